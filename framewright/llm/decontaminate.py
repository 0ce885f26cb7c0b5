"""Benchmark decontamination: a BM25 index of test items, searched by block-max WAND.

Posting lists are sorted by item and cut into blocks of neighbours; each list keeps the largest impact
of each of its blocks and of the whole.  Every passage of every training text is a query.  The block
maxima are first held against all words of a text: where no block can reach the threshold, no
passage of the text can.  Otherwise each passage walks the lists of its words: the pivot is the
first block at which the lists' maxima add up to the threshold, the block's own maxima decide whether
it is scored, and every item scored at or above the threshold is retrieved.  Impacts are divided by
the item's score for its own text, so the threshold is the share of an item that a passage covers,
weighed by rarity.  What is retrieved is verified: enough word n-grams of the item's question and of
its answer must stand in the passage.

Document frequencies and the mean length are those of all items, however many indexes they are
dealt to, and a passage's width depends on the item's own length: neither the number of items nor
their order changes a score.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import stored

K1, B = 1.2, 0.75
BLOCK = 16
GRAM = 4
WIDTH_STEP = 64  # items are searched in passages four times their length, rounded up to this
INDEX_BYTES = 64 << 20
TABLE = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
OTHER_MARKS = re.compile(r"[^\w\s\x00-\x7f]+")
#: Letters of scripts that put no spaces between words: each is a word of its own.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8; punctuation of any script separates."""
    text = (text or "").lower()
    if not text.isascii():
        text = UNSPACED.sub(r" \1 ", OTHER_MARKS.sub(" ", text))
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what stands before it the question; one sentence is both."""
    ends = [m.end() for m in re.finditer(r"[.!?]+\s+(?=\S)", text.strip())]
    cut = ends[-1] if ends else 0
    text = text.strip()
    return (text[:cut], text[cut:]) if cut else (text, text)


def ngrams(words: list[bytes], n: int) -> set[tuple]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass
class Item:
    item_id: int
    size: int
    question: set = field(default_factory=set)
    answer: set = field(default_factory=set)
    question_n: int = 0
    answer_n: int = 0

    @property
    def width(self) -> int:
        """Words of the passages in which the item is looked for: half of them hold it with as many words put between its own."""
        return 4 * WIDTH_STEP * -(-self.size // WIDTH_STEP)


@dataclass(frozen=True)
class Statistics:
    """What BM25 takes from the whole collection."""

    items: int
    mean: float

    def idf(self, df: int) -> float:
        return math.log(1 + (self.items - df + 0.5) / (df + 0.5))

    def impact(self, tf: int, df: int, size: int) -> float:
        return self.idf(df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start[i]..stop[i]-1, one range after another."""
    size = stop - start
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass
class PostingList:
    most: float  # the largest impact
    blocks: list[int]
    places: list[int]  # of the blocks in the index


class Bm25Index:
    """Inverted index of some test items with impacts scaled to the item's own score."""

    def __init__(self, items: list[tuple[int, str, list[bytes], list[int], list[int]]], whole: Statistics, gram: int = GRAM) -> None:
        """``items``: (item_id, text, terms, their counts in the item, their document frequencies in all items)."""
        # neighbours share a block: items of like length have like impacts
        items = sorted((x for x in items if x[2]), key=lambda x: (sum(x[3]), x[0], x[1]))
        self.items: list[Item] = []
        rows: list[tuple[bytes, int, float]] = []
        for k, (item_id, text, terms, tfs, dfs) in enumerate(items):
            size = sum(tfs)
            terms, tfs, dfs = zip(*sorted(zip(terms, tfs, dfs, strict=True)), strict=True)
            raw = [whole.impact(tf, df, size) for tf, df in zip(tfs, dfs, strict=True)]
            own = sum(raw)
            rows += [(t, k, v / own) for t, v in zip(terms, raw, strict=True)]
            q, a = (words_of(x) for x in question_and_answer(text))
            self.items.append(Item(item_id, size, ngrams(q, gram), ngrams(a, gram), min(gram, len(q)), min(gram, len(a))))
        rows.sort()
        self.ids: dict[bytes, int] = {}
        term = np.array([self.ids.setdefault(t, len(self.ids)) for t, _, _ in rows], np.int64)
        #: Posting lists one after another: items and impacts.
        self.post_item = np.array([k for _, k, _ in rows], np.int32)
        self.post_impact = np.array([v for _, _, v in rows], np.float64)
        block = self.post_item.astype(np.int64) // BLOCK
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(rows) else np.zeros(0, np.int64)
        #: Blocks of the lists: number, first and last posting, largest impact.
        self.block = block[new].astype(np.int32)
        self.block_from, self.block_to = new, np.r_[new[1:], len(rows)] if len(rows) else new
        self.block_max = np.maximum.reduceat(self.post_impact, new) if len(rows) else np.zeros(0)
        first = np.flatnonzero(np.r_[True, term[new][1:] != term[new][:-1]]) if len(rows) else np.zeros(0, np.int64)
        #: Of each term its blocks.
        self.from_, self.to = first, np.r_[first[1:], len(new)] if len(rows) else first
        self.blocks = -(-len(self.items) // BLOCK)

    def live(self, ids: np.ndarray, threshold: float) -> np.ndarray:
        """Blocks whose maxima over the query's terms add up to the threshold."""
        at = spans(self.from_[ids], self.to[ids])
        return np.flatnonzero(np.bincount(self.block[at], self.block_max[at], self.blocks) >= threshold - 1e-9)

    def scores(self, ids: np.ndarray, blocks: np.ndarray) -> dict[int, float]:
        """Scores of all items of some blocks, list by list."""
        at = spans(self.from_[ids], self.to[ids])
        at = at[np.isin(self.block[at], blocks)]
        post = spans(self.block_from[at], self.block_to[at])
        total = np.bincount(self.post_item[post], self.post_impact[post], len(self.items))
        return {k: float(total[k]) for k in np.flatnonzero(total).tolist()}

    def lists(self, ids: np.ndarray, blocks: np.ndarray | None = None) -> dict[int, PostingList]:
        """The posting lists of distinct terms, or of them what lies in some blocks; terms with nothing there are left out."""
        at = spans(self.from_[ids], self.to[ids])
        owner = np.repeat(ids, self.to[ids] - self.from_[ids])
        if blocks is not None:
            keep = np.isin(self.block[at], blocks)
            at, owner = at[keep], owner[keep]
        out: dict[int, PostingList] = {}
        for t, k, blk, most in zip(owner.tolist(), at.tolist(), self.block[at].tolist(), self.block_max[at].tolist(), strict=True):
            if (got := out.get(t)) is None:
                out[t] = PostingList(most, [blk], [k])
            else:
                got.most = max(got.most, most)
                got.blocks.append(blk)
                got.places.append(k)
        return out

    def search(self, held: list[PostingList], threshold: float) -> list[tuple[int, float]]:
        """(item position, score) of every item that scores at least ``threshold`` for the lists' terms."""
        need = threshold - 1e-9
        if sum(x.most for x in held) < need:
            return []
        lists = [[0, x.most, x.places, x.blocks, k] for k, x in enumerate(held)]
        out = []
        while lists:
            lists.sort(key=lambda x: x[3][x[0]])
            # the pivot: no block before it can reach the threshold
            total, pivot = 0.0, None
            for x in lists:
                total += x[1]
                if total >= need:
                    pivot = x[3][x[0]]
                    break
            if pivot is None:
                break
            for x in lists:
                while x[0] < len(x[3]) and x[3][x[0]] < pivot:
                    x[0] += 1
            lists = [x for x in lists if x[0] < len(x[3])]
            # summed in the order given, so that equal passages get equal scores in any index
            here = sorted((x for x in lists if x[3][x[0]] == pivot), key=lambda x: x[4])
            if sum(self.block_max[x[2][x[0]]] for x in here) >= need:
                scores = np.zeros(BLOCK)
                for x in here:
                    a, b = self.block_from[x[2][x[0]]], self.block_to[x[2][x[0]]]
                    scores[self.post_item[a:b] - pivot * BLOCK] += self.post_impact[a:b]
                out += [(pivot * BLOCK + k, float(scores[k])) for k in np.flatnonzero(scores >= need).tolist()]
            for x in here:
                x[0] += 1
            lists = [x for x in lists if x[0] < len(x[3])]
        return out


@dataclass(frozen=True)
class Limits:
    score: float = 0.7  # share of an item's own BM25 score
    question: float = 0.6  # share of the question's n-grams
    answer: float = 0.6  # share of the answer's n-grams


def passages(n: int, width: int) -> list[tuple[int, int]]:
    """Windows of ``width`` words, each half a window on; every span of width / 2 words is inside one."""
    step = max(1, width // 2)
    return [(s, min(n, s + width)) for s in range(0, max(1, n - step), step)] if n else []


class Searcher:
    def __init__(self, index: Bm25Index, limits: Limits, gram: int = GRAM) -> None:
        self.index, self.limits, self.gram = index, limits, gram

    def leaks(self, text: str | None, words: list[bytes] | None = None) -> list[tuple[int, float, float, float, int]]:
        """(item_id, score, question share, answer share, first word of the passage), best passage per item."""
        ix = self.index
        words = words_of(text) if words is None else words
        if not words or not ix.items:
            return []
        get = ix.ids.get
        # the whole text bounds its passages: a block or item that it does not reach, they don't
        whole = {w: i for w in set(words) if (i := get(w)) is not None}
        ids = np.fromiter(whole.values(), np.int64, len(whole))
        blocks = ix.live(ids, self.limits.score)
        reached = [k for k, v in ix.scores(ids, blocks).items() if v >= self.limits.score - 1e-9] if len(blocks) else []
        if not reached:
            return []
        widths: dict[int, set[int]] = {}
        for k in reached:
            widths.setdefault(ix.items[k].width, set()).add(k // BLOCK)
        at = [whole.get(w, -1) for w in words]
        best: dict[int, tuple] = {}
        for width, near in widths.items():
            lists = ix.lists(ids, np.array(sorted(near)))
            for lo, hi in passages(len(words), width):
                grams: dict[int, set] = {}
                for k, score in ix.search([lists[t] for t in sorted(set(at[lo:hi])) if t in lists], self.limits.score):
                    item = ix.items[k]
                    if item.width != width:
                        continue
                    shares = []
                    for want, n in ((item.question, item.question_n), (item.answer, item.answer_n)):
                        if n not in grams:
                            grams[n] = ngrams(words[lo:hi], n) if n else set()
                        shares.append(len(want & grams[n]) / len(want) if want else 1.0)
                    if shares[0] >= self.limits.question and shares[1] >= self.limits.answer:
                        row = (score, *shares, -lo)
                        if item.item_id not in best or row > best[item.item_id]:
                            best[item.item_id] = row
        return [(i, s, q, a, -lo) for i, (s, q, a, lo) in sorted(best.items())]


def index_shards(benchmark: DataFrame, most: int = 50_000, most_bytes: int = INDEX_BYTES) -> list[list[Broadcast]]:
    """Broadcast indexes of at most ``most`` items and ``most_bytes`` each, in groups of no more bytes; each item is in one.

    Statistics are taken over all items, words are counted and joined on the executors.  Null items
    are left out; equal item_ids keep all their texts; repeated rows count once.
    """
    spark = benchmark.sparkSession

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter(words_of(t)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["item_id"], b["text"], pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))],
                ["item_id", "text", "terms", "tfs"],
            )

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates()
    items = stored(rows.mapInArrow(split, "item_id long, text string, terms array<binary>, tfs array<long>").where("size(terms) > 0"), "benchmark-items")
    size = F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)
    n, words = items.agg(F.count("*"), F.sum(size)).first()
    if not n:
        return []
    whole = Statistics(n, words / n)
    flat = items.select("item_id", "text", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("item_id", "text", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
    df = flat.groupBy("term").agg(F.count("*").alias("df"))
    counted = flat.join(df, "term").groupBy("item_id", "text").agg(F.collect_list(F.struct("term", "tf", "df")).alias("terms"))
    counted = stored(counted, "benchmark-terms")
    shards = -(-n // most)
    while True:
        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            own = [(i, t, [bytes(x["term"]) for x in w], [x["tf"] for x in w], [x["df"] for x in w]) for i, t, w in zip(pdf["item_id"].tolist(), pdf["text"], pdf["terms"], strict=True)]
            return pd.DataFrame({"data": [pickle.dumps(Bm25Index(own, whole))]})

        dealt = counted.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
        built = stored(dealt.groupBy("shard").applyInPandas(build, "data binary"), "benchmark-index")
        largest = built.agg(F.max(F.octet_length("data"))).first()[0]
        if largest <= most_bytes or shards >= n:
            break
        shards = min(n, 2 * shards)
    groups: list[list[Broadcast]] = []
    room = 0
    # one index at a time on the driver; broadcasts are kept on disk
    for r in built.select("data").toLocalIterator():
        if room < len(r["data"]):
            groups.append([])
            room = max(most_bytes, len(r["data"]))
        room -= len(r["data"])
        groups[-1].append(spark.sparkContext.broadcast(bytes(r["data"])))
    return groups


def _searchers(held: list[Broadcast], limits: Limits) -> list[Searcher]:
    return [Searcher(pickle.loads(x.value), limits) for x in held]


def find_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), most: int = 50_000) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word), one row per document and item found.

    Texts are read whole, of any length, in place, once per group of indexes; null and empty texts
    and null items yield nothing; repeated rows yield a row each.  Of an item's passages the one
    of the highest score, then shares, then the earliest is told; equal item_ids on several texts
    share a row.  Further columns are not carried; either table may be empty.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    out = None
    for held in index_shards(benchmark, most):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tools = _searchers(held, limits)
            for b in batches:
                rows = []
                for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    words = words_of(t)
                    rows += [(i, *x) for tool in tools for x in tool.leaks(t, words)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of ``docs``, with all their columns, in whose text no item is found, decided where the text is read: nothing is shuffled.

    Rows with null or empty texts stay, as do repeated rows and those with null ids.
    """
    clean = docs
    for held in index_shards(benchmark):
        clean = clean.where(_free(held, limits)(F.col("text")))
    return clean


def _free(held: list[Broadcast], limits: Limits):
    @F.pandas_udf("boolean")
    def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = _searchers(held, limits)
        for texts in batches:
            yield pd.Series([not any(tool.leaks(t, words) for words in [words_of(t)] for tool in tools) for t in texts], dtype=bool)

    return free
