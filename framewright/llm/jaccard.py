"""N-gram Jaccard join: rare-first prefix filtering, verified once per pair, with components.

1. One pass over the texts hashes each document's shingle set, gives equal sets one key and counts
   all shingles into a table of fixed size.
2. A second pass orders each set rarest first by that table and emits its prefix, once per key and
   task.  The table only orders: any total order gives exact results.
3. Prefixes meet by shingle.  Length and positional filters leave candidate pairs; a shingle that
   very many sets hold first tries two of them against the rest, because members of one component
   need no further links between them; what is still apart then is compared in tiles of whole
   sets, so no link between components is lost.  The run of a shingle that the table counts as very
   frequent is dealt to several tasks by key; the leaders of its parts then meet in a run of their own.
4. Distinct candidates are verified once on the whole sets, behind a suffix filter, and the links
   are closed to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import Forest, connected_components, stored

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
TABLE_BITS = 22
TABLE_PARTS = 64
SHORT_RUN = 48
HOT_RUN, PART_RUN = 4096, 2048  # documents of a shingle above the usual from which on its run is split, and rows in a part
RUN_PARTS = 16


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words_per: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    A-Z are lower-cased; words are what ASCII white space separates.  Fewer words than a shingle
    make one shingle of them all; no words make the empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < words_per:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    n = len(h) - words_per + 1
    s = np.zeros(n, np.uint64)
    for k in range(words_per):
        s = scramble(s + h[k : k + n] * MIX[k % len(MIX)])
    return np.unique(s)


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of a set's 128-bit hash: its key, and a check that tells sets of one key apart."""
    key, check = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist()
    return key, check


def set_key(s: np.ndarray, shared: frozenset[int] = frozenset(), keys_of=set_keys) -> int:
    """The key; where it is one of those that unequal sets share, the check instead."""
    key, check = keys_of(s)
    return check if key in shared else key


def overlap_needed(na, nb, t: int):
    """Least intersection with which 100 * intersection >= t * union."""
    return -((-t * (na + nb)) // (100 + t))


def probe_prefix(n, t: int):
    return n - (-(-t * n // 100)) + 1


def index_prefix(n, t: int):
    return n - (-(-2 * t * n // (100 + t))) + 1


def suffix_distance(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the sets' symmetric difference, by splitting both at a's median again and again."""
    if not depth or not len(a) or not len(b):
        return abs(len(a) - len(b))
    i = len(a) // 2
    j = int(np.searchsorted(b, a[i]))
    return suffix_distance(a[:i], b[:j], depth - 1) + suffix_distance(a[i:], b[j:], depth - 1)


def linked(a: np.ndarray, b: np.ndarray, t: int) -> bool:
    need = int(overlap_needed(len(a), len(b), t))
    if min(len(a), len(b)) < need or suffix_distance(a, b) > len(a) + len(b) - 2 * need:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def _describe(words_per: int, bits: int, keys_of):
    """(doc_id, text_hash, key, check, n) of each row, and the task's counts of shingles in parts of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "text_hash", "key", "check", "n", "part", "counts"]
        for b in batches:
            sets = [shingle_set(t, words_per) for t in b["text"].to_pylist()]
            n = len(sets)
            if n:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            keys = [keys_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        tool = zstandard.ZstdCompressor(level=3)
        parts = [(k, tool.compress(c.tobytes())) for k, c in enumerate(counts.reshape(TABLE_PARTS, -1)) if c.any()]
        m = len(parts)
        yield pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 5, pa.array([k for k, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], names)

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts summed over tasks, as rarity classes: eight to a doubling of the count."""
    sums: dict[int, np.ndarray] = {}
    tool = zstandard.ZstdDecompressor()
    for b in batches:
        for k, c in zip(b["part"].to_pylist(), b["counts"].to_pylist(), strict=True):
            c = np.frombuffer(tool.decompress(c), np.uint32).astype(np.uint64)
            sums[k] = sums[k] + c if k in sums else c
    classes = [np.minimum(255, np.rint(8 * np.log2(1.0 + c))).astype(np.uint8).tobytes() for c in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(classes, pa.binary())], ["part", "counts"])


def split_parts(rarity: np.ndarray, usual: float) -> np.ndarray:
    """Parts that a shingle's run is dealt to, by its rarity class: 1, or of a very frequent one as many as have PART_RUN rows each.

    ``usual`` is the mean count of the table's buckets, which grows with the corpus; a bucket counts
    as that of a very frequent shingle only where it stands out from what is usual.
    """
    count = np.exp2(rarity / 8.0)
    return np.where(count > HOT_RUN + 4 * usual, np.ceil((count - usual) / PART_RUN), 1).astype(np.uint64)


def _prefixes(words_per: int, t: int, table, bits: int, shared: frozenset[int], keys_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = np.frombuffer(table.value, np.uint8)
        usual = float((np.bincount(rare, minlength=256) * (np.exp2(np.arange(256) / 8.0) - 1)).sum() / len(rare))
        seen: set[int] = set()
        for b in batches:
            toks, salts, keys, ns, poss = [], [], [], [], []
            for text, doc_id in zip(b["text"].to_pylist(), b["doc_id"].to_pylist(), strict=True):
                s = shingle_set(text, words_per) if doc_id is not None else ()
                n = len(s)
                if not n or (key := set_key(s, shared, keys_of)) in seen:
                    continue
                if len(seen) < 5_000_000:
                    seen.add(key)
                p = int(probe_prefix(n, t))
                order = (rare[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
                first = first[np.lexsort((s[first], order[first]))]
                parts = split_parts(order[first] >> np.uint64(56), usual)
                # rows of a very frequent shingle are dealt by their keys; -1 for all others
                own = int(scramble(np.array([key], np.int64).view(np.uint64))[0])
                salts.append(np.where(parts > 1, (np.uint64(own) % parts).astype(np.int64), -1).astype(np.int32))
                toks.append(s[first].view(np.int64))
                keys.append(np.full(p, key, np.int64))
                ns.append(np.full(p, n, np.int32))
                poss.append(np.arange(p, dtype=np.int32))
            if toks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (toks, salts, keys, ns, poss)], ["token", "salt", "key", "n", "pos"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Arrays of whole runs of equal tokens from rows sorted by token; a run may span batches."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        cols = [b[c].to_numpy() for c in columns]
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        if held and held[-1][0][0] != cols[0][-1] or cut:
            held.append([c[:cut] for c in cols])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _passes(n, pos, i, j, t: int) -> np.ndarray:
    """Length, index-prefix and positional filters for rows i and j of one run, n[i] <= n[j]."""
    ni, nj = n[i].astype(np.int64), n[j].astype(np.int64)
    room = 1 + np.minimum(ni - pos[i] - 1, nj - pos[j] - 1)
    return (100 * ni >= t * nj) & (pos[i] < index_prefix(ni, t)) & (room >= overlap_needed(ni, nj, t))


def _leaders(key) -> list[int]:
    """Two members of a run, the same ones in most runs of a group."""
    return list(dict.fromkeys(int(np.argmin(scramble(key.view(np.uint64) ^ m))) for m in MIX[:2]))


def _star(n, pos, leaders: list[int], t: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the leaders with all the rest; rows are in order of n."""
    left, right = [], []
    every = np.arange(len(n))
    for lead in leaders:
        rest = every[every != lead]
        i, j = np.minimum(rest, lead), np.maximum(rest, lead)
        ok = _passes(n, pos, i, j, t)
        left.append(i[ok])
        right.append(j[ok])
    return np.concatenate(left), np.concatenate(right)


def _pair_batch(kind: int, a, b, n, pos) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n), pa.array(pos)], ["kind", "a", "b", "n", "pos"])


def _candidates(t: int):
    """Kind 0: candidate pairs of keys.  Kind 1: rows (token, key, n, pos) of long or split runs, for later rounds.

    Kind 2: of each part of a split run the rows of its leaders, through which the parts meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tok, salt, key, n, pos in _runs(batches, ["token", "salt", "key", "n", "pos"]):
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (key[1:] != key[:-1])
            tok, salt, key, n, pos = tok[new], salt[new], key[new], n[new], pos[new]
            start = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])])
            size = np.diff(np.r_[start, len(tok)])
            long = (size > SHORT_RUN) | (salt[start] >= 0)
            run_of = np.repeat(np.arange(len(start)), size)
            live = np.flatnonzero((size[run_of] > 1) & ~long[run_of])
            found_a, found_b = [], []
            step = 1
            while len(live):
                live = live[live + step < (start + size)[run_of[live]]]
                i, j = live, live + step
                ok = _passes(n, pos, i, j, t)
                found_a.append(key[i[ok]])
                found_b.append(key[j[ok]])
                step += 1
            for r in np.flatnonzero(long):
                at = slice(start[r], start[r] + size[r])
                leaders = _leaders(key[at])
                i, j = _star(n[at], pos[at], leaders, t)
                found_a.append(key[at][i])
                found_b.append(key[at][j])
                yield _pair_batch(1, tok[at], key[at], n[at], pos[at])
                if salt[start[r]] >= 0:
                    yield _pair_batch(2, tok[at][leaders], key[at][leaders], n[at][leaders], pos[at][leaders])
            if found_a:
                pairs = np.stack([np.concatenate(found_a), np.concatenate(found_b)], axis=1)
                pairs.sort(axis=1)
                pairs = np.unique(pairs, axis=0)
                zero = np.zeros(len(pairs), np.int32)
                yield _pair_batch(0, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), zero, zero)

    return run


def _rejoin(t: int):
    """Links between rows of a tile whose components differ: (a, b), at most one per pair of components joined.

    ``side`` 1 are rows outside the group's main component, ``side`` 0 all its rows.  Shared
    shingles are counted by an inverted index of the tile; every pair is compared in full.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        few, all_ = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0]
        sets = [np.frombuffer(x, np.uint64) for x in all_["items"]]
        size = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        keys, comps = all_["key"].to_numpy(), all_["comp"].to_numpy()
        forest, out = Forest(), []
        for key, comp, items in zip(few["key"].tolist(), few["comp"].tolist(), few["items"], strict=True):
            x = np.frombuffer(items, np.uint64)
            lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
            spans = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            for j in np.flatnonzero((comps != comp) & (shared >= overlap_needed(len(x), size, t))).tolist():
                if forest.join(comp, int(comps[j])):
                    out.append((key, int(keys[j])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def _wanted_bits(keys: DataFrame, bits: int = 24) -> bytes:
    """A bitmap of fixed size in which the hash of every key is set; 2 MB reach the driver, however many keys."""
    spot = F.pmod(F.xxhash64("key"), F.lit(1 << bits))
    words = keys.select(spot.alias("s")).selectExpr("s div 32 as w", "shiftleft(1L, cast(s % 32 as int)) as bit")
    rows = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.uint32)
    return out.tobytes()


def _wanted_sets(words_per: int, wanted, shared: frozenset[int], keys_of):
    """(key, set) of rows whose doc_id may be wanted; decided before any hashing of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint32)
        for b in batches:
            spot = b["spot"].to_numpy()
            hit = (bits[spot >> 5] >> (spot & 31).astype(np.uint32)) & 1
            texts = b["text"].filter(pa.array(hit.astype(bool))).to_pylist()
            sets = [shingle_set(x, words_per) for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s, shared, keys_of) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "items"])

    return run


def _verify(t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), t) for x, y in zip(b["items_a"].to_pylist(), b["items_b"].to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(keep), b["b"].filter(keep)], ["a", "b"])

    return run


def join_in_parts(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with a table of one row per ``on``, which most rows may share: met in RUN_PARTS parts by key."""
    part = F.explode(F.sequence(F.lit(0), F.lit(RUN_PARTS - 1)))
    return rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(RUN_PARTS)).cast("int")).join(small.withColumn("part", part), [*on, "part"]).drop("part")


class JaccardJoin:
    """Components of documents whose shingle sets have 100 * intersection >= threshold * union."""

    def __init__(self, docs: DataFrame, threshold: int = 85, words_per: int = 4, table_bits: int = TABLE_BITS, keys_of=set_keys) -> None:
        self.spark = docs.sparkSession
        self.keys_of = keys_of
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
        self.t, self.words_per, self.bits = threshold, words_per, table_bits

    def describe(self) -> None:
        both = stored(self.docs.mapInArrow(_describe(self.words_per, self.bits, self.keys_of), "doc_id long, text_hash long, key long, check long, n long, part int, counts binary"), "jaccard-sets")
        rows = both.where("part is null")
        # keys that unequal sets share: none is expected below some billions of sets, hundreds at a hundred billion
        twice = rows.where("n > 0").groupBy("key").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
        self.shared = frozenset(r["key"] for r in twice.select("key").collect())
        if self.shared:
            rows = rows.withColumn("key", F.when(F.col("key").isin(*self.shared), F.col("check")).otherwise(F.col("key")))
        self.rows = rows.select("doc_id", "text_hash", "key", "n")
        parts = both.where("part is not null").select("part", "counts").repartition(TABLE_PARTS, "part").mapInArrow(_sum_counts, "part int, counts binary").collect()
        size = (1 << self.bits) // TABLE_PARTS
        table = bytearray(1 << self.bits)  # fixed size, whatever the corpus
        for part, classes in parts:
            table[part * size : (part + 1) * size] = classes
        self.table = self.spark.sparkContext.broadcast(bytes(table))
        self.classes = stored(self.rows.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("key", "first", F.col("first.doc_id").alias("rep")), "jaccard-classes")

    def members(self, keys: DataFrame) -> DataFrame:
        """(key, items): the whole sets of the given keys, each from one document that has it."""
        wanted = stored(keys.join(self.classes, "key").select("key", "rep"), "jaccard-wanted")
        bitmap = self.spark.sparkContext.broadcast(_wanted_bits(wanted.select(F.col("rep").alias("key"))))
        spotted = self.docs.where("doc_id is not null").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 24)).cast("int").alias("spot"))
        sets = spotted.mapInArrow(_wanted_sets(self.words_per, bitmap, self.shared, self.keys_of), "key long, items binary").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])
        return stored(sets, "jaccard-members")

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of distinct candidate pairs of keys that hold, on whole sets; each is verified once."""
        pairs = stored(pairs.distinct(), "jaccard-pairs")
        sets = self.members(pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct())
        withs = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("items_a")), "a").join(sets.select(F.col("key").alias("b"), F.col("items").alias("items_b")), "b")
        return stored(withs.mapInArrow(_verify(self.t), "a long, b long"), "jaccard-links")

    def place(self, rows: DataFrame, comps: DataFrame) -> DataFrame:
        """``rows`` with ``comp``, the component of their key; a key without links is its own."""
        return rows.join(comps.select(F.col("node").alias("key"), F.col("component").alias("comp")), "key", "left").withColumn("comp", F.coalesce("comp", "key"))

    def rejoin(self, waiting: DataFrame, comps: DataFrame, tile: int = 512, tile_items: int = 1_000_000) -> DataFrame:
        """Links between components that long runs still hold apart, or None if no run does.

        Runs that share keys make a group.  Its rows outside the group's largest component meet its rows
        of like length, tile by tile: rows are sent, not pairs, and rows of one component are not
        compared.  Lengths are bucketed so that sets in buckets further apart than neighbours cannot
        reach the threshold.  A tile holds about ``tile`` rows of each side, fewer where sets are
        large: ``tile_items`` shingles.
        """
        placed = self.place(waiting, comps)
        split = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
        placed = stored(join_in_parts(placed, split, ["token"]).select("token", "key", "n", "comp"), "jaccard-open")
        if placed.limit(1).count() == 0:
            return None
        groups = connected_components(placed.select(F.col("token").alias("a"), F.col("key").alias("b")))
        step = float(np.log(100 / self.t)) * 1.0001
        rows = placed.select("key", "n", "comp").distinct().join(groups.select(F.col("node").alias("key"), F.col("component").alias("grp")), "key")
        rows = stored(rows.withColumn("len", F.floor(F.log(F.col("n")) / step).cast("int") if self.t < 100 else F.col("n").cast("int")), "jaccard-groups")
        main = rows.groupBy("grp", "comp").agg(F.count("*").alias("rows")).groupBy("grp").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"))
        rows = join_in_parts(rows, main, ["grp"]).withColumn("few", F.col("comp") != F.col("main"))
        need = lambda x: F.greatest(F.lit(0), F.ceil(F.count(x) / F.lit(tile) + F.coalesce(F.sum(F.when(x.isNotNull(), F.col("n"))), F.lit(0)) / F.lit(tile_items))).cast("int")
        parts = stored(rows.groupBy("grp", "len").agg(need(F.col("key")).alias("t_all"), need(F.when(F.col("few"), F.col("key"))).alias("t_few")), "jaccard-parts")
        # for each bucket of lengths, those beside it that its rows meet
        near = parts.select("grp", "len", F.explode(F.array(F.col("len") - 1, F.col("len"), F.col("len") + 1)).alias("other"))
        met = near.join(parts.select("grp", F.col("len").alias("other"), F.col("t_all").alias("o_all"), F.col("t_few").alias("o_few")), ["grp", "other"])
        met = met.groupBy("grp", "len").agg(F.collect_list(F.struct("other", "o_all", "o_few")).alias("met")).join(parts, ["grp", "len"])
        rows = join_in_parts(rows, met, ["grp", "len"])
        rows = stored(rows.join(self.members(rows.select("key").distinct()), "key"), "jaccard-group-sets")
        own = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
        # a tile is a part i of all rows of bucket x and a part j of the few of bucket y
        every = rows.select("grp", "key", "comp", "items", F.lit(0).alias("side"), F.col("len").alias("x"), own(F.col("t_all")).alias("i"), F.explode("met").alias("m")).where("m.o_few > 0")
        every = every.select("grp", "key", "comp", "items", "side", "x", "i", F.col("m.other").alias("y"), F.explode(F.sequence(F.lit(0), F.col("m.o_few") - 1)).alias("j"))
        few = rows.where("few").select("grp", "key", "comp", "items", F.lit(1).alias("side"), F.explode("met").alias("m"), F.col("len").alias("y"), own(F.col("t_few")).alias("j"))
        few = few.select("grp", "key", "comp", "items", "side", F.col("m.other").alias("x"), F.explode(F.sequence(F.lit(0), F.col("m.o_all") - 1)).alias("i"), "y", "j")
        return stored(every.unionByName(few).groupBy("grp", "x", "i", "y", "j").applyInPandas(_rejoin(self.t), "a long, b long"), "jaccard-rejoined")

    def components(self, links: DataFrame) -> DataFrame:
        return connected_components(links)

    def run(self) -> DataFrame:
        """(doc_id, n, component, text_hash, first) of every row; component is the smallest doc_id reached by links.

        ``text_hash`` is xxhash64 of the text; ``first`` is true for the row of the component's smallest
        (doc_id, text_hash), and for rows that link with nothing.  Null doc_ids link with nothing
        and have a null component; empty sets stand alone.  Repeated rows have a row each; one
        doc_id may stand on several texts, which link each on their own.  Texts are read whole, of any
        length; further columns are not carried.
        """
        self.describe()
        schema = "kind int, a long, b long, n int, pos int"
        prefixes = self.docs.select("doc_id", "text").mapInArrow(_prefixes(self.words_per, self.t, self.table, self.bits, self.shared, self.keys_of), "token long, salt int, key long, n int, pos int")
        dealt = prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key")
        found = stored(dealt.mapInArrow(_candidates(self.t), schema), "jaccard-candidates")
        # parts of one run meet through their leaders, two a part
        heads = found.where("kind = 2").select(F.col("a").alias("token"), F.lit(-1).alias("salt"), F.col("b").alias("key"), "n", "pos")
        across = heads.repartition("token").sortWithinPartitions("token", "n", "key").mapInArrow(_candidates(self.t), schema).where("kind = 0")
        tested = found.where("kind = 0").select("a", "b").unionAll(across.select("a", "b"))
        links = self.links(tested)
        comps = self.components(links)
        waiting = found.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("key"), "n", "pos")
        more = self.rejoin(waiting, comps) if waiting.limit(1).count() else None
        if more is not None:
            comps = self.components(links.unionAll(more))
        # keys to their first rows: of the class, then of the component of classes
        placed = self.place(self.classes, comps)
        least = placed.groupBy("comp").agg(F.min("first").alias("top"))
        by_key = placed.join(least, "comp").select("key", "top")
        whole = self.rows.where("n > 0 and doc_id is not null").join(by_key, "key").select("doc_id", "n", F.col("top.doc_id").alias("component"), "text_hash", (F.struct("doc_id", "text_hash") == F.col("top")).alias("first"))
        alone = self.rows.where("not (n > 0 and doc_id is not null)").select("doc_id", "n", F.col("doc_id").alias("component"), "text_hash", F.lit(True).alias("first"))
        return whole.unionAll(alone)


def op10_rows(docs: DataFrame) -> DataFrame:
    out = JaccardJoin(docs, threshold=85, words_per=4).run()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: The same rows in DuckDB's SQL, by all shared shingles: for small tables.
OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(a, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.x = p.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT a AS doc_id, min(x) AS component_id FROM r GROUP BY a) LEFT JOIN n USING (doc_id)
"""
