"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learnt from labelled documents: words, and stems that many words share, found far
more often in toxic texts.  Its trie is intersected with the Levenshtein automata of all entries;
the product automaton is determinised on demand, so a word costs one table step per character and
most words die after two or three.  Each hit is judged in a window of words around it: inside
quotation marks or after a verb of reporting it counts as a quotation, otherwise as abuse.  A
logistic regression over the counts of both kinds gives the score of the whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import fit_logistic, held_out, labelled_sample

WORD = re.compile(r"[^\W_]+")
QUOTE_CHARS = "\"“”«»„"
#: Verbs and nouns of reporting, to start from; those of the labelled texts are learnt besides.
REPORTING = frozenset("said says say wrote called calls quoted quote word words term insult insults slur slurs sagte schrieb nannte wort dit appelle mot dijo llama palabra".split())
WINDOW = 5
STEM_MIN = 4
OWN_WORDS = 3  # ordinary words near an entry from which on its misspellings are doubtful


def edits_allowed(n: int) -> int:
    """Edits that an entry of ``n`` characters tolerates: short words are too close to ordinary ones."""
    return 0 if n < 5 else 1 if n < 9 else 2


@dataclass(frozen=True)
class ToxicModel:
    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...]
    banned: frozenset[str] = field(default_factory=frozenset)  # spellings that are ordinary words
    amid: frozenset[str] = field(default_factory=frozenset)  # entries amid ordinary words: their misspellings are doubtful
    reporting: frozenset[str] = REPORTING


class LexiconAutomaton:
    """Words and stems in one trie, run against all their Levenshtein automata at once.

    A nondeterministic state is (trie node, edits left); stem ends accept any continuation.  Sets
    of such states are numbered and their transitions kept, so later words walk a plain table.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], amid: frozenset[str] = frozenset(), exact: frozenset[str] = frozenset(), limit: int = 200_000) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.value: list[float] = [0.0]
        self.stem: list[float] = [0.0]
        self.left: list[set[int]] = [set()]
        self.budget: list[int] = [-1]
        self.doubtful: set[int] = set()
        for entries, is_stem in ((words, False), (stems, True)):
            for text, weight in entries.items():
                k = 0 if is_stem or text in exact else edits_allowed(len(text))
                self._insert(text, weight, k, is_stem)
                if text in amid and not is_stem:
                    self.doubtful.add(self.node_of(text))
        self.limit = limit
        self.amid = amid
        self.reset()

    def _insert(self, text: str, weight: float, k: int, is_stem: bool) -> None:
        node = 0
        self.left[0].add(k)
        for ch in text:
            nxt = self.children[node].get(ch)
            if nxt is None:
                nxt = len(self.value)
                self.children.append({})
                self.value.append(0.0)
                self.stem.append(0.0)
                self.left.append(set())
                self.budget.append(-1)
                self.children[node][ch] = nxt
            node = nxt
            self.left[node].add(k)
        if is_stem:
            self.stem[node] = max(self.stem[node], weight)
        else:
            self.value[node] = max(self.value[node], weight)
            self.budget[node] = k

    def node_of(self, text: str) -> int:
        node = 0
        for ch in text:
            node = self.children[node][ch]
        return node

    def reset(self) -> None:
        """Forget the determinised part; it is rebuilt on demand, so memory stays bounded."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[float, int]] = []
        self.start = self._number(self._closure({(0, k, k) for k in self.left[0]}))

    def _closure(self, states: set) -> frozenset:
        """Add what skipping trie characters reaches; (node, budget of the entry, edits left)."""
        todo = list(states)
        seen = set(states)
        while todo:
            node, k, left = todo.pop()
            if left:
                for nxt in self.children[node].values():
                    if k in self.left[nxt] and (s := (nxt, k, left - 1)) not in seen:
                        seen.add(s)
                        todo.append(s)
        best: dict = {}
        for node, k, left in seen:
            best[(node, k)] = max(left, best.get((node, k), -1))
        return frozenset((n, k, left) for (n, k), left in best.items())

    def _number(self, states: frozenset) -> int:
        if not states:
            return -1
        i = self.ids.get(states)
        if i is None:
            i = self.ids[states] = len(self.sets)
            self.sets.append(states)
            self.steps.append({})
            best = (0.0, 0)
            for node, k, left in states:
                # an entry's own budget decides: nodes of longer entries passed on the way don't accept
                if self.value[node] and self.budget[node] == k:
                    kind = 1 if left == k else 3 if node in self.doubtful else 2
                    # what is no doubtful spelling of any entry counts as such
                    if not best[1] or (kind == 3, -self.value[node]) < (best[1] == 3, -best[0]):
                        best = (self.value[node] * (1.0 if left == k else 0.9), kind)
            self.accept.append(best)
        return i

    def _step(self, i: int, ch: str) -> int:
        out = set()
        for node, k, left in self.sets[i]:
            if self.stem[node] and k == 0:
                continue
            nxt = self.children[node].get(ch)
            if nxt is not None and k in self.left[nxt]:
                out.add((nxt, k, left))
            if left:
                out.add((node, k, left - 1))
                for n2 in self.children[node].values():
                    if k in self.left[n2]:
                        out.add((n2, k, left - 1))
        j = self._number(self._closure(out))
        self.steps[i][ch] = j
        return j

    def match(self, word: str) -> tuple[float, int]:
        """(weight, kind) of the best entry: kind 1 exact or by stem, 2 misspelled, 3 doubtful, 0 none."""
        if len(self.sets) > self.limit:
            self.reset()
        i, steps = self.start, self.steps
        if i < 0:
            return 0.0, 0
        stem = 0.0
        for ch in word:
            j = steps[i].get(ch)
            if j is None:
                j = self._step(i, ch)
            if j < 0:
                return (stem, 1) if stem else (0.0, 0)
            i = j
            for node, k, _ in self.sets[i] if self.has_stem(i) else ():
                if k == 0 and self.stem[node]:
                    stem = max(stem, self.stem[node])
        if stem and self.accept[i][1] > 1:
            return stem, 1  # a form of the stem is no misspelling of a word near it
        return max(self.accept[i], (stem, 1)) if stem else self.accept[i]

    def has_stem(self, i: int) -> bool:
        flags = self.__dict__.setdefault("_stem_flags", [])
        if len(flags) > len(self.sets):
            flags.clear()
        while len(flags) < len(self.sets):
            flags.append(any(k == 0 and self.stem[n] for n, k, _ in self.sets[len(flags)]))
        return flags[i]


class Scorer:
    """Features and scores of whole texts; words already judged are kept in a bounded table."""

    def __init__(self, model: ToxicModel, memory: int = 400_000) -> None:
        # doubtful misspellings that were found to tell nothing need not be looked for
        idle = model.amid if not model.weights[2] else frozenset()
        self.auto = LexiconAutomaton(model.words, model.stems, model.amid, exact=idle)
        self.banned, self.reporting = model.banned, model.reporting
        self.weights = np.array(model.weights)
        self.known: dict[str, tuple[float, int]] = {}
        self.memory = memory

    def judge(self, word: str) -> tuple[float, int]:
        if len(self.known) > self.memory:
            self.known.clear()
        hit = (0.0, 0) if word in self.banned else self.auto.match(word)
        self.known[word] = hit
        return hit

    def hits(self, text: str) -> list[tuple[int, str, float, int, bool]]:
        """(start, word, weight, kind, quoted) of every lexicon hit, in text order."""
        known, judge = self.known, self.judge
        low = text.lower()
        words = WORD.findall(low)
        # hits are kept apart from the table, which judging may empty at any word
        found = {w: hit for w in set(words) if (hit := known.get(w) or judge(w))[1]}
        if not found:
            return []
        spans = [(m.start(), m.group()) for m in WORD.finditer(low)]
        out = []
        counted = odd = 0
        for i, (at, w) in enumerate(spans):
            if w in found:
                lo = spans[max(0, i - WINDOW)][0]
                hi_at, hi_w = spans[min(len(spans) - 1, i + WINDOW)]
                before, after = low[lo:at], low[at + len(w) : hi_at + len(hi_w)]
                # straight quotation marks open and close alike: their parity is carried along
                odd ^= low.count('"', counted, at) & 1
                counted = at
                marks = odd and '"' in before
                inside = (marks or any(q in before for q in QUOTE_CHARS[1:])) and any(q in after for q in QUOTE_CHARS)
                told = any(x in self.reporting for _, x in spans[max(0, i - WINDOW) : i])
                out.append((at, w, *found[w], bool(inside or told)))
        return out

    def contexts(self, text: str) -> list[str]:
        """Distinct words of the windows before hits."""
        low = text.lower()
        starts = {at for at, *_ in self.hits(text)}
        words = [(m.start(), m.group()) for m in WORD.finditer(low)] if starts else []
        return sorted({x for i, (at, _) in enumerate(words) if at in starts for _, x in words[max(0, i - WINDOW) : i]})

    def features(self, text: str) -> list[float]:
        """Logs of the summed weights of words, misspelled words, doubtful misspellings and quoted hits."""
        sums = [0.0, 0.0, 0.0, 0.0]
        for _, _, weight, kind, q in self.hits(text):
            sums[3 if q else kind - 1] += weight
        return [math.log1p(x) for x in sums]

    def score(self, text: str | None) -> float:
        x = self.features(text or "")
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights[:-1], x) + self.weights[-1], -30, 30))))


def apart(sets: list[set[str]], hashes: int = 12, same: int = 6) -> list[set[str]]:
    """One of each group of near copies, judged by minhashes, so that no single text supports a word often."""
    out, seen = [], {}
    for s in sets:
        if not s:
            continue
        codes = np.array([zlib.crc32(w.encode()) for w in s], dtype=np.uint64)
        mins = [int((codes * np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).min()) for k in range(1, hashes + 1)]
        shared = Counter(d for k, m in enumerate(mins) for d in seen.get((k, m), ()))
        if shared and max(shared.values()) >= same:
            continue
        for k, m in enumerate(mins):
            seen.setdefault((k, m), []).append(len(out))
        out.append(s)
    return out


def learn_lexicon(toxic: list[set[str]], clean: list[set[str]], *, min_odds: float = 3.0, risk: float = 0.5) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with a smoothed log odds of at least ``min_odds`` that chance does not explain.

    Of the texts with a word, the toxic share must exceed the sample's by more than Chernoff's bound
    allows at ``risk`` over all words tried.  A stem is the shortest prefix of ``STEM_MIN``
    characters or more that passes and is continued by at least three words; words below it stay
    beside it, as stems tolerate no edits.
    """
    a, b = max(1, len(toxic)), max(1, len(clean))
    share = a / (a + b)

    def odds(t: int, c: int) -> float:
        return math.log((t + 0.1) / (a + 0.2)) - math.log((c + 0.1) / (b + 0.2))

    def real(t: int, c: int, tried: int) -> bool:
        n, q = t + c, t / (t + c)
        if q <= share or odds(t, c) < min_odds:
            return False
        distance = q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0.0)
        return n * distance >= math.log(tried / risk)

    ct = Counter(w for s in toxic for w in s)
    cc = Counter(w for s in clean for w in s)
    often = sum(n > 2 for n in ct.values())
    words = {w: odds(n, cc[w]) for w, n in ct.items() if n > 2 and len(w) >= 3 and real(n, cc[w], often)}
    longest = 12
    pt: Counter = Counter()
    pc: Counter = Counter()
    for sets, into in ((toxic, pt), (clean, pc)):
        for s in sets:
            into.update({w[:n] for w in s for n in range(STEM_MIN, min(len(w), longest) + 1)})
    ends: Counter = Counter()
    for w in ct:
        ends.update(w[:n] for n in range(STEM_MIN, min(len(w), longest)))
    stems: dict[str, float] = {}
    for p in sorted((p for p, n in pt.items() if n > 2 and ends[p] >= 3 and pc[p] <= n // 200 and real(n, pc[p], len(pt))), key=len):
        if not any(p[:n] in stems for n in range(STEM_MIN, len(p))):
            stems[p] = odds(pt[p], pc[p])
    return words, stems


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = 2000, reporting: frozenset[str] = REPORTING) -> ToxicModel:
    """Learn lexicon, words of reporting and weights from at most ``per_class`` labelled texts per class outside the held-out fifth.

    ``reporting`` are words of reporting known beforehand.  Equal texts count once.  What reaches the driver is the distinct words of those texts, found on
    the executors.  With labels of one class only, or too few to tell words from
    chance, the lexicon is empty and every score is 0.
    """
    sample = labelled_sample(docs, labels, "toxic", per_class).groupBy("text").agg(F.max("y").alias("y"))

    @F.pandas_udf("string")
    def vocabulary(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(sorted(set(WORD.findall(t.lower())))))

    half = F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")
    rows = sample.select("y", half, vocabulary("text").alias("words")).toPandas()
    rows = rows.sort_values("words", kind="stable")
    sets = {y: apart([set(s.split(" ")) - {""} for s in rows["words"][rows["y"] == y]]) for y in (0, 1)}
    if not sets[0] or not sets[1]:
        return ToxicModel({}, {}, (0.0, 0.0, 0.0, 0.0, -30.0))
    words, stems = learn_lexicon(sets[1], sets[0])
    if not words and not stems:
        return ToxicModel({}, {}, (0.0, 0.0, 0.0, 0.0, -30.0))
    # a spelling that clean texts use as often as toxic ones is a word of its own, not a misspelling;
    # an entry near several such words stands for itself alone
    auto = LexiconAutomaton(words, stems)

    def ordinary(texts: dict[int, list[set[str]]]) -> frozenset[str]:
        near: Counter = Counter()
        for y, step in ((1, 1), (0, -3)):
            for s in texts[y]:
                near.update({w: step for w in s if w not in words and auto.match(w)[1] > 1})
        return frozenset(w for w, n in near.items() if n < 0)

    banned = ordinary(sets)
    around = Counter(e for e in words for one in [LexiconAutomaton({e: 1.0}, {})] for w in banned if abs(len(w) - len(e)) <= 2 and one.match(w)[1])
    amid = frozenset(e for e, n in around.items() if n >= OWN_WORDS)
    draft = ToxicModel(words, stems, (1.0, 1.0, 1.0, 0.0, 0.0), banned, amid, frozenset(reporting))
    # words that stand before hits of clean texts far more often than of toxic ones tell of reporting
    told = measured(sample, draft, "contexts", "array<string>")
    seen = {y: Counter(w for r in told[told["y"] == y]["x"] for w in r) for y in (0, 1)}
    n = {y: max(1, int(sum(len(r) > 0 for r in told[told["y"] == y]["x"]))) for y in (0, 1)}
    learnt = {w for w, k in seen[0].items() if k >= 4 and w not in words and (k / n[0]) >= 4 * ((seen[1][w] + 1) / (n[1] + 1))}
    draft = replace(draft, reporting=draft.reporting | learnt)
    # each half is measured with the ordinary words of the other, as unseen texts are met later
    halves = []
    for half in (0, 1):
        other = rows[rows["half"] != half]
        known = ordinary({y: [set(s.split(" ")) for s in other["words"][other["y"] == y]] for y in (0, 1)})
        halves.append(measured(sample.where(F.pmod(F.xxhash64("text"), F.lit(2)) == half), replace(draft, banned=known), "features", "array<double>"))
    feats = pd.concat(halves)
    x, y = np.array(feats["x"].tolist()).reshape(-1, 4), feats["y"].to_numpy()
    w = fit_logistic(x, y, l2=1e-3)
    if not x[:, 1].any():
        w[1] = w[0] * 0.8  # no misspelling was seen; it counts nearly as much as the word
    w[2] = max(0.0, w[2])
    return replace(draft, weights=tuple(map(float, w)))


def measured(sample: DataFrame, model: ToxicModel, what: str, kind: str) -> pd.DataFrame:
    """(y, x) of each sampled text: ``what`` a Scorer of the model gives for it."""
    held = sample.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = Scorer(held.value)
        for texts in batches:
            yield pd.Series([getattr(tool, what)(t) for t in texts])

    return sample.select("y", run("text").alias("x")).toPandas()


def score_column(spark: SparkSession, model: ToxicModel):
    """A function from a text column to its score column; the model is broadcast once."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = Scorer(held.value)
        for texts in batches:
            yield pd.Series([tool.score(t) for t in texts], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 where score >= threshold); columns of these names are replaced.

    Null and empty texts have no hits and get the score of a clean text.  Texts are read whole, of any
    length.  Ties, repeated rows and null ids are scored like any other row; the table may be empty.
    """
    score = score_column(docs.sparkSession, model)
    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_toxicity(docs, labels)
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
