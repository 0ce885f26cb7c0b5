"""Token counts that follow edits: segment trees of pre-token segments per document.

A text is cut into segments where no pre-token of the pattern can span, whatever stands around: before
white space, and between letters, digits and other marks (but not between an apostrophe and a
letter).  So segments are encoded on their own, in any script; only a run of one kind that is itself
one pre-token is never cut.  A
document keeps a segment tree with the characters and tokens of every subtree.  An edit descends the
tree to the segments it touches, widened by the two characters that a cut depends on; only their new
text is encoded, into the same slots, and only the sums above those slots change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.bpe import default_pattern, default_ranks, read_ranks

SEGMENT = 512
CONTEXT = 2  # characters on either side of a cut on which its being safe depends
CUT = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")


def segments(text: str, target: int = SEGMENT) -> list[str]:
    """``text`` cut at the first safe place after each ``target`` characters; joined they are ``text``."""
    out, at = [], 0
    while len(text) - at > target:
        m = CUT.search(text, at + target)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


class Counter:
    """Token counts of segments by a rank file and its pattern."""

    def __init__(self, ranks: str, pattern: str) -> None:
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={})

    def __call__(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0


@dataclass
class Tree:
    """Sums over a perfect binary tree: node 1 is the whole, node ``width + i`` is segment i."""

    chars: np.ndarray
    tokens: np.ndarray

    @property
    def width(self) -> int:
        return len(self.chars) // 2

    @staticmethod
    def of(chars: list[int], tokens: list[int]) -> Tree:
        width = 1
        while width < len(chars):
            width *= 2
        t = Tree(np.zeros(2 * width, np.int64), np.zeros(2 * width, np.int64))
        t.chars[width : width + len(chars)] = chars
        t.tokens[width : width + len(tokens)] = tokens
        for i in range(width - 1, 0, -1):
            t.chars[i] = t.chars[2 * i] + t.chars[2 * i + 1]
            t.tokens[i] = t.tokens[2 * i] + t.tokens[2 * i + 1]
        return t

    def find(self, pos: int) -> tuple[int, int]:
        """(segment, its first character) of the character at ``pos``; past the end the last segment that has any."""
        pos = max(0, min(pos, int(self.chars[1]) - 1))
        node, start = 1, 0
        while node < self.width:
            left = int(self.chars[2 * node])
            node *= 2
            if pos - start >= left:
                start += left
                node += 1
        return node - self.width, start

    def put(self, segment: int, chars: int, tokens: int) -> None:
        """Set one segment and add the change to the sums above it."""
        node = segment + self.width
        dc, dt = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2


def build(text: str, count: Counter, target: int = SEGMENT) -> Tree:
    parts = segments(text, target)
    return Tree.of([len(p) for p in parts], [count(p) for p in parts])


def apply_edits(text: str, tree: Tree, edits: list[tuple[int, int, str]], count: Counter, target: int = SEGMENT) -> tuple[str, Tree, int, int]:
    """(new text, tree, segments encoded, characters encoded) after (position, deleted, inserted) edits.

    Edits are applied in the given order, each to the text left by the one before; positions and
    lengths are clipped to it.  A segment that has grown to eight times ``target`` has the tree
    built anew, from kept counts but for its own.
    """
    n_segments = n_chars = 0
    for pos, deleted, inserted in edits:
        pos = max(0, min(pos, len(text)))
        end = max(pos, min(pos + deleted, len(text)))
        first, start = tree.find(pos - CONTEXT)
        last, at = tree.find(end + CONTEXT - 1)
        stop = at + int(tree.chars[tree.width + last])
        text = text[:pos] + inserted + text[end:]
        region = text[start : stop + len(inserted) - (end - pos)]
        parts = segments(region, target)
        slots = last - first + 1
        # as many segments as slots: what is left over stays with the last, slots left over are empty
        parts = parts[: slots - 1] + ["".join(parts[slots - 1 :])] if len(parts) > slots else parts + [""] * (slots - len(parts))
        for k, p in enumerate(parts):
            tree.put(first + k, len(p), count(p))
        n_segments += slots
        n_chars += len(region)
        if len(parts[-1]) > 8 * target:
            chars = tree.chars[tree.width :].tolist()
            tokens = tree.tokens[tree.width :].tolist()
            big = segments(parts[-1], target)
            chars[last : last + 1] = [len(p) for p in big]
            tokens[last : last + 1] = [count(p) for p in big]
            n_segments += len(big)
            n_chars += len(parts[-1])
            kept = [(c, t) for c, t in zip(chars, tokens, strict=True) if c]
            tree = Tree.of([c for c, _ in kept], [t for _, t in kept])
    return text, tree, n_segments, n_chars


TREE = "doc_id long, text string, tree_chars array<long>, tree_tokens array<long>"


def build_trees(docs: DataFrame, *, ranks: str | None = None, pattern: str | None = None, target: int = SEGMENT) -> DataFrame:
    """(doc_id, text, tree_chars, tree_tokens) of every whole text, of any length; a null text is an empty one. No shuffle.

    Null ids, repeated rows and further columns are allowed; further columns are not carried.
    """
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks, pattern)
        for b in batches:
            trees = [build(t or "", count, target) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array([t.chars for t in trees], pa.list_(pa.int64())), pa.array([t.tokens for t in trees], pa.list_(pa.int64()))], ["doc_id", "text", "tree_chars", "tree_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, TREE)


def update_trees(trees: DataFrame, *, ranks: str | None = None, pattern: str | None = None, target: int = SEGMENT) -> DataFrame:
    """Apply column ``edits``, array<struct<pos long, deleted long, inserted string>>, to trees from build_trees.

    Adds n_tokens, the count before them, and n_segments and n_chars, what was encoded for them.  Null edits are none.
    Null ids and repeated rows are edited like any other; further columns are not carried.
    """
    ranks, pattern = ranks or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(ranks, pattern)
        for b in batches:
            rows: list[tuple] = []
            for text, chars, tokens, edits in zip(b["text"].to_pylist(), b["tree_chars"].to_pylist(), b["tree_tokens"].to_pylist(), b["edits"].to_pylist(), strict=True):
                todo = [(e["pos"] or 0, e["deleted"] or 0, e["inserted"] or "") for e in edits or () if e]
                rows.append(apply_edits(text or "", Tree(np.array(chars, np.int64), np.array(tokens, np.int64)), todo, count, target))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].chars for r in rows], kind), pa.array([r[1].tokens for r in rows], kind), pa.array([t[1] for t in b["tree_tokens"].to_pylist()], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                ["doc_id", "text", "tree_chars", "tree_tokens", "n_tokens", "n_segments", "n_chars"],
            )

    return trees.select("doc_id", "text", "tree_chars", "tree_tokens", "edits").mapInArrow(run, f"{TREE}, n_tokens long, n_segments long, n_chars long")


def op3_rows(docs: DataFrame) -> DataFrame:
    """Counts of every document before and after three edits: words replaced, put in and taken out.

    The edits stand at a quarter, the middle and three quarters of each text.  Returns doc_id,
    n_tokens, n_tokens_after, n_chars_after, n_segments and n_chars encoded for the edits.
    """
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    edit = lambda pos, deleted, inserted: F.struct(F.floor(pos).cast("long").alias("pos"), F.lit(deleted).cast("long").alias("deleted"), F.lit(inserted).alias("inserted"))
    edits = F.array(edit(n / 4, 12, "Rewritten words"), edit(n / 2, 0, " and a sentence, put in between. "), edit(3 * n / 4, 40, ""))
    after = update_trees(build_trees(docs).withColumn("edits", edits))
    return after.select("doc_id", "n_tokens", F.element_at("tree_tokens", 2).alias("n_tokens_after"), F.element_at("tree_chars", 2).alias("n_chars_after"), "n_segments", "n_chars")
