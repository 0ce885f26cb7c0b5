"""Byte-level BPE encoding and decoding over overlapping chunks.

A text is cut into chunks that overlap.  All chunks are pre-tokenised on their own, starting wherever
their cuts fell; in the overlap a chunk's boundaries soon agree with those of the chunk before.  The
two are stitched at the first boundary that both have and that follows a character other than white
space (white space looks ahead, so only there does nothing depend on the other side).  A stitched
boundary is one of the whole text: the first chunk's are, and a chunk that shares one with the chunk
before has the same from there on.  The stitched pieces are then encoded by rank and concatenated;
decoding concatenates the bytes of the ids.

Very long texts are rows of parts, each of many chunks with the chunk before them, which are encoded
by different tasks; both neighbours find the same boundary between them.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import stored

CHUNK = 16_384
OVERLAP = 256
TAIL = 8


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class ChunkedBpe:
    """Encoder of whole texts by rank file and pattern, each match of the pattern separately."""

    def __init__(self, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        self.pattern = regex.compile(pattern)
        self.names = [str(i) for i in range(self.encoding.n_vocab)]
        self.chunk, self.overlap = chunk, min(overlap, chunk // 2)

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Ends of the pre-tokens met when pre-tokenising ``text[start:end]`` alone."""
        return [m.end() + start for m in self.pattern.finditer(text[start:end])]

    def stitch(self, text: str, known: int, cut: int) -> int | None:
        """A safe boundary shared by the chunk that starts at ``known`` and the one that starts at ``cut``.

        The overlap is widened until they agree; None if they never do (then the two stay one piece).
        """
        width = self.overlap
        while True:
            end = min(len(text), cut + width)
            # near a cut end matches can differ from what they'd be with more text behind them
            sure = end if end == len(text) else end - TAIL
            theirs = set(self.boundaries(text, cut, end)[:-1])
            for b in self.boundaries(text, known, end)[:-1]:
                if cut < b <= sure and b in theirs and not text[b - 1].isspace():
                    return b
            if end == len(text):
                return None
            width *= 4

    def stitched(self, text: str, first: int, cuts: list[int]) -> list[int | None]:
        """For each cut the boundary that the chunks before and after it share, None where the overlap shows none.

        Chunks start at ``first`` and at the cuts; each is pre-tokenised on its own.
        """
        starts = [first, *cuts]
        ends = [self.boundaries(text, a, min(len(text), b + self.overlap)) for a, b in zip(starts, [*cuts, cuts[-1] + self.overlap] if cuts else [], strict=False)]
        out: list[int | None] = []
        for cut, ours, theirs in zip(cuts, ends, ends[1:], strict=False):
            stop = min(len(text), cut + self.overlap)
            # near a cut end matches can differ from what they'd be with more text behind them
            sure = stop if stop == len(text) else stop - TAIL
            both = set(theirs)
            out.append(next((b for b in ours[bisect_right(ours, cut) :] if b <= sure and b < len(text) and b in both and not text[b - 1].isspace()), None))
        return out

    def pieces(self, text: str) -> list[str]:
        """``text`` cut at safe pre-token boundaries, about one chunk apiece; their concatenation is ``text``."""
        if len(text) <= self.chunk + self.overlap:
            return [text]
        cuts = list(range(self.chunk, len(text) - self.overlap, self.chunk))
        at = [0]
        known = True  # whether the chunk before is known to have the text's own boundaries at its end
        for cut, b in zip(cuts, self.stitched(text, 0, cuts), strict=True):
            if not known or b is None:
                # the chunks don't agree in the overlap: look on from the last boundary that is known
                b = self.stitch(text, at[-1], cut) if cut > at[-1] else None
            known = b is not None
            if known:
                at.append(b)
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text):
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


PART_CHUNKS = 64  # a text of more chunks is several rows


def _split(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame, int]:
    """(docs of one part with ``row``, parts of longer ones, characters of a part): rows are numbered where they were read."""
    size = chunk * PART_CHUNKS
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    many = rows.where(n > size + chunk)
    # a part has the chunk before it and the overlap after it; the last one ends with the text
    parts = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil((F.length("text") - chunk) / F.lit(size)).cast("int") - 1)))
    last = (F.col("part") + 1) * size + chunk >= F.length("text")
    lead = F.when(F.col("part") > 0, chunk).otherwise(0)
    length = F.when(last, F.length("text")).otherwise(lead + size + chunk)
    parts = parts.select("row", "doc_id", "part", last.alias("last"), F.substring("text", F.col("part") * size - lead + 1, length).alias("text"))
    return rows.where(n <= size + chunk), parts.repartition("row", "part"), size


def _encoded(docs: DataFrame, ranks: str, pattern: str, chunk: int, digest, schema: str, columns) -> DataFrame:
    """``digest`` of the ids of every document; ``schema`` are its columns, ``columns`` makes arrays of them."""
    short, parts, size = _split(docs, chunk)

    def tidy(tool: ChunkedBpe, doc_ids, ids: list[list[int]]) -> pa.RecordBatch:
        arrays, names = columns([digest(tool, x) for x in ids])
        return pa.RecordBatch.from_arrays([doc_ids, *arrays], ["doc_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = ChunkedBpe(ranks, pattern, chunk)
        for b in batches:
            yield tidy(tool, b["doc_id"], [tool.encode(t or "") for t in b["text"].to_pylist()])

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = ChunkedBpe(ranks, pattern, chunk)
        for b in batches:
            data = []
            for part, last, text in zip(b["part"].to_pylist(), b["last"].to_pylist(), b["text"].to_pylist(), strict=True):
                lead = chunk if part else 0
                stop = len(text) if last else lead + size
                cuts = [*([lead] if lead else []), *range(lead + chunk, stop, chunk), *([] if last else [stop])]
                at = tool.stitched(text, 0, cuts)
                if None in at:
                    data.append(None)  # not all chunks agree: the text is encoded in one piece
                    continue
                begin, end = at[0] if lead else 0, len(text) if last else at[-1]
                marks = [begin, *[x for x in at if begin < x < end], end]
                ids = [i for a, z in zip(marks, marks[1:], strict=False) for i in tool.encoding.encode_ordinary(text[a:z])]
                data.append(np.array(ids, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["part"], pa.array(data, pa.binary())], ["row", "doc_id", "part", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = ChunkedBpe(ranks, pattern, chunk)
        for b in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in parts), "<u4").tolist() for parts in b["parts"].to_pylist()]
            yield tidy(tool, b["doc_id"], ids)

    once = short.select("doc_id", "text").mapInArrow(run, schema)
    coded = stored(parts.mapInArrow(run_parts, "row long, doc_id long, part int, ids binary"), "bpe-parts")
    if coded.limit(1).count() == 0:
        return once
    # the digest of a text is one task's; its parts are not
    whole = coded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max(F.col("ids").isNull()).alias("apart"), F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    joined = whole.where("not apart").select("doc_id", "parts").mapInArrow(join, schema)
    apart = coded.where("ids is null").select("row").distinct()
    rest = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").join(apart, "row", "left_semi")
    return once.unionAll(joined).unionAll(rest.select("doc_id", "text").mapInArrow(run, schema))


def encode_documents(docs: DataFrame, *, ranks: str | None = None, pattern: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of every whole text; a null text is an empty one.

    Rows stay where they were read, one batch of texts in memory per task; only texts of over
    ``PART_CHUNKS`` chunks are dealt to several tasks.  Null ids, repeated rows and further columns are
    allowed; further columns are not carried.
    """
    return _encoded(
        docs, ranks or default_ranks(), pattern or default_pattern(), chunk, lambda tool, ids: (ids, tool.decode(ids)), "doc_id long, ids array<int>, decoded binary",
        lambda rows: ([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.binary())], ["ids", "decoded"]),
    )


def op9_rows(docs: DataFrame, *, ranks: str | None = None, pattern: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Digests of the ids and of the decoded bytes, taken in the task that encodes: ids of texts in one part are not sent on."""

    def digest(tool: ChunkedBpe, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(" ".join([tool.names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(tool.decode(ids)).hexdigest()

    return _encoded(
        docs, ranks or default_ranks(), pattern or default_pattern(), chunk, digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda rows: ([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]),
    )
