"""Token-id files: independent zstandard frames, a trailing seek table, per-frame checksums.

Layout of a shard: frames, each the zstandard compression (with content checksum) of the ids of
consecutive documents as little-endian unsigned integers; then, inside a zstandard skippable frame,
the seek table: per frame its compressed size, ids and crc32; per document its id, its frame and its
count; and a fixed footer that says where the table starts.  Any zstandard tool reads the frames one
after another and skips the table; a reader of some documents reads the footer, the table and the
frames of those documents only.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import shared_dir

MAGIC = 0x184D2A5E  # a skippable frame, by the zstandard format
FOOTER = struct.Struct("<QIII8s")  # table start, frames, documents, crc32 of the table, mark
MARK = b"TOKSEEK1"
FRAME_IDS = 1 << 16
SHARD_BYTES = 64 << 20
ROWS = 1000  # of a batch, encoded and sent on together
#: White space other than the space and the line feed.
ASCII_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
OTHER_SPACE = ASCII_SPACE + "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Fixed value: the split pattern of the library's byte-level pre-tokeniser.
LATIN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Stands in texts where they are cut; it is white space, so texts that have it are not cut so.
CUT = "\x1f"
WORD_END = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
SPACE = " \n" + OTHER_SPACE.replace(CUT, "")
LINE_END = f"([^{SPACE}])\n([^{SPACE}])"
#: A space next to other white space; what cuts before such spaces look like.
SPACES, AFTER_SPACE, BEFORE_SPACE = f"[{SPACE}] | [{SPACE}]", f"([{SPACE}]){CUT}", f"{CUT}( [{SPACE}])"
NOT_LATIN = re.compile("[^\\x00-\\u024f]")
#: A piece that ends in white space, or starts with other than a space of its own.
UNSURE = re.compile(r"\s\t|\t[^\S ]|\t \s")


def write_shard(docs: Iterable[tuple[int, np.ndarray]], out, width: int = 2, frame_ids: int = FRAME_IDS, level: int = 3) -> int:
    """Write (doc_id, ids) in the given order to the binary stream ``out``; the number of ids written.

    ``width`` is bytes per id, 2 or 4.  A document starts and ends in one frame; a frame is closed
    once it holds ``frame_ids`` ids, so one document longer than that has a frame of its own.
    """
    tool = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    kind = np.dtype("<u2" if width == 2 else "<u4")
    frames, names, where, counts = [], [], [], []
    held: list[np.ndarray] = []
    n = total = at = 0

    def close() -> None:
        nonlocal n, at, held
        if not held:
            return
        raw = np.concatenate(held).astype(kind).tobytes()
        data = tool.compress(raw)
        out.write(data)
        frames.append((at, len(data), len(raw) // width, zlib.crc32(raw)))
        at += len(data)
        n, held = 0, []

    for doc_id, ids in docs:
        names.append(doc_id)
        where.append(len(frames))
        counts.append(len(ids))
        held.append(ids)
        n += len(ids)
        total += len(ids)
        if n >= frame_ids:
            close()
    close()
    table = b"".join([
        np.array([width, len(frames), len(names)], "<u4").tobytes(),
        np.array(frames, "<u8").reshape(-1, 4).tobytes(),
        np.array(names, "<i8").tobytes(), np.array(where, "<u4").tobytes(), np.array(counts, "<u8").tobytes(),
    ])
    body = table + FOOTER.pack(at + 8, len(frames), len(names), zlib.crc32(table), MARK)
    out.write(struct.pack("<II", MAGIC, len(body)) + body)
    return total


class ShardReader:
    """Reads documents of one shard from a seekable binary file; checks every frame it decompresses."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, io.SEEK_END)
        source.seek(size - FOOTER.size)
        start, n_frames, n_docs, crc, mark = FOOTER.unpack(source.read(FOOTER.size))
        if mark != MARK:
            raise ValueError("not a token-id shard")
        source.seek(start)
        table = source.read(size - FOOTER.size - start)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table is damaged")
        self.width = int(np.frombuffer(table, "<u4", 1)[0])
        at = 12
        self.frames = np.frombuffer(table, "<u8", 4 * n_frames, at).reshape(-1, 4)
        at += 32 * n_frames
        self.doc_ids = np.frombuffer(table, "<i8", n_docs, at)
        self.where = np.frombuffer(table, "<u4", n_docs, at + 8 * n_docs)
        self.counts = np.frombuffer(table, "<u8", n_docs, at + 12 * n_docs).astype(np.int64)
        ends = np.cumsum(self.counts)
        self.starts = ends - self.counts
        first = np.zeros(n_frames + 1, np.int64)
        if n_frames:
            np.cumsum(self.frames[:, 2].astype(np.int64), out=first[1:])
        self.first = first
        self.held: tuple[int, np.ndarray] | None = None
        self.tool = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> np.ndarray:
        if self.held is None or self.held[0] != k:
            at, size, n, crc = map(int, self.frames[k])
            self.source.seek(at)
            raw = self.tool.decompress(self.source.read(size), max_output_size=n * self.width)
            if zlib.crc32(raw) != crc:
                raise ValueError(f"frame {k} is damaged")
            self.held = (k, np.frombuffer(raw, "<u2" if self.width == 2 else "<u4"))
        return self.held[1]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the shard; only its frame is decompressed."""
        n = int(self.counts[i])
        if not n:
            return np.zeros(0, "<u2")
        k = int(self.where[i])
        at = int(self.starts[i] - self.first[k])
        return self.frame(k)[at : at + n]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i, doc_id in enumerate(self.doc_ids.tolist()):
            yield doc_id, self.document(i)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class CachedTokenizer:
    """The tokenizers library over a byte-level vocabulary, called once per new word, many words at a time.

    In such a vocabulary no pre-token spans a single space between two characters that are not white
    space, nor a letter and a punctuation mark, nor a line feed and what is not white space beside it;
    what follows is pre-tokenised alike wherever it stands.  So texts are cut there (by Arrow, many
    texts at once; in Python, and at spaces only, if they hold ``CUT``), different pieces are looked up,
    and only new ones go through the library, hundreds in a call: through its model, joined by a byte
    that no merge rule has; pieces that are not a word of Latin letters first, joined by tabs, which
    come out as pre-tokens of their own, through its pre-tokeniser (of Latin text its pattern is run by
    the regex module, four times as fast).
    Ids equal ``Tokenizer.encode(text, add_special_tokens=False)``; a text that holds a special
    token's string goes through that call as a whole, as do long pieces.  ``special_strings`` False
    makes such strings ordinary text.

    Ids are kept, as bytes, in two tables of at most about ``memory`` bytes together: when the younger is
    full it becomes the older, so frequent pieces stay.  Pieces of over ``LONG`` characters are not kept.
    """

    LONG = 64
    ENTRY = 200  # bytes of an entry besides its characters and ids
    SLICE = 4_000_000  # characters of texts whose new pieces are encoded together
    JOINED = 200  # pieces in one call of the library

    def __init__(self, path: str, width: int = 4, memory: int = 200_000_000, special_strings: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = not special_strings
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or config.get("normalizer"):
            raise ValueError("not a plain byte-level vocabulary")
        self.strings = [t["content"] for t in config.get("added_tokens") or () if special_strings or not t["special"]]
        self.pre = self.tool.pre_tokenizer
        self.bare = Tokenizer(self.tool.model)  # the model alone, on texts in its byte alphabet
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        merged = {c for m in config["model"]["merges"] for part in (m.split(" ") if isinstance(m, str) else m) for c in part}
        vocab = config["model"]["vocab"]
        alone = [b for b in range(32) if self.alphabet[b] not in merged and self.alphabet[b] in vocab]
        if 9 not in alone or len(alone) < 2:
            raise ValueError("merge rules have the tab or all control characters")
        self.gap = chr(next(b for b in alone if b != 9))
        self.gap_id, self.tab_id = vocab[self.alphabet[ord(self.gap)]], vocab[self.alphabet[9]]
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.memory = memory
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.odd = "|".join([CUT, *map(re.escape, self.strings)])  # texts that Arrow does not cut

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Parts of ``text``, cut at spaces; joined by a space they are ``text``, and all but the first stand for it too."""
        parts = text.split(" ")
        # next to other white space a space isn't a safe place to cut: join those parts again
        if not all(parts) or " \n" in text or "\n " in text or any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE)):
            out = [parts[0]]
            for p in parts[1:]:
                last = out[-1]
                if p and not p[0].isspace() and last and not last[-1].isspace():
                    out.append(p)
                else:
                    out[-1] = f"{last} {p}"
            parts = out
        return parts

    def whole(self, text: str) -> bytes:
        """Ids of a text by the library's plain call."""
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def new(self, texts: list[str]) -> list[bytes]:
        """Ids of pieces as texts of their own, a space before included."""
        words = [t for t in texts if t.removeprefix(" ").isalpha() and len(t) <= self.LONG and (t.isascii() or not NOT_LATIN.search(t))]
        made: dict[str, bytes] = {}
        for k in range(0, len(words), self.JOINED):
            group = words[k : k + self.JOINED]
            made.update(zip(group, self.cut(self.model(self.spelt(group)), self.gap_id), strict=True))
        rest = [t for t in texts if t not in made]
        made.update(zip(rest, self.mixed(rest), strict=True))
        return [made[t] for t in texts]

    def mixed(self, texts: list[str]) -> list[bytes]:
        """Ids of pieces of any number of pre-tokens."""
        out: list[bytes] = []
        for k in range(0, len(texts), self.JOINED):
            group = texts[k : k + self.JOINED]
            joined = "\t".join(group)
            if joined.count("\t") >= len(group) or self.gap in joined or max(map(len, group)) > self.LONG or UNSURE.search(f"\t{joined}\t") or not all(group):
                if len(group) == 1:
                    out.append(self.whole(joined) if joined else b"")
                else:
                    half = len(group) // 2
                    out += self.mixed(group[:half]) + self.mixed(group[half:])
                continue
            ids = self.model(self.other(joined) if NOT_LATIN.search(joined) else self.spelt(LATIN.findall(joined)))
            out += self.cut(ids[ids != self.gap_id], self.tab_id)
        return out

    def model(self, text: str) -> np.ndarray:
        """Ids of pre-tokens in the byte alphabet with gaps between, by the library's model; gaps included."""
        return np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    @staticmethod
    def cut(ids: np.ndarray, at: int) -> list[bytes]:
        """What stands between the ids ``at``."""
        data, width = ids.tobytes(), ids.itemsize
        ends = width * np.flatnonzero(ids == at)
        return [data[a:b] for a, b in zip([0, *(ends + width).tolist()], [*ends.tolist(), len(data)], strict=True)]

    def spelt(self, tokens: list[str]) -> str:
        """Pre-tokens in the byte alphabet with gaps between."""
        return self.gap.join(tokens).encode("utf-8").decode("latin-1").translate(self.alphabet)

    def other(self, text: str) -> str:
        """A text's pre-tokens in the byte alphabet with gaps between, by the library."""
        return self.alphabet[ord(self.gap)].join([t for t, _ in self.pre.pre_tokenize_str(text)])

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of different pieces as texts of their own, from the tables or else by the library."""
        out = list(map(self.young.get, texts))
        missing = [i for i, ids in enumerate(out) if ids is None]
        if self.old:
            for i in missing:
                out[i] = self.old.get(texts[i])
        new = [i for i in missing if out[i] is None]
        for i, ids in zip(new, self.new([texts[i] for i in new]), strict=True):
            out[i] = ids
        found = {t: out[i] for i in missing if len(t := texts[i]) <= self.LONG}
        self.young.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + self.ENTRY * len(found)
        if self.held > self.memory // 2:
            self.old, self.young, self.held = self.young, {}, 0
        return out

    def encode_many(self, texts: list[str | None], tail: bytes = b"") -> list[bytes]:
        """The ids of each text as little-endian unsigned integers, ``tail`` after each; a null text is an empty one."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            some, room = [], self.SLICE
            while at < len(texts) and room > 0:
                some.append(texts[at] or "")
                room -= len(some[-1])
                at += 1
            column = pa.array(some, pa.large_string())
            odd = pc.match_substring_regex(column, self.odd)
            plain = iter(self._encode_plain(column.filter(pc.invert(odd)), tail))
            rest = iter(self._encode_odd(column.filter(odd).to_pylist(), tail))
            out += [next(rest if x else plain) for x in odd.to_pylist()]
        return out

    def _encode_plain(self, texts: pa.LargeStringArray, tail: bytes) -> list[bytes]:
        """Ids of texts that ``odd`` does not match."""
        spaces = pc.any(pc.match_substring_regex(texts, SPACES)).as_py()
        texts = pc.replace_substring(texts, " ", f"{CUT} ")
        if spaces:
            texts = pc.replace_substring_regex(pc.replace_substring_regex(texts, AFTER_SPACE, r"\1"), BEFORE_SPACE, r"\1")
        texts = pc.replace_substring_regex(texts, WORD_END, rf"\1{CUT}\2")
        texts = pc.replace_substring_regex(texts, LINE_END, f"\\1{CUT}\n{CUT}\\2")
        pieces = pc.split_pattern(texts, CUT)
        bounds = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        ids = pa.array(self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        if not len(ids):
            return []
        _, ends, data = ids.buffers()
        ends, data = np.frombuffer(ends, np.int64, len(ids) + 1)[bounds].tolist(), memoryview(data or b"")
        return [b"".join((data[a:b], tail)) for a, b in zip(ends, ends[1:], strict=False)]

    def _encode_odd(self, texts: list[str], tail: bytes) -> list[bytes]:
        """Ids of any texts."""
        parts = [t if any(s in t for s in self.strings) else self.pieces(t) for t in texts]
        for p in parts:
            if type(p) is list:
                p[1:] = [f" {w}" for w in p[1:]]
        names = list(set().union(*(p for p in parts if type(p) is list)))
        ids = dict(zip(names, self.ids_of(names), strict=True))
        return [b"".join([*map(ids.__getitem__, p), tail]) if type(p) is list else self.whole(p) + tail for p in parts]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


_TOOLS: dict[tuple, CachedTokenizer] = {}


def tokenizer_of(path: str, width: int) -> CachedTokenizer:
    """This process's tokenizer: its tables serve all tasks that a Python worker runs, one after another."""
    if (path, width) not in _TOOLS:
        _TOOLS.clear()
        _TOOLS[path, width] = CachedTokenizer(path, width)
    return _TOOLS[path, width]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shard_cuts(docs: DataFrame, shards: int | None) -> list[int]:
    """Quantiles of doc_id between shards, found from the id column; an id with several is cut within by a hash of its ids.

    Where ``shards`` is not given there are as many as keep one at about ``SHARD_BYTES`` of text.
    """
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))
    if shards < 2:
        return []
    # bounds from the id column alone: ranging over the rows would read every text twice
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.agg(F.percentile_approx(ids, [i / shards for i in range(1, shards)], min(100 * shards, 1_000_000))).first()[0] or []


def shard_of(doc_ids: np.ndarray, data: list[bytes], cuts: np.ndarray) -> np.ndarray:
    """Ascending shards of ascending (doc_id, crc32 of ids)."""
    low, high = np.searchsorted(cuts, doc_ids, side="left"), np.searchsorted(cuts, doc_ids, side="right")
    for i in np.flatnonzero(high - low > 1).tolist():
        low[i] += zlib.crc32(data[i]) * (int(high[i] - low[i]) + 1) >> 32
    return low


def write_token_files(docs: DataFrame, out_dir: str, *, tokenizer: str | None = None, end_id: int | None = 0, width: int = 2, shards: int | None = None) -> DataFrame:
    """Encode every whole text and write shards of ascending doc_id; (shard, path, n_docs, n_ids), one row a shard.

    Documents are dealt to shards by ranges of doc_id (see shard_cuts), a task a shard; it is written
    under a name of its own attempt and named in the result only when complete, so lost or repeated
    tasks leave no half shard in it.  Rows with a null doc_id come first, equal doc_ids in the order
    of a checksum of their ids; only rows that agree in id and text cannot be dealt to several shards.
    A null text is an empty one, of any length it is encoded whole; further columns are not written.  An
    empty table has no shards.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    cuts = shard_cuts(docs, shards)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer_of(tokenizer, width)
        tail = np.array([] if end_id is None else [end_id], tool.kind).tobytes()
        bounds = np.array(cuts, dtype=np.int64)
        for b in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            data = tool.encode_many(b["text"].to_pylist(), tail)
            shard = shard_of(b["doc_id"].fill_null(-(2**63)).to_numpy(), data, bounds)
            crc = pa.array([zlib.crc32(x) for x in data], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b["doc_id"], crc, pa.array(data, pa.binary())], ["shard", "doc_id", "crc", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if width == 2 else "<u4"
        place = None
        rows: dict[str, list] = {"shard": [], "path": [], "n_docs": [], "n_ids": []}

        def flat() -> Iterator[tuple[int, int, bytes]]:
            for b in batches:
                yield from zip(b["shard"].to_pylist(), b["doc_id"].fill_null(-(2**63)).to_pylist(), b["ids"].to_pylist(), strict=True)

        stream = flat()
        row = next(stream, None)
        while row is not None:
            shard, n_docs = row[0], 0

            def of_shard(shard=shard) -> Iterator[tuple[int, np.ndarray]]:
                nonlocal row, n_docs
                while row is not None and row[0] == shard:
                    n_docs += 1
                    yield row[1], np.frombuffer(row[2], kind)
                    row = next(stream, None)

            if place is None:
                place, base = filesystem(out_dir)
                place.create_dir(base, recursive=True)
            name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
            with place.open_output_stream(f"{base}/{name}") as out:
                n_ids = write_shard(of_shard(), out, width)
            for key, value in (("shard", shard), ("path", name), ("n_docs", n_docs), ("n_ids", n_ids)):
                rows[key].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int32()), pa.array(rows["path"], pa.string()), pa.array(rows["n_docs"], pa.int64()), pa.array(rows["n_ids"], pa.int64())], list(rows))

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "shard int, doc_id long, crc long, ids binary")
    dealt = encoded.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "crc", "ids")
    written = dealt.mapInArrow(write, "shard int, path string, n_docs long, n_ids long")
    # one small row a shard; written down, so that reading it again writes no shard again
    index = f"{out_dir}/index.parquet"
    written.write.parquet(index)
    return spark.read.schema(written.schema).parquet(index)


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back shard by shard.

    The starts of shards are sums over the index, which has one row a shard.
    """
    index = spark.read.parquet(f"{out_dir}/index.parquet")
    rows = sorted(index.select("shard", "path", "n_ids").collect())  # bounded: the number of shards
    start, parts = 0, []
    for _, path, n in rows:
        parts.append((path, start))
        start += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, base = filesystem(out_dir)
        for b in batches:
            for path, first in zip(b["path"].to_pylist(), b["first"].to_pylist(), strict=True):
                with place.open_input_file(f"{base}/{path}") as f:
                    shard = ShardReader(f)
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in shard]
                    names = pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == -(2**63))
                    yield pa.RecordBatch.from_arrays([names, pa.array(shard.starts + first, pa.int64()), pa.array(shard.counts, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = spark.createDataFrame(parts, "path string, first long").repartition(max(1, len(parts)))
    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_rows(docs: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    out_dir = shared_dir(docs.sparkSession, "token-files")
    write_token_files(docs, out_dir, tokenizer=tokenizer)
    return read_token_files(docs.sparkSession, out_dir)
