"""Queries that call the engine's own functions, with SQL that works the results out by another way.

Container files are written in SQL from their formats: a file is a list of hexadecimal parts of known
length, so the places of its fields, which the faults change, are known when the SQL is written.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import columns as c
from framewright.functions import containers as ct
from framewright.functions import geometry as g
from framewright.functions import jpeg
from framewright.functions import scene as sc
from framewright.operators import lockfile as lk
from framewright.operators import motion as mo
from framewright.operators import validate
from framewright.queries import _FILES, _files, _sine_sql, _word, query, table

# ---------------------------------------------------------------- files in SQL

Part = tuple[str, int, str]  # SQL of hexadecimal text, bytes, name of the place


def raw(data: bytes, name: str = "") -> list[Part]:
    return [(f"'{data.hex()}'", len(data), name)]


def num(expr: str, name: str = "", little: bool = False) -> list[Part]:
    h = f"printf('%08x', ({expr})::BIGINT)"
    return [(f"regexp_replace({h}, '^(..)(..)(..)(..)$', '\\4\\3\\2\\1')" if little else h, 4, name)]


def half(expr: str) -> list[Part]:
    return [(f"printf('%04x', ({expr})::BIGINT)", 2, "")]


def size_of(parts: list[Part]) -> int:
    return sum(n for _, n, _ in parts)


def iso_box(tag: str, *parts: list[Part]) -> list[Part]:
    body = [x for p in parts for x in p]
    return raw((size_of(body) + 8).to_bytes(4, "big") + tag.encode("latin-1"), tag) + body + [("''", 0, f"/{tag}")]


def riff(tag: str, *parts: list[Part], name: str = "") -> list[Part]:
    body = [x for p in parts for x in p]
    return raw(tag.encode() + size_of(body).to_bytes(4, "little"), name or tag) + body + [("''", 0, f"/{name or tag}")]


def places(parts: list[Part]) -> dict[str, int]:
    """Byte offsets of the first part of each name."""
    out, at = {}, 0
    for _, n, name in parts:
        if name:
            out.setdefault(name, at)
        at += n
    return out


def text_of(parts: list[Part]) -> str:
    return " || ".join(x for x, n, _ in parts if n)


FRAMES = (12, 9)
FRAME = [f"substr(sha256('{k}-' || s_suppkey), 1, {2 * n})" for k, n in enumerate(FRAMES)]
#: Columns of a file's declaration, from a supplier.
DECLARED = """SELECT s_suppkey, p // gcd(p, q) AS num, q // gcd(p, q) AS den, s_nationkey + 1 AS w, s_suppkey % 50 + 1 AS h, s_suppkey % 2 = 0 AS jpeg, s_suppkey % 4 AS turn FROM (SELECT *, s_nationkey + 24 AS p, s_suppkey % 7 + 1 AS q FROM supplier)"""
Z = bytes


def iso_parts(capture: str) -> list[Part]:
    one, unit = "65536", raw(bytes.fromhex("00010000" + "00" * 12 + "00010000" + "00" * 12 + "40000000"))
    pick = lambda *v: f"CASE turn WHEN 0 THEN {v[0]} WHEN 1 THEN {v[1]} WHEN 2 THEN {v[2]} ELSE {v[3]} END"
    minus = "4294901760"
    matrix = [num(pick(one, 0, minus, 0)), num(pick(0, one, 0, minus)), raw(Z(4)), num(pick(0, minus, 0, one)), num(pick(one, 0, minus, 0)), raw(Z(4)), num(pick(0, "h * 65536", "w * 65536", 0)), num(pick(0, 0, "h * 65536", "w * 65536")), raw(bytes.fromhex("40000000"))]
    entry = iso_box(
        "ENTRY", raw(Z(6) + b"\0\1" + Z(16)), half("w"), half("h"), raw(bytes.fromhex("0048000000480000") + Z(4) + b"\0\1" + Z(32) + b"\0\x18\xff\xff"),
    )
    # the tag of a sample entry depends on the row
    head = bytes(entry[0][0][1:9], "ascii").decode()
    entry[0] = (f"'{head}' || CASE WHEN jpeg THEN '{b'mjpg'.hex()}' ELSE '{b'raw '.hex()}' END", 8, "entry")

    def moov(first: int) -> list[Part]:
        stbl = iso_box(
            "stbl", iso_box("stsd", raw(Z(4) + b"\0\0\0\1"), entry), iso_box("stts", raw(Z(4) + b"\0\0\0\1\0\0\0\2"), num("den")), iso_box("stsc", raw(Z(4) + b"\0\0\0\1" * 4)),
            iso_box("stsz", raw(Z(8) + b"\0\0\0\2" + b"".join(n.to_bytes(4, "big") for n in FRAMES))), iso_box("stco", raw(Z(4) + b"\0\0\0\2"), raw(first.to_bytes(4, "big")), raw((first + FRAMES[0]).to_bytes(4, "big"))),
        )
        dinf = iso_box("dinf", iso_box("dref", raw(Z(4) + b"\0\0\0\1"), iso_box("url ", raw(b"\0\0\0\1"))))
        minf = iso_box("minf", iso_box("vmhd", raw(Z(6) + b"\xff" * 6)), dinf, stbl)
        mdia = iso_box("mdia", iso_box("mdhd", raw(Z(12)), num("num"), num("2 * den"), raw(b"\x55\xc4\0\0")), iso_box("hdlr", raw(Z(8) + b"vide" + Z(12) + b"VideoHandler")), minf)
        tkhd = iso_box("tkhd", raw(b"\0\0\0\x0f" + Z(8) + b"\0\0\0\1" + Z(4)), num("2 * den"), raw(Z(12) + b"\1\0\0\0"), *matrix, half("w"), raw(Z(2)), half("h"), raw(Z(2)))
        mvhd = iso_box("mvhd", raw(Z(12)), num("num"), num("2 * den"), raw(b"\0\1\0\0\1\0" + Z(10)), unit, raw(Z(24) + b"\0\0\0\2"))
        more: list[Part] = []
        if capture == "cfps":
            more = iso_box("udta", iso_box("cfps", raw(Z(4)), num("(num + 1) // gcd(num + 1, den)"), num("den // gcd(num + 1, den)")))
        if capture == "meta":
            name = b"com.apple.quicktime.capture.fps"
            # of 64, 128 or 256 frames a second: a power of two has no bits but its exponent's
            more = iso_box(
                "meta", raw(Z(4)), iso_box("hdlr", raw(Z(8) + b"mdta" + Z(13))), iso_box("keys", raw(Z(4) + b"\0\0\0\1" + (len(name) + 8).to_bytes(4, "big") + b"mdta" + name)),
                iso_box("ilst", iso_box("\0\0\0\1", iso_box("data", raw(b"\0\0\0\x17" + Z(4)), num("(133 + s_suppkey % 3) * 8388608")))),
            )
        return iso_box("moov", mvhd, iso_box("trak", tkhd, mdia), more)

    ftyp = iso_box("ftyp", raw(b"isom\0\0\2\0isom"))
    first = size_of(ftyp) + size_of(moov(0)) + 8
    frames = [(FRAME[k], n, f"frame{k}") for k, n in enumerate(FRAMES)]
    return ftyp + moov(first) + iso_box("mdat", frames)


AVI_FRAMES = {"mjpeg": (5, 8), "raw": (6, 6)}


def avi_parts(coding: str) -> list[Part]:
    """Two frames, of odd and even length where they are coded, or of two pixels."""
    sizes, is_jpeg = AVI_FRAMES[coding], coding == "mjpeg"
    w, h = (("w", "h") if is_jpeg else ("2", "1"))
    le = lambda e, name="": num(e, name, little=True)
    tag, four = ("00dc", b"MJPG") if is_jpeg else ("00db", Z(4))
    avih = riff("avih", le("den * 1000000 // num"), raw(Z(8) + b"\x10\0\0\0\2\0\0\0" + Z(4) + b"\1\0\0\0" + Z(4)), le(w), le(h), raw(Z(16)))
    strh = riff("strh", raw(b"vids" + (b"MJPG" if is_jpeg else b"DIB ") + Z(12)), le("den"), le("num"), raw(Z(4) + b"\2\0\0\0" + Z(4) + b"\xff" * 4 + Z(12)))
    strf = riff("strf", raw(b"\x28\0\0\0"), le(w), le(f"4294967296 - {h}"), raw(b"\1\0\x18\0" + four + Z(20)))
    hdrl = riff("LIST", raw(b"hdrl"), avih, riff("LIST", raw(b"strl"), strh, strf, name="strl"), name="hdrl")
    chunks = [riff(tag, [(f"substr(sha256('{k}-' || s_suppkey), 1, {2 * n})", n, f"frame{k}")], name=f"chunk{k}") + raw(Z(n % 2)) for k, n in enumerate(sizes)]
    movi = riff("LIST", raw(b"movi"), *chunks, name="movi")
    second = 4 + size_of(chunks[0])
    idx1 = riff("idx1", *[raw(tag.encode() + b"\x10\0\0\0" + at.to_bytes(4, "little") + n.to_bytes(4, "little")) for at, n in zip((4, second), sizes, strict=True)])
    return riff("RIFF", raw(b"AVI "), hdrl, movi, idx1)


def _digests(select: str) -> str:
    return f"SELECT s_suppkey, kind, md5(file) AS digest, (length(file) // 2)::BIGINT AS size FROM ({select})"


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, s_nationkey) of all suppliers, dealt to tasks."""
    return mo.dealt(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey")), "s_suppkey")


def media_rows(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """(s_suppkey, kind, digest, size) of what ``make`` gives for each supplier: (kind, bytes) pairs."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, nation in zip(pdf["s_suppkey"].tolist(), pdf["s_nationkey"].tolist(), strict=True):
                how = {"rate": Fraction(nation + 24, key % 7 + 1), "width": nation + 1, "height": key % 50 + 1, "jpeg": key % 2 == 0, "turn": ("identity", "rot90", "rot180", "rot270")[key % 4]}
                rows += [(key, kind, None if data is None else hashlib.md5(data.hex().encode()).hexdigest(), None if data is None else len(data)) for kind, data in make(key, how)]
            yield pd.DataFrame(rows, columns=["s_suppkey", "kind", "digest", "size"])

    return declared(spark, sf_dir).mapInPandas(run, "s_suppkey long, kind string, digest string, size long")


def some_frames(key: int, sizes: tuple[int, ...]) -> list[bytes]:
    return [hashlib.sha256(f"{k}-{key}".encode()).digest()[:n] for k, n in enumerate(sizes)]


def iso_of(key: int, how: dict, capture: str = "none") -> bytes:
    rate = {"none": None, "cfps": (Fraction(how["rate"].numerator + 1, how["rate"].denominator), "cfps"), "meta": (Fraction(64 << key % 3), "meta")}[capture]
    return ct.iso_file(some_frames(key, FRAMES), capture=rate, **how)


def avi_of(key: int, how: dict, coding: str) -> bytes:
    w, h = (how["width"], how["height"]) if coding == "mjpeg" else (2, 1)
    return ct.avi_file(some_frames(key, AVI_FRAMES[coding]), w, h, coding == "mjpeg", how["rate"])


@query(_digests(" UNION ALL ".join(f"SELECT s_suppkey, '{k}' AS kind, {text_of(iso_parts(k))} AS file FROM ({DECLARED})" for k in ("none", "cfps", "meta"))))
def iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ISO files with and without capture rates, all four turns."""
    return media_rows(spark, sf_dir, lambda key, how: [(k, iso_of(key, how, k)) for k in ("none", "cfps", "meta")])


@query(_digests(" UNION ALL ".join(f"SELECT s_suppkey, '{k}' AS kind, {text_of(avi_parts(k))} AS file FROM ({DECLARED})" for k in AVI_FRAMES)))
def avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: whole AVI files: headers, frames padded to even lengths, index."""
    return media_rows(spark, sf_dir, lambda key, how: [(k, avi_of(key, how, k)) for k in AVI_FRAMES])


def _put(at: int, value: str, n: int = 4) -> str:
    """SQL: the file with ``n`` bytes at ``at`` replaced."""
    return f"file[:{2 * at}] || {value} || file[{2 * (at + n) + 1}:]"


def _cut(a: int, b: int) -> str:
    return f"file[{2 * a + 1}:{2 * b}]"


def _faulty(parts: list[Part], faults: dict[str, str]) -> str:
    return _digests(" UNION ALL ".join(f"SELECT s_suppkey, '{k}' AS kind, {e} AS file FROM (SELECT s_suppkey, {text_of(parts)} AS file FROM ({DECLARED}))" for k, e in faults.items()))


def _be(n: int) -> str:
    return f"'{n.to_bytes(4, 'big').hex()}'"


def _le(n: int) -> str:
    return f"'{n.to_bytes(4, 'little').hex()}'"


def _iso_faults() -> dict[str, str]:
    parts = iso_parts("none")
    at, n = places(parts), size_of(parts)
    box = lambda tag: at[f"/{tag}"] - at[tag]
    stsd, trak = at["stsd"] + 8, box("trak")
    # growing moov by a copy of trak, put after it
    dup = f"file[:{2 * at['moov']}] || {_be(box('moov') + trak)} || {_cut(at['moov'] + 4, at['/trak'])} || {_cut(at['trak'], at['/trak'])} || {_cut(at['/trak'], n)}"
    sized = f"{_cut(0, at['tkhd'] + 84)} || '00000000' || '00000000' || {_cut(at['tkhd'] + 92, stsd + 40)} || '00000000' || {_cut(stsd + 44, n)}"
    return {
        "trunc-before": _cut(0, at["moov"]), "trunc-within": _cut(0, at["frame0"] + 5), "trunc-in-tkhd": _cut(0, at["tkhd"] + 3), "trunc-second": _cut(0, at["frame1"] + 1),
        "zero-pay": _put(at["mdat"], _be(8)), "over-len": _put(at["ftyp"], _be(20 + 256)), "under-len": _put(at["moov"], _be(box("moov") - 1)), "off-end": _put(at["stco"] + 16, _be(n + 1)),
        "dup-box": dup, "unk-box": f"{_put(0, _be(28))} || '00000008' || '{b'UNKN'.hex()}'", "unk-in-trak": f"{_cut(0, at['moov'])} || {_be(box('moov') + 8)} || {_cut(at['moov'] + 4, at['trak'])} || {_be(trak + 8)} || {_cut(at['trak'] + 4, at['/trak'])} || '00000008' || '{b'UNKN'.hex()}' || {_cut(at['/trak'], n)}",
        "zero-fps": _put(at["mvhd"] + 20, _be(0)), "absurd-fps": _put(at["mvhd"] + 20, _be(1_000_001)), "no-dim": sized, "zero-width": _put(at["tkhd"] + 84, _be(0)), "zero-height": _put(at["tkhd"] + 88, _be(0)),
        "non-mono": _put(at["stts"] + 20, _be(0)), "count-mis": _put(at["stsz"] + 16, _be(42)), "reorder": f"{_cut(0, at['moov'])} || {_cut(at['mdat'], n)} || {_cut(at['moov'], at['mdat'])}",
    }


ISO_CALLS = {
    "trunc-within": ("trunc-within", {"offset": 5}), "trunc-in-tkhd": ("trunc-within", {"address": ("moov", "trak", "tkhd"), "offset": 3}), "trunc-second": ("trunc-within", {"address": ("mdat", 1), "offset": 1}),
    "unk-in-trak": ("unk-box", {"path": ("moov", "trak")}), "zero-width": ("zero-dim", {}), "zero-height": ("zero-dim", {"axis": "height"}),
}


@query(_faulty(iso_parts("none"), _iso_faults()))
def iso_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D15 in ISO files, K9: each fault put in by the engine."""
    kinds = list(_iso_faults())

    def make(key, how):
        data = ct.Parsed(iso_of(key, how))
        return [(k, ct.inject(data, ISO_CALLS.get(k, (k, {}))[0], **ISO_CALLS.get(k, (k, {}))[1])) for k in kinds]

    return media_rows(spark, sf_dir, make)


def _avi_faults() -> dict[str, str]:
    parts = avi_parts("mjpeg")
    at, n = places(parts), size_of(parts)
    length = lambda tag: at[f"/{tag}"] - at[tag] - 8
    return {
        "trunc-before": _cut(0, at["movi"]), "trunc-within": _cut(0, at["frame0"] + 3), "trunc-second": _cut(0, at["frame1"] + 7), "over-avih": _put(at["avih"] + 4, _le(length("avih") + 256)), "under-movi": _put(at["movi"] + 4, _le(length("movi") - 1)),
        "unk-box": f"'{b'ZIFF'.hex()}' || {_le(n)} || {_cut(8, n)} || '{b'UNKN'.hex()}' || '08000000'", "zero-fps": _put(at["strh"] + 32, _le(0)), "absurd-fps": _put(at["strh"] + 32, _le(1_000_001)),
        "zero-width": _put(at["avih"] + 40, _le(0)), "zero-height": _put(at["avih"] + 44, _le(0)), "count-mis": _put(at["avih"] + 24, _le(42)),
    }


AVI_CALLS = {
    "trunc-within": ("trunc-within", {"offset": 3}), "trunc-second": ("trunc-within", {"address": ("RIFF", "movi", 1), "offset": 7}), "over-avih": ("over-len", {"path": ("hdrl", "avih")}), "under-movi": ("under-len", {"path": ("movi",)}),
    "zero-width": ("zero-dim", {}), "zero-height": ("zero-dim", {"axis": "height"}),
}


@query(_faulty(avi_parts("mjpeg"), _avi_faults()))
def avi_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2, D4, D5, D8, D9, D11, D12, D14 in AVI files."""
    kinds = list(_avi_faults())

    def make(key, how):
        data = ct.Parsed(avi_of(key, how, "mjpeg"))
        return [(k, ct.inject(data, AVI_CALLS.get(k, (k, {}))[0], **AVI_CALLS.get(k, (k, {}))[1])) for k in kinds]

    return media_rows(spark, sf_dir, make)


ISO_REGIONS = ("ftyp", "moov", "moov/mvhd", "moov/trak", "moov/trak/tkhd", "moov/trak/mdia", "moov/trak/mdia/mdhd", "moov/trak/mdia/hdlr", "moov/trak/mdia/minf", "moov/trak/mdia/minf/vmhd", "moov/trak/mdia/minf/dinf", "moov/trak/mdia/minf/dinf/dref", "moov/trak/mdia/minf/stbl", *(f"moov/trak/mdia/minf/stbl/{t}" for t in ("stsd", "stts", "stsc", "stsz", "stco")), "mdat", "mdat/#0", "mdat/#1")
AVI_REGIONS = ("RIFF", "RIFF/hdrl", "RIFF/hdrl/avih", "RIFF/hdrl/strl", "RIFF/hdrl/strl/strh", "RIFF/hdrl/strl/strf", "RIFF/movi", "RIFF/movi/#0", "RIFF/movi/#1", "RIFF/idx1")


def _layout_sql() -> str:
    rows = []
    for kind, parts, regions in (("iso", iso_parts("none"), ISO_REGIONS), ("avi", avi_parts("mjpeg"), AVI_REGIONS)):
        at = places(parts)
        starts = [at[r.rsplit("/", 1)[-1].replace("#", "frame")] for r in regions]
        rows += [f"('{kind}', '{r}', {a}, {b})" for r, a, b in zip(regions, starts, [*starts[1:], size_of(parts)], strict=True)]
    return f"""WITH r(kind, address, first, stop) AS (VALUES {', '.join(rows)})
SELECT s_suppkey, kind, address, first::BIGINT AS first, stop::BIGINT AS stop FROM supplier, r
UNION ALL SELECT s_suppkey, kind, 'prefixes', 0, max(stop)::BIGINT FROM supplier, r GROUP BY s_suppkey, kind"""


@query(_layout_sql())
def container_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte's owner; truncations before and within regions are all proper prefixes, each once."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, nation in zip(pdf["s_suppkey"].tolist(), pdf["s_nationkey"].tolist(), strict=True):
                how = {"rate": Fraction(nation + 24, key % 7 + 1), "width": nation + 1, "height": key % 50 + 1, "jpeg": key % 2 == 0, "turn": "identity"}
                for data in map(ct.Parsed, (iso_of(key, how), avi_of(key, how, "mjpeg"))):
                    kind, regions = ct.detect(data), ct.layout(data)
                    name = lambda s: f"#{s}" if isinstance(s, int) else s[0] + (f"[{s[1]}]" if s[1] else "")
                    rows += [(key, kind, "/".join(map(name, r.address)), r.start, r.end) for r in regions]
                    cuts = sorted(x for r in regions for x in range(r.start, r.end))
                    rows.append((key, kind, "prefixes", cuts[0], cuts[-1] + 1 if cuts == list(range(len(data))) else -1))
            yield pd.DataFrame(rows, columns=["s_suppkey", "kind", "address", "first", "stop"])

    return declared(spark, sf_dir).mapInPandas(run, "s_suppkey long, kind string, address string, first long, stop long")


# ---------------------------------------------------------------- declarations and differences

_DECL = """SELECT o_orderkey, o_custkey, o_orderkey % 23 - 1 AS width, o_orderkey % 19 - 1 AS height, o_custkey % 17 - 1 AS count, o_orderkey % 13 AS rate_num, 3::BIGINT AS rate_den, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 11 END AS scale_num, 2::BIGINT AS scale_den,
o_custkey % 29 AS zoom_num, CASE WHEN o_custkey % 31 = 7 THEN -4 ELSE 4 END::BIGINT AS zoom_den, CASE WHEN o_orderkey % 3 > 0 THEN 2 * (o_custkey % 14) END AS capture_num, 6::BIGINT AS capture_den,
CASE o_orderkey % 2 WHEN 0 THEN 'raw' ELSE 'mjpeg' END AS coding, CASE o_custkey % 2 WHEN 0 THEN 'iso' ELSE 'avi' END AS container, CASE o_orderkey % 4 WHEN 0 THEN 'no-dim' ELSE 'nodef' END AS defect FROM orders"""


@query(f"""SELECT o_orderkey, CASE WHEN width <= 0 THEN 'width' WHEN height <= 0 THEN 'height' WHEN count <= 0 THEN 'count' WHEN rate_num = 0 THEN 'rate' WHEN scale_num = 0 THEN 'scale' WHEN zoom_num = 0 OR zoom_den < 0 THEN 'magnification'
WHEN capture_num = 0 THEN 'capture rate' WHEN capture_num = 2 * rate_num THEN 'capture equals playback' WHEN defect = 'no-dim' AND NOT (coding = 'mjpeg' AND container = 'iso') THEN 'size-omission' END AS error FROM ({_DECL})""")
def declaration_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, counts, rates and factors above zero, capture apart from playback, where a size may be left out."""
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    d = {
        "width": o % 23 - 1, "height": o % 19 - 1, "count": k % 17 - 1, "rate_num": o % 13, "rate_den": c.lit(3), "scale_num": F.when(o % 5 > 0, k % 11), "scale_den": c.lit(2), "zoom_num": k % 29, "zoom_den": F.when(k % 31 == 7, c.lit(-4)).otherwise(c.lit(4)),
        "capture_num": F.when(o % 3 > 0, 2 * (k % 14)), "capture_den": c.lit(6), "coding": F.when(o % 2 == 0, "raw").otherwise("mjpeg"), "container": F.when(k % 2 == 0, "iso").otherwise("avi"), "defect": F.when(o % 4 == 0, "no-dim").otherwise("nodef"),
    }
    return table(spark, sf_dir, "orders").select("o_orderkey", validate.declaration_error(d).alias("error"))


_TEXT = "CASE doc_id % 6 WHEN 0 THEN 'frame_count' WHEN 1 THEN 'raw-16' || doc_id WHEN 2 THEN '' WHEN 3 THEN substr(text, 1, 4) WHEN 4 THEN 'a.b' || doc_id ELSE 'x.' || doc_id || '.y' END"


@query(f"""SELECT doc_id, CASE WHEN t = '' THEN 'empty' WHEN NOT regexp_full_match(t, '[a-z_]+') THEN 'alphabet' END AS as_key, CASE WHEN t = '' THEN 'empty' WHEN NOT regexp_full_match(t, '[a-z0-9-]+') THEN 'alphabet' END AS as_entry,
CASE WHEN t = '' THEN 'empty' WHEN NOT regexp_full_match(t, '[a-z0-9-]+\\.[a-z0-9]+') THEN 'alphabet' END AS as_file FROM (SELECT doc_id, {_TEXT} AS t FROM documents)""")
def alphabets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys, entry names and file names."""
    d = F.col("doc_id")
    said = lambda *x: F.concat(*[y if not isinstance(y, str) else F.lit(y) for y in x])
    text = F.when(d % 6 == 0, "frame_count").when(d % 6 == 1, said("raw-16", d.cast("string"))).when(d % 6 == 2, "").when(d % 6 == 3, F.substring("text", 1, 4)).when(d % 6 == 4, said("a.b", d.cast("string"))).otherwise(said("x.", d.cast("string"), ".y"))
    t = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    return t.select("doc_id", *[validate.name_error(F.col("t"), kind).alias(f"as_{kind}") for kind in ("key", "entry", "file")])


_ODD = f"""SELECT CASE WHEN pos % 11 = 3 THEN 'new-' || name WHEN pos % 11 = 5 THEN 'Odd_' || name ELSE name END AS name, CASE WHEN pos % 13 = 5 THEN sha256(digest) ELSE digest END AS digest,
CASE WHEN pos % 17 = 2 THEN length + 1 WHEN pos % 23 = 6 THEN NULL ELSE length END AS length, pos FROM (SELECT *, row_number() OVER (ORDER BY digest, name) AS pos FROM ({_FILES})) WHERE pos % 19 <> 4"""


@query(f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY name DESC) AS pos FROM ({_FILES})), a AS ({_ODD}),
j AS (SELECT coalesce(e.name, a.name) AS name, e.name AS en, a.name AS an, e.digest AS ed, a.digest AS ad, e.length AS el, a.length AS al, e.pos AS eat, a.pos AS aat, a.name IS NOT NULL AND NOT regexp_full_match(a.name, '[a-z0-9-]+\\.[a-z0-9]+') AS odd FROM e FULL OUTER JOIN a ON e.name = a.name),
k AS (SELECT *, an IS NOT NULL AND NOT odd AND al IS NULL AS over FROM j), f AS (SELECT *, an IS NOT NULL AND NOT odd AND NOT over AS fine FROM k),
d AS (SELECT name, u.kind, CASE u.kind WHEN 'digest' THEN ed WHEN 'length' THEN el::VARCHAR END AS expected, CASE u.kind WHEN 'digest' THEN ad WHEN 'length' THEN al::VARCHAR END AS actual, CASE u.kind WHEN 'missing' THEN eat ELSE aat END AS pos
FROM f, (VALUES ('missing'), ('extra'), ('digest'), ('length'), ('invalid-name'), ('length-overflow')) u(kind)
WHERE CASE u.kind WHEN 'missing' THEN en IS NOT NULL AND NOT fine WHEN 'extra' THEN fine AND en IS NULL WHEN 'invalid-name' THEN odd WHEN 'length-overflow' THEN over WHEN 'digest' THEN fine AND ed <> ad ELSE fine AND el <> al END)
SELECT row_number() OVER (ORDER BY kind = 'missing', pos, name, kind = 'length') AS nth, kind, name, expected, actual FROM d""")
def differences_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six kinds of difference, told in the corpus's order, then missing ones in the lockfile's."""
    from pyspark.sql import Window

    files = _files(spark, sf_dir)
    e = files.withColumn("at", F.row_number().over(Window.orderBy(F.col("name").desc())))
    a = files.withColumn("at", F.row_number().over(Window.orderBy("digest", "name"))).where("at % 19 <> 4")
    at = F.col("at")
    name = F.when(at % 11 == 3, F.concat(F.lit("new-"), "name")).when(at % 11 == 5, F.concat(F.lit("Odd_"), "name")).otherwise(F.col("name"))
    length = F.when(at % 17 == 2, F.col("length") + 1).when(at % 23 == 6, F.lit(None).cast("long")).otherwise(F.col("length"))
    a = a.select(name.alias("name"), F.when(at % 13 == 5, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"), length.alias("length"), "at")
    found = lk.differences(e, a)
    return found.select(F.row_number().over(Window.orderBy("ord")).cast("long").alias("nth"), "kind", "name", "expected", "actual")


@query("SELECT name, line_no FROM (SELECT 'n-' || o_custkey AS name, o_orderkey AS line_no, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) WHERE nth = 2 ORDER BY line_no LIMIT 1")
def first_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of a file whose name an earlier line has."""
    return lk.first_duplicate(table(spark, sf_dir, "orders").select(F.concat(F.lit("n-"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderkey").alias("line_no")))


# ---------------------------------------------------------------- shapes, motions and blocks by the engine


def per_nation(spark: SparkSession, sf_dir: str, make, schema: str) -> DataFrame:
    """Rows that ``make`` gives for each nation's key."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([r for key in pdf["n_nationkey"].tolist() for r in make(int(key))], columns=names)

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey")).mapInPandas(run, schema)


@query("""
SELECT n::BIGINT AS n_nationkey, i::BIGINT AS i, CASE WHEN ax > bx OR ay > by_ THEN 'inverted' ELSE ((bx - ax) * (by_ - ay))::VARCHAR END AS area,
  CASE WHEN ax > bx OR ay > by_ THEN NULL WHEN greatest(ax, 0) > least(bx, 9) OR greatest(ay, 0) > least(by_, 9) THEN 'inverted' ELSE ((least(bx, 9) - greatest(ax, 0)) * (least(by_, 9) - greatest(ay, 0)))::VARCHAR END AS met
FROM (SELECT n_nationkey AS n, i, (n_nationkey * 3 + i) % 13 - 4 AS ax, (n_nationkey + 5 * i) % 11 - 3 AS ay, (n_nationkey * 7 + 2 * i) % 17 - 2 AS bx, (n_nationkey * 2 + 3 * i) % 14 - 1 AS by_ FROM nation, range(40) t(i))
""")
def bounds_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that are inverted, their areas, their meeting with a frame."""

    def make(n: int):
        for i in range(40):
            corners = map(Fraction, ((n * 3 + i) % 13 - 4, (n + 5 * i) % 11 - 3, (n * 7 + 2 * i) % 17 - 2, (n * 2 + 3 * i) % 14 - 1))
            try:
                b = g.bounds(*corners)
            except g.Inverted:
                yield n, i, "inverted", None
                continue
            try:
                met = str(b.intersect(g.bounds(*map(Fraction, (0, 0, 9, 9)))).area())
            except g.Inverted:
                met = "inverted"
            yield n, i, str(b.area()), met

    return per_nation(spark, sf_dir, make, "n_nationkey long, i long, area string, met string")


@query("""
SELECT n::BIGINT AS n_nationkey, i::BIGINT AS i, x::BIGINT AS same_x, x + n AS moved_x, y - 3 AS moved_y, 3 * x + n AS scaled_x, 3 * y - 3 AS scaled_y,
  CASE q WHEN 0 THEN x WHEN 1 THEN -y WHEN 2 THEN -x ELSE y END + n AS turned_x, CASE q WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN -y ELSE -x END - 3 AS turned_y, x AS back_x, y AS back_y, true AS singular
FROM (SELECT n_nationkey AS n, i, i - 7 AS x, n_nationkey * i % 19 AS y, (n_nationkey + i) % 4 AS q FROM nation, range(20) t(i))
""")
def similarities_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities, translations, scales and quarter turns, composed and undone; no inverse of a flat map."""

    def make(n: int):
        move = g.similarity_translation(g.Point(Fraction(n), Fraction(-3)))
        for i in range(20):
            p, q = g.Point(Fraction(i - 7), Fraction(n * i % 19)), (n + i) % 4
            scaled = g.similarity_scale(Fraction(3)).then(move).apply(p)
            turn = move.compose(g.similarity_quarter_turns(q))
            same = g.similarity_identity().apply(g.affine_identity().apply(p))
            moved = g.affine_translation(g.Point(Fraction(n), Fraction(-3))).apply(p)
            turned = g.affine_translation(g.Point(Fraction(n), Fraction(-3))).compose(g.affine_quarter_turns(q)).apply(p)
            back = turn.inverse().apply(turn.apply(p))
            try:
                g.Affine(*map(Fraction, (1, 2, 2, 4, 0, 0))).inverse()
                singular = False
            except ArithmeticError:
                singular = True
            yield (n, i, *(int(v) for v in (same.x, moved.x, moved.y, scaled.x, scaled.y, turned.x, turned.y, back.x, back.y)), singular and turned == turn.apply(p))

    return per_nation(spark, sf_dir, make, "n_nationkey long, i long, same_x long, moved_x long, moved_y long, scaled_x long, scaled_y long, turned_x long, turned_y long, back_x long, back_y long, singular boolean")


@query("""
WITH v AS (SELECT * FROM (VALUES (8, 2, 30, 12), (30, 12, 24, 34), (24, 34, 16, 18), (16, 18, 4, 30), (4, 30, 8, 2)) t(x, y, x2, y2)),
s AS (SELECT n_nationkey, px, py, 2 * px + 1 - n_nationkey % 4 AS sx, 2 * py + 1 - n_nationkey % 3 AS sy FROM nation, range(20) a(px), range(20) b(py)),
p AS (SELECT n_nationkey, px, py, sx, sy, bool_or((x2 - x) * (sy - y) - (y2 - y) * (sx - x) = 0 AND sx BETWEEN least(x, x2) AND greatest(x, x2) AND sy BETWEEN least(y, y2) AND greatest(y, y2)) AS on_edge,
  (sum(CASE WHEN (y > sy) <> (y2 > sy) AND ((x2 - x) * (sy - y) - (y2 - y) * (sx - x) > 0) = (y2 > y) AND (x2 - x) * (sy - y) - (y2 - y) * (sx - x) <> 0 THEN 1 ELSE 0 END) % 2 = 1) AS odd FROM s, v GROUP BY ALL),
l AS (SELECT *, 22 * 22 + 10 * 10 AS len, (sx - 8) * 22 + (sy - 2) * 10 AS along, (sx - 8) * 10 - (sy - 2) * 22 AS side FROM p)
SELECT n_nationkey::BIGINT AS n_nationkey, px, py, on_edge, odd, on_edge OR odd AS inside, (sx - 17) * (sx - 17) + (sy - 16) * (sy - 16) <= 121 AS in_disc,
  CASE WHEN along <= 0 THEN (sx - 8) * (sx - 8) + (sy - 2) * (sy - 2) <= 1 WHEN along >= len THEN (sx - 30) * (sx - 30) + (sy - 12) * (sy - 12) <= 1 ELSE side * side <= len END AS on_line FROM l
""")
def cover_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, parity, polygons, discs and lines by the engine's own tests; samples and vertices doubled."""
    corners = [g.Point(Fraction(x, 2), Fraction(y, 2)) for x, y in ((8, 2), (30, 12), (24, 34), (16, 18), (4, 30))]

    def make(n: int):
        for px in range(20):
            for py in range(20):
                p = g.Point(Fraction(2 * px + 1 - n % 4, 2), Fraction(2 * py + 1 - n % 3, 2))
                on = any(g.on_segment(p, a, b) for a, b in g.edges(corners))
                yield n, px, py, on, g.crossings_odd(p, corners), g.in_polygon(p, corners), g.disc_covers(g.Point(Fraction(17, 2), Fraction(8)), Fraction(11, 2), p), g.line_covers(corners[0], corners[1], p)

    return per_nation(spark, sf_dir, make, "n_nationkey long, px long, py long, on_edge boolean, odd boolean, inside boolean, in_disc boolean, on_line boolean")


@query(f"""
SELECT n::BIGINT AS n_nationkey, f::BIGINT AS frame, (x + 2 * f)::VARCHAR AS linear_x, (200 * (x + 2 * f) + 3 * f * f)::BIGINT AS ballistic_x200, (32768 * x + 5 * {_sine_sql('o.f + o.n', '24', True)})::BIGINT AS circular_x, (32768 * x + 7 * {_sine_sql('o.f * 5 + o.n', '60', False)})::BIGINT AS oscillating_x,
  CASE WHEN f < 4 THEN x WHEN f < 9 THEN x + 2 * f ELSE 100 END::VARCHAR AS piecewise_x, (4 + least(f, 8))::BIGINT AS zoom4, ({_sine_sql('-o.f', '16', True)} * (4 + least(f, 8)))::BIGINT AS camera_xx, (-{_sine_sql('-o.f', '16', False)} * (4 + least(f, 8)))::BIGINT AS camera_xy
FROM (SELECT n_nationkey AS n, f, n_nationkey * 3 AS x FROM nation, range(14) t(f)) o
""")
def motions_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, nested segments, turn and zoom of a camera by the engine's own functions."""

    def make(n: int):
        x = Fraction(3 * n)
        at = (x, Fraction(0))
        fixed = {"kind": "fixed", "origin": at}
        linear = {"kind": "linear", "origin": at, "velocity": (Fraction(2), Fraction(0))}
        ballistic = {"kind": "ballistic", "origin": at, "velocity": (Fraction(2), Fraction(0)), "acceleration": (Fraction(3, 100), Fraction(0))}
        circular = {"kind": "circular", "origin": at, "radius": Fraction(5), "turns_per_frame": Fraction(1, 24), "phase": Fraction(n, 24)}
        swing = {"kind": "oscillating", "origin": at, "amplitude": (Fraction(7), Fraction(0)), "period": 12, "phase": Fraction(n, 60)}
        inner = {"kind": "piecewise", "segments": [{"from": 0, "motion": linear}, {"from": 9, "motion": {"kind": "fixed", "origin": (Fraction(100), Fraction(0))}}]}
        nested = {"kind": "piecewise", "segments": [{"from": 2, "motion": fixed}, {"from": 4, "motion": inner}]}
        camera = {"motion": fixed, "rotation": {"start": Fraction(0), "per_frame": Fraction(1, 16)}, "zoom": {"start": Fraction(1), "end": Fraction(3), "over": 8}}
        walks = sc.Walks()
        for f in range(14):
            place = lambda m: sc.position(m, f, walks).x  # noqa: B023, E731
            m, z = sc.camera_at(camera, f, walks)
            scaled = [place(circular) * 32768, place(swing) * 32768, m.xx * 4 * 32768, m.xy * 4 * 32768, z * 4, place(ballistic) * 200]
            if any(v.denominator != 1 for v in scaled):
                raise ArithmeticError("not in these units")
            circ, osc, xx, xy, z4, b200 = map(int, scaled)
            yield n, f, str(place(linear)), b200, circ, osc, str(place(nested)), z4, xx, xy

    return per_nation(spark, sf_dir, make, "n_nationkey long, frame long, linear_x string, ballistic_x200 long, circular_x long, oscillating_x long, piecewise_x string, zoom4 long, camera_xx long, camera_xy long")


@query("""
WITH s AS (SELECT n_nationkey AS n, n_nationkey % 13 + 1 AS w, n_nationkey * 5 % 11 + 1 AS h FROM nation),
c AS (SELECT n, w, h, y, x, (n * 31 + y * 17 + x * 7) % 256 AS v FROM s, range(20) a(y), range(20) b(x) WHERE y < h AND x < w),
luma AS (SELECT s.n, a.y // 8 AS r, b.x // 8 AS col, a.y % 8 AS y, b.x % 8 AS x, coalesce(c.v, 0) AS v FROM s, range(16) a(y), range(16) b(x) LEFT JOIN c ON c.n = s.n AND c.y = a.y AND c.x = b.x),
half AS (SELECT n, y // 2 AS y, x // 2 AS x, (sum(v) + count(*) // 2) // count(*) AS v FROM c GROUP BY n, y // 2, x // 2),
chroma AS (SELECT s.n, 0 AS r, 0 AS col, a.y, b.x, coalesce(h.v, 128) AS v FROM s, range(8) a(y), range(8) b(x) LEFT JOIN half h ON h.n = s.n AND h.y = a.y AND h.x = b.x)
SELECT n::BIGINT AS n_nationkey, 'luma' AS plane, r::BIGINT AS r, col::BIGINT AS col, y::BIGINT AS y, x::BIGINT AS x, v::BIGINT AS v FROM (SELECT n, r, col, y, x, v FROM luma) UNION ALL SELECT n, 'chroma', r, col, y, x, v FROM chroma
""")
def padded_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of planes that they do not fill, by the coder: luma padded with 0, halved chroma with 128."""
    import numpy as np

    def make(n: int):
        w, h = n % 13 + 1, n * 5 % 11 + 1
        plane = np.array([[(n * 31 + y * 17 + x * 7) % 256 for x in range(w)] for y in range(h)], np.uint8)
        for name, got in (("luma", jpeg.blocks(plane, 2, 2, 0)), ("chroma", jpeg.blocks(jpeg.halve(plane), 1, 1, 128))):
            for (r, col, y, x), v in np.ndenumerate(got):
                yield n, name, r, col, y, x, int(v)

    return per_nation(spark, sf_dir, make, "n_nationkey long, plane string, r long, col long, y long, x long, v long")


@query("""
SELECT n_nationkey::BIGINT AS n_nationkey, kind, y::BIGINT AS y, x::BIGINT AS x, CASE kind WHEN 'solid' THEN 40 + n_nationkey WHEN 'checker' THEN CASE WHEN x // cell % 2 = y // cell % 2 THEN 200 ELSE 100 END WHEN 'grid' THEN CASE WHEN x % cell = 0 OR y % cell = 0 THEN 100 ELSE 180 END
  WHEN 'across' THEN (50 * 15 - 50 * x + 200 * x + 7) // 15 WHEN 'down' THEN (50 * 11 - 50 * y + 200 * y + 5) // 11 ELSE 50 END::BIGINT AS v
FROM (SELECT n_nationkey, n_nationkey % 7 + 1 AS cell FROM nation), (VALUES ('solid', 16, 12), ('checker', 16, 12), ('grid', 16, 12), ('across', 16, 12), ('down', 16, 12), ('one', 1, 12)) k(kind, w, h), range(16) a(x), range(12) b(y) WHERE x < w AND y < h
""")
def backdrops_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solid grounds, checkers, grids and gradients, one of a single column, by the engine."""

    def make(n: int):
        cell = n % 7 + 1
        grounds = {
            "solid": {"kind": "solid", "colour": (40 + n,) * 3}, "checker": {"kind": "checker", "cell": cell, "even": (200,) * 3, "odd": (100,) * 3}, "grid": {"kind": "grid", "spacing": cell, "line": (100,) * 3, "ground": (180,) * 3},
            "across": {"kind": "gradient", "direction": "horizontal", "from": (50,) * 3, "to": (200,) * 3}, "down": {"kind": "gradient", "direction": "vertical", "from": (50,) * 3, "to": (200,) * 3}, "one": {"kind": "gradient", "direction": "horizontal", "from": (50,) * 3, "to": (200,) * 3},
        }
        for name, ground in grounds.items():
            px = sc.backdrop(ground, 1 if name == "one" else 16, 12)
            for y, row in enumerate(px[..., 1].tolist()):
                yield from ((n, name, y, x, v) for x, v in enumerate(row))

    return per_nation(spark, sf_dir, make, "n_nationkey long, kind string, y long, x long, v long")


def _blob(i: str, draw: int, below: int) -> str:
    return f"({_word('n_nationkey::UHUGEINT', f'(6 * {i} + {draw})')} % {below})::BIGINT"


@query(f"""
WITH d AS MATERIALIZED (SELECT n_nationkey, i, {_blob('i', 1, 16)} AS cx, {_blob('i', 2, 16)} AS cy, 2 + {_blob('i', 3, 4)} AS r, {_blob('i', 4, 256)} AS red, {_blob('i', 5, 256)} AS green, {_blob('i', 6, 256)} AS blue FROM nation, range(5) t(i)),
p AS (SELECT n_nationkey, x, y FROM nation, range(16) a(x), range(16) b(y))
SELECT p.n_nationkey::BIGINT AS n_nationkey, x::BIGINT AS x, y::BIGINT AS y, coalesce(arg_max(red, i), 0) AS red, coalesce(arg_max(green, i), 0) AS green, coalesce(arg_max(blue, i), 0) AS blue
FROM p LEFT JOIN d ON d.n_nationkey = p.n_nationkey AND (2 * x + 1 - 2 * cx) * (2 * x + 1 - 2 * cx) + (2 * y + 1 - 2 * cy) * (2 * y + 1 - 2 * cy) <= 4 * r * r GROUP BY 1, 2, 3
""")
def blobs_by_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discs drawn one after another from one stream: place, radius, colour; later ones cover."""

    def make(n: int):
        px = sc.backdrop({"kind": "blobs", "seed": n, "count": 5, "radii": (2, 5)}, 16, 16)
        for y, row in enumerate(px.tolist()):
            yield from ((n, x, y, *colour) for x, colour in enumerate(row))

    return per_nation(spark, sf_dir, make, "n_nationkey long, x long, y long, red long, green long, blue long")
