"""Whole entries, containers, faults, the catalogue, lockfiles."""

import hashlib

import numpy as np
import pytest

from framewright import queries as q
from framewright.functions import containers as ct
from framewright.functions import jpeg
from framewright.operators import lockfile as lk
from framewright.plans import catalogue, corpus


def test_whole_entries_have_frozen_digests(spark):
    import duckdb

    want = {r[0]: r[1:] for r in duckdb.sql(q.ORACLES["golden_artifacts"]).fetchall()}
    got = {r["name"]: (r["digest"], r["length"]) for r in q.QUERIES["golden_artifacts"](spark, "").collect()}
    assert got == want


def test_manifest_in_one_piece_equals_manifest_in_ranges():
    for name in q.GOLDEN:
        e = corpus.parse_name(name)
        assert catalogue.entry_name(e) == name and len(corpus.manifest_json(e)) > 700


@pytest.fixture(scope="module")
def pairs():
    fits = lambda a, i, b, j: not (a == 0 and b == 1 and not catalogue.volume_fits(catalogue.AXES["dimensions"][i], catalogue.AXES["frame_count"][j])) and not (a == 7 and b == 10 and not catalogue.defect_fits(catalogue.AXES["container"][i], j))
    n = catalogue.SIZES
    return [(a, i, b, j) for a in range(11) for i in range(n[a]) for b in range(a + 1, 11) for j in range(n[b]) if fits(a, i, b, j)]


def test_catalogue_covers_all_pairs(pairs):
    assert len(pairs) == 1419
    rows = catalogue.covering_array(pairs)
    have = {(a, r[a], b, r[b]) for r in rows for a in range(11) for b in range(a + 1, 11)}
    assert have >= set(pairs)
    assert len(have - set(pairs)) == 0
    entries = catalogue.entries(pairs)
    assert len(entries) == 138 and sum(bool(e["capture"]) for e in entries) == 9
    names = [catalogue.entry_name(e) for e in entries]
    assert len(set(names)) == 138 and all(catalogue.entry_name(corpus.parse_name(n)) == n for n in names)


def frames(n=2, size=16):
    return [bytes([k]) * (size * size * 3) for k in range(n)]


ISO = {"width": 16, "height": 16, "jpeg": False, "rate": catalogue.RATES["ntsc"]}


def test_offsets_point_at_frames():
    for data, fs in ((ct.iso_file(frames(), **ISO), frames()), (ct.avi_file(frames(), 16, 16, False, catalogue.RATES["30fps"]), frames())):
        got = [data[a:b] for a, b in ct.frame_ranges(data)]
        assert [g[-len(f) :] for g, f in zip(got, fs)] == fs
        assert ct.detect(data) in ("iso", "avi")


def test_each_fault_changes_bytes_or_is_refused():
    iso, avi = ct.iso_file(frames(), **ISO), ct.avi_file(frames(), 16, 16, False, catalogue.RATES["30fps"])
    for fault in sorted(set(catalogue.AXES["defect"]) - {"nodef"} | {"no-dim"}):
        assert ct.inject(iso, fault) != iso
        assert ct.inject(iso, fault) == ct.inject(iso, fault)
    assert ct.inject(iso, "unk-box")[:4] == (28).to_bytes(4, "big") and ct.inject(avi, "unk-box")[:4] == b"ZIFF"
    assert ct.inject(avi, "trunc-before") == avi[:212]
    assert len(ct.inject(iso, "reorder")) == len(iso) and len(ct.inject(iso, "dup-box")) > len(iso)
    for fault in ("no-dim", "non-mono", "dup-box"):
        with pytest.raises(ct.FaultError):
            ct.inject(avi, fault)
    with pytest.raises(ct.FaultError):
        ct.inject(b"nothing", "zero-fps")
    with pytest.raises(ct.FaultError):
        ct.inject(iso, "trunc-within", offset=10**6)


def test_capture_boxes():
    data = ct.iso_file(frames(), capture=(catalogue.CAPTURES[2][1], "cfps"), **ISO)
    assert data[data.index(b"cfps") + 8 :][:8] == (24000).to_bytes(4, "big") + (1001).to_bytes(4, "big")
    assert b"com.apple.quicktime.capture.fps" in ct.iso_file(frames(), capture=(catalogue.CAPTURES[6][1], "meta"), **ISO)


def test_jpeg_entropy_coding_reads_back():
    """Levels decoded from the scan are those of the blocks."""
    rgb = np.zeros((16, 16, 3), np.uint8)
    rgb[..., 0], rgb[..., 1], rgb[..., 2] = 16 * np.arange(16)[None, :], 128, 16 * np.arange(16)[:, None]
    data = jpeg.encode(rgb, 75, subsampled=False)
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9" and data == jpeg.encode(rgb, 75, subsampled=False)
    scan = data[data.index(b"\xff\xda") + 14 : -2].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{b:08b}" for b in scan)
    at = 0

    def symbol(table):
        nonlocal at
        code = ""
        while True:
            code += bits[at]
            at += 1
            for s, (c, n) in table.items():
                if n == len(code) and c == int(code, 2):
                    return s

    def value(size):
        nonlocal at
        if not size:
            return 0
        v = int(bits[at : at + size], 2)
        at += size
        return v if v >> (size - 1) else v - (1 << size) + 1

    planes, last = jpeg.ycbcr(rgb), [0, 0, 0]
    for y in range(2):
        for x in range(2):
            for c in range(3):
                chroma = c > 0
                want = jpeg.coefficients(jpeg.blocks(planes[..., c], 2, 2, 128 if chroma else 0), jpeg.steps(75, chroma))[y, x].tolist()
                last[c] += value(symbol(jpeg.codes(jpeg.DC_LENGTHS[chroma], jpeg.DC_SYMBOLS)))
                got = [last[c]]
                while len(got) < 64:
                    s = symbol(jpeg.codes(jpeg.AC_LENGTHS[chroma], jpeg.AC_SYMBOLS[chroma]))
                    if s == 0:
                        got += [0] * (64 - len(got))
                    elif s == 0xF0:
                        got += [0] * 16
                    else:
                        got += [0] * (s >> 4) + [value(s & 15)]
                assert got == want


def test_lockfile_lines_and_differences(spark):
    rows = [("a.json", "0" * 64, 3), ("b-media.mp4", "1" * 64, 4), ("c.json", "2" * 64, 5)]
    expected = spark.createDataFrame(rows, "name string, digest string, length long")
    actual = spark.createDataFrame([("a.json", "0" * 64, 3), ("b-media.mp4", "f" * 64, 9), ("d.json", "2" * 64, 5)], "name string, digest string, length long")
    got = {(r["kind"], r["name"]) for r in lk.differences(expected, actual).collect()}
    assert got == {("missing", "c.json"), ("extra", "d.json"), ("digest", "b-media.mp4"), ("length", "b-media.mp4")}
    assert tuple(lk.summary(expected, lk.differences(expected, actual)).first()) == (3, 1, 2)
    lines = lk.lockfile_lines(expected)
    assert lk.parse_lines(lines).where("error is null").count() == 3
    assert lk.parse_lines(spark.createDataFrame([("",), ("a b",), ("A.b " + "0" * 64 + " 1",)], "line string")).select("error").collect() == [("fields",), ("name",)]


def test_publish_and_dry_run(spark, tmp_path):
    rows = [(n, corpus.parse_name(n)["frame_count"]) for n in q.GOLDEN[3:]]
    e = spark.createDataFrame(rows, "name string, frame_count long")
    assert corpus.publish(e, str(tmp_path / "dry"), dry_run=True).count() == 2 and not (tmp_path / "dry").exists()
    assert {r["error"] for r in corpus.publish(e, str(tmp_path / "out")).collect()} == {None}
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names == [f"{q.GOLDEN[3]}-media.mp4", f"{q.GOLDEN[3]}.json"]
    assert hashlib.sha256((tmp_path / "out" / names[1]).read_bytes()).hexdigest().startswith("e5271381")
    with pytest.raises(ValueError):
        corpus.select_entries(e, ["no-such"], strict=True)
    assert corpus.select_entries(e, ["no-such"]).count() == 0
