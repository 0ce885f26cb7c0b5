"""Declarations that must be refused, layouts of damaged files, arrays against plain integers, files that cannot be written."""

import random
from fractions import Fraction

import numpy as np
import pytest

from framewright.functions import containers as ct
from framewright.functions import exact as ex
from framewright.functions import jpeg
from framewright.operators import entropy
from framewright.operators import lockfile as lk
from framewright.plans import catalogue, corpus


def test_entries_that_must_not_be_made():
    good = "0016x0016-10-30fps-solid-disc-fixed-mjpeg-iso-identity-unscaled-no-dim"
    assert corpus.parse_name(good)["defect"] == "no-dim"
    for bad in (
        good.replace("mjpeg", "raw"), good.replace("iso", "avi"), "0016x0016-10-30fps-solid-disc-fixed-raw-iso-identity-unscaled-cap30-nodef", "0000x0016-10-30fps-solid-disc-fixed-raw-iso-identity-unscaled-nodef",
        "0016x0016-0-30fps-solid-disc-fixed-raw-iso-identity-unscaled-nodef", "0016x0016-10-30fps-solid-disc-fixed-raw-avi-identity-unscaled-cap240-nodef",
    ):
        with pytest.raises(ValueError):
            corpus.parse_name(bad)


def test_objects_of_written_keys():
    assert corpus.canonical_object([("b", 1), ("a", [2]), ("b", 3)]) == '{"a":[2],"b":3}'
    for key in ("B", "", "a-b", "a1"):
        with pytest.raises(ValueError):
            corpus.canonical_object([(key, 1)])


def files():
    frames = [b"abcdefg", b"xy", b"12345"]
    how = {"width": 4, "height": 4, "jpeg": True, "rate": catalogue.RATES["30fps"]}
    yield ct.iso_file(frames, **how)
    yield ct.iso_file(frames, capture=(Fraction(240), "cfps"), **how)
    yield ct.iso_file(frames, capture=(Fraction(240), "meta"), **how)
    yield ct.avi_file(frames, 4, 4, True, catalogue.RATES["30fps"])


def test_truncations_are_all_proper_prefixes_each_once():
    for data in files():
        regions = ct.layout(data)
        assert len({r.address for r in regions}) == len(regions)
        lengths = []
        for r in regions:
            lengths.append(len(ct.inject(data, "trunc-before", address=r.address)) if len(ct.inject(data, "trunc-before", address=r.address)) else 0)
            lengths += [len(ct.inject(data, "trunc-within", address=r.address, offset=k)) for k in range(1, r.end - r.start)]
        assert sorted(lengths) == list(range(len(data)))
    frames = [data[a:b] for data in [next(iter(files()))] for a, b in (ct.span(data, ("mdat", k)) for k in range(3))]
    assert frames == [b"abcdefg", b"xy", b"12345"]


def test_siblings_are_told_apart():
    data = ct.box(b"ftyp", b"isom") + ct.box(b"free", b"a") + ct.box(b"moov", ct.box(b"trak", ct.box(b"tkhd")), ct.box(b"trak", ct.box(b"tkhd"), ct.box(b"edts", ct.box(b"elst")))) + ct.box(b"free", b"bc")
    assert ct.span(data, ("free",)) == (12, 21) and ct.span(data, (("free", 1),)) == (len(data) - 10, len(data))
    assert ct.inject(data, "trunc-within", address=("moov", ("trak", 1), "edts", "elst"), offset=3) == data[: len(data) - 10 - 5]
    for address in (("free", 0), (("free", 2),), ("moov", ("trak", 2))):
        with pytest.raises(ct.FaultError):
            ct.span(data, address)
    moved = ct.inject(next(iter(files())), "dup-box")
    assert [b.occurrence for b in ct.read_boxes(moved) if b.path == ("moov", "trak")] == [0, 1]


def test_damaged_tables_are_refused():
    data = next(iter(files()))
    stco = next(b for b in ct.read_boxes(data) if b.path[-1] == "stco")
    stsz = next(b for b in ct.read_boxes(data) if b.path[-1] == "stsz")
    for bad in (ct.put(data, stsz.payload + 8, 2, "big"), ct.put(data, stco.payload + 8, 3, "big"), ct.put(data, stsz.payload + 16, 10**6, "big")):
        with pytest.raises(ct.FaultError):
            ct.layout(bad)


def plain_scan(blocks, components):
    """Entropy coding one symbol at a time."""
    bits, last = "", {}
    for zz, c in zip(blocks, components, strict=True):
        dc = jpeg.codes(jpeg.DC_LENGTHS[c > 0], jpeg.DC_SYMBOLS)
        ac = jpeg.codes(jpeg.AC_LENGTHS[c > 0], jpeg.AC_SYMBOLS[c > 0])
        code = lambda t, s: format(t[s][0], f"0{t[s][1]}b")
        own = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
        d = max(-2047, min(2047, zz[0] - last.get(c, 0)))
        last[c] = last.get(c, 0) + d
        bits += code(dc, abs(d).bit_length()) + own(d)
        run = 0
        for v in zz[1:]:
            if v:
                bits += code(ac, 0xF0) * (run // 16) + code(ac, run % 16 << 4 | abs(v).bit_length()) + own(v)
            run = 0 if v else run + 1
        bits += code(ac, 0) if run else ""
    bits += "1" * (-len(bits) % 8)
    return b"".join(bytes([b, 0]) if b == 255 else bytes([b]) for b in int(bits, 2).to_bytes(len(bits) // 8, "big"))


def test_scan_equals_one_symbol_at_a_time():
    rng = np.random.default_rng(3)
    for _ in range(20):
        zz = rng.integers(-1000, 1000, (12, 64)) * (rng.random((12, 64)) < rng.choice([0.02, 0.2, 0.9]))
        zz[:, 0] = rng.integers(-9000, 9000, 12)
        component = np.tile([0, 0, 1, 2], 3)
        assert jpeg.scan(zz, component) == plain_scan(zz.tolist(), component.tolist())


def test_single_precision_arrays():
    rng = random.Random(2)
    num = [rng.choice([0, 1, 2**32 - 1, rng.getrandbits(rng.randint(1, 32))]) for _ in range(3000)]
    den = [rng.choice([1, 2**32 - 1, rng.getrandbits(rng.randint(1, 32)) | 1]) for _ in range(3000)]
    assert ex.vector_binary32(num, den).tolist() == [ex.binary32(a, b) for a, b in zip(num, den, strict=True)]
    with pytest.raises(ex.Overflow):
        ex.vector_binary32([1], [2**32])


def test_differences_of_all_kinds_in_order(spark):
    e = spark.createDataFrame([("b.x", "1", 1, 1), ("a.x", "2", 2, 2), ("c.x", "3", 3, 3)], "name string, digest string, length long, at long")
    a = spark.createDataFrame([("z.x", "9", 9, 1), ("Odd", "9", 9, 2), ("c.x", "4", 4, 3), ("a.x", "2", None, 4)], "name string, digest string, length long, at long")
    got = [(r["kind"], r["name"]) for r in lk.differences(e, a).orderBy("ord").collect()]
    assert got == [("extra", "z.x"), ("invalid-name", "Odd"), ("digest", "c.x"), ("length", "c.x"), ("length-overflow", "a.x"), ("missing", "b.x"), ("missing", "a.x")]
    assert lk.first_duplicate(spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("a", 4)], "name string, line_no long")).first()["line_no"] == 3
    assert lk.first_duplicate(spark.createDataFrame([("a", 1)], "name string, line_no long")).count() == 0


def test_symbols_of_rows_equal_the_coder(spark):
    rng = np.random.default_rng(5)
    zz = rng.integers(-3, 4, (6, 64)) * (rng.random((6, 64)) < 0.04)
    rows = spark.createDataFrame([(b, k, int(v)) for b, block in enumerate(zz.tolist()) for k, v in enumerate(block)], "block long, k long, level long")
    got = {}
    for r in entropy.ac_symbols(rows, "block").orderBy("block", "k", "part").collect():
        got.setdefault(r["block"], []).append(r["symbol"])
    for b, block in enumerate(zz.tolist()):
        want, run = [], 0
        for v in block[1:]:
            if v:
                want += [0xF0] * (run // 16) + [run % 16 << 4 | abs(v).bit_length()]
            run = 0 if v else run + 1
        assert got.get(b, []) == want + [0] * bool(run)


def test_failed_writes_leave_nothing_behind(spark, tmp_path):
    name = "0016x0016-10-30fps-solid-disc-fixed-raw-iso-identity-unscaled-nodef"
    (tmp_path / f"{name}.json").mkdir()
    (tmp_path / f"{name}.json" / "in the way").write_text("")
    entries = spark.createDataFrame([(name, 10)], "name string, frame_count long")
    done = {r["name"]: r["error"] for r in corpus.publish(entries, str(tmp_path)).collect()}
    assert done[f"{name}.json"] and done[f"{name}-media.mp4"] is None
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"{name}-media.mp4", f"{name}.json"]


def test_covering_array_equals_plain_greedy(spark):
    pairs = sorted(tuple(r) for r in catalogue.pair_obligations(spark).collect())
    axes = list(catalogue.AXES.values())
    left, want = set(pairs), []

    def allowed(axis, row):
        container, coding, size, count = axes[7][row[7]], axes[6][row[6]], axes[0][row[0]], axes[1][row[1]]
        if axis in (7, 10) and catalogue.NEEDS[row[10]] not in (None, container):
            return False
        if axis in (0, 1) and size[0] * size[1] * count > 10_000_000:
            return False
        return axis not in (0, 1, 6, 7) or coding != "raw" or count * (size[0] * size[1] * 3 + 16) < 2**32

    cells = lambda row: {(i, row[i], j, row[j]) for i in range(len(row)) for j in range(i + 1, len(row))}
    for a, va, b, vb in pairs:
        if (a, va, b, vb) in left:
            row = [0] * len(axes)
            row[a], row[b] = va, vb
            for axis in set(range(len(axes))) - {a, b}:
                tried = []
                for value in range(len(axes[axis])):
                    row[axis] = value
                    if allowed(axis, row):
                        tried.append((len(cells(row) & left), -value))
                row[axis] = -max(tried)[1]
            left -= cells(row)
            want.append(tuple(row))
    assert catalogue.covering_array(pairs) == want and not left
