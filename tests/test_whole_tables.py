"""Queries take whole tables: keys beyond those of the smallest one, held against brute force."""

from fractions import Fraction as F

import pytest

from framewright import queries as q
from framewright.functions import exact as ex


@pytest.fixture
def tables(spark, tmp_path):
    """A function that writes a table of rows and gives the folder it lies in."""

    def write(name: str, rows: list[tuple], schema: str) -> str:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_draws_of_all_orders(spark, tables):
    keys = [0, 7, 1999, 2000, 2001, 14_999, 149_999, 6_000_000]
    got = {r["o_orderkey"]: r["draw"] for r in q.QUERIES["bounded_draws"](spark, tables("orders", [(k,) for k in keys], "o_orderkey long")).collect()}
    assert got == {k: ex.Generator(k).below(200) for k in keys}


def near_segment(key: int, x: int, y: int) -> bool:
    """Whether a pixel's centre is within half a unit of a part's segment, in exact fractions."""
    a, b = (key % 16, key * 3 % 16), (key * 5 % 16, key * 7 % 16)
    d, p = (b[0] - a[0], b[1] - a[1]), (x + F(1, 2) - a[0], y + F(1, 2) - a[1])
    length = d[0] ** 2 + d[1] ** 2
    t = min(F(1), max(F(0), (p[0] * d[0] + p[1] * d[1]) / length)) if length else F(0)
    return (p[0] - t * d[0]) ** 2 + (p[1] - t * d[1]) ** 2 <= F(1, 4)


def test_pixels_of_all_segments(spark, tables):
    keys = [0, 3, 199, 200, 201, 1999, 19_999, 6_000_000]
    got = [tuple(r) for r in q.QUERIES["line_cover_pixels"](spark, tables("part", [(k,) for k in keys], "p_partkey long")).select("p_partkey", "x", "y").collect()]
    want = [(k, x, y) for k in keys for x in range(16) for y in range(16) if near_segment(k, x, y)]
    assert sorted(got) == want


def test_catalogue_query_makes_every_entry(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(q.co, "artifacts", lambda entries: asked.append(entries) or entries)
    q.QUERIES["catalogue_manifests"](spark, "")
    rows = asked[0].collect()
    assert len({r["name"] for r in rows}) == 138
    assert {r["frame_count"] for r in rows} == {1, 10, 100, 1000, 20000} and max(r["pixels"] for r in rows) == 1920 * 1080


def test_long_entries_in_ranges_equal_those_in_one_piece(spark):
    entries = q.co.catalogue(spark).where("frame_count = 1000").orderBy("ord").limit(2)
    got = {r["name"]: bytes(r["content"]) for r in q.co.artifact_bytes(entries).collect()}
    want = {}
    for r in entries.collect():
        e = q.co.parse_name(r["name"])
        want |= {f"{r['name']}.json": q.co.manifest_json(e), q.ct.media_name(e): q.co.media(e)}
    assert got == {k: v.encode() if isinstance(v, str) else v for k, v in want.items()}
