"""Queries over the engine's operators, with the DuckDB SQL that gives the same rows.

Operators are functions over columns; the driver's tables supply numbers, bytes and intervals.
Results are BIGINT, STRING and BOOLEAN, so that both engines' values are equal exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from framewright.functions import arrow
from framewright.functions import columns as c
from framewright.operators import lockfile as lk
from framewright.operators import motion as mo
from framewright.plans import catalogue as ct
from framewright.plans import corpus as co
from framewright.plans.catalogue_names import NAMES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as the query of its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rat(num: str, den: str = "1") -> str:
    """SQL text of a reduced fraction."""
    return f"(({num}) // (gcd({num}, {den}) * sign({den})::BIGINT))::VARCHAR || '/' || (abs({den}) // gcd({num}, {den}))::VARCHAR"


# ---------------------------------------------------------------- exact numbers

_A, _B = ("l_orderkey", "l_linenumber::BIGINT"), ("l_partkey", "l_suppkey")


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {rat(*_A)} AS a, {rat('l_orderkey * l_suppkey + l_partkey * l_linenumber', 'l_linenumber * l_suppkey')} AS a_plus_b,
  {rat('l_orderkey * l_suppkey - l_partkey * l_linenumber', 'l_linenumber * l_suppkey')} AS a_minus_b,
  {rat('l_orderkey * l_partkey', 'l_linenumber * l_suppkey')} AS a_times_b,
  {rat('l_orderkey * l_suppkey', 'l_linenumber * l_partkey')} AS a_over_b,
  {rat('-l_orderkey', 'l_linenumber::BIGINT')} AS minus_a,
  sign(l_orderkey * l_suppkey - l_partkey * l_linenumber)::INTEGER AS compared,
  (l_orderkey * l_suppkey = l_partkey * l_linenumber) AS equal,
  floor_a, floor_minus_a, -floor_minus_a AS ceil_a
FROM (SELECT *, l_orderkey // l_linenumber AS floor_a, -((l_orderkey + l_linenumber - 1) // l_linenumber) AS floor_minus_a FROM (SELECT l_orderkey, l_linenumber, l_partkey + 1 AS l_partkey, l_suppkey + 1 AS l_suppkey FROM lineitem))
""")
def ratio_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Construct, add, subtract, multiply, divide, negate, compare, floor and ceiling."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") + 1).alias("l_partkey"), (F.col("l_suppkey") + 1).alias("l_suppkey"))
    one = c.lit(1)
    t = t.withColumn("x", arrow.ratio_op("div")("l_orderkey", one, F.col("l_linenumber").cast("long"), one)).withColumn("y", arrow.ratio_op("div")("l_partkey", one, "l_suppkey", one))
    x, y = F.col("x"), F.col("y")
    op = lambda name: c.r_text(arrow.ratio_op(name)("x.num", "x.den", "y.num", "y.den"))
    return t.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.r_text(x).alias("a"), op("add").alias("a_plus_b"), op("sub").alias("a_minus_b"),
        op("mul").alias("a_times_b"), op("div").alias("a_over_b"), c.r_text(c.r_neg(x)).alias("minus_a"), c.r_cmp(x, y).alias("compared"), (x == y).alias("equal"),
        c.r_floor(x).alias("floor_a"), c.r_floor(c.r_neg(x)).alias("floor_minus_a"), c.r_ceil(x).alias("ceil_a"),
    )


@query("""
SELECT o_orderkey, (h // gcd(h, w))::VARCHAR || '/' || (w // gcd(h, w))::VARCHAR AS product FROM (
SELECT o_orderkey, (o_orderkey::HUGEINT * 4611686018427387847)::HUGEINT AS h, ((o_custkey + 1)::HUGEINT * 4611686018427387847)::HUGEINT AS w FROM orders)
""")
def ratio_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 on parts whose product leaves 64 bits while the reduced result does not."""
    t = table(spark, sf_dir, "orders")
    big = F.lit(4611686018427387847)
    return t.select(
        "o_orderkey", c.r_text(arrow.ratio_op("mul")(F.col("o_orderkey"), big, big, F.col("o_custkey") + 1)).alias("product")
    )


def _sine_sql(num: str, den: str, cosine: bool) -> str:
    four = f"((({num}) * 4 + {den if cosine else 0}) % (4 * {den}) + 4 * {den}) % (4 * {den})"
    return f"""(SELECT CASE WHEN q < 2 THEN v ELSE -v END FROM (SELECT q, CASE WHEN up <= 0 THEN 0 WHEN up >= d THEN 32768 ELSE
      greatest(0, least(32768, (15708 * u - 6459 * t3 + 794 * t5 - 43 * t7 + 5000) // 10000)) END AS v FROM (
      SELECT *, (((u * u // 32768) * (u * u // 32768)) // 32768) * u // 32768 AS t5, (t3 * t3 // 32768) * u // 32768 AS t7 FROM (
      SELECT *, (u * u // 32768) * u // 32768 AS t3 FROM (SELECT *, least(32768, (up * 32768 + d // 2) // d) AS u FROM (
      SELECT q, d, CASE WHEN q % 2 = 0 THEN r ELSE d - r END AS up FROM (SELECT f // d AS q, f % d AS r, d FROM (SELECT {four} AS f, ({den})::BIGINT AS d)))))))) """


@query(f"""
SELECT event_id, {_sine_sql('e.event_id - 500', '97', False)}::BIGINT AS sin_scaled, {_sine_sql('e.event_id - 500', '97', True)}::BIGINT AS cos_scaled FROM events e
""")
def trig_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sine and cosine of turns in units of 1/32768."""
    n = F.col("event_id") - 500
    return table(spark, sf_dir, "events").select("event_id", c.sine(n, F.lit(97).cast("long")).alias("sin_scaled"), c.sine(n, F.lit(97).cast("long"), cosine=True).alias("cos_scaled"))


_M = "18446744073709551616::UHUGEINT"


def _mix_sql(state: str) -> str:
    """Words of generator states as unsigned 64-bit decimals; products are split to stay in 128 bits."""
    mul = lambda x, k: f"((({x}) % 4294967296 * {k} + (({x}) // 4294967296 * {k} % 4294967296) * 4294967296) % {_M})"
    a = f"(SELECT xor(z, z >> 30) AS z FROM (SELECT ({state})::UHUGEINT AS z))"
    b = f"(SELECT xor(z, z >> 27) AS z FROM (SELECT {mul('z', '13787848793156543929::UHUGEINT')} AS z FROM {a}))"
    return f"(SELECT xor(z, z >> 31) FROM (SELECT {mul('z', '10723151780598845931::UHUGEINT')} AS z FROM {b}))"


def _word(seed: str, draw: str) -> str:
    return _mix_sql(f"({seed} + {draw}::UHUGEINT * 11400714819323198485) % {_M}")


@query(f"""
SELECT o_orderkey, lower(lpad(to_hex({_word('o_orderkey::UHUGEINT', '1')}::UBIGINT), 16, '0')) AS word1,
       lower(lpad(to_hex({_word('o_orderkey::UHUGEINT', '2')}::UBIGINT), 16, '0')) AS word2,
       ({_word('o_orderkey::UHUGEINT', '1')} >> 2)::BIGINT AS unit_num
FROM orders
""")
def splitmix_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter-form words of the generator, and the unit draw over 2**62."""
    t = table(spark, sf_dir, "orders")
    w = lambda k: arrow.splitmix(F.col("o_orderkey"), F.lit(k).cast("long"))
    h = lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))
    return t.select("o_orderkey", h(w(1)).alias("word1"), h(w(2)).alias("word2"), F.shiftrightunsigned(w(1), 2).alias("unit_num"))


@query(f"""
SELECT event_id, (((user_id::UHUGEINT % 4294967296) * 13787848793156543929::UHUGEINT + event_id::UHUGEINT) % {_M})::VARCHAR AS seed FROM events
""")
def walk_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiply-add modulo 2**64."""
    s = arrow.walk_seed(F.col("event_id"), F.col("user_id"))
    text = F.when(s >= 0, s.cast("decimal(20,0)")).otherwise(s.cast("decimal(20,0)") + F.lit(Decimal(2**64)).cast("decimal(20,0)"))
    return table(spark, sf_dir, "events").select("event_id", text.cast("decimal(20,0)").cast("string").alias("seed"))


def _accepted(seed: str, limit: int, mask: int, tries: int) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN ({_word(seed, str(k))} % {mask + 1}) < {limit} THEN ({_word(seed, str(k))} % {mask + 1})::BIGINT END" for k in range(1, tries + 1)) + ")"


@query(f"SELECT o_orderkey, {_accepted('o_orderkey::UHUGEINT', 200, 255, 9)} AS draw FROM orders")
def bounded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws below 200 by mask and rejection."""
    t = table(spark, sf_dir, "orders")
    return t.select("o_orderkey", arrow.bounded(F.col("o_orderkey"), F.lit(200).cast("long")).alias("draw"))


@query("""
SELECT l_orderkey, l_linenumber, (src * alpha + dst * (255 - alpha) + 127) // 255 AS blended, w * h * 3 AS buffer_len,
  (w * h * 3 + 16) * n <= 4294967295 AS fits FROM (
SELECT l_orderkey, l_linenumber, l_partkey % 256 AS src, l_suppkey % 256 AS alpha, l_orderkey % 256 AS dst, l_partkey % 1920 + 1 AS w, l_suppkey % 1080 + 1 AS h, l_orderkey AS n FROM lineitem)
""")
def channel_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blending of channels, frame buffer lengths, the 32-bit capacity check."""
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    area = (p % 1920 + 1) * (s % 1080 + 1) * 3
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.blend(p % 256, s % 256, k % 256).alias("blended"), area.alias("buffer_len"), ((area + 16) * k <= 4294967295).alias("fits"))


@query("""
SELECT p_partkey, p_size, lower(lpad(to_hex(CASE WHEN p_partkey = 0 THEN 0::UBIGINT WHEN m >= 16777216 THEN ((e + 1 + 127) * 8388608)::UBIGINT ELSE ((e + 127) * 8388608 + m - 8388608)::UBIGINT END), 8, '0')) AS bits FROM (
SELECT p_partkey, p_size, e, CASE WHEN 2 * r > d OR (2 * r = d AND q % 2 = 1) THEN q + 1 ELSE q END AS m FROM (
SELECT *, a // d AS q, a % d AS r FROM (
SELECT p_partkey, p_size, e, CASE WHEN e <= 23 THEN p_partkey::HUGEINT * (1::HUGEINT << (23 - e)) ELSE p_partkey::HUGEINT END AS a, CASE WHEN e <= 23 THEN p_size::HUGEINT ELSE p_size::HUGEINT * (1::HUGEINT << (e - 23)) END AS d FROM (
SELECT p_partkey, p_size, (SELECT max(k) FROM range(-8, 40) t(k) WHERE CASE WHEN k >= 0 THEN p_partkey::HUGEINT >= p_size::HUGEINT * (1::HUGEINT << k::INTEGER) ELSE p_partkey::HUGEINT * (1::HUGEINT << (-k)::INTEGER) >= p_size END)::INTEGER AS e FROM part))))
""")
def float_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-precision bits of a fraction, nearest with ties to even, in integers."""
    t = table(spark, sf_dir, "part")
    return t.select("p_partkey", "p_size", F.lower(F.lpad(F.hex(arrow.binary32(F.col("p_partkey"), F.col("p_size").cast("long"))), 8, "0")).alias("bits"))


# ---------------------------------------------------------------- geometry


@query("""
SELECT l_orderkey, l_linenumber, 3 * x - 2 * y + 5 AS ax, 2 * x + 4 * y - 7 AS ay, 3 * x - 2 * y AS vx, 2 * x + 4 * y AS vy,
  -y AS qx, x AS qy, 2 * x + 3 * y + 1 AS sx, -3 * x + 2 * y + 2 AS sy,
  2 * (3 * x - 2 * y + 5) + 3 * (2 * x + 4 * y - 7) + 1 AS cx, -3 * (3 * x - 2 * y + 5) + 2 * (2 * x + 4 * y - 7) + 2 AS cy, x AS back_x, y AS back_y
FROM (SELECT l_orderkey, l_linenumber, l_partkey AS x, l_suppkey AS y FROM lineitem)
""")
def affine_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms applied to points and vectors, composed, and undone by their inverses."""
    from fractions import Fraction

    from framewright.functions import geometry as g

    m = g.Affine(*map(Fraction, (3, -2, 2, 4, 5, -7)))
    sim = g.Similarity(*map(Fraction, (2, 3, 1, 2)))
    quarter, both, back = g.affine_quarter_turns(1), m.then(sim.to_affine()), m.inverse()

    def at(t: g.Affine, x, y, vector: bool = False):
        """Columns of a constant transform over one denominator, exact for integer points on its lattice."""
        import math

        den = math.lcm(*(v.denominator for v in t))
        a, b, cc, d, tx, ty = (int(v * den) for v in t)
        px = F.lit(a).cast("long") * x + F.lit(b).cast("long") * y + (0 if vector else tx)
        py = F.lit(cc).cast("long") * x + F.lit(d).cast("long") * y + (0 if vector else ty)
        return c.div(px, den), c.div(py, den)

    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))
    x, y = F.col("x"), F.col("y")
    out = {}
    for name, tr, vec in (("a", m, False), ("v", m, True), ("q", quarter, False), ("s", sim.to_affine(), False), ("c", both, False)):
        px, py = at(tr, x, y, vec)
        out |= {f"{name}x": px, f"{name}y": py}
    moved = t.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in out.items()])
    bx, by = at(back, F.col("ax"), F.col("ay"))
    return moved.withColumns({"back_x": bx, "back_y": by})


_BOX = "SELECT p_partkey, p_partkey % 40 - 10 AS cx, p_partkey * 7 % 40 - 10 AS cy, p_size % 15 + 1 AS r FROM part"


@query(f"""
SELECT p_partkey, cx - r AS min_x, cy - r AS min_y, cx + r AS max_x, cy + r AS max_y, 4 * r * r AS area, {rat('seen', 'whole')} AS on_screen,
  (cx + r < 0 OR cx - r > 20 OR cy + r < 0 OR cy - r > 20) AS outside FROM (
SELECT *, (4 * r * r)::BIGINT AS whole, (greatest(0, least(20, cx + r) - greatest(0, cx - r)) * greatest(0, least(20, cy + r) - greatest(0, cy - r)))::BIGINT AS seen FROM ({_BOX}))
""")
def bbox_visible_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disc extents, their area, and the share of it inside a 20 by 20 frame."""
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 40 - 10).alias("cx"), (F.col("p_partkey") * 7 % 40 - 10).alias("cy"), (F.col("p_size") % 15 + 1).cast("long").alias("r"))
    cx, cy, r, zero, edge = F.col("cx"), F.col("cy"), F.col("r"), c.lit(0), c.lit(20)
    side = lambda m: F.greatest(zero, F.least(edge, m + r) - F.greatest(zero, m - r))
    share = c.ratio(side(cx) * side(cy), 4 * r * r)
    t = t.withColumn("share", share)
    # the fraction of an extent can be no less than 0 and no more than 1
    checked = F.when((F.col("share.num") < 0) | (F.col("share.num") > F.col("share.den")), F.raise_error(F.lit("on-screen fraction outside [0, 1]")).cast("string")).otherwise(c.r_text(F.col("share")))
    out = (cx + r < 0) | (cx - r > 20) | (cy + r < 0) | (cy - r > 20)
    return t.select("p_partkey", (cx - r).alias("min_x"), (cy - r).alias("min_y"), (cx + r).alias("max_x"), (cy + r).alias("max_y"), (4 * r * r).alias("area"), checked.alias("on_screen"), out.alias("outside"))


@query("""
SELECT p_partkey, min_x, min_y, max_x, max_y, line_min_x, line_max_x FROM (
SELECT p_partkey, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, min(CASE WHEN k < 2 THEN 2 * x END) - 1 AS line_min_x, max(CASE WHEN k < 2 THEN 2 * x END) + 1 AS line_max_x FROM (
SELECT p_partkey, k, (p_partkey * (3 * k + 1)) % 31 AS x, (p_partkey * (5 * k + 2)) % 37 AS y FROM part, range(5) t(k)) GROUP BY p_partkey)
""")
def polygon_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of five-cornered polygons as minimum and maximum over vertices, and of a line, in halves."""
    k = F.sequence(F.lit(0), F.lit(4))
    p = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select("p_partkey", F.transform(k, lambda i: p * (3 * i + 1) % 31).alias("x"), F.transform(k, lambda i: p * (5 * i + 2) % 37).alias("y"))
    line = F.slice("x", 1, 2)
    return t.select("p_partkey", F.array_min("x").alias("min_x"), F.array_min("y").alias("min_y"), F.array_max("x").alias("max_x"), F.array_max("y").alias("max_y"), (2 * F.array_min(line) - 1).alias("line_min_x"), (2 * F.array_max(line) + 1).alias("line_max_x"))


# vertices and samples doubled, so that pixel centres are integers
_POLY = "[{'x': 8, 'y': 2}, {'x': 30, 'y': 12}, {'x': 24, 'y': 34}, {'x': 16, 'y': 18}, {'x': 4, 'y': 30}]"
_VERTICES = ((8, 2), (30, 12), (24, 34), (16, 18), (4, 30))


@query(f"""
WITH v AS (SELECT i, x, y, x2, y2 FROM (SELECT i, ax AS x, ay AS y, lead(ax, 1, 8) OVER (ORDER BY i) AS x2, lead(ay, 1, 2) OVER (ORDER BY i) AS y2 FROM (VALUES (0, 8, 2), (1, 30, 12), (2, 24, 34), (3, 16, 18), (4, 4, 30)) t(i, ax, ay))),
g AS (SELECT n_nationkey, px, py, 2 * px + 1 - n_nationkey % 4 AS sx, 2 * py + 1 - n_nationkey % 3 AS sy FROM nation, range(20) a(px), range(20) b(py))
SELECT n_nationkey, px, py, bool_or((x2 - x) * (sy - y) - (y2 - y) * (sx - x) = 0 AND sx BETWEEN least(x, x2) AND greatest(x, x2) AND sy BETWEEN least(y, y2) AND greatest(y, y2)) AS on_edge,
  (sum(CASE WHEN (y > sy) <> (y2 > sy) AND ((x2 - x) * (sy - y) - (y2 - y) * (sx - x) > 0) = (y2 > y) AND (x2 - x) * (sy - y) - (y2 - y) * (sx - x) <> 0 THEN 1 ELSE 0 END) % 2 = 1) AS odd
FROM g, v GROUP BY n_nationkey, px, py
""")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples against the edges of a concave polygon: on an edge, and parity of crossings."""
    grid = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(c.lit(0), c.lit(19))).alias("px")).withColumn("py", F.explode(F.sequence(c.lit(0), c.lit(19))))
    sx, sy = c.pixel_centre(F.col("px"))["num"] - F.col("n_nationkey") % 4, c.pixel_centre(F.col("py"))["num"] - F.col("n_nationkey") % 3
    on, odd = F.lit(False), F.lit(False)
    for (x, y), (x2, y2) in zip(_VERTICES, _VERTICES[1:] + _VERTICES[:1], strict=True):
        cross = (x2 - x) * (sy - y) - (y2 - y) * (sx - x)
        on = on | ((cross == 0) & sx.between(min(x, x2), max(x, x2)) & sy.between(min(y, y2), max(y, y2)))
        hit = ((F.lit(y) > sy) != (F.lit(y2) > sy)) & ((cross > 0) == F.lit(y2 > y)) & (cross != 0)
        odd = odd != hit
    return grid.select("n_nationkey", "px", "py", on.alias("on_edge"), odd.alias("odd"))


@query("""
SELECT p_partkey, x, y FROM (SELECT p_partkey, p_partkey * 3 % 64 AS cx2, p_partkey * 5 % 64 AS cy2, p_size % 12 AS r FROM part), range(32) a(x), range(32) b(y)
WHERE (2 * x + 1 - cx2) * (2 * x + 1 - cx2) + (2 * y + 1 - cy2) * (2 * y + 1 - cy2) <= 4 * r * r
""")
def disc_cover_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that discs cover; only rows and columns inside a disc's box are made."""
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 3 % 64).alias("cx2"), (F.col("p_partkey") * 5 % 64).alias("cy2"), (F.col("p_size") % 12).cast("long").alias("r"))

    def span(mid: str):
        # pixel i has its centre at (2i + 1) / 2: ceil((mid - 2r - 1) / 2) to floor((mid + 2r - 1) / 2)
        low = F.greatest(c.lit(0), -c.floordiv(-(F.col(mid) - 2 * F.col("r") - 1), c.lit(2)))
        high = F.least(c.lit(31), c.floordiv(F.col(mid) + 2 * F.col("r") - 1, c.lit(2)))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    px = t.withColumn("x", F.explode(span("cx2"))).withColumn("y", F.explode(span("cy2")))
    dx, dy = c.pixel_centre(F.col("x"))["num"] - F.col("cx2"), c.pixel_centre(F.col("y"))["num"] - F.col("cy2")
    return px.where(dx * dx + dy * dy <= 4 * F.col("r") * F.col("r")).select("p_partkey", "x", "y")


@query("""
SELECT p_partkey, x, y FROM (SELECT p_partkey, 2 * (p_partkey % 16) AS ax, 2 * (p_partkey * 3 % 16) AS ay, 2 * (p_partkey * 5 % 16) AS bx, 2 * (p_partkey * 7 % 16) AS by_ FROM part), range(16) a(x), range(16) b(y),
LATERAL (SELECT bx - ax AS dx, by_ - ay AS dy, 2 * x + 1 - ax AS px, 2 * y + 1 - ay AS py) d, LATERAL (SELECT dx * dx + dy * dy AS l, px * dx + py * dy AS t) e
WHERE CASE WHEN l = 0 OR t <= 0 THEN px * px + py * py <= 1 WHEN t >= l THEN (px - dx) * (px - dx) + (py - dy) * (py - dy) <= 1 ELSE (px * dy - py * dx) * (px * dy - py * dx) <= l END
""")
def line_cover_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels within half a unit of a segment, by the closest point clamped to its ends."""
    p = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select("p_partkey", (2 * (p % 16)).alias("ax"), (2 * (p * 3 % 16)).alias("ay"), (2 * (p * 5 % 16)).alias("bx"), (2 * (p * 7 % 16)).alias("by"))

    def span(a: str, b: str):
        low = F.greatest(c.lit(0), -c.floordiv(-(F.least(a, b) - 2), c.lit(2)))
        return F.sequence(low, F.least(c.lit(15), c.floordiv(F.greatest(a, b), c.lit(2))))

    px = t.withColumn("x", F.explode(span("ax", "bx"))).withColumn("y", F.explode(span("ay", "by")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    qx, qy = 2 * F.col("x") + 1 - F.col("ax"), 2 * F.col("y") + 1 - F.col("ay")
    length, along, cross = dx * dx + dy * dy, qx * dx + qy * dy, qx * dy - qy * dx
    near = F.when((length == 0) | (along <= 0), qx * qx + qy * qy <= 1).when(along >= length, (qx - dx) * (qx - dx) + (qy - dy) * (qy - dy) <= 1).otherwise(cross * cross <= length)
    return px.where(near).select("p_partkey", "x", "y")


# ---------------------------------------------------------------- frames, motions, cameras

_OBJECTS = "SELECT c_custkey, c_custkey % 320 AS x, c_custkey * 7 % 240 AS y, c_nationkey - 12 AS vx, c_custkey % 9 - 4 AS vy FROM customer"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (k % 320).alias("x"), (k * 7 % 240).alias("y"), (F.col("c_nationkey") - 12).cast("long").alias("vx"), (k % 9 - 4).alias("vy"), F.lit(12).alias("frame_count"))


@query(f"""
SELECT c_custkey, n AS frame, x AS fixed_x, x + vx * n AS linear_x, y + vy * n AS linear_y, 200 * (x + vx * n) + n * n AS ballistic_x200, 200 * (y + vy * n) + 3 * n * n AS ballistic_y200,
  32768 * x + 50 * {_sine_sql('o.n', '360', True)} AS circular_x, 32768 * y + 50 * {_sine_sql('o.n', '360', False)} AS circular_y, 32768 * x + 40 * {_sine_sql('o.n', '120', False)} AS oscillating_x
FROM (SELECT * FROM ({_OBJECTS}), range(12) t(n)) o
""")
def motion_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of objects at frames; ballistic in 1/200, turning motions in 1/32768."""
    t = mo.frames(mo.dealt(_objects(spark, sf_dir), "c_custkey"))
    n, x, y, vx, vy = (F.col(k) for k in ("frame", "x", "y", "vx", "vy"))
    lx, ly = x + vx * n, y + vy * n
    return t.select(
        "c_custkey", "frame", x.alias("fixed_x"), lx.alias("linear_x"), ly.alias("linear_y"), (200 * lx + n * n).alias("ballistic_x200"), (200 * ly + 3 * n * n).alias("ballistic_y200"),
        (32768 * x + 50 * c.sine(n, c.lit(360), True)).alias("circular_x"), (32768 * y + 50 * c.sine(n, c.lit(360))).alias("circular_y"), (32768 * x + 40 * c.sine(n, c.lit(120))).alias("oscillating_x"),
    )


def _step_sql(seed: str) -> str:
    """Both coordinates of a step: of its accepted draws (below 2049 of 4096) the first and the second."""
    return f"""(SELECT list(d ORDER BY k)[1:2] FROM (SELECT k, ({_mix_sql(f'({seed} + k::UHUGEINT * 11400714819323198485) % {_M}')} % 4096)::BIGINT AS d FROM range(1, 33) t(k)) WHERE d < 2049)"""


@query(f"""
SELECT n_nationkey, frame, sum(dx) OVER w AS x, sum(dy) OVER w AS y FROM (
SELECT n_nationkey, frame, CASE WHEN frame = 0 THEN 0 ELSE d[1] - 1024 END AS dx, CASE WHEN frame = 0 THEN 0 ELSE d[2] - 1024 END AS dy FROM (
SELECT n_nationkey, frame, {_step_sql('seed')} AS d FROM (SELECT n_nationkey, frame, ((n_nationkey::UHUGEINT + frame::UHUGEINT * 13787848793156543929::UHUGEINT) % {_M}) AS seed FROM nation, range(20) f(frame))))
WINDOW w AS (PARTITION BY n_nationkey ORDER BY frame ROWS UNBOUNDED PRECEDING)
""")
def walk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random walk as running sums of steps drawn independently; in 1/1024 of the step length."""
    t = mo.frames(table(spark, sf_dir, "nation").select("n_nationkey", F.lit(20).alias("frame_count")))
    t = t.withColumn("step", arrow.walk_step(F.col("n_nationkey").cast("long"), F.col("frame")))
    t = t.select("n_nationkey", "frame", *[F.when(F.col("frame") == 0, 0).otherwise(F.col(f"step.{k}")).alias(k) for k in ("dx", "dy")])
    return t.select("n_nationkey", "frame", mo.running_sum(t, "dx", ["n_nationkey"], ["frame"]).alias("x"), mo.running_sum(t, "dy", ["n_nationkey"], ["frame"]).alias("y"))


@query("""
WITH seg AS (SELECT user_id, min(event_id) AS event_id, event_id % 100 AS from_frame FROM events GROUP BY user_id, event_id % 100),
f AS (SELECT u.user_id, n AS frame FROM (SELECT DISTINCT user_id FROM events) u, range(0, 100, 7) t(n))
SELECT f.user_id, f.frame, coalesce(s.from_frame, b.from_frame) AS from_frame, coalesce(s.event_id, b.event_id) AS event_id
FROM f ASOF LEFT JOIN seg s ON f.user_id = s.user_id AND f.frame >= s.from_frame JOIN (SELECT user_id, min(from_frame) AS from_frame, arg_min(event_id, from_frame) AS event_id FROM seg GROUP BY user_id) b ON b.user_id = f.user_id
""")
def piecewise_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to the segment in force, or the first one before any has begun."""
    e = table(spark, sf_dir, "events")
    seg = e.groupBy("user_id", (F.col("event_id") % 100).alias("from_frame")).agg(F.min("event_id").alias("event_id"))
    f = e.select("user_id").distinct().withColumn("frame", F.explode(F.sequence(c.lit(0), c.lit(99), c.lit(7))))
    return mo.active_segment(f, seg, "user_id")


@query("""
SELECT c_custkey, n AS frame, o_orderkey FROM customer, range(12) t(n), orders
WHERE o_custkey = c_custkey AND n >= o_orderkey % 10 AND n < o_orderkey % 10 + o_orderkey % 5 + 1
""")
def frame_object_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of customers with the orders whose half-open span holds them."""
    f = mo.frames(table(spark, sf_dir, "customer").select("c_custkey", F.lit(12).alias("frame_count"))).select("c_custkey", "frame")
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", (k % 10).alias("start"), (k % 10 + k % 5 + 1).alias("end"))
    return mo.visible(f, o, "c_custkey").select("c_custkey", "frame", "o_orderkey")


@query(f"""
SELECT s_suppkey, n AS frame, cosv AS xx, -(-sinv) AS xy, -(cosv * px + sinv * py) AS tx, -(-sinv * px + cosv * py) AS ty, {rat('4 + least(n, 8)', '4::BIGINT')} AS zoom FROM (
SELECT s_suppkey, n, s_suppkey % 50 AS px, s_nationkey AS py, {_sine_sql('s.n', '16', True)} AS cosv, {_sine_sql('s.n', '16', False)} AS sinv FROM (SELECT * FROM supplier, range(12) t(n)) s)
""")
def camera_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera that turns a sixteenth a frame and zooms over eight; entries in 1/32768 before zoom."""
    eye = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 50).alias("px"), F.col("s_nationkey").cast("long").alias("py"), F.lit(12).alias("frame_count"))
    t = mo.frames(mo.dealt(eye, "s_suppkey"))
    n, px, py = F.col("frame"), F.col("px"), F.col("py")
    # the camera's angle is undone: cosine of the angle, and minus the sine of its negative
    xx, xy = c.sine(n, c.lit(16), True), -c.sine(-n, c.lit(16))
    zoom = c.ratio(4 + F.least(n, c.lit(8)), c.lit(4))
    return t.select("s_suppkey", "frame", xx.alias("xx"), xy.alias("xy"), (-(xx * px + xy * py)).alias("tx"), (-(-xy * px + xx * py)).alias("ty"), c.r_text(zoom).alias("zoom"))


# ---------------------------------------------------------------- rasters


@query("""
SELECT n_nationkey, x, y, CASE WHEN x // cell % 2 = y // cell % 2 THEN 200 ELSE 100 END AS checker, CASE WHEN x % cell = 0 OR y % cell = 0 THEN 100 ELSE 180 END AS grid,
  (50 * (31 - x) + 200 * x + 15) // 31 AS gradient FROM (SELECT n_nationkey, n_nationkey % 7 + 1 AS cell FROM nation), range(32) a(x), range(24) b(y)
""")
def background_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkers, grids and gradients as expressions over pixel rows."""
    t = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 7 + 1).cast("long").alias("cell"))
    t = t.withColumn("x", F.explode(F.sequence(c.lit(0), c.lit(31)))).withColumn("y", F.explode(F.sequence(c.lit(0), c.lit(23))))
    x, y, cell = F.col("x"), F.col("y"), F.col("cell")
    checker = F.when(c.div(x, cell) % 2 == c.div(y, cell) % 2, 200).otherwise(100)
    return t.select("n_nationkey", "x", "y", checker.alias("checker"), F.when((x % cell == 0) | (y % cell == 0), 100).otherwise(180).alias("grid"), c.div(50 * (31 - x) + 200 * x + 15, 31).alias("gradient"))


@query("""
SELECT x, y, arg_max(l_suppkey, k) AS colour, max(k) AS painted_by FROM (
SELECT l_partkey % 64 AS x, l_suppkey * 7 % 64 AS y, l_suppkey, l_orderkey * 8 + l_linenumber AS k FROM lineitem) GROUP BY x, y
""")
def pixel_overdraw_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all that paint a pixel the last in order shows; partial aggregation does the work."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") * 7 % 64).alias("y"), "l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"))
    return t.groupBy("x", "y").agg(F.max_by("l_suppkey", "k").alias("colour"), F.max("k").alias("painted_by"))


# ---------------------------------------------------------------- JPEG


@query("""
SELECT l_orderkey, l_linenumber, greatest(0, least(255, (77 * r + 150 * g + 29 * b + 128) >> 8)) AS y,
  greatest(0, least(255, floor((-43 * r - 85 * g + 128 * b + 128) / 256.0)::BIGINT + 128)) AS cb, greatest(0, least(255, floor((128 * r - 107 * g - 21 * b + 128) / 256.0)::BIGINT + 128)) AS cr
FROM (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, l_suppkey % 256 AS g, l_orderkey % 256 AS b FROM lineitem)
""")
def rgb_to_ycbcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour planes by weights in 256ths, shifted down (floor) and clamped."""
    y, cb, cr = c.ycbcr(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", y.alias("y"), cb.alias("cb"), cr.alias("cr"))


@query("""
SELECT k, y // 2 AS y, x // 2 AS x, (sum(v) + count(*) // 2) // count(*) AS v FROM (
SELECT o_orderkey // 195 AS k, o_orderkey % 195 // 15 AS y, o_orderkey % 15 AS x, o_custkey % 256 AS v FROM orders) GROUP BY k, y // 2, x // 2
""")
def chroma_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 2x2 boxes of 15 by 13 planes, rounded half up; edges have one or two samples."""
    o = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(c.div(o, 195).alias("k"), c.div(c.div(o % 195, 15), 2).alias("y"), c.div(o % 15, 2).alias("x"), (F.col("o_custkey") % 256).alias("v"))
    return t.groupBy("k", "y", "x").agg(c.div(F.sum("v") + c.div(F.count("*"), 2), F.count("*")).alias("v"))


def _cosines() -> list[tuple[int, int, int]]:
    from framewright.functions.jpeg import COSINES

    return [(u, x, int(COSINES[u, x])) for u in range(8) for x in range(8)]


_SAMPLES = """SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, greatest(0, least(255, floor(embedding[i]::DOUBLE * 128)::BIGINT + 128)) - 128 AS s FROM embeddings, range(1, 65) t(i)"""


def _dct_sql() -> str:
    values = ", ".join(str(t) for t in _cosines())
    from framewright.functions.jpeg import LUMA_STEPS, ZIGZAG

    zig = ", ".join(f"({int(r)}, {k})" for k, r in enumerate(ZIGZAG))
    step = ", ".join(f"({i}, {max(1, min(255, (q * 50 + 50) // 100))})" for i, q in enumerate(LUMA_STEPS))
    return f"""
WITH cosines(u, x, c) AS (VALUES {values}), zig(r, k) AS (VALUES {zig}), step(r, q) AS (VALUES {step}), s AS ({_SAMPLES}),
a AS (SELECT vec_id, y, u, sum(s * c)::BIGINT AS t FROM s JOIN cosines USING (x) GROUP BY vec_id, y, u),
d AS (SELECT vec_id, v.u AS v, a.u AS u, sum(t * c)::BIGINT AS t FROM a JOIN cosines v ON v.x = a.y GROUP BY vec_id, v.u, a.u),
f AS (SELECT vec_id, v * 8 + u AS r, sign(t)::BIGINT * (abs(t) // CASE WHEN u = 0 AND v = 0 THEN 34359738368 WHEN u = 0 OR v = 0 THEN 24296030208 ELSE 17179869184 END) AS coef FROM d)
SELECT vec_id, k, coef, sign(coef)::BIGINT * ((abs(coef) + (q >> 1)) // q) AS level FROM f JOIN zig USING (r) JOIN step USING (r)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, k, coef, level): blocks of 8 by 8 samples transformed, quantised and put in zigzag order."""
    import numpy as np
    import pandas as pd

    from framewright.functions import jpeg

    sample = F.transform("embedding", lambda e: F.greatest(c.lit(0), F.least(c.lit(255), F.floor(e.cast("double") * 128) + 128)) - 128)
    blocks = table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", sample.alias("s"))

    def transform(batches):
        # one matrix product for a batch of blocks
        for pdf in batches:
            x = np.stack(pdf["s"].to_numpy()).reshape(-1, 8, 8) if len(pdf) else np.zeros((0, 8, 8), np.int64)
            coef = jpeg.forward_dct(x)
            level = jpeg.half_away(coef, jpeg.steps(75, False).reshape(8, 8))
            n = len(pdf)
            yield pd.DataFrame({"vec_id": np.repeat(pdf["vec_id"].to_numpy(), 64), "k": np.tile(np.arange(64), n), "coef": coef.reshape(n, 64)[:, jpeg.ZIGZAG].ravel(), "level": level.reshape(n, 64)[:, jpeg.ZIGZAG].ravel()})

    return blocks.mapInPandas(transform, "vec_id long, k long, coef long, level long")


@query(_dct_sql())
def block_dct_quant_zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integer transform, truncated; levels rounded half away; zigzag order."""
    return _levels(spark, sf_dir)


@query(f"""
WITH RECURSIVE l AS MATERIALIZED (SELECT vec_id, vec_id // 64 AS scan, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) AS i, greatest(-32768, least(32767, level * 300)) AS v FROM ({_dct_sql().strip()}) WHERE k = 0),
f(scan, i, vec_id, predictor, delta) AS (SELECT scan, i, vec_id, greatest(-2047, least(2047, v)), greatest(-2047, least(2047, v)) FROM l WHERE i = 1
  UNION ALL SELECT l.scan, l.i, l.vec_id, f.predictor + greatest(-2047, least(2047, l.v - f.predictor)), greatest(-2047, least(2047, l.v - f.predictor)) FROM f JOIN l ON l.scan = f.scan AND l.i = f.i + 1)
SELECT scan, vec_id, delta::BIGINT AS delta FROM f
""")
def dc_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of mean levels (made large, so that some are clamped) in scans of up to 64 blocks, whatever ids are missing."""
    from framewright.operators import entropy

    dc = _levels(spark, sf_dir).where("k = 0").select(c.div(F.col("vec_id"), 64).alias("scan"), "vec_id", (F.col("level") * 300).alias("level"))
    return entropy.dc_deltas(dc, "scan", "vec_id")


@query(f"""
WITH l AS MATERIALIZED (SELECT vec_id, k, CASE WHEN abs(level) * 2 > vec_id % 40 THEN level ELSE 0 END AS level FROM ({_dct_sql().strip()})),
n AS MATERIALIZED (SELECT *, k - 1 - coalesce(lag(k) OVER (PARTITION BY vec_id ORDER BY k), 0) AS run, greatest(-1023, least(1023, level)) AS v FROM l WHERE k > 0 AND level <> 0)
SELECT vec_id, k::BIGINT AS k, part::BIGINT AS part, 240::BIGINT AS symbol, 0::BIGINT AS size, 0::BIGINT AS bits FROM n, range(4) t(part) WHERE part < run // 16
UNION ALL SELECT vec_id, k, run // 16, run % 16 * 16 + length(bin(abs(v))), length(bin(abs(v))), CASE WHEN v > 0 THEN v ELSE v + (1 << length(bin(abs(v)))) - 1 END FROM n
UNION ALL SELECT vec_id, 64, 0, 0, 0, 0 FROM l GROUP BY vec_id HAVING coalesce(max(CASE WHEN k > 0 AND level <> 0 THEN k END), 0) < 63
""")
def ac_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of runs, sixteen zeros and the end of a block, on levels of which the small ones are left out."""
    from framewright.operators import entropy

    kept = F.when(F.abs("level") * 2 > F.col("vec_id") % 40, F.col("level")).otherwise(c.lit(0))
    return entropy.ac_symbols(_levels(spark, sf_dir).select("vec_id", "k", kept.alias("level")), "vec_id")


@query(f"""
SELECT vec_id, k, level, k - 1 - coalesce(lag(k) OVER (PARTITION BY vec_id ORDER BY k), 0) AS run, length(bin(abs(greatest(-1023, least(1023, level))))) AS size,
  CASE WHEN level > 0 THEN least(1023, level) ELSE greatest(-1023, level) + (1 << length(bin(abs(greatest(-1023, level))))) - 1 END AS bits
FROM ({_dct_sql().strip()}) WHERE k > 0 AND level <> 0
""")
def ac_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero runs before each level that is not zero, its size category and its bits."""
    w = Window.partitionBy("vec_id").orderBy("k")
    t = _levels(spark, sf_dir).where("k > 0 and level <> 0")
    v = F.greatest(c.lit(-1023), F.least(c.lit(1023), F.col("level")))
    size = F.length(F.bin(F.abs(v))).cast("long")
    bits = F.when(v > 0, v).otherwise(v + F.expr("shiftleft(1L, length(bin(abs(greatest(-1023L, level)))))") - 1)
    return t.select("vec_id", "k", "level", (F.col("k") - 1 - F.coalesce(F.lag("k").over(w), c.lit(0))).alias("run"), size.alias("size"), bits.alias("bits"))


def _tables() -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
    from framewright.functions import jpeg

    return [("dc0", jpeg.DC_LENGTHS[0], jpeg.DC_SYMBOLS), ("dc1", jpeg.DC_LENGTHS[1], jpeg.DC_SYMBOLS), ("ac0", jpeg.AC_LENGTHS[0], jpeg.AC_SYMBOLS[0]), ("ac1", jpeg.AC_LENGTHS[1], jpeg.AC_SYMBOLS[1])]


def _huffman_sql() -> str:
    lens = ", ".join(f"('{t}', {n}, {many})" for t, lengths, _ in _tables() for n, many in enumerate(lengths, 1))
    symbols = ", ".join(f"('{t}', {i}, {v})" for t, _, values in _tables() for i, v in enumerate(values))
    return f"""
WITH RECURSIVE lens(tab, n, many) AS (VALUES {lens}), symbols(tab, i, symbol) AS (VALUES {symbols}),
firsts(tab, n, code, before) AS (SELECT DISTINCT tab, 1, 0, 0 FROM lens UNION ALL SELECT f.tab, f.n + 1, (f.code + l.many) * 2, f.before + l.many FROM firsts f JOIN lens l ON l.n = f.n AND l.tab = f.tab WHERE f.n < 16)
SELECT f.tab, s.symbol::BIGINT AS symbol, (f.code + s.i - f.before)::BIGINT AS code, f.n::BIGINT AS length FROM firsts f JOIN lens l USING (tab, n) JOIN symbols s ON s.tab = f.tab AND s.i >= f.before AND s.i < f.before + l.many"""


@query(_huffman_sql())
def huffman_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical codes of all four tables from their counts of code lengths."""
    from framewright.functions import jpeg

    rows = [(t, s, code, n) for t, lengths, symbols in _tables() for s, (code, n) in jpeg.codes(lengths, symbols).items()]
    return spark.createDataFrame(rows, "tab string, symbol long, code long, length long")


def _cells() -> list[tuple[int, int, int]]:
    from framewright.functions import jpeg

    return [(k, r, int(s)) for k, steps in enumerate((jpeg.LUMA_STEPS, jpeg.CHROMA_STEPS)) for r, s in enumerate(steps)]


@query(f"""
SELECT q, kind, r, greatest(1, least(255, (s * CASE WHEN q >= 100 THEN 2 WHEN q < 50 THEN least(256, 5000 // q) ELSE 200 - 2 * q END + 50) // 100)) AS step
FROM range(1, 101) a(q), (VALUES {", ".join(map(str, _cells()))}) t(kind, r, s)
""")
def quant_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiser steps of all cells of both tables at all qualities, by the coder's own function."""
    from framewright.functions import jpeg

    rows = [(q, kind, r, int(step)) for q in range(1, 101) for kind in (0, 1) for r, step in enumerate(jpeg.steps(q, bool(kind)))]
    return spark.createDataFrame(rows, "q long, kind int, r int, step long")


# ---------------------------------------------------------------- bytes and containers


@query("""
SELECT doc_id, size, sum(size) OVER w - size + 48 AS frame_offset, total, total <= 4294967295 AS fits FROM (
SELECT doc_id, doc_id // 100 AS grp, octet_length(encode(text)) AS size, sum(octet_length(encode(text))) OVER (PARTITION BY doc_id // 100)::BIGINT AS total FROM documents)
WINDOW w AS (PARTITION BY grp ORDER BY doc_id ROWS UNBOUNDED PRECEDING)
""")
def sample_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk offsets as running sums of sample sizes, and the payload's 32-bit check."""
    d = table(spark, sf_dir, "documents").select("doc_id", c.div(F.col("doc_id"), 100).alias("grp"), F.octet_length("text").cast("long").alias("size"))
    total = F.sum("size").over(Window.partitionBy("grp"))
    return d.select("doc_id", "size", (mo.running_sum(d, "size", ["grp"], ["doc_id"], exclusive=True) + 48).alias("frame_offset"), total.alias("total"), (total <= 4294967295).alias("fits"))


@query("""
SELECT o_orderkey, lower(lpad(to_hex(o_orderkey), 8, '0')) AS be, regexp_replace(lower(lpad(to_hex(o_orderkey), 8, '0')), '^(..)(..)(..)(..)$', '\\4\\3\\2\\1') AS le,
  CASE WHEN o_custkey % 3 = 0 THEN 'avi' WHEN o_orderkey BETWEEN 8 AND 4096 THEN 'iso' ELSE 'neither' END AS format FROM orders
""")
def u32_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit fields in both orders; formats told by the first bytes of a 4096-byte file."""
    k = F.col("o_orderkey")
    head = F.unhex(F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("52494646"), c.hex_u32(k), F.lit("41564920"))).otherwise(F.concat(c.hex_u32(k), F.lit("66747970"), F.lit("69736f6d"))))
    size = F.conv(F.hex(F.substring("head", 1, 4)), 16, 10).cast("long")
    iso = size.between(8, 4096)
    avi = (F.hex(F.substring("head", 1, 4)) == "52494646") & (F.hex(F.substring("head", 9, 4)) == "41564920")
    return table(spark, sf_dir, "orders").withColumn("head", head).select("o_orderkey", c.hex_u32(k).alias("be"), c.hex_u32(k, little=True).alias("le"), F.when(iso, "iso").when(avi, "avi").otherwise("neither").alias("format"))


@query("""
SELECT doc_id, md5(h[:2 * cut]) AS truncated, CASE WHEN n >= 12 THEN md5(h[:16] || '00000008' || h[25:]) END AS overwritten, CASE WHEN n >= 16 THEN md5(h || h[17:32]) END AS duplicated,
  CASE WHEN n >= 24 THEN md5(h[:16] || h[33:48] || h[17:32] || h[49:]) END AS swapped FROM (SELECT doc_id, lower(hex(encode(text))) AS h, octet_length(encode(text)) AS n, least(octet_length(encode(text)), doc_id % 50 + 1) AS cut FROM documents)
""")
def fault_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D15 where offsets are known: cutting, overwriting, copying and swapping bytes; null where a text is too short for a fault."""
    d = table(spark, sf_dir, "documents")
    h = F.lower(F.hex(F.encode("text", "utf-8")))
    d = d.select("doc_id", h.alias("h"), F.octet_length("text").alias("n"), F.least(F.octet_length("text"), F.col("doc_id") % 50 + 1).cast("int").alias("cut"))
    part = lambda a, n: F.col("h").substr(F.lit(a), F.lit(n))
    rest = 2**31 - 1
    held = lambda n, x: F.when(F.col("n") >= n, F.md5(x))
    return d.select(
        "doc_id", F.md5(F.col("h").substr(F.lit(1), 2 * F.col("cut"))).alias("truncated"), held(12, F.concat(part(1, 16), F.lit("00000008"), part(25, rest))).alias("overwritten"),
        held(16, F.concat("h", part(17, 16))).alias("duplicated"), held(24, F.concat(part(1, 16), part(33, 16), part(17, 16), part(49, rest))).alias("swapped"),
    )


@query("""
SELECT turn, w, (list_transform([a, b, 0, c, d, 0, x, y], lambda v: CASE WHEN v < 0 THEN 4294967296 + v * 65536 ELSE v * 65536 END))::VARCHAR AS words FROM (
SELECT p_partkey AS w, turn, a, b, c, d, CASE kx WHEN 'h' THEN p_size WHEN 'w' THEN p_partkey ELSE 0 END AS x, CASE ky WHEN 'h' THEN p_size WHEN 'w' THEN p_partkey ELSE 0 END AS y FROM part,
(VALUES ('identity', 1, 0, 0, 1, '', ''), ('rot90', 0, 1, -1, 0, 'h', ''), ('rot180', -1, 0, 0, -1, 'w', 'h'), ('rot270', 0, -1, 1, 0, '', 'w')) t(turn, a, b, c, d, kx, ky))
""")
def track_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-point matrices of the four display turns, as unsigned words."""
    turns = spark.createDataFrame([("identity", 1, 0, 0, 1, "", ""), ("rot90", 0, 1, -1, 0, "h", ""), ("rot180", -1, 0, 0, -1, "w", "h"), ("rot270", 0, -1, 1, 0, "", "w")], "turn string, a long, b long, c long, d long, kx string, ky string")
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("w"), F.col("p_size").cast("long").alias("h")).join(F.broadcast(turns))
    move = lambda k: F.when(F.col(k) == "h", F.col("h")).when(F.col(k) == "w", F.col("w")).otherwise(c.lit(0))
    nine = F.array("a", "b", c.lit(0), "c", "d", c.lit(0), move("kx"), move("ky"))
    words = F.transform(nine, lambda v: F.when(v < 0, v * 65536 + 4294967296).otherwise(v * 65536).cast("string"))
    return t.select("turn", "w", F.concat(F.lit("["), F.array_join(words, ", "), F.lit("]")).alias("words"))


# ---------------------------------------------------------------- digests, lockfiles, verification

_FILES = "SELECT 'doc-' || doc_id || '.txt' AS name, sha256(text) AS digest, octet_length(encode(text)) AS length FROM documents"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").alias("content"))
    return lk.digests(d)


@query(f"SELECT name || ' ' || digest || ' ' || length AS line FROM ({_FILES}) ORDER BY name")
def lockfile_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and lengths of artifacts as lockfile lines in bytewise order of name."""
    return lk.lockfile_lines(_files(spark, sf_dir))


@query(f"""SELECT sha256(string_agg(name || ' ' || digest || ' ' || length || chr(10), '' ORDER BY name)) AS digest, count(*) AS n FROM ({_FILES})""")
def lockfile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2, O3: the lines concatenated in order, and the digest of the file they make."""
    return lk.lockfile_digest(_files(spark, sf_dir))


_LINES = """SELECT CASE doc_id % 7 WHEN 0 THEN 'doc ' || doc_id || '.txt' || digest WHEN 1 THEN 'Doc_' || doc_id || '.txt ' || digest || ' 7' WHEN 2 THEN 'doc-1.txt ' || upper(digest) || ' 7'
  WHEN 3 THEN 'doc-1.txt ' || digest || ' 18446744073709551616' WHEN 4 THEN '  ' ELSE 'doc-' || doc_id || '.txt ' || digest || ' ' || doc_id END AS line FROM (SELECT doc_id, sha256(text || '!') AS digest FROM documents)"""


@query(f"""
SELECT line, CASE WHEN len(p) <> 3 THEN 'fields' WHEN NOT regexp_matches(p[1], '^[a-z0-9-]+\\.[a-z0-9]+$') THEN 'name' WHEN NOT regexp_matches(p[2], '^[0-9a-f]{{64}}$') THEN 'digest'
  WHEN NOT regexp_matches(p[3], '^[0-9]+$') OR try_cast(p[3] AS UBIGINT) IS NULL THEN 'length' END AS error FROM (SELECT line, string_split(line, ' ') AS p FROM ({_LINES}) WHERE trim(line) <> '')
""")
def lockfile_parse_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines checked field by field; blank lines dropped."""
    d, digest = F.col("doc_id"), F.sha2(F.concat("text", F.lit("!")), 256)
    text = lambda *x: F.concat(*[y.cast("string") if not isinstance(y, str) else F.lit(y) for y in x])
    line = (
        F.when(d % 7 == 0, text("doc ", d, ".txt", digest)).when(d % 7 == 1, text("Doc_", d, ".txt ", digest, " 7")).when(d % 7 == 2, text("doc-1.txt ", F.upper(digest), " 7"))
        .when(d % 7 == 3, text("doc-1.txt ", digest, " 18446744073709551616")).when(d % 7 == 4, F.lit("  ")).otherwise(text("doc-", d, ".txt ", digest, " ", d))
    )
    return lk.parse_lines(table(spark, sf_dir, "documents").select(line.alias("line"))).select("line", "error")


_ACTUAL = f"""SELECT CASE WHEN i % 11 = 3 THEN 'new-' || name ELSE name END AS name, CASE WHEN i % 13 = 5 THEN sha256(digest) ELSE digest END AS digest, CASE WHEN i % 17 = 2 THEN length + 1 ELSE length END AS length
FROM (SELECT *, length AS i FROM ({_FILES})) WHERE i % 19 <> 4"""


def _actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, f = F.col("length"), _files(spark, sf_dir)
    return f.where(i % 19 != 4).select(F.when(i % 11 == 3, F.concat(F.lit("new-"), F.col("name"))).otherwise(F.col("name")).alias("name"), F.when(i % 13 == 5, F.sha2("digest", 256)).otherwise(F.col("digest")).alias("digest"), F.when(i % 17 == 2, i + 1).otherwise(i).alias("length"))


_DIFF = f"""SELECT u.kind, coalesce(e.name, a.name) AS name, CASE u.kind WHEN 'digest' THEN e.digest WHEN 'length' THEN e.length::VARCHAR END AS expected, CASE u.kind WHEN 'digest' THEN a.digest WHEN 'length' THEN a.length::VARCHAR END AS actual
FROM ({_FILES}) e FULL OUTER JOIN ({_ACTUAL}) a ON e.name = a.name, (VALUES ('missing'), ('extra'), ('digest'), ('length')) u(kind)
WHERE CASE u.kind WHEN 'missing' THEN a.name IS NULL WHEN 'extra' THEN e.name IS NULL WHEN 'digest' THEN e.digest <> a.digest ELSE e.length <> a.length END"""


@query(_DIFF)
def lockfile_verify_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between an expected and an actual corpus."""
    return lk.differences(_files(spark, sf_dir), _actual(spark, sf_dir)).drop("ord")


@query(f"""SELECT (SELECT count(*) FROM ({_FILES})) AS verified, (SELECT count(*) FROM ({_FILES})) - count(DISTINCT name) AS matched, count(DISTINCT name) AS failed FROM ({_DIFF}) WHERE kind <> 'extra'""")
def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of names verified, matched and failed."""
    e = _files(spark, sf_dir)
    return lk.summary(e, lk.differences(e, _actual(spark, sf_dir)))


@query("SELECT sha256(text) AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand more than once."""
    return lk.duplicate_names(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("name")))


# ---------------------------------------------------------------- the catalogue


def _axis_case(sql: str, values: tuple) -> str:
    return f"CASE {sql} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_AX = ct.AXES
_NAME_SQL = f"""SELECT o_orderkey, printf('%04dx%04d', w::BIGINT, h::BIGINT) || '-' || n || '-' || r || '-' || bg || '-' || sh || '-' || m || '-' || cod || '-' || con || '-' || tm || '-' || sc || '-' || de AS name, con FROM (
SELECT o_orderkey, (o_orderkey * 13 % 1920 + 1) AS w, (o_orderkey * 7 % 1080 + 1) AS h, o_custkey % 100 + 1 AS n, {_axis_case('o_orderkey % 6', _AX['rate'])} AS r, {_axis_case('o_orderkey % 5', _AX['background'])} AS bg, {_axis_case('o_orderkey % 4', _AX['shape'])} AS sh,
{_axis_case('o_custkey % 6', _AX['motion'])} AS m, {_axis_case('o_custkey % 2', _AX['coding'])} AS cod, {_axis_case('o_orderkey % 2', _AX['container'])} AS con, {_axis_case('o_custkey % 4', _AX['track_matrix'])} AS tm, {_axis_case('o_orderkey // 2 % 2', _AX['scale'])} AS sc, {_axis_case('o_orderkey % 17', _AX['defect'])} AS de FROM orders)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda x, axis: F.get(F.array(*[F.lit(v) for v in _AX[axis]]), x.cast("int"))
    size = F.format_string("%04dx%04d", o * 13 % 1920 + 1, o * 7 % 1080 + 1)
    parts = [pick(o % 6, "rate"), pick(o % 5, "background"), pick(o % 4, "shape"), pick(k % 6, "motion"), pick(k % 2, "coding"), pick(o % 2, "container"), pick(k % 4, "track_matrix"), pick(c.div(o, 2) % 2, "scale"), pick(o % 17, "defect")]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("-", size, (k % 100 + 1).cast("string"), *parts).alias("name"), pick(o % 2, "container").alias("con"))


@query(f"SELECT o_orderkey, name, name || '-media.' || CASE con WHEN 'iso' THEN 'mp4' ELSE 'avi' END AS media FROM ({_NAME_SQL})")
def entry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of entries and of their media."""
    media = F.concat("name", F.lit("-media."), F.when(F.col("con") == "iso", "mp4").otherwise("avi"))
    return _names(spark, sf_dir).select("o_orderkey", "name", media.alias("media"))


@query(f"""SELECT o_orderkey, file, CASE WHEN file LIKE '%.json' THEN regexp_replace(file, '\\.json$', '') ELSE nullif(regexp_extract(file, '^(.*)-media\\.', 1), '') END AS entry
FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN name || '.json' WHEN 1 THEN name || '-media.mp4' ELSE name END AS file FROM ({_NAME_SQL}))""")
def entry_name_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z3: the entry that a lockfile name belongs to."""
    file = F.when(F.col("o_orderkey") % 3 == 0, F.concat("name", F.lit(".json"))).when(F.col("o_orderkey") % 3 == 1, F.concat("name", F.lit("-media.mp4"))).otherwise(F.col("name"))
    entry = F.when(F.col("file").endswith(".json"), F.regexp_replace("file", r"\.json$", "")).otherwise(F.nullif(F.regexp_extract("file", r"^(.*)-media\.", 1), F.lit("")))
    return _names(spark, sf_dir).select("o_orderkey", file.alias("file")).withColumn("entry", entry)


@query(f"WITH n AS (SELECT o_orderkey, name FROM ({_NAME_SQL})) SELECT o_orderkey, name FROM n WHERE name IN (SELECT name FROM n WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49))")
def selected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries asked for, by a semi-join."""
    names = _names(spark, sf_dir).select("o_orderkey", "name")
    want = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")).join(names, "o_orderkey")
    return co.select_entries(names, want, strict=True)


_PAIRS = "WITH axes(axis, size) AS (VALUES " + ", ".join(f"({i}, {n})" for i, n in enumerate(ct.SIZES)) + """),
v AS (SELECT axis, i AS value FROM axes, range(20) t(i) WHERE i < size),
px(i, n) AS (VALUES (0, 256), (1, 76800), (2, 307200), (3, 921600), (4, 2073600)), fr(j, n) AS (VALUES (0, 1), (1, 10), (2, 100), (3, 1000), (4, 20000)),
need(j, box) AS (VALUES """ + ", ".join(f"({j}, {_AX['container'].index(n)})" for j, n in enumerate(ct.NEEDS) if n) + """)
SELECT a.axis AS axis_a, a.value::INTEGER AS value_a, b.axis AS axis_b, b.value::INTEGER AS value_b FROM v a JOIN v b ON a.axis < b.axis
WHERE NOT (a.axis = 0 AND b.axis = 1 AND (SELECT px.n::BIGINT FROM px WHERE px.i = a.value) * (SELECT fr.n FROM fr WHERE fr.j = b.value) > 10000000)
AND NOT (a.axis = 7 AND b.axis = 10 AND EXISTS (SELECT 1 FROM need WHERE need.j = b.value AND need.box <> a.value))"""


@query(_PAIRS)
def pair_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of axis values to cover."""
    return ct.pair_obligations(spark)


def _covering(spark: SparkSession) -> list[tuple[int, ...]]:
    return ct.covering_array([tuple(r) for r in ct.pair_obligations(spark).collect()])  # 1419 pairs of literals


@query(f"SELECT count(*) AS pairs, count(*) AS covered, 127::BIGINT AS entries FROM ({_PAIRS})")
def covered_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs there are, and how many of them a row of the covering array has: all."""
    array = _covering(spark)
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(array)], "row int, " + ", ".join(f"a{i} int" for i in range(len(ct.NAMES))))
    cells = rows.select("row", F.posexplode(F.array(*[f"a{i}" for i in range(len(ct.NAMES))])).alias("axis", "value"))
    a, b = cells.toDF("row", "axis_a", "value_a"), cells.toDF("row", "axis_b", "value_b")
    have = a.join(b, "row").where("axis_a < axis_b").drop("row").distinct().withColumn("have", F.lit(1))
    pairs = ct.pair_obligations(spark).join(have, ["axis_a", "value_a", "axis_b", "value_b"], "left")
    return pairs.agg(F.count("*").alias("pairs"), F.count("have").alias("covered")).withColumn("entries", c.lit(len(array)))


@query("SELECT ord::INTEGER AS ord, name FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES)) + ") t(ord, name)")
def covering_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's entries in order: the array, two single entries, nine with capture rates."""
    return co.catalogue(spark).select("ord", "name")


@query("SELECT n_nationkey, '{\"index\":' || n_nationkey || ',\"name\":\"n-' || n_nationkey || '\",\"objects\":[' || string_agg('{\"index\":' || i || ',\"on_screen\":{\"den\":' || (i + 1) || ',\"num\":1}}', ',' ORDER BY i) || ']}' AS json FROM nation, range(3) t(i) GROUP BY n_nationkey")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows as JSON without white space, keys in byte order, arrays in index order."""
    t = table(spark, sf_dir, "nation").withColumn("i", F.explode(F.sequence(c.lit(0), c.lit(2))))
    one = F.struct(F.col("i").alias("index"), F.struct((F.col("i") + 1).alias("den"), c.lit(1).alias("num")).alias("on_screen"))
    n = t.groupBy("n_nationkey").agg(F.array_sort(F.collect_list(one), lambda a, b: (a["index"] - b["index"]).cast("int")).alias("objects"))
    return n.select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("index"), F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("name"), "objects")).alias("json"))


GOLDEN = (
    "0016x0016-10-60fps-checker-rect-linear-mjpeg-avi-rot90-unscaled-trunc-before",
    "0016x0016-10-ntsc-gradient-polygon-fixed-raw-iso-rot270-unscaled-reorder",
    "0320x0240-10-30fps-grid-cross-linear-mjpeg-iso-rot180-scaled-dup-box",
    "0016x0016-1-30fps-gradient-disc-fixed-raw-iso-rot180-scaled-zero-fps",
)


@query("""SELECT name, digest, length FROM (VALUES
('0016x0016-10-60fps-checker-rect-linear-mjpeg-avi-rot90-unscaled-trunc-before.json', 'bd9419358c2218049e88ca8ea0987ced463534ea1d0db9c36314bef5daae3c18', 4231),
('0016x0016-10-60fps-checker-rect-linear-mjpeg-avi-rot90-unscaled-trunc-before-media.avi', 'a7a9ef428a03c7f34b0be2d622afe37cf1898d871de3970d44d1af2f9f422167', 212),
('0016x0016-10-ntsc-gradient-polygon-fixed-raw-iso-rot270-unscaled-reorder.json', '45e6a9fe7be0bb352ac7f7ec3460dca5dcf3576af973817535805630fa3587c1', 4253),
('0016x0016-10-ntsc-gradient-polygon-fixed-raw-iso-rot270-unscaled-reorder-media.mp4', 'a3b0fc24629da5fad7d776ce58d7d3e1619072385a84d0f67ca7ce5c70472fa7', 8350),
('0320x0240-10-30fps-grid-cross-linear-mjpeg-iso-rot180-scaled-dup-box.json', '6bcaedba7ac92261afd841376c1feb984f6ae1d76288515ec5362bdac94e1840', 4913),
('0320x0240-10-30fps-grid-cross-linear-mjpeg-iso-rot180-scaled-dup-box-media.mp4', 'f0200ae32c2a7287b8764d81f9b22ebc48f585c3d0cc1fc0c0bbb0df1fedc0f4', 95005),
('0016x0016-1-30fps-gradient-disc-fixed-raw-iso-rot180-scaled-zero-fps.json', 'e52713819ed859efd82877cb39b047d0e07547f1e3b6d7e95f6448d9d9abff6c', 770),
('0016x0016-1-30fps-gradient-disc-fixed-raw-iso-rot180-scaled-zero-fps-media.mp4', 'c206d384d6b32232ebcb4d40944f3b9f9524bef0b3786391fb5843a51a5f3eab', 1366)) t(name, digest, length)""")
def golden_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole entries, from name to digests, against frozen ones."""
    from framewright.plans.corpus import parse_name

    rows = [(n, parse_name(n)["frame_count"]) for n in GOLDEN]
    return co.artifacts(spark.createDataFrame(rows, "name string, frame_count long"))


@query()
def catalogue_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all entries, made again from names."""
    return co.artifacts(co.catalogue(spark))


from framewright import engine_queries  # noqa: E402, F401  registers queries that call the engine on small files and shapes
