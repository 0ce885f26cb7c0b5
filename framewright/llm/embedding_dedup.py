"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are turned into the axes of a PCA, most variance first, which keeps all products.  Rows of
one label are dealt to tiles along the first axis; each pair of tiles that can hold a link is
compared by one task.  A tile pair accumulates products over leading dimensions first; norms of the
suffixes bound what the rest can add, and rows that cannot reach the threshold with any partner are
left out of the next block.  Pairs that survive are decided on the original vectors in double
precision.  Equal vectors are compared once and weighted.  A task returns link counts per row and a
spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import connected_components, stored

TILE = 1024
UNIT = 8 * TILE  # rows of one side of a task: each is sent once for every unit in reach
BLOCK = 8
SLACK = 1e-6  # of the rotated products, far above their rounding


def pca_axes(sample: np.ndarray) -> np.ndarray:
    """Orthonormal axes, largest second moment first; the identity without rows."""
    dim = sample.shape[1]
    if not len(sample):
        return np.eye(dim)
    _, axes = np.linalg.eigh(sample.T @ sample)
    return np.ascontiguousarray(axes[:, ::-1])


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with ``a[i] . b[j] >= threshold`` up to SLACK, for rotated unit rows.

    Products of leading blocks are accumulated; after each, the product of suffix norms bounds the
    rest, and rows without any partner left are dropped.
    """
    dim = a.shape[1]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    total = np.zeros((len(a), len(b)))
    at = 0
    while len(rows) and len(cols) and at < dim:
        end = min(dim, at + block)
        total += a[rows, at:end] @ b[cols, at:end].T
        if end < dim:
            room = np.sqrt(np.maximum((a[rows, end:] ** 2).sum(1), 0))[:, None] * np.sqrt(np.maximum((b[cols, end:] ** 2).sum(1), 0))
            alive = total + room >= threshold - SLACK
            keep_r, keep_c = alive.any(1), alive.any(0)
            rows, cols = rows[keep_r], cols[keep_c]
            total = total[np.ix_(keep_r, keep_c)]
        at, block = end, block * 2
    i, j = np.nonzero(total >= threshold - SLACK)
    return rows[i], cols[j]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def lowest_linked(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels, each the lowest row reached so far, after the links p-q: whole arrays at a time, until nothing changes."""
    label = label.copy()
    while True:
        a, b = label[p], label[q]
        open_ = a != b
        if not open_.any():
            return label
        p, q, a, b = p[open_], q[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        # the labels themselves are joined, then every row takes its label's label
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(further := label[label], label):
            label = further


def _compare(threshold: float, axes: dict[int, np.ndarray]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair of tiles: (vec, links, up); ``up`` is a linked vector nearer to the forest's root, or null."""
        pdf = pdf.sort_values("vec", kind="stable")
        x = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        turned = unit @ axes[x.shape[1]]
        vec, weight = pdf["vec"].to_numpy(), pdf["copies"].to_numpy()
        left = np.flatnonzero(pdf["side"].to_numpy() == 0)
        same = bool((pdf["side"] == 0).all())
        right = left if same else np.flatnonzero(pdf["side"].to_numpy() == 1)
        links = np.zeros(len(vec), np.int64)
        label = np.arange(len(vec))  # rows are in order of vec within a side: see lowest_linked
        for lo in range(0, len(left), TILE):
            for ro in range(lo if same else 0, len(right), TILE):
                l_rows, r_rows = left[lo : lo + TILE], right[ro : ro + TILE]
                i, j = tile_links(turned[l_rows], turned[r_rows], threshold)
                i, j = l_rows[i], r_rows[j]
                if same:
                    i, j = i[i < j], j[i < j]
                for k in range(0, len(i), 200_000):
                    p, q = i[k : k + 200_000], j[k : k + 200_000]
                    ok = cosines(x[p], x[q]) >= threshold
                    p, q = p[ok], q[ok]
                    np.add.at(links, p, weight[q])
                    np.add.at(links, q, weight[p])
                    label = lowest_linked(label, p, q)
        up = vec[label]
        out = pd.DataFrame({"vec": vec, "links": links, "up": up})
        return out[out["links"] > 0]

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, sample_rows: int = 4000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
    label or id, link with nothing; vectors of different lengths do not link.  Repeated rows with
    one vec_id count as separate vectors with that id.  ``sample_rows`` bounds the rows that the PCA
    is fitted on; the axes only order the work, the result does not depend on them.  Cosines of exactly
    ``threshold`` link.  Further columns are not carried; the table may be empty.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    fine = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & (norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.lit(False))
    marked = v.withColumn("fine", fine)
    # equal vectors of a label are one class, represented by its smallest id
    good = marked.where("fine").select("vec_id", "label", "embedding", F.size("embedding").alias("dim"))
    classes = stored(good.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies")), "embedding-classes")
    # the first axis bounds a link: unit vectors with cosine c are at most sqrt(2 - 2c) apart on it
    dims = [r[0] for r in classes.select("dim").distinct().collect()]
    axes = {}
    for d in dims:
        rows = classes.where(F.col("dim") == d).orderBy(F.xxhash64("vec")).limit(sample_rows).select("embedding").toPandas()["embedding"]
        x = np.stack(rows.to_numpy()).astype(np.float64)
        axes[d] = pca_axes(x / np.sqrt((x * x).sum(1))[:, None])
    if not dims:
        return marked.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b["dim"].to_numpy()
            flat, ends = b["embedding"].flatten().to_numpy(), np.cumsum(dim)
            first = np.zeros(len(dim))
            for d in np.unique(dim):
                rows = np.flatnonzero(dim == d)
                x = flat[(ends[rows] - d)[:, None] + np.arange(d)]
                first[rows] = x @ axes[int(d)][:, 0] / np.sqrt((x * x).sum(1))
            yield pa.RecordBatch.from_arrays([b["label"].cast(pa.string()), b["dim"], b["vec"], b["copies"], b["embedding"], pa.array(first, pa.float64())], ["label", "dim", "vec", "copies", "embedding", "first"])

    flat = classes.mapInArrow(project, "label string, dim int, vec long, copies long, embedding array<double>, first double")
    flat = stored(flat, "embedding-flat")
    # tiles of about TILE rows per label, cut at quantiles of the first axis over all its rows
    cuts = flat.groupBy("label", "dim").agg(F.count("*").alias("rows"), F.percentile_approx("first", [i / 64 for i in range(1, 65)], 10000).alias("q"))
    steps = F.greatest(F.lit(1), F.least(F.lit(64), F.ceil(F.col("rows") / TILE)))
    cuts = cuts.select("label", "dim", steps.cast("int").alias("tiles"), "q").selectExpr("label", "dim", "tiles", "transform(sequence(1, tiles), i -> q[cast(ceil(i * 64 / tiles) as int) - 1]) as ends")
    placed = flat.join(cuts, ["label", "dim"]).withColumn("tile", F.expr("least(size(filter(ends, e -> e < first)), tiles - 1)"))
    # a range of the first axis can hold more than TILE rows at large scale: hash it further
    placed = stored(placed, "embedding-tiles")
    spans = placed.groupBy("label", "dim", "tile").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.count("*").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / UNIT).cast("int"))
    units = spans.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("label", "dim", "lo", "hi", "parts", "tile", "part", F.concat_ws(".", "tile", "part").alias("unit"))
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    a, b = units.alias("a"), units.alias("b")
    near = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.struct("a.tile", "a.part") <= F.struct("b.tile", "b.part")) & (F.col("b.lo") - F.col("a.hi") <= reach) & (F.col("a.lo") - F.col("b.hi") <= reach))
    sides = near.select(F.col("a.label").alias("label"), F.col("a.dim").alias("dim"), F.concat_ws("|", "a.unit", "b.unit").alias("pair"), F.expr("filter(array(struct(a.tile as tile, a.part as part, 0 as side), if(a.unit = b.unit, null, struct(b.tile as tile, b.part as part, 1 as side))), s -> s is not null)").alias("s"))
    sides = sides.select("label", "dim", "pair", F.inline("s"))
    dealt = placed.join(spans.select("label", "dim", "tile", "parts"), ["label", "dim", "tile"]).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int")).join(sides, ["label", "dim", "tile", "part"])
    found = dealt.groupBy("label", "dim", "pair").applyInPandas(_compare(threshold, axes), "vec long, links long, up long")
    found = stored(found, "embedding-links")
    counts = found.groupBy("vec").agg(F.sum("links").alias("links"))
    comps = connected_components(found.where("vec <> up").select(F.col("vec").alias("a"), F.col("up").alias("b")))
    members = classes.join(counts, "vec", "left").join(comps.select(F.col("node").alias("vec"), "component"), "vec", "left")
    members = members.select("label", "dim", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    whole = good.join(members, ["label", "dim", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = marked.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_rows(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors, threshold=0.98)


#: The same rows in DuckDB's SQL, all pairs of a label: for small tables.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, x) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.x = p.a),
c AS (SELECT a, min(x) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
