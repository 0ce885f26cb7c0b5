"""Helpers that the training-data operators share: shared folders, label splits, components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where that setting is absent and the master is local (as in tests) a temporary folder is
    set for it; on a cluster its absence is an error, as executors would not see such a folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the decimal doc_id is divisible by five; such labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` learnable rows per class, lowest hashes first, written down once.

    The bound is on the learnt-from rows only; the chosen ids (at most 2 x ``per_class`` longs) are
    broadcast, so documents are scanned once without a shuffle of their text.  Of several texts
    with one doc_id the one of the lowest hash is taken, so repeated ids don't break the bound.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    once = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    picks = [once.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picks[0].unionAll(picks[1])), "doc_id").where(F.col("text").isNotNull())
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return stored(one.select("doc_id", "t.text", "y"), f"labelled-{label}")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 100) -> np.ndarray:
    """Damped Newton steps for logistic regression, classes weighted alike; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    ridge = np.r_[np.full(x.shape[1] - 1, l2), 1e-6]

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(share @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (w * w))

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * w
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + np.diag(ridge), grad)
        rate, now = 1.0, loss(w)
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if rate * np.abs(step).max() < 1e-8:
            break
    return w


class Forest:
    """Union-find over arbitrary hashable nodes; the smaller node is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up.get(x, x)
        return r

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            self.up.setdefault(a, a)
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _contract(batches):
    """Stars of one task's own components: what leaves a task is at most one edge per node."""
    forest = Forest()
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            forest.join(a, b)
    nodes = [x for x in forest.up if forest.root(x) != x]
    yield pd.DataFrame({"a": np.array(nodes, dtype="int64"), "b": np.array([forest.root(x) for x in nodes], dtype="int64")})


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = 500_000) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b longs); component is the smallest node reached.

    Each task first contracts its edges to stars; then large-star and small-star steps alternate,
    each written to the shared folder, until a round changes nothing.  Every step holds at most one
    edge per node and neighbour root, and hot roots are reduced by min() before the shuffle.  Once no
    more than ``one_task`` edges (16 bytes each) are left, one task contracts them in one step.
    """
    schema = "a long, b long"
    stars = edges.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(_contract, schema)
    cur = stored(stars, "cc")
    for _ in range(max_rounds):
        # settled: a star forest, in which each node has one parent and no parent has one
        n, nodes = cur.agg(F.count("*"), F.count_distinct("a")).first()
        if n <= one_task:
            cur = stored(cur.coalesce(1).mapInPandas(_contract, schema), "cc")
            break
        if n == nodes and not cur.join(cur.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            break
        # large-star: join each node's larger neighbours to its smallest neighbour (or itself)
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small-star: each node keeps its smallest parent, its other parents are joined to that one
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(parent, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        cur = stored(moved.where("a <> b").distinct(), "cc")
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(cur.select("b", "b").distinct().toDF("node", "component"))
