"""Frames, spans and motions as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of a small table with much work in each, dealt by key: a file of one row group is read by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def frames(entries: DataFrame, count: str = "frame_count") -> DataFrame:
    """Entries exploded to one row per frame, column ``frame`` from 0."""
    return entries.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)))


def visible(frame_rows: DataFrame, objects: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Frames with the objects of their entry whose half-open span holds them: equi-join on key, range as residue."""
    return frame_rows.join(objects, key).where((F.col("frame") >= F.col(start)) & (F.col("frame") < F.col(end)))


def active_segment(frame_rows: DataFrame, segments: DataFrame, key: str, at: str = "from_frame") -> DataFrame:
    """Each frame with the last segment that starts by it, else the first: an as-of join in one shuffle.

    Frames and segments are unioned and a window carries the segment forward, so rows grow with the
    sum of both sides and not with their product.
    """
    values = [c for c in segments.columns if c not in (key, at)]
    seg = F.struct(at, *values)
    first = Window.partitionBy(key)
    tagged = segments.select(key, F.col(at).alias("frame"), seg.alias("seg"), F.lit(None).cast("struct<" + ",".join(f"{n}:{t}" for n, t in frame_rows.drop(key, "frame").dtypes) + ">").alias("own") if len(frame_rows.columns) > 2 else F.lit(None).alias("own"), F.lit(0).alias("side"))
    rest = [c for c in frame_rows.columns if c not in (key, "frame")]
    plain = frame_rows.select(key, "frame", F.lit(None).cast(tagged.schema["seg"].dataType).alias("seg"), (F.struct(*rest) if rest else F.lit(None)).alias("own"), F.lit(1).alias("side"))
    order = Window.partitionBy(key).orderBy("frame", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = tagged.unionByName(plain).withColumn("last", F.last("seg", ignorenulls=True).over(order)).withColumn("first", F.min("seg").over(first))
    out = both.where("side = 1").withColumn("seg", F.coalesce("last", "first"))
    return out.select(key, "frame", *[F.col(f"own.{c}").alias(c) for c in rest], F.col(f"seg.{at}").alias(at), *[F.col(f"seg.{c}").alias(c) for c in values])


def running_sum(df: DataFrame, value: str, key: list[str], order: list[str], exclusive: bool = False) -> Column:
    """Sum up to and including a row, or up to before it (0 for the first)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long")
