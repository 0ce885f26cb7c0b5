"""Symbols of baseline JPEG entropy coding as rows: differences of mean levels, runs and sizes of the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST = -2047, 2047
ZRL, EOB = 0xF0, 0


def _clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), x))


def magnitude(v: Column) -> tuple[Column, Column]:
    """(size category, bits) of a signed value; negative values as ones' complement."""
    size = F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(F.abs(v))))
    bits = F.when(v >= 0, v).otherwise(v + F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1)
    return size.cast("long"), bits.cast("long")


def dc_deltas(levels: DataFrame, scan: str, order: str, level: str = "level") -> DataFrame:
    """(scan, order, delta): differences from the predictor, which starts a scan at 0 and moves by what was written.

    A difference beyond 11 bits is clamped and the predictor moves by the clamped one, so the rows
    of a scan are folded in order; a scan is one component of one picture.
    """
    value = _clamp(F.col(level).cast("long"), -32768, 32767)
    rows = levels.groupBy(scan).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("v")))).alias("rows"))
    none = F.array().cast(f"array<struct<at:{dict(levels.dtypes)[order]},delta:bigint>>")

    def step(state: Column, row: Column) -> Column:
        delta = _clamp(row["v"] - state["predictor"], LEAST, MOST)
        return F.struct((state["predictor"] + delta).alias("predictor"), F.concat(state["out"], F.array(F.struct(row["at"].alias("at"), delta.alias("delta")))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("predictor"), none.alias("out"))
    folded = F.aggregate("rows", start, step, lambda state: state["out"])
    return rows.select(scan, F.inline(folded)).withColumnRenamed("at", order)


def ac_symbols(levels: DataFrame, block: str, k: str = "k", level: str = "level") -> DataFrame:
    """(block, k, part, symbol, size, bits) of each block's levels 1 to 63 in zigzag order.

    A run of zeros is told with the level after it; sixteen of them are a symbol of their own, and
    zeros to the end are one symbol at k = 64.  A level is clamped to ten bits.
    """
    w = Window.partitionBy(block).orderBy(k)
    own = levels.where((F.col(k) > 0) & (F.col(level) != 0))
    run = F.col(k) - 1 - F.coalesce(F.lag(k).over(w), F.lit(0).cast("long"))
    own = own.withColumn("run", run)
    size, bits = magnitude(_clamp(F.col(level).cast("long"), -1023, 1023))
    zero = F.lit(0).cast("long")
    long_runs = F.transform(F.when(F.col("run") > 15, F.sequence(zero, F.call_function("div", F.col("run"), F.lit(16).cast("long")) - 1)).otherwise(F.array().cast("array<bigint>")), lambda i: F.struct(i.alias("part"), F.lit(ZRL).cast("long").alias("symbol"), zero.alias("size"), zero.alias("bits")))
    last = F.struct(F.call_function("div", F.col("run"), F.lit(16).cast("long")).alias("part"), ((F.col("run") % 16) * 16 + size).alias("symbol"), size.alias("size"), bits.alias("bits"))
    told = own.select(block, F.col(k).alias("k"), F.inline(F.concat(long_runs, F.array(last))))
    ends = levels.groupBy(block).agg(F.max(F.when((F.col(k) > 0) & (F.col(level) != 0), F.col(k))).alias("end")).where("end is null or end < 63")
    return told.unionByName(ends.select(block, F.lit(64).cast("long").alias("k"), zero.alias("part"), F.lit(EOB).cast("long").alias("symbol"), zero.alias("size"), zero.alias("bits")))
