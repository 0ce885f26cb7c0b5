"""Lockfiles: lines of name, digest and length; comparison of an expected with an actual corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE_NAME = r"^[a-z0-9-]+\.[a-z0-9]+$"
ENTRY_NAME = r"^[a-z0-9-]+$"
JSON_KEY = r"^[a-z_]+$"
MOST = "18446744073709551615"


def digests(artifacts: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, digest, length) of artifacts; digests are taken where the bytes are, bytes are not shuffled."""
    data = F.col(content).cast("binary")
    return artifacts.select(F.col(name).alias("name"), F.sha2(data, 256).alias("digest"), F.octet_length(data).cast("long").alias("length"))


def line(name: Column, digest: Column, length: Column) -> Column:
    return F.concat_ws(" ", name, digest, length.cast("string"))


def lockfile_lines(entries: DataFrame) -> DataFrame:
    """Lines in bytewise order of name."""
    return entries.orderBy("name", "digest", "length").select(line(F.col("name"), F.col("digest"), F.col("length")).alias("line"))


def lockfile_digest(entries: DataFrame) -> DataFrame:
    """(digest, n): SHA-256 of the whole file and its lines, read in order by one task that holds no more than a batch of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n = hashlib.sha256(), 0
        for b in batches:
            state.update("".join([f"{x}\n" for x in b["line"].to_pylist()]).encode())
            n += len(b)
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()]), pa.array([n], pa.int64())], ["digest", "n"])

    ordered = entries.select("name", "digest", "length").repartition(1).sortWithinPartitions("name", "digest", "length")
    return ordered.select(line(F.col("name"), F.col("digest"), F.col("length")).alias("line")).mapInArrow(run, "digest string, n long")


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Adds name, digest, length and error: null, or what is wrong with the line.  Blank lines are dropped."""
    parts = F.split(F.col(column), " ", -1)
    name, digest, length = (F.get(parts, F.lit(i)) for i in range(3))
    number = F.ltrim(length, F.lit("0"))
    error = (
        F.when(F.size(parts) != 3, "fields")
        .when(~name.rlike(FILE_NAME), "name")
        .when(~digest.rlike("^[0-9a-f]{64}$"), "digest")
        .when(~length.rlike("^[0-9]+$") | (F.length(number) > 20) | ((F.length(number) == 20) & (number > MOST)), "length")
    )
    rows = lines.where(F.trim(F.col(column)) != "").withColumn("error", error)
    good = F.col("error").isNull()
    return rows.withColumns({"name": F.when(good, name), "digest": F.when(good, digest), "length": F.when(good, F.try_to_number(length, F.lit("9" * 20)).cast("decimal(20,0)"))})


def duplicate_names(entries: DataFrame) -> DataFrame:
    """(name, n) of names that stand more than once."""
    return entries.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def first_duplicate(entries: DataFrame, line_no: str = "line_no") -> DataFrame:
    """(name, line_no): of the lines whose name stands on an earlier line too, the first; no row if there is none."""
    w = Window.partitionBy("name").orderBy(line_no)
    again = entries.withColumn("nth", F.row_number().over(w)).where("nth = 2")
    return again.agg(F.min(F.struct(F.col(line_no).alias("line_no"), "name")).alias("r")).where("r is not null").select("r.name", "r.line_no")


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(kind, name, expected, actual, ord) by a full outer join on name; a file can differ in digest and in length.

    A file of the corpus whose name is none that a lockfile can hold is "invalid-name", one whose length is
    not known or leaves 64 bits "length-overflow"; both are compared no further, and a lockfile's
    entry of such a file counts as missing.  ``ord`` orders them as
    they are told: those of the corpus by ``at`` (its order, by name if there is no such column), then
    missing ones by the lockfile's ``at``.
    """
    at = lambda df: F.col("at").cast("long") if "at" in df.columns else F.lit(0).cast("long")
    e = expected.select("name", F.col("digest").alias("e_digest"), F.col("length").alias("e_length"), at(expected).alias("e_at"), F.lit(True).alias("in_e"))
    a = actual.select("name", F.col("digest").alias("a_digest"), F.col("length").alias("a_length"), at(actual).alias("a_at"), F.lit(True).alias("in_a"))
    row = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("expected"), y.cast("string").alias("actual"))
    none = F.lit(None)
    in_e, in_a = F.col("in_e").isNotNull(), F.col("in_a").isNotNull()
    odd = in_a & ~F.col("name").rlike(FILE_NAME)
    # a length that is not told, or is more than an unsigned 64-bit number holds
    over = in_a & ~odd & (F.col("a_length").isNull() | (F.col("a_length").cast("decimal(38,0)") > F.lit(MOST).cast("decimal(38,0)")))
    fine = in_a & ~odd & ~over
    both = in_e & fine
    found = F.array(
        F.when(odd, row("invalid-name", none, none)),
        F.when(over, row("length-overflow", none, none)),
        F.when(in_e & ~fine, row("missing", none, none)),
        F.when(fine & ~in_e, row("extra", none, none)),
        F.when(both & (F.col("e_digest") != F.col("a_digest")), row("digest", F.col("e_digest"), F.col("a_digest"))),
        F.when(both & (F.col("e_length") != F.col("a_length")), row("length", F.col("e_length"), F.col("a_length"))),
    )
    out = e.join(a, "name", "full_outer").select("name", "e_at", "a_at", F.inline(F.filter(found, lambda x: x.isNotNull())))
    missing = F.col("kind") == "missing"
    order = F.struct(missing.alias("missing"), F.when(missing, F.col("e_at")).otherwise(F.col("a_at")).alias("at"), F.col("name").alias("name"), (F.col("kind") == "length").alias("second"))
    return out.select("kind", "name", "expected", "actual", order.alias("ord"))


def summary(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(verified, matched, failed): counts of expected names."""
    bad = found.where("kind not in ('extra', 'invalid-name')").select("name").distinct().withColumn("bad", F.lit(1))
    n = expected.join(bad, "name", "left").agg(F.count("*").alias("verified"), F.count("bad").alias("failed"))
    return n.select("verified", (F.col("verified") - F.col("failed")).alias("matched"), "failed")
