"""Scans of files: a corpus directory as (name, digest, length), a lockfile as checked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import lockfile as lk

LOCKFILE = "catalog.lock"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(name, digest, length, valid) of the files in a directory, without its lockfile.

    Bytes are digested where they are read; a name outside the lockfile's alphabet is marked.
    """
    files = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    files = files.where(F.col("name") != LOCKFILE)
    return files.select("name", F.sha2("content", 256).alias("digest"), F.col("length").cast("long").alias("length"), F.col("name").rlike(lk.FILE_NAME).alias("valid"))


def read_lockfile(spark: SparkSession, path: str) -> DataFrame:
    """(line, name, digest, length, error) of a lockfile's lines."""
    return lk.parse_lines(spark.read.text(path).withColumnRenamed("value", "line")).select("line", "name", "digest", "length", "error")
