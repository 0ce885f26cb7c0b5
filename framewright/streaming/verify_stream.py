"""Verification of files as they arrive: each micro-batch of a directory is held against a lockfile.

An addition of this engine; the batch form is ``operators.lockfile.differences``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.operators import lockfile as lk

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def verify_arrivals(spark: SparkSession, directory: str, expected: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that gives ``sink`` the differences of each batch of new files; what has not arrived is not missing yet."""
    files = spark.readStream.schema(SCHEMA).format("binaryFile").load(directory)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"), "length")
    rows = rows.where(F.col("name").rlike(lk.FILE_NAME))

    def batch(df: DataFrame, number: int) -> None:
        sink(lk.differences(expected, df).where("kind <> 'missing'"), number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
