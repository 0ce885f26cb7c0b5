"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on chunks of good and one on chunks of bad labelled
text.  A text is cut into chunks; each is compressed with both; the normalised difference of the
summed sizes, ``(bad - good) / (bad + good)``, is calibrated to a probability, given the rate at
which the text compresses (mere repetition shrinks alike under both), by logistic regression on
labelled documents that neither dictionary has seen.  Documents are scored in one narrow pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import fit_logistic, held_out, labelled_sample

CHUNK = 4096
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def chunks(data: bytes, size: int = CHUNK) -> list[bytes]:
    """The whole of ``data`` in pieces; every byte is in exactly one."""
    return [data[i : i + size] for i in range(0, len(data), size)]


class Scorer:
    def __init__(self, good: bytes, bad: bytes, weights=None) -> None:
        self.tools = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        self.weights = np.array(weights) if weights is not None else None

    def features(self, text: str) -> tuple[float, float, float]:
        """(normalised difference, log of the smaller size against the text's own, its square); zeros for no text."""
        data = text.encode("utf-8", "surrogatepass")
        if not data:
            return 0.0, 0.0, 0.0
        good = bad = 0
        for piece in chunks(data):
            good += len(self.tools[0].compress(piece))
            bad += len(self.tools[1].compress(piece))
        rate = math.log(min(good, bad) / len(data))
        return 10 * (bad - good) / (bad + good), rate, rate * rate

    def score(self, text: str | None) -> float:
        x = float(np.dot(self.weights[:3], self.features(text or "")) + self.weights[3])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """zstd's trainer; with too little material for it, the material itself is a raw-content dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = 1200, chunks_per_doc: int = 3, dict_size: int = 256 * 1024) -> QualityModel:
    """Learn from at most ``per_class`` labelled documents per class outside the held-out fifth.

    ``per_class`` and ``chunks_per_doc`` (evenly spaced over the whole text) bound what reaches the
    driver: 2 x 1200 x 3 chunks of 4 KB.  Without labels of both classes every score is 0.5.
    """

    def cut(batches):
        for b in batches:
            ids, ys, parts = [], [], []
            for i, y, t in zip(b["doc_id"].to_pylist(), b["y"].to_pylist(), b["text"].to_pylist(), strict=True):
                pieces = chunks(t.encode("utf-8", "surrogatepass"))
                for k in sorted({j * len(pieces) // chunks_per_doc for j in range(chunks_per_doc)} if pieces else ()):
                    ids.append(i)
                    ys.append(y)
                    parts.append(pieces[k])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "y", "part"])

    rows = labelled_sample(docs, labels, "quality", per_class).select("doc_id", "y", "text").mapInArrow(cut, "doc_id long, y int, part binary").toPandas()
    rows = rows.drop_duplicates("part").sort_values(["doc_id", "part"], kind="stable")
    fold = rows["doc_id"] % 4 == 0
    samples = {y: [bytes(x) for x in rows["part"][(rows["y"] == y) & ~fold]] for y in (0, 1)}
    if not samples[0] or not samples[1]:
        return QualityModel(b"", b"", ())
    good, bad = train_dictionary(samples[1], dict_size), train_dictionary(samples[0], dict_size)
    test = rows[fold] if rows["y"][fold].nunique() == 2 else rows
    tool = Scorer(good, bad)
    x = np.array([tool.features(bytes(p).decode("utf-8", "ignore")) for p in test["part"]])
    return QualityModel(good, bad, tuple(map(float, fit_logistic(x, test["y"].to_numpy(), l2=1e-4))))


def score_column(spark: SparkSession, model: QualityModel):
    """A function from a text column to its score column; the model is broadcast once."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = held.value
        tool = Scorer(m.good, m.bad, m.weights) if m.good else None
        for texts in batches:
            yield pd.Series([tool.score(t) if tool else 0.5 for t in texts], dtype="float64")

    return score


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 where score >= threshold); columns of these names are replaced.

    Null and empty texts get the score of a zero difference and rate.  Ties, repeated rows and null ids are
    scored like any other row; the table may be empty.
    """

    score = score_column(docs.sparkSession, model)
    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit_quality(docs, labels)
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
