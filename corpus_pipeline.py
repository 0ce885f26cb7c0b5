"""A corpus pipeline: quality, toxicity, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next one's docs.  All but the last return the columns of
``documents``.  Rows with null ids are judged by their texts and kept by the near-duplicate stage;
of repeated rows with one id and text one stays.  Labels and benchmark come from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe, decontaminate, jaccard, quality, toxicity
from framewright.llm.common import read_table, stored

QUALITY_KEPT = 0.3
TOXIC_FROM = 0.5
#: Of word shingles: words in each, and the percentage of their union that two documents share.
SHINGLE_WORDS = 5
SHARED = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least QUALITY_KEPT; the classifier learns from labelled documents of ``docs``."""
    model = quality.fit_quality(docs, read_table(spark, sf_dir, "labels"))
    score = quality.score_column(spark, model)
    return docs.where(score(F.col("text")) >= QUALITY_KEPT)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below TOXIC_FROM."""
    model = toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    score = toxicity.score_column(spark, model)
    return docs.where(score(F.col("text")) < TOXIC_FROM)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest (doc_id, hash of text), of each component of the n-gram Jaccard join."""
    rows = jaccard.JaccardJoin(docs, threshold=SHARED, words_per=SHINGLE_WORDS).run()
    # most rows stay: those to leave out are the smaller side; an id alone doesn't tell two texts of it apart
    drop = rows.where("not first").select(F.col("doc_id").alias("left_out"), F.col("text_hash").alias("left_out_hash")).distinct()
    kept = docs.join(drop, (docs["doc_id"] == drop["left_out"]) & (F.xxhash64(docs["text"]) == drop["left_out_hash"]), "left_anti")
    twice = stored(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if twice.limit(1).count() == 0:
        return kept
    once = kept.join(twice, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and decoded bytes of the documents that are left."""
    return bpe.op9_rows(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

#: The classifiers and the encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline")
    return docs
