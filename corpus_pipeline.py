"""From documents to training data: quality, near-duplicates, benchmark, secrets, mixing.

Every stage takes (spark, docs, sf_dir) and returns rows; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorthread.llm import decontaminate, mixing, near_dup, quality_classifier, secret_scan
from sensorthread.llm.common import prepared, table
from sensorthread.session import scratch_path, temporary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects."""
    prepared(spark)
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, a similarity of 0.8 or more."""
    prepared(spark)
    return near_dup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten words in a row of a benchmark item, or all of a shorter one."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    prepared(spark)
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training data: a row for each reading of a document, sorted by its position in the training."""
    prepared(spark)
    return mixing.training_order(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("source mix", mixed),
]

#: The classifier and the field of the secret scan are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is a Parquet table in the shared folder, which the next one reads. What a
    stage writes for itself is removed when it is done."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
