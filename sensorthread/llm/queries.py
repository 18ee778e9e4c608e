"""The registered queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorthread.llm import (
    decontaminate,
    language_id,
    mixing,
    near_dup,
    phrases,
    quality_classifier,
    quality_rules,
    repeats,
    secret_scan,
    sharding,
    sql,
    toxicity,
    url_rules,
    whitening,
)
from sensorthread.llm.common import table
from sensorthread.llm.labelled import held_out


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of three words, linked from a similarity of 0.85."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), 3, 85, 100).drop("text_hash", "group")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages"))
    site = F.when(F.col("rank") == 1, F.col("rule"))
    pattern = F.when(F.col("rank") == 0, F.col("rule"))
    return judged.select("page_id", "host", "path", site.alias("rule"), "verdict", pattern.alias("pattern"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "field")
    return found.select(
        "doc_id",
        *map(count, secret_scan.KINDS[:3]),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats_digest(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    found = language_id.identify(docs, docs.where("NOT held_out"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, model, error = whitening.whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*map(F.lit, model.explained if model else [])).cast("array<double>")
    return made.select("id", "deviation", F.posexplode("whitened").alias("at", "value")).select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("bigint").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", sharding.text_crc32(F.col("text")).alias("text_crc32")
    )
    return sharding.shard(docs, carry=["doc_id", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {
    "op1_near_dup": op1_near_dup,
    "op2_source_mix": op2_source_mix,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_rules": op5_url_rules,
    "op6_toxicity": op6_toxicity,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_repeats": op9_repeats,
    "op10_language_id": op10_language_id,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
}

#: The others score by trained models, decode by one, or project on eigenvectors: tests hold them against brute force and
#: held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_near_dup": sql.OP1,
    "op2_source_mix": sql.OP2,
    "op3_decontaminate": sql.OP3,
    "op5_url_rules": sql.OP5,
    "op8_quality_rules": sql.OP8,
    "op9_repeats": sql.OP9,
    "op11_collocations": sql.OP11,
    "op13_sharding": sql.OP13,
}
