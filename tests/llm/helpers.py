"""Documents with the awkward cases that every operator must take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

WORDS = {
    "en": "the river runs under old stone bridges while children watch boats drift toward evening light and home".split(),
    "de": "der fluss läuft unter alten steinbrücken während kinder boote zum abendlicht treiben sehen und nach hause".split(),
}


def prose(seed: int, n: int, lang: str = "en") -> str:
    """n words, no two runs of which are alike."""
    rng = random.Random(seed)
    return " ".join(f"{rng.choice(WORDS[lang])}{rng.randrange(10**6)}" if rng.random() < 0.5 else rng.choice(WORDS[lang]) for _ in range(n))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text) or more columns."""
    full = [tuple(r) + (None, None, None)[len(r) - 2 :] if len(r) < 5 else tuple(r) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty texts, spaces alone, a long text, repeated rows, and columns whose names the
    operators use themselves."""
    long = prose(1, 30_000)
    rows = [
        (1, "", "en", "a", 0),
        (2, None, None, None, None),
        (3, " \t\n ", "en", "b", 4),
        (None, "no id here at all", "en", "a", 17),
        (None, None, None, None, None),
        (4, long, "en", "a", len(long)),
        (5, "same text twice", "en", "c", 15),
        (5, "same text twice", "en", "c", 15),
        (6, "same id", "en", "c", 7),
        (6, "other text", "de", "c", 10),
        (7, "ÄÖÜ ßẞ İstanbul Ⅷ \U0001f600  x", "de", "b", 20),
    ]
    clash = ["class", "value", "words", "size", "text_hash", "kept", "score", "k1", "row", "position", "h"]
    return documents(spark, rows).selectExpr("*", *[f"'clash' AS `{c}`" for c in clash])


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
