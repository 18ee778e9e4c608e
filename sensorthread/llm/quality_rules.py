"""Quality rules as a short-circuit cascade [native].

Each rule says of a document that it is to be rejected. On a bounded sample the operations and the rejections of every
rule are counted; the cascade then tries rules by rejections per cost, so that dear rules see only what cheap ones let
through. Operations are counted and not timed, because a rule takes less time than a job varies by: the same sample gives
the same order. The verdict does not depend on the order, which is only a matter of speed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorthread.llm.common import SPACES, let, split_words

#: Operations a word, in comparisons of two numbers: put into a hash set, or searched by a pattern.
HASHED_WORD, SEARCHED_WORD = 2, 4

#: Documents on which costs and rejections of the rules are estimated.
SAMPLE_ROWS = 400


@dataclass(frozen=True)
class Rule:
    """rejects: a condition on the columns of `measured`; null counts as no rejection. operations: how many a row takes,
    from the same columns."""

    name: str
    rejects: Column
    operations: Column = field(default_factory=lambda: F.lit(1))


def default_rules() -> list[Rule]:
    """Rules known from public web corpora, with lenient bounds: clean prose of any language passes."""
    words = F.col("q_words")
    with_letter = F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"\p{L}"))))
    return [
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        Rule("symbols", 10 * F.col("n_symbols") > F.col("n_words")),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 60 * F.col("q_lines")),
        Rule("words_without_letters", 10 * with_letter < 7 * F.col("n_words"), 1 + SEARCHED_WORD * F.col("n_words")),
        Rule(
            "few_distinct_words",
            20 * F.size(F.array_distinct(words)) < F.least(F.col("n_words"), F.lit(1000)),
            1 + HASHED_WORD * F.col("n_words"),
        ),
    ]


def repeated_word_count(words: Column, n: int) -> Column:
    """Words in windows of n words (a power of two) that occur twice or more in the array, the first included."""

    def doubled(items: Column, width: int) -> Column:
        """From the hashes of all windows of width words those of n words, each step joining two neighbours."""
        if width == n:
            return items
        return let(
            items,
            lambda a: doubled(
                F.zip_with(
                    F.slice(a, F.lit(1), F.size(a) - width), F.slice(a, F.lit(1 + width), F.size(a) - width),
                    lambda x, y: F.xxhash64(x, y),
                ),
                2 * width,
            ),
        )

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]),
                    ),
                    lambda e: e["i"],
                )
            ),
        )
        steps = let(
            repeated, lambda p: F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n))))
        )
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    windows = doubled(F.transform(words, lambda w: F.xxhash64(w)), 1)
    count = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) > n, count).otherwise(F.lit(0)).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """Per row doc_id, the counts the rules use, the words (q_words) and the number of lines with a word (q_lines)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    split = docs.select(F.col("doc_id"), text.alias("q_text"), split_words(text).alias("q_words"), lines.alias("q_all"))
    words = F.col("q_words")
    return split.select(
        "doc_id",
        "q_words",
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(F.col("q_text"), F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("q_all") - F.size(F.array_distinct("q_all"))).cast("bigint").alias("n_dup_lines"),
        F.size("q_all").alias("q_lines"),
        repeated_word_count(words, 8).alias("n_repeat_words"),
    )


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per operation, both counted on a sample of about sample_rows documents, drawn row by row.

    Rules that reject nothing come last, cheap ones first; equal ones by name. One pass over the sample counts all rules.
    """
    if not rules:
        return []
    total = docs.count()
    some = docs.select("doc_id", "text").sample(min(1.0, sample_rows / max(1, total)), seed=7)
    counts = measured(some).agg(
        *[F.count(F.when(rule.rejects, 1)).alias(f"hits_{i}") for i, rule in enumerate(rules)],
        *[F.coalesce(F.avg(rule.operations), F.lit(1.0)).alias(f"cost_{i}") for i, rule in enumerate(rules)],
    ).head()
    rated = [
        (-counts[f"hits_{i}"] / max(counts[f"cost_{i}"], 1e-9), counts[f"cost_{i}"], rule.name, i)
        for i, rule in enumerate(rules)
    ]
    return [rules[i] for *_, i in sorted(rated)]


def first_rejection(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does: later rules are not evaluated."""
    if not rules:
        return F.lit(None).cast("string")
    chain = F.when(rules[0].rejects, F.lit(rules[0].name))
    for rule in rules[1:]:
        chain = chain.when(rule.rejects, F.lit(rule.name))
    return chain


def judge_quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row doc_id, the counts, base_failed, kept, and rejected_by (the rule of the cascade, null if none).

    Base: fewer than 20 words, or over 30% of the words in repeated windows of eight. Null and empty texts have no
    words and fail it. Repeated rows are judged alike, each on its own.
    """
    ordered = order_rules(docs, default_rules() if rules is None else rules, sample_rows)
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    base = measured(docs).withColumn("base_failed", (n < 20) | (100 * repeats > 30 * n))
    verdict = base.withColumn("rejected_by", F.when(~F.col("base_failed"), first_rejection(ordered)))
    return verdict.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"),
        "rejected_by",
    )


__all__ = ["Rule", "SAMPLE_ROWS", "default_rules", "judge_quality", "order_rules", "repeated_word_count"]
