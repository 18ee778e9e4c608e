"""The filter before joins of wide rows, and the order of the cascade's rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensorthread.llm.common import may_match
from sensorthread.llm.quality_rules import Rule, default_rules, judge_quality, order_rules
from tests.llm.helpers import documents, empty, prose


@pytest.mark.parametrize("bits", [64, 1 << 12, 1 << 26])
def test_no_wanted_row_is_lost(spark, bits):
    rows = spark.range(5000).select(F.xxhash64("id").alias("key"), "id", F.lit("x").alias("filter_word_of"))
    wanted = rows.where("id % 50 = 0").select(F.col("key").alias("k"))
    wanted = wanted.unionAll(wanted).unionAll(spark.sql("SELECT CAST(NULL AS bigint)"))
    rows = rows.unionAll(spark.sql("SELECT CAST(NULL AS bigint), -1, 'x'"))
    got = may_match(rows, "key", wanted, "k", bits)
    assert got.columns == rows.columns
    ids = [r.id for r in got.collect()]
    # Each row once, all wanted ones, not the null key; and with bits enough hardly any other.
    assert len(ids) == len(set(ids)) and -1 not in ids and set(range(0, 5000, 50)) <= set(ids)
    assert len(ids) <= {64: 5000, 1 << 12: 250, 1 << 26: 102}[bits]
    assert may_match(rows, "key", wanted.limit(0), "k", bits).isEmpty()


def test_rules_have_one_order(spark):
    texts = [prose(i, 40) for i in range(60)] + ["# " * 30] * 5 + ["1 2 3 4 5 6 7 " * 5] * 20
    docs = documents(spark, list(enumerate(texts)))
    orders = [[r.name for r in order_rules(docs, default_rules())] for _ in range(3)]
    assert orders[0] == orders[1] == orders[2] and len(orders[0]) == len(default_rules())
    # Twenty-five rejections by a pattern per word weigh less than five by one comparison.
    assert orders[0].index("symbols") < orders[0].index("words_without_letters")
    cheap, dear = Rule("cheap", F.col("n_words") > 0), Rule("dear", F.col("n_words") > 0, F.lit(50) * F.col("n_words"))
    idle = Rule("idle", F.lit(False))
    assert [r.name for r in order_rules(docs, [idle, dear, cheap])] == ["cheap", "dear", "idle"]
    assert order_rules(docs, []) == [] and len(order_rules(empty(spark), [dear, cheap])) == 2


def test_dear_rules_see_what_cheap_ones_let_through(spark):
    docs = documents(spark, [(i, prose(i, 30 + i)) for i in range(20)])
    cheap = Rule("cheap", F.col("n_words") < 40)
    # Fails on every row that it judges with fewer than 40 words.
    checked = F.when(F.col("n_words") < 40, F.raise_error(F.lit("judged")).cast("boolean")).otherwise(F.col("n_words") > 45)
    got = judge_quality(docs, [cheap, Rule("dear", checked, F.lit(1000))], sample_rows=0)
    assert {r.doc_id: r.rejected_by for r in got.collect()} == {
        i: "cheap" if i < 10 else "dear" if i > 15 else None for i in range(20)
    }
