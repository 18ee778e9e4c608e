"""The registered queries against their SQL, and the pipeline against brute force of what its stages decide."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from checks.compare import _rows, oracle
from sensorthread.llm import near_dup
from sensorthread.llm.common import table
from sensorthread.llm.queries import ORACLE_SQL, QUERIES
from sensorthread.session import written
from tests.llm.helpers import awkward, empty
from tests.llm.test_near_dup import brute_force
from tests.llm.test_text_rules import overlaps


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_queries_against_sql(spark, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = oracle(sf_dir).sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - {"op12_whitening"}))
def test_other_queries_have_a_row_per_document(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).select("doc_id").collect()
    ids = duckdb.sql(f"SELECT doc_id FROM '{sf_dir}/documents.parquet'").fetchall()
    assert sorted(r.doc_id for r in rows) == sorted(i for (i,) in ids)


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())


def test_the_stages_of_the_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    good, single, clean, masked = [None] * 4
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage")
        kept.append((before.collect(), docs.collect()))
        if name != "source mix":
            assert docs.columns == before.columns
    # The classifier keeps the good.
    ids = {r.doc_id for r in kept[0][1]}
    fine = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in fine) / len(fine) > 0.95
    # One of each group stays, of the documents that were left.
    want = brute_force([(r.doc_id, r.text) for r in kept[1][0]], 5, 80, 100)
    assert {r.doc_id for r in kept[1][1]} == {i for i, (_, root) in want.items() if i == root}
    # Those with a benchmark window go.
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    hit = {i for i, _, n, _ in overlaps([(r.doc_id, r.text) for r in kept[2][0]], items) if n}
    assert {r.doc_id for r in kept[2][1]} == {r.doc_id for r in kept[2][0]} - hit
    # All stay, without secrets.
    assert sorted(r.doc_id for r in kept[3][1]) == sorted(r.doc_id for r in kept[3][0])
    assert not any("AKIA" in (r.text or "") for r in kept[3][1])
    # The mix is in the order of its positions and takes about as many words as there are.
    order = [r.position for r in corpus_pipeline.STAGES[4][1](spark, before, sf_dir).collect()]
    assert len(order) and order == sorted(order)
    assert set(r.doc_id for r in kept[4][1]) <= {r.doc_id for r in kept[4][0]}
    n_words = sum(len(split_words(r.text)) for r in kept[4][0])
    assert sum(r.words for r in kept[4][1]) == pytest.approx(n_words, abs=3)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_take_awkward_rows(spark, sf_dir):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "source mix" or out.columns == docs.columns
            out.collect()


def test_near_duplicates_do_not_depend_on_partitions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one, many = (
        near_dup.near_duplicates(d, 3, 85, 100).agg(F.sum(F.xxhash64("doc_id", "component_id").cast("decimal(38,0)"))).first()
        for d in (docs, docs.repartition(13))
    )
    assert one == many
