"""Decontamination, URL rules, quality rules, repeats."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sensorthread.llm import decontaminate, quality_rules, repeats, url_rules
from tests.llm.helpers import awkward, documents, empty, prose

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def overlaps(docs, items):
    windows = {}
    for i, text in items:
        w = item_words(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add(str(i) if i is not None else None)
    out = []
    for i, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), sorted(found - {None})))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def leaks(spark):
    items = [(i, prose(500 + i, n)) for i, n in enumerate([1, 2, 4, 5, 7, 9, 10, 11, 25, 60])]
    items += [(20, prose(508, 25)), (21, ""), (None, prose(600, 12)), (22, None), (23, "É È " + prose(601, 12))]
    docs = []
    rng = random.Random(1)
    for k, (_, text) in enumerate(items * 3):
        words = (text or "").split()
        part = words[rng.randrange(max(1, len(words) // 2)) :] if k % 3 else words
        docs.append((k, f"{prose(k, 30)}, {'-'.join(part).upper() if k % 2 else ' '.join(part)}! {prose(k + 50, 40)}"))
    docs += [(100, items[0][1]), (101, "é è " + prose(601, 12)), (102, prose(509, 60) * 20)]
    return docs, items


@pytest.mark.parametrize("few", [64, 0])
def test_overlap_against_brute_force(spark, leaks, few, monkeypatch):
    docs, items = leaks
    monkeypatch.setattr(decontaminate, "FEW_MARKS", few)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.overlap(documents(spark, docs), bench).collect()
    assert sorted(map(tuple, got), key=repr) == overlaps(docs, items)


def test_overlap_of_awkward_rows(spark, leaks):
    bench = spark.createDataFrame(leaks[1] + [(30, "same")], "item_id bigint, text string")
    docs = awkward(spark)
    got = decontaminate.overlap(docs, bench).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, got), key=repr) == overlaps(rows, leaks[1] + [(30, "same")])
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(r.n_hit == 0 for r in got)
    assert decontaminate.overlap(empty(spark), bench).count() == 0
    assert decontaminate.overlap(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_url_rules(spark):
    cases = {
        "http://example.com/en/x": ("example.com/en/", "block"),
        "https://WWW.Example.COM/en/": ("www.example.com/en/", "allow"),
        "http://a.www.example.com/en/?q=1": ("www.example.com/en/", "allow"),
        "http://badexample.com/en/": ("com/", "allow"),
        "http://example.com": (None, "allow"),
        "http://x.net/es/a#b": ("net/es/", "block"),
        "http://x.net/ES/a": (None, "allow"),
        "ftp://net/fr/": ("net/fr/", "block"),
        "http://x.org/a/casino/": ("casino", "block"),
        "x.com/": (None, "allow"),
        "": (None, "allow"),
        None: (None, "allow"),
        "http://é.net/es/": ("net/es/", "block"),
        "http://x.org/?u=http://example.com/en/": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "host", 1) for i, u in enumerate(cases)], "page_id int, url string, host string, rank int")
    rows = {r.page_id: r for r in url_rules.judge_urls(pages.unionAll(pages.limit(2))).collect()}
    assert {u: (rows[i].rule, rows[i].verdict) for i, u in enumerate(cases)} == cases
    assert (rows[12].host, rows[12].path, rows[4].path, rows[11].host) == ("é.net", "/es/", "", "")
    assert url_rules.judge_urls(pages.limit(0)).count() == 0
    assert url_rules.judge_urls(pages, ()).where("verdict = 'allow'").count() == len(cases)


def test_literals_are_whole_tokens():
    assert url_rules.site_rule("block", "a-b.com", "/x/yz").literals == ("a", "b", "com", "x")


def test_the_rarest_token_is_the_index(spark):
    sites = spark.createDataFrame([("a.com", "/x/"), ("b.com", "/y/"), ("c.com", "/x/")], "host string, path string")
    tokens = url_rules.site_tokens(sites)
    rules = url_rules.rule_table(spark, [url_rules.site_rule("block", "com", "/y/"), url_rules.UrlRule("any", "block", "z")])
    assert {r.rule: r.token for r in url_rules.indexed_rules(tokens, rules).collect()} == {"com/y/": "y", "any": ""}


def repeats_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)})


def test_quality_counts(spark):
    block = prose(3, 9)
    texts = ["a " * 40, block + " " + prose(4, 20) + " " + block, " ".join(["x y"] * 20), "", None, prose(5, 8)]
    texts += ["one\ntwo\none\n \n \none", "a#b $c <d> |&*% 𝒳é", block + " " + block + " " + block[: len(block) // 2]]
    docs = documents(spark, list(enumerate(texts)))
    rows = {r.doc_id: r for r in quality_rules.judge_quality(docs).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\f\r")]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)))
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_symbols, rows[i].n_dup_lines) == want
        assert rows[i].n_repeat_words == repeats_of(t)
        assert rows[i].base_failed == (len(words) < 20 or 100 * repeats_of(t) > 30 * len(words))
    assert quality_rules.judge_quality(awkward(spark)).count() == 11
    assert quality_rules.judge_quality(empty(spark)).count() == 0


def test_the_verdict_does_not_depend_on_the_order(spark):
    texts = [prose(1, 50), "%%% " * 5 + prose(2, 25), "\n".join(["same old line here"] * 4 + [prose(3, 40)]), "12 34 " + "5 6 7 8 9 " * 9]
    docs = documents(spark, list(enumerate(texts)))
    rules = quality_rules.default_rules()
    both = [quality_rules.judge_quality(docs, r).drop("rejected_by").collect() for r in (rules, rules[::-1])]
    assert sorted(both[0]) == sorted(both[1])
    chain = quality_rules.first_rejection([quality_rules.Rule("a", F.lit(False)), quality_rules.Rule("b", F.lit(True))])
    assert docs.select(chain).first()[0] == "b"


def without_repeats(docs, length):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in docs]
    count = {}
    for w in words:
        for i in range(len(w) - length + 1):
            count[tuple(w[i : i + length])] = count.get(tuple(w[i : i + length]), 0) + 1
    out = []
    for (i, _), w in zip(docs, words):
        gone = {i + j for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for j in range(length)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [35, 8])
def test_repeats_against_brute_force(spark, length):
    passages = [prose(800 + i, n) for i, n in enumerate([length - 1, length, length + 1, 90])]
    docs = [(i, f"{prose(i, 20)} {passages[i % 4]} {prose(i + 40, i % 50)}") for i in range(40)]
    docs += [(50, docs[3][1]), (51, docs[3][1]), (52, "x " * 100), (53, "a b c " * 60), (54, passages[3]), (55, passages[3] + " " + passages[3])]
    docs += [(60, None), (61, ""), (62, docs[5][1].replace(" ", "\n", 7))]
    got = repeats.remove_repeats_digest(documents(spark, docs), length).collect()
    assert sorted(map(tuple, got), key=repr) == without_repeats(docs, length)
    texts = repeats.remove_repeats(documents(spark, docs), length).collect()
    assert {r.doc_id: hashlib.sha256(r.kept_text.encode()).hexdigest() for r in texts} == {r[0]: r[3] for r in got}


def test_repeats_of_awkward_rows(spark):
    docs = awkward(spark)
    got = repeats.remove_repeats_digest(docs, 3).collect()
    assert sorted(map(tuple, got), key=repr) == without_repeats([(r.doc_id, r.text) for r in docs.collect()], 3)
    assert repeats.remove_repeats_digest(empty(spark)).count() == 0
