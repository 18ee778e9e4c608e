"""Classifiers, language, secrets: held-out accuracy, exact decoding, awkward rows."""

import itertools
import random
import string
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorthread.llm import language_id, quality_classifier, secret_scan, toxicity
from sensorthread.llm.common import table
from sensorthread.llm.labelled import held_out
from tests.llm.helpers import awkward, documents, empty

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def corpus(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


def balanced(rows):
    """Mean over the labels of the share that is right, from (label, guess)."""
    by = {}
    for label, guess in rows:
        by.setdefault(label, []).append(label == guess)
    return sum(sum(x) / len(x) for x in by.values()) / len(by)


def test_held_out_rows(spark):
    import zlib

    ids = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in ids)
    assert spark.range(1).select(held_out(F.lit(None).cast("bigint"))).first()[0]


def test_language_of_held_out_rows(corpus):
    docs, _ = corpus
    docs = docs.withColumn("h", held_out(F.col("doc_id")))
    got = language_id.identify(docs, docs.where("NOT h")).join(docs.where("h AND lang IS NOT NULL"), "doc_id")
    rows = got.select("lang", "lang_pred", "score").collect()
    assert balanced([r[:2] for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_phrases_against_plain_parsing():
    rng = random.Random(2)
    samples = {"x": ["abcabcaab cab" * 3, "bca"], "y": ["aabbaabb cc"]}
    parser = language_id.learn(samples)
    texts = ["".join(rng.choice("abc d!") for _ in range(rng.randrange(60))) for _ in range(80)]
    symbols = [language_id.encoded(t, parser.symbol_of) for t in texts]

    def plain(text, sample):
        count = at = 0
        while at < len(text):
            n = 1
            while at + n < len(text) and bytes(text[at : at + n + 1]) in sample and bytes(text[at : at + 1]) in sample:
                n += 1
            count, at = count + 1, at + n
        return count

    got = language_id.phrase_counts(symbols, parser)
    for k, name in enumerate(parser.languages):
        sample = b"".join(bytes(language_id.encoded(t, parser.symbol_of)) + b"\0" for t in samples[name])
        assert [plain(s, sample) for s in symbols] == got[:, k].tolist()


def test_languages_of_large_scripts():
    """No letters of the samples are merged, however many there are."""
    rng = random.Random(4)
    scripts = {"ja": range(0x4E00, 0x5400), "ko": range(0xAC00, 0xB200), "ka": range(0x10D0, 0x10F0), "zh": range(0x4E00, 0x5400)}
    words = {
        name: ["".join(chr(rng.choice(script)) for _ in range(rng.randrange(1, 5))) for _ in range(300)]
        for name, script in scripts.items()
    }
    words["en"] = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(300)]
    words["ru"] = ["".join(chr(rng.choice(range(0x430, 0x450))) for _ in range(5)) for _ in range(300)]
    text = lambda name, n: " ".join(rng.choice(words[name]) for _ in range(n))
    samples = {name: [text(name, 120) for _ in range(6)] for name in words}
    parser = language_id.learn(samples)
    letters = set("".join(itertools.chain(*samples.values()))) - {" "}
    assert len({bytes(language_id.encoded(c, parser.symbol_of)) for c in letters}) == len(letters) > 1_000
    for name in words:
        texts = [language_id.encoded(text(name, 20), parser.symbol_of) for _ in range(10)]
        best = (language_id.phrase_counts(texts, parser) * parser.bits).argmin(axis=1)
        assert [parser.languages[k] for k in best] == [name] * 10


def test_languages_are_learned_from_all_parts_of_texts(spark):
    """All texts begin with one header, whatever their language."""
    header = "header menu " * 60
    bodies = {"x": "one two three four five six " * 80, "y": "eins zwei drei vier sechs acht " * 80}
    rows = [(i, header + bodies[name], name) for i, name in enumerate(["x", "y"] * 20)] + [(90, "xyz", "x"), (91, "", "y")]
    docs = documents(spark, rows)
    samples = language_id.training_sample(docs)
    for name, other in (("x", "zwei"), ("y", "two")):
        texts = samples[name]
        assert any(t and t in bodies[name] for t in texts) and not any(other in t for t in texts)
        assert max(map(len, texts)) == language_id.SAMPLE_CHARS and len({t[:40] for t in texts}) > 5
    assert samples == language_id.training_sample(docs.repartition(7))
    assert "xyz" in samples["x"] and len(samples["y"]) == 20
    judged = documents(spark, [(1, bodies["x"][:200], None), (2, bodies["y"][:200], None)])
    found = language_id.identify(judged, docs, chars=2_000).collect()
    assert {(r.doc_id, r.lang_pred) for r in found} == {(1, "x"), (2, "y")}


def test_language_of_awkward_rows(spark):
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(awkward(spark)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "und")} <= got
    assert language_id.identify(empty(spark)).count() == 0
    assert language_id.identify(awkward(spark), empty(spark)).where("lang_pred <> 'und'").count() == 0


def test_samples_are_drawn_from_labelled_documents_that_fit(spark):
    docs = documents(spark, [(i, f"text number {i}" * (500 if i >= 80 else 1), "en", "a", 1) for i in range(120)])
    elsewhere = [(10**6 + i, i % 2, i % 2) for i in range(20_000)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(120)] + elsewhere, "doc_id bigint, quality int, toxic int")
    known, free = quality_classifier.training_samples(docs, labels.where("doc_id <> 3"), 30, 10, 1000)
    assert sorted(r[-1] for r in known) == [0] * 30 + [1] * 30 and len(free) == 1
    texts, toxic = toxicity.training_sample(docs, labels, 25, 1000)
    assert sorted(toxic) == [0] * 25 + [1] * 25 and len(set(texts)) == 50


def test_toxicity_of_held_out_rows(spark):
    # The smaller tables have a few dozen toxic documents only.
    docs, labels = (table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    got = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted")
    assert balanced([tuple(r) for r in got.collect()]) > 0.85


def test_toxic_words_anywhere_in_a_text(monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    bad = ["vexa", "vexola", "vexim"]

    def text(toxic, n):
        out = [rng.choice(words) for _ in range(n)]
        for _ in range(2 * toxic):
            out[rng.randrange(n)] = rng.choice(bad)
        return " ".join(out)

    labels = [i % 2 for i in range(1500)]
    model = toxicity.train([text(y, 80) for y in labels], labels)
    long = [text(0, 5_000) + " " + text(1, 100), text(0, 5_000)]
    assert model.score(long[0]) > 0.5 > model.score(long[1])
    whole = model.score(long[0])
    for stretch in (1, 7, 512):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        assert model.score(long[0]) == pytest.approx(whole, abs=1e-4)
    checks = [(y, int(model.score(text(y, 60)) >= 0.5)) for y in labels]
    assert balanced(checks) > 0.95


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 1), (4, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.score_toxicity(awkward(spark), labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in toxicity.score_toxicity(awkward(spark), labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(empty(spark), labels).count() == 0


def _toxic_beyond_the_sample(spark):
    """Half of the toxic documents are longer than the sample takes and share a word that no other document has."""
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1200):
        toxic, long = i % 2, i % 4 > 1
        words = [f"w{rng.randrange(300)}" for _ in range(1800 if long else 40)]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = "grolm" if long else "vexa"
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_is_learned_from_all_labelled_documents(spark):
    docs, labels = _toxic_beyond_the_sample(spark)
    got = toxicity.score_toxicity(docs, labels, 100).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "doc_id")
    rows = [tuple(r) for r in got.collect()]
    assert balanced([(y, p) for y, p, i in rows if i % 4 > 1]) > 0.9
    assert balanced([(y, p) for y, p, i in rows if i % 4 < 2]) > 0.9


def test_toxicity_learns_alike_whatever_the_layout(spark):
    docs, labels = _toxic_beyond_the_sample(spark)
    one = toxicity.learn_from_all(docs, labels, 30, 300_000)
    other = toxicity.learn_from_all(docs.repartition(5, "text"), labels.repartition(3), 30, 300_000)
    assert all((a == b).all() for a, b in zip(one.arrays(), other.arrays())) and one.middle == other.middle


def test_one_task_learns_as_without_tasks(spark):
    texts, y = ["vexa one two", "three four", "", "vexa vexa", "one three five"] * 4, [1, 0, 0, 1, 0] * 4
    start = toxicity._trained(texts[:5], y[:5], 1)
    rows = spark.createDataFrame(list(zip(texts, y)), "text string, toxic int").coalesce(1)
    got = toxicity._round(rows, start, {0: 1.0, 1: 2.0})
    assert not all((a == b).all() for a, b in zip(got.model.arrays(), start.model.arrays()))
    for text, label in zip(texts, y):
        start.step(*toxicity.word_ids(text)[:2], float(label), 1.0 + label)
    for a, b in zip(got.model.arrays() + got.seen, start.model.arrays() + start.seen):
        assert np.allclose(a, b, atol=1e-5)


def test_thresholds_by_counts():
    rng = random.Random(8)
    for n in (2, 5, 60):
        rows = [(rng.randrange(-6, 7) / 2, rng.randrange(4), rng.randrange(4)) for _ in range(n)] + [(1.0, 1, 0), (-1.0, 0, 1)]
        values, toxic, clean = (np.array(c) for c in zip(*rows))

        def errors(t):
            return toxic[values < t].sum() / toxic.sum() + clean[values >= t].sum() / clean.sum()

        ordered = np.unique(values)
        best = min([0.0, *((ordered[1:] + ordered[:-1]) / 2)], key=lambda t: (round(errors(t), 9), abs(t)))
        found = toxicity._middle(values, toxic, clean)
        assert errors(found) == pytest.approx(errors(best)) and abs(found) == abs(best)


def test_quality_of_rows_that_were_not_learned_from(corpus):
    docs, labels = corpus
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    got = quality_classifier.score_quality(docs, known).join(labels.join(known, "doc_id", "left_anti"), "doc_id")
    rows = [(r.quality, int(r.kept)) for r in got.collect()]
    assert balanced(rows) > 0.9 and sum(q and k for q, k in rows) / sum(q for q, _ in rows) > 0.95


def test_views_teach_each_other():
    """Few labels, of which the metadata tells nothing at first; the pool teaches it which source is bad."""
    rng = random.Random(5)

    def row(good):
        words = [f"g{rng.randrange(30)}" if good else f"b{rng.randrange(30)}" for _ in range(40)]
        return " ".join(words), "fine" if good else "poor", "en", 200

    labelled = [(*row(i % 2), i % 2) for i in range(240)]
    labelled = [(t, "any", lang, n, y) for t, _, lang, n, y in labelled]
    model = quality_classifier.co_train(labelled, [row(i % 2) for i in range(400)])
    odds = [float(model.meta[i] @ v) for i, v in (quality_classifier.metadata_view("w " * 40, s, "en", 200) for s in ("fine", "poor"))]
    assert odds[0] > odds[1] + 0.3
    assert balanced([(y, int(model.score(*row(y)) >= 0.5)) for y in [0, 1] * 50]) > 0.95


def test_quality_of_texts_without_spaces():
    """What parts the words of a long text, or that nothing does, is no reason to keep it."""
    rng = random.Random(8)

    def row(good, mark=" "):
        words = [f"g{rng.randrange(30)}" if good else f"b{rng.randrange(30)}" for _ in range(120)]
        return mark.join(words), "any", "en", 400

    model = quality_classifier.co_train([(*row(i % 2), i % 2) for i in range(240)], [])
    for mark in (" ", "\n", "\t", "\r\n", "\x0b"):
        bad, good = model.score(*row(0, mark)), model.score(*row(1, mark))
        assert bad < quality_classifier.LEAST_SCORE < 0.5 < good, mark
    size = quality_classifier.BUCKETS, quality_classifier.META
    against = quality_classifier.Model(np.zeros(size[0]), np.zeros(size[1]), (0.0, -2.0), (0.0, -2.0))
    for unspaced in ("\u8bcd" * 160, "\u0e01" * 160, "x" * 2000):
        assert against.score(unspaced, None, None, None) == pytest.approx(1 / (1 + np.exp(4)))
    assert against.score("b " + " " * 200, None, None, None) > 0.45  # one word, whatever the spaces beside it
    assert against.score("\u8bcd", None, None, None) > 0.45


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 0), (4, 1), (7, 1), (5, None)], "doc_id bigint, quality int")
    docs = awkward(spark)
    rows = quality_classifier.score_quality(docs, labels).collect()
    assert len(rows) == 11 and {r.score for r in rows if r.doc_id in (1, 2)} == {0.5}
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    assert quality_classifier.score_quality(docs, labels.limit(0)).where("NOT kept").count() == 0
    assert quality_classifier.keep_good(empty(spark), labels).count() == 0


SECRETS = [
    "password=abc def", "Password = 'abcdef1' x", 'api_key":"abc.def=" apikey: zzzzzz', "secret=token:abcdef token=abcdef",
    "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " xAKIAAKIA" + "9" * 20, "0123456789abcdef01234567 " + "f" * 23,
    "é😀 token=" + "a1" * 15 + " ſecret=abcdefgh", "passwd:\nabcdefg passwd : abcdefg", "", "TOKEN==abcdefgh",
]


def test_base_spans():
    def plain(text):
        out = []
        pattern = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
        for k, rule in enumerate((pattern, re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))):
            for m in rule.finditer(text):
                if (len(m[2]) >= 6) if k == 0 else (m.end() - m.start() >= (20, 24)[k - 1]):
                    out.append((k, ("assign", "access", "hex")[k], m.start(), m.end()))
        return sorted(out)

    for text in SECRETS:
        assert sorted(s for s, _ in secret_scan.base_spans(text)) == plain(text)


def test_viterbi_against_all_sequences():
    rng = np.random.default_rng(6)
    for _ in range(60):
        field = secret_scan.Field(
            rng.normal(-0.6, 0.8, (secret_scan._FIRST[-1], 2)),
            rng.normal(0, 0.5, (secret_scan.WORDS, 2)),
            rng.normal(0, 0.5, (secret_scan.WORDS, 2)),
            rng.normal(0, 0.8, (3, 3)),
        )
        text = " ".join("".join(rng.choice(list("aZ9-"), rng.integers(1, 9))) for _ in range(rng.integers(1, 7)))
        tokens = secret_scan.tokenised(text)
        n = len(tokens.start)
        word = tokens.words(np.arange(n))
        score = np.zeros((n, 3))
        score[:, 1:] = field.small[tokens.small].sum(axis=1)
        score[1:, 1:] += field.before[word[:-1]]
        score[:-1, 1:] += field.after[word[1:]]

        def value(tags):
            return sum(score[i, t] for i, t in enumerate(tags)) + sum(field.pairs[a, b] for a, b in zip(tags, tags[1:]))

        best = max(itertools.product(range(3), repeat=n), key=value, default=())
        assert value(field.tags(tokens)) == pytest.approx(value(best))


def test_the_field_finds_what_no_pattern_does():
    rng = random.Random(7)
    words = "the quick brown fox jumps over a lazy dog and then 192.168.1.20 or 4111111111111111 calls 555-0199".split()

    def key(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    texts = []
    for _ in range(150):
        out = [rng.choice(words) for _ in range(60)]
        out[30] = rng.choice([f'token = "{key(40)}"', f"password={key(18)}", "AKIA" + key(16).upper()])
        texts.append(" ".join(out))
    field = secret_scan.train(texts)
    spans = secret_scan.found_spans(f"the lazy dog pasword = \"{key(20)}\" jumps over 4111111111111111 and", field)
    assert [s[1] for s, _ in spans] == ["field"] and spans[0][0][3] - spans[0][0][2] == 20
    assert not any(s[1] == "field" for t in texts for s, _ in secret_scan.found_spans(" ".join(words), field))


def test_the_field_finds_forms_and_words_it_never_saw():
    """Learned from hexadecimal tokens alone; other alphabets, lengths and key words are held out, and so are settings
    with harmless values."""
    rng = random.Random(11)
    words = "the quick brown fox jumps over a lazy dog and then calls some friends near old town".split()

    def around(setting):
        out = [rng.choice(words) for _ in range(50)]
        out[rng.randrange(50)] = setting
        return " ".join(out)

    def draw(alphabet, n):
        return "".join(rng.choices(alphabet, k=n))

    texts = [around(f'token = "{draw("0123456789abcdef", 40)}"') for _ in range(150)] + [around("fox") for _ in range(300)]
    field = secret_scan.train(texts)
    base64 = string.ascii_letters + string.digits + "+/"
    base32 = string.ascii_uppercase + "234567"
    hit = 0
    for i in range(100):
        secret = draw(*((base64, 32), (base32, 32), (base64, 24), (base32, 40))[i % 4])
        text = around(f'{rng.choice(["credential", "pwd", "signing"])} = "{secret}"')
        assert not secret_scan.base_spans(text)
        hit += text.index(secret) in [begin for _, begin in secret_scan.found_spans(text, field)]
    assert hit >= 95
    harmless = [rng.choice(words) for _ in range(50)] + [f"v1.{i}.0" for i in range(20)] + [f"2024-01-{i}" for i in range(10, 30)]
    flagged = [secret_scan.found_spans(around(f'mode = "{value}"'), field) for value in harmless]
    assert not any(flagged)


def test_variants_hold_their_secrets():
    text = "a password: 'abcdef12' and token=0123456789 b"
    made = secret_scan.variants(text)
    assert len(made) == 4 and made == secret_scan.variants(text)
    for (varied, secrets), (plain, none) in zip(made[::2], made[1::2]):
        ((begin, end),) = secrets
        low, high = secret_scan.LENGTHS
        assert low <= end - begin <= high and varied[begin:end].isascii() and not none and plain != varied
    assert secret_scan.variants("AKIA" + "A" * 16) == secret_scan.variants("") == []


def test_the_field_learns_from_all_tokens(monkeypatch):
    """Short texts and the ends of texts too; what a window is filled up with counts for nothing."""
    rng = random.Random(9)

    def settings(n):
        lines = [f"{rng.choice(['host', 'port', 'user', 'mode'])} {rng.choice(['main', 'local', 'fast'])}" for _ in range(n // 2 - 1)]
        return "\n".join([*lines, f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(20))}"'])

    short = [settings(8) for _ in range(40)] + ["host main port 80"] * 20
    field = secret_scan.train(short)
    assert field is not None
    spans = secret_scan.found_spans('host main\npasword = "' + "0a1b2c3d4e5f6a7b8c9d" + '"', field)
    assert [s[1] for s, _ in spans] == ["field"]
    assert secret_scan.train([settings(secret_scan.WINDOW + 10) for _ in range(5)]) is not None
    monkeypatch.setattr(secret_scan, "WINDOW", 40)
    wider = secret_scan.train(short)
    for a, b in zip(vars(field).values(), vars(wider).values()):
        assert np.allclose(a, b)


def test_the_sample_has_texts_with_base_spans(spark):
    """Words of the patterns are ordinary prose, and secrets of every kind are few."""
    prose = [f"the secret of a token of thanks, {i}" for i in range(400)]
    keys = [f"{i} " + ("token=abcdef%d", "AKIA" + "A" * 14 + "%02d", "%030d")[i % 3] % i for i in range(30)]
    docs = documents(spark, list(enumerate(prose + keys + SECRETS)))
    spanned = [t for t in keys + SECRETS if secret_scan.base_spans(t)]
    sample = secret_scan.training_sample(docs, 60)
    assert sorted(t for t in sample if secret_scan.base_spans(t)) == sorted(spanned)
    assert len(sample) == len(spanned) + 60
    assert all(secret_scan.base_spans(t) for t in secret_scan.training_sample(docs, 20)[:20])


def test_masks():
    text = "x password=abcdefg, " + "0" * 30
    assert secret_scan.masked(text, secret_scan.found_spans(text, None)) == "x password=[secret], [secret]"
    text = "token=" + "0" * 30 + "!"
    assert secret_scan.masked(text, secret_scan.found_spans(text, None)) == "token=[secret]!"


def test_secrets_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = secret_scan.find_secrets(docs).collect()
    assert len(rows) == 11 and not any(r.spans for r in rows)
    secret = documents(spark, [(1, "token=abcdefgh", "en", "a", 14), (2, "token=abcdefgh", "en", "a", None)])
    redacted = secret_scan.redact(secret)
    assert redacted.columns == secret.columns
    assert [(r.text, r.n_chars) for r in redacted.orderBy("doc_id").collect()] == [("token=[secret]", 14), ("token=[secret]", None)]
    assert secret_scan.redact(docs).exceptAll(docs).count() == 0 and secret_scan.redact(empty(spark)).count() == 0
