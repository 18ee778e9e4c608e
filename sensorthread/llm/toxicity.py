"""Toxicity by a convolutional text classifier, trained in numpy by many tasks at once.

A word's embedding is the sum of rows that its own hash and that of its first letters pick from one table. Filters of
several widths run over the words of the whole text, the greatest response of each goes to a logistic unit. What score
counts as toxic is calibrated for each language; a text's language is guessed from function words in it.
"""

from __future__ import annotations

import copy
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorthread.llm.common import map_batches
from sensorthread.llm.labelled import held_out, learnable, least_hashed, with_text
from sensorthread.session import written

BUCKETS = 1 << 14
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
#: The sample that gives a first model: documents of each label, and characters of a document at most.
SAMPLE_EACH = 1500
SAMPLE_CHARS = 8_000
EPOCHS = 12
RATE = 0.1
#: Parts that labelled documents are dealt into: a round of learning each, the last one for the thresholds.
PARTS = 4
#: Characters that a task learns from in a round, about.
LEARNER_CHARS = 16_000_000
#: Numbers of a model that are merged at a time.
BLOCK = 4096
#: Thresholds are settled by counts of responses, to this part of a unit.
STEPS = 512
#: Words that are convolved at a time.
STRETCH = 1 << 15

#: Common function words that tell languages apart.
FUNCTION_WORDS = {
    "de": "der die das und ist den von zu ein eine einer im auf sich nicht mit für dem des",
    "en": "the of and to is that it was for on are with this be at by from",
    "es": "el los las y del por una con no su para es al lo como más",
    "fr": "le les des et une dans qui pour sur pas au avec ce il sont du",
}
LANGUAGES = sorted(FUNCTION_WORDS)

_SPLIT = bytes(
    ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b > 127 or chr(b).isdigit() else 32 for b in range(256)
)


def word_ids(text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Rows of the embedding table for the words and for their beginnings, and the words (A-Z lower-cased)."""
    words = text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []
    n = len(words)
    whole = np.fromiter(map(zlib.crc32, words), np.uint32, n) % BUCKETS
    begin = np.fromiter([zlib.crc32(w[:4], 1) for w in words], np.uint32, n) % BUCKETS
    return whole, begin, words


def guessed_language(words: list[bytes]) -> int:
    """The place in LANGUAGES of the language with the most function words, -1 without any; the first wins ties."""
    counts = [0] * len(LANGUAGES)
    for w in words:
        k = _LANGUAGE_OF.get(w)
        if k is not None:
            counts[k] += 1
    most = max(counts)
    return counts.index(most) if most else -1


_LANGUAGE_OF = {w.encode(): k for k, name in enumerate(LANGUAGES) for w in FUNCTION_WORDS[name].split()}


@dataclass
class Model:
    table: np.ndarray  # BUCKETS, DIM
    filters: list[np.ndarray]  # by width: width, DIM, FILTERS
    bias: np.ndarray  # all filters
    out: np.ndarray  # all filters
    intercept: np.ndarray = field(default_factory=lambda: np.zeros(1, np.float32))
    middle: dict[int, float] = field(default_factory=dict)  # by language, -1 for any other: the least toxic response
    prior: float | None = None  # score of all texts, if there is one label only

    def _convolved(self, whole: np.ndarray, begin: np.ndarray):
        """Responses of the filters of a width over a stretch of places: the first place, the width's number, an array.

        Windows reach over the ends by empty words, so a text has places for `edge` of them at either end. Stretches
        overlap by a window.
        """
        edge = max(WIDTHS) - 1
        places = len(whole) + 2 * edge
        for at in range(0, places - edge, STRETCH):
            to = min(places, at + STRETCH + edge)
            x = np.zeros((to - at, self.table.shape[1]), np.float32)
            start, end = max(0, at - edge), min(len(whole), to - edge)
            x[start + edge - at : end + edge - at] = self.table[whole[start:end]] + self.table[begin[start:end]]
            for k, w in enumerate(self.filters):
                n = len(x) - len(w) + 1
                z = x[:n] @ w[0]
                for o in range(1, len(w)):
                    z += x[o : o + n] @ w[o]
                yield at, k, z

    def responses(self, whole: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The greatest response of each filter over all places."""
        best = np.full(len(self.bias), -np.inf, np.float32)
        for _, k, z in self._convolved(whole, begin):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            best[part] = np.maximum(best[part], z.max(axis=0))
        return best + self.bias

    def places(self, whole: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Where the greatest response of each filter is; the first of equal ones."""
        best = np.full(len(self.bias), -np.inf, np.float32)
        found = np.zeros(len(self.bias), np.int64)
        for at, k, z in self._convolved(whole, begin):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            p = z.argmax(axis=0)
            value = z[p, np.arange(FILTERS)]
            found[part] = np.where(value > best[part], at + p, found[part])
            best[part] = np.maximum(best[part], value)
        return found

    def logit(self, whole: np.ndarray, begin: np.ndarray) -> float:
        return float(np.maximum(self.responses(whole, begin), 0) @ self.out + self.intercept[0])

    def arrays(self) -> list[np.ndarray]:
        """All that is learned step by step."""
        return [self.table, *self.filters, self.bias, self.out, self.intercept]

    def score(self, text: str | None) -> float:
        if self.prior is not None:
            return self.prior
        whole, begin, words = word_ids(text)
        middle = self.middle.get(guessed_language(words), self.middle[-1])
        return float(1 / (1 + np.exp(-np.clip(self.logit(whole, begin) - middle, -50, 50))))


class Learning:
    """A model that learns text by text; each number moves at a pace set by the squares of its gradients so far."""

    def __init__(self, model: Model, seen: list[np.ndarray] | None = None):
        self.model = model
        self.seen = seen or [np.full(a.shape, 1e-3, np.float32) for a in model.arrays()]

    def _move(self, k: int, gradient: np.ndarray, rows=slice(None)) -> None:
        array, square = self.model.arrays()[k], self.seen[k]
        square[rows] += gradient * gradient
        array[rows] -= RATE * gradient / np.sqrt(square[rows])

    def step(self, whole: np.ndarray, begin: np.ndarray, y: float, weight: float) -> None:
        model = self.model
        pooled = np.maximum(model.responses(whole, begin), 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.intercept[0], -30, 30)))
        error = np.float32((p - y) * weight)
        if abs(error) < 0.02:
            return
        back = error * model.out * (pooled > 0)
        places, n, edge = model.places(whole, begin), len(whole), max(WIDTHS) - 1
        touched, gradients = [], []
        for k, w in enumerate(model.filters):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            at = places[part][:, None] + np.arange(len(w)) - edge  # filter, offset: place among the words
            inside = (at >= 0) & (at < n)
            windows = np.zeros((*at.shape, DIM), np.float32)  # filter, offset, dim
            windows[inside] = model.table[whole[at[inside]]] + model.table[begin[at[inside]]]
            touched.append(at[inside])
            gradients.append(np.einsum("odf,f->fod", w, back[part])[inside])
            self._move(1 + k, np.einsum("fod,f->odf", windows, back[part]))
        words, gradients = np.concatenate(touched), np.concatenate(gradients)
        for ids in (whole[words], begin[words]):
            rows, where = np.unique(ids, return_inverse=True)
            gradient = np.zeros((len(rows), DIM), np.float32)
            np.add.at(gradient, where, gradients)
            self._move(0, gradient, rows)
        self._move(-3, back)
        self._move(-2, error * pooled)
        self._move(-1, np.array([error], np.float32))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """A model from labelled texts. Every fourth of either label is kept for the calibration. Texts of one label alone, or none, give a
    model that scores all texts alike."""
    return _trained(texts, labels, epochs, seed).model


def _trained(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Learning:
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    model = Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, total).astype(np.float32),
    )
    learning = Learning(model)
    if len(set(labels)) < 2:
        model.prior = float(labels[0]) if labels else 0.0
        return learning
    data = [word_ids(t) for t in texts]
    y = np.array(labels, float)
    checked = np.zeros(len(data), bool)
    for label in (0.0, 1.0):
        checked[np.flatnonzero(y == label)[::4]] = True
    fit = np.flatnonzero(~checked).tolist()
    weight = {c: len(fit) / (2 * max(1, sum(y[i] == c for i in fit))) for c in (0.0, 1.0)}
    for _ in range(epochs):
        for i in rng.permutation(fit):
            learning.step(*data[i][:2], y[i], weight[y[i]])
    kept = np.flatnonzero(checked)
    model.middle = _middles(
        [guessed_language(data[i][2]) for i in kept], [model.logit(*data[i][:2]) for i in kept], y[kept], 1 - y[kept]
    )
    return learning


def _middles(languages: list[int], values: list[float], toxic: list[int], clean: list[int]) -> dict[int, float]:
    """The middle of all rows (-1), and of each language with 10 or more of either label; rows are counted by label."""
    languages, values, toxic, clean = (np.array(a) for a in (languages, values, toxic, clean))
    middles = {-1: _middle(values, toxic, clean)}
    for language in np.unique(languages).tolist():
        own = languages == language
        if language >= 0 and min(toxic[own].sum(), clean[own].sum()) >= 10:
            middles[language] = _middle(values[own], toxic[own], clean[own])
    return middles


def _middle(values: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The value that parts the labels with the fewest errors, in the middle of the gap between its neighbours; 0 is
    taken where it does as well as any. Either label counts as if it were half of the rows."""
    if not toxic.sum() or not clean.sum():
        return 0.0
    ordered, where = np.unique(values, return_inverse=True)
    # Share of the toxic below each value and of the others from it on.
    below = np.concatenate([[0], np.cumsum(np.bincount(where, toxic))]) / toxic.sum()
    above = 1 - np.concatenate([[0], np.cumsum(np.bincount(where, clean))]) / clean.sum()
    cuts = np.concatenate([[0.0], (ordered[1:] + ordered[:-1]) / 2])
    at = np.searchsorted(ordered, cuts)
    errors = np.round(below[at] + above[at], 12)
    return float(cuts[np.lexsort((np.abs(cuts), errors))[0]])


def _greatest(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from; of several of a document the greatest counts."""
    return (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )


def training_sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, chars: int = SAMPLE_CHARS) -> tuple[list, list]:
    """Texts and labels, each labels of 0 and of 1 at most, from documents of chars characters at most that are not held
    out."""
    known = learnable(_greatest(labels), docs, chars)
    chosen = least_hashed(known.where("toxic = 0"), each).unionAll(least_hashed(known.where("toxic = 1"), each))
    rows = with_text(docs.select("doc_id", "text"), chosen, chars).orderBy(F.xxhash64("doc_id", "text")).collect()
    return [r["text"] for r in rows], [int(r["toxic"]) for r in rows]


def learn_from_all(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, learner_chars: int = LEARNER_CHARS) -> Model:
    """A model that has learned from the whole text of every labelled document that is not held out.

    Documents are dealt into PARTS by their id. A bounded sample gives a first model; all documents of a part but the
    last teach it in a round, many tasks at once, whose models are merged for the next round. Those of the last part
    settle by counts what response is toxic.
    """
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(PARTS))
    texts = docs.where(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    known = written(_greatest(labels), "toxic")
    counted = texts.select("doc_id", F.length("text").alias("n")).join(known, "doc_id").groupBy("toxic")
    rows = {int(r["toxic"]): r for r in counted.agg(F.count("n").alias("rows"), F.sum("n").alias("chars")).collect()}
    if len(rows) < 2:
        return train([""] * len(rows), list(rows))
    learning = _trained(*training_sample(texts.where(part < PARTS - 1), known, each))
    learning.model.prior = None
    learning.model.middle.setdefault(-1, 0.0)
    total = sum(r["rows"] for r in rows.values())
    weight = {label: total / (2 * r["rows"]) for label, r in rows.items()}
    tasks = sum(r["chars"] for r in rows.values()) // (PARTS * learner_chars) + 1

    def labelled(k: int) -> DataFrame:
        # Whose task a document is depends on its id alone, so reruns learn alike.
        own = texts.where(part == k).repartition(tasks, "doc_id")
        return own.join(known.where(part == k).repartition(tasks, "doc_id").hint("shuffle_hash"), "doc_id")

    for k in range(PARTS - 1):
        learning = _round(labelled(k).sortWithinPartitions(F.xxhash64("doc_id", "text"), "doc_id"), learning, weight)
    counts = _responses(labelled(PARTS - 1), learning.model).collect()
    toxic, clean = [r["toxic"] for r in counts], [r["rows"] - r["toxic"] for r in counts]
    if any(toxic) and any(clean):  # Of a few documents the last part may have one label only.
        learning.model.middle = _middles([r["language"] for r in counts], [r["step"] / STEPS for r in counts], toxic, clean)
    return learning.model


def _round(rows: DataFrame, start: Learning, weight: dict[int, float]) -> Learning:
    """What all tasks learned from their rows, each in order and from the same start.

    A number of the model moves by the mean of its moves in the tasks, weighted by the squared gradients that moved it:
    a word that one task alone has met moves as it did there.
    """
    shared = rows.sparkSession.sparkContext.broadcast((vars(start.model), start.seen))

    def learn(batches):
        fields, seen = copy.deepcopy(shared.value)
        own = Learning(Model(**fields), seen)
        before = _flat(own.model.arrays()), _flat(own.seen)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own.step(*word_ids(text)[:2], float(toxic), weight[toxic])
        moved, gain = _flat(own.model.arrays()) - before[0], _flat(own.seen) - before[1]
        blocks = [b for b in range(0, len(gain), BLOCK) if gain[b : b + BLOCK].any()]
        task = TaskContext.get().partitionId()
        columns = [[task] * len(blocks), blocks, *([a[b : b + BLOCK] for b in blocks] for a in (moved, gain))]
        types = [pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.float32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["task", "block", "moved", "gain"])

    def merge(group: pa.Table) -> pa.Table:
        group = group.sort_by("task")
        moved, gain = (np.array(group[c].to_pylist(), float) for c in ("moved", "gain"))
        weights = gain / np.maximum(gain.sum(axis=0), 1e-30)
        merged = [(weights * a).sum(axis=0).astype(np.float32) for a in (moved, gain)]
        return pa.table(
            {"block": group["block"][:1].combine_chunks(), **{c: pa.array([a], pa.list_(pa.float32())) for c, a in zip(("moved", "gain"), merged)}}
        )

    learned = rows.select("text", F.col("toxic").cast("int")).mapInArrow(
        learn, "task int, block int, moved array<float>, gain array<float>"
    )
    numbers, squares = _flat(start.model.arrays()), _flat(start.seen)
    for r in learned.groupBy("block").applyInArrow(merge, "block int, moved array<float>, gain array<float>").collect():
        here = slice(r["block"], r["block"] + BLOCK)
        numbers[here] += np.array(r["moved"], np.float32)
        squares[here] += np.array(r["gain"], np.float32)
    result = copy.deepcopy(start)
    for flat, arrays in ((numbers, result.model.arrays()), (squares, result.seen)):
        ends = np.cumsum([a.size for a in arrays])[:-1]
        for a, values in zip(arrays, np.split(flat, ends)):
            a[...] = values.reshape(a.shape)
    return result


def _flat(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([a.ravel() for a in arrays])


def _responses(rows: DataFrame, model: Model) -> DataFrame:
    """How many rows, and how many toxic ones, have a response: by guessed language and steps of the response. A score
    tells no responses beyond 50 apart, so there are at most 100 * STEPS of a language, however many rows."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))

    def columns(text, toxic):
        model = Model(**shared.value)
        found = [word_ids(t) for t in text]
        steps = [round(float(np.clip(model.logit(whole, begin), -50, 50)) * STEPS) for whole, begin, _ in found]
        return {"language": [guessed_language(words) for *_, words in found], "step": steps, "toxic": toxic}

    placed = map_batches(rows.select("text", F.col("toxic").cast("int")), columns, "language int, step int, toxic int")
    return placed.groupBy("language", "step").agg(F.count(F.lit(1)).alias("rows"), F.sum("toxic").alias("toxic"))


def score_toxicity(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """Per row doc_id, held_out, score and predicted (1 from a score of 0.5), by a model that learns from all labelled
    documents that are not held out; each bounds the sample of either label that its first state comes from.

    Scores depend on the text alone. Null and empty texts are scored as texts without words; repeated rows alike.
    Without labels all scores are 0, with labels of one kind alone all scores are that label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(learn_from_all(docs, labels, each)))

    def columns(doc_id, held_out, text):
        model = Model(**shared.value)
        scores = [model.score(t) for t in text]
        return {"doc_id": doc_id, "held_out": held_out, "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, columns, "doc_id bigint, held_out boolean, score double, predicted int")
