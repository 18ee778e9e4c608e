"""Quality by co-training: a classifier of the text and one of the page's metadata teach each other.

The text view has hashed words and their shapes. The metadata view has source, language, stated length and the layout
of the page: lines and their lengths, and the shares of kinds of characters. Both are logistic units on a bounded
labelled sample. Over some rounds, each view labels those of a bounded pool of unlabelled documents that it is most sure
of, for the other view. In the end either view's log-odds are calibrated on labelled rows that no view was trained on,
and added up, the odds of the labels being counted once.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorthread.llm.common import map_batches
from sensorthread.llm.labelled import learnable, least_hashed, with_text

BUCKETS = 1 << 14
META = 1 << 10
#: The samples: labelled documents of each label, unlabelled ones, and characters of a document at most.
SAMPLE_EACH = 1200
POOL = 2_000
SAMPLE_CHARS = 8_000
ROUNDS = 4
#: Documents that a view may label for the other in a round, of each label, and how sure it must be.
EXCHANGE = 150
SURE = 0.95
#: Bytes of a text from which its layout is told in fine steps, and of the pieces whose compression is measured.
LONG = 200
PACK = 1 << 16
#: Words up to which the evidence of a text is discounted: a few words say little, and such documents stay.
FULL_WORDS = 80
#: Characters that count as a word in scripts without spaces, and bytes in any other run without white space.
UNSPACED_CHARS = 2
RUN_BYTES = 24
#: Documents that score less are rejected: lower than one half, so that doubtful ones stay.
LEAST_SCORE = 0.35

#: Thai, Lao, Tibetan, Burmese, Khmer; kana and ideographs.
_UNSPACED = re.compile("[\u0e01-\u0eff\u0f40-\u0fbc\u1000-\u109f\u1780-\u17d3\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

_SHAPE = bytes(
    97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 120 if b > 127 else b for b in range(256)
)


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: words and, apart from them, shapes of words, by the logarithm of their number."""
    raw = text.encode("utf-8", "surrogatepass").split() if text else []
    words = [zlib.crc32(w) % (BUCKETS // 2) for w in raw]
    shapes = [BUCKETS // 2 + zlib.crc32(_squeezed(w)) % (BUCKETS // 2) for w in raw]
    ids, counts = np.unique(np.array(words + shapes, np.int64), return_counts=True)
    values = np.log1p(counts).astype(np.float64)
    size = np.sqrt((values * values).sum())
    return ids, values / size if size else values


def full_share(text: str | None) -> float:
    """How much of FULL_WORDS a text has, 1 at most: words between any white space, as text_view splits them. Where they
    are fewer, characters of scripts without spaces and bytes of long runs count too."""
    words = text.encode("utf-8", "surrogatepass").split(None, FULL_WORDS) if text else []
    n = len(words)
    if 0 < n < FULL_WORDS:
        unspaced = sum(1 for _ in islice(_UNSPACED.finditer(text), UNSPACED_CHARS * FULL_WORDS))
        n = max(n, unspaced / UNSPACED_CHARS, sum(map(len, words)) / RUN_BYTES)
    return min(1.0, n / FULL_WORDS)


def _squeezed(word: bytes) -> bytes:
    """Kinds of characters, runs of one kind as one."""
    shape = word.translate(_SHAPE)
    return bytes(b for i, b in enumerate(shape) if not i or b != shape[i - 1])


def metadata_view(text: str | None, source, lang, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: one for each of source, language, stated length and the layout's figures in steps."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    long = size >= LONG
    lines = raw.split(b"\n")
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=5) / size
    figures = [
        ("source", source),
        ("lang", lang),
        ("chars", None if n_chars is None else int(np.log2(max(1, n_chars)) * 2)),
        ("lines", int(np.log2(len(lines)) * 2)),
        ("line", int(np.log2(size / len(lines)) * 2)),
        ("distinct lines", int(8 * len(set(lines)) / len(lines))),
        ("packed", int(20 * sum(len(zlib.compress(raw[i : i + PACK], 1)) for i in range(0, len(raw), PACK)) / size) if long else None),
        *[(f"kind {k}", int(np.log2(1e-2 + share) * (2 if long else 1))) for k, share in enumerate(kinds)],
    ]
    ids = np.unique([zlib.crc32(repr(f).encode()) % META for f in figures])
    return ids, np.full(len(ids), len(ids) ** -0.5)


_KIND = np.array(
    [0 if chr(b).islower() and b < 128 or b > 127 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b <= 32 else 4 for b in range(256)],
    np.int64,
)


@dataclass
class Rows:
    """Sparse rows one after another."""

    ids: np.ndarray
    values: np.ndarray
    owner: np.ndarray
    n: int

    @staticmethod
    def of(views: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        empty = np.empty(0)
        return Rows(
            np.concatenate([v[0] for v in views] or [empty.astype(np.int64)]).astype(np.int64),
            np.concatenate([v[1] for v in views] or [empty]),
            np.repeat(np.arange(len(views)), [len(v[0]) for v in views]),
            len(views),
        )

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.values * weights[self.ids], minlength=self.n)


def _fit(rows: Rows, y: np.ndarray, use: np.ndarray, size: int, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic unit on the used rows, both labels counting alike."""
    weights, square, intercept, square_i = np.zeros(size), np.full(size, 1e-4), 0.0, 1e-4
    share = np.where(use, np.where(y > 0, 0.5 / max(1, (use & (y > 0)).sum()), 0.5 / max(1, (use & (y <= 0)).sum())), 0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows.times(weights) + intercept, -30, 30)))
        error = share * (p - y)
        g = np.bincount(rows.ids, rows.values * error[rows.owner], minlength=size) + 1e-5 * weights
        square += g * g
        weights -= 0.5 * g / np.sqrt(square)
        square_i += error.sum() ** 2
        intercept -= 0.5 * error.sum() / np.sqrt(square_i)
    return weights, float(intercept)


def _calibrated(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept of the log-odds of y by the value, both labels counting alike."""
    a, b, centre, spread = 1.0, 0.0, float(value.mean()), float(value.std()) or 1.0
    x = (value - centre) / spread
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    soft = np.where(y > 0, 1 - 1 / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    for _ in range(500):
        error = share * (1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))) - soft)
        a = max(0.0, a - 2.0 * float((error * x).sum()))
        b -= 2.0 * float(error.sum())
    return a / spread, b - a * centre / spread


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_line: tuple[float, float]
    meta_line: tuple[float, float]
    prior: float | None = None  # score of all documents, if there is one label only

    def score(self, text, source, lang, n_chars) -> float:
        if self.prior is not None:
            return self.prior
        ids, values = text_view(text)
        odds = self.text_line[0] * float(self.text[ids] @ values) + self.text_line[1]
        ids, values = metadata_view(text, source, lang, n_chars)
        odds += self.meta_line[0] * float(self.meta[ids] @ values) + self.meta_line[1]
        odds *= full_share(text)
        return float(1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def co_train(labelled: list[tuple], pool: list[tuple], rounds: int = ROUNDS) -> Model:
    """labelled: (text, source, lang, n_chars, label); pool: the same without labels. Every fourth row of either label is
    kept for the calibration. Rows of one label alone, or none, give a model that scores all documents alike."""
    y0 = np.array([r[4] for r in labelled], float)
    if len(set(y0)) < 2:
        return Model(np.zeros(BUCKETS), np.zeros(META), (0.0, 0.0), (0.0, 0.0), float(y0[0]) if len(y0) else 1.0)
    everything = [r[:4] for r in labelled] + [r[:4] for r in pool]
    views = [Rows.of([text_view(r[0]) for r in everything]), Rows.of([metadata_view(*r) for r in everything])]
    sizes = (BUCKETS, META)
    n = len(labelled)
    known = np.arange(len(everything)) < n
    kept = known.copy()
    for label in (0.0, 1.0):
        own = np.flatnonzero(y0 == label)
        kept[np.delete(own, np.s_[::4])] = False
    y = [np.concatenate([y0, np.zeros(len(pool))]) for _ in views]
    use = [known & ~kept for _ in views]
    for left in range(rounds, -1, -1):
        fits = [_fit(v, a, u, s) for v, a, u, s in zip(views, y, use, sizes)]
        if not left:
            break
        odds = [v.times(w) + b for v, (w, b) in zip(views, fits)]
        for me, other in ((0, 1), (1, 0)):
            line = _calibrated(odds[me][kept], y[me][kept])
            p = 1 / (1 + np.exp(-np.clip(line[0] * odds[me] + line[1], -50, 50)))
            free = ~known & ~use[other]
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-np.where(free, sure, -1), kind="stable")[:EXCHANGE]
                best = best[free[best] & (sure[best] >= SURE)]
                use[other][best] = True
                y[other][best] = label
    lines = [_calibrated((v.times(w) + b)[kept], y[0][kept]) for v, (w, b) in zip(views, fits)]
    lines = [(a, c + a * b) for (a, c), (_, b) in zip(lines, fits)]
    return Model(fits[0][0], fits[1][0], *lines)


_COLUMNS = ["text", "source", "lang", "n_chars"]


def training_samples(
    docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, pool: int = POOL, chars: int = SAMPLE_CHARS
) -> tuple[list[tuple], list[tuple]]:
    """Labelled rows, each of either label at most, and unlabelled ones, pool at most: documents of chars characters at
    most, with the least hashes of their ids. Of several labels of a document the least counts."""
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = learnable(known, docs, chars)
    chosen = least_hashed(usable.where("quality = 0"), each).unionAll(least_hashed(usable.where("quality = 1"), each))
    free = docs.where(F.length("text") <= chars).select("doc_id").distinct().join(known, "doc_id", "left_anti")
    own = docs.select("doc_id", *_COLUMNS)
    order = F.xxhash64("doc_id", "text")
    with_label = with_text(own, chosen, chars).orderBy(order).select(*_COLUMNS, "quality").collect()
    without = with_text(own, least_hashed(free, pool), chars).orderBy(order).select(*_COLUMNS).collect()
    return [tuple(r) for r in with_label], [tuple(r) for r in without]


def trained(docs: DataFrame, labels: DataFrame, **bounds: int) -> dict:
    return vars(co_train(*training_samples(docs, labels, **bounds)))


def score_quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE, **bounds: int) -> DataFrame:
    """Per row doc_id, score (0 to 1) and kept (whether the score reaches least).

    Null and empty texts score one half: nothing speaks against them. Repeated rows are scored alike. Without labels
    all score 1, with labels of one kind alone all score that label.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **bounds))

    def columns(doc_id, text, source, lang, n_chars):
        model = Model(**shared.value)
        scores = [model.score(*row) for row in zip(text, source, lang, n_chars)]
        return {"doc_id": doc_id, "score": scores, "kept": [s >= least for s in scores]}

    return map_batches(docs.select("doc_id", *_COLUMNS), columns, "doc_id bigint, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE, **bounds: int) -> DataFrame:
    """The rows that score_quality keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, **bounds))
    places = [docs.columns.index(c) for c in _COLUMNS]

    def run(batches):
        model = Model(**shared.value)
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in places))
            yield batch.filter(pa.array([model.score(*row) >= least for row in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
