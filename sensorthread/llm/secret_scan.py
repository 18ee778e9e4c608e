"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags tokens (runs without spaces, quotes and separators) as the beginning of a secret, inside of one, or
outside. Its features are the token's shape, the words and separators beside it, and a few of the whole text. It is
trained in numpy on a bounded sample whose tags come from the patterns, and on variants of it that no pattern matches:
assigned secrets under an ordinary word and drawn anew in other forms, and words, numbers and paths in their place. So neither key
words nor the patterns' alphabets are enough to tell a secret. It is decoded by Viterbi. Tokens that are outside
whatever their neighbours are, by a bound on the weights, are settled at once; the rest are decoded in the runs that
remain, which gives the same tags.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorthread.llm.common import map_batches

#: The base patterns, in the order of kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "field")

#: The training sample: documents with a base span, as many without, and characters of a document at most.
SAMPLE_EACH = 400
SAMPLE_CHARS = 8_000
WINDOW = 24
ROUNDS = 120
WORDS = 1 << 12
#: What secrets of variants are drawn from, their lengths, and the characters kept on both sides of them.
FORMS = (
    string.hexdigits[:16],
    string.hexdigits[:10] + string.hexdigits[16:],
    string.ascii_uppercase + string.digits,
    string.ascii_letters + string.digits,
    string.ascii_letters + string.digits + "-_",
)
LENGTHS = (12, 48)
#: Forms of what is no secret in their place: words (w), numbers of up to so many digits, and signs.
PLAIN = ("w", "w", "w", "4", "8", "4-2-2", "1.2.2", "w-2", "w.2", "w_w", "w/w.w", "w@w.w")
BESIDE = 200

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS[:-1] + "{%d,}" % (LEAST_ACCESS - 4))
_HEX = re.compile(HEX[:-1] + "{%d,}" % LEAST_HEX)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[int, str, int, int]  # place of the kind in KINDS, kind, start, end

#: Classes of characters: 0 space, 1 quote or separator, 2 a-f, 3 other lower case, 4 upper case, 5 digit, 6 sign within
#: a token, 7 any other.
_CLASS = np.full(128, 1, np.uint8)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = (
        0 if _s.isspace() else 2 if _s in "abcdef" else 3 if _s.islower() else 4 if _s.isupper() else 5 if _s.isdigit()
        else 6 if _s in "+/_-.@" else 1
    )


def base_spans(text: str) -> list[tuple[Span, int]]:
    """The spans of the base patterns, each with the place where the secret itself begins."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                found.append(((0, "assign", m.start(), m.end()), m.start(2)))
    if "AKIA" in text:
        found += [((1, "access", m.start(), m.end()), m.start()) for m in _ACCESS.finditer(text)]
    found += [((2, "hex", m.start(), m.end()), m.start()) for m in _HEX.finditer(text)]
    return found


@dataclass
class Tokens:
    points: np.ndarray  # of the text
    start: np.ndarray
    end: np.ndarray
    small: np.ndarray  # token, feature: weights that are few

    def words(self, which: np.ndarray) -> np.ndarray:
        """Hashes of the tokens asked for, letters in either case alike."""
        if not len(which):
            return np.empty(0, np.int64)
        length = (self.end - self.start)[which]
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        place = np.arange(length.sum()) - np.repeat(first, length)
        low = self.points[np.repeat(self.start[which], length) + place].astype(np.uint64) | np.uint64(32)
        sums = np.add.reduceat(low * _POWERS[place & 63], first)
        return ((sums ^ (sums >> np.uint64(29))) % np.uint64(WORDS)).astype(np.int64)


#: Sizes of the small features: length, mix of classes, changes of class, share of digits, separators before and after,
#: length of the text, assignments in the text.
SMALL = (12, 64, 6, 5, 16, 16, 5, 4)
_FIRST = np.concatenate(([0], np.cumsum(SMALL)))
_POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64))


def tokenised(text: str) -> Tokens:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.full(len(points), 7, np.uint8)
    plain = points < 128
    kind[plain] = _CLASS[points[plain]]
    inside = kind > 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    start, end = edge[::2], edge[1::2]
    n = len(start)
    if not n:
        return Tokens(points, start, end, np.zeros((0, len(SMALL)), np.int64))
    length = end - start
    at = np.flatnonzero(inside)
    owner = np.repeat(np.arange(n), length)
    counts = np.bincount(owner * 8 + kind[at], minlength=8 * n).reshape(n, 8)
    change = np.concatenate(([0], np.cumsum(kind[1:] != kind[:-1])))
    changes = change[end - 1] - change[start]
    has = counts > 0
    mix = has[:, 2] + 2 * has[:, 3] + 4 * has[:, 4] + 8 * has[:, 5] + 16 * has[:, 6] + 32 * has[:, 7]
    # What stands between tokens: bits for a line break, an equals sign, a colon, a quote.
    bits = np.zeros(len(points) + 1, np.int64)
    gap = np.flatnonzero(~inside)
    code = points[gap]
    for bit, chars in ((1, (10,)), (2, (61,)), (4, (58,)), (8, (34, 39))):
        bits[gap[np.isin(code, chars)]] |= bit
    before = np.zeros(n, np.int64)
    after = np.zeros(n, np.int64)
    marked = np.flatnonzero(bits)
    if len(marked):
        nxt = np.searchsorted(start, marked)  # the token that follows
        np.bitwise_or.at(before, nxt[nxt < n], bits[marked[nxt < n]])
        np.bitwise_or.at(after, nxt[nxt > 0] - 1, bits[marked[nxt > 0]])
    assigns = int((points == 61).sum())
    small = np.stack(
        [
            np.searchsorted((2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64), length, side="left"),
            mix,
            np.minimum(changes, 5),
            np.searchsorted((1e-9, 0.2, 0.5, 0.95), counts[:, 5] / length, side="right"),
            before,
            after,
            np.full(n, np.searchsorted((100, 1_000, 10_000, 50_000), len(points))),
            np.full(n, np.searchsorted((1, 3, 10), assigns, side="right")),
        ],
        axis=1,
    )
    return Tokens(points, start, end, small + _FIRST[:-1])


@dataclass
class Field:
    """Weights of B and I against O: of small features, of the words before and after; and of pairs of tags (O, B, I)."""

    small: np.ndarray
    before: np.ndarray
    after: np.ndarray
    pairs: np.ndarray

    def most(self) -> tuple[np.ndarray, np.ndarray]:
        """What the tags beside a token can add at most to the score of B and of I, and what the words beside it can."""
        t = self.pairs
        gain = t[:, None, 1:] + t[1:, :].T[None] - t[:, :1, None] - t[0][None, :, None]
        ends = np.maximum((t[:, 1:] - t[:, :1]).max(axis=0), (t[1:] - t[:1]).max(axis=1))
        from_tags = np.maximum(np.maximum(gain.max(axis=(0, 1)), ends), 0)
        return from_tags, self.before.max(axis=0) + self.after.max(axis=0)

    def tags(self, tokens: Tokens, most: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """0 O, 1 B, 2 I by token, the best sequence. most: that of the field, if it is at hand."""
        n = len(tokens.start)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        from_tags, from_words = self.most() if most is None else most
        shape = self.small[tokens.small[:, 0]]
        for k in range(1, len(SMALL)):
            shape += self.small[tokens.small[:, k]]
        # Outside whatever words and tags are beside it; then, with the words known, whatever tags are.
        top = shape + (from_tags + from_words)
        live = np.flatnonzero((top[:, 0] >= 0) | (top[:, 1] >= 0))
        score = shape[live]
        score[live > 0] += self.before[tokens.words(live[live > 0] - 1)]
        score[live < n - 1] += self.after[tokens.words(live[live < n - 1] + 1)]
        open_still = (score + from_tags >= 0).any(axis=1)
        live, score = live[open_still], score[open_still]
        if not len(live):
            return tags
        for run in np.split(np.arange(len(live)), np.flatnonzero(np.diff(live) > 1) + 1):
            first, last = live[run[0]], live[run[-1]]
            tags[first : last + 1] = self._viterbi(score[run], first > 0, last < n - 1)
        return tags

    def _viterbi(self, score: np.ndarray, after_o: bool, before_o: bool) -> np.ndarray:
        """The best tags of a run between tokens that are outside, or the ends of the text."""
        best = np.concatenate(([0.0], score[0])) + (self.pairs[0] if after_o else 0)
        back = []
        for row in score[1:]:
            paths = best[:, None] + self.pairs
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + np.concatenate(([0.0], row))
        if before_o:
            best = best + self.pairs[:, 0]
        tags = [int(best.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return np.array(tags[::-1], np.int8)


def variants(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """For each assigned secret two texts around it, with where their own secrets begin and end: one with another secret
    under a word of the text, and one with what is no secret in its place."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    made = []
    for (_, kind, start, end), begin in base_spans(text):
        if kind != "assign":
            continue
        left, right = text[max(0, start - BESIDE) : start], text[end : end + BESIDE]
        between = text[_ASSIGN.match(text, start).end(1) : begin]
        words = re.findall(r"[^\W\d_]+", left + right) or ["value"]
        secret = "".join(rng.choices(rng.choice(FORMS), k=rng.randint(*LENGTHS)))
        head = left + rng.choice(words) + between
        made.append((head + secret + right, [(len(head), len(head) + len(secret))]))
        plain = [rng.choice(words) if part == "w" else str(rng.randrange(10 ** int(part))) if part.isdigit() else part
                 for part in rng.choice(PLAIN)]
        made.append((left + rng.choice(words) + between + "".join(plain) + right, []))
    return made


def train(texts: list[str], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4) -> Field | None:
    """A field that gives texts the tags of their base spans, and their variants those of their secrets, by gradient
    ascent on the likelihood; None without any.

    Texts are cut into windows of WINDOW tokens, the last of each filled up with places that count for nothing; all
    windows with a secret and all of variants count, and others up to four times as many as have a secret.
    """
    rows, golds, sizes = [], [], []
    examples = [(text, []) for text in texts]
    examples += [variant for text in texts for variant in variants(text)]
    own_windows = 0
    for i, (text, secrets) in enumerate(examples):
        tokens = tokenised(text)
        n = len(tokens.start)
        word = tokens.words(np.arange(n))
        gold = np.zeros(n, np.int64)
        for begin, end in secrets + [(begin, span[3]) for span, begin in base_spans(text)]:
            own = np.flatnonzero((tokens.start < end) & (tokens.end > begin))
            gold[own] = np.where(gold[own] == 1, 1, 2)
            gold[own[:1]] = 1
        before = np.concatenate(([WORDS], word[:-1]))
        after = np.concatenate((word[1:], [WORDS]))
        for s in range(0, n, WINDOW):
            e = min(s + WINDOW, n)
            fill = WINDOW - (e - s)
            row = np.concatenate([tokens.small[s:e], before[s:e, None], after[s:e, None]], axis=1)
            rows.append(np.pad(row, ((0, fill), (0, 0))))
            golds.append(np.pad(gold[s:e], (0, fill)))
            sizes.append(e - s)
        own_windows = len(rows) if i < len(texts) else own_windows
    with_secret = [i for i, g in enumerate(golds) if g.any()]
    if not with_secret:
        return None
    others = [i for i, g in enumerate(golds[:own_windows]) if not g.any()]
    chosen = with_secret + others[:: max(1, len(others) // (4 * len(with_secret)))]
    chosen += [i for i in range(own_windows, len(golds)) if not golds[i].any()]
    x = np.stack([rows[i] for i in chosen])  # window, place, feature
    gold = np.stack([golds[i] for i in chosen])
    real = np.arange(WINDOW) < np.array([sizes[i] for i in chosen])[:, None]
    small, before, after = x[:, :, : len(SMALL)], x[:, :, -2], x[:, :, -1]
    weights = [np.zeros((_FIRST[-1], 2)), np.zeros((WORDS + 1, 2)), np.zeros((WORDS + 1, 2)), np.zeros((3, 3))]
    square = [np.full(w.shape, 1e-2) for w in weights]
    hot = np.eye(3)[gold]
    pairs_seen = np.einsum("wpa,wpb->ab", hot[:, :-1], hot[:, 1:] * real[:, 1:, None])
    for _ in range(rounds):
        score = np.zeros(gold.shape + (3,))
        score[:, :, 1:] = weights[0][small].sum(axis=2) + weights[1][before] + weights[2][after]
        potential = np.exp(np.clip(weights[3], -20, 20))
        local = np.exp(score - score.max(axis=2, keepdims=True))
        forward, backward = np.zeros_like(local), np.ones_like(local)
        forward[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
        for p in range(1, gold.shape[1]):
            forward[:, p] = (forward[:, p - 1] @ potential) * local[:, p]
            forward[:, p] /= forward[:, p].sum(axis=1, keepdims=True)
        for p in range(gold.shape[1] - 2, -1, -1):
            backward[:, p] = (backward[:, p + 1] * local[:, p + 1]) @ potential.T
            backward[:, p] /= backward[:, p].sum(axis=1, keepdims=True)
            backward[~real[:, p + 1], p] = 1  # the text ends at p or before
        single = forward * backward
        single /= single.sum(axis=2, keepdims=True)
        double = forward[:, :-1, :, None] * potential * (local * backward)[:, 1:, None, :]
        double /= double.sum(axis=(2, 3), keepdims=True)
        double *= real[:, 1:, None, None]
        error = (hot - single)[:, :, 1:] * real[:, :, None]
        gradients = []
        for index, w in ((small, weights[0]), (before, weights[1]), (after, weights[2])):
            spread = error[:, :, None, :] if index.ndim == 3 else error
            spread = np.broadcast_to(spread, index.shape + (2,))
            gradients.append(
                np.stack([np.bincount(index.ravel(), spread[..., k].ravel(), minlength=len(w)) for k in (0, 1)], axis=1)
            )
        gradients.append(pairs_seen - double.sum(axis=(0, 1)))
        for w, s, g in zip(weights, square, gradients):
            g = g - decay * len(gold) * w
            s += g * g
            w += rate * g / np.sqrt(s)
    return Field(weights[0], weights[1][:WORDS], weights[2][:WORDS], weights[3])


def found_spans(text: str | None, field: Field | None, most: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[Span, int]]:
    """All spans by start and kind, each with the place where the secret itself begins. Those of the field that touch
    no base span are added."""
    if not text:
        return []
    spans = base_spans(text)
    if field is not None:
        tokens = tokenised(text)
        tags = field.tags(tokens, most)
        at = np.flatnonzero(tags)
        if len(at):
            taken = [(s[2], s[3]) for s, _ in spans]
            begins = np.flatnonzero((tags[at] == 1) | (np.diff(at, prepend=-2) > 1))
            for run in np.split(at, begins[1:]):
                start, end = int(tokens.start[run[0]]), int(tokens.end[run[-1]])
                if all(end <= s or start >= e for s, e in taken):
                    spans.append(((3, "field", start, end), start))
    return sorted(spans, key=lambda x: (x[0][2], x[0][0]))


def with_base_span(text: Column) -> Column:
    """Whether base_spans finds anything: cheap tests come first, the patterns only where they may hold."""
    low = F.lower(text)
    word = F.lit(False)
    for part in ("passw", "secret", "token", "apikey", "api_key"):
        word = word | F.contains(low, F.lit(part))
    # As base_spans does, matches are found one after another first, and then the short ones are left out.
    values = F.regexp_extract_all(text, F.lit("(?i)" + ASSIGN), F.lit(2))
    assign = word & F.exists(values, lambda v: F.length(v) >= LEAST_ASSIGN)
    access = F.contains(text, F.lit("AKIA")) & F.rlike(text, F.lit(_ACCESS.pattern))
    return assign | access | F.rlike(text, F.lit(_HEX.pattern))


def training_sample(docs: DataFrame, each: int = SAMPLE_EACH, chars: int = SAMPLE_CHARS) -> list[str]:
    """Texts that hold a base span and others, each texts at most of either, those with the least hashes among texts of
    chars characters at most. Only hashes are sorted and broadcast, and copies of a text count once."""
    spanned = with_base_span(F.col("text"))
    texts = docs.where(F.length("text") <= chars).select("text", F.xxhash64("text").alias("text_hash"))
    found = []
    for condition in (spanned, ~spanned):
        least = texts.where(condition).select("text_hash").distinct().orderBy("text_hash").limit(each)
        chosen = texts.join(F.broadcast(least), "text_hash").groupBy("text_hash").agg(F.first("text").alias("text"))
        found += [row["text"] for row in chosen.orderBy("text_hash").collect()]
    return found


def field_of(docs: DataFrame, each: int = SAMPLE_EACH) -> Field | None:
    return train(training_sample(docs, each))


def find_secrets(docs: DataFrame, learned_from: DataFrame | None = None) -> DataFrame:
    """Per row doc_id and spans, an array of (kind, start, end, secret): code points, end exclusive, secret where the
    secret itself begins. Null texts have none; repeated rows have the same ones."""
    field = field_of(docs if learned_from is None else learned_from)
    shared = docs.sparkSession.sparkContext.broadcast(field and vars(field))

    def columns(doc_id, text):
        own = Field(**shared.value) if shared.value else None
        most = own and own.most()
        return {
            "doc_id": doc_id,
            "spans": [
                [{"kind": s[1], "start": s[2], "end": s[3], "secret": begin} for s, begin in found_spans(t, own, most)]
                for t in text
            ],
        }

    schema = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, secret: bigint>>"
    return map_batches(docs.select("doc_id", "text"), columns, schema)


def masked(text: str | None, spans: list[tuple[Span, int]], mask: str = "[secret]") -> str | None:
    """The text with the secrets of all spans replaced, overlapping ones by one mask."""
    if not spans:
        return text
    parts, done = [], 0
    for begin, end in sorted((begin, span[3]) for span, begin in spans):
        if begin >= done:
            parts += [text[done:begin], mask]
        done = max(done, end)
    return "".join(parts) + text[done:]


def redact(docs: DataFrame, learned_from: DataFrame | None = None) -> DataFrame:
    """The rows with all their columns and with secrets in text masked; n_chars, where there is one that is not null, is
    the length of the new text if it changed."""
    field = field_of(docs if learned_from is None else learned_from)
    shared = docs.sparkSession.sparkContext.broadcast(field and vars(field))
    names = docs.columns
    at, sized = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        own = Field(**shared.value) if shared.value else None
        most = own and own.most()
        for batch in batches:
            arrays = list(batch.columns)
            old = arrays[at].to_pylist()
            new = [masked(t, found_spans(t, own, most)) for t in old]
            arrays[at] = pa.array(new, arrays[at].type)
            if sized is not None:
                lengths = [
                    n if n is None or a == b else len(b) for n, a, b in zip(arrays[sized].to_pylist(), old, new)
                ]
                arrays[sized] = pa.array(lengths, arrays[sized].type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
