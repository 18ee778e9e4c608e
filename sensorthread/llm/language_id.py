"""Language identification by cross-parsing.

A suffix automaton per language holds every substring of a bounded sample of labelled text. A text is read against it
phrase by phrase, each phrase the longest match from where the last one ended. The language that needs the fewest
phrases wins, normalised by the bits that name a phrase of its sample and by the length of the text.

Texts are parsed in pieces, many pieces of all texts of a batch side by side, one symbol of each at a step.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorthread.llm.common import map_batches

#: The sample a language is learned from: documents, and characters of each.
SAMPLE_DOCS = 32
SAMPLE_CHARS = 600
#: Letters that are one symbol each. Rarer ones are several digits, the first of them from a set of its own.
LETTERS = 62
DIGITS = 16
NONE = 255
#: Symbols of a piece; a phrase ends at the end of its piece.
PIECE = 1024


@dataclass
class Parser:
    languages: list[str]
    symbol_of: np.ndarray  # by code point; 0: no letter, 1: in no sample; rows filled up with NONE if any has digits
    step: np.ndarray  # flat: state * symbols + symbol -> state, or -1
    first: np.ndarray  # language, symbol -> state after a phrase that starts with the symbol
    idle: np.ndarray  # language -> the state before any phrase
    bits: np.ndarray  # language -> bits that name a phrase
    symbols: int


def suffix_automaton(text: np.ndarray, symbols: int) -> np.ndarray:
    """Transitions of the automaton of all substrings: state, symbol -> state or -1. State 0 is the start."""
    following = np.full((2 * len(text) + 2, symbols), -1, np.int32)
    length, link, size, last = [0], [-1], 1, 0
    for c in text.tolist():
        new, p = size, last
        size += 1
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and following[p, c] < 0:
            following[p, c] = new
            p = link[p]
        if p >= 0:
            q = int(following[p, c])
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = size
                size += 1
                length.append(length[p] + 1)
                link.append(link[q])
                following[twin] = following[q]
                while p >= 0 and following[p, c] == q:
                    following[p, c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return following[:size]


def encoded(text: str, symbol_of: np.ndarray) -> np.ndarray:
    """Lower-cased letters as symbols, every run of other characters as one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = symbol_of[points]
    if len(symbols) > 1:
        letter = (symbols if symbols.ndim == 1 else symbols[:, 0]) > 0
        symbols = symbols[np.concatenate(([True], letter[1:] | letter[:-1]))]
    return symbols if symbols.ndim == 1 else symbols[symbols != NONE]


def learn(samples: dict[str, list[str]], letters: int = LETTERS) -> Parser | None:
    """A parser from texts by language; None if none has a letter."""
    is_letter = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    symbol_of = is_letter.astype(np.uint8)
    counts = np.zeros(sys.maxunicode + 1, np.int64)
    for texts in samples.values():
        for text in texts:
            points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            np.add.at(counts, points[is_letter[points]], 1)
    known = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    known, rare = known[:letters], np.sort(known[letters:])  # by code point, so that letters of a script share digits
    symbol_of[known] = np.arange(2, 2 + len(known), dtype=np.uint8)
    symbols = 2 + len(known)
    if len(rare):
        width = 2
        while DIGITS**width < len(rare):
            width += 1
        symbol_of = np.stack([symbol_of] + [np.full_like(symbol_of, NONE)] * (width - 1), axis=1)
        digits = np.arange(len(rare))[:, None] // DIGITS ** np.arange(width - 1, -1, -1) % DIGITS
        digits[:, 1:] += DIGITS
        symbol_of[rare] = symbols + digits
        symbols += 2 * DIGITS
    languages, tables, bits = [], [], []
    for language in sorted(samples):
        parts = [encoded(t, symbol_of) for t in samples[language]]
        joined = np.concatenate([np.append(p, 0) for p in parts]) if parts else np.empty(0, np.uint8)
        if joined.any():
            languages.append(language)
            tables.append(suffix_automaton(joined, symbols))
            bits.append(math.log2(len(joined) + 1))
    if not languages:
        return None
    first = np.zeros((len(languages), symbols), np.int64)
    idle = np.zeros(len(languages), np.int64)
    stacked, base = [], 0
    for k, t in enumerate(tables):
        idle[k] = base + len(t)  # one more state, which no symbol leads on from
        first[k] = np.where(t[0] >= 0, t[0] + base, idle[k])
        stacked += [np.where(t >= 0, t + base, -1).astype(np.int32), np.full((1, symbols), -1, np.int32)]
        base += len(t) + 1
    return Parser(languages, symbol_of, np.concatenate(stacked).ravel(), first, idle, np.array(bits), symbols)


def phrase_counts(texts: list[np.ndarray], parser: Parser, piece: int = PIECE) -> np.ndarray:
    """Phrases of each text by language."""
    owners, pieces = [], []
    for i, text in enumerate(texts):
        for start in range(0, len(text), piece):
            owners.append(i)
            pieces.append(text[start : start + piece])
    counts = np.zeros((len(texts), len(parser.languages)), np.int64)
    if not pieces:
        return counts
    sizes = np.array([len(p) for p in pieces])
    order = np.argsort(-sizes, kind="stable")
    lanes = np.zeros((sizes[order[0]], len(pieces)), np.int64)
    for lane, k in enumerate(order):
        lanes[: sizes[k], lane] = pieces[k]
    active = np.searchsorted(-sizes[order], -np.arange(len(lanes)), side="left")
    state = np.repeat(parser.idle[:, None], len(pieces), axis=1)
    phrases = np.zeros(state.shape, np.int64)
    for t in range(len(lanes)):
        n = active[t]
        symbol = lanes[t, :n]
        to = parser.step.take(state[:, :n] * parser.symbols + symbol)
        ended = to < 0
        phrases[:, :n] += ended
        state[:, :n] = np.where(ended, parser.first[:, symbol], to)
    np.add.at(counts, np.array(owners)[order], phrases.T)
    return counts


def training_sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Texts by language: of each language the docs_each labelled documents with the least hash of their doc_id, of each
    chars characters from a place that a hash of the doc_id gives."""
    places = F.greatest(F.length("text") - chars + 1, F.lit(1))
    start = (1 + F.pmod(F.xxhash64("doc_id", F.lit("place")), places)).cast("int")
    of_language = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash")
    chosen = (
        docs.where("lang IS NOT NULL AND doc_id IS NOT NULL")
        .where(F.rlike("text", F.lit(r"\p{L}")))
        .select("doc_id", "lang", F.xxhash64("text").alias("text_hash"), F.substring("text", start, F.lit(chars)).alias("text"))
        .withColumn("place", F.row_number().over(of_language))
        .where(F.col("place") <= docs_each)
    )
    samples: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "place").collect():
        samples.setdefault(row["lang"], []).append(row["text"])
    return samples


def identify(
    docs: DataFrame, learned_from: DataFrame | None = None, docs_each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """Per row doc_id, lang_pred and score (0.5 to 1: how many more phrases the second-best language needs).

    learned_from: labelled rows (doc_id, text, lang), docs itself by default. Only texts are judged; null texts and
    those without letters, or all if there is nothing to learn from, are `und` with a score of 0. The first language by
    name wins ties. Repeated rows are judged alike.
    """
    parser = learn(training_sample(docs if learned_from is None else learned_from, docs_each, chars))
    shared = docs.sparkSession.sparkContext.broadcast(parser and vars(parser))

    def columns(doc_id, text):
        if shared.value is None:
            return {"doc_id": doc_id, "lang_pred": ["und"] * len(doc_id), "score": [0.0] * len(doc_id)}
        parser = Parser(**shared.value)
        texts = [encoded(t or "", parser.symbol_of) for t in text]
        cost = phrase_counts(texts, parser) * parser.bits
        predicted, scores = [], []
        for symbols, costs in zip(texts, cost):
            if not symbols.any():
                predicted.append("und")
                scores.append(0.0)
                continue
            best = int(np.argmin(costs))
            others = np.delete(costs, best)
            predicted.append(parser.languages[best])
            scores.append(float(others.min() / (others.min() + costs[best])) if len(others) else 1.0)
        return {"doc_id": doc_id, "lang_pred": predicted, "score": scores}

    return map_batches(docs.select("doc_id", "text"), columns, "doc_id bigint, lang_pred string, score double")
