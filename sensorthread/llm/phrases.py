"""Phrase collocation mining by HAT-trie counting.

Phrases of two to five words are counted as windows: from every word of a piece the five words that follow, less at the
end of the piece. A task keeps its windows in a HAT-trie. The upper levels are a trie by word id: the first word leads
to a container, a hash table of the other words, and a container that grows large bursts into one container per second
word. When the trie is full, whole subtrees leave it, largest first, as runs in the byte order of their words, cut by
prefix (the first two words) into partitions. Each prefix partition then merges its runs: a stretch of windows that no
later run can add to is counted at every length at once and let go, so that neither a common prefix nor a large
partition has to fit in memory.

A phrase is no more frequent than any of its words or pairs of neighbouring words, so windows end before a pair that is
too rare. Words are counted first, by an aggregate, then hashes of pairs of frequent words. Tasks know what is rare by
Bloom filters of what is frequent, which have the same size always: where a hash or filter errs a window is longer than
it need be, and the trie's counts, which know words as such, decide.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorthread.llm.common import LOWER, UPPER
from sensorthread.session import written

#: What ends a piece, the lengths of phrases, the least count, and how many are reported per language.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
NO_LANG = "und"

#: Entries of a task's trie, entries at which a container bursts, windows of a run's chunk, and windows that a merge holds
#: before it lets go of those that are complete. They bound memory and do not change results.
TRIE_ENTRIES = 1_000_000
BURST_ENTRIES = 8_192
CHUNK_WINDOWS = 65_536
MERGE_WINDOWS = 1_500_000

#: Words that are put into the trie at a time, sorted by the subtree they go to.
BLOCK_WORDS = 1 << 18

#: Words of the corpus per prefix partition, and bits of the Bloom filters of words and of pairs (powers of two).
PART_WORDS = 2_000_000
BLOOM_BITS = 1 << 24
PAIR_BITS = 1 << 26

#: Hashes of pairs that a task sorts at a time, and their bits.
PAIR_BLOCK = 1 << 22
PAIR_HASH_BITS = 48

#: A run tells this many words apart, so that four of them fit 64 bits.
RUN_WORDS = 65_000

_PAIRS = "part int, n int, body binary"
_RUNS = "lang string, part int, first array<binary>, n int, words binary, body binary"


# Words


def _lang() -> Column:
    return F.coalesce(F.col("lang"), F.lit(NO_LANG)).alias("lang")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) for all words of all texts."""
    blank = F.translate("text", UPPER + PIECE_ENDS + "\t", LOWER + " " * (len(PIECE_ENDS) + 1))
    words = docs.where("text IS NOT NULL").select(_lang(), F.explode(F.split(blank, " ")).alias("word"))
    return words.where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))


def bloom_filter(hashes: DataFrame, bits: int) -> bytes:
    """Bits set by the column `hash`, modulo bits: bits / 8 bytes in the driver, however many rows there are."""
    page = 1 << 15  # Bits of a bitmap of Spark's.
    pages = (
        hashes.select((F.col("hash") % bits).alias("at"))
        .groupBy(F.expr(f"at div {page}").alias("page"))
        .agg(F.bitmap_construct_agg(F.expr(f"at % {page}")).alias("bitmap"))
    )
    table = bytearray(max(bits, page) // 8)
    for row in pages.collect():
        table[row.page * page // 8 : (row.page + 1) * page // 8] = row.bitmap
    return bytes(table)


class _Words(dict):
    """Hashes of the words of one language, 0 for words that are too rare and for the end of a piece; -1 for no word.
    Rare words are remembered up to `most`."""

    def __init__(self, lang: str, bloom: bytes, most: int):
        super().__init__({b"": -1, b"\n": 0})
        self.salt, self.bloom, self.most = zlib.crc32(lang.encode() + b"\0"), bloom, most

    def hash_of(self, word: bytes) -> int:
        at = zlib.crc32(word, self.salt)
        bit = at & (len(self.bloom) * 8 - 1)
        return at or 1 if self.bloom[bit >> 3] >> (bit & 7) & 1 else 0

    def __missing__(self, word: bytes) -> int:
        found = self.hash_of(word)
        if len(self) < self.most:
            self[word] = found
        return found


class _Ids(_Words):
    """Ids in a run in place of hashes. Ids are dealt by the trie."""

    def __init__(self, lang: str, trie: "HatTrie"):
        super().__init__(lang, trie.bloom, 4 * trie.limits.run_words)
        self.lang, self.trie = lang, trie

    def __missing__(self, word: bytes) -> int:
        trie, hashed, new = self.trie, self.hash_of(word), 0
        if hashed:
            new = len(trie.words)
            trie.words.append(word)
            trie.word_hash.append(hashed)
            trie.word_lang.append(self.lang)
        if new or len(self) < self.most:
            self[word] = new
        return new


#: Bytes of a text to those of its words: lower case, a blank between words and a line feed between pieces.
_TABLE = bytes.maketrans(
    (UPPER + "\t" + PIECE_ENDS).encode(), (LOWER + " " + "\n" * len(PIECE_ENDS)).encode()
)


def _tokens(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")


# Hashes of pairs


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of hashes of words, as int64: PAIR_HASH_BITS bits."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - PAIR_HASH_BITS)).astype(np.int64)


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of the range of hashes that one falls in."""
    return ((hashes >> 16) * parts) >> (PAIR_HASH_BITS - 16)


def _tally(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes in order, and the sums of their counts (1 each by default)."""
    if counts is None:
        hashes = np.sort(hashes)
    else:
        by = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[by], counts[by]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, np.int64)
    sums = np.diff(np.r_[starts, len(hashes)]) if counts is None else np.add.reduceat(counts, starts)
    return hashes[starts], sums


def _pair_runs(bloom: bytes, parts: int, block: int, most: int):
    """The map function: (lang, text) batches to rows of _PAIRS, sorted runs of hashes with their counts."""

    def packed(values: np.ndarray) -> bytes:
        """First bytes first, so that what is the same in all of them compresses."""
        return values.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()

    def runs(waiting: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        words = np.concatenate([a for found in waiting for a in (found, [0])])
        both = (words[:-1] > 0) & (words[1:] > 0)
        if not both.any():
            return
        hashes, counts = _tally(_pair_hash(words[:-1][both], words[1:][both]))
        part = _part_of(hashes, parts)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist() + [len(part)]
        rows = [
            (int(part[lo]), hi - lo, packed(np.diff(hashes[lo:hi], prepend=0)) + packed(counts[lo:hi]))
            for lo, hi in zip(cuts, cuts[1:])
        ]
        part, n, body = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()),
                pa.array(n, pa.int32()),
                pa.array([pa.compress(b, codec="zstd", asbytes=True) for b in body], pa.binary()),
            ],
            names=["part", "n", "body"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Words] = {}
        waiting, n = [], 0
        for given in batches:
            for lang, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                if (words := known.get(lang)) is None:
                    words = known[lang] = _Words(lang, bloom, most)
                found = np.fromiter(map(words.__getitem__, _tokens(text)), np.int64)
                waiting.append(found[found >= 0])
                n += len(found)
                if n >= block:
                    yield from runs(waiting)
                    waiting, n = [], 0
        if waiting:
            yield from runs(waiting)

    return run


def _often(least: int):
    """Rows of _PAIRS, a part after the other, to the hashes that are frequent."""

    def settled(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, counts = _tally(np.concatenate([h for h, _ in held]), np.concatenate([c for _, c in held]))
        return pa.RecordBatch.from_arrays([pa.array(hashes[counts >= least], pa.int64())], names=["hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = [], None
        for given in batches:
            for row in given.to_pylist():
                if row["part"] != part and held:
                    yield settled(held)
                    held = []
                part, n = row["part"], row["n"]
                plain = np.frombuffer(pa.decompress(row["body"], 16 * n, codec="zstd", asbytes=True), np.uint8)
                delta, counts = (np.ascontiguousarray(half.reshape(8, n).T).view(np.int64).ravel() for half in (plain[: 8 * n], plain[8 * n :]))
                held.append((np.cumsum(delta), counts))
        if held:
            yield settled(held)

    return run


# The trie of a task


@dataclass(frozen=True)
class Limits:
    """The bounds of a task's memory, as the constants above."""

    entries: int = TRIE_ENTRIES
    burst: int = BURST_ENTRIES
    chunk: int = CHUNK_WINDOWS
    hold: int = MERGE_WINDOWS
    block: int = BLOCK_WORDS
    pair_block: int = PAIR_BLOCK
    run_words: int = RUN_WORDS
    part_words: int = PART_WORDS


class HatTrie:
    """Counts of windows: `roots[w1]` is a container, or after a burst a dict of containers by second word.

    A container counts the rest of a window by one integer, 16 bits a word; 0 stands for no word. Windows end before a
    pair that the filter `pairs` does not hold.
    """

    def __init__(self, bloom: bytes, pairs: bytes, parts: int, limits: Limits):
        self.bloom, self.pairs, self.parts, self.limits = bloom, np.frombuffer(pairs, np.uint8), parts, limits
        self.low = 16 * (MAX_WORDS - 2)  # Bits below the second word.
        self._clear()

    def _clear(self) -> None:
        self.words: list[bytes] = [b""]
        self.word_lang: list[str] = [""]
        self.word_hash: list[int] = [0]
        self.ids: dict[str, _Ids] = {}
        self.roots: dict[int, Counter] = {}
        self.burst_roots: dict[int, dict[int, Counter]] = {}
        self.entries = 0
        self.waiting: list[tuple[np.ndarray, int]] = []
        self.waiting_words = 0

    def add(self, lang: str, text: bytes) -> Iterator[tuple]:
        """Count the windows of a text, a stretch of it at a time; yields what has to leave the trie."""
        tokens = _tokens(text)
        size, reach = self.limits.run_words // 4, MAX_WORDS - 1
        for start in range(0, len(tokens), size):
            if len(self.words) + size + 80 > self.limits.run_words:
                yield from self.spill(0)
                self._clear()
            ids = self.ids.get(lang)
            if ids is None:
                ids = self.ids[lang] = _Ids(lang, self)
            found = np.fromiter(map(ids.__getitem__, tokens[start : start + size]), np.int64)
            found = found[found >= 0]
            own, more = len(found), start + size
            # Windows of this stretch reach into the next one.
            while len(found) < own + reach and more < len(tokens):
                extra = np.fromiter(map(ids.__getitem__, tokens[more : more + 64]), np.int64)
                found, more = np.concatenate([found, extra[extra >= 0]]), more + 64
            self.waiting.append((found[: own + reach], own))
            self.waiting_words += own
            if self.waiting_words >= self.limits.block:
                self._count()
                if self.entries > self.limits.entries:
                    yield from self.spill(self.limits.entries // 4)

    def _count(self) -> None:
        gap = np.zeros(MAX_WORDS, np.int64)
        ids = np.concatenate([a for found, _ in self.waiting for a in (found, gap)] or [gap])
        starts = np.zeros(len(ids), bool)
        at = 0
        for found, own in self.waiting:
            starts[at : at + own] = True
            at += len(found) + MAX_WORDS
        self.waiting, self.waiting_words = [], 0
        # Whether a place and the next one are words that may be counted together.
        joined = (ids > 0) & (np.r_[ids[1:], 0] > 0)
        hashes = np.array(self.word_hash, np.int64)[ids]
        bit = _pair_hash(hashes, np.r_[hashes[1:], 0]) & (len(self.pairs) * 8 - 1)
        joined &= (self.pairs[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
        at = np.flatnonzero(starts & joined)
        if not len(at):
            return
        key, alive = ids[at + 1].astype(np.uint64), np.ones(len(at), bool)
        for k in range(2, MAX_WORDS):
            alive &= joined[at + k - 1]
            key = (key << np.uint64(16)) | np.where(alive, ids[at + k], 0).astype(np.uint64)
        first = ids[at]
        order = np.argsort(first, kind="stable")
        first, key = first[order], key[order]
        cuts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]]).tolist() + [len(first)]
        heads = first[cuts[:-1]].tolist()
        for w1, lo, hi in zip(heads, cuts, cuts[1:]):
            self._add(w1, key[lo:hi])

    def _add(self, w1: int, keys: np.ndarray) -> None:
        node = self.burst_roots.get(w1)
        if node is None:
            box = self.roots.get(w1)
            if box is None:
                box = self.roots[w1] = Counter()
            before = len(box)
            box.update(keys.tolist())
            self.entries += len(box) - before
            if len(box) > self.limits.burst:
                self._burst(w1)
            return
        keys = np.sort(keys)
        second = keys >> np.uint64(self.low)
        cuts = np.flatnonzero(np.r_[True, second[1:] != second[:-1]]).tolist() + [len(keys)]
        heads, rest = second[cuts[:-1]].tolist(), (keys & np.uint64((1 << self.low) - 1)).tolist()
        for w2, lo, hi in zip(heads, cuts, cuts[1:]):
            box = node.get(w2)
            if box is None:
                box = node[w2] = Counter()
            before = len(box)
            box.update(rest[lo:hi])
            self.entries += len(box) - before

    def _burst(self, w1: int) -> None:
        node: dict[int, Counter] = {}
        for key, count in self.roots.pop(w1).items():
            box = node.get(key >> self.low)
            if box is None:
                box = node[key >> self.low] = Counter()
            box[key & ((1 << self.low) - 1)] = count
        self.burst_roots[w1] = node

    def spill(self, keep: int) -> Iterator[tuple]:
        """Whole subtrees leave, largest first, until `keep` entries are left."""
        self._count()
        sizes = [(-len(box), w1) for w1, box in self.roots.items()]
        sizes += [(-sum(map(len, node.values())), w1) for w1, node in self.burst_roots.items()]
        heapq.heapify(sizes)
        firsts, keys, counts = [], [], []
        while sizes and self.entries > keep:
            size, w1 = heapq.heappop(sizes)
            self.entries += size
            box = self.roots.pop(w1, None)
            boxes = [(0, box)] if box is not None else self.burst_roots.pop(w1).items()
            firsts.append(np.full(-size, w1, np.int64))
            for w2, one in boxes:
                keys.append(np.fromiter(one.keys(), np.uint64, len(one)) | np.uint64(w2 << self.low))
                counts.append(np.fromiter(one.values(), np.int64, len(one)))
        if firsts:
            yield from self._runs(np.concatenate(firsts), np.concatenate(keys), np.concatenate(counts))

    def _runs(self, first: np.ndarray, key: np.ndarray, count: np.ndarray) -> Iterator[tuple]:
        """Rows of _RUNS: chunks of windows in the byte order of their words, by language and prefix partition."""
        places = [np.uint64(16 * k) for k in range(MAX_WORDS - 2, -1, -1)]
        columns = [first] + [((key >> place) & np.uint64(0xFFFF)).astype(np.int64) for place in places]
        order = sorted(range(len(self.words)), key=self.words.__getitem__)  # "" is first, as no word.
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes = np.array(self.word_hash, np.int64)
        langs = {lang: i for i, lang in enumerate(sorted(set(self.word_lang)))}
        lang = np.array([langs[name] for name in self.word_lang])[first]
        part = (hashes[columns[0]] * 31 + hashes[columns[1]]) % self.parts
        ranks = [rank[c] for c in columns]
        tail = np.zeros(len(first), np.uint64)
        for r in ranks[1:]:
            tail = (tail << np.uint64(16)) | r.astype(np.uint64)
        group = lang * self.parts + part
        by = np.lexsort((tail, ranks[0], group))
        group, count, ranks = group[by], count[by], [r[by] for r in ranks]
        names = list(langs)
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() + [len(group)]
        for lo, end in zip(cuts, cuts[1:]):
            for at in range(lo, end, self.limits.chunk):
                to = min(at + self.limits.chunk, end)
                windows = np.stack([r[at:to] for r in ranks])
                used = np.zeros(len(order), bool)
                used[windows] = True
                used[0] = True  # No word is always entry 0.
                words = [self.words[order[i]] for i in np.flatnonzero(used).tolist()]
                local = (np.cumsum(used) - 1)[windows].astype(np.uint16)
                body = local.tobytes() + count[at:to].tobytes()
                yield (
                    names[group[at] // self.parts],
                    int(group[at] % self.parts),
                    [words[i] for i in local[:, 0] if i],
                    to - at,
                    b" ".join(words),
                    pa.compress(body, codec="zstd", asbytes=True),
                )


def _spilled(bloom: bytes, pairs: bytes, parts: int, limits: Limits):
    """The map function: (lang, text) batches to rows of _RUNS."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_RUNS))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        while some := list(islice(rows, 32)):
            yield batch(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(bloom, pairs, parts, limits)
        for given in batches:
            for lang, text in zip(given.column(0).to_pylist(), given.column(1).to_pylist()):
                yield from batches_of(trie.add(lang, text))
        yield from batches_of(trie.spill(0))

    return run


# Merging runs


class _Merge:
    """The windows of one language and prefix partition, from chunks in the order of their first window."""

    def __init__(self, least: int, hold: int):
        self.least, self.hold = least, hold
        self.ids: dict[bytes, int] = {b"": 0}
        self.windows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def _local(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))

    def add(self, first: list[bytes], n: int, words: bytes, body: bytes) -> list[tuple]:
        done = []
        if self.held > self.hold:
            done = self._settle(first)
        plain = pa.decompress(body, n * (2 * MAX_WORDS + 8), codec="zstd", asbytes=True)
        local = np.frombuffer(plain, np.uint16, n * MAX_WORDS).reshape(MAX_WORDS, n)
        self.windows.append(self._local(words.split(b" "))[local])
        self.counts.append(np.frombuffer(plain, np.int64, n, offset=2 * n * MAX_WORDS))
        self.held += n
        return done

    def finish(self) -> list[tuple]:
        return self._settle(None) if self.held else []

    def _settle(self, upto: list[bytes] | None) -> list[tuple]:
        """Count phrases of the windows below upto (all if None); the others are held on, equal ones as one."""
        if upto is not None:
            self._local(upto)
        words = sorted(self.ids)
        rank = np.empty(len(words), np.int64)
        for r, w in enumerate(words):
            rank[self.ids[w]] = r
        self.ids = {w: r for r, w in enumerate(words)}
        windows = rank[np.concatenate(self.windows, axis=1)]
        counts = np.concatenate(self.counts)
        by = np.lexsort(windows[::-1])
        windows, counts = windows[:, by], counts[by]
        new = np.ones(len(counts), bool)
        new[1:] = (windows[:, 1:] != windows[:, :-1]).any(axis=0)
        counts = np.add.reduceat(counts, np.flatnonzero(new))
        windows = windows[:, new]
        edge, stop = None, len(counts)
        if upto is not None:
            edge = [self.ids[w] for w in upto] + [0] * (MAX_WORDS - len(upto))
            lo, hi = 0, len(counts)
            for k in range(MAX_WORDS):
                lo, hi = (lo + int(np.searchsorted(windows[k, lo:hi], edge[k], side)) for side in ("left", "right"))
                if lo == hi:
                    break
            stop = lo
        done, open_sums = self._phrases(words, windows[:, :stop], counts[:stop], edge)
        self.windows, self.counts = [windows[:, stop:]], [counts[stop:]]
        if any(open_sums.values()):
            # What was counted of prefixes that go on: as windows that end there.
            sizes = sorted(open_sums, reverse=True)
            rest = [open_sums[d] - open_sums.get(d + 1, 0) for d in sizes]
            self.windows.append(np.array([[*edge[:d], *[0] * (MAX_WORDS - d)] for d in sizes], np.int64).T)
            self.counts.append(np.array(rest, np.int64))
        self.held = sum(map(len, self.counts))
        return done

    def _phrases(self, words: list[bytes], windows: np.ndarray, counts: np.ndarray, edge: list[int] | None):
        """(words, count) of the phrases that are frequent, and the counts by length of those that edge continues."""
        done, open_sums = [], {}
        if not len(counts):
            return done, open_sums
        new = np.zeros(len(counts), bool)
        new[0] = True
        new[1:] = windows[0, 1:] != windows[0, :-1]
        for d in range(2, MAX_WORDS + 1):
            new[1:] |= windows[d - 1, 1:] != windows[d - 1, :-1]
            starts = np.flatnonzero(new)
            sums = np.add.reduceat(counts, starts)
            if edge is not None and d < MAX_WORDS and edge[d - 1] and (windows[:d, -1] == edge[:d]).all():
                open_sums[d] = int(sums[-1])
                sums[-1] = 0
            for i in np.flatnonzero((sums >= self.least) & (windows[d - 1, starts] > 0)).tolist():
                done.append((b" ".join(words[w] for w in windows[:d, starts[i]].tolist()), d, int(sums[i])))
        return done, open_sums


def _merged(least: int, hold: int):
    """The function of a prefix partition: sorted rows of _RUNS to (lang, phrase, size, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(lang: str, found: list[tuple]) -> pa.RecordBatch:
            phrases, sizes, counts = zip(*found)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(found), pa.string()),
                    pa.array([p.decode("utf-8", "replace") for p in phrases], pa.string()),
                    pa.array(sizes, pa.int32()),
                    pa.array(counts, pa.int64()),
                ],
                names=["lang", "phrase", "size", "f"],
            )

        group, merge = None, _Merge(least, hold)
        for given in batches:
            for row in given.to_pylist():
                found = []
                if (row["lang"], row["part"]) != group:
                    if group and (found := merge.finish()):
                        yield batch(group[0], found)
                    group, merge = (row["lang"], row["part"]), _Merge(least, hold)
                if found := merge.add(row["first"], row["n"], row["words"], row["body"]):
                    yield batch(group[0], found)
        if group and (found := merge.finish()):
            yield batch(group[0], found)

    return run


# Phrases and their scores


def frequent_phrases(docs: DataFrame, counts: DataFrame, min_count: int = MIN_COUNT, limits: Limits = Limits()) -> DataFrame:
    """(lang, phrase, size, f): phrases of two to five words with f >= min_count; counts as from word_counts."""
    total = counts.agg(F.sum("f")).first()[0] or 0
    parts = max(1, -(-total // limits.part_words))
    hashed_word = F.crc32(F.concat("lang", F.lit("\0"), "word").cast("binary"))
    words = bloom_filter(counts.where(F.col("f") >= min_count).select(hashed_word.alias("hash")), BLOOM_BITS)
    texts = docs.where("text IS NOT NULL").select(_lang(), F.col("text").cast("binary"))

    # Every part of the hashes has about part_words pairs, however often any of them occurs in a task's run.
    hashed = texts.mapInArrow(_pair_runs(words, parts, limits.pair_block, 4 * limits.run_words), _PAIRS)
    often = hashed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_often(min_count), "hash bigint")
    pairs = bloom_filter(often, PAIR_BITS)
    runs = texts.mapInArrow(_spilled(words, pairs, parts, limits), _RUNS)
    dealt = runs.repartition(parts, "part").sortWithinPartitions("part", "lang", "first")
    return dealt.mapInArrow(_merged(min_count, limits.hold), "lang string, phrase string, size int, f bigint")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates. found: (lang, phrase, size, f) of all frequent phrases, words
    included; totals: (lang, n)."""
    split = F.split("phrase", " ")

    # A phrase within one of the same count is dropped; one longer by a word then has that count too.
    inner = found.where("size > 2").select(
        "lang",
        "f",
        F.explode(
            F.array(F.array_join(F.slice(split, 1, F.col("size") - 1), " "), F.array_join(F.slice(split, 2, F.col("size") - 1), " "))
        ).alias("phrase"),
    )
    covered = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    candidates = (
        found.where("size > 1")
        .join(covered, ["lang", "phrase"], "left")
        .where("longer IS NULL OR longer < f")
        .select("lang", "phrase", "size", F.col("f").alias("a"))
    )
    cuts = candidates.select("*", split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"),
    )
    known = found.select("lang", F.col("phrase").alias("part"), "f")
    return (
        cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        .join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        .join(totals, "lang")
        # Decimals of 38 digits: the products may pass 64 bits, the quotient, at most 1000 n, does not.
        .withColumn("score", F.expr("(CAST(a AS decimal(19,0)) * CAST(n AS decimal(19,0)) * 1000BD) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))"))
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("bigint").alias("score"))
    )


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, limits: Limits = Limits()) -> DataFrame:
    """Per language the `top` phrases: lang, rank, phrase, a, l, r, n, score.

    docs needs text and lang; other columns are not read, whatever their names. Null texts have no words, a null lang is
    'und', repeated rows count as often as they occur, and equal scores are ranked by a, then by the phrase's bytes. No
    texts, or none with a frequent phrase, give no rows.
    """
    counts = written(word_counts(docs), "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    words = counts.where(F.col("f") >= min_count).select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f")
    found = written(frequent_phrases(docs, counts, min_count, limits).unionByName(words), "frequent-phrases")
    best_cuts = scored(found, totals)
    # Few languages hold all phrases, so the best of each of many parts are taken first.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    best = best_cuts.withColumn("rank", F.row_number().over(in_part)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
