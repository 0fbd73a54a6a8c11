"""Passages of benchmark items in documents, up to word edits.

A document matches an item of m words when the item, at edit distance of at most RATE * m words, begins at
some word of it.  Words are runs of letters and digits, lower-cased (ASCII), so punctuation and line breaks
do not count.

Items are grouped by length (a power of two and up), and the windows at a document's words are embedded by CGK random
walks: a walk reads the word under its pointer at each step and moves on if a random function of step
and word says so, which turns edit distance into Hamming distance.  Each of TABLES bit-sampling tables for each
walk takes SAMPLED steps, of those in which the pointer is still inside the items of the group, as its
key.  A window and an item that agree in any key are compared exactly: by their common word pairs, then by
dynamic programming with a free end.  How many walks a group needs follows from the wanted recall: its own walks are tried on
random items of the group's lengths with as many random edits as the limit allows, until they find that share of them.

Of all windows only those are embedded that pass the q-gram lemma: an item within k word edits shares at
least m - 1 - 2 k of its word pairs with the window.  This loses nothing, and leaves few windows in clean text.

The benchmark is read in blocks of about BLOCK bytes, all rows of an item in one; every block meets all documents in a pass that
shuffles nothing.  Null or empty texts match nothing, nor do items of fewer than two words; repeated document
rows give a row each, equal (item_id, text) rows count once; other columns are ignored; an empty table of either kind gives no
matches.  A text of any length is searched whole.  Of several matches of an item in a document the one of least distance is reported, then the
first, then the shortest.  Rows of the benchmark without item_id are searched like others, each as an item of its own, and reported
with a null item_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolens.llm import textkit

RATE = 0.2
TABLES, SAMPLED = 12, 3
#: Wanted share of the passages at the edit limit, and the trials for each of three lengths of a group.
RECALL, TRIALS = 0.98, 200
BLOCK = 2 << 20
#: Windows embedded at once.
SLICE = 4096

_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)]).astype(np.uint8)

FOUND = "doc_id bigint, item_id bigint, distance int, item_words int, start_word bigint, end_word bigint"


def words_of(chunk: textkit.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word."""
    low = textkit.LOWER[chunk.data]
    at = textkit.runs(textkit.Chunk(0, low, chunk.offsets), _WORD)
    return at.doc, textkit.Hasher(low)(at.start, at.end)


def embed(windows: np.ndarray, walk: int, short: int) -> np.ndarray:
    """Keys of the tables of one walk for items of short words or more: windows (n, width) become (n, TABLES) hashes."""
    n, width = windows.shape
    rng = np.random.default_rng([walk, short])
    salts = rng.integers(0, 1 << 63, 2 * short, dtype=np.uint64)
    steps = np.sort(np.stack([rng.choice(2 * short, min(SAMPLED, 2 * short), replace=False) for _ in range(TABLES)]), axis=1)
    at = np.zeros(n, np.int64)
    rows = np.arange(n)
    padded = np.concatenate([windows, np.zeros((n, 1), np.uint64)], axis=1)
    keys = np.zeros((n, TABLES), np.uint64)
    for j in range(int(steps.max()) + 1):
        word = padded[rows, at]
        for t in np.flatnonzero((steps == j).any(axis=1)):
            keys[:, t] = textkit.mix(keys[:, t] * np.uint64(0x9FB21C651E98DF25) + word + np.uint64(1))
        move = ((word ^ salts[j]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)
        at = np.minimum(at + move.astype(np.int64), width)
    return keys


def edits(items: np.ndarray, texts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, (least edit distance of the item to a beginning of the text, its length); zeros end the text."""
    n, m = items.shape
    width = texts.shape[1]
    far = m + width
    over = texts == 0
    row = np.tile(np.arange(width + 1), (n, 1))
    for i in range(1, m + 1):
        low, high = max(1, i - most), min(width, i + most)
        new = np.full((n, width + 1), far)
        new[:, 0] = i
        cost = (texts[:, low - 1 : high] != items[:, i - 1 : i]) | over[:, low - 1 : high]
        best = np.minimum(row[:, low - 1 : high] + cost, row[:, low : high + 1] + 1)
        # insertions run along the row: a running minimum of best - column
        shift = np.arange(low, high + 1)
        first = new[:, low - 1 : low] - (low - 1)
        new[:, low : high + 1] = np.minimum.accumulate(np.concatenate([first, best - shift], axis=1), axis=1)[:, 1:] + shift
        row = new
    real = np.concatenate([np.ones((n, 1), bool), ~np.logical_or.accumulate(over, axis=1)], axis=1)
    row = np.where(real, row, far)
    end = row.argmin(axis=1)
    return row[np.arange(n), end], end


def _edited(rng: np.random.Generator, m: int, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An item of m words that occur once, and a window of width words that begins with it after k random edits."""
    item = rng.integers(1, 1 << 63, m, dtype=np.uint64)
    text = item.tolist()
    for _ in range(k):
        at = rng.integers(len(text))
        taken, given = ((1, 1), (1, 0), (0, 1))[rng.integers(3)]
        text[at : at + taken] = rng.integers(1, 1 << 63, given, dtype=np.uint64).tolist()
    more = rng.integers(1, 1 << 63, width, dtype=np.uint64)
    return item, np.concatenate([np.array(text, np.uint64), more])[:width]


@lru_cache(maxsize=256)
def walks(short: int, rate: float, recall: float) -> int:
    """The number of walks that finds the wanted share of edited items of short words and more, at each of three lengths."""
    rng = np.random.default_rng(short)
    lengths = sorted({short, short + short // 2, 2 * short - 1})
    cases = []
    for m in lengths:
        k = int(rate * m)
        rows = [_edited(rng, m, k, m + k) for _ in range(TRIALS)]
        items = np.zeros((TRIALS, 2 * short - 1), np.uint64)
        items[:, :m] = [x for x, _ in rows]
        cases.append((items, np.array([x for _, x in rows]), np.zeros(TRIALS, bool)))
    for n in count(1):
        for items, windows, found in cases:
            found |= (embed(items, n - 1, short) == embed(windows, n - 1, short)).any(axis=1)
        if min(found.mean() for _, _, found in cases) >= recall:
            return n


class Group:
    """Items of short up to 2 * short - 1 words: hashes padded with zeros, their word pairs, keys in all tables."""

    def __init__(self, short: int, items: list[tuple[int, np.ndarray]], rate: float, recall: float = RECALL) -> None:
        self.short = short
        self.ids = np.array([i for i, _ in items], np.int64)
        self.length = np.array([len(x) for _, x in items])
        self.most = (rate * self.length).astype(np.int64)
        self.shared = np.maximum(1, self.length - 1 - 2 * self.most)
        self.width = int((self.length + self.most).max())
        self.words = np.zeros((len(items), int(self.length.max())), np.uint64)
        for i, (_, x) in enumerate(items):
            self.words[i, : len(x)] = x
        pairs = [_owned(textkit.ngrams(x, np.zeros(len(x), np.int64), 2)[1], np.array([i], np.uint64)) for i, (_, x) in enumerate(items)]
        self.pairs = np.unique(np.concatenate(pairs))
        self.tables = []
        for walk in range(walks(short, rate, recall)):
            keys = embed(self.words, walk, short)
            by = np.argsort(keys, axis=0, kind="stable")
            self.tables.append([(keys[by[:, t], t], by[:, t]) for t in range(TABLES)])

    def candidates(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in a key of some table."""
        out = []
        for walk, tables in enumerate(self.tables):
            keys = embed(windows, walk, self.short)
            for t, (known, item) in enumerate(tables):
                low, high = np.searchsorted(known, keys[:, t], "left"), np.searchsorted(known, keys[:, t], "right")
                hit = np.flatnonzero(high > low)
                times = high[hit] - low[hit]
                place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[hit], times)
                out.append(np.repeat(hit, times) * len(self.ids) + item[place])
        return np.divmod(np.unique(np.concatenate(out)), len(self.ids))

    def verified(self, windows: np.ndarray, window: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance, words) of the candidates within the item's edits."""
        pair = textkit.mix(windows[:, :-1] * np.uint64(0x9DDFEA08EB382D69) + windows[:, 1:])
        real = (windows[:, 1:] != 0)[window] & (np.arange(self.width - 1) < (self.length + self.most)[item][:, None] - 1)
        own = _owned(pair[window], item.astype(np.uint64)[:, None])
        known = self.pairs[np.minimum(np.searchsorted(self.pairs, own), len(self.pairs) - 1)] == own
        enough = (known & real).sum(axis=1) >= self.shared[item]
        window, item = window[enough], item[enough]
        out = [np.zeros((0, 4), np.int64)]
        for m in np.unique(self.length[item]):
            w, i = window[self.length[item] == m], item[self.length[item] == m]
            most = int(self.most[i[0]])
            distance, words = edits(self.words[i, :m], windows[w, : m + most], most)
            near = distance <= most
            out.append(np.stack([w[near], i[near], distance[near], words[near]], axis=1))
        return tuple(np.concatenate(out).T)


def _owned(pairs: np.ndarray, item: np.ndarray) -> np.ndarray:
    return textkit.mix(pairs ^ (item * np.uint64(0xD6E8FEB86659FD93)))


class Items:
    """One block of the benchmark; an item's number is its place in ids, where those without id have a place for each row."""

    def __init__(self, rows: list[tuple[int | None, str]], rate: float = RATE, recall: float = RECALL) -> None:
        if not 0 <= rate < 0.5:
            raise ValueError("rate must be below 0.5: beyond, an item need not share any word pair with its passage")
        found: dict[int, list] = {}
        places = {i: n for n, i in enumerate(dict.fromkeys(i for i, _ in rows if i is not None))}
        numbers, self.ids = [], list(places)
        for i, _ in rows:
            numbers.append(len(self.ids) if i is None else places[i])
            if i is None:
                self.ids.append(None)
        pairs = [np.zeros(0, np.uint64)]
        for chunk in textkit.chunks(pa.array([t for _, t in rows], pa.string())):
            doc, h = words_of(chunk)
            pairs.append(textkit.ngrams(h, doc, 2)[1])
            cuts = np.searchsorted(doc, np.arange(chunk.n + 1))
            for i in range(chunk.n):
                own = h[cuts[i] : cuts[i + 1]]
                if len(own) >= 2:
                    found.setdefault(1 << (len(own).bit_length() - 1), []).append((numbers[chunk.first + i], own))
        self.groups = [Group(short, items, rate, recall) for short, items in sorted(found.items())]
        self.pairs = np.unique(np.concatenate(pairs))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.pairs >> np.uint64(44)).astype(np.int64)] = True

    def _places(self, at: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Words at which a word pair of the benchmark begins."""
        maybe = np.flatnonzero(self.seen[(pair >> np.uint64(44)).astype(np.int64)])
        if not len(self.pairs):
            return maybe
        near = np.minimum(np.searchsorted(self.pairs, pair[maybe]), len(self.pairs) - 1)
        return at[maybe[self.pairs[near] == pair[maybe]]]

    @staticmethod
    def _starts(hits: np.ndarray, doc: np.ndarray, first: np.ndarray, m: int, need: int) -> np.ndarray:
        """Words at which a window of m words has need word pairs of the benchmark or more."""
        left, right = hits[: max(0, len(hits) - need + 1)], hits[need - 1 :]
        ok = (right - left <= m - 2) & (doc[left] == doc[right])
        left, right = left[ok], right[ok]
        low = np.maximum(right - (m - 2), first[doc[left]])
        times = left - low + 1
        return np.unique(np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times))

    def search(self, chunk: textkit.Chunk) -> np.ndarray:
        """Rows (text, number of the item, distance, m, first word, word after the last): the best match of each text and item."""
        doc, h = words_of(chunk)
        at, pair = textkit.ngrams(h, doc, 2)
        hits = self._places(at, pair)
        first, last = np.searchsorted(doc, np.arange(chunk.n)), np.searchsorted(doc, np.arange(chunk.n), side="right")
        out = [np.zeros((0, 6), np.int64)]
        for group in self.groups:
            kinds = sorted({*zip((group.length + group.most).tolist(), group.shared.tolist())})
            begin = np.unique(np.concatenate([self._starts(hits, doc, first, m, need) for m, need in kinds]))
            for k in range(0, len(begin), SLICE):
                own = begin[k : k + SLICE]
                place = own[:, None] + np.arange(group.width)
                windows = np.where(place < last[doc[own]][:, None], h[np.minimum(place, len(h) - 1)], np.uint64(0))
                window, item, distance, words = group.verified(windows, *group.candidates(windows))
                start = own[window] - first[doc[own[window]]]
                out.append(np.stack([doc[own[window]], group.ids[item], distance, group.length[item], start, start + words], axis=1))
        rows = np.concatenate(out)
        rows = rows[np.lexsort((rows[:, 5], rows[:, 4], rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        return rows[new]


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        item_ids = pa.array(items.ids, pa.int64())
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            for chunk in textkit.chunks(batch.column(1)):
                rows = items.search(chunk)
                if len(rows):
                    ids = batch.column(0).take(pa.array(rows[:, 0] + chunk.first))
                    yield pa.RecordBatch.from_arrays([ids, item_ids.take(pa.array(rows[:, 1])), *[pa.array(rows[:, i + 2]).cast(k) for i, k in enumerate(kinds)]], names)

    return run


def _clean(shared, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for chunk in textkit.chunks(batch.column(text)):
                keep[items.search(chunk)[:, 0] + chunk.first] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame, rate: float, block: int, recall: float) -> Iterator:
    """The benchmark as broadcasts of about block bytes of text each; an item's texts are in one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    n = 1 + int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // block
    of = F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id"))
    for b in range(n):
        rows = items.filter(F.pmod(of, F.lit(n)) == b).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items(sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), rate, recall))


def find_passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, distance, item_words, start_word, end_word: the best match of each document row and item."""
    docs = docs.select("doc_id", "text")
    return reduce(DataFrame.unionByName, [docs.mapInArrow(_searched(own), FOUND) for own in _blocks(benchmark, rate, block, recall)])


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """The rows of docs in which no item is found, as they are."""
    for own in _blocks(benchmark, rate, block, recall):
        docs = docs.mapInArrow(_clean(own, docs.columns.index("text")), docs.schema)
    return docs
