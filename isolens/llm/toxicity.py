"""Toxicity scores by weak supervision.

1. Voters.  From a bounded sample of labelled rows (MOST_LABELLED, the first by hash of doc_id; rows of the
   held-out fold never) words and word beginnings that mark toxic texts are mined.  Lexicon voters hold the
   words, dealt out by rank; beginning voters hold the beginnings, one for each length; one voter asks for
   two different hits.  Pattern voters see no label: letters hidden behind signs inside a word, words in capitals, repeated
   exclamation marks, words that address the reader beside a hit.  Two voters speak for clean texts: a hit that stands in
   quotes, and a text of PLAIN words and more without any hit or pattern.
2. Label model.  Every document is put to the vote, and Spark counts the vote patterns, at most two to the
   number of voters.  EM fits each voter's rates in both classes; from the conditional correlations that
   remain a tree of dependent voters is chosen, and EM is run again with each voter given its parent.
3. Classifier.  A logistic regression over hashed words and word beginnings, in which every document outside the
   held-out fold counts by its posterior.  One aggregation over them finds the features whose rates in toxic and clean texts differ
   (log ratio of TELLING or more, and clear of chance); another counts the distinct sets of those features that texts hold,
   by vote pattern; L-BFGS then takes loss and gradient from sums over that table.

Counts, patterns, training and scores cover all documents; scores depend on the text alone.  A null or empty text gets
the score of the intercept; repeated rows give a row each; without labels every score is the base rate; an empty table gives no
rows; a text of any length is scored whole; columns besides doc_id and text are ignored.  Features that are equal in count and
score have equal weights, so the order of rows decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolens.llm import textkit
from isolens.llm.scratch import passing, saved

MOST_LABELLED = 20_000
#: A mark's evidence (nats) beyond that of the best of all words by chance.
SURE = 8.0
BEGINNINGS = (4, 5, 6, 7)
LEXICONS = 6
#: Numbers of the voters after the lexicon and beginning voters; those up to TWICE vote by marks.
TWICE = LEXICONS + len(BEGINNINGS)
HIDDEN, CAPITALS, EXCLAIMED, ADDRESSED, QUOTED, PLAINLY = range(TWICE + 1, TWICE + 7)
VOTERS = PLAINLY + 1
PLAIN = 50
BITS = 18
#: Least weight of a feature, standard errors from chance, and pseudo-documents at the feature's overall rate.
TELLING, CLEAR, PRIOR = 2.0, 5.0, 4.0
RIDGE = 1.0

# Words by which a text addresses its reader.
ADDRESS = ("you", "your", "you're", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "vous", "votre", "te", "ti", "tú", "usted", "ustedes", "vosotros")

_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)]).astype(np.uint8)
_CAPITAL = np.array([65 <= b <= 90 for b in range(256)])
_SIGN = np.array([chr(b) in "*@$#0123456789" for b in range(256)]).astype(np.uint8)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def marks(chunk: textkit.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, kind, hash) of lower-cased words (kind 0) and their beginnings (kind 1 and on)."""
    low = textkit.LOWER[chunk.data]
    at = textkit.runs(textkit.Chunk(0, low, chunk.offsets), _LETTER)
    hasher = textkit.Hasher(low)
    docs, kinds, hashes = [at.doc], [np.zeros(len(at.doc), np.int8)], [hasher(at.start, at.end)]
    for k, length in enumerate(BEGINNINGS, 1):
        long = at.end - at.start >= length
        docs.append(at.doc[long])
        kinds.append(np.full(len(docs[-1]), k, np.int8))
        hashes.append(textkit.mix(hasher(at.start[long], at.start[long] + length) + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(kinds), np.concatenate(hashes)


class Words(NamedTuple):
    """The words of a chunk, lower-cased: byte ranges, which of the distinct words each is, and the marks of distinct words.

    marks[kind, word] are the hashes that marks() gives, where has[kind, word]: what depends on the word alone is found once a chunk.
    """

    at: textkit.Tokens
    which: np.ndarray
    marks: np.ndarray
    has: np.ndarray

    def holding(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (text, value) of values below 2^32 by kind and word, in order; those below 0 are none."""
        own = (value >= 0).any(axis=0)
        places = slice(None) if own.all() else np.flatnonzero(own[self.which])
        pairs = _unique(self.at.doc[places] << 32 | self.which[places])
        value = value[:, pairs & 0xFFFFFFFF]
        pairs = _unique(((pairs >> 32 << 32) | value)[value >= 0])
        return pairs >> 32, pairs & 0xFFFFFFFF


def _unique(value: np.ndarray) -> np.ndarray:
    value = np.sort(value)
    new = np.ones(len(value), bool)
    np.not_equal(value[1:], value[:-1], out=new[1:])
    return value[new]


def _translated(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] of bytes."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), np.uint8)


def _lettered(chunk: textkit.Chunk) -> textkit.Tokens:
    """textkit.runs(chunk, _LETTER): with one class of bytes, words begin and end where letters do."""
    letter = _translated(chunk.data, _LETTER).view(bool)
    begins = chunk.offsets[:-1][chunk.offsets[:-1] < len(letter)]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    first[begins] = letter[begins]
    last[:-1] &= ~letter[1:]
    last[begins - 1] = letter[begins - 1]  # of the first text: the last byte, where a word ends if it is a letter
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return textkit.Tokens(start, end, np.repeat(np.arange(chunk.n), np.diff(np.searchsorted(start, chunk.offsets))))


def words_of(chunk: textkit.Chunk) -> Words:
    low = _translated(chunk.data, textkit.LOWER)
    at = _lettered(chunk)
    hasher = textkit.Hasher(low)
    coded = pa.array(hasher(at.start, at.end)).dictionary_encode()
    which, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()
    one = np.empty(len(distinct), np.int64)
    one[which] = np.arange(len(which))
    start, length = at.start[one], at.end[one] - at.start[one]
    marks, has = np.zeros((len(BEGINNINGS) + 1, len(distinct)), np.uint64), np.ones((len(BEGINNINGS) + 1, len(distinct)), bool)
    marks[0] = distinct
    for k, n in enumerate(BEGINNINGS, 1):
        has[k] = length >= n
        marks[k, has[k]] = textkit.mix(hasher(start[has[k]], start[has[k]] + n) + np.uint64(k))
    return Words(at, which, marks, has)


def _distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((value, doc))
    doc, value = doc[by], value[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for chunk in textkit.chunks(batch.column(0)):
            doc, kind, h = marks(chunk)
            for k in range(len(BEGINNINGS) + 1):
                own_doc, own = _distinct(doc[kind == k], h[kind == k])
                label = toxic[chunk.first + own_doc]
                distinct, back = np.unique(own, return_inverse=True)
                columns = [np.full(len(distinct), k, np.int32), distinct.astype(np.int64), np.bincount(back, weights=label, minlength=len(distinct)).astype(np.int64), np.bincount(back, minlength=len(distinct))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "h", "toxic", "n"])


class Lexicon(NamedTuple):
    """Sorted hashes of the marks, the voter of each, and the share of toxic rows in the sample."""

    hashes: np.ndarray
    voters: np.ndarray
    share: float


def _contexts(known: np.ndarray):
    """(kind, h, context, toxic): the distinct words before each occurrence of the known hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            for chunk in textkit.chunks(batch.column(0)):
                doc, kind, h = marks(chunk)
                low = textkit.Chunk(0, textkit.LOWER[chunk.data], chunk.offsets)
                at, words = textkit.runs(low, _LETTER), textkit.words(low)
                word = textkit.Hasher(low.data)(words.start, words.end)
                own = np.searchsorted(words.start, at.start, side="right") - 1
                follows = (own > 0) & (words.doc[own - 1] == words.doc[own]) if len(own) else np.zeros(0, bool)
                before = np.where(follows, word[own - 1], np.uint64(0)) if len(own) else np.zeros(0, np.uint64)
                context = np.concatenate([before, *[before[at.end - at.start >= n] for n in BEGINNINGS]])
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[place] == h
                rows = np.unique(np.stack([kind[hit].astype(np.int64), h[hit].view(np.int64), context[hit].view(np.int64), toxic[chunk.first + doc[hit]].astype(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), pa.array(rows[1].copy()), pa.array(rows[2].copy()), pa.array(rows[3].astype(np.int32))], ["kind", "h", "context", "toxic"])

    return run


def _telling(toxic: Column, n: Column, share: float, tried: int) -> Column:
    """More of n are toxic than the share explains, even as the best of so many tries: the binomial's large-deviation bound."""
    p = toxic / n
    clean = F.when(p < 1, (1 - p) * F.log(F.greatest((1 - p), F.lit(1e-12)) / (1 - share))).otherwise(0.0)
    return (toxic >= 4) & (p >= 0.7) & (n * (p * F.log(F.greatest(p, F.lit(1e-12)) / share) + clean) > float(np.log(max(tried, 1)) + SURE))


def mine(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Words and beginnings that far more toxic than clean texts of the sample hold, in several surroundings.

    Near copies of one toxic text share all their words, but also the words before them: a mark must pass the same test with
    the distinct words before it in place of texts.
    """
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    of = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    share = (of.toxic + 0.5) / (of.n + 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")
    counted = rows.mapInArrow(_mined, "kind int, h bigint, toxic bigint, n bigint").groupBy("kind", "h").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    with passing(docs.sparkSession):
        counted = saved(counted, "counted")
        tried = counted.count()
        first = counted.filter(_telling(F.col("toxic"), F.col("n"), share, tried)).select("h").toArrow()  # of a bounded sample
        hashes = np.sort(first.column("h").to_numpy().view(np.uint64))
        none = Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), share)
        if not len(hashes):
            return none
        pairs = rows.mapInArrow(_contexts(hashes), "kind int, h bigint, context bigint, toxic int").groupBy("kind", "h", "context").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("clean"))
        by = pairs.groupBy("kind", "h").agg(F.sum("toxic").cast("long").alias("toxic"), F.sum(F.col("toxic") + 1 - F.col("clean")).cast("long").alias("n"))
        found = by.filter(_telling(F.col("toxic"), F.col("n"), share, tried)).orderBy(F.desc("toxic"), "kind", "h").collect()
    if not found:
        return none
    voters, words = [], 0
    for r in found:
        voters.append(words % LEXICONS if r.kind == 0 else LEXICONS + r.kind - 1)
        words += r.kind == 0
    hashes = np.array([r.h for r in found], np.int64).view(np.uint64)
    by = np.argsort(hashes)
    return Lexicon(hashes[by], np.array(voters, np.int64)[by], share)


def _hidden(data: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Places of a sign or digit between two letters of one text; new: the first byte of each text."""
    at = np.flatnonzero(_translated(data[1:-1], _SIGN)) + 1
    return at[(_LETTER[data[at - 1]] > 0) & (_LETTER[data[at + 1]] > 0) & ~new[at] & ~new[at + 1]]


def _capitals(data: np.ndarray, words: textkit.Tokens) -> np.ndarray:
    """Places of the words of four bytes and more that are all capitals A-Z."""
    at = np.flatnonzero(words.end - words.start >= 4)
    for k in range(4):
        at = at[_CAPITAL[data[words.start[at] + k]]]
    if not len(at):
        return at
    length = words.end[at] - words.start[at]
    cut = np.cumsum(length) - length
    inside = np.repeat(words.start[at] - cut, length) + np.arange(length.sum())
    return at[np.add.reduceat(_CAPITAL[data[inside]].astype(np.int64), cut) == length]


@lru_cache(maxsize=1)
def _address() -> np.ndarray:
    raw = np.frombuffer("\n".join(ADDRESS).encode(), np.uint8)
    at = textkit.runs(textkit.Chunk(0, raw, np.array([0, len(raw)])), _LETTER)
    return np.unique(textkit.Hasher(raw)(at.start, at.end))


def _places(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each hash among the known ones, which are sorted; -1: not there."""
    beginning = np.zeros(1 << 16, bool)
    beginning[known >> np.uint64(48)] = True
    out = np.full(h.shape, -1)
    maybe = np.nonzero(beginning[h >> np.uint64(48)])
    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    out[maybe] = np.where(known[at] == h[maybe], at, -1)
    return out


def votes(chunk: textkit.Chunk, lexicon: Lexicon, words: Words | None = None) -> np.ndarray:
    """For each text, the bits of the voters that speak up."""
    n, out = chunk.n, np.zeros(chunk.n, np.int64)
    if not len(lexicon.hashes):
        return out
    words = words or words_of(chunk)
    place = np.where(words.has, _places(lexicon.hashes, words.marks), -1)
    doc, at = words.holding(place)
    np.bitwise_or.at(out, doc, np.left_shift(1, lexicon.voters[at]))
    any_hit = out != 0

    def vote(voter: int, which: np.ndarray) -> None:
        out[which] |= 1 << voter

    vote(TWICE, np.bincount(doc[lexicon.voters[at] < LEXICONS], minlength=n) >= 2)
    data, of = chunk.data, lambda places: np.searchsorted(chunk.offsets, places, side="right") - 1
    new = np.zeros(len(data) + 1, bool)
    new[chunk.offsets[:-1]] = True
    new = new[: len(data)]
    vote(HIDDEN, np.bincount(of(_hidden(data, new)), minlength=n) > 0)
    start, of_word = words.at.start, words.at.doc
    vote(CAPITALS, np.bincount(of_word[_capitals(data, words.at)], minlength=n) >= 2)
    twice = np.flatnonzero((data[1:] == 33) & (data[:-1] == 33) & ~new[1:]) if len(data) else np.zeros(0, np.int64)
    vote(EXCLAIMED, np.bincount(of(twice), minlength=n) > 0)
    found = np.flatnonzero((place[0] >= 0)[words.which])
    addressed = (_places(_address(), words.marks[0]) >= 0)[words.which]
    near = np.zeros(n, bool)
    for k in (-3, -2, -1, 1, 2, 3):
        other = found + k
        inside = (other >= 0) & (other < len(of_word))
        own, other = found[inside], other[inside]
        near[of_word[own[addressed[other] & (of_word[own] == of_word[other])]]] = True
    vote(ADDRESSED, near)
    before = data[np.maximum(start[found] - 1, 0)]
    vote(QUOTED, np.bincount(of_word[found[(start[found] > 0) & ((before == 34) | (before == 39))]], minlength=n) > 0)
    vote(PLAINLY, ~any_hit & (out == 0) & (np.bincount(of_word, minlength=n) >= PLAIN))
    return out


def _patterns(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << VOTERS, np.int64)
        for batch in batches:
            for chunk in textkit.chunks(batch.column(0)):
                total += np.bincount(votes(chunk, lexicon), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pattern", "n"])

    return run


class LabelModel:
    """Two classes; each voter's rate given the class and, where it has one, its parent's vote."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float) -> None:
        self.v = (patterns[:, None] >> np.arange(VOTERS)) & 1
        self.counts = counts.astype(float)
        self.prior = prior
        self.parent = np.full(VOTERS, -1)
        q = np.where(self.v[:, : TWICE + 1].any(axis=1), 0.95, 0.01)
        q = self._fit(q)
        self.correlation = np.stack([self._correlation(q), self._correlation(1 - q)])
        self._choose_tree(np.abs(self.correlation).max(axis=0))
        self._fit(q)

    def _correlation(self, q: np.ndarray) -> np.ndarray:
        w = self.counts * q
        x = self.v - (w @ self.v) / max(w.sum(), 1e-9)
        cov = (x * w[:, None]).T @ x / max(w.sum(), 1e-9)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        return np.where(np.outer(sd, sd) > 1e-6, cov / np.outer(sd, sd), 0) * (1 - np.eye(VOTERS))

    def _choose_tree(self, strength: np.ndarray, least: float = 0.1) -> None:
        """A spanning forest of the strongest correlations, grown from the first voter of each tree."""
        inside = [0]
        while len(inside) < VOTERS:
            rest = [j for j in range(VOTERS) if j not in inside]
            best = max(((strength[i, j], i, j) for i in inside for j in rest), key=lambda x: (x[0], -x[1], -x[2]))
            if best[0] >= least:
                self.parent[best[2]] = best[1]
            inside.append(best[2])

    def _likelihood(self, rates: np.ndarray, v: np.ndarray) -> np.ndarray:
        """log P(votes | class); rates[class, voter, parent's vote]."""
        given = np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)
        r = rates[:, np.arange(VOTERS), given]
        return np.log(np.where(v == 1, r, 1 - r)).sum(axis=2)

    def _fit(self, q: np.ndarray, steps: int = 100) -> np.ndarray:
        given = np.where(self.parent >= 0, self.v[:, np.maximum(self.parent, 0)], 0)
        for _ in range(steps):
            rates = np.empty((2, VOTERS, 2))
            for y, weight in enumerate((1 - q, q)):
                w = self.counts * weight
                for g in (0, 1):
                    of = w[:, None] * (given == g)
                    low = 1e-5 if y == 0 else 1e-2
                    rates[y, :, g] = np.clip(((of * self.v).sum(axis=0) + low) / (of.sum(axis=0) + 1), 1e-6, 0.999)
            share = np.clip((self.counts @ q + self.prior) / (self.counts.sum() + 1), 1e-4, 0.9)
            log = self._likelihood(rates, self.v)
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log(1 / share - 1), -500, 500)))
            done = np.abs(new - q).max() < 1e-6
            q = new
            if done:
                break
        self.rates, self.share = rates, share
        return q

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        log = self._likelihood(self.rates, (patterns[:, None] >> np.arange(VOTERS)) & 1)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log(1 / self.share - 1), -500, 500)))


def _feature(words: Words) -> np.ndarray:
    """The features by kind and distinct word; -1: none."""
    return np.where(words.has, (words.marks >> np.uint64(64 - BITS)).astype(np.int64), -1)


def _features(chunk: textkit.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature)."""
    words = words_of(chunk)
    return words.holding(_feature(words))


class Posterior(NamedTuple):
    """The posterior of each vote pattern, patterns sorted."""

    patterns: np.ndarray
    q: np.ndarray

    def __call__(self, patterns: np.ndarray) -> np.ndarray:
        return self.q[np.searchsorted(self.patterns, patterns)]


def _evidence(lexicon: Lexicon, posterior: Posterior):
    """(feature, df, toxic): documents with the feature, and the sum of their posteriors; under feature 2^BITS those of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, toxic = np.zeros((1 << BITS) + 1, np.int64), np.zeros((1 << BITS) + 1)
        n, all_toxic = 0, 0.0
        for batch in batches:
            for chunk in textkit.chunks(batch.column(0)):
                words = words_of(chunk)
                q = posterior(votes(chunk, lexicon, words))
                n, all_toxic = n + chunk.n, all_toxic + float(q.sum())
                doc, feature = words.holding(_feature(words))
                df += np.bincount(feature, minlength=len(df))
                toxic += np.bincount(feature, weights=q[doc], minlength=len(df))
        df[-1], toxic[-1] = n, all_toxic
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen]), pa.array(toxic[seen])], ["feature", "df", "toxic"])

    return run


def telling(df: np.ndarray, toxic: np.ndarray, n: float, n_toxic: float) -> np.ndarray:
    """The features whose rates in toxic and in clean texts differ much and surely."""
    rate, mean = df / max(n, 1), n_toxic / max(n, 1)
    ratio = np.log((toxic + PRIOR * rate + 1e-9) / (n_toxic + PRIOR)) - np.log((df - toxic + PRIOR * rate + 1e-9) / (n - n_toxic + PRIOR))
    z = (toxic - df * mean) / np.sqrt(np.maximum(df * mean * (1 - mean), 1e-9))
    return np.flatnonzero((df >= 4) & (np.abs(z) >= CLEAR) & (np.abs(ratio) >= TELLING))


def _sets(lexicon: Lexicon, chosen: np.ndarray):
    """(pattern, features): for each text its votes and the places in chosen of the features that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full((1 << BITS) + 1, -1)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            for chunk in textkit.chunks(batch.column(0)):
                words = words_of(chunk)
                doc, feature = words.holding(place[_feature(words)])
                cuts = np.searchsorted(doc, np.arange(chunk.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(votes(chunk, lexicon, words)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))], ["pattern", "features"])

    return run


def _slopes(posterior: Posterior, theta: np.ndarray):
    """(i, value) of rows (pattern, features, n): the gradient by theta, whose last place is the intercept, and under len(theta) the loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(theta) + 1)
        for batch in batches:
            q, n = posterior(batch.column(0).to_numpy()), batch.column(2).to_numpy()
            lists = batch.column(1)
            feature = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            z = np.bincount(row, weights=theta[feature], minlength=batch.num_rows) + theta[-1]
            r = n * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - q)
            out[:-2] += np.bincount(feature, weights=r[row], minlength=len(theta) - 1)
            out[-2] += r.sum()
            out[-1] += (n * (np.logaddexp(0, z) - q * z)).sum()
        seen = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(out[seen])], ["i", "value"])

    return run


def lbfgs(of: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, memory: int = 8, small: float = 1e-5) -> np.ndarray:
    """The minimum of a smooth convex function that gives value and gradient, from x on."""
    value, slope = of(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        move, used = slope.copy(), []
        for s, y in reversed(pairs):
            a = (s @ move) / (s @ y)
            used.append(a)
            move -= a * y
        move *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(np.linalg.norm(slope), 1e-12)
        for (s, y), a in zip(pairs, reversed(used)):
            move += s * (a - (y @ move) / (s @ y))
        scale = 1.0
        while True:
            new = x - scale * move
            new_value, new_slope = of(new)
            if new_value <= value - 1e-4 * scale * (slope @ move) or scale < 1e-4:
                break
            scale /= 2
        gain = value - new_value
        if gain <= 0:
            return x
        s, y = new - x, new_slope - slope
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)]
        x, value, slope = new, new_value, new_slope
        if gain < small * abs(value):
            return x
    return x


def train(sets: DataFrame, posterior: Posterior, n_features: int, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the features and, last, the intercept, from sets (pattern, features, n).  At most n_features + 2 sums reach the driver in a step."""

    def of(theta: np.ndarray) -> tuple[float, np.ndarray]:
        rows = sets.mapInArrow(_slopes(posterior, theta), "i bigint, value double").groupBy("i").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(len(theta) + 1)
        out[rows.column("i").to_numpy()] = rows.column("value").to_numpy()
        held = np.append(theta[:-1], 0)
        return float(out[-1] + ridge * (held @ held) / 2), out[:-1] + ridge * held

    return lbfgs(of, np.zeros(n_features + 1))


def _scored(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighty = np.append(weights != 0, False)
        for batch in batches:
            for chunk in textkit.chunks(batch.column(2)):
                words = words_of(chunk)
                feature = _feature(words)
                doc, feature = words.holding(np.where(weighty[feature], feature, -1))
                logit = np.bincount(doc, weights=weights[feature], minlength=chunk.n) + bias
                rows = slice(chunk.first, chunk.first + chunk.n)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], ["doc_id", "held_out", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weights of 2^BITS features, intercept) of a text's logit."""
    lexicon = mine(docs, labels)
    weights, bias = np.zeros(1 << BITS), float(np.log(lexicon.share / (1 - lexicon.share)))
    if not len(lexicon.hashes):
        return weights, bias
    with passing(docs.sparkSession):
        # at most 2^VOTERS patterns and 2^BITS features reach the driver, whatever the documents
        patterns = docs.select("text").mapInArrow(_patterns(lexicon), "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
        known, counts = (patterns.column(c).to_numpy() for c in ("pattern", "n"))
        if not len(known):
            return weights, bias
        posterior = Posterior(known, LabelModel(known, counts, lexicon.share).posterior(known))
        trained = docs.filter(~held_out(F.col("doc_id"))).select("text")
        rows = trained.mapInArrow(_evidence(lexicon, posterior), "feature bigint, df bigint, toxic double").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("toxic").alias("toxic")).toArrow()
        df, toxic = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        at = rows.column("feature").to_numpy()
        df[at], toxic[at] = rows.column("df").to_numpy(), rows.column("toxic").to_numpy()
        chosen = telling(df[:-1], toxic[:-1], df[-1], toxic[-1])
        sets = trained.mapInArrow(_sets(lexicon, chosen), "pattern bigint, features array<int>").groupBy("pattern", "features").agg(F.count(F.lit(1)).alias("n"))
        theta = train(saved(sets, "sets"), posterior, len(chosen))
    weights[chosen] = theta[:-1]
    return weights, float(theta[-1])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    docs = docs.select("doc_id", "text")
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_scored(*fit(docs, labels)), "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
