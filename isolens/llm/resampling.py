"""Quality classifier by importance resampling.

Texts become bags of hashed unigrams and bigrams (words and runs of punctuation, lower-cased).  Two
generative models are estimated over 2^BITS buckets: one for target texts, the rows labelled of good quality
(a bounded sample: of MOST_LABELLED labelled rows, the first by hash of doc_id), and one for raw text, counted over all
documents.  A text's log importance weight is the log ratio of its probabilities in the two: the sum of the log ratios
of its n-grams, whatever their number.  The target model is smoothed towards the raw one, so that a bucket of which
nothing is known says nothing.

A sample without replacement of size k is drawn by Gumbel top-k: each row's key is its log weight plus
a Gumbel variable from a hash of its id, and the k largest keys are selected.  k defaults to a share of the rows: that of
good texts among the labelled.  The k-th key is found exactly by counting the keys of ever smaller intervals, so nothing
is sorted or gathered.

A null or empty text has weight 1 (log weight 0); equal keys at the threshold are selected together; repeated rows
give a row each; without good labels every weight is 1 and all rows are selected; an empty table gives no rows.  A text of
any length is weighed whole.  resample ignores columns besides doc_id and text, select_rows returns them as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isolens.llm import textkit
from isolens.llm.scratch import apart, saved

BITS = 15
MOST_LABELLED = 20_000
#: Observations in each bucket, at the raw model's rate, that the target model starts from.
PRIOR = 8.0

_CLASS = np.array([0 if textkit.SPACE[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def features(chunk: textkit.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each unigram and bigram."""
    low = textkit.LOWER[chunk.data]
    at = textkit.runs(textkit.Chunk(0, low, chunk.offsets), _CLASS)
    h = textkit.Hasher(low)(at.start, at.end)
    first, pairs = textkit.ngrams(h, at.doc, 2)
    doc = np.concatenate([at.doc, at.doc[first]])
    return doc, (np.concatenate([h, pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for chunk in textkit.chunks(batch.column(0)):
            total += np.bincount(features(chunk)[1], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the texts; at most 2^BITS rows reach the driver."""
    rows = docs.select("text").mapInArrow(_counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log of target over raw probability of each bucket."""
    expected = target.sum() * raw / max(raw.sum(), 1)
    return np.log((target + prior) / (expected + prior))


def _weighed(ratios: np.ndarray, text: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textkit.chunks(batch.column(text)):
                doc, bucket = features(chunk)
                n = np.bincount(doc, minlength=chunk.n)
                weight = np.bincount(doc, weights=ratios[bucket], minlength=chunk.n).astype(float)  # of no n-grams it is a count
                own = batch.slice(chunk.first, chunk.n)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n), pa.array(weight)], names)

    return run


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs with n_features and log_weight."""
    fields = [*docs.schema.fields, T.StructField("n_features", T.LongType()), T.StructField("log_weight", T.DoubleType())]
    return docs.mapInArrow(_weighed(ratios, docs.columns.index("text"), [f.name for f in fields]), T.StructType(fields))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A standard Gumbel variable that the id and the seed determine."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of the column key, exactly: each pass narrows an interval to one of its 4096 parts."""
    low, high, above = (lambda r: (r.low, r.high, 0))(keys.agg(F.min("key").alias("low"), F.max("key").alias("high")).first())
    while True:
        width = (high - low) / 4096
        if not width or low + width == low:
            return high
        part = F.least(F.floor((F.col("key") - low) / width), F.lit(4095))
        inside = keys.filter(F.col("key").between(low, high)).groupBy(part.alias("part"))
        rows = sorted(inside.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), key=lambda r: -r.part)
        for r in rows:
            if above + r.n >= k:
                break
            above += r.n
        if r.low == r.high:
            return r.low
        low, high = r.low, r.high


def _fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the share of good texts among the labelled."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = docs.select("doc_id").join(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).hint("broadcast"), "doc_id")
    known = saved(known.distinct(), "labelled")
    target = bucket_counts(docs.join(F.broadcast(known.filter("quality = 1")), "doc_id"))
    if not target.any():
        return np.zeros(1 << BITS), 1.0
    share = known.agg(F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0))).first()[0]
    return log_ratios(target, bucket_counts(docs)), share


def _key(seed: int) -> Column:
    return F.col("log_weight") + gumbel(F.col("doc_id"), seed)


def _threshold(keyed: DataFrame, k: int | None, share: float) -> float:
    """The least key that is selected."""
    n = keyed.count()
    k = math.ceil(share * n) if k is None else k
    if k >= n:
        return -math.inf
    return kth_largest(keyed.select("key"), k) if k > 0 else math.inf


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, n_features, log_weight, key and selected for every row of docs."""
    docs = docs.select("doc_id", "text")
    ratios, share = _fit(docs, labels)
    keyed = saved(weigh(docs, ratios).select("doc_id", "n_features", "log_weight", _key(seed).alias("key")), "keyed")
    return keyed.withColumn("selected", F.col("key") >= _threshold(keyed, k, share))


def select_rows(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7) -> DataFrame:
    """The rows of docs that are selected, as they are.  Texts are weighed once for the threshold and once for the selection, which costs less than a join."""
    own = docs.select("doc_id", "text")
    ratios, share = _fit(own, labels)
    least = _threshold(saved(weigh(own, ratios).select(_key(seed).alias("key")), "keyed"), k, share)
    return weigh(apart(docs, "doc_id", "text"), ratios).filter(_key(seed) >= least).drop("n_features", "log_weight").toDF(*docs.columns)
