import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from isolens.llm import resampling as r
from isolens.llm import textkit
from isolens.llm.queries import op2_resampling


def test_kth_largest_is_exact(spark):
    values = [*np.random.default_rng(3).normal(size=500) * 1e6, 5.0, 5.0, 5.0, -1e300, 1e300, 0.0]
    keys = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in (1, 2, 250, 500, len(values)):
        assert r.kth_largest(keys, k) == sorted(values)[-k]
    assert r.kth_largest(spark.createDataFrame([(2.0,)] * 9, "key double"), 4) == 2.0


def test_keys_are_gumbel(spark):
    x = np.array([v.g for v in spark.range(20_000).select(r.gumbel(F.col("id"), 7).alias("g")).collect()])
    assert abs(x.mean() - 0.5772) < 0.03 and abs(x.var() - np.pi**2 / 6) < 0.06


def test_weights_tell_target_from_raw(spark):
    good = [f"the river runs past house {i} and the garden" for i in range(200)]
    bad = [f"buy*** now!!! {i} $$$ cheap### pills" for i in range(200)]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(good + bad)] + [(1000, None, 0.0), (1001, "", 0.0)], "doc_id bigint, text string, key double")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 400, 4)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    rows = {x.doc_id: x for x in r.resample(docs, labels).collect()}
    assert sum(rows[i].selected for i in range(200)) >= 198 and sum(rows[i].selected for i in range(200, 400)) <= 2
    assert rows[1000].log_weight == rows[1001].log_weight == 0
    assert r.resample(docs, labels, k=10).filter("selected").count() == 10
    assert r.resample(docs, labels.limit(0)).filter("selected").count() == 402
    assert r.resample(docs.limit(0), labels).count() == 0
    assert r.resample(docs.union(docs), labels).count() == 804


def bucket(words):
    """The bucket of one unigram or bigram, asked for alone."""
    chunk = next(textkit.chunks(pa.array([" ".join(words)])))
    return int(r.features(chunk)[1][-1])


def test_weights_equal_brute_force(spark):
    """n-grams by a regular expression, counts by dictionaries, the whole text's log probability ratio; long texts too."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÄB", "&&&", "!?"]
    texts = {i: " ".join(rng.choice(words, int(rng.choice([0, 1, 3, 40, 700])), p=None)) for i in range(120)}
    labels = {i: int(i % 3 > 0) for i in range(0, 120, 2)}
    grams = {}
    for i, text in texts.items():
        parts = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\x80-\U0010ffff\s]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams[i] = [(w,) for w in parts] + list(zip(parts, parts[1:]))
    known = {g: bucket(g) for own in grams.values() for g in own}
    raw, target = Counter(known[g] for own in grams.values() for g in own), Counter(known[g] for i, own in grams.items() if labels.get(i) for g in own)
    scale = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + r.PRIOR) / (scale * raw[b] + r.PRIOR)) for b in raw}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    rows = r.resample(docs, spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int")).collect()
    for x in rows:
        assert x.n_features == len(grams[x.doc_id]) and abs(x.log_weight - sum(ratio[known[g]] for g in grams[x.doc_id])) < 1e-9
    k = math.ceil(sum(labels.values()) / len(labels) * len(rows))
    assert {x.doc_id for x in rows if x.selected} == {x.doc_id for x in sorted(rows, key=lambda x: -x.key)[:k]}


def test_ties_at_the_threshold_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "same words"), (1, "same words"), (2, "ba " * 300_000), (3, "&& " * 2000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id bigint, quality int")
    rows = r.resample(docs, labels, k=2).collect()
    assert len(rows) == 4 and sum(x.selected for x in rows if x.doc_id == 1) in (0, 2)
    best = sorted((x.key for x in rows), reverse=True)[1]
    assert all(x.selected == (x.key >= best) for x in rows)


def test_query(spark):
    d = "/root/testdata/sf0.01"
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op2_resampling(spark, d).collect()
    assert len(rows) == 1000
    kept = [x.selected for x in rows if labels.get(x.doc_id) == 1]
    junk = [x.selected for x in rows if labels.get(x.doc_id) == 0]
    assert sum(kept) >= 0.97 * len(kept) and sum(junk) <= 0.1 * len(junk)
