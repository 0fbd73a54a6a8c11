import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from isolens.llm import mixing as m
from isolens.llm.queries import op1_mix_sources

SIZES = {"a": 300, "b": 60, "c": 12, "": 5}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, source or None, "w " * (1 + i % 7), 0.0) for source, n in SIZES.items() for i in range(1000 * len(source) + sum(map(ord, source)) * 1000, 1000 * len(source) + sum(map(ord, source)) * 1000 + n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string, weight double").cache()


def tokens(docs):
    out = Counter()
    for r in docs.collect():
        out[r.source or ""] += len(r.text.split()) or 1
    return out


def brute_exponent(counts, test):
    low, high = 0.0, 1.0
    for _ in range(48):
        mid = (low + high) / 2
        low, high = (mid, high) if test([(c / sum(counts)) ** mid for c in counts], [c / sum(counts) for c in counts]) else (low, mid)
    return low


def test_exponent_meets_the_targets(spark, docs):
    t = tokens(docs)
    by = spark.createDataFrame([(s, n, n / sum(t.values())) for s, n in t.items()], "source string, tokens bigint, share double")
    repeats = brute_exponent(list(t.values()), lambda w, p: max(x / y for x, y in zip(w, p)) / min(x / y for x, y in zip(w, p)) > 3.0)
    assert m.bisect_exponent(by, repeats=3.0) == pytest.approx(repeats, abs=1e-9)
    entropy = brute_exponent(list(t.values()), lambda w, p: -sum(x / sum(w) * math.log(x / sum(w)) for x in w) >= 1.0)
    assert m.bisect_exponent(by, entropy=1.0) == pytest.approx(entropy, abs=1e-9)


def test_every_document_once_and_none_beyond_the_limit(docs):
    t = tokens(docs)
    rows = m.mix(docs, repeats=3.0, block=200).collect()
    times = Counter((r.source, r.doc_id) for r in rows)
    assert set(times) == {(r.source or "", r.doc_id) for r in docs.collect()} and max(times.values()) <= 3 + 1
    assert len({(r.source, r.doc_id, r.epoch) for r in rows}) == len(rows)
    got = Counter()
    for r in rows:
        got[r.source] += r.tokens
    weight = {r.source: r.weight for r in rows}
    assert sum(weight.values()) == pytest.approx(1)
    total = sum(got.values())
    for s in t:
        assert abs(got[s] - weight[s] * total) <= 0.02 * total + 14
        assert got[s] / t[s] <= 3.0 + 14 / t[s]
    assert sorted((r.mix_block, r.mix_rank) for r in rows) == [(b, k + 1) for b, n in sorted(Counter(r.mix_block for r in rows).items()) for k in range(n)]
    assert {r.epoch for r in rows if r.source == "a"} == {0}


def test_blocks_hold_the_weights(docs):
    rows = m.mix(docs, exponent=0.5, block=400).collect()
    by, n_blocks = {}, 1 + max(r.mix_block for r in rows)
    for r in rows:
        by.setdefault(r.source, Counter())[r.mix_block] += r.tokens
    assert n_blocks >= 4
    for source in ("a", "b"):
        mean = sum(by[source].values()) / n_blocks
        assert all(0.5 * mean <= by[source][b] <= 1.6 * mean for b in range(n_blocks))


def test_a_budget_is_kept(docs):
    rows = m.mix(docs, exponent=0.0, budget=400, block=50).collect()
    got = Counter()
    for r in rows:
        got[r.source] += r.tokens
    assert all(100 <= got[s] <= 100 + 7 for s in SIZES)
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(m.mix(docs.repartition(3), exponent=0.0, budget=400, block=50).collect())]


def test_edge_rows(spark, docs):
    assert m.mix(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, None, None), (None, "s", ""), (2, "s", "w " * 100_000)], "doc_id bigint, source string, text string")
    rows = m.mix(odd).collect()
    assert Counter((r.doc_id, r.source, r.tokens) for r in rows if r.epoch == 0) == {(1, "", 1): 2, (None, "s", 1): 1, (2, "s", 100_000): 1}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = op1_mix_sources(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert rows.select("doc_id").distinct().count() == docs.count()
    per = rows.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("n")).collect()
    assert max(r.n for r in per) <= 5
