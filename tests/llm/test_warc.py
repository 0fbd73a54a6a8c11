import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from isolens.llm import queries as q
from isolens.llm import warc


def row(spark, url):
    return spark.range(1).select(warc.canonical_url(F.lit(url))).first()[0]


def test_canonical_urls(spark):
    assert row(spark, "HTTP://User@Example.COM:80/A/b/?z=1&a=2&utm_source=x&ref=q#frag") == "example.com/A/b?a=2&z=1"
    assert row(spark, "https://example.com:8443") == "example.com:8443"
    assert row(spark, "https://example.com/?") == "example.com" and row(spark, "no url") is None and row(spark, None) is None


def brute(records):
    """{record_id: (response_id, outcome)} by looking through all earlier responses."""
    by = defaultdict(list)
    for r in records:
        if r[3] == "response" and r[4] == 200 and r[1]:
            by[r[1]].append(((r[2] is not None, r[2] or 0), r[0], r[5] or {}))
    out = {}
    for rid, url, ts, kind, _, headers, _ in records:
        if kind != "revisit":
            continue
        at = ((ts is not None, ts or 0), rid)
        earlier = max((x for x in by.get(url, []) if (x[0], x[1]) < at), default=None, key=lambda x: x[:2])
        mine = {k.lower(): v for k, v in (headers or {}).items()}
        if earlier is None:
            out[rid] = (None, "no_response")
            continue
        old = {k.lower(): v for k, v in earlier[2].items()}
        if "etag" in mine:
            same = mine["etag"].removeprefix("W/") == old.get("etag", "?").removeprefix("W/")
        elif "last-modified" in mine:
            same = mine["last-modified"] == old.get("last-modified")
        else:
            out[rid] = (earlier[1], "no_validator")
            continue
        out[rid] = (earlier[1], "resolved" if same else "mismatch")
    return out


@pytest.mark.parametrize("slices", [1, 7, 64])
def test_as_of_join_equals_brute_force(spark, slices):
    rng = random.Random(slices)
    urls = ["https://a.example/x"] * 6 + [f"https://b.example/{i}" for i in range(5)] + [None]
    records = []
    for i in range(600):
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        headers = rng.choice([None, {}, {"ETag": f'"{rng.randint(0, 2)}"'}, {"etag": f'W/"{rng.randint(0, 2)}"'}, {"Last-Modified": str(rng.randint(0, 2))}])
        records.append((i, rng.choice(urls), rng.choice([None, *range(60)]), kind, rng.choice([200, 200, 404]) if kind == "response" else 304, headers, f"p{i}"))
    df = spark.createDataFrame([(*r, 0) for r in records], warc.RECORD + ", slice int")
    rows = warc.resolve_revisits(df, payload=True, slices=slices).collect()
    assert {r.record_id: (r.response_id, r.outcome) for r in rows} == brute(records) and len(rows) == len(brute(records))
    assert all(r.payload == (f"p{r.response_id}" if r.outcome == "resolved" else None) for r in rows)


def test_headers_that_may_change(spark):
    rows = [(1, "http://a.b/", 1, "response", 200, {"ETag": "1", "Content-Length": "5", "Vary": "x", "X-Own": "y"}, "body"), (2, "https://A.b", 2, "revisit", 304, {"etag": "W/1", "content-length": "0", "Vary": "z", "X-New": "n", "Date": "d"}, None)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).first()
    assert got.headers == {"etag": "W/1", "content-length": "5", "vary": "z", "x-own": "y", "date": "d"}
    assert warc.resolve_revisits(spark.createDataFrame([], warc.RECORD)).count() == 0


def test_query_has_every_outcome(spark):
    assert {r.outcome for r in q.op4_revisits(spark, "/root/testdata/sf0.01").select("outcome").distinct().collect()} == {"resolved", "mismatch", "no_validator", "no_response"}


def test_revisits_without_or_with_a_common_id(spark):
    rows = [(1, "http://a.b/", 1, "response", 200, {"ETag": "1"}, "body")]
    rows += [(i, "http://a.b/", ts, "revisit", 304, headers, None) for i, ts, headers in ((None, 2, {"etag": "1"}), (None, 3, {"etag": "2"}), (7, 4, {"etag": "1"}), (7, 4, {"etag": "2"}), (7, 5, None))]
    got = warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).collect()
    want = [(None, 1, "resolved"), (None, 1, "mismatch"), (7, 1, "resolved"), (7, 1, "mismatch"), (7, 1, "no_validator")]
    assert sorted(((r.record_id, r.response_id, r.outcome) for r in got), key=str) == sorted(want, key=str)
