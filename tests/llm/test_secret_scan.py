import hashlib
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from isolens.llm import secret_scan as s
from isolens.llm import spans
from isolens.llm.queries import op3_secret_scan


def brute(text):
    out = []
    for rank, rule in enumerate(s.RULES):
        out += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(rule.pattern, text, rule.flags) if rule.holds is None or rule.holds(m)]
    return sorted(out)


PIECES = ["password", "ToKen", "api_key", "APIKEY", " = ", ": ", '"', "abcd1234+/", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "é漢😀", "\n", "ghp_", "x" * 40, "eyJ", "-----BEGIN RSA PRIVATE KEY-----", "sk_live_", "http://u:p@h", "xoxb-", ".", " "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), max_size=6))
def test_scan_equals_brute_force(texts):
    assert s.scan(pa.array(texts, pa.string()), s.RULES) == [brute(t) for t in texts]


def test_queries_of_patterns():
    assert s.trigram_query(r"[0-9a-f]{32,}") == s.ALL
    assert s.trigram_query("AKIA[A-Z0-9]+") == ("and", ("gram", b"aki"), ("gram", b"kia"))
    assert s.trigram_query("(abc|de)x*") == s.ALL
    assert s.trigram_query("(abc|xyz)[0-9]+") == ("or", ("gram", b"abc"), ("gram", b"xyz"))
    assert s.trigram_query("ab?cd") == ("or", ("and", ("gram", b"abc"), ("gram", b"bcd")), ("gram", b"acd"))


def test_edge_rows(spark):
    long = "é" * 300_000 + " token = abcdefgh1 "
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, long, "x"), (None, "password:12345678", "x"), (4, "password:1234567", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = spans.digests(s.find_secrets(docs), ["assign", "access", "hex"]).collect()
    empty = hashlib.sha256(b"").hexdigest()
    by = sorted(((r.doc_id, r.n_assign, r.base_sha256, r.spans) for r in got), key=str)
    one = "assign:300001:300018"
    assert by == sorted([(1, 0, empty, ""), (2, 0, empty, ""), (4, 0, empty, ""), *2 * [(3, 1, hashlib.sha256(one.encode()).hexdigest(), one)], (None, 1, hashlib.sha256(b"assign:0:17").hexdigest(), "assign:0:17")], key=str)
    assert s.find_secrets(docs.limit(0)).count() == 0


def test_query(spark):
    got = op3_secret_scan(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts) and got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    for r in rows:
        assert r.spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute(texts[r.doc_id]))


def test_long_secrets_are_found_whole():
    part = "aB3_-x" * 2000
    secrets = [f"eyJ{part}.{part}.{part}", f"ftp://{'u' * 500}:{'p' * 500}@", "ghp_" + "a1" * 400, "xoxb-" + "a1-" * 400, "sk_live_" + "Z9" * 400]
    for secret in [*secrets, f"eyJ.eyJx{secrets[0]}"]:
        text = f"see {secret} here"
        assert [text[a:b] for a, _, b, _ in s.scan(pa.array([text]), s.MORE_RULES)[0]] == [secret.removeprefix("eyJ.")]
    assert s.scan(pa.array(["eyJ" * 100_000]), s.MORE_RULES) == [[]]
