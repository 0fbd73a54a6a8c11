import hashlib
import re

from pyspark.sql import functions as F

from isolens.llm import pii, spans
from isolens.llm.queries import op6_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


TEXTS = [
    None,
    "",
    "a@b.com.x@y.com a@b.com_foo@y.com x@y..z @q.r a.b%c+d-e@f-g.h.i. é漢😀k@l.mn",
    "1.2.3.4.5.6.7.8 256.1.1.1 00255.01.2.3 1..2.3.4 0.0.0.0 9999999999999999999999.1.1.1 1.2.3.4.",
    "4111 1111-1111 1111 4111111111111111 4111  111111111111 x4111111111111111-7 12-34 5 6 79927398713 000000000000 -4111111111111111-",
    "+1 (743) 555-3824 +12345678 +123456789 +1234567890123456 ++49 30 1234567. +4 9) +1-",
    "7" * 50_000 + " " + "a" * 50_000 + "@x" + ".y" * 20_000 + " " + "1 2-" * 20_000,
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, wrong DE88370400440532013000",
    "my ssn is 123-45-6789 and 000-12-3456" + " word" * 20 + " part 123-45-6789 serial",
    " ".join(["4111111111111111 1.2.3.4 a@b.c"] * 500),
]


def test_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, spans string")
    got = {r.doc_id: [(s.start, s.rank, s.end, s.kind) for s in r.spans if s.rank < 4] for r in pii.find_pii(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_added_kinds_and_scores(spark):
    docs = spark.createDataFrame([(i, TEXTS[i]) for i in (7, 8)], "doc_id bigint, text string")
    got = {r.doc_id: [(TEXTS[r.doc_id][s.start : s.end], x) for s, x in zip(r.spans, r.scores) if s.rank > 3] for r in pii.find_pii(docs).collect()}
    assert got == {7: [("DE89 3704 0044 0532 0130 00", 1.0), ("GB82WEST12345698765432", 1.0)], 8: [("123-45-6789", 0.6)]}


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd +4111111111111111 end"), (2, ""), (3, None), (4, "none")], "doc_id bigint, text string")
    found = pii.find_pii(docs, keep=("text",))
    got = {r.doc_id: r.t for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert got == {1: "é [EMAIL] +[CARD] end", 2: "", 3: None, 4: "none"}


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op6_pii(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in want) for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in want).encode()).hexdigest()
    assert spans.digests(pii.find_pii(spark.createDataFrame([], "doc_id bigint, text string")), ["email"]).count() == 0


def test_very_many_hits_in_one_text(spark):
    """Offsets, surroundings and redaction of 24,000 hits, code points beyond the basic plane between them."""
    text = "mail a@b.co 😀é 10.0.0.1 or " * 12_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find_pii(docs, keep=("text",))
    row = found.select("spans", "scores", pii.redacted(F.col("text"), F.col("spans")).alias("clean")).first()
    assert [(s.start, s.rank, s.end, s.kind) for s in row.spans] == brute(text)
    assert row.clean == "mail [EMAIL] 😀é [IP] or " * 12_000
    assert set(row.scores[::2]) == {1.0}


def test_blocks(spark):
    """Cuts at, before and beyond the borders of blocks are those of the text."""
    text = "".join(chr(97 + i % 26) if i % 7 else "😀" for i in range(3 * pii.BLOCK + 5))
    edges = [0, 1, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 2 * pii.BLOCK, len(text) - 1, len(text)]
    rows = [(text, a, b) for a in edges for b in [*edges, len(text) + 300]]
    got = spark.createDataFrame(rows, "text string, a int, b int").select("text", "a", "b", pii._cut(pii._blocks(F.col("text")), F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.x == r.text[r.a : r.b] for r in got)
