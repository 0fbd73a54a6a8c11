import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from isolens.llm import quality_rules as q
from isolens.llm import textkit
from isolens.llm.queries import op9_quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked), len(text.encode())]


PIECES = ["a", "b", " ", "\n", "a b a b a b a b a b", "\t", "é", "漢😀", "#*$%&|<>", "line\n", "line\n", "\x0b", " "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), max_size=5))
def test_stats_equal_brute_force(texts):
    got = [x for chunk in textkit.chunks(pa.array(texts, pa.string())) for x in np.stack(q.stats(chunk), axis=1).tolist()]
    assert got == [brute(t) for t in texts]


def brute_model(rows, order):
    """Modified Kneser-Ney by dictionaries, straight from its definition."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        raw = b"\0" * (order - 1) + text.encode()
        for i in range(order - 1, len(raw)):
            counts[lang][raw[i - order + 1 : i + 1]] += 1
    out = {}
    for lang, top in counts.items():
        levels = {order: top}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        probs = {}
        for k in range(1, order + 1):
            n = [sum(c == i for c in levels[k].values()) for i in range(1, 5)]
            if all(n[:3]):
                y = n[0] / (n[0] + 2 * n[1])
                d = [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i] / n[i - 1])) for i in (1, 2, 3)]
            else:
                d = [0.5, 1.0, 1.5]
            total, spare = Counter(), Counter()
            for g, c in levels[k].items():
                total[g[:-1]] += c
                spare[g[:-1]] += d[min(c, 3) - 1]
            for g, c in levels[k].items():
                lower = 1 / 256 if k == 1 else probs[g[1:]]
                probs[g] = (c - d[min(c, 3) - 1]) / total[g[:-1]] + spare[g[:-1]] / total[g[:-1]] * lower
        out[lang] = probs
    return out


ROWS = [("en", "the cat sat on the mat. the cat ran"), ("en", "a dog and the cat"), ("fr", "le chat et le chien é"), ("", "zz zz")]


def test_model_and_scores_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, lang or None, 0) for i, (lang, t) in enumerate([*ROWS, ROWS[0]])], "doc_id bigint, text string, lang string, logp int")
    grams = q.count_grams(docs.limit(4), 3)
    new = docs.unionByName(spark.createDataFrame([(9, "the cow\nsat é", "en", 0), (10, None, "xx", 0), (11, "unknown", "xx", 0), (9, "the cow\nsat é", "en", 0)], docs.schema))
    answers = q.kneser_ney(grams, q.count_grams(new, 3), 3).cache()
    want = brute_model(ROWS, 3)
    got = {(r.lang, r.gram.to_bytes(3, "big")): r.logp for r in answers.collect()}
    for lang, probs in want.items():
        seen = [g for g in probs if len(g) == 3]
        assert all(abs(got[lang, g] - math.log(probs[g])) < 1e-9 for g in seen)
    rows = []
    for shard, kept in ((10**6, 12), (20, 12), (7, 1)):
        table = q.shards(answers, answers.count(), shard)
        rows.append(sorted(((r.doc_id, r.lang, r.n_words, r.logp) for r in q.score(new, table, 3, kept).collect()), key=str))
    assert len(rows[0]) == new.count() and rows[0] == rows[1] == rows[2]
    by = {r[:2]: r[3] for r in rows[0]}
    assert by[0, "en"] == pytest.approx(sum(math.log(want["en"][g]) for g in [(b"\0\0" + ROWS[0][1].encode())[i : i + 3] for i in range(len(ROWS[0][1]))]), abs=1e-3)
    assert by[11, "xx"] == pytest.approx(-7 * math.log(256), abs=1e-3)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "w " * 200_000, "en"), (3, "w " * 200_000, "en")], "doc_id bigint, text string, lang string")
    got = sorted((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in q.judge(docs).collect())
    assert got == [(1, 0, 0, True, False), (2, 0, 0, True, False), *2 * [(3, 200_000, 200_000, True, False)]]
    assert q.judge(docs.limit(0)).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    rows = op9_quality_rules(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want[:5]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.95 * len(good)


def test_labelled_junk_is_rejected_beyond_the_base_rules(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in op9_quality_rules(spark, "/root/testdata/sf0.01").collect() if not r.base_failed]
    good, bad = ([r for r in rows if labels.get(r.doc_id) == k] for k in (1, 0))
    assert len(bad) > 20 and sum(not r.kept for r in bad) >= 0.5 * len(bad)
    assert sum(r.kept for r in good) >= 0.95 * len(good)


@pytest.mark.parametrize("shard", [10**6, 50])
def test_no_text_vouches_for_itself(spark, shard):
    texts = [f"the cat number {i} sat on the {'mat' if i % 3 else 'roof'} and saw {i * i} dogs" for i in range(12)]
    docs = spark.createDataFrame([*((i, t, "en") for i, t in enumerate(texts)), (12, texts[0], "en"), (13, texts[0], None)], "doc_id bigint, text string, lang string")
    half = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "pmod(xxhash64(text), 2) AS h").collect()}
    ids = {h: [i for i in range(13) if half[i] == h] for h in (0, 1)}
    assert all(len(own) > 1 for own in ids.values())
    models = {h: brute_model([("en", [*texts, texts[0]][i]) for i in ids[1 - h]], 3)["en"] for h in (0, 1)}
    got = {r.doc_id: r for r in q.judge(docs, 3, shard=shard, kept=2).collect()}

    def logp(model, text):
        raw, out = b"\0\0" + text.encode(), 0.0
        contexts = {g[:-1] for g in model}
        for i in range(len(text)):
            for g in (raw[i : i + 3], raw[i + 1 : i + 3], raw[i + 2 : i + 3]):
                if g in model:
                    out += math.log(model[g])
                    break
                out += math.log(spare(model, g[:-1])) if g[:-1] in contexts else 0
            else:
                out -= math.log(256)
        return out

    def spare(model, context):
        # what the context's own n-grams leave, for what the next shorter context gives them
        kept = sum(p for g, p in model.items() if len(g) == len(context) + 1 and g[:-1] == context)
        lower = sum(model[g[1:]] if len(g) > 1 else 1 / 256 for g in model if len(g) == len(context) + 1 and g[:-1] == context)
        return (1 - kept) / (1 - lower)

    for i in range(13):
        text = [*texts, texts[0]][i]
        assert got[i].entropy == pytest.approx(-logp(models[half[i]], text) / len(text), abs=1e-3)
        assert got[i].word_entropy == pytest.approx(got[i].entropy * len(text) / len(text.split()))
    assert got[13].entropy == pytest.approx(math.log(256)) and got[13].kept
