import random
import re

import numpy as np
import pytest

from isolens.llm import jaccard_join as j
from isolens.llm.components import components, extended
from isolens.llm.queries import op10_jaccard_join

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def brute(texts, n, least):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {i: shingles(t, n) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=12, copies=14):
    """Chains of ever more edited copies, exact copies, passages that many texts share, texts of few words, none."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([6, 20, 60, 150]))]
        for c in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                match rng.randrange(3):
                    case 0:
                        own[rng.randrange(len(own))] = rng.choice(words)
                    case 1:
                        own.insert(rng.randrange(len(own)), rng.choice(words))
                    case 2:
                        del own[rng.randrange(len(own))]
            texts.append(" ".join(own).upper() if c % 5 == 0 else "\n".join(own))
            if c % 4 == 0:
                base = own
    texts += [f"{' '.join(rng.choice(words) for _ in range(rng.randint(0, 12)))} {passage} {' '.join(rng.choice(words) for _ in range(rng.randint(0, 12)))}" for _ in range(60)]
    texts += ["a b c", "A  b\tc", "a b", "a", "", "   ", None, "a b c d", "a b c d"]
    rng.shuffle(texts)
    return dict(enumerate(texts))


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed,n,least,block,common", [(1, 4, 85, 8192, 200_000), (2, 5, 80, 16, 5), (3, 4, 85, 8, 0), (4, 1, 50, 40, 10)])
def test_components_equal_brute_force(spark, monkeypatch, seed, n, least, block, common):
    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j, "MOST_COMMON", common)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id bigint, text string, class string, size int")
    assert got(j.similar_documents(docs, n, least)) == brute(texts, n, least)


def test_no_pairs_of_a_large_group(spark):
    """Near copies in the square of their number would be 180,000 pairs."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(200)]
    texts = {}
    for i in range(600):
        own = list(base)
        own[rng.randrange(200)] = f"x{i}"
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    sets, classes, links, _ = j.join_classes(docs, 4, 85)
    assert classes.count() == 600 and links.count() < 20 * 600
    assert got(j.similar_documents(docs, 4, 85)) == {i: (len(shingles(texts[i], 4)), 0) for i in texts}


def test_edge_rows(spark):
    rows = [(None, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "a b c d e f g h"), (9, "A b c d e f g h"), (7, "q " * 200_000), (8, None), (5, "other words here too")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.similar_documents(docs, 4, 85).collect()), key=str)
    assert out == sorted([(None, 5, None), (5, 5, 5), (5, 5, 5), (9, 5, 5), (7, 1, 7), (8, 0, 8), (5, 1, 5)], key=str)
    assert j.similar_documents(docs.limit(0), 4, 85).count() == 0
    assert got(j.similar_documents(docs.filter("doc_id = 8"), 4, 85)) == {8: (0, 8)}


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 50)] + [(300 + i, 300 + (i + 1) % 30) for i in range(30)] + [(500, 500)]
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.root, set()).add(r.v)
    assert sorted(map(min, by.values())) == [0, 200, 300] and {len(v) for v in by.values()} == {101, 50, 30}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_may_come_later(spark):
    roots = components(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a bigint, b bigint"))
    rows = extended(roots, spark.createDataFrame([(2, 4), (7, 8), (8, 5), (1, 2)], "a bigint, b bigint")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.root, set()).add(r.v)
    assert sorted(map(sorted, by.values())) == [[1, 2, 3, 4], [5, 6, 7, 8]]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert got(op10_jaccard_join(spark, d)) == brute(texts, 4, 85)
    assert np.unique([v[1] for v in brute(texts, 4, 85).values()]).size < len(texts)
