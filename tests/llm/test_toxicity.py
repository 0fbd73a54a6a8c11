import zlib

import numpy as np
import pyarrow as pa

from isolens.llm import textkit
from isolens.llm import toxicity as t
from isolens.llm.queries import op8_toxicity


def test_label_model_recovers_rates_and_finds_the_dependent_pair():
    rng = np.random.default_rng(1)
    n = 60_000
    y = rng.random(n) < 0.1
    v = np.zeros((n, t.VOTERS), int)
    for j in range(t.VOTERS):
        v[:, j] = rng.random(n) < np.where(y, 0.4, 0.01)
    copy = rng.random(n) < 0.9
    v[copy, 4] = v[copy, 3]
    patterns, counts = np.unique((v << np.arange(t.VOTERS)).sum(axis=1), return_counts=True)
    m = t.LabelModel(patterns, counts, 0.1)
    assert m.parent[4] == 3 or m.parent[3] == 4
    assert abs(m.share - 0.1) < 0.01 and abs(m.rates[1, 0, 0] - 0.4) < 0.05 and m.rates[0, 0, 0] < 0.02
    q = m.posterior((v << np.arange(t.VOTERS)).sum(axis=1))
    assert ((q > 0.5) == y).mean() > 0.98


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} " + "idiot " * (i % 3 == 0), 0.5) for i in range(300)] + [(None, "x", 0.0), (400, None, 0.0), (401, "", 0.0), (1, "plain words", 0.0), (402, "idiot " * 200_000, 0.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id bigint, toxic int")
    rows = t.score_toxicity(docs, labels).collect()
    assert len(rows) == 305 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and r.doc_id < 300)
    assert all(r.predicted == 0 for r in t.score_toxicity(docs, labels.limit(0)).collect())
    assert t.score_toxicity(docs.limit(0), labels).count() == 0


def test_query_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op8_toxicity(spark, d).collect()
    assert len(rows) == 10_000
    fold = [(toxic[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in toxic]
    hits, marked, real = sum(a & b for a, b in fold), sum(b for _, b in fold), sum(a for a, _ in fold)
    assert hits >= 0.8 * real and hits >= 0.97 * marked


def test_training_equals_brute_force(spark):
    """Evidence, choice of features, loss and gradient over whole texts against dictionaries; other cuts of the table change nothing."""
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("aro", "enilo", "usimota")]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 30)))) + (" idiot" * (i % 7 == 0)) + (" scum" * (i % 11 == 0))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 7 == 0 or i % 11 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    lexicon = t.mine(docs, labels)
    assert len(lexicon.hashes)
    bits = {i: int(t.votes(next(textkit.chunks(pa.array([text]))), lexicon)[0]) if text else 0 for i, text in rows}
    patterns, counts = np.unique(list(bits.values()), return_counts=True)
    posterior = t.Posterior(patterns, t.LabelModel(patterns, counts, lexicon.share).posterior(patterns))
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    features = {i: set(t._features(next(textkit.chunks(pa.array([text]))))[1].tolist()) if text else set() for i, text in rows if i not in held}
    q = {i: float(posterior(np.array([bits[i]]))[0]) for i in features}
    df, toxic = np.zeros(1 << t.BITS), np.zeros(1 << t.BITS)
    for i, own in features.items():
        df[list(own)] += 1
        toxic[list(own)] += q[i]
    chosen = t.telling(df, toxic, len(features), sum(q.values()))
    x = np.array([[f in features[i] for f in chosen] for i in features], float)
    y = np.array([q[i] for i in features])
    w, bias = np.zeros(len(chosen)), 0.0
    for _ in range(4000):
        r = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w, bias = w - 0.01 * (x.T @ r + t.RIDGE * w), bias - 0.01 * r.sum()
    weights, got_bias = t.fit(docs, labels)
    assert set(np.flatnonzero(weights)) <= set(chosen) and abs(got_bias - bias) < 0.1 and np.abs(weights[chosen] - w).max() < 0.1
    for r in t.score_toxicity(docs.repartition(2), labels).collect():
        own = set(t._features(next(textkit.chunks(pa.array([rows[r.doc_id][1]]))))[1].tolist()) if rows[r.doc_id][1] else set()
        assert abs(r.score - 1 / (1 + np.exp(-(sum(weights[f] for f in own) + got_bias)))) < 1e-6


def test_pattern_voters():
    lexicon = t.Lexicon(textkit.Hasher(np.frombuffer(b"idiot", np.uint8))(np.array([0]), np.array([5])), np.array([0]), 0.1)
    texts = ["you idiot", 'he said "idiot" once', "id1ot and sc*m", "WHAT NOISE here", "stop!! now", "plain " * 60, "", "a! !b"]
    bits = t.votes(next(textkit.chunks(pa.array(texts))), lexicon)
    have = [{v for v in range(t.VOTERS) if b >> v & 1} for b in bits]
    assert have == [{0, t.ADDRESSED}, {0, t.QUOTED}, {t.HIDDEN}, {t.CAPITALS}, {t.EXCLAIMED}, {t.PLAINLY}, set(), set()]


def test_words_are_read_once_a_chunk(monkeypatch):
    """Votes and features of a chunk come from the same words: one pass of hashing each for evidence and sets, whatever the texts."""
    lexicon = t.Lexicon(textkit.Hasher(np.frombuffer(b"idiot", np.uint8))(np.array([0]), np.array([5])), np.array([0]), 0.1)
    texts = ["you idiot", "plain " * 60, "", None, "ID1OT!! Idiot"]
    every = t.Posterior(np.arange(1 << t.VOTERS), np.full(1 << t.VOTERS, 0.5))
    made, plain = [], textkit.Hasher
    t._address()
    monkeypatch.setattr(textkit, "Hasher", lambda data, *seed: made.append(len(data)) or plain(data, *seed))
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])
    (seen,), (sets,) = t._evidence(lexicon, every)(batch()), t._sets(lexicon, np.arange(1 << t.BITS))(batch())
    assert made == [sum(len(x or "") for x in texts)] * 2
    assert seen.column(1).to_pylist()[-1] == 5 and [len(x) > 0 for x in sets.column(1).to_pylist()] == [True, True, False, False, True]


def test_words_and_patterns_equal_plain_ones():
    """Words, distinct features and pattern places of random texts against textkit.runs, marks() and plain Python, over ends of texts and empty ones."""
    rng = np.random.default_rng(5)
    parts = ["idiot", "IDIOT", "ABCDEFG", "ABCDeFG", "you", "é", "ÀBCDE", "a1b", "*", "!!", "!", " ", " ", "\n", '"', "x" * 40, "9", "-"]
    cases = [[], ["", None], ["a"], ["1"], ["a", "", "b", "1", "c"]] + [["".join(rng.choice(parts, int(rng.integers(0, 12)))) for _ in range(int(rng.integers(1, 40)))] for _ in range(60)]
    for texts in cases:
        for chunk in textkit.chunks(pa.array(texts, pa.string())):
            words, runs = t._lettered(chunk), textkit.runs(chunk, t._LETTER)
            assert all(np.array_equal(a, b) for a, b in zip(words, runs))
            doc, _, h = t.marks(chunk)
            assert set(zip(doc.tolist(), (h >> np.uint64(64 - t.BITS)).astype(int).tolist())) == set(zip(*(x.tolist() for x in t._features(chunk))))
            own = [chunk.data[a:b].tobytes() for a, b in zip(runs.start, runs.end)]
            assert t._capitals(chunk.data, runs).tolist() == [i for i, w in enumerate(own) if len(w) >= 4 and all(65 <= c <= 90 for c in w)]
            letter = lambda c: c >= 128 or chr(c).isalpha()
            raw = [chunk.data[a:b].tobytes() for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:])]
            new = np.zeros(len(chunk.data) + 1, bool)
            new[chunk.offsets[:-1]] = True
            hidden = [a + i for a, x in zip(chunk.offsets[:-1].tolist(), raw) for i in range(1, len(x) - 1) if chr(x[i]) in "*@$#0123456789" and letter(x[i - 1]) and letter(x[i + 1])]
            assert t._hidden(chunk.data, new[: len(chunk.data)]).tolist() == hidden
