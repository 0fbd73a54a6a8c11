import random
import re

import numpy as np
import pyarrow as pa
import pytest

from isolens.llm import decontamination as d
from isolens.llm import textkit
from isolens.llm.queries import op5_decontamination

VOCABULARY = [f"w{i}" for i in range(400)] + ["the", "of"] * 40


def words(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prefix_distance(item, text):
    row = list(range(len(text) + 1))
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(item, text, rate=d.RATE):
    item, text = words(item), words(text)
    most = int(rate * len(item))
    return min((prefix_distance(item, text[s : s + len(item) + most]) for s in range(len(text))), default=10**9) <= most


def edited(rng, text, k):
    out = text.split()
    for _ in range(k):
        i = rng.randrange(len(out))
        match rng.randrange(3):
            case 0:
                out[i] = rng.choice(VOCABULARY)
            case 1:
                del out[i]
            case 2:
                out.insert(i, rng.choice(VOCABULARY))
    return " ".join(out)


def test_edits_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        m, most = rng.randint(2, 9), rng.randint(0, 3)
        items = np.array([[rng.randint(1, 4) for _ in range(m)] for _ in range(8)], np.uint64)
        texts = np.array([([rng.randint(1, 4) for _ in range(rng.randint(0, m + most))] + [0] * (m + most))[: m + most] for _ in range(8)], np.uint64)
        got, length = d.edits(items, texts, most)
        for item, text, g, n in zip(items.tolist(), texts.tolist(), got, length):
            text = [w for w in text if w]
            want = prefix_distance(item, text)
            assert g == want if want <= most else g > most


def test_recall_against_brute_force_and_no_false_match():
    rng = random.Random(11)
    items = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(8, 45))) for _ in range(60)]
    texts = []
    for n in range(240):
        item = items[n % 60]
        passage = edited(rng, item, rng.randint(0, max(1, int(0.22 * len(item.split())))))
        around = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 120))) for _ in range(2)]
        texts.append(f"{around[0]} {passage} {around[1]}" if n % 4 else around[0])
    index = d.Items(list(enumerate(items)))
    found = set()
    for chunk in textkit.chunks(pa.array(texts), 20_000):
        found |= {(int(r[0]) + chunk.first, int(r[1])) for r in index.search(chunk)}
    pairs = {(n, n % 60) for n in range(240) if brute(items[n % 60], texts[n])}
    assert len(pairs & found) >= 0.95 * len(pairs) and len(pairs) > 100
    assert all(brute(items[i], texts[n]) for n, i in found)


def test_edge_rows(spark):
    item = "One two three, four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, item, 0), (3, item, 0), (4, "é " * 300_000 + item.upper().replace(" ", "\n"), 0), (5, "alone", 0), (None, item, 0)], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, ""), (10, "alone"), (None, "x y")], "item_id bigint, text string")
    got = d.find_passages(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=str) == sorted([(3, 7, 0), (3, 7, 0), (4, 7, 0), (None, 7, 0)], key=str)
    assert sorted((r.doc_id or 0) for r in d.find_passages(docs, bench, block=20).collect()) == [0, 3, 3, 4]
    assert d.find_passages(docs.limit(0), bench).count() == d.find_passages(docs, bench.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    found = {(r.doc_id, r.item_id) for r in op5_decontamination(spark, sf).collect()}
    exact = {(a.doc_id, b.item_id) for a in docs for b in bench if b.text in a.text}
    assert exact and exact <= found
    texts, items = {a.doc_id: a.text for a in docs}, {b.item_id: b.text for b in bench}
    assert all(brute(items[i], texts[n]) for n, i in found - exact)


@pytest.mark.parametrize("m", [5, 7, 10, 15, 20, 31, 32, 45, 59, 60, 63, 64, 100, 127, 128, 300, 600])
@pytest.mark.parametrize("rate", [0.1, 0.15, d.RATE])
def test_recall_by_length_and_rate_of_edits(m, rate):
    rng = random.Random(f"{m} {rate}")
    fresh = lambda n: [rng.randrange(1, 1 << 63) for _ in range(n)]
    items = [fresh(m) for _ in range(200)]
    group = d.Group(1 << (m.bit_length() - 1), [(i, np.array(x, np.uint64)) for i, x in enumerate(items)], d.RATE)
    windows = []
    for item in items:
        text = list(item)
        for _ in range(int(rate * m)):
            i = rng.randrange(len(text))
            taken, given = rng.choice([(1, 1), (1, 0), (0, 1)])
            text[i : i + taken] = fresh(given)
        windows.append((text + fresh(group.width))[: group.width])
    windows = np.array(windows, np.uint64)
    near = {(int(w), int(i)) for w, i in zip(*group.verified(windows, np.arange(200), np.arange(200))[:2])}
    assert len(near) > 190
    found = set(zip(*(x.tolist() for x in group.candidates(windows))))
    assert len(near & found) >= 0.95 * len(near)


def test_items_without_id_are_searched(spark):
    one, two, three = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue white black pink")
    docs = spark.createDataFrame([(1, f"x {one} y {two}"), (2, f"{three} z"), (3, "nothing of it")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, one), (None, one), (None, two), (0, three)], "item_id bigint, text string")
    for block in (d.BLOCK, 20):
        got = d.find_passages(docs, bench, block=block).collect()
        assert sorted((r.doc_id, str(r.item_id), r.item_words) for r in got) == [(1, "None", 6), (1, "None", 7), (2, "0", 6)]
        assert [r.doc_id for r in d.clean_documents(docs, bench, block=block).collect()] == [3]


def test_results_do_not_depend_on_blocks(spark):
    """An item with two texts is one item however small the blocks are; a rate that the lemma cannot serve is refused."""
    texts = ["one two three four five six seven", "eight nine ten eleven twelve thirteen", "red green blue white black pink"]
    docs = spark.createDataFrame([(1, f"x {texts[0]} y {texts[1]}"), (2, f"{texts[2]} z")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(4, texts[0]), (4, texts[1]), (5, texts[2])], "item_id bigint, text string")
    rows = [sorted(map(tuple, d.find_passages(docs, bench, block=block).collect())) for block in (d.BLOCK, 20, 5)]
    assert rows[0] == rows[1] == rows[2] and [r[:2] for r in rows[0]] == [(1, 4), (2, 5)]
    with pytest.raises(ValueError):
        d.find_passages(docs, bench, rate=0.5)


def test_walks_follow_from_the_recall():
    assert d.walks(16, d.RATE, 0.5) < d.walks(16, d.RATE, 0.98) and d.walks(16, 0.05, 0.98) < d.walks(16, d.RATE, 0.98)
