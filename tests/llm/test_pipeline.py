from collections import Counter

import pytest

import corpus_pipeline as p
from tests.llm.test_decontamination import brute as holds
from tests.llm.test_jaccard_join import brute as groups
from tests.llm.test_pii import brute as spans

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into each stage and those that come out of the last."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs.cache()]
    for _, stage in p.STAGES:
        out.append(stage(spark, out[-1], D).cache())
    return [df.collect() for df in out], [df.columns for df in out]


def test_columns_stay(stages):
    assert all(c == stages[1][0] for c in stages[1][:5])


def test_quality_keeps_the_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    before, after = ({r.doc_id: tuple(r) for r in rows} for rows in stages[0][:2])
    assert all(before[i] == row for i, row in after.items())
    good = [i for i in before if labels.get(i) == 1]
    bad = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in good) >= 0.95 * len(good) and sum(i in after for i in bad) <= 0.4 * len(bad)


def test_one_document_of_each_group_stays(stages):
    want = groups({r.doc_id: r.text for r in stages[0][1]}, 5, 80)
    assert {r.doc_id for r in stages[0][2]} == {root for _, root in want.values()}


def test_no_benchmark_passage_stays(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r.text for r in rows} for rows in stages[0][2:4])
    assert after.keys() <= before.keys()
    gone = before.keys() - after.keys()
    assert all(any(holds(item, before[i]) for item in items) for i in gone)
    assert not any(item in text for item in items for text in after.values())


def test_personal_data_is_replaced(stages):
    before, after = ({r.doc_id: r for r in rows} for rows in stages[0][3:5])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert (r.text == before[i].text) == (not spans(before[i].text)) or "[IBAN]" in r.text or "[SSN]" in r.text
        assert r.n_chars == len(r.text) or r.text == before[i].text
        assert not [s for s in spans(r.text) if s[3] in ("email", "ip")]


def test_every_document_is_in_the_mix(stages):
    before, after = stages[0][4:6]
    times = Counter(r.doc_id for r in after)
    assert times.keys() == {r.doc_id for r in before} and max(times.values()) <= 5
    texts = {r.doc_id: r.text for r in before}
    assert all(r.text == texts[r.doc_id] for r in after)


def test_run(spark, stages):
    assert Counter(r.doc_id for r in p.run(spark, D).collect()) == Counter(r.doc_id for r in stages[0][5])


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "s", 0), (None, None, None, None, None), (2, "", "en", None, 0), (3, "plain words of no interest at all", "xx", "s", 33), (3, "plain words of no interest at all", "xx", "s", 33)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string"
    docs = spark.createDataFrame([(*r, "x") for r in rows], schema)
    for name, table in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id bigint, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id bigint, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    assert Counter(r.doc_id for r in p.run(spark, str(tmp_path)).collect()) == {1: 1, None: 1, 2: 1, 3: 1}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
