"""Operators that the catalogue does not reach: files, streams, the guardrail, the command line."""

import json
import random
import struct
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st_
from pyspark.sql import functions as F

from isolens import guardrail
from isolens.__main__ import main
from isolens.functions import wire
from isolens.operators import diff, proof, resolve, triage, writes
from isolens.operators.rowfilter import Legs, View, rows_of, spark_text
from isolens.sources import files
from isolens.streaming import capture


@pytest.fixture(scope="module")
def invoices(spark):
    return spark.createDataFrame([(1, "acme", "open", 100), (2, "globex", "open", 200), (3, None, "paid", 5)], "id bigint, tenant_id string, status string, amount int")


def test_shortfall_is_a_multiset_difference(spark):
    rng = random.Random(2)
    a, b = ([(rng.randint(0, 4), rng.choice([None, "x"])) for _ in range(40)] for _ in range(2))
    left, right = (spark.createDataFrame(x, "a int, b string") for x in (a, b))
    want = Counter(a) - Counter(b)
    assert diff.shortfall(left, right).count() == sum(want.values())
    row = diff.compare(left, right).first()
    assert (row.n_unrestricted, row.n_restricted, row.withheld_rows) == (40, 40, sum(want.values()))


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i % 5, str(i % 3)) for i in range(20)], "n int, t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(t,1)" in plan(rows_of(df, "t", "1")) and "EqualTo(n,3)" in plan(rows_of(df, "n", "3"))
    assert [rows_of(df, "n", x).count() for x in ("3", "03", "x", None)] == [4, 0, 0, 0]


def test_dialect():
    assert spark_text("SELECT '$1' FROM t WHERE a = $1::uuid AND b = $12 FOR UPDATE") == "SELECT '$1' FROM t WHERE a = :p1::string AND b = :p12 "
    assert spark_text("INSERT INTO t VALUES ($1) RETURNING *") == "INSERT INTO t VALUES (:p1) "


def test_legs_and_failures(spark, invoices):
    legs = Legs(spark, {"invoices": invoices}, {"invoices": "tenant_id"}, {"mine": View("SELECT * FROM invoices"), "all_": View("SELECT * FROM invoices", invoker=False)})
    u, r = legs.run("SELECT * FROM mine", [], "acme")
    assert (u.count(), r.count()) == (3, 1)
    assert legs.run("SELECT * FROM all_", [], "acme")[1].count() == 3
    found = {v.id: v for v in diff.diff_reads(legs, [diff.Captured("bad", "SELECT nothing FROM invoices WHERE tenant_id = $1", (diff.st.Param("acme"),)), diff.Captured("late", "SELECT 1 / (id - 1) FROM invoices WHERE tenant_id = $1", (diff.st.Param("acme"),)), diff.Captured("ok", "SELECT * FROM invoices WHERE tenant_id = $1", (diff.st.Param("acme"),)), diff.Captured("gone", None)], [diff.st.Scoped("invoices", "tenant_id")])}
    assert [found[k].verdict for k in ("bad", "late", "ok", "gone")] == ["UNATTRIBUTABLE", "UNATTRIBUTABLE", "SAFE", "UNATTRIBUTABLE"]
    assert found["bad"].reason.startswith("dialect:") and found["late"].reason.startswith("execution:")


def test_guardrail(spark, invoices):
    invoices.createOrReplaceTempView("invoices")
    g = guardrail.GuardedSession(spark, {"invoices": ("scoped", "tenant_id")})
    with pytest.raises(guardrail.NoTenantContext):
        g.sql("SELECT * FROM invoices")
    with guardrail.with_tenant("acme"):
        assert guardrail.tenant_from_context() == "acme"
        assert g.sql("SELECT * FROM invoices WHERE tenant_id = $1", ["acme"]).count() == 1
        for sql, args, error in (("SELECT * FROM invoices", [], guardrail.UnscopedQuery), ("SELECT * FROM invoices WHERE tenant_id = $1", ["globex"], guardrail.WrongTenant), ("SELECT * FROM nowhere", [], guardrail.Unattributable)):
            with pytest.raises(error):
                g.sql(sql, args)
    with guardrail.with_tenant(""), pytest.raises(guardrail.NoTenantContext):
        g.check("SELECT 1")
    assert not hasattr(g, "spark")


def test_guarded_writes_and_rows(spark, tmp_path):
    spark.sql(f"CREATE TABLE guarded (id BIGINT, tenant_id STRING) USING parquet LOCATION '{tmp_path / 'guarded'}'")
    try:
        g = guardrail.GuardedSession(spark, {"guarded": ("scoped", "tenant_id")})
        with guardrail.with_tenant("acme"):
            g.execute("INSERT INTO guarded (id, tenant_id) VALUES ($1, $2)", [1, "acme"])
            with pytest.raises(guardrail.WrongTenant):
                g.execute("INSERT INTO guarded (id, tenant_id) VALUES ($1, $2)", [2, "globex"])
            with pytest.raises(guardrail.Unattributable, match="not a write"):
                g.execute("SELECT * FROM guarded WHERE tenant_id = $1", ["acme"])
            for sql in ("INSERT INTO guarded (id, tenant_id) VALUES (3, $1)", "CREATE TABLE taken USING parquet AS SELECT * FROM guarded WHERE tenant_id = $1"):
                with pytest.raises(guardrail.Unattributable, match="not a query"):
                    g.sql(sql, ["acme"])
            assert tuple(g.first("SELECT * FROM guarded WHERE tenant_id = $1 ORDER BY id", ["acme"])) == (1, "acme")
            assert g.first("SELECT * FROM guarded WHERE tenant_id = $1 AND id = 9", ["acme"]) is None
        assert spark.table("guarded").count() == 1 and not spark.catalog.tableExists("taken")
    finally:
        spark.sql("DROP TABLE guarded")


def test_canaries(spark, invoices):
    seeded = proof.canaries(invoices, "tenant_id", ["id"])
    assert seeded.source == "sampled" and sorted((r.id, r.tenant_id, r.status) for r in seeded.rows.collect()) == [(1000, proof.CANARY_A, "open"), (1001, proof.CANARY_B, "open")]
    composite = proof.canaries(invoices, "tenant_id", ["tenant_id", "id"])
    assert sorted(r.id for r in composite.rows.collect()) == [1, 3]  # a null tenant sorts first
    empty = invoices.limit(0)
    assert proof.canaries(empty, "tenant_id").skipped == "0 rows and no fixture"
    given_ = proof.canaries(empty, "tenant_id", fixture=[{"id": "1", "amount": "2"}, {"id": "2", "status": "'x'"}])
    assert given_.source == "fixture" and sorted((r.id, r.tenant_id, r.status, r.amount) for r in given_.rows.collect()) == [(1, proof.CANARY_A, None, 2), (2, proof.CANARY_B, "x", None)]
    assert proof.canaries(invoices, "amount").skipped.startswith("tenant column of type int")


def test_writes(spark, invoices):
    assert writes.check_insert(invoices.filter("id = 1"), "tenant_id", "acme").first().verdict == "SAFE"
    assert writes.check_insert(invoices, "tenant_id", "acme").first().n_violations == 2
    assert writes.check_insert(invoices.limit(0), "tenant_id", "acme").first().vacuous
    new = spark.createDataFrame([(2, "acme", "open", 1), (1, "acme", "open", 1)], invoices.schema)
    assert {(r.outcome, r.n) for r in writes.conflicts(new, invoices, [["id"]], "tenant_id", "acme").collect()} == {("resolved", 1), ("unattributable", 1)}
    assert sorted(r.amount for r in writes.without_conflicts(new, invoices, ["id"]).collect()) == [1, 1, 5]


def test_files(spark, tmp_path):
    param = {"null": False, "format": "binary", "oid": 17, "value_known": False, "value": None, "value_base64": "AAE=", "unknown_reason": "no type"}
    events = spark.createDataFrame([(1, "bind", "", None, "SELECT 1", True, None, [param])], files.EVENT)
    files.write_events(events, str(tmp_path / "events"))
    back = files.read_events(spark, str(tmp_path / "events"))
    assert back.collect() == events.collect() and bytes(back.select(files.param_bytes(F.col("params")[0])).first()[0]) == b"\x00\x01"
    (tmp_path / "bad.json").write_text("{not json\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        files.read_events(spark, str(tmp_path / "bad.json")).collect()
    policy = spark.createDataFrame([("public", "t", "BASE TABLE", "scoped", "org_id", ["org_id"], "")], "schema string, name string, kind string, class string, tenant_column string, candidates array<string>, reason string")
    files.write_policy(policy, str(tmp_path / "policy"))
    assert files.read_policy(spark, str(tmp_path / "policy")).select(policy.columns).collect() == policy.collect()


@given(st_.lists(st_.binary(max_size=12), max_size=6), st_.lists(st_.integers(1, 9), max_size=40))
def test_framer_does_not_care_where_chunks_end(bodies, cuts):
    stream = b"".join(b"Q" + struct.pack(">i", len(b) + 4) + b for b in bodies)
    framer, out, at = wire.Framer(), [], 0
    for n in [*cuts, len(stream) + 1]:
        out += list(framer.push(stream[at : at + n]))
        at += n
    assert out == [("Q", b) for b in bodies]


def test_messages():
    bind = b"portal\0stmt\0" + struct.pack(">hh", 1, 1) + struct.pack(">h", 2) + struct.pack(">i", 4) + b"\0\0\0\x2a" + struct.pack(">i", -1) + struct.pack(">h", 0)
    m = wire.parsed("B", bind, "F")
    assert (m.stmt, m.portal, m.formats, m.values) == ("stmt", "portal", [1, 1], [b"\0\0\0\x2a", None])
    assert wire.parsed("B", bind[:-6], "F") is None and wire.parsed("P", b"no end", "F") is None
    assert wire.parsed("C", b"Sname\0", "F").type == "CS" and wire.parsed("C", b"Pname\0", "F").stmt is None
    assert wire.parsed("t", struct.pack(">hII", 2, 23, 25), "B").oids == [23, 25]
    assert wire.parsed("T", struct.pack(">h", 1) + b"c\0" + struct.pack(">ihIhih", 0, 0, 23, 4, -1, 0), "B").oids == [23]


def test_decoding(spark):
    rows = [(16, "01", "true"), (21, "002a", "42"), (23, "ffffffd6", "-42"), (20, "0000000000000100", "256"), (25, "61636d65", "acme"), (2950, "00112233445566778899aabbccddeeff", "00112233-4455-6677-8899-aabbccddeeff"), (1082, "00000000", "2000-01-01"), (23, "00", None), (1700, "0001", None), (701, "3ff8000000000000", "1.5"), (700, "3dcccccd", "0.1"), (701, "00", None), (20, "8000000000000000", "-9223372036854775808")]
    df = spark.createDataFrame(rows, "oid int, hex string, want string").withColumn("got", wire.decoded_with_floats(F.unhex("hex"), F.col("oid")))
    assert [(r.oid, r.got) for r in df.collect()] == [(o, w) for o, _, w in rows]


def _protocol(spark):
    rows = [(1, 1, "parse", "a", "q1", 0, None), (1, 2, "describe", "a", None, 0, None), (1, 3, "t", None, None, 0, [23]), (1, 4, "bind", "a", None, 1, None), (1, 5, "bind", "a", None, 2, None), (1, 6, "close", "a", None, 0, None), (1, 7, "bind", "a", None, 1, None), (2, 1, "bind", "a", None, 0, None), (2, 2, "t", None, None, 0, [25]), (2, 3, "parse", "", "q2", 0, None), (2, 4, "bind", "", None, 0, None), (2, 5, "query", None, "q3", 0, None)]
    return spark.createDataFrame(rows, "conn int, seq bigint, kind string, stmt string, sql string, n_params int, oids array<bigint>")


def test_stream_equals_batch(spark, tmp_path):
    events = _protocol(spark)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    for key, value in capture.STATE_STORE.items():
        spark.conf.set(key, value)
    found = capture.resolve_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = found.writeStream.format("memory").queryName("resolved").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("resolved")
    binds = {(r.conn, r.seq): (r.sql, r.resolved) for r in rows.filter("kind = 'bind'").collect()}
    assert binds == {(r.conn, r.seq): (r.sql, r.resolved) for r in resolve.resolve_binds(events).collect()}
    assert {(r.conn, r.seq): r.oids for r in rows.filter("oids is not null").collect()} == {(1, 4): [23], (1, 7): [23]}  # types outlive a close, only their number protects
    assert {(r.conn, r.seq, r.stmt) for r in resolve.described(events).collect()} == {(1, 3, "a")}


def test_stream_of_row_descriptions_to_a_folder(spark, tmp_path):
    rows = [(1, 1, "T", None, None, 0, [20]), (1, 2, "describe", "a", None, 0, None), (1, 3, "describe", "b", None, 0, None), (1, 4, "t", None, None, 0, [23]), (1, 5, "T", None, None, 0, [25])]
    events = spark.createDataFrame(rows, "conn int, seq bigint, kind string, stmt string, sql string, n_params int, oids array<bigint>")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    for key, value in capture.STATE_STORE.items():
        spark.conf.set(key, value)
    for _ in range(2):  # what has been written is not written again
        found = capture.resolve_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
        capture.to_folder(found, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    back = spark.read.schema(capture.RESOLVED).json(str(tmp_path / "out"))
    assert sorted((r.seq, r.kind, r.stmt, r.resolved, r.oids) for r in back.collect()) == [(1, "T", "", False, [20]), (5, "T", "a", True, [25])]
    assert {(r.conn, r.seq, r.stmt) for r in resolve.row_descriptions(events).collect()} == {(1, 1, None), (1, 5, "a")}  # "b" is asked for, not answered


def _frame(kind, body):
    return kind + struct.pack(">i", len(body) + 4) + body


def test_capture_decodes_by_the_types_of_the_server(spark, tmp_path):
    bind = lambda stmt, code, *values: _frame(b"B", b"\0" + stmt + b"\0" + struct.pack(">hhh", 1, code, len(values)) + b"".join(struct.pack(">i", len(v)) + v for v in values) + b"\0\0")
    frames = [
        (1, 0, "F", _frame(b"P", b"a\0SELECT $1\0\0\0") + _frame(b"D", b"Pportal\0") + _frame(b"D", b"Sa\0")),
        (1, 1, "B", _frame(b"t", struct.pack(">hI", 1, 23))), (1, 2, "B", _frame(b"t", struct.pack(">hI", 1, 25))),
        (1, 3, "F", bind(b"a", 1, struct.pack(">i", 7)) + bind(b"a", 1, b"\1") + bind(b"a", 7, b"x") + bind(b"a", 0, b"\xff!") + bind(b"b", 1, b"")), (1, 4, "F", None), (1, 5, "F", b""),
    ]
    spark.createDataFrame(frames, files.FRAME).write.parquet(str(tmp_path / "frames"))
    assert main(["capture", "--frames", str(tmp_path / "frames"), "--out", str(tmp_path / "events")]) == 0
    found = files.read_events(spark, str(tmp_path / "events")).collect()
    binds = sorted((r.stmt, r.resolved, p.value or "", p.oid or 0, p.unknown_reason or "") for r in found if r.kind == "bind" for p in r.params)
    assert binds == [
        ("a", True, "", 0, "unknown format code 7"), ("a", True, "", 23, "no decoder for type 23 of this width"), ("a", True, "7", 23, ""), ("a", True, "\ufffd!", 0, ""),
        ("b", False, "", 0, "binary value without a captured type"),
    ]
    assert sorted((r.stmt, r.resolved) for r in found if r.kind == "param_description") == [("", False), ("a", True)]
    empty = spark.createDataFrame([], files.FRAME)
    assert resolve.captured(resolve.protocol_events(wire.messages(empty))).collect() == []


def test_a_connection_is_shuffled_once(spark):
    events = spark.createDataFrame([], "conn int, seq bigint, kind string, stmt string, portal string, sql string, formats array<int>, `values` array<binary>, oids array<bigint>")
    plan = resolve.captured(events.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "Join" not in plan


def test_triage_texts(spark, tmp_path):
    assert triage.classified("Delete all encrypted data from the database.") is None
    assert triage.classified("Select an option from the menu below") is None
    assert triage.classified("-- name: GetX :one\nSELECT a FROM widgets w WHERE x = 1") == ("READ", "widgets")
    assert triage.classified("WITH x AS (SELECT 1) UPDATE widgets SET a = 1") == ("WRITE", "widgets")
    assert triage.go_literals(r'var q = "SELECT\u0020\x61\x20FROM\040t\t\"x\" -- \303\244"')[0][2] == 'SELECT a FROM t\t"x" -- \u00e4'
    assert triage.go_literals(r'var q = "no \q escape", "\777", "\ud800"') == [(1, None, r'"no \q escape"'), (1, None, r'"\777"'), (1, None, r'"\ud800"')]
    (tmp_path / "migrations").mkdir()
    (tmp_path / "vendor").mkdir()
    (tmp_path / "a.sql").write_text("-- name: A :one\nSELECT * FROM widgets WHERE organization_id = $1;\n-- name: B :one\nSELECT * FROM widgets WHERE id = $1;\n")
    (tmp_path / "migrations/b.sql").write_text("SELECT * FROM widgets;")
    (tmp_path / "vendor/c.sql").write_text("SELECT * FROM widgets;")
    (tmp_path / "d.go").write_text('var q = "UPDATE widgets SET a = 1"\n')
    doc = json.loads(triage.report(files.read_sources(spark, str(tmp_path))).first().report)
    assert doc["unverified"] and doc["known_scoped_tables"] == ["widgets"] and doc["statements_found"] == 3
    assert [(s["rank"], s["file"], s["line"], s["verb"]) for s in doc["suspicions"]] == [(1, "d.go", 1, "WRITE"), (2, "a.sql", 3, "READ")]
    text = json.dumps(doc["suspicions"]).lower()
    assert not any(w in text for w in ("leak", "proven", "violation"))


def test_command_line(spark, invoices, tmp_path, capsys):
    invoices.coalesce(1).write.parquet(str(tmp_path / "invoices.parquet"))
    assert main(["infer", "--data", str(tmp_path), "--out", str(tmp_path / "policy"), "invoices"]) == 0
    assert "scoped\ttenant_id" in capsys.readouterr().out
    assert main(["verify", "--data", str(tmp_path), "--policy", str(tmp_path / "policy")]) == 0
    param = {"null": False, "format": "text", "oid": 25, "value_known": True, "value": "acme", "value_base64": None, "unknown_reason": None}
    files.write_events(spark.createDataFrame([(1, "bind", "", None, s, True, None, p) for s, p in (("SELECT * FROM invoices WHERE tenant_id = $1", [param]), ("SELECT * FROM invoices", []), ("SELECT * FROM invoices", []))], files.EVENT), str(tmp_path / "events"))
    capsys.readouterr()
    assert main(["audit", "--data", str(tmp_path), "--policy", str(tmp_path / "policy"), "--events", str(tmp_path / "events")]) == 0
    doc = json.loads(capsys.readouterr().out)
    assert (doc["counts"]["n"], doc["counts"]["safe"], doc["counts"]["leak"]) == (3, 1, 2)
    assert doc["tables_row_level"] == [{"table": "invoices", "seed_source": "sampled"}] and doc["tables_structural_only"] == [] and all(doc["checks"].values())
    assert [(q["verdict"], q["n"], q.get("params"), q.get("withheld_rows", 0) > 0) for q in doc["queries"]] == [("LEAK", 2, None, True), ("SAFE", 1, ["acme"], False)]
    assert main(["audit", "--data", str(tmp_path), "--policy", str(tmp_path / "policy"), "--events", str(tmp_path / "events"), "--output", "text", "--shared-database"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert "tables_row_level: invoices (seed_source=sampled)" in lines and "shared_database: True" in lines and sum(x.startswith("query: ") for x in lines) == 2
    assert main(["verify", "--data", str(tmp_path), "--policy", str(tmp_path / "policy")]) == 0 and "counts" not in json.loads(capsys.readouterr().out)
    (tmp_path / "none.json").write_text('{"relations": []}')
    assert main(["verify", "--data", str(tmp_path), "--policy", str(tmp_path / "none.json")]) == 2


def test_every_scoped_relation_is_accounted_for(spark):
    scoped = spark.createDataFrame([("a",), ("b",)], "name string")
    said = lambda *rows: proof.accounted(spark.createDataFrame(list(rows), "table string, seeded boolean, skip_reason string"), scoped).first()
    assert tuple(said(("a", True, None), ("b", False, "no rows"))) == (2, 1, 1, True)
    assert not said(("a", True, None)).accounted  # b is missing
    assert not said(("a", True, None), ("b", False, None)).accounted  # without a reason
    assert not said(("a", True, None), ("b", False, "x"), ("c", True, None)).accounted  # nobody asked for c
    assert not said(("a", True, None), ("a", True, None), ("b", False, "x")).accounted  # twice
