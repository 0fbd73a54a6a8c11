"""Every query of the engine by name, with SQL that must give the same rows.

Two kinds of SQL: a derivation of the same result, or known answers, which follow from how a synthetic capture is made
and use no parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from isolens.functions import columns as c
from isolens.functions import statements as st
from isolens.functions import wire
from isolens.operators import audit, diff, infer, proof, resolve, triage, writes
from isolens.operators.rowfilter import Legs, rows_of
from isolens.plans import corpus
from isolens.plans.overlay import PRIMARY_KEYS, ROW_LEVEL, STRUCTURAL, TENANT, tables, with_clause
from isolens.sources.files import EVENT

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _values(names: str, rows: list[tuple]) -> str:
    """A table of known answers."""
    listed = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)
    return f"(VALUES {listed}) AS k({names})"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


# Row filters and differences -------------------------------------------------------------------------------------------


@query(f"{with_clause('ov_orders')} SELECT id, tenant_id, o_custkey, o_orderstatus FROM ov_orders WHERE tenant_id = '{TENANT}'")
def row_filter_orders(spark, sf_dir):
    return rows_of(tables(spark, sf_dir)["ov_orders"], "tenant_id", TENANT)


@query("SELECT CAST(0 AS BIGINT) AS n")
def row_filter_unset_tenant_denies(spark, sf_dir):
    return rows_of(tables(spark, sf_dir)["ov_orders"], "tenant_id", None).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT t AS tenant, (SELECT count(*) FROM part WHERE CAST(p_size AS VARCHAR) = t) AS n FROM (VALUES ('7'), ('07'), ('x'), ('')) AS v(t)")
def row_filter_typed_column(spark, sf_dir):
    part = tables(spark, sf_dir)["ov_part"]
    legs = [rows_of(part, "workspace_id", t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tenant"), "n") for t in ("7", "07", "x", "")]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).unionByName(legs[3])


def _legs(spark, sf_dir, names=tuple(ROW_LEVEL)) -> Legs:
    t = tables(spark, sf_dir)
    own = {n: t[n] for n in {*names, "ov_tenants"}}
    return Legs(spark, own, {n: col for n, col in ROW_LEVEL.items() if n in own}, corpus.VIEWS if "ov_orders" in own else {})


def _two_legs(template: corpus.Template, tenant: str) -> str:
    """Both legs of a template spelt out, and the verdict by EXCEPT ALL."""
    sql = re.sub(r"\$(\d+)(::\w+)?", lambda m: _quoted(template.params[int(m[1]) - 1]), template.sql)
    lists = ["ov_orders_v AS (SELECT * FROM ov_orders)", "ov_orders_dv AS (SELECT * FROM ov_orders)"]
    lists += [f"r_{n} AS (SELECT * FROM {n} WHERE {col} = '{tenant}')" for n, col in ROW_LEVEL.items()]
    lists += ["r_ov_orders_v AS (SELECT * FROM r_ov_orders)"]
    restricted = re.sub(rf"\b({'|'.join([*ROW_LEVEL, 'ov_orders_v'])})\b", r"r_\1", sql)
    return f"""{with_clause()}, {", ".join(lists)}, u AS ({sql}), r AS ({restricted}),
        n AS (SELECT (SELECT count(*) FROM u) AS n_unrestricted, (SELECT count(*) FROM r) AS n_restricted,
                     (SELECT count(*) FROM (SELECT * FROM u EXCEPT ALL SELECT * FROM r)) AS short)
        SELECT n_unrestricted, n_restricted, CASE WHEN short > 0 OR n_unrestricted <> n_restricted THEN 'LEAK' ELSE 'SAFE' END AS verdict,
               CASE WHEN short > 0 THEN short ELSE abs(n_unrestricted - n_restricted) END AS withheld_rows,
               short = 0 AND n_unrestricted = n_restricted AND n_unrestricted = 0 AS vacuous FROM n"""


def _diff_query(name: str, id_: str, tenant: str) -> None:
    template = next(t for t in (*corpus.TEMPLATES, corpus.LINEITEM_MAX) if t.id == id_)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return diff.compare(*_legs(spark, sf_dir).run(template.sql, list(template.params), tenant))

    run.__name__ = name
    query(_two_legs(template, tenant))(run)


for _name, _id, _tenant in (
    ("diff_read_safe", "S1", "7"), ("diff_projection_safe", "S2", "7"), ("diff_join_both_scoped", "S3", "7"), ("diff_cte_safe", "S4", "7"), ("diff_aggregate_safe", "S5", "7"),
    ("diff_view_invoker", "S6", "7"), ("diff_vacuous", "S7", "7"), ("diff_lineitem_max", "X1", "7"), ("diff_read_leak", "L1", ""), ("diff_aggregate_leak", "L2", ""),
    ("diff_join_one_side_scoped", "L3", "7"), ("diff_cte_aggregate", "L4", ""), ("diff_other_tenant", "L5", "8"), ("diff_tautology", "L6", ""), ("diff_view_definer", "L7", ""),
    ("diff_in_subquery", "L8", ""), ("diff_max", "L9", ""), ("diff_or_defeated", "L10", "7"),
):
    _diff_query(_name, _id, _tenant)


@query(f"""{with_clause('ov_lineitem')} SELECT l_returnflag AS row, count(*) AS n FROM
    (SELECT l_returnflag FROM ov_lineitem EXCEPT ALL SELECT l_returnflag FROM ov_lineitem WHERE tenant_id = '{TENANT}') GROUP BY 1""")
def multiset_shortfall_lineitem(spark, sf_dir):
    df = tables(spark, sf_dir)["ov_lineitem"]
    have, want = df.select("l_returnflag"), rows_of(df, "tenant_id", TENANT).select("l_returnflag")
    return diff.shortfall(have, want).groupBy("row").agg(F.count(F.lit(1)).alias("n"))


# Policies --------------------------------------------------------------------------------------------------------------

_COLUMNS = {
    "ov_ambiguous": "id,org_id,account_id", "ov_customer": "id,tenant_id,c_mktsegment", "ov_events": "id,account_id,event_type", "ov_lineitem": "l_orderkey,l_linenumber,tenant_id,l_returnflag",
    "ov_notes": "order_id,l_linenumber,tenant_id,note", "ov_orders": "id,tenant_id,o_custkey,o_orderstatus", "ov_part": "id,workspace_id", "ov_supplier": "id,tenant_id", "ov_tenants": "tenant_id",
    "nation": "n_nationkey,n_name,n_regionkey", "region": "r_regionkey,r_name", "ov_orders_v": "id,tenant_id,o_custkey,o_orderstatus",
}
_CLASSES = {n: ("scoped", "tenant_id") for n in ("ov_customer", "ov_lineitem", "ov_notes", "ov_orders", "ov_supplier", "ov_tenants")} | {
    "ov_events": ("scoped", "account_id"), "ov_part": ("scoped", "workspace_id"), "ov_ambiguous": ("unclassifiable", None), "nation": ("unscoped", None), "region": ("unscoped", None), "ov_orders_v": ("unclassifiable", None),
}


def _catalog(spark, sf_dir) -> DataFrame:
    t = tables(spark, sf_dir)
    more = {"ov_orders_v": t["ov_orders"], "ov_orders_2020": t["ov_orders"], "ov_orders_seq": t["ov_tenants"]}
    return infer.catalog(spark, t | more, {"ov_orders_v": "VIEW", "ov_orders_seq": "OTHER"}, ["ov_orders_2020"])


@query(f"SELECT name, columns FROM {_values('name, columns', list(_COLUMNS.items()))}")
def catalog_scan_ordered_columns(spark, sf_dir):
    return infer.relations_of(_catalog(spark, sf_dir)).select("name", F.array_join("columns", ",").alias("columns"))


@query(f"SELECT name, candidates FROM {_values('name, candidates', [(n, ','.join(sorted(x for x in cols.split(',') if x in st.CANDIDATE_COLUMNS))) for n, cols in _COLUMNS.items()])}")
def infer_candidates(spark, sf_dir):
    return infer.infer(_catalog(spark, sf_dir)).select("name", F.array_join("candidates", ",").alias("candidates"))


@query(f"SELECT name, class, tenant_column FROM {_values('name, class, tenant_column', [(n, *k) for n, k in _CLASSES.items()])}")
def infer_classify(spark, sf_dir):
    return infer.infer(_catalog(spark, sf_dir)).select("name", "class", "tenant_column")


@query("SELECT CAST(8 AS BIGINT) AS scoped, CAST(2 AS BIGINT) AS unscoped, CAST(2 AS BIGINT) AS unclassifiable")
def infer_counts(spark, sf_dir):
    return infer.counts(infer.infer(_catalog(spark, sf_dir)))


# Controls and proof ------------------------------------------------------------------------------------------------------


@query(f"{with_clause('ov_orders')} SELECT count(*) AS n_all, count(*) FILTER (WHERE tenant_id = '{TENANT}') AS n_visible, count(*) FILTER (WHERE tenant_id = '{TENANT}') < count(*) AS a1 FROM ov_orders")
def control_a1_counts(spark, sf_dir):
    df = tables(spark, sf_dir)["ov_orders"]
    return proof.a1(df, rows_of(df, "tenant_id", TENANT))


@query("SELECT name FROM (VALUES ('ov_events'), ('ov_part'), ('ov_supplier')) AS v(name)")
def control_a2_uncovered(spark, sf_dir):
    relations = infer.infer(_catalog(spark, sf_dir)).filter(F.col("name") != "ov_tenants")
    rows = [("ov_customer", True, 1), ("ov_orders", True, 2), ("ov_lineitem", True, 1), ("ov_notes", True, 1), ("ov_supplier", False, 1), ("ov_part", True, 0)]
    return proof.uncovered(relations, spark.createDataFrame(rows, "relation string, enabled boolean, policies int"))


@query("SELECT role, reason FROM (VALUES ('root', 'superuser'), ('batch', 'bypasses row filters'), ('owner', 'owns ov_orders without force')) AS v(role, reason)")
def control_a3_bypass(spark, sf_dir):
    roles = spark.createDataFrame([("root", True, True), ("batch", False, True), ("owner", False, False), ("app", False, False), ("strict", False, False)], "role string, superuser boolean, bypass boolean")
    return proof.bypassing(roles, spark.createDataFrame([("ov_orders", "owner", False), ("ov_part", "owner", False), ("ov_events", "strict", True)], "relation string, owner string, forced boolean"))


@query(f"""{with_clause('ov_orders', 'ov_supplier')} SELECT 'right' AS filter, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_surplus, true AS a4
    UNION ALL SELECT 'wrong', (SELECT count(*) FROM ov_orders WHERE tenant_id = '{TENANT}' AND CAST(o_custkey AS VARCHAR) <> '{TENANT}'),
    (SELECT count(*) FROM ov_orders WHERE tenant_id <> '{TENANT}' AND CAST(o_custkey AS VARCHAR) = '{TENANT}'), false""")
def control_a4_row_keys(spark, sf_dir):
    df = tables(spark, sf_dir)["ov_orders"]
    legs = [proof.a4(df, rows_of(df, col, TENANT), "tenant_id", TENANT, ["id"]).select(F.lit(name).alias("filter"), "n_missing", "n_surplus", "a4") for name, col in (("right", "tenant_id"), ("wrong", "o_custkey"))]
    return legs[0].unionByName(legs[1])


_PROVEN = [("t1", True, True, True, True, True), ("t2", True, True, True, True, False), ("t3", False, None, True, True, None)]


def _tables_proof(spark):
    return spark.createDataFrame(_PROVEN, "table string, seeded boolean, a1 boolean, a2 boolean, a3 boolean, a4 boolean")


@query(f"""SELECT bool_or(a1 IS NOT NULL) AS a1_checked, bool_and(a1) AS a1_passed, bool_or(a4 IS NOT NULL) AS a4_checked, bool_and(a4) AS a4_passed
    FROM {_values('t, seeded, a1, a2, a3, a4', _PROVEN)} WHERE seeded""")
def proof_aggregate(spark, sf_dir):
    return proof.aggregate(_tables_proof(spark)).select("a1_checked", "a1_passed", "a4_checked", "a4_passed")


@query("SELECT 'A4' AS first_failure, false AS proven UNION ALL SELECT NULL, true UNION ALL SELECT 'A1', false")
def proof_first_failure(spark, sf_dir):
    t = _tables_proof(spark)
    parts = [proof.aggregate(x).select("first_failure", "proven") for x in (t, t.filter(F.col("table") == "t1"), t.filter(~F.col("seeded")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"SELECT mutant, gate, a1, a2, a3, a4, true AS caught FROM {_values('mutant, gate, a1, a2, a3, a4', [('M1', 'a2', True, False, True, False), ('M2', 'a1', False, True, True, False), ('M3', 'a4', True, True, True, False), ('M4', 'a3', False, True, False, False), ('M5', 'a3', False, True, False, False), ('M6', 'a2', False, False, True, False), ('M7', 'a4', True, True, True, False), ('M8', 'a1', False, True, True, True)])}")
def mutants_gate_matrix(spark, sf_dir):
    df = tables(spark, sf_dir)["ov_orders"]
    return proof.mutants(df, "tenant_id", "o_custkey", TENANT, ["id"])


@query(f"""{with_clause('ov_customer')}, first AS (SELECT *, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) AS n FROM ov_customer)
    SELECT CAST(999 + n AS BIGINT) AS id, CASE n WHEN 1 THEN '{proof.CANARY_A}' ELSE '{proof.CANARY_B}' END AS tenant_id, c_mktsegment FROM first WHERE n <= 2""")
def canary_plan_rows(spark, sf_dir):
    return proof.canaries(tables(spark, sf_dir)["ov_customer"], "tenant_id", ["id"]).rows


@query(f"{with_clause('ov_supplier')} SELECT (SELECT count(*) FROM ov_supplier) + 2 AS n_seeded, CAST(1 AS BIGINT) AS n_canary_a, CAST(1 AS BIGINT) AS n_canary_b")
def canary_seeded_counts(spark, sf_dir):
    df = tables(spark, sf_dir)["ov_supplier"]
    seeded = df.unionByName(proof.canaries(df, "tenant_id", ["id"]).rows)
    return seeded.agg(F.count(F.lit(1)).alias("n_seeded"), F.count_if(F.col("tenant_id") == proof.CANARY_A).alias("n_canary_a"), F.count_if(F.col("tenant_id") == proof.CANARY_B).alias("n_canary_b"))


@query(f"SELECT t AS \"table\", seeded, seed_source, a1, a2, a3, a4 FROM {_values('t, seeded, seed_source, a1, a2, a3, a4', [(n, True, 'sampled', True, True, True, True) for n in ROW_LEVEL] + [('ov_part', False, None, None, True, True, None)])}")
def seed_source_by_table(spark, sf_dir):
    return proof.prove(spark, tables(spark, sf_dir), ROW_LEVEL | STRUCTURAL, PRIMARY_KEYS).drop("skip_reason")


_GATE = [("ov_customer", True, "sampled", True, True, True, True), ("ov_supplier", True, "sampled", False, False, True, False), ("ov_orders", True, "sampled", False, True, False, False), ("ov_notes", True, "fixture", True, True, True, True), ("ov_part", False, None, None, True, True, None)]


@query(f"SELECT t AS \"table\", seeded, seed_source, a1, a2, a3, a4, CAST(5 AS BIGINT) AS n_scoped, CAST(4 AS BIGINT) AS n_seeded, CAST(1 AS BIGINT) AS n_skipped, true AS accounted, 'A1' AS first_failure FROM {_values('t, seeded, seed_source, a1, a2, a3, a4', _GATE)}")
def gate_report(spark, sf_dir):
    """The proof by a policy: a disabled filter, an owner without force, a relation without rows that has a fixture, and one that takes no canary."""
    own = tables(spark, sf_dir)
    own["ov_notes"] = own["ov_notes"].filter(F.lit(False))
    fixture = [{"order_id": "1", "l_linenumber": "1", "note": "'a'"}, {"order_id": "2", "l_linenumber": "1", "note": "'b'"}]
    field = lambda name, column, **more: Row(name=name, tenant_column=column, **{"primary_key": PRIMARY_KEYS.get(name), "unique_keys": None, "fixture": None, "owner": None, "enabled": None, "forced": None, **more})
    scoped = [
        field("ov_customer", "tenant_id", unique_keys=[["c_mktsegment"]]), field("ov_supplier", "tenant_id", enabled=False), field("ov_orders", "tenant_id", owner="restricted", forced=False),
        field("ov_notes", "tenant_id", fixture=fixture), field("ov_part", "workspace_id"),
    ]
    proven = proof.prove_policy(spark, own, scoped)
    whole = proof.accounted(proven, spark.createDataFrame([(r.name,) for r in scoped], "name string")).crossJoin(proof.aggregate(proven).select("first_failure"))  # one row each
    return proven.drop("skip_reason").crossJoin(F.broadcast(whole))


# Text of statements ------------------------------------------------------------------------------------------------------

_CAPTURE = f"""WITH t AS (SELECT * FROM {_values('template, id, sql', [(i, t.id, t.sql) for i, t in enumerate(corpus.TEMPLATES)])}),
    e AS (SELECT event_id AS seq, event_id % {len(corpus.TEMPLATES)} AS template FROM events)"""
_SQL_NAMES = f"list_transform(regexp_extract_all(sql, {_quoted(st.TABLE_PATTERN)}, 1), lambda x: lower(x))"
_SQL_ALIASES = f"list_filter(list_transform(regexp_extract_all(sql, {_quoted(st.TABLE_PATTERN)}, 2), lambda x: lower(x)), lambda x: NOT list_contains([{', '.join(map(_quoted, ('', *st.ALIAS_STOP_WORDS)))}], x))"


@query(f"{_CAPTURE} SELECT id, array_to_string(list_sort(list_distinct(list_concat({_SQL_NAMES}, {_SQL_ALIASES}))), ',') AS names, count(*) AS n FROM e JOIN t USING (template) WHERE sql IS NOT NULL GROUP BY 1, 2")
def referenced_tables(spark, sf_dir):
    own = corpus.captured(spark, sf_dir).filter("sql is not null")
    return own.groupBy("id", F.array_join(F.array_sort(c.mentioned(F.col("sql"))), ",").alias("names")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_CAPTURE} SELECT id, array_to_string(list_sort(list_distinct({_SQL_NAMES})), ',') AS names, count(*) AS n FROM e JOIN t USING (template) WHERE sql IS NOT NULL GROUP BY 1, 2")
def referenced_names_only(spark, sf_dir):
    own = corpus.captured(spark, sf_dir).filter("sql is not null")
    return own.groupBy("id", F.array_join(F.array_sort(c.mentioned_names(F.col("sql"))), ",").alias("names")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_CAPTURE} SELECT id, array_to_string(regexp_extract_all(sql, {_quoted(st.COMPARED_PATTERN.format(column='tenant_id'))}, 1), '|') AS compared, count(*) AS n FROM e JOIN t USING (template) WHERE sql IS NOT NULL GROUP BY 1, 2")
def tenant_comparisons(spark, sf_dir):
    own = corpus.captured(spark, sf_dir).filter("sql is not null")
    return own.groupBy("id", F.array_join(c.compared_with(F.col("sql"), "tenant_id"), "|").alias("compared")).agg(F.count(F.lit(1)).alias("n"))


_REFERENCES = [("$1", 1), ("$1::uuid", 1), ("$2 :: uuid", 2), ("$3::text[]", 3), ("$4::timestamp with time zone", 4), ("$5::uuid::text", 5), ("CAST($6 AS uuid)", 6), ("cast ( $12 as character varying [] )", 12), ("'x'", None), ("$1 + 1", None), ("gen_random_uuid()", None)]


@query(f"SELECT expression, CAST(position AS INTEGER) AS position FROM {_values('expression, position', _REFERENCES)}")
def param_ref_casts(spark, sf_dir):
    return spark.createDataFrame([(x,) for x, _ in _REFERENCES], "expression string").select("expression", c.param_position(F.col("expression")).alias("position"))


_INSERTS = [
    ("INSERT INTO ov_orders (id, tenant_id) VALUES ($1, $2)", "resolved", 1), ("INSERT INTO ov_orders (id, tenant_id) VALUES (gen_random_uuid(), CAST($2 AS text)) RETURNING *", "resolved", 1),
    ("insert into public.ov_orders (id) values ($1)", "no_predicate", None), ("INSERT INTO ov_orders (id, tenant_id) VALUES ($1)", "unattributable", None),
    ("INSERT INTO ov_orders (id, tenant_id) VALUES ($1, (SELECT tenant_id FROM ov_tenants))", "unattributable", None), ("INSERT INTO ov_orders (id, tenant_id) VALUES (coalesce($1, 'a, b'), 'acme')", "no_predicate", None),
    ("INSERT INTO ov_orders (id, tenant_id) VALUES (f($1, 2), 'acme')", "no_predicate", None), ("INSERT INTO ov_orders (id, tenant_id) VALUES ($1, $9)", "unattributable", None),
]


def _texts(spark, sf_dir, texts: list[str], params) -> DataFrame:
    """One captured statement for each event: seq, template, sql, params."""
    e = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), "user_id", "event_type")
    n = F.pmod("seq", F.lit(len(texts)))
    one = lambda p: F.struct(F.lit(False).alias("null"), F.lit("text").alias("format"), F.lit(25).cast("long").alias("oid"), F.lit(True).alias("value_known"), p.alias("value"), F.lit(None).cast("string").alias("value_base64"), F.lit(None).cast("string").alias("unknown_reason"))
    return e.select("seq", n.cast("int").alias("template"), corpus.by_template(n, texts).alias("sql"), F.array(*[one(p) for p in params]).cast(f"array<{c.PARAM}>").alias("params"))


@query(f"SELECT event_id AS seq, kind, CASE WHEN position = 1 THEN CAST(user_id AS VARCHAR) END AS value FROM events JOIN {_values('template, kind, position', [(i, k, p) for i, (_, k, p) in enumerate(_INSERTS)])} ON template = event_id % {len(_INSERTS)}")
def insert_attribution(spark, sf_dir):
    own = _texts(spark, sf_dir, [x[0] for x in _INSERTS], [F.col("event_type"), F.col("user_id").cast("string")])
    return own.select("seq", c.attribution(corpus.SCOPED)("sql", "params").alias("a")).select("seq", "a.kind", "a.value")


_CLAIMS = [(i, t.claim, ("8" if t.id == "L5" else "7") if t.claim == "resolved" else None) for i, t in enumerate(corpus.TEMPLATES)]


@query(f"SELECT event_id AS seq, kind, k.value FROM events JOIN {_values('template, kind, value', _CLAIMS)} ON template = event_id % {len(corpus.TEMPLATES)}")
def attribute_tenant(spark, sf_dir):
    return corpus.captured(spark, sf_dir).select("seq", c.attribution(corpus.SCOPED)("sql", "params").alias("a")).select("seq", "a.kind", "a.value")


_WRITES = [
    ("INSERT INTO t VALUES (1)", True), ("-- note\n update t set a = 1", True), ("DELETE FROM t", True), ("SELECT * FROM t", False), ("WITH a AS (SELECT 1) SELECT * FROM a", False),
    ("WITH a AS (DELETE FROM t RETURNING *) SELECT * FROM a", True), ("WITH a(x) AS NOT MATERIALIZED (SELECT 1), b AS (SELECT 2) INSERT INTO t SELECT * FROM a", True),
    ("WITH RECURSIVE a AS (WITH b AS (UPDATE t SET x = 1 RETURNING *) SELECT * FROM b) SELECT * FROM a", True), ("MERGE INTO t USING s ON t.a = s.a", False), ("/* x */ DELETE FROM t", False),
]


@query(f"SELECT event_id AS seq, is_write FROM events JOIN {_values('template, is_write', [(i, w) for i, (_, w) in enumerate(_WRITES)])} ON template = event_id % {len(_WRITES)}")
def write_statement_flag(spark, sf_dir):
    return _texts(spark, sf_dir, [x[0] for x in _WRITES], []).select("seq", c.is_write("sql").alias("is_write"))


_CTES = [("WITH a AS (WITH b AS (SELECT 1) SELECT * FROM b), c AS (SELECT 2) SELECT * FROM a, c", "a,b,c"), ("SELECT * FROM t", ""), ('WITH RECURSIVE "Up"(n) AS (SELECT 1) SELECT * FROM "Up"', "up"), ("-- c\nWITH x AS MATERIALIZED (SELECT ')') SELECT 1", "x")]


@query(f"SELECT event_id AS seq, names FROM events JOIN {_values('template, names', [(i, n) for i, (_, n) in enumerate(_CTES)])} ON template = event_id % {len(_CTES)}")
def cte_names(spark, sf_dir):
    return _texts(spark, sf_dir, [x[0] for x in _CTES], []).select("seq", F.array_join(c.cte_names("sql"), ",").alias("names"))


_POPULATIONS = [
    ("SELECT now()", False, "no_declared_table"), ("SELECT * FROM ov_part WHERE workspace_id = 'acme'", False, "structural_only"), ("SELECT * FROM ov_orders o JOIN ov_part p ON true", False, "row_level_unattributed"),
    ("DECLARE c CURSOR FOR SELECT * FROM ov_orders", True, "non_query"), ("FETCH 5 FROM c", True, "non_query"), ("-- x\n  lock TABLE ov_orders", True, "non_query"), ("BEGIN", True, "non_query"), ("BEGIN;", False, "no_declared_table"),
    ("SET search_path = x", True, "non_query"), ("SETTLE FROM ov_part", False, "structural_only"), ("EXECUTE(p)", True, "non_query"), ("ROLLBACK", False, "no_declared_table"),
]
_SQL_BARE = "regexp_replace(sql, '^(?:\\s+|--[^\\n]*(?:\\n|$))*', '')"


@query(f"WITH t AS (SELECT * FROM {_values('template, sql', [(i, x[0]) for i, x in enumerate(_POPULATIONS)])}) SELECT event_id AS seq, regexp_matches({_SQL_BARE}, '(?i)^(?:{'|'.join(st.NON_QUERY_WORDS)})(?:[ \\t\\r\\n(]|$)') AS non_query FROM events JOIN t ON template = event_id % {len(_POPULATIONS)}")
def non_query_flag(spark, sf_dir):
    return _texts(spark, sf_dir, [x[0] for x in _POPULATIONS], []).select("seq", c.non_query(F.col("sql")).alias("non_query"))


@query(f"SELECT event_id AS seq, population FROM events JOIN {_values('template, population', [(i, x[2]) for i, x in enumerate(_POPULATIONS)])} ON template = event_id % {len(_POPULATIONS)}")
def unattributable_population(spark, sf_dir):
    return _texts(spark, sf_dir, [x[0] for x in _POPULATIONS], []).select("seq", c.population(F.col("sql"), list(ROW_LEVEL), list(STRUCTURAL)).alias("population"))


@query(f"{_CAPTURE} SELECT id, count(*) AS n FROM e JOIN t USING (template) WHERE sql IS NOT NULL GROUP BY id")
def tenant_dedup_distinct_statements(spark, sf_dir):
    own = corpus.captured(spark, sf_dir).filter("sql is not null")
    ids = spark.createDataFrame([(t.sql, t.params[-1] if t.params else "", t.id) for t in corpus.TEMPLATES if t.sql], "sql string, last string, id string")
    return audit.distinct_statements(own).withColumn("last", F.coalesce(F.try_element_at("params", F.lit(-1))["value"], F.lit(""))).join(F.broadcast(ids), ["sql", "last"]).select("id", "n")


# Capture -----------------------------------------------------------------------------------------------------------------


def _protocol(spark, sf_dir) -> DataFrame:
    """conn, seq, kind, stmt, sql: parses, binds, closes, describes and their answers, from the events' numbers."""
    e = _events(spark, sf_dir).select(F.pmod("event_id", F.lit(16)).cast("int").alias("conn"), F.col("event_id").alias("seq"), "user_id", F.floor(F.col("event_id") / 16).alias("turn"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.pmod(F.col("turn") * 5 + F.col("user_id"), F.lit(len(_KINDS))) + 1).cast("int"))
    return e.select("conn", "seq", kind.alias("kind"), F.concat(F.lit("s"), F.pmod("user_id", F.lit(3)).cast("string")).alias("stmt"), F.concat(F.lit("q"), F.col("seq").cast("string")).alias("sql"))


_KINDS = ("parse", "bind", "describe", "t", "bind", "close", "t")
_SQL_PROTOCOL = f"""WITH p AS (SELECT CAST(event_id % 16 AS INTEGER) AS conn, event_id AS seq, [{', '.join(map(_quoted, _KINDS))}][1 + ((event_id // 16) * 5 + user_id) % {len(_KINDS)}] AS kind,
    's' || CAST(user_id % 3 AS VARCHAR) AS stmt, 'q' || CAST(event_id AS VARCHAR) AS sql FROM events)"""


@query(f"""{_SQL_PROTOCOL}, o AS (SELECT *, max(CASE WHEN kind IN ('parse', 'close') THEN seq END) OVER (PARTITION BY conn, stmt ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM p)
    SELECT o.conn, o.seq, o.stmt, CASE WHEN q.kind = 'parse' THEN q.sql END AS sql, coalesce(q.kind = 'parse', false) AS resolved FROM o LEFT JOIN p q ON q.seq = o.at WHERE o.kind = 'bind'""")
def events_resolve_binds(spark, sf_dir):
    return resolve.resolve_binds(_protocol(spark, sf_dir))


@query(f"""{_SQL_PROTOCOL}, d AS (SELECT *, sum(CASE kind WHEN 'describe' THEN 1 ELSE -1 END) OVER (PARTITION BY conn ORDER BY seq) AS depth FROM p WHERE kind IN ('describe', 't')),
    m AS (SELECT *, least(0, coalesce(min(depth) OVER (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lowest FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY conn, kind ORDER BY seq) AS rank FROM m WHERE kind = 'describe' OR depth >= lowest)
    SELECT a.conn, a.seq, b.stmt FROM k a JOIN k b ON a.conn = b.conn AND a.rank = b.rank AND a.kind = 't' AND b.kind = 'describe'""")
def describe_fifo(spark, sf_dir):
    return resolve.described(_protocol(spark, sf_dir))


_SQL_ANSWERED = f"""{_SQL_PROTOCOL}, d AS (SELECT *, sum(CASE kind WHEN 'describe' THEN 1 ELSE -1 END) OVER (PARTITION BY conn ORDER BY seq) AS depth FROM p WHERE kind IN ('describe', 't')),
    m AS (SELECT *, least(0, coalesce(min(depth) OVER (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lowest FROM d),
    k AS (SELECT *, row_number() OVER (PARTITION BY conn, kind ORDER BY seq) AS rank FROM m WHERE kind = 'describe' OR depth >= lowest),
    a AS (SELECT t.conn, t.seq, s.stmt FROM k t JOIN k s ON t.conn = s.conn AND t.rank = s.rank AND t.kind = 't' AND s.kind = 'describe')"""


@query(f"""{_SQL_ANSWERED}, r AS (SELECT conn, seq FROM p WHERE kind = 'close')
    SELECT r.conn, r.seq, arg_max(a.stmt, a.seq) AS stmt FROM r LEFT JOIN a ON a.conn = r.conn AND a.seq < r.seq GROUP BY 1, 2""")
def row_description_targets(spark, sf_dir):
    own = _protocol(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "close", "T").otherwise(F.col("kind")))
    return resolve.row_descriptions(own)


@query("""SELECT event_id AS seq, user_id % 3 = event_id % 4 AS types_known, array_to_string(list_transform(range(user_id % 3), lambda i: 'v' || CAST(i AS VARCHAR) || ':' || CASE WHEN user_id % 3 = event_id % 4 THEN CAST(20 + i AS VARCHAR) ELSE '?' END), ',') AS typed FROM events""")
def params_zip_oids_arity(spark, sf_dir):
    sized = lambda n, one: F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), one)).otherwise(F.array())
    e = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.pmod("user_id", F.lit(3)).alias("a"), F.pmod("event_id", F.lit(4)).alias("b"))
    e = e.select("seq", sized(F.col("a"), lambda i: F.concat(F.lit("v"), i.cast("string"))).cast("array<string>").alias("params"), sized(F.col("b"), lambda i: i + 20).cast("array<bigint>").alias("oids"))
    text = F.array_join(F.transform("typed", lambda t: F.concat_ws(":", t["value"], F.coalesce(t["oid"].cast("string"), F.lit("?")))), ",")
    return resolve.with_types(e).select("seq", "types_known", text.alias("typed"))


def _bytes(number, width: int):
    """A signed integer of so many bytes, big-endian."""
    return F.unhex(F.right(F.lpad(F.hex(number.cast("long")), 16, "0"), F.lit(2 * width)))


@query("SELECT event_id AS seq, CAST(user_id - 20 AS VARCHAR) AS int2, CAST(event_id - 500 AS VARCHAR) AS int4, CAST((event_id - 500) * 10000000000 AS VARCHAR) AS int8, CAST(event_id AS VARCHAR) AS oid, CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END AS bool, CAST(NULL AS VARCHAR) AS wrong_width FROM events")
def decode_binary_ints(spark, sf_dir):
    e, of = _events(spark, sf_dir), lambda value, oid: wire.decoded(value, F.lit(oid))
    n = F.col("event_id")
    return e.select(
        n.alias("seq"), of(_bytes(F.col("user_id") - 20, 2), wire.INT2).alias("int2"), of(_bytes(n - 500, 4), wire.INT4).alias("int4"), of(_bytes((n - 500) * 10_000_000_000, 8), wire.INT8).alias("int8"),
        of(_bytes(n, 4), wire.OID).alias("oid"), of(F.unhex(F.lpad(F.hex(n % 2), 2, "0")), wire.BOOL).alias("bool"), of(_bytes(n, 2), wire.INT4).alias("wrong_width"),
    )


@query("SELECT event_id AS seq, '00112233-4455-6677-8899-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS uuid, '\\x' || lower(hex(CAST(event_type AS BLOB))) AS bytea, event_type AS text FROM events")
def decode_binary_uuid(spark, sf_dir):
    e = _events(spark, sf_dir)
    raw = F.unhex(F.concat(F.lit("00112233445566778899"), F.lpad(F.col("event_id").cast("string"), 12, "0")))
    text = F.col("event_type").cast("binary")
    return e.select(F.col("event_id").alias("seq"), wire.decoded(raw, F.lit(wire.UUID)).alias("uuid"), wire.decoded(text, F.lit(wire.BYTEA)).alias("bytea"), wire.decoded(text, F.lit(wire.VARCHAR)).alias("text"))


@query("SELECT event_id AS seq, CAST(DATE '2000-01-01' + CAST(event_id - 500 AS INTEGER) AS VARCHAR) AS date, strftime(TIMESTAMP '2000-01-01' + to_microseconds(event_id * 250001 * (event_id % 3) * 4), '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id * (event_id % 3) * 4 % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(event_id * 250001 * (event_id % 3) * 4 % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z' AS moment FROM events")
def decode_binary_temporal(spark, sf_dir):
    n = F.col("event_id")
    return _events(spark, sf_dir).select(n.alias("seq"), wire.decoded(_bytes(n - 500, 4), F.lit(wire.DATE)).alias("date"), wire.decoded(_bytes(n * 250_001 * (n % 3) * 4, 8), F.lit(wire.TIMESTAMPTZ)).alias("moment"))


_FLOATS = [
    ("3FF8000000000000", "1.5"), ("412E848000000000", "1e+06"), ("40F86A0000000000", "100000"), ("4132D68700000000", "1.234567e+06"), ("3F1A36E2EB1C432D", "0.0001"), ("3EE4F8B588E368F1", "1e-05"), ("8000000000000000", "-0"),
    ("7FF0000000000000", "+Inf"), ("7FF8000000000000", "NaN"), ("C08F38CCCCCCCCCD", "-999.1"), ("3DCCCCCD", "0.1"), ("4B7FFFFF", "1.6777215e+07"), ("00", None),
]


@query(f"SELECT event_id AS seq, text FROM events JOIN {_values('template, text', [(i, t) for i, (_, t) in enumerate(_FLOATS)])} ON template = event_id % {len(_FLOATS)}")
def decode_binary_floats(spark, sf_dir):
    """Binary floats of both widths, and one of neither."""
    raw = F.unhex(corpus.by_template(F.pmod("event_id", F.lit(len(_FLOATS))), [h for h, _ in _FLOATS]))
    own = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), raw.alias("raw"))
    return own.select("seq", wire.decoded_with_floats(F.col("raw"), F.when(F.octet_length("raw") == 4, wire.FLOAT4).otherwise(wire.FLOAT8)).alias("text"))


@query(f"{_CAPTURE} SELECT id, count(*) AS n, count(*) AS n_same FROM e JOIN t USING (template) GROUP BY id")
def jsonl_round_trip(spark, sf_dir):
    own = corpus.captured(spark, sf_dir).withColumns({"stmt": F.lit(""), "portal": F.lit(None).cast("string"), "resolved": F.col("sql").isNotNull(), "note": F.lit(None).cast("string")})
    fields = F.struct("conn", "kind", "stmt", "portal", "sql", "resolved", "note", "params")
    back = F.from_json(F.to_json(fields), EVENT, {"mode": "FAILFAST"})
    same = (back["sql"].eqNullSafe(F.col("sql"))) & (F.to_json(back["params"]) == F.to_json("params")) & (c.param_texts(back["params"]) == c.param_texts(F.col("params")))
    return own.select("id", same.alias("same")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_same"))


@query("SELECT CAST(event_id % 16 AS INTEGER) AS conn, 's' || CAST(user_id AS VARCHAR) AS stmt, 'SELECT ' || CAST(event_id AS VARCHAR) AS sql, row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) - 1 AS number FROM events")
def frames_reassemble(spark, sf_dir):
    n, zero = F.col("event_id"), F.unhex(F.lit("00"))
    body = F.concat(F.concat(F.lit("s"), F.col("user_id").cast("string")).cast("binary"), zero, F.concat(F.lit("SELECT "), n.cast("string")).cast("binary"), zero, F.unhex(F.lit("0000")))
    e = _events(spark, sf_dir).select(n.alias("event_id"), F.pmod(n, F.lit(16)).cast("int").alias("conn"), F.concat(F.lit("P").cast("binary"), _bytes(F.octet_length(body) + 4, 4), body).alias("message"))
    cut = F.pmod("event_id", F.lit(9)).cast("int") + 1
    halves = F.array(F.struct(F.lit(0).alias("half"), F.substring("message", F.lit(1), cut).alias("bytes")), F.struct(F.lit(1).alias("half"), F.substring("message", cut + 1, F.lit(10_000)).alias("bytes")))
    frames = e.select("conn", "event_id", F.inline(halves)).select("conn", (F.col("event_id") * 2 + F.col("half")).alias("seq"), F.lit("F").alias("dir"), "bytes")
    return wire.messages(frames).select("conn", "stmt", "sql", F.col("number").cast("long").alias("number"))


def _message(kind: str, *parts):
    body = F.concat(*[p.cast("binary") for p in parts])
    return F.concat(F.lit(kind).cast("binary"), _bytes(F.octet_length(body) + 4, 4), body)


def _both_directions(spark, sf_dir) -> DataFrame:
    """Frames of connections that prepare, ask for types, and bind four values, two of them as numbers in binary, and a null.

    By connection, the server tells all types, one too few, or none; or the statement is closed before the bind.
    """
    n, zero = F.col("event_id"), F.unhex(F.lit("00"))
    name, as_number = F.concat(F.lit("s"), n.cast("string")), lambda x, width: _bytes(F.lit(x), width)
    prepare = F.concat(_message("P", name, zero, F.concat(F.lit("SELECT "), n.cast("string")), zero, as_number(0, 2)), _message("D", F.lit("S"), name, zero))
    types = lambda *oids: _message("t", as_number(len(oids), 2), *[as_number(o, 4) for o in oids])
    whole, short = types(wire.INT4, wire.FLOAT8, wire.TEXT, wire.TEXT), types(wire.INT4, wire.FLOAT8, wire.TEXT)
    row = _message("T", as_number(1, 2), F.lit("c"), zero, as_number(0, 6), as_number(wire.INT4, 4), as_number(0, 8))
    codes = F.concat(as_number(4, 2), as_number(1, 2), as_number(1, 2), as_number(0, 2), as_number(1, 2))
    typed = F.concat(as_number(4, 4), _bytes(n, 4), as_number(8, 4), F.unhex(F.lit("3FF8000000000000")), _bytes(F.octet_length("event_type"), 4), F.col("event_type").cast("binary"), as_number(-1, 4))
    bind = _message("B", zero, name, zero, codes, as_number(4, 2), typed, as_number(0, 2))
    way = F.pmod(n, F.lit(4))
    frame = lambda i, d, b: F.struct(F.lit(i).alias("turn"), F.lit(d).alias("dir"), b.alias("bytes"))
    answer = F.when(way == 1, F.concat(short, row)).when(way == 3, F.lit(b"")).otherwise(F.concat(whole, row))
    last = F.concat(F.when(way == 2, _message("C", F.lit("S"), name, zero)).otherwise(F.lit(b"")), bind, _message("Q", F.lit("SELECT now()"), zero))
    cut = F.pmod(n, F.lit(7)).cast("int") + 1
    frames = F.array(frame(0, "F", prepare), frame(1, "B", answer), frame(2, "F", F.substring(last, F.lit(1), cut)), frame(3, "F", F.substring(last, cut + 1, F.lit(10_000))))
    own = _events(spark, sf_dir).select("event_id", F.pmod(n, F.lit(16)).cast("int").alias("conn"), F.inline(frames))
    return own.select("conn", (F.col("event_id") * 4 + F.col("turn")).alias("seq"), "dir", "bytes")


@query("""SELECT CAST(event_id % 16 AS INTEGER) AS conn, 'bind' AS kind, 's' || event_id AS stmt, CASE WHEN event_id % 4 <> 2 THEN 'SELECT ' || event_id END AS sql, event_id % 4 <> 2 AS resolved,
        CASE WHEN event_id % 2 = 0 THEN event_id || '|1.5' ELSE '<undecoded>|<undecoded>' END || '|' || event_type || '|NULL' AS params,
        CASE event_id % 4 WHEN 1 THEN '3 captured types for 4 values: not decoded' WHEN 3 THEN 'binary value without a captured type' END AS reason FROM events
    UNION ALL SELECT event_id % 16, 'parse', 's' || event_id, 'SELECT ' || event_id, false, NULL, NULL FROM events
    UNION ALL SELECT event_id % 16, 'close', 's' || event_id, NULL, false, NULL, NULL FROM events WHERE event_id % 4 = 2
    UNION ALL SELECT event_id % 16, 'query', '', 'SELECT now()', true, NULL, NULL FROM events
    UNION ALL SELECT event_id % 16, kind, 's' || event_id, NULL, true, NULL, NULL FROM events, (VALUES ('param_description'), ('row_description')) AS k(kind) WHERE event_id % 4 <> 3""")
def capture_both_directions(spark, sf_dir):
    found = resolve.captured(resolve.protocol_events(wire.messages(_both_directions(spark, sf_dir))))
    reason = F.try_element_at(F.filter(F.transform("params", lambda p: p["unknown_reason"]), lambda r: r.isNotNull()), F.lit(1))
    return found.select("conn", "kind", "stmt", "sql", "resolved", F.array_join(c.param_texts(F.col("params")), "|").alias("params"), reason.alias("reason"))


# Audit -------------------------------------------------------------------------------------------------------------------


def _verdicts(spark, sf_dir) -> DataFrame:
    """One row for each template: id, sql, verdict, ..., n (how often it was captured), population."""
    known = audit.judged_events(corpus.captured(spark, sf_dir)).groupBy("id", "sql", "params").agg(F.count(F.lit(1)).alias("n"))
    found = diff.verdicts_table(spark, diff.diff_reads(_legs(spark, sf_dir), diff.as_captured(known.toLocalIterator()), corpus.SCOPED))
    return audit.with_population(found.join(known, "id"), list(ROW_LEVEL), list(STRUCTURAL))


_EXPECTED = f"""WITH k AS (SELECT * FROM {_values('template, id, verdict, vacuous, population', [(i, t.id, t.first, t.id == 'S7' or None, {'U1': 'row_level_unattributed', 'U3': 'row_level_unattributed', 'U2': 'no_declared_table', 'U4': 'no_declared_table'}.get(t.id)) for i, t in enumerate(corpus.TEMPLATES)])}),
    own AS (SELECT event_id % {len(corpus.TEMPLATES)} AS template, count(*) AS n FROM events GROUP BY 1), seventh AS (SELECT c_nationkey = 7 AS yes FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 1),
    v AS (SELECT id, verdict, population, n, coalesce(vacuous, false) AND NOT coalesce((SELECT bool_or(yes) FROM seventh), false) AS vacuous FROM k JOIN own USING (template)),
    s AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE verdict = 'SAFE'), 0) AS BIGINT) AS safe, CAST(coalesce(sum(n) FILTER (WHERE verdict = 'LEAK'), 0) AS BIGINT) AS leak,
        CAST(coalesce(sum(n) FILTER (WHERE verdict = 'UNATTRIBUTABLE'), 0) AS BIGINT) AS unattributable, CAST(coalesce(sum(n) FILTER (WHERE vacuous), 0) AS BIGINT) AS vacuous_safe,
        {', '.join(f"CAST(coalesce(sum(n) FILTER (WHERE population = '{p}'), 0) AS BIGINT) AS {p}" for p in audit.POPULATIONS)} FROM v),
    d AS (SELECT unnest([{', '.join(map(_quoted, audit.DENOMINATORS))}]) AS label, unnest([n, n - non_query, safe - vacuous_safe + leak + structural_only + row_level_unattributed, safe - vacuous_safe + leak + row_level_unattributed]) AS denominator,
        unnest([unattributable, unattributable - non_query, structural_only + row_level_unattributed, row_level_unattributed]) AS unattributable FROM s),
    r AS (SELECT *, round(unattributable / denominator, 6) AS rate FROM d WHERE denominator > 0)"""


@query(f"{_EXPECTED} SELECT id, verdict, population, n FROM v")
def audit_verdicts_corpus(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("id", "verdict", "population", "n")


@query(f"{_EXPECTED}, t AS (SELECT * FROM {_values('template, sql, params', [(i, t.sql, '|'.join(t.params) if t.params else None) for i, t in enumerate(corpus.TEMPLATES)])}) SELECT t.sql, t.params, v.verdict, v.population, v.n, CASE WHEN v.vacuous THEN true END AS vacuous FROM v JOIN k USING (id) JOIN t USING (template)")
def audit_report_queries(spark, sf_dir):
    return audit.queries(_verdicts(spark, sf_dir)).select("sql", F.array_join("params", "|").alias("params"), "verdict", "population", "n", "vacuous")


@query(f"{_EXPECTED} SELECT * FROM s")
def audit_verdict_counts(spark, sf_dir):
    return audit.counts(_verdicts(spark, sf_dir))


@query(f"{_EXPECTED} SELECT * FROM r")
def audit_rates(spark, sf_dir):
    return audit.rates(audit.counts(_verdicts(spark, sf_dir)))


@query(f"{_EXPECTED} SELECT rate, unattributable / denominator > 18.0 / 762 AS exceeded FROM r WHERE label = '{audit.CEILING_OF}'")
def audit_ceiling(spark, sf_dir):
    return audit.ceiling(audit.rates(audit.counts(_verdicts(spark, sf_dir))))


@query("SELECT first_failure, exceeded, CAST(code AS INTEGER) AS code FROM (VALUES (NULL, false, 0), (NULL, true, 3), ('A1', true, 10), ('A2', false, 11), ('A3', false, 12), ('A4', true, 13)) AS v(first_failure, exceeded, code)")
def audit_exit_code(spark, sf_dir):
    cases = spark.createDataFrame([(None, False), (None, True), ("A1", True), ("A2", False), ("A3", False), ("A4", True)], "first_failure string, exceeded boolean")
    return cases.withColumn("code", audit.exit_code(F.col("first_failure"), F.col("exceeded")))


@query(f"SELECT id, verdict FROM {_values('id, verdict', [(t.id, t.second) for t in corpus.TEMPLATES if t.second])}")
def guardrail_check(spark, sf_dir):
    own = corpus.captured(spark, sf_dir).filter("sql is not null").select("id", "sql", c.param_texts(F.col("params")).alias("params")).distinct()
    return own.withColumn("checked", c.tenant_check(corpus.CLASSES)("sql", "params", F.lit(TENANT))).select("id", "checked.verdict")


# Simulated writes --------------------------------------------------------------------------------------------------------


@query(f"{with_clause('ov_customer')} SELECT count(*) AS n_rows, count(*) FILTER (WHERE tenant_id <> '{TENANT}') AS n_violations, CASE WHEN count(*) FILTER (WHERE tenant_id <> '{TENANT}') > 0 THEN 'LEAK' ELSE 'SAFE' END AS verdict FROM ov_customer WHERE c_mktsegment = 'BUILDING'")
def write_insert_check(spark, sf_dir):
    df = tables(spark, sf_dir)["ov_customer"].filter("c_mktsegment = 'BUILDING'")
    return writes.check_insert(df, "tenant_id", TENANT).select("n_rows", "n_violations", "verdict")


@query(f"""{with_clause('ov_orders')}, w AS (SELECT * FROM ov_orders WHERE o_orderstatus = 'O'), v AS (SELECT * FROM w WHERE tenant_id = '{TENANT}')
    SELECT (SELECT count(*) FROM w) AS n_unrestricted, (SELECT count(*) FROM v) AS n_restricted, (SELECT count(*) FROM v WHERE o_custkey % 2 = 0) AS n_violations,
    CASE WHEN (SELECT count(*) FROM v WHERE o_custkey % 2 = 0) > 0 THEN 'LEAK' ELSE 'SAFE' END AS verdict, (SELECT count(*) FROM w) - (SELECT count(*) FROM v) AS affected_delta""")
def write_update_check(spark, sf_dir):
    moved = {"tenant_id": F.when(F.col("o_custkey") % 2 == 0, "8").otherwise(F.col("tenant_id"))}
    return writes.check_update(tables(spark, sf_dir)["ov_orders"], F.col("o_orderstatus") == "O", moved, "tenant_id", TENANT).select("n_unrestricted", "n_restricted", "n_violations", "verdict", "affected_delta")


@query(f"{with_clause('ov_orders')} SELECT count(*) AS n_unrestricted, count(*) FILTER (WHERE tenant_id = '{TENANT}') AS n_restricted, CAST(0 AS BIGINT) AS n_violations, 'SAFE' AS verdict FROM ov_orders WHERE o_orderstatus = 'F'")
def write_delete_visible(spark, sf_dir):
    return writes.check_delete(tables(spark, sf_dir)["ov_orders"], F.col("o_orderstatus") == "F", "tenant_id", TENANT).select("n_unrestricted", "n_restricted", "n_violations", "verdict")


@query(f"""{with_clause('ov_orders')}, n AS (SELECT o_custkey * 3 AS id FROM ov_orders)
    SELECT 'id' AS key, CASE WHEN tenant_id = '{TENANT}' THEN 'resolved' ELSE 'unattributable' END AS outcome, count(*) AS n FROM n JOIN ov_orders USING (id) GROUP BY 2""")
def write_conflict_keys(spark, sf_dir):
    """Every order gives an incoming row, whose key an order has or has not."""
    df = tables(spark, sf_dir)["ov_orders"]
    return writes.conflicts(df.select((F.col("o_custkey") * 3).alias("id")), df, [["id"]], "tenant_id", TENANT)


#: (id, text, parameters, verdict, rows beyond) of captured writes as the tenant 7; counts depend on the data and are in the SQL.
_CAPTURED_WRITES = [
    ("insert", "INSERT INTO ov_orders (id, tenant_id) VALUES ($1, $2) RETURNING id", ("900000001", "7"), "SAFE"), ("insert_two", "INSERT INTO ov_orders (id, tenant_id) VALUES ($1, $2), ($3, '8')", ("900000001", "7", "900000002"), "LEAK"),
    ("insert_taken", "INSERT INTO ov_orders (id, tenant_id) VALUES ($1, $2)", ("1", "none"), "UNATTRIBUTABLE"), ("insert_select", "INSERT INTO ov_orders (id, tenant_id) SELECT id, tenant_id FROM ov_orders WHERE tenant_id = $1", ("7",), "SAFE"),
    ("update", "UPDATE ov_orders SET o_orderstatus = 'X' WHERE tenant_id = $1", ("7",), "SAFE"), ("update_moves", "-- moves rows\nUPDATE ov_orders o SET tenant_id = '8' WHERE o.tenant_id = $1", ("7",), "LEAK"),
    ("delete", "DELETE FROM ov_orders WHERE tenant_id = $1 AND o_orderstatus = $2", ("7", "F"), "SAFE"), ("delete_join", "DELETE FROM ov_orders USING ov_supplier s WHERE ov_orders.tenant_id = $1", ("7",), "UNATTRIBUTABLE"),
    ("with_write", "WITH gone AS (DELETE FROM ov_orders WHERE tenant_id = $1 RETURNING *) SELECT * FROM gone", ("7",), "UNATTRIBUTABLE"),
]


@query(f"SELECT id, verdict FROM {_values('id, verdict', [(x[0], x[3]) for x in _CAPTURED_WRITES])}")
def diff_write_captured(spark, sf_dir):
    known = [diff.Captured(i, sql, tuple(st.Param(p) for p in params)) for i, sql, params, _ in _CAPTURED_WRITES]
    legs = _legs(spark, sf_dir)
    return diff.verdicts_table(spark, diff.diff_reads(legs, known, corpus.SCOPED, {"ov_orders": [["id"]]})).select("id", "verdict")


_COMMANDS = (
    "INSERT OVERWRITE DIRECTORY '/tmp/isolens-never' USING parquet SELECT * FROM ov_orders WHERE tenant_id = $1", "CREATE TABLE never AS SELECT * FROM ov_orders WHERE tenant_id = $1", "DROP VIEW ov_orders; -- FROM ov_orders WHERE tenant_id = $1",
    "SET spark.sql.ansi.enabled = false -- FROM ov_orders WHERE tenant_id = $1", "CACHE TABLE ov_orders AS SELECT * FROM ov_orders WHERE tenant_id = $1", "SELECT h.* FROM ov_orders i JOIN hidden_ov_orders h ON true WHERE i.tenant_id = $1",
    "FROM ov_orders INSERT OVERWRITE DIRECTORY '/tmp/isolens-never' USING parquet SELECT * WHERE tenant_id = $1",
)


@query(f"SELECT id, 'UNATTRIBUTABLE' AS verdict, true AS still_there FROM {_values('id', [(str(i),) for i in range(len(_COMMANDS))])}")
def audit_commands_refused(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    found = list(diff.diff_reads(legs, [diff.Captured(str(i), sql, (st.Param("7"),)) for i, sql in enumerate(_COMMANDS)], corpus.SCOPED))
    there = legs.restricted.catalog.tableExists("ov_orders") and not legs.restricted.catalog.tableExists("never") and legs.restricted.conf.get("spark.sql.ansi.enabled") == spark.conf.get("spark.sql.ansi.enabled")
    return diff.verdicts_table(spark, found).select("id", "verdict", F.lit(there).alias("still_there"))


@query(f"""{with_clause('ov_orders')} SELECT 'run' AS part, 'SAFE' AS verdict, CAST(count(*) AS BIGINT) AS n FROM ov_orders WHERE tenant_id = '{TENANT}'
    UNION ALL SELECT 'claim NULL', 'resolved', count(*) FROM events""")
def attribute_null_parameter(spark, sf_dir):
    """A null is bound as null, and a tenant that is null is named NULL."""
    both = diff.compare(*_legs(spark, sf_dir).run("SELECT id FROM ov_orders WHERE tenant_id = $1 AND $2 IS NULL", [TENANT, None], TENANT))
    run = both.select(F.lit("run").alias("part"), "verdict", F.col("n_restricted").alias("n"))
    own = _texts(spark, sf_dir, ["SELECT * FROM ov_orders WHERE tenant_id = $1"], [F.lit(None).cast("string")]).withColumn("params", F.transform("params", lambda p: p.withField("null", F.lit(True))))
    claims = own.select(c.attribution(corpus.SCOPED)("sql", "params").alias("a")).groupBy(F.concat(F.lit("claim "), F.col("a.value")).alias("part"), F.col("a.kind").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    return run.unionByName(claims)


@query(f"{with_clause('ov_orders')} SELECT tenant_id = '0' AS replaced, count(*) AS n FROM (SELECT CASE WHEN id % 10 = 0 THEN '0' ELSE '1' END AS tenant_id FROM ov_orders) GROUP BY 1")
def write_conflict_replaced(spark, sf_dir):
    df = tables(spark, sf_dir)["ov_orders"].withColumn("tenant_id", F.lit("1"))
    new = df.filter(F.col("id") % 10 == 0).withColumn("tenant_id", F.lit("0"))
    return writes.without_conflicts(new, df, ["id"]).groupBy((F.col("tenant_id") == "0").alias("replaced")).agg(F.count(F.lit(1)).alias("n"))


# Triage ------------------------------------------------------------------------------------------------------------------

#: (path ending, text, verb, table, mentions a tenant column, suspect) of each kind of source file.
_SOURCES = [
    (".sql", "SELECT * FROM widgets WHERE org_id = $1", "READ", "widgets", True, False), (".sql", "SELECT * FROM widgets WHERE id = $1", "READ", "widgets", False, True),
    (".sql", "UPDATE widgets SET name = $1 WHERE id = $2", "WRITE", "widgets", False, True), (".sql", "DELETE FROM widgets AS w WHERE w.org_id = $1 OR true", "WRITE", "widgets", True, False),
    (".sql", "SELECT * FROM plain", "READ", "plain", False, False), (".sql", "Delete all encrypted data from the database.", None, None, False, False),
    (".sql", "Select an option from the menu", None, None, False, False), (".sql", "Select one item from our catalogue", None, None, False, False), (".sql", "SELECT * FROM widgets w", None, None, False, False),
    (".go", 'package a\n// "SELECT * FROM hidden"\nvar q = "SELECT id FROM widgets;"', "READ", "widgets", False, True), (".go", "package a\nvar q = `INSERT INTO plain (a) VALUES ($1)`", "WRITE", "plain", False, False),
    (".go", '// Code generated by x. DO NOT EDIT.\nvar q = "SELECT * FROM widgets"', None, None, False, False), (".txt", "SELECT * FROM widgets", None, None, False, False),
]
_SQL_SOURCES = f"WITH k AS (SELECT * FROM {_values('template, ending, verb, tab, evidence, suspect', [(i, x[0], *x[2:]) for i, x in enumerate(_SOURCES)])}), f AS (SELECT k.*, 'src/' || CAST(event_id AS VARCHAR) || ending AS file FROM events JOIN k ON template = event_id % {len(_SOURCES)})"


def _sources(spark, sf_dir) -> DataFrame:
    n = F.pmod("event_id", F.lit(len(_SOURCES)))
    path = F.concat(F.lit("src/"), F.col("event_id").cast("string"), corpus.by_template(n, [x[0] for x in _SOURCES]))
    return _events(spark, sf_dir).select(path.alias("path"), corpus.by_template(n, [x[1] for x in _SOURCES]).alias("text"))


@query(f"{_SQL_SOURCES} SELECT tab AS \"table\", count(*) AS n, count(*) FILTER (WHERE evidence) AS n_evidence, 'org_id' AS tenant_column, round(count(*) FILTER (WHERE evidence) / count(*), 6) AS confidence FROM f WHERE tab = 'widgets' GROUP BY tab")
def triage_evidence(spark, sf_dir):
    return triage.evidence(triage.statements(_sources(spark, sf_dir)))


@query(f"{_SQL_SOURCES} SELECT row_number() OVER (ORDER BY CASE verb WHEN 'WRITE' THEN 0 ELSE 1 END, file) AS rank, file, tab AS \"table\", verb FROM f WHERE suspect")
def triage_suspicions_ranked(spark, sf_dir):
    found = triage.suspicions(triage.statements(_sources(spark, sf_dir)))
    return found.select(F.col("rank").cast("long").alias("rank"), "file", "table", "verb")


@query(f"{_SQL_SOURCES} SELECT file, verb, tab AS \"table\" FROM f WHERE verb IS NOT NULL")
def triage_prose_rejected(spark, sf_dir):
    return triage.statements(_sources(spark, sf_dir)).select("file", "verb", "table")


@query("""SELECT 'q/' || CAST(event_id AS VARCHAR) || '.sql' AS file, 'get_' || CAST(i AS VARCHAR) AS name, CAST(3 + 3 * i AS INTEGER) AS line FROM (SELECT event_id, unnest(range(1 + event_id % 3)) AS i FROM events)""")
def sql_splitter(spark, sf_dir):
    block = F.transform(F.sequence(F.lit(0).cast("long"), F.pmod("event_id", F.lit(3))), lambda i: F.concat(F.lit("-- name: get_"), i.cast("string"), F.lit(" :one\nSELECT *\nFROM widgets;\n")))
    own = _events(spark, sf_dir).select(F.concat(F.lit("q/"), F.col("event_id").cast("string"), F.lit(".sql")).alias("path"), F.concat(F.lit("-- head\n\n"), F.array_join(block, "")).alias("text"))
    return triage.statements(own).select("file", "name", "line")



# Smaller pieces ------------------------------------------------------------------------------------------------------------

_TYPES = [("Character Varying(20)", "character varying", "canary-tenant-a"), ("TEXT[]", "text", None), ("numeric(10, 2)", "numeric", None), ("uuid", "uuid", st.CANARY_UUIDS[0]), ("timestamp(3) with time zone", "timestamp with time zone", None), ("name", "name", "canary-tenant-a")]


@query(f"SELECT declared, base, canary FROM {_values('declared, base, canary', _TYPES)}")
def declared_types(spark, sf_dir):
    own = spark.createDataFrame([(t,) for t, *_ in _TYPES], "declared string")
    return own.select("declared", F.regexp_replace(c.base_type(F.col("declared")), " +", " ").alias("base"), c.canary_text(F.col("declared"), 0).alias("canary"))


_SAMPLES = {
    "integer": "CAST(1000 + event_id AS VARCHAR)", "numeric(10,2)": "CAST(1000 + event_id AS VARCHAR) || '.0'", "boolean": "CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END", "character varying(9)": "'sample-' || event_id",
    "uuid": "'00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0')", "timestamp(6) with time zone": "strftime(TIMESTAMP '2000-01-01' + to_microseconds(event_id), '%Y-%m-%d %H:%M:%S.%f')",
    "date": "CAST(DATE '2000-01-01' + CAST(event_id AS INTEGER) AS VARCHAR)", "time without time zone": "strftime(TIMESTAMP '2000-01-01' + to_seconds(event_id), '%H:%M:%S')", "jsonb": "'{\"sample\":' || event_id || '}'",
    "bytea": "'\\x' || lpad(lower(hex(event_id % 256)), 2, '0')", "inet": "'127.0.0.' || (1 + event_id % 254)", "interval": "(1 + event_id) || ' seconds'", "jsonb[]": "'{\"{\\\"sample\\\":' || event_id || '}\"}'",
    "mood": "['sad', 'ok', 'happy'][1 + event_id % 3]", "point[]": "'{}'", "point": "CAST(NULL AS VARCHAR)",
}


@query(f"SELECT event_id AS seq, CASE event_id % {len(_SAMPLES)} {' '.join(f'WHEN {i} THEN {_quoted(k)}' for i, k in enumerate(_SAMPLES))} END AS declared, CASE event_id % {len(_SAMPLES)} {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(_SAMPLES.values()))} END AS sample FROM events")
def sample_values(spark, sf_dir):
    n = F.col("event_id")
    declared = corpus.by_template(F.pmod(n, F.lit(len(_SAMPLES))), list(_SAMPLES))
    labels = F.when(F.col("declared") == "mood", F.array(*[F.lit(x) for x in ("sad", "ok", "happy")]))
    return _events(spark, sf_dir).select(n.alias("seq"), declared.alias("declared")).withColumn("sample", c.sample_text(F.col("declared"), F.col("seq"), labels))


_ARRAYS = [("{a,b}", "a|b"), ('{"a, b",NULL,"q\\"x"}', 'a, b|<null>|q"x'), ("{}", ""), ("{a,}", None), ("a,b", None)]


@query(f"SELECT literal, elements FROM {_values('literal, elements', _ARRAYS)}")
def array_literals(spark, sf_dir):
    own = spark.createDataFrame([(t,) for t, _ in _ARRAYS], "literal string")
    return own.select("literal", F.array_join(c.array_literal("literal"), "|", "<null>").alias("elements"))


@query("SELECT o_orderkey AS id, 'Key (id, status)=(' || o_orderkey || ', ' || o_orderstatus || ') already exists.' AS detail, CAST(o_orderkey AS VARCHAR) AS key_id, o_orderstatus AS key_status FROM orders UNION ALL SELECT 0, 'Failing row contains (1).', NULL, NULL")
def duplicate_key_details(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    detail = F.concat(F.lit("Key (id, status)=("), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_orderstatus"), F.lit(") already exists."))
    own = o.select(F.col("o_orderkey").alias("id"), detail.alias("detail")).unionByName(spark.range(1).select("id", F.lit("Failing row contains (1).").alias("detail")))
    key = c.duplicate_key(F.col("detail"))
    return own.select("id", "detail", key["id"].alias("key_id"), key["status"].alias("key_status"))


@query("SELECT 'A1' AS gate, 't2' AS \"table\"")
def proof_first_cause(spark, sf_dir):
    rows = [("t1", True, True, False), ("t2", True, False, False), ("t3", False, None, None), ("t4", True, False, True)]
    return proof.first_cause(spark.createDataFrame(rows, "table string, seeded boolean, a1 boolean, a4 boolean"))


@query(f"SELECT name, true AS confirmed FROM {_values('name', [(n,) for n in ROW_LEVEL])}")
def filters_confirmed(spark, sf_dir):
    legs = _legs(spark, sf_dir)
    lacking = proof.unconfirmed(legs)
    return spark.createDataFrame([(n, n not in lacking) for n in legs.filters], "name string, confirmed boolean")


@query("SELECT CAST(event_id AS INTEGER) AS conn, type, sql FROM events, (VALUES ('startup', NULL), ('Q', 'SELECT 1')) AS v(type, sql)")
def startup_negotiation(spark, sf_dir):
    n = F.col("event_id")
    ssl, version, query_ = F.unhex(F.lit("0000000804d2162f")), F.unhex(F.lit("0000000900030000") ), F.unhex(F.lit("510000000d53454c454354203100"))
    sent = F.when(n % 2 == 0, F.concat(ssl, version, F.unhex(F.lit("00")), query_)).otherwise(F.concat(version, F.unhex(F.lit("00")), query_))
    e = _events(spark, sf_dir).select(n.cast("int").alias("conn"), sent.alias("sent"), (F.pmod(n, F.lit(11)).cast("int") + 1).alias("cut"))
    halves = F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.substring("sent", F.lit(1), F.col("cut")).alias("bytes")), F.struct(F.lit(1).cast("long").alias("seq"), F.substring("sent", F.col("cut") + 1, F.lit(1000)).alias("bytes")))
    frames = e.select("conn", F.inline(halves), F.lit("F").alias("dir"))
    return wire.messages(frames, startup=True).select("conn", "type", "sql")
