"""Statement templates over the overlay with their known verdicts, and synthetic captures made of them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isolens.functions import statements as st
from isolens.functions.columns import PARAM
from isolens.operators.diff import Captured
from isolens.operators.rowfilter import View
from isolens.plans.overlay import PRIMARY_KEYS, ROW_LEVEL, TENANT


class Template(NamedTuple):
    id: str
    sql: str | None
    params: tuple[str, ...]
    first: str  # verdict of the differential run
    second: str | None  # verdict of the check before execution, for tenant 7
    claim: str  # kind of attribution


_BOTH = "SELECT i.id, a.note FROM ov_orders i JOIN ov_notes a ON a.order_id = i.id WHERE i.tenant_id = $1 AND a.tenant_id = $2"
TEMPLATES = (
    Template("S1", "SELECT * FROM ov_orders WHERE tenant_id = $1", ("7",), "SAFE", "SAFE", "resolved"),
    Template("S2", "SELECT o_orderstatus FROM ov_orders WHERE tenant_id = $1 AND o_orderstatus = $2", ("7", "O"), "SAFE", "SAFE", "resolved"),
    Template("S3", _BOTH, ("7", "7"), "SAFE", "SAFE", "resolved"),
    Template("S4", "WITH scoped AS (SELECT * FROM ov_orders WHERE tenant_id = $1) SELECT * FROM scoped", ("7",), "SAFE", "SAFE", "resolved"),
    Template("S5", "SELECT count(*) FROM ov_orders WHERE tenant_id = $1", ("7",), "SAFE", "SAFE", "resolved"),
    Template("S6", "SELECT * FROM ov_orders_v WHERE tenant_id = $1", ("7",), "SAFE", "SAFE", "resolved"),
    Template("S7", "SELECT * FROM ov_orders WHERE id = $1 AND tenant_id = $2", ("1", "7"), "SAFE", "SAFE", "resolved"),
    Template("S8", "SELECT * FROM ov_orders WHERE tenant_id = $1 ORDER BY id LIMIT 10", ("7",), "SAFE", "SAFE", "resolved"),
    Template("S9", "INSERT INTO ov_orders (id, tenant_id, o_orderstatus) VALUES ($1, $2, $3) RETURNING *", ("900000001", "7", "O"), "SAFE", "SAFE", "resolved"),
    Template("S10", "SELECT * FROM ov_notes WHERE tenant_id = $1", ("7",), "SAFE", "SAFE", "resolved"),
    Template("L1", "SELECT * FROM ov_orders WHERE id = $1", ("1",), "LEAK", "LEAK", "no_predicate"),
    Template("L2", "SELECT count(*) FROM ov_orders", (), "LEAK", "LEAK", "no_predicate"),
    Template("L3", "SELECT i.* FROM ov_orders i JOIN ov_notes a ON a.order_id = i.id WHERE a.tenant_id = $1", ("7",), "LEAK", "SAFE", "resolved"),
    Template("L4", "WITH agg AS (SELECT count(*) c FROM ov_orders) SELECT c FROM agg", (), "LEAK", "LEAK", "no_predicate"),
    Template("L5", "SELECT * FROM ov_orders WHERE tenant_id = $1", ("8",), "SAFE", "LEAK", "resolved"),
    Template("L6", "SELECT * FROM ov_orders WHERE tenant_id = tenant_id", (), "LEAK", "LEAK", "no_predicate"),
    Template("L7", "SELECT * FROM ov_orders_dv", (), "SAFE", "LEAK", "no_predicate"),
    Template("L8", "SELECT * FROM ov_orders WHERE tenant_id IN (SELECT tenant_id FROM ov_tenants)", (), "LEAK", "LEAK", "no_predicate"),
    Template("L9", "SELECT max(id) FROM ov_orders", (), "LEAK", "LEAK", "no_predicate"),
    Template("L10", "SELECT * FROM ov_orders WHERE tenant_id = $1 OR o_orderstatus = $2", ("7", "O"), "LEAK", "SAFE", "resolved"),
    Template("U1", "SELECT * FROM ov_orders WHERE tenant_id = (SELECT tenant_id FROM ov_supplier WHERE id = $1)", ("1",), "UNATTRIBUTABLE", "UNATTRIBUTABLE", "unattributable"),
    Template("U2", "SELECT * FROM scoped_summary()", (), "UNATTRIBUTABLE", "UNATTRIBUTABLE", "unattributable"),
    Template("U3", _BOTH.replace("i.id, a.note", "*"), ("7", "8"), "UNATTRIBUTABLE", "UNATTRIBUTABLE", "unattributable"),
    Template("U4", None, (), "UNATTRIBUTABLE", None, "unattributable"),
)
#: Beside the corpus.
LINEITEM_MAX = Template("X1", "SELECT max(l_linenumber) FROM ov_lineitem WHERE tenant_id = $1::uuid", ("7",), "SAFE", "SAFE", "resolved")
SCOPED = [st.Scoped(n, c) for n, c in ROW_LEVEL.items()] + [st.Scoped("ov_orders_v", "tenant_id"), st.Scoped("ov_orders_dv", "tenant_id")]
CLASSES: dict[str, tuple[str, str | None]] = {s.name: ("scoped", s.tenant_column) for s in SCOPED} | {"ov_tenants": ("unscoped", None), "ov_ambiguous": ("unclassifiable", None)}
VIEWS = {"ov_orders_v": View("SELECT * FROM ov_orders"), "ov_orders_dv": View("SELECT * FROM ov_orders", invoker=False)}


def statements() -> list[Captured]:
    return [Captured(t.id, t.sql, tuple(st.Param(p) for p in t.params)) for t in TEMPLATES]


def by_template(column: Column, values: list) -> Column:
    """The value of the template that the number selects."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column + 1).cast("int"))


def params_column(number: Column) -> Column:
    texts = by_template_arrays(number, [t.params for t in TEMPLATES])
    one = lambda p: F.struct(F.lit(False).alias("null"), F.lit("text").alias("format"), F.lit(25).cast("long").alias("oid"), F.lit(True).alias("value_known"), p.alias("value"), F.lit(None).cast("string").alias("value_base64"), F.lit(None).cast("string").alias("unknown_reason"))
    return F.transform(texts, one).cast(f"array<{PARAM}>")


def by_template_arrays(number: Column, values: list[tuple[str, ...]]) -> Column:
    return F.element_at(F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in values]), (number + 1).cast("int"))


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bind for each row of events: conn, seq, template, id, kind, sql, params."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"))
    number = F.pmod("seq", F.lit(len(TEMPLATES)))
    return events.select(
        F.pmod("seq", F.lit(16)).cast("int").alias("conn"), "seq", number.cast("int").alias("template"), by_template(number, [t.id for t in TEMPLATES]).alias("id"),
        F.lit("bind").alias("kind"), by_template(number, [t.sql for t in TEMPLATES]).alias("sql"), params_column(number).alias("params"),
    )


__all__ = ["CLASSES", "PRIMARY_KEYS", "SCOPED", "TEMPLATES", "TENANT", "VIEWS", "captured", "statements"]
