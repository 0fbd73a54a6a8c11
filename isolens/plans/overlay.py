"""A tenancy laid over the TPC-H-like tables: the same definitions for Spark and for the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (SQL, primary key, depth of proof)
OVERLAY = {
    "ov_customer": "SELECT c_custkey AS id, CAST(c_nationkey AS {string}) AS tenant_id, c_mktsegment FROM customer",
    "ov_supplier": "SELECT s_suppkey AS id, CAST(s_nationkey AS {string}) AS tenant_id FROM supplier",
    "ov_orders": "SELECT o_orderkey AS id, CAST(c_nationkey AS {string}) AS tenant_id, o_custkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey",
    "ov_lineitem": "SELECT l_orderkey, l_linenumber, CAST(c_nationkey AS {string}) AS tenant_id, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
    "ov_notes": "SELECT l_orderkey AS order_id, l_linenumber, CAST(s_nationkey AS {string}) AS tenant_id, l_linestatus AS note FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
    "ov_events": "SELECT event_id AS id, CAST(user_id AS {string}) AS account_id, event_type FROM events",
    "ov_part": "SELECT p_partkey AS id, p_size AS workspace_id FROM part",
    "ov_ambiguous": "SELECT c_custkey AS id, c_nationkey AS org_id, c_custkey AS account_id FROM customer",
    "ov_tenants": "SELECT CAST(n_nationkey AS {string}) AS tenant_id FROM nation",
}
TENANT = "7"
PRIMARY_KEYS = {"ov_customer": ["id"], "ov_supplier": ["id"], "ov_orders": ["id"], "ov_events": ["id"], "ov_part": ["id"]}
#: Relations whose row filter is proven by rows of their own; ov_part has a tenant column that takes no canary text.
ROW_LEVEL = {"ov_customer": "tenant_id", "ov_supplier": "tenant_id", "ov_orders": "tenant_id", "ov_lineitem": "tenant_id", "ov_notes": "tenant_id", "ov_events": "account_id"}
STRUCTURAL = {"ov_part": "workspace_id"}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The overlay's relations; tables are read as named views of a session of their own."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    for name in ("customer", "supplier", "orders", "lineitem", "events", "part", "nation", "region"):
        own.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return {name: own.sql(sql.format(string="STRING")) for name, sql in OVERLAY.items()} | {n: own.table(n) for n in ("nation", "region")}


def with_clause(*names: str) -> str:
    """WITH list of the overlay's relations for the SQL oracle."""
    return "WITH " + ", ".join(f"{n} AS ({OVERLAY[n].format(string='VARCHAR')})" for n in names or OVERLAY)
