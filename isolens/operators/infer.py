"""Which relations are scoped to tenants, from the catalogue of their columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolens.functions import columns as c

COLUMNS = "schema string, name string, kind string, attnum int, column string, type string, partition boolean"
#: What a policy speaks of; a partition is part of its parent.
KINDS = ("BASE TABLE", "PARTITIONED TABLE", "VIEW", "MATERIALIZED VIEW", "FOREIGN TABLE")


def catalog(spark: SparkSession, relations: dict[str, DataFrame], kinds: dict[str, str] | None = None, partitions: Sequence[str] = ()) -> DataFrame:
    """One row for each column of the relations; partitions: those that are part of another."""
    kinds = kinds or {}
    rows = [("public", name, kinds.get(name, "BASE TABLE"), i, f.name, f.dataType.simpleString(), name in partitions) for name, df in relations.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, COLUMNS)


def relations_of(catalog: DataFrame) -> DataFrame:
    """schema, name, kind, columns (in the order of the catalogue), without system schemas, partitions and what is no relation."""
    own = catalog.filter(F.col("kind").isin(*KINDS) & ~F.coalesce("partition", F.lit(False)) & ~F.col("schema").isin("pg_catalog", "information_schema") & ~F.col("schema").startswith("pg_toast"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("attnum", "column"))), lambda x: x["column"])
    return own.groupBy("schema", "name", "kind").agg(ordered.alias("columns"))


def infer(catalog: DataFrame) -> DataFrame:
    """The policy: schema, name, kind, class, tenant_column, candidates, reason."""
    found = relations_of(catalog).withColumn("candidates", c.candidates(F.col("columns")))
    kind = c.class_of(F.col("kind"), F.col("candidates"))
    column = F.when(kind == "scoped", F.element_at("candidates", 1))
    return found.select("schema", "name", "kind", kind.alias("class"), column.alias("tenant_column"), "candidates", c.class_reason(F.col("kind"), F.col("candidates")).alias("reason"))


def counts(policy: DataFrame) -> DataFrame:
    n = lambda k: F.coalesce(F.sum((F.col("class") == k).cast("long")), F.lit(0)).alias(k)
    return policy.agg(n("scoped"), n("unscoped"), n("unclassifiable"))
