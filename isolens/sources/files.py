"""Events, policies, source trees and protocol frames as DataFrames, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolens.functions.columns import PARAM

EVENT = f"conn int, kind string, stmt string, portal string, sql string, resolved boolean, note string, params array<{PARAM}>"
POLICY = "relations array<struct<schema:string,name:string,kind:string,class:string,tenant_column:string,candidates:array<string>,reason:string,fixture:array<map<string,string>>,primary_key:array<string>,unique_keys:array<array<string>>,security_invoker:boolean,owner:string,enabled:boolean,forced:boolean>>"
FRAME = "conn int, seq bigint, dir string, bytes binary"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Captured events, one JSON object a line; malformed lines are errors."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def write_events(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).option("mode", "FAILFAST").json(path)


def param_bytes(param):
    """The bytes of a parameter that could not be decoded."""
    return F.unbase64(param["value_base64"])


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """One row for each relation of a policy document."""
    return spark.read.schema(POLICY).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("relations"))


def write_policy(policy: DataFrame, path: str) -> None:
    """One indented document, for people to review; a policy is small by nature."""
    names = F.array_sort(F.collect_list(F.struct("schema", "name", *[c for c in policy.columns if c not in ("schema", "name")])))
    policy.agg(names.alias("relations")).select(F.to_json(F.struct("relations"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root) and text of the *.sql and *.go files of a tree."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{sql,go}").load(root)
    return files.select(F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("^" + root.rstrip("/") + "/"), F.lit("")).alias("path"), F.decode("content", "UTF-8").alias("text"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME).parquet(path)
