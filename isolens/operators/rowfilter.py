"""Row filters and the two legs of a differential run.

A catalogue holds base relations and offers two sessions with the same view names: in the unrestricted leg a
view is the whole relation, in the restricted leg it shows the rows of the tenant in the session variable.
Catalyst inlines the views, so the filter reaches the scan; for a tenant column that is not a string a
second, redundant condition in the column's own type is added, because the textual comparison alone cannot be
pushed down.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIABLE = "row_tenant"

_numbers = count()
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|\$(\d+)|::\s*(uuid|timestamptz|jsonb?)\b|\bfor\s+update\b|\breturning\b[^)]*$", re.I | re.S)


def rows_of(df: DataFrame, column: str, tenant: str | None) -> DataFrame:
    """The rows that the filter shows to the tenant; without a tenant there are none."""
    return df.filter(tenant_matches(df, column, F.lit(tenant).cast("string")))


def tenant_matches(df: DataFrame, column: str, tenant: Column) -> Column:
    text = df[column].cast("string") == tenant
    kind = df.schema[column].dataType
    return text if isinstance(kind, T.StringType) else (df[column] == tenant.try_cast(kind)) & text


def spark_text(sql: str) -> str:
    """The statement in this dialect: $1 as :p1, types that are strings here, without what only writers or lockers need."""

    def one(m: re.Match) -> str:
        if m[1]:
            return f":p{m[1]}"
        if m[2]:
            return "::timestamp" if m[2].lower() == "timestamptz" else "::string"
        return m[0] if m[0][0] in "'\"-" else ""

    return _QUOTED.sub(one, sql)


def as_query(sql: str) -> str:
    return f"SELECT * FROM (\n{spark_text(sql).strip().rstrip(';')}\n)"


@dataclass(frozen=True)
class View:
    """A view over relations; with invoker rights it sees what the caller sees, else the whole relations."""

    sql: str
    invoker: bool = True


@dataclass
class Legs:
    """Two sessions over the same relations: filters holds the tenant column of every relation that has a row filter."""

    spark: SparkSession
    relations: dict[str, DataFrame]
    filters: dict[str, str]
    views: dict[str, View] = field(default_factory=dict)

    def __post_init__(self) -> None:
        # what the views read has names that no captured statement can know
        self._base = {name: f"base_{uuid.uuid4().hex}" for name in self.relations}
        self._id = next(_numbers)
        self.unrestricted = self._session(False)
        self.restricted = self._session(True)

    def _session(self, filtered: bool) -> SparkSession:
        own = self.spark.newSession()
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            own.conf.set(key, self.spark.conf.get(key))
        own.sql(f"DECLARE OR REPLACE VARIABLE {VARIABLE} STRING")
        for name, df in self.relations.items():
            hidden = self._base[name]
            _in_session(own, df).createOrReplaceTempView(hidden)
            column = self.filters.get(name)
            if not (filtered and column):
                own.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM {hidden}")
                continue
            where = f"CAST(`{column}` AS STRING) = {VARIABLE}"
            kind = df.schema[column].dataType
            if not isinstance(kind, T.StringType):
                where = f"`{column}` = TRY_CAST({VARIABLE} AS {kind.simpleString()}) AND {where}"
            own.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM {hidden} WHERE {where}")
        for name, view in self.views.items():
            sql = view.sql if view.invoker else re.sub(rf"\b({'|'.join(self.relations)})\b", lambda m: self._base[m[1]], view.sql)
            own.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS {sql}")
        return own

    def run(self, sql: str, params: Sequence[str | None], tenant: str | None) -> tuple[DataFrame, DataFrame]:
        """The statement's rows without and with the row filters; tenant None leaves the variable empty.

        The statement is run as a subquery, which the grammar allows for queries alone: commands do not parse, and nothing is executed.
        """
        args = {f"p{i}": p for i, p in enumerate(params, 1)}
        legs = []
        for own in (self.unrestricted, self.restricted):
            own.sql(f"SET VARIABLE {VARIABLE} = '{(tenant or '').replace(chr(39), chr(39) * 2)}'")
            legs.append(own.sql(as_query(sql), args=args))
        return legs[0], legs[1]


def _in_session(own: SparkSession, df: DataFrame) -> DataFrame:
    """The same plan as a DataFrame of another session."""
    jvm = own.sparkContext._jvm
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.logicalPlan()), own)
