"""Writes, simulated: what a statement would add or change, and whether the row filter would let it.

Nothing is written.  An INSERT gives candidate rows, an UPDATE the new versions of visible rows, a DELETE removes visible
rows; a new row that the filter would not show to the tenant is a violation.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolens.functions import statements as st
from isolens.operators.rowfilter import Legs, rows_of


def _verdict(violations: Column, unrestricted: Column, restricted: Column) -> list[Column]:
    vacuous = (violations == 0) & (unrestricted == 0) & (restricted == 0)
    return [F.when(violations > 0, "LEAK").otherwise("SAFE").alias("verdict"), F.when(violations > 0, 1).otherwise(0).cast("long").alias("withheld_rows"), vacuous.alias("vacuous"), (unrestricted - restricted).cast("long").alias("affected_delta")]


def check_insert(rows: DataFrame, tenant_column: str, tenant: str) -> DataFrame:
    """One row: n_rows, n_violations and the verdict of inserting the rows as the tenant."""
    wrong = ~rows[tenant_column].cast("string").eqNullSafe(tenant)
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(wrong, 1)).alias("n_violations"))
    n = F.col("n_rows")
    return total.select("n_rows", "n_violations", *_verdict(F.col("n_violations"), n, n))


def check_update(df: DataFrame, where: Column, assignments: dict[str, Column], tenant_column: str, tenant: str) -> DataFrame:
    """One row: n_unrestricted, n_restricted (rows affected), n_violations and the verdict."""
    shown = rows_of(df, tenant_column, tenant).filter(where)
    new = assignments.get(tenant_column, F.col(tenant_column))
    wrong = shown.agg(F.count(F.lit(1)).alias("n_restricted"), F.count(F.when(~new.cast("string").eqNullSafe(tenant), 1)).alias("n_violations"))
    all_ = df.filter(where).agg(F.count(F.lit(1)).alias("n_unrestricted"))
    return all_.crossJoin(wrong).select("n_unrestricted", "n_restricted", "n_violations", *_verdict(F.col("n_violations"), F.col("n_unrestricted"), F.col("n_restricted")))  # one row each


def check_delete(df: DataFrame, where: Column, tenant_column: str, tenant: str) -> DataFrame:
    """A DELETE never violates; it only reaches visible rows."""
    return check_update(df, where, {}, tenant_column, tenant)


def conflicts(rows: DataFrame, existing: DataFrame, keys: Sequence[Sequence[str]], tenant_column: str, tenant: str) -> DataFrame:
    """key, outcome, n: rows whose unique key is taken, by whether the tenant sees the row that takes it.

    A conflict with a visible row is resolved by replacing it; one with a hidden row makes the write unattributable.
    """
    parts = None
    for key in keys:
        taken = existing.select(*key, existing[tenant_column].cast("string").eqNullSafe(tenant).alias("seen"))
        hit = rows.select(*key).join(taken, list(key))
        own = hit.groupBy(F.when(F.col("seen"), "resolved").otherwise("unattributable").alias("outcome")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(",".join(key)).alias("key"), "outcome", "n")
        parts = own if parts is None else parts.unionByName(own)
    return parts


def without_conflicts(rows: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """existing after the rows replaced those with their key."""
    return existing.join(rows.select(*key), list(key), "left_anti").select(existing.columns).unionByName(rows.select(existing.columns))


# Captured texts --------------------------------------------------------------------------------------------------------


class NotReadable(Exception):
    """A write whose text is not understood."""


class Judged(NamedTuple):
    verdict: str
    withheld_rows: int
    vacuous: bool
    n_hidden: int = 0  # rows whose unique key a hidden row has


_TARGET = r'\s+(?:only\s+)?"?(?:\w+\.)?"?(\w+)"?'
_UPDATE = re.compile(rf"(?ais)update{_TARGET}(?:\s+(?:as\s+)?(?!set\b)(\w+))?\s+set\s+")
_DELETE = re.compile(rf"(?ais)delete\s+from{_TARGET}(?:\s+(?:as\s+)?(?!where\b|using\b|returning\b)(\w+))?\s*")
_INSERT = re.compile(rf"(?ais)insert\s+into{_TARGET}\s*(?=\()")
_PART = re.compile(r"(?ai)'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[()]|\b(where|from|using|returning|on\s+conflict)\b")


def _parts(text: str) -> dict[str, str]:
    """The text up to the first clause word outside quotes and parentheses, under '', and what follows each such word."""
    out, name, start, depth = {}, "", 0, 0
    for m in _PART.finditer(text):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[1] and depth == 0:
            out[name] = text[start : m.start()].strip()
            name, start = " ".join(m[1].lower().split()), m.end()
    out[name] = text[start:].strip()
    return out


def _inserted(legs: Legs, text: str, head: re.Match, params: Sequence[str | None], tenant: str | None) -> DataFrame:
    """The rows that an INSERT gives, evaluated with its parameters as the tenant."""
    closed = st.balanced(text, head.end())
    if closed is None:
        raise NotReadable("unbalanced column list")
    columns = [c.strip('"').lower() for c in st.top_level_items(text[head.end() + 1 : closed])]
    rest = text[closed + 1 :].strip().rstrip(";")
    values = re.match(r"(?ai)values\s*(?=\()", rest)
    if not values:
        body = rest[: m.start()] if (m := re.search(r"(?ai)\b(returning|on\s+conflict)\b", rest)) else rest
        return legs.run(body, params, tenant)[1].toDF(*columns)
    given, at = [], values.end()
    while at < len(rest) and rest[at] == "(":
        end = st.balanced(rest, at)
        if end is None:
            raise NotReadable("unbalanced values")
        given.append(st.top_level_items(rest[at + 1 : end]))
        more = re.match(r"\s*,\s*(?=\()", rest[end + 1 :])
        at = end + 1 + more.end() if more else len(rest)
    if any(len(row) != len(columns) for row in given):
        raise NotReadable("columns and values differ in number")
    selects = ["SELECT " + ", ".join(f"CAST({v} AS STRING) AS `{c}`" for v, c in zip(row, columns)) for row in given]
    return reduce(DataFrame.unionByName, [legs.run(one, params, tenant)[1] for one in selects])


def judge(legs: Legs, sql: str, params: Sequence[str | None], tenant: str | None, scoped: dict[str, str], keys: dict[str, list[list[str]]]) -> Judged:
    """What a captured INSERT, UPDATE or DELETE would do; scoped: tenant column by relation, keys: unique keys by relation.

    Only queries are run: the rows an INSERT gives, the rows that the conditions of the others select.  Assignments and
    conditions are evaluated by the server's rules for queries.  Writes in WITH lists and over joins are not readable.
    """
    text = sql[re.match(r"(?:\s+|--[^\n]*(?:\n|$))*", sql).end() :].rstrip().rstrip(";")
    insert, update, delete = (p.match(text) for p in (_INSERT, _UPDATE, _DELETE))
    head = insert or update or delete
    name = head and head[1].lower()
    if not head or name not in scoped or name not in legs.relations:
        raise NotReadable("a write whose target is not a scoped relation by its plain text")
    column = scoped[name]
    wanted = tenant or ""
    if insert:
        rows = _inserted(legs, text, insert, params, tenant)
        if column.lower() not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast("string"))
        found = check_insert(rows, column, wanted).first()
        hidden = 0
        for key in keys.get(name, []):
            if set(key) <= set(rows.columns):
                taken = conflicts(rows.select(*key), legs.relations[name], [key], column, wanted).filter("outcome = 'unattributable'")
                hidden += sum(r.n for r in taken.collect())
        return Judged(found.verdict, found.withheld_rows, found.vacuous, hidden)
    parts = _parts(text[head.end() :])
    if {"from", "using"} & parts.keys():
        raise NotReadable("a write over a join")
    alias = head[2] or name
    where = parts.get("where", "true")
    new = f"{alias}.`{column}`"
    if update:
        for item in st.top_level_items(parts[""]):
            target, eq, value = item.partition("=")
            if not eq or "(" in target:
                raise NotReadable("an assignment of several columns")
            if target.strip().strip('"').lower() == column.lower():
                new = value
    statement = f"SELECT CAST(({new}) AS STRING) AS new_tenant FROM {name} {alias} WHERE {where}"
    whole, shown = legs.run(statement, params, tenant)
    counted = shown.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("new_tenant").eqNullSafe(wanted), 1)).alias("wrong")).first()
    n, wrong = whole.count(), counted.wrong if update else 0
    return Judged(st.LEAK if wrong else st.SAFE, int(wrong > 0), not wrong and n == 0 and counted.n == 0)
