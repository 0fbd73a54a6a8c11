"""Column expressions and Arrow UDFs over statements, events and relations."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isolens.functions import statements as st

PARAM = "struct<null:boolean,format:string,oid:bigint,value_known:boolean,value:string,value_base64:string,unknown_reason:string>"


# Relations ------------------------------------------------------------------------------------------------------------


def candidates(columns: Column) -> Column:
    """The columns of a relation that may name its tenant, sorted."""
    return F.array_sort(F.filter(columns, lambda c: c.isin(*st.CANDIDATE_COLUMNS)))


def class_of(kind: Column, found: Column) -> Column:
    """scoped, unscoped or unclassifiable, from the relation's kind and its candidate columns."""
    return F.when(kind.isin("VIEW", "MATERIALIZED VIEW", "FOREIGN TABLE") | (F.size(found) > 1), "unclassifiable").when(F.size(found) == 1, "scoped").otherwise("unscoped")


def class_reason(kind: Column, found: Column) -> Column:
    views = kind.isin("VIEW", "MATERIALIZED VIEW", "FOREIGN TABLE")
    return F.when(views, F.concat(F.lit("rows of a "), F.lower(kind), F.lit(" come from elsewhere"))).when(F.size(found) > 1, F.concat(F.lit("several candidates: "), F.array_join(found, ", "))).when(F.size(found) == 0, "no candidate column").otherwise("")


def base_type(declared: Column) -> Column:
    """A declared type in lower case, without length and without array brackets."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(declared), r"\[\s*\]", ""), r"\([^)]*\)", ""))


def canary_text(declared: Column, which: int) -> Column:
    """How canary tenant 0 or 1 is written in a tenant column of the declared type; null where it cannot be told apart."""
    array, base = declared.rlike(r"\[\s*\]"), base_type(declared)
    return F.when(array, None).when(base == "uuid", st.CANARY_UUIDS[which]).when(base.isin(*st.TEXT_TYPES), st.CANARIES[which])


def sample_text(declared: Column, i: Column, labels: Column | None = None) -> Column:
    """A value of the declared type, as text, that differs by i; null where none can be made up.

    labels: those of the type where it is an enumeration; its values repeat after as many.  An array holds one sample, or
    nothing if its elements have none.
    """
    array, base, at = declared.rlike(r"\[\s*\]"), base_type(declared), i.cast("long")
    text, clock = at.cast("string"), F.pmod(at, F.lit(86_400))
    one = (
        F.when(base.isin("smallint", "integer", "bigint"), (at + 1000).cast("string"))
        .when(base.isin("real", "double precision", "numeric", "decimal"), F.concat((at + 1000).cast("string"), F.lit(".0")))
        .when(base == "boolean", (F.pmod(at, F.lit(2)) == 1).cast("string"))
        .when(base.isin(*st.TEXT_TYPES, "citext"), F.concat(F.lit("sample-"), text))
        .when(base == "uuid", F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(text, 12, "0")))
        .when(base.isin("timestamp with time zone", "timestamp without time zone"), F.date_format(F.timestamp_micros(F.unix_micros(F.lit("2000-01-01 00:00:00 UTC").cast("timestamp")) + at), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(base == "date", F.date_add(F.lit("2000-01-01").cast("date"), at.cast("int")).cast("string"))
        .when(base.isin("time with time zone", "time without time zone"), F.format_string("%02d:%02d:%02d", F.floor(clock / 3600), F.floor(F.pmod(clock, F.lit(3600)) / 60), F.pmod(clock, F.lit(60))))
        .when(base.isin("json", "jsonb"), F.concat(F.lit('{"sample":'), text, F.lit("}")))
        .when(base == "bytea", F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.pmod(at, F.lit(256))), 2, "0"))))
        .when(base.isin("inet", "cidr"), F.concat(F.lit("127.0.0."), (F.pmod(at, F.lit(254)) + 1).cast("string")))
        .when(base == "interval", F.concat((at + 1).cast("string"), F.lit(" seconds")))
    )
    escaped = F.replace(F.replace(one, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    held = F.when(base != "", F.coalesce(F.concat(F.lit('{"'), escaped, F.lit('"}')), F.lit("{}")))
    own = one if labels is None else F.coalesce(one, F.get(labels, F.pmod(at, F.size(labels)).cast("int")))
    return F.when(array, held).otherwise(own)


def quoted(name: Column) -> Column:
    """An identifier between backticks."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def duplicate_key(detail: Column) -> Column:
    """map of column to value, from the detail of a unique violation; null if it is none."""
    lists = [F.split(F.regexp_extract(detail, st.DUPLICATE_PATTERN, i), ", ") for i in (1, 2)]
    fits = detail.rlike(st.DUPLICATE_PATTERN) & (F.size(lists[0]) == F.size(lists[1]))
    return F.when(fits, F.map_from_arrays(*lists))


@F.pandas_udf(T.ArrayType(T.StringType()))
def array_literal(text: pd.Series) -> pd.Series:
    """The elements of an array literal of the server, with its quotes and escapes; null if it is none."""
    return text.map(lambda s: st.array_elements(s) if s is not None else None)


# Statements, built-in functions only ---------------------------------------------------------------------------------


def mentioned(sql: Column) -> Column:
    """Names and aliases of tables, lower-cased, as an array without repetition."""
    names = F.transform(F.regexp_extract_all(sql, F.lit(st.TABLE_PATTERN), F.lit(1)), F.lower)
    aliases = F.transform(F.regexp_extract_all(sql, F.lit(st.TABLE_PATTERN), F.lit(2)), F.lower)
    stops = F.array(*[F.lit(w) for w in ("", *st.ALIAS_STOP_WORDS)])
    return F.array_union(names, F.array_except(aliases, stops))


def mentioned_names(sql: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(sql, F.lit(st.TABLE_PATTERN), F.lit(1)), F.lower))


def compared_with(sql: Column, column: str) -> Column:
    """The right sides of comparisons of the tenant column."""
    return F.regexp_extract_all(sql, F.lit(st.COMPARED_PATTERN.format(column=column)), F.lit(1))


def param_position(expression: Column) -> Column:
    text = F.trim(expression)
    chain, call = F.regexp_extract(text, st.CAST_CHAIN_PATTERN, 1), F.regexp_extract(text, st.CAST_CALL_PATTERN, 1)
    return F.when(chain != "", chain.cast("int")).when(call != "", call.cast("int"))


def without_leading_comments(sql: Column) -> Column:
    return F.regexp_replace(sql, r"^(?:\s+|--[^\n]*(?:\n|$))*", "")


def non_query(sql: Column) -> Column:
    """The statement begins with a word of session control."""
    return without_leading_comments(sql).rlike(rf"(?i)^(?:{'|'.join(st.NON_QUERY_WORDS)})(?:[ \t\r\n(]|$)")


def unknown_params(params: Column) -> Column:
    """Which parameters could not be decoded: $1, $3."""
    at = F.transform(params, lambda p, i: F.when(~p["null"] & ~p["value_known"], F.concat(F.lit("$"), (i + 1).cast("string"))))
    return F.filter(at, lambda x: x.isNotNull())


def param_texts(params: Column) -> Column:
    return F.transform(params, lambda p: F.when(p["null"], "NULL").when(p["value_known"], p["value"]).otherwise("<undecoded>"))


def population(sql: Column, row_level: Sequence[str], structural: Sequence[str]) -> Column:
    """Why an unattributable statement is so, most telling first."""
    names = mentioned(sql)
    some = lambda tables: F.arrays_overlap(names, F.array(*[F.lit(t.lower()) for t in tables])) if tables else F.lit(False)
    return F.when(non_query(sql), "non_query").when(some(row_level), "row_level_unattributed").when(some(structural), "structural_only").otherwise("no_declared_table")


# Statements, nested text: Arrow UDFs ------------------------------------------------------------------------------------


def attribution(relations: Sequence[st.Scoped]):
    """A UDF (sql, params) -> struct(kind, value, reason); the relations are a policy, small by nature."""
    relations = tuple(relations)

    @F.pandas_udf("kind string, value string, reason string")
    def attributed(sql: pd.Series, params: pd.Series) -> pd.DataFrame:
        out = []
        for text, bound in zip(sql, params):
            own = [st.Param.of(None if p["null"] else (p["value"] or ""), bool(p["null"] or p["value_known"])) for p in (bound if bound is not None else [])]
            out.append(st.attribute(text, relations, own) if text is not None else st.Attribution(st.UNATTRIBUTABLE, reason="unresolved statement"))
        return pd.DataFrame(out, columns=["kind", "value", "reason"])

    return attributed


@F.pandas_udf(T.BooleanType())
def is_write(sql: pd.Series) -> pd.Series:
    return sql.map(lambda s: s is not None and st.is_write(s)).astype(bool)


@F.pandas_udf(T.ArrayType(T.StringType()))
def cte_names(sql: pd.Series) -> pd.Series:
    return sql.map(lambda s: st.cte_names(s) if s is not None else [])


def tenant_check(classes: dict[str, tuple[str, str | None]]):
    """A UDF (sql, param texts, tenant) -> struct(verdict, reason)."""

    @F.pandas_udf("verdict string, reason string")
    def checked(sql: pd.Series, params: pd.Series, tenant: pd.Series) -> pd.DataFrame:
        rows = [st.check_tenant(s, classes, [st.Param(str(p)) for p in (ps if ps is not None else [])], t) for s, ps, t in zip(sql, params, tenant)]
        return pd.DataFrame(rows, columns=["verdict", "reason"])

    return checked
