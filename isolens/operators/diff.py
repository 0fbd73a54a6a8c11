"""Differences of multisets of rows, and the verdicts that follow from them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, IllegalArgumentException, NumberFormatException, ParseException, SparkRuntimeException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isolens.functions import statements as st
from isolens.operators import writes
from isolens.operators.rowfilter import Legs

# How a row is written as text.
SEPARATOR, NULL = "\x1f", "\x00NULL"

#: Statements whose two legs are compared in one Spark job, and such jobs at a time.
AT_ONCE, JOBS = 8, 4

#: What a statement itself can bring about, when it is analysed and when it is run; a lost executor or a full disk is none of these.
REFUSED = (AnalysisException, ParseException, IllegalArgumentException)
FAILED = (*REFUSED, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, SparkRuntimeException)

RESULT = "id string, verdict string, reason string, tenant string, withheld_rows long, vacuous boolean"


def rendered(df: DataFrame) -> DataFrame:
    """One string column: each row as text, so that any two results can be compared."""
    parts = [F.coalesce(df[f"`{c}`"].cast("string") if df.columns.count(c) == 1 else F.lit(None), F.lit(NULL)) for c in df.columns]
    if len(set(df.columns)) < len(df.columns):
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        parts = [F.coalesce(df[c].cast("string"), F.lit(NULL)) for c in df.columns]
    return df.select(F.concat_ws(SEPARATOR, *parts).alias("row"))


def shortfall(have: DataFrame, want: DataFrame) -> DataFrame:
    """The rows of have that want lacks, as often as it lacks them."""
    return rendered(have).exceptAll(rendered(want))


def counted(unrestricted: DataFrame, restricted: DataFrame) -> DataFrame:
    """row, u, r: how often each row occurs in both results; one shuffle of partial counts."""
    both = rendered(unrestricted).withColumn("leg", F.lit(1)).unionByName(rendered(restricted).withColumn("leg", F.lit(0)))
    return both.groupBy("row").agg(F.sum("leg").alias("u"), F.sum(1 - F.col("leg")).alias("r"))


def verdict_columns(u: Column, r: Column, short: Column) -> list[Column]:
    """verdict, withheld_rows and vacuous from the two row counts and the shortfall."""
    leak = (short > 0) | (u != r)
    withheld = F.when(~leak, F.lit(0)).when(short > 0, short).otherwise(F.abs(u - r))
    return [F.when(leak, st.LEAK).otherwise(st.SAFE).alias("verdict"), withheld.cast("long").alias("withheld_rows"), (~leak & (u == 0)).alias("vacuous")]


def compare(unrestricted: DataFrame, restricted: DataFrame) -> DataFrame:
    """One row: n_unrestricted, n_restricted, verdict, withheld_rows, vacuous."""
    c = counted(unrestricted, restricted)
    total = c.agg(
        F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("n_unrestricted"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("n_restricted"),
        F.coalesce(F.sum(F.greatest(F.col("u") - F.col("r"), F.lit(0))), F.lit(0)).cast("long").alias("short"),
    )
    return total.select("n_unrestricted", "n_restricted", *verdict_columns(F.col("n_unrestricted"), F.col("n_restricted"), F.col("short")))


class Captured(NamedTuple):
    """A statement to be judged; sql None: it could not be resolved."""

    id: str
    sql: str | None
    params: tuple[st.Param, ...] = ()


def as_captured(rows: Iterable) -> Iterator[Captured]:
    """Distinct statements (id, sql, params) of captured events as statements to be judged, one after the other."""
    bound = lambda p: st.Param.of(None if p["null"] else p["value"] or "", bool(p["null"] or p["value_known"]))
    return (Captured(r.id, r.sql, tuple(bound(p) for p in r.params or [])) for r in rows)


class Verdict(NamedTuple):
    id: str
    verdict: str
    reason: str = ""
    tenant: str | None = None
    withheld_rows: int = 0
    vacuous: bool = False


def _message(e: Exception) -> str:
    return str(e).strip().split("\n")[0][:200]


def diff_reads(legs: Legs, statements: Iterable[Captured], relations: list[st.Scoped], keys: dict[str, list[list[str]]] | None = None) -> Iterator[Verdict]:
    """Verdicts on captured statements, as they come; keys: the unique keys of relations, for inserts.

    Writes are judged by what they would change (see writes), commands are refused.

    Each distinct statement is run without and with the row filters for the tenant it claims.  AT_ONCE of them
    make one job: their rows are tagged, united and counted by (statement, row), so the comparison is one
    distributed aggregation and the driver receives a row for each statement.  If such a job fails, its statements
    are run one by one, and those that fail are unattributable.  While up to JOBS of them are planned and run, the next statements are
    analysed, so the driver holds the plans of (JOBS + 1) * AT_ONCE statements, however many there are.
    """
    runs, jobs = [], deque()
    with ThreadPoolExecutor(JOBS) as pool:
        for s in statements:
            found = _claimed(legs, s, relations, keys or {})
            if isinstance(found, Verdict):
                yield found
                continue
            runs.append(found)
            if len(runs) == AT_ONCE:
                jobs.append(pool.submit(_judged, runs))
                runs = []
                if len(jobs) == JOBS:
                    yield from jobs.popleft().result()
        if runs:
            jobs.append(pool.submit(_judged, runs))
        for job in jobs:
            yield from job.result()


def _claimed(legs: Legs, s: Captured, relations: list[st.Scoped], keys: dict[str, list[list[str]]]) -> Verdict | tuple[Captured, str | None, tuple[DataFrame, DataFrame]]:
    """The verdict, where no query has to be run for it; else the statement, its tenant and both legs, analysed."""
    if s.sql is None:
        return Verdict(s.id, "UNATTRIBUTABLE", "unresolved statement")
    claim = st.attribute(s.sql, relations, s.params)
    if claim.kind == st.UNATTRIBUTABLE:
        return Verdict(s.id, "UNATTRIBUTABLE", claim.reason or "")
    try:
        if st.is_write(s.sql):
            return _judged_write(legs, s, claim.value, relations, keys)
        return s, claim.value, legs.run(s.sql, [p.value for p in s.params], claim.value)
    except REFUSED as e:
        return Verdict(s.id, "UNATTRIBUTABLE", f"dialect: {_message(e)}", claim.value)


def _judged_write(legs: Legs, s: Captured, tenant: str | None, relations: list[st.Scoped], keys: dict[str, list[list[str]]]) -> Verdict:
    try:
        found = writes.judge(legs, s.sql, [p.value for p in s.params], tenant, {r.name.lower(): r.tenant_column for r in relations}, keys)
    except writes.NotReadable as e:
        return Verdict(s.id, "UNATTRIBUTABLE", f"dialect: {e}", tenant)
    except FAILED as e:
        return Verdict(s.id, "UNATTRIBUTABLE", f"dialect: {_message(e)}", tenant)
    if found.n_hidden:
        return Verdict(s.id, "UNATTRIBUTABLE", "a unique key is taken by a row that the tenant does not see", tenant)
    return Verdict(s.id, found.verdict, "" if found.verdict == st.SAFE else "rows written beyond the tenant's", tenant, found.withheld_rows, found.vacuous)


def _judged(runs: list) -> list[Verdict]:
    tagged = [counted_leg(df, s.id, leg) for s, _, both in runs for leg, df in zip((1, 0), both)]
    try:
        total = reduce(DataFrame.unionAll, tagged).groupBy("id", "row").agg(F.sum("leg").alias("u"), F.sum(1 - F.col("leg")).alias("r"))
        by = total.groupBy("id").agg(F.sum("u").alias("u"), F.sum("r").alias("r"), F.sum(F.greatest(F.col("u") - F.col("r"), F.lit(0))).alias("short"))
        found = {r.id: r for r in by.select("id", *verdict_columns(F.col("u"), F.col("r"), F.col("short"))).collect()}
    except FAILED as e:
        if len(runs) > 1:
            return [v for one in runs for v in _judged([one])]
        return [Verdict(runs[0][0].id, "UNATTRIBUTABLE", f"execution: {_message(e)}", runs[0][1])]
    none = Verdict("", st.SAFE, vacuous=True)
    return [Verdict(s.id, (r := found.get(s.id, none)).verdict, "" if r.verdict == st.SAFE else "rows beyond the tenant's", tenant, r.withheld_rows, r.vacuous) for s, tenant, _ in runs]


def counted_leg(df: DataFrame, id_: str, leg: int) -> DataFrame:
    return rendered(df).select(F.lit(id_).alias("id"), "row", F.lit(leg).alias("leg"))


def verdicts_table(spark: SparkSession, verdicts: Iterable[Verdict]) -> DataFrame:
    return spark.createDataFrame(list(verdicts), RESULT)
