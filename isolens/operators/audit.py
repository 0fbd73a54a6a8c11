"""Audit reports: verdicts of captured statements, their counts, rates, ceiling and exit code."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolens.functions import columns as c
from isolens.operators import proof

# Labels of denominators, the ceiling and the exit codes.
POPULATIONS = ("no_declared_table", "structural_only", "row_level_unattributed", "non_query")
DENOMINATORS = ("all_captured_queries", "real_app_sql_any_table", "real_app_sql_touching_any_declared_table", "row_level_touching_real_app_sql")
CEILING_OF, CEILING = "row_level_touching_real_app_sql", 18 / 762
EXIT = {"A1": 10, "A2": 11, "A3": 12, "A4": 13, "ceiling": 3, "usage": 2}


def judged_events(events: DataFrame) -> DataFrame:
    """Only events that run a statement are judged."""
    return events.filter(F.col("kind").isin("bind", "query"))


def distinct_statements(events: DataFrame) -> DataFrame:
    """sql, params, n: what is executed once however often it was captured."""
    return judged_events(events).groupBy("sql", "params").agg(F.count(F.lit(1)).alias("n"))


def with_population(verdicts: DataFrame, row_level: Sequence[str], structural: Sequence[str]) -> DataFrame:
    """verdicts (sql, verdict, ...) with population, which only the unattributable have."""
    return verdicts.withColumn("population", F.when(F.col("verdict") == "UNATTRIBUTABLE", c.population(F.coalesce("sql", F.lit("")), row_level, structural)))


def counts(verdicts: DataFrame) -> DataFrame:
    """n, safe, leak, unattributable, vacuous_safe and one column for each population; verdicts may carry a weight n."""
    weight = F.col("n") if "n" in verdicts.columns else F.lit(1)
    total = lambda when: F.coalesce(F.sum(F.when(when, weight)), F.lit(0)).cast("long")
    of = [total(F.lit(True)).alias("n"), *[total(F.col("verdict") == v.upper()).alias(v) for v in ("safe", "leak", "unattributable")]]
    return verdicts.agg(*of, total(F.col("vacuous")).alias("vacuous_safe"), *[total(F.col("population") == p).alias(p) for p in POPULATIONS])


def rates(counted: DataFrame) -> DataFrame:
    """label, denominator, unattributable, rate; a denominator of none is left out."""
    x = F.col
    attributed = x("safe") - x("vacuous_safe") + x("leak")
    pairs: list[tuple[Column, Column]] = [
        (x("n"), x("unattributable")),
        (x("n") - x("non_query"), x("unattributable") - x("non_query")),
        (attributed + x("structural_only") + x("row_level_unattributed"), x("structural_only") + x("row_level_unattributed")),
        (attributed + x("row_level_unattributed"), x("row_level_unattributed")),
    ]
    rows = F.array(*[F.struct(F.lit(label).alias("label"), d.alias("denominator"), u.alias("unattributable")) for label, (d, u) in zip(DENOMINATORS, pairs)])
    return counted.select(F.inline(rows)).filter("denominator > 0").withColumn("rate", F.round(F.col("unattributable") / F.col("denominator"), 6))


def ceiling(rates_: DataFrame, label: str = CEILING_OF, most: float = CEILING) -> DataFrame:
    """rate, exceeded: strictly above the ceiling; without the denominator nothing is exceeded."""
    own = rates_.filter(F.col("label") == label)
    return own.agg(F.max("rate").alias("rate"), F.coalesce(F.bool_or(F.col("unattributable") / F.col("denominator") > most), F.lit(False)).alias("exceeded"))


def exit_code(first_failure: Column, exceeded: Column) -> Column:
    out = F
    for gate in ("A1", "A2", "A3", "A4"):
        out = out.when(first_failure == gate, EXIT[gate])
    return out.when(exceeded, EXIT["ceiling"]).otherwise(0)


def queries(verdicts: DataFrame) -> DataFrame:
    """What a report says of each distinct statement; what does not apply is null: sql, verdict, reason, tenant, params, withheld_rows, population, vacuous, n."""
    params = F.when(F.size("params") > 0, c.param_texts(F.col("params")))
    said = {"reason": F.nullif("reason", F.lit("")), "withheld_rows": F.nullif("withheld_rows", F.lit(0)), "vacuous": F.when(F.col("vacuous"), True), "params": params}
    return verdicts.withColumns(said).select("sql", "verdict", "reason", "tenant", "params", "withheld_rows", "population", "vacuous", "n")


def head(verdicts: DataFrame | None, tables: DataFrame, shared_database: bool = False) -> DataFrame:
    """All that a report says besides its queries, in one row; none unless the row filters are proven.

    tables: what was proven of each scoped relation (proof.prove); verdicts: None where no statement was judged.
    """
    listed = lambda when, *cols: F.array_sort(F.collect_list(F.when(when, F.struct(*cols))))
    own = tables.agg(
        F.array_sort(F.collect_list("table")).alias("tables"),  # relations of a policy
        listed(F.col("seeded"), "table", "seed_source").alias("tables_row_level"),
        listed(~F.col("seeded"), "table", F.col("skip_reason").alias("reason")).alias("tables_structural_only"),
    )
    checks = F.struct(*[F.col(f"{a}_passed").alias(a) for a in ("a1", "a2", "a3", "a4")])
    one = proof.aggregate(tables).filter("proven").crossJoin(own)  # one row each
    said = [F.col("proven"), F.lit(1).alias("tier"), F.lit("simulated").alias("proof_source"), "tables", "tables_row_level", "tables_structural_only", checks.alias("checks"), F.lit(shared_database).alias("shared_database")]
    if verdicts is None:
        return one.select(*said)
    by = counts(verdicts)
    counted = F.struct("n", "safe", "leak", "unattributable", F.struct(*POPULATIONS).alias("population"), "vacuous_safe").alias("counts")
    rate = F.round(F.col("unattributable") / F.nullif("n", F.lit(0)), 6).alias("unattributable_rate")
    entry = F.struct("label", "denominator", "unattributable", "rate")
    place = F.array_position(F.array(*[F.lit(d) for d in DENOMINATORS]), F.col("label"))
    rated = rates(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), entry.alias("entry")))), lambda x: x["entry"]).alias("unattributable_rate_by_denominator"))
    return one.crossJoin(by.select(counted, rate)).crossJoin(rated).select(*said, "counts", "unattributable_rate", "unattributable_rate_by_denominator")


def document(head_: DataFrame, queries_: DataFrame | None) -> Iterator[str]:
    """The report as one JSON document in pieces, a statement at a time, so that it is never held as a whole."""
    first = head_.select(F.to_json(F.struct("*"))).first()
    if first is None:
        return
    yield first[0][:-1]
    if queries_ is not None:
        yield ', "queries": ['
        for i, row in enumerate(queries_.select(F.to_json(F.struct("*"))).toLocalIterator()):
            yield (",\n" if i else "\n") + row[0]
        yield "]"
    yield "}\n"


def text(head_: DataFrame, queries_: DataFrame | None) -> Iterator[str]:
    """The same for people, line by line."""
    found = head_.first()
    if found is None:
        return
    said = found.asDict(recursive=True)
    yield from (f"{k}: {said[k]}\n" for k in ("proven", "tier", "proof_source"))
    yield f"tables: {', '.join(said['tables'])}\n"
    yield from (f"tables_row_level: {t['table']} (seed_source={t['seed_source']})\n" for t in said["tables_row_level"])
    yield from (f"tables_structural_only: {t['table']} ({t['reason']})\n" for t in said["tables_structural_only"])
    pairs = lambda d: " ".join(f"{k}={v}" for k, v in d.items())
    yield f"checks: {pairs(said['checks'])}\nshared_database: {said['shared_database']}\n"
    if "counts" not in said:
        return
    population = said["counts"].pop("population")
    yield f"counts: {pairs(said['counts'])}\ncounts.population: {pairs(population)}\n"
    if said["unattributable_rate"] is not None:
        yield f"unattributable_rate: {said['unattributable_rate']:.4f}\n"
    for e in said["unattributable_rate_by_denominator"]:
        yield f"unattributable_rate_by_denominator: {e['label']} denominator={e['denominator']} unattributable={e['unattributable']} rate={e['rate']:.4f}\n"
    if queries_ is not None:
        yield from (f"query: {pairs(r.asDict())}\n" for r in queries_.toLocalIterator())
