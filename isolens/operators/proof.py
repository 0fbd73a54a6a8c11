"""Does the row filter withhold the right rows?  Four controls, canary rows, and what they prove together.

A1  a tenant sees fewer rows than there are;
A2  every scoped relation has an enabled filter with a policy;
A3  the role cannot pass by the filter (superuser, bypass, or owner of a relation without force);
A4  a tenant sees exactly the rows that an explicit predicate selects.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isolens.functions import statements as st
from isolens.operators.rowfilter import VARIABLE, Legs, tenant_matches

CANARY_A, CANARY_B = st.CANARIES
# How row keys are written.
KEY_SEPARATOR, KEY_NULL = "\x1c", "\x1dNULL\x1d"
#: Tenant columns of these types take a canary's text.
CANARY_TYPES = (T.StringType,)
#: Relations that are sampled at the same time.
SEEDED_AT_ONCE = 8
#: Who owns a relation of which a policy names no owner.
OWNER = "owner"


@dataclass(frozen=True)
class Filter:
    """A relation's row filter: the column it compares (None: no policy; True: every row passes) with a session setting."""

    column: str | bool | None
    enabled: bool = True
    forced: bool = True
    setting: str = "row_tenant"
    registered: bool = True


@dataclass(frozen=True)
class Role:
    name: str = "restricted"
    superuser: bool = False
    bypass: bool = False


def passes_by(flt: Filter, role: Role, owner: str) -> bool:
    """No filter applies to the role: a superuser, one that bypasses filters, or the owner of a relation without force."""
    return role.superuser or role.bypass or (role.name == owner and not flt.forced)


def shown(df: DataFrame, flt: Filter, role: Role, owner: str, tenant: str) -> Column:
    """Whether the role sees a row of the relation while the setting row_tenant holds the tenant."""
    if passes_by(flt, role, owner) or not flt.enabled or not flt.registered or flt.column is True:
        return F.lit(True)
    if flt.column is None:
        return F.lit(False)
    return tenant_matches(df, flt.column, F.lit(tenant if flt.setting == "row_tenant" else None).cast("string"))


def visible(df: DataFrame, flt: Filter, role: Role, owner: str, tenant: str) -> DataFrame:
    """What the role sees of the relation while the setting row_tenant holds the tenant."""
    return df.filter(shown(df, flt, role, owner, tenant))


def row_key(df: DataFrame, primary_key: Sequence[str] = ()) -> Column:
    columns = list(primary_key) or df.columns
    if not columns:
        raise ValueError("a relation without columns has no row key")
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(df[c].cast("string"), F.lit(KEY_NULL)) for c in columns])


def a1(df: DataFrame, restricted: DataFrame) -> DataFrame:
    """n_all, n_visible, a1."""
    n_all, n_visible = df.agg(F.count(F.lit(1)).alias("n_all")), restricted.agg(F.count(F.lit(1)).alias("n_visible"))
    return n_all.crossJoin(n_visible).select("n_all", "n_visible", (F.col("n_visible") < F.col("n_all")).alias("a1"))  # one row each


def a4(df: DataFrame, restricted: DataFrame, tenant_column: str, tenant: str, primary_key: Sequence[str] = ()) -> DataFrame:
    """n_missing, n_surplus, a4: row keys of the explicit predicate against those that are visible."""
    explicit = df.filter(df[tenant_column].cast("string") == tenant).select(row_key(df, primary_key).alias("k"), F.lit(1).alias("e"))
    shown = restricted.select(row_key(restricted, primary_key).alias("k"), F.lit(-1).alias("e"))
    sides = explicit.unionByName(shown).groupBy("k").agg(F.max("e").alias("hi"), F.min("e").alias("lo"))
    total = sides.agg(F.count(F.when(F.col("lo") == 1, 1)).alias("n_missing"), F.count(F.when(F.col("hi") == -1, 1)).alias("n_surplus"))
    return total.select("n_missing", "n_surplus", ((F.col("n_missing") == 0) & (F.col("n_surplus") == 0)).alias("a4"))


def uncovered(relations: DataFrame, policies: DataFrame) -> DataFrame:
    """A2: scoped relations (name, class) without an enabled filter and a policy (relation, enabled, policies)."""
    p = policies.select(F.col("relation").alias("name"), "enabled", "policies")
    covered = F.coalesce(F.col("enabled"), F.lit(False)) & (F.coalesce(F.col("policies"), F.lit(0)) > 0)
    return relations.filter(F.col("class") == "scoped").join(p, "name", "left").filter(~covered).select("name")


def bypassing(roles: DataFrame, owners: DataFrame) -> DataFrame:
    """A3: role and reason, from roles (role, superuser, bypass) and owners (relation, owner, forced)."""
    unforced = owners.filter(~F.col("forced")).groupBy(F.col("owner").alias("role")).agg(F.min("relation").alias("relation"))
    reason = F.when(F.col("superuser"), "superuser").when(F.col("bypass"), "bypasses row filters").when(F.col("relation").isNotNull(), F.concat(F.lit("owns "), F.col("relation"), F.lit(" without force")))
    return roles.join(unforced, "role", "left").select("role", reason.alias("reason")).filter("reason is not null")


def check(df: DataFrame, flt: Filter, role: Role, owner: str, tenant_column: str, tenant: str, primary_key: Sequence[str] = ()) -> DataFrame:
    """a1, a2, a3, a4 of one relation, one row.

    Two scans: one of the tenant column, which counts, and one of the rows that either side has, whose condition is pushed down; row keys
    are compared in one aggregation of it.
    """
    seen, own = F.coalesce(shown(df, flt, role, owner, tenant), F.lit(False)), F.coalesce(df[tenant_column].cast("string") == tenant, F.lit(False))
    covered = flt.registered and flt.enabled and flt.column is not None
    first = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(seen).alias("n_visible")).select((F.col("n_visible") < F.col("n")).alias("a1"))
    either = df.filter(shown(df, flt, role, owner, tenant) | (df[tenant_column].cast("string") == tenant))
    by = either.select(row_key(df, primary_key).alias("k"), own.alias("own"), seen.alias("seen")).groupBy("k").agg(F.bool_or("own").alias("own"), F.bool_or("seen").alias("seen"))
    last = by.agg((F.count_if(F.col("own") != F.col("seen")) == 0).alias("a4"))
    return first.crossJoin(last).select("a1", F.lit(covered).alias("a2"), F.lit(not passes_by(flt, role, owner)).alias("a3"), "a4")  # one row each


#: Ways to break a filter: name, control that must notice, what is changed.
MUTANTS = (
    ("M1", "a2", {"column": None}, {}),
    ("M2", "a1", {"column": True}, {}),
    ("M3", "a4", {"column": "other"}, {}),
    ("M4", "a3", {"forced": False}, {"name": "owner"}),
    ("M5", "a3", {}, {"bypass": True}),
    ("M6", "a2", {"registered": False}, {}),
    ("M7", "a4", {"setting": "another"}, {}),
    ("M8", "a1", {"column": True}, {}),
)


def mutants(df: DataFrame, tenant_column: str, other_column: str, tenant: str, primary_key: Sequence[str] = ()) -> DataFrame:
    """mutant, gate, a1 to a4 and caught, for every mutant of the relation's filter; M8 sees the one tenant's rows only."""
    right, role = Filter(tenant_column), Role()
    parts = []
    for name, gate, change, role_change in MUTANTS:
        change = {k: other_column if v == "other" else v for k, v in change.items()}
        own = df.filter(df[tenant_column].cast("string") == tenant) if name == "M8" else df
        checked = check(own, replace(right, **change), replace(role, **role_change), "owner", tenant_column, tenant, primary_key)
        parts.append(checked.select(F.lit(name).alias("mutant"), F.lit(gate).alias("gate"), "a1", "a2", "a3", "a4", (~F.col(gate)).alias("caught")))
    return reduce(DataFrame.unionByName, parts)


def aggregate(tables: DataFrame) -> DataFrame:
    """checked and passed for each control over seeded tables (seeded, a1 ... a4), the first failure, and proven."""
    of = lambda a: [F.coalesce(F.bool_or(F.when(F.col("seeded"), F.col(a).isNotNull())), F.lit(False)).alias(f"{a}_checked"), F.coalesce(F.bool_and(F.when(F.col("seeded"), F.col(a))), F.lit(False)).alias(f"{a}_passed")]
    total = tables.agg(*[c for a in ("a1", "a2", "a3", "a4") for c in of(a)])
    fails = F.coalesce(*[F.when(~(F.col(f"{a}_checked") & F.col(f"{a}_passed")), a.upper()) for a in ("a1", "a2", "a3", "a4")])
    return total.withColumn("first_failure", fails).withColumn("proven", F.col("first_failure").isNull())


def first_cause(tables: DataFrame) -> DataFrame:
    """The table and the control to name for a failed proof: of seeded tables, the first by name that fails A1, then A4."""
    failed = F.when(~F.col("a1"), "A1").when(~F.col("a4"), "A4")
    own = tables.filter("seeded").select(failed.alias("gate"), "table").filter("gate is not null")
    return own.agg(F.min(F.struct("gate", "table")).alias("x")).select("x.gate", "x.table").filter("gate is not null")


def unconfirmed(legs: Legs) -> list[str]:
    """Filtered relations whose restricted view does not compare the tenant column with the session variable."""
    out = []
    for name, column in legs.filters.items():
        legs.restricted.sql(f"SET VARIABLE {VARIABLE} = 'confirmed-by-plan'")
        plan = legs.restricted.table(name)._jdf.queryExecution().optimizedPlan().toString()
        if not ("confirmed-by-plan" in plan and column in plan) and "LocalRelation <empty>" not in plan:
            out.append(name)
    return out


# Canary rows ----------------------------------------------------------------------------------------------------------


def sample_literal(kind: T.DataType, i: int) -> Column | None:
    """A value of the type that differs by i; None where none can be made up."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.lit(1000 + i).cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return F.lit(float(1000 + i)).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(i % 2 == 1)
    if isinstance(kind, T.StringType):
        return F.lit(f"sample-{i}")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return (F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(secs=F.lit(i * 1e-6))).cast(kind)
    if isinstance(kind, T.DateType):
        return F.date_add(F.lit("2000-01-01").cast("date"), i)
    if isinstance(kind, T.BinaryType):
        return F.lit(bytes([i % 256]))
    if isinstance(kind, T.DayTimeIntervalType):
        return F.make_dt_interval(secs=F.lit(1 + i))
    if isinstance(kind, T.ArrayType):
        inner = sample_literal(kind.elementType, i)
        return F.array(inner) if inner is not None else F.array().cast(kind)
    return None


def fresh_columns(tenant_column: str, unique_keys: Sequence[Sequence[str]]) -> set[str]:
    """Columns of unique keys that the canary tenant does not already tell apart."""
    return {c for key in unique_keys if tenant_column not in key for c in key}


@dataclass(frozen=True)
class Seeded:
    """The canary rows of a relation, and whether they were borrowed ("sampled") or given ("fixture")."""

    rows: DataFrame | None
    source: str | None = None
    skipped: str | None = None


def canaries(df: DataFrame, tenant_column: str, primary_key: Sequence[str] = (), unique_keys: Sequence[Sequence[str]] = (), fixture: Sequence[dict[str, str]] = ()) -> Seeded:
    """Two rows of different canary tenants for the relation.

    They borrow the values of the first two rows by row key, except that the tenant column holds a canary and columns of
    unique keys without it hold made-up values.  With fewer than two rows a fixture of exactly two is used.
    """
    if not isinstance(df.schema[tenant_column].dataType, CANARY_TYPES):
        return Seeded(None, skipped=f"tenant column of type {df.schema[tenant_column].dataType.simpleString()} takes no canary")
    fresh = fresh_columns(tenant_column, [*unique_keys, *([primary_key] if primary_key else [])])
    impossible = [c for c in sorted(fresh) if sample_literal(df.schema[c].dataType, 0) is None]
    if impossible:
        return Seeded(None, skipped=f"no sample value for {', '.join(impossible)}")
    first = df.withColumn("__key", row_key(df, primary_key)).orderBy("__key").limit(2).collect()
    if len(first) == 2:
        borrowed = df.sparkSession.createDataFrame([r[:-1] for r in first], df.schema).coalesce(1)
        number = F.monotonically_increasing_id()
        rows = borrowed.withColumn("__n", number)
        for i, f in enumerate(df.schema.fields):
            pair = (F.lit(CANARY_A), F.lit(CANARY_B)) if f.name == tenant_column else (sample_literal(f.dataType, 2 * i), sample_literal(f.dataType, 2 * i + 1)) if f.name in fresh else None
            if pair:
                rows = rows.withColumn(f.name, F.when(F.col("__n") == 0, pair[0]).otherwise(pair[1]))
        return Seeded(rows.select(df.columns), "sampled")
    if len(fixture) != 2:
        return Seeded(None, skipped=f"{len(first)} rows and no fixture")
    lacking = [f.name for f in df.schema.fields if not f.nullable and any(f.name not in row for row in fixture)]
    if lacking:
        return Seeded(None, skipped=f"the fixture lacks {', '.join(lacking)}")
    both = []
    for canary, row in zip((CANARY_A, CANARY_B), fixture):
        values = [F.lit(canary) if f.name == tenant_column else F.expr(row[f.name]) if f.name in row else F.lit(None) for f in df.schema.fields]
        both.append(df.sparkSession.range(1).select(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, df.schema.fields)]))
    return Seeded(both[0].unionByName(both[1]), "fixture")


def prove(spark: SparkSession, relations: dict[str, DataFrame], tenant_columns: dict[str, str], primary_keys: dict[str, list[str]], filters: dict[str, Filter] | None = None, role: Role = Role(), owners: dict[str, str] | None = None, unique_keys: dict[str, list[list[str]]] | None = None, fixtures: dict[str, list[dict[str, str]]] | None = None) -> DataFrame:
    """table, seeded, seed_source, skip_reason, a1 to a4 for every scoped relation; the controls run over its rows and canaries."""
    def seed(name: str) -> Seeded:
        return canaries(relations[name], tenant_columns[name], primary_keys.get(name, []), (unique_keys or {}).get(name, []), (fixtures or {}).get(name, []))

    with ThreadPoolExecutor(SEEDED_AT_ONCE) as pool:  # each is a job that gives two rows
        seeds = dict(zip(tenant_columns, pool.map(seed, tenant_columns)))
    parts = []
    for name, column in tenant_columns.items():
        df, key, seeded = relations[name], primary_keys.get(name, []), seeds[name]
        flt = (filters or {}).get(name, Filter(column))
        owner = (owners or {}).get(name, OWNER)
        head = [F.lit(name).alias("table"), F.lit(seeded.rows is not None).alias("seeded"), F.lit(seeded.source).cast("string").alias("seed_source"), F.lit(seeded.skipped).cast("string").alias("skip_reason")]
        if seeded.rows is None:
            covered = flt.enabled and flt.registered and flt.column is not None
            none = F.lit(None).cast("boolean")
            parts.append(spark.range(1).select(*head, none.alias("a1"), F.lit(covered).alias("a2"), F.lit(not passes_by(flt, role, owner)).alias("a3"), none.alias("a4")))
        else:
            parts.append(check(df.unionByName(seeded.rows), flt, role, owner, column, CANARY_A, key).select(*head, "a1", "a2", "a3", "a4"))
    return reduce(DataFrame.unionByName, parts)


def prove_policy(spark: SparkSession, relations: dict[str, DataFrame], scoped: Sequence[Row], role: Role = Role()) -> DataFrame:
    """prove() by the fields of a policy's scoped relations.

    A relation of which the policy does not say otherwise has an enabled and forced filter, the owner OWNER, no unique keys besides its
    primary key, and no fixture.
    """
    return prove(
        spark, relations, {r.name: r.tenant_column for r in scoped}, {r.name: r.primary_key or [] for r in scoped},
        {r.name: Filter(r.tenant_column, enabled=r.enabled is not False, forced=r.forced is not False) for r in scoped}, role,
        {r.name: r.owner or OWNER for r in scoped}, {r.name: r.unique_keys or [] for r in scoped}, {r.name: r.fixture or [] for r in scoped},
    )


def accounted(proven: DataFrame, scoped: DataFrame) -> DataFrame:
    """n_scoped, n_seeded, n_skipped, accounted: each scoped relation (name) is either seeded or skipped with a reason, once."""
    seeded, skipped = F.col("seeded") & F.col("skip_reason").isNull(), ~F.col("seeded") & F.col("skip_reason").isNotNull()
    ours = proven.select(F.col("table").alias("name"), F.lit(0).alias("wanted"), F.lit(1).alias("listed"), F.coalesce(seeded, F.lit(False)).alias("seeded"), F.coalesce(skipped, F.lit(False)).alias("skipped"))
    both = ours.unionByName(scoped.select("name", F.lit(1).alias("wanted"), F.lit(0).alias("listed"), F.lit(False).alias("seeded"), F.lit(False).alias("skipped")))
    by = both.groupBy("name").agg(F.sum("wanted").alias("wanted"), F.sum("listed").alias("listed"), F.count_if("seeded").alias("seeded"), F.count_if("skipped").alias("skipped"))
    total = by.agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("n_scoped"), F.coalesce(F.sum("seeded"), F.lit(0)).alias("n_seeded"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("n_skipped"),
        F.coalesce(F.bool_and((F.col("wanted") == 1) & (F.col("listed") == 1) & (F.col("seeded") + F.col("skipped") == 1)), F.lit(True)).alias("holds"))
    return total.select("n_scoped", "n_seeded", "n_skipped", F.col("holds").alias("accounted"))
