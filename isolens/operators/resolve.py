"""From protocol events to statements: which SQL and which types a bind had.

Events carry a capture sequence number; within a connection it orders everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isolens.functions import wire
from isolens.functions.columns import PARAM

#: Event kinds of message types; those of portals and all others are of no interest.
KINDS = {"P": "parse", "B": "bind", "CS": "close", "DS": "describe", "Q": "query", "t": "t", "T": "T"}
#: Kinds as they are written; a describe is not.
WRITTEN = {"parse": "parse", "bind": "bind", "close": "close", "query": "query", "t": "param_description", "T": "row_description"}


def protocol_events(found: DataFrame) -> DataFrame:
    """Messages of both directions as events (conn, seq, kind, stmt, portal, sql, formats, values, oids); seq is their order on the connection."""
    kind = _mapped("type", KINDS)
    order = Window.partitionBy("conn").orderBy("at", "dir", "number")
    own = found.withColumn("kind", kind).filter("kind is not null").withColumn("seq", F.row_number().over(order).cast("long"))
    return own.select("conn", "seq", "kind", F.coalesce("stmt", F.lit("")).alias("stmt"), "portal", "sql", "formats", "values", "oids")


def _mapped(column: str, of: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in of.items() for x in pair]), F.col(column))


def resolve_binds(events: DataFrame) -> DataFrame:
    """Binds (conn, seq, stmt) with sql and resolved: the latest parse of the name on the connection, unless closed since."""
    before = Window.partitionBy("conn", "stmt").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.col("kind").isin("parse", "close"), F.struct("kind", "sql"))
    open_ = events.withColumn("open", F.last(named, ignorenulls=True).over(before)).filter(F.col("kind") == "bind")
    resolved = F.coalesce(F.col("open.kind") == "parse", F.lit(False))
    return open_.select("conn", "seq", "stmt", F.when(resolved, F.col("open.sql")).alias("sql"), resolved.alias("resolved"))


def answered(events: DataFrame) -> DataFrame:
    """The events with name: of an answer ("t") the statement whose describe it answers, first in first out; null where none waits.

    Two windows over a connection and no join: the k-th describe and the k-th answer that finds one waiting share the rank k.
    """
    by_conn = Window.partitionBy("conn").orderBy("seq")
    asks, answers = F.col("kind") == "describe", F.col("kind") == "t"
    depth = events.withColumn("depth", F.sum(F.when(asks, 1).when(answers, -1).otherwise(0)).over(by_conn))
    lowest = F.least(F.lit(0), F.min("depth").over(by_conn.rowsBetween(Window.unboundedPreceding, -1)))
    finds = answers & (F.col("depth") >= F.col("lowest"))
    kept = depth.withColumn("lowest", lowest).withColumn("finds", finds)
    rank = F.when(asks, F.count_if(asks).over(by_conn)).when(F.col("finds"), F.count_if("finds").over(by_conn))
    together = Window.partitionBy("conn", "rank").orderBy("seq")
    name = F.when(F.col("finds"), F.last(F.when(asks, F.col("stmt")), ignorenulls=True).over(together))
    return kept.withColumn("rank", rank).withColumn("name", name).drop("depth", "lowest", "finds", "rank")


def described(events: DataFrame) -> DataFrame:
    """(conn, seq, stmt) for each answer ("t") to a describe; answers to nothing are left out."""
    own = answered(events.filter(F.col("kind").isin("describe", "t")))
    return own.filter((F.col("kind") == "t") & F.col("name").isNotNull()).select("conn", "seq", F.col("name").alias("stmt"))


def with_types(binds: DataFrame) -> DataFrame:
    """params (text) and oids zipped to typed; where their numbers differ no type is known."""
    fits = F.size("params") == F.size("oids")
    typed = F.transform("params", lambda p, i: F.struct(p.alias("value"), F.when(fits, F.try_element_at("oids", i + 1)).alias("oid")))
    return binds.withColumn("typed", typed).withColumn("types_known", fits)


def row_descriptions(events: DataFrame) -> DataFrame:
    """(conn, seq, stmt) of row descriptions ("T"): the statement that the connection's last answer ("t") was about."""
    own = answered(events.filter(F.col("kind").isin("describe", "t", "T")))
    return own.withColumn("about", _last_answer()).filter(F.col("kind") == "T").select("conn", "seq", F.col("about").alias("stmt"))


def _last_answer() -> Column:
    before = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col("kind") == "t", F.col("name")), ignorenulls=True).over(before)


def captured(events: DataFrame) -> DataFrame:
    """The protocol's events (see protocol_events) as they are written: conn, seq, kind, stmt, portal, sql, resolved, note, params.

    A bind has the SQL of the latest parse of its name, unless that was closed since.  Its binary values are decoded by the
    latest parameter types of its name, if they are as many as the values; otherwise they stay unknown, with the reason.
    Types outlive a close.  Everything is a window over a connection, so the events are shuffled once.
    """
    own = answered(events).withColumn("about", _last_answer())
    kind = F.col("kind")
    own = own.withColumn("stmt", F.when(kind == "t", F.col("name")).when(kind == "T", F.coalesce("about", F.lit(""))).otherwise(F.col("stmt")))
    before = Window.partitionBy("conn", "stmt").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(kind.isin("parse", "close"), F.struct("kind", "sql"))
    own = own.withColumn("open", F.last(named, ignorenulls=True).over(before)).withColumn("types", F.last(F.when(kind == "t", F.col("oids")), ignorenulls=True).over(before))
    found = F.coalesce(F.col("open.kind") == "parse", F.lit(False))
    resolved = F.when(kind == "bind", found).when(kind == "t", F.col("stmt").isNotNull()).when(kind == "T", F.col("stmt") != "").otherwise(kind.isin("query"))
    note = (
        F.when((kind == "bind") & ~found, F.concat(F.lit("unresolvable: no open statement "), F.to_json(F.struct("stmt")), F.lit(" on this connection")))
        .when((kind == "t") & F.col("stmt").isNull(), "parameter types that no describe waits for")
        .when(kind == "close", "closed: a later bind of this name is unresolvable")
    )
    fits = F.when((kind == "bind") & (F.size("values") == F.size("types")), F.col("types"))
    own = own.withColumn("fits", fits).withColumn("floats", wire.floats("values", "fits"))
    sql = F.when(kind == "bind", F.when(found, F.col("open.sql"))).otherwise(F.col("sql"))
    params = F.when(kind == "bind", F.transform("values", _param)).cast(f"array<{PARAM}>")
    written = own.withColumns({"sql": sql, "resolved": resolved, "note": note, "params": params}).filter(kind != "describe")
    return written.select("conn", "seq", _mapped("kind", WRITTEN).alias("kind"), F.coalesce("stmt", F.lit("")).alias("stmt"), "portal", "sql", "resolved", "note", "params")


def _param(value: Column, i: Column) -> Column:
    """A bound value, decoded where format and type allow it."""
    code = F.coalesce(F.get("formats", i), F.lit(0))
    binary, oid = value.isNotNull() & (code == 1), F.get("fits", i)
    text = F.when(code == 0, wire.text_of(value)).when(code == 1, F.coalesce(wire.decoded(value, oid), F.get("floats", i)))
    known = value.isNull() | text.isNotNull()
    reason = (
        F.when(known, None)
        .when(code != 1, F.concat(F.lit("unknown format code "), code.cast("string")))
        .when(F.coalesce(F.size("types"), F.lit(-1)) <= 0, "binary value without a captured type")
        .when(oid.isNull(), F.concat(F.size("types").cast("string"), F.lit(" captured types for "), F.size("values").cast("string"), F.lit(" values: not decoded")))
        .otherwise(F.concat(F.lit("no decoder for type "), oid.cast("string"), F.lit(" of this width")))
    )
    return F.struct(
        value.isNull().alias("null"), F.when(code == 1, "binary").otherwise("text").alias("format"), F.when(binary, oid).alias("oid"), known.alias("value_known"),
        text.alias("value"), F.when(~known, F.base64(value)).alias("value_base64"), reason.alias("unknown_reason"),
    )
