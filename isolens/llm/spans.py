"""Digest columns of span lists, shared by the operators that find things in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, first code point, code point after the last, and the rank of the kind in its list.
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(df: DataFrame, base: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, a count for each base kind, the digest of the base spans, all spans as text."""
    spans = F.array_sort("spans")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    held = F.filter(spans, lambda s: s["kind"].isin(base))
    return df.select("doc_id", *map(of, base), F.sha2(_joined(held), 256).alias("base_sha256"), _joined(spans).alias("spans"), *more)
