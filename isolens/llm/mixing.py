"""Mixing sources to target weights, with DataFrame functions only.

Temperature: the weight of a source is its token share to the power of an exponent from 0 to 1, normalised.
The exponent is found by bisection: the largest at which the entropy of the weights reaches a target, or the
smallest at which no source is repeated more often than a limit.  A pass evaluates the 2^LEVELS - 1 inner
points of LEVELS bisections at once, as one aggregation over the table of sources; the driver sees those
sums alone.

Permutation: each source is read in epochs, in a new order each time.  A document's place is a hash of seed,
epoch and id, cut into blocks of about BLOCK tokens; a running sum over blocks and then within each block
gives its first token in the source's stream.  Documents that begin before the source's quota (weight times budget)
are in.  The place in the mix is the share of the quota that lies before a document, so that every block of the
mix holds the sources in their weights; within it they stand in an order of their own.

Without a budget the mix is the smallest that holds every document of every source once, so nothing is
dropped; a smaller budget takes the beginning of each source's permutation.

Tokens are words, and a document without words or text counts as one; it is in the first epoch alone, as there is nothing in it to
repeat.  A null source counts as the empty one.  Rows with the same id in a source stand next to each other in one block;
columns besides doc_id, source and text are ignored.  An empty table gives no rows.  Of a text only the number of words is held,
so its length does not matter.  Ties in an order are broken by id, tokens, source and epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isolens.llm.scratch import saved

BLOCK = 1_000_000
STRETCH = 4096
LEVELS = 4
PASSES = 12
REPEATS = 4.0


def count_tokens(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.greatest(words, F.lit(1)).alias("tokens"), (words == 0).alias("wordless"))


def _power(exponent: Column) -> Column:
    return F.exp(exponent * F.log("share"))


def bisect_exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None) -> float:
    """The exponent for a target entropy (nats) or, for a mix that holds every document once, a repetition limit."""
    low, high = 0.0, 1.0
    parts = 1 << LEVELS
    for _ in range(PASSES):
        points = [low + (high - low) * i / parts for i in range(1, parts)]
        p = F.col("share")
        sums = []
        for i, a in enumerate(points):
            z = F.sum(_power(F.lit(a)))
            if entropy is not None:
                # entropy of p^a / z: log z - a * sum(p^a log p) / z
                sums.append((F.log(z) - a * F.sum(_power(F.lit(a)) * F.log(p)) / z >= entropy).alias(f"x{i}"))
            else:
                # repetitions of a source: p^(a - 1) over the least of them
                r = F.exp((a - 1) * F.log(p))
                sums.append((F.max(r) / F.min(r) > repeats).alias(f"x{i}"))
        row = sources.agg(*sums).first()
        n = sum(bool(x) for x in row)  # both tests hold from 0 to some exponent
        low, high = low + (high - low) * n / parts, low + (high - low) * (n + 1) / parts
    return low if entropy is not None else high


def weights(counted: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, exponent: float | None = None, budget: int | None = None) -> DataFrame:
    """source, tokens, share, weight, quota (tokens)."""
    by = saved(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    total = by.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    by = by.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    if exponent is None:
        exponent = bisect_exponent(by, entropy, None if entropy is not None else repeats)
    z, least = by.agg(F.coalesce(F.sum(_power(F.lit(exponent))), F.lit(1.0)), F.min(_power(F.lit(exponent)) / F.col("tokens"))).first()
    weighed = by.withColumn("weight", _power(F.lit(exponent)) / F.lit(z or 1.0))
    if budget is None:
        quota = F.greatest(F.ceil(_power(F.lit(exponent)) / F.lit(least or 1.0) * (1 - 1e-12)), F.col("tokens"))
    else:
        quota = F.ceil(F.col("weight") * float(budget))
    return weighed.withColumn("quota", quota.cast("long"))


def mix(docs: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, exponent: float | None = None, budget: int | None = None, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """doc_id, source, tokens, weight, epoch, mix_block, mix_rank: the documents of the mix, each as often as it is in it."""
    counted = saved(count_tokens(docs), "counted")
    quotas = saved(weights(counted, entropy, repeats, exponent, budget), "weights")
    budget_all = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    n_mix = max(1, -(-budget_all // block))
    sized = counted.join(quotas.select("source", F.col("tokens").alias("all_tokens"), "weight", "quota"), "source")
    epochs = F.when(F.col("wordless"), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("quota") / F.col("all_tokens")), F.lit(1)).cast("int"))
    each = sized.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    place = F.xxhash64(F.lit(seed), "epoch", "doc_id")
    n_blocks = F.ceil(F.col("all_tokens") / block)
    each = each.withColumn("block", F.pmod(place, n_blocks)).withColumn("order", F.xxhash64(F.lit(seed + 1), "epoch", "doc_id"))
    cell = ["source", "epoch", "block"]
    sums = each.groupBy(cell).agg(F.sum("tokens").alias("cell_tokens"))
    # in two levels, STRETCH blocks at a time, so that the cells of a hot source are many windows
    sums = sums.withColumn("stretch", F.floor(F.col("block") / STRETCH))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    stretches = sums.groupBy("source", "epoch", "stretch").agg(F.sum("cell_tokens").alias("n")).select("source", "epoch", "stretch", before("n", upto("source").orderBy("epoch", "stretch")).alias("start"))
    inner = sums.select(*cell, "stretch", before("cell_tokens", upto("source", "epoch", "stretch").orderBy("block")).alias("rest"))
    offsets = inner.join(stretches, ["source", "epoch", "stretch"]).select(*cell, (F.col("start") + F.col("rest")).alias("offset"))
    inside = Window.partitionBy(cell).orderBy("order", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = each.join(offsets, cell).withColumn("at", F.col("offset") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    taken = placed.filter(F.col("at") < F.col("quota"))
    progress = F.col("at") / F.col("quota")
    taken = taken.withColumn("mix_block", F.least(F.floor(progress * n_mix), F.lit(n_mix - 1)))
    rank = Window.partitionBy("mix_block").orderBy(F.xxhash64(F.lit(seed + 2), "epoch", "doc_id", "source"), "source", "doc_id", "epoch")
    return taken.select("doc_id", "source", "tokens", "weight", "epoch", "mix_block", F.row_number().over(rank).alias("mix_rank"))
