"""Proportional stratified interleaving: every shard gets each source in the proportion of the whole.

Rows are shuffled by a seeded hash within their source and ranked; rank r of n stands at (2r - 1) / 2n, and the rows of
all sources sorted by that place are cut into shards whose counts differ by one at most.

No source is ever sorted in one task: ranks come from counts of hash ranges plus a rank within each range, and so do
places, from ranges of the place. Both hash ranges and place ranges are even whatever the sizes of the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 10


def _running(df: DataFrame, count: str, by: list[str], order: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(count).over(w), F.lit(0)))


def interleave(df: DataFrame, source: str, keys: list[str], shards: int, seed: int = 0, range_bits: int = RANGE_BITS) -> DataFrame:
    """df with `shard` (0 to shards - 1) and `slot` (its place in the shard, from 0); columns of those names are replaced.

    `keys` tell rows apart: the hash is taken over them and the seed, and ties go by them. Null sources are a source of
    their own, null keys a value like others, columns may have any names; rows equal in all keys are interchangeable. An empty table stays empty.
    """
    df = df.drop("shard", "slot")
    kept = df.columns
    clash = {c.lower() for c in kept} & {"__s", "__h", "__b", "__r", "__at", "__j", "__n", "__p", "__s2", "__b2", "__j2", "__of", "__all", "__before"}
    if clash:  # under other names while the rows are dealt
        own = dict(zip(kept, (f"column {i}" for i in range(len(kept))), strict=True))
        out = interleave(df.withColumnsRenamed(own), own[source], [own[k] for k in keys], shards, seed, range_bits)
        return out.withColumnsRenamed({v: k for k, v in own.items()})
    keys_ = [F.col(f"`{k}`") for k in keys]
    rows = (df.withColumn("__s", F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-")))
            .withColumn("__h", F.xxhash64(F.lit(seed), *keys_))
            .withColumn("__b", F.shiftright("__h", 64 - range_bits)))
    counts = rows.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    counts = _running(counts, "__n", ["__s"], "__b", "__before")
    counts = counts.select(F.col("__s").alias("__s2"), F.col("__b").alias("__b2"), "__before",
                           F.sum("__n").over(Window.partitionBy("__s")).alias("__of"))
    rank = F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", *keys_))
    ranges = 1 << range_bits
    ranked = (rows.withColumn("__r", rank)
              .join(counts, (F.col("__s") == F.col("__s2")) & (F.col("__b") == F.col("__b2")))
              .withColumn("__r", F.col("__r") + F.col("__before"))
              .withColumn("__at", (2 * F.col("__r") - 1) / (2 * F.col("__of")).cast("double"))
              .withColumn("__j", F.expr(f"(2 * __r - 1) * {ranges} div (2 * __of)"))
              .select(*(F.col(f"`{c}`") for c in kept), "__s", "__r", "__at", "__j"))
    # How many ranks of a source fall into each range follows from its size: the first rank of range j is ceil((2 n j + R) / 2R).
    sizes = rows.groupBy("__s").agg(F.count("*").alias("__n"))
    edge = f"((2 * __n * {{0}} + {ranges} + {2 * ranges - 1}) div {2 * ranges})"
    small = sizes.where(F.col("__n") < ranges).select(F.explode(F.sequence(F.lit(1).cast("bigint"), "__n")).alias("__r"), "__n").select(
        F.expr(f"(2 * __r - 1) * {ranges} div (2 * __n)").alias("__j"), F.lit(1).cast("bigint").alias("__n"))
    large = sizes.where(F.col("__n") >= ranges).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ranges - 1).cast("bigint"))).alias("__j"), "__n").select(
        "__j", F.expr(f"{edge.format('(__j + 1)')} - {edge.format('__j')}").alias("__n"))
    places = small.unionByName(large).groupBy("__j").agg(F.sum("__n").alias("__n"))
    places = _running(places, "__n", [], "__j", "__before")  # one row for each range
    places = places.select(F.col("__j").alias("__j2"), "__before", F.sum("__n").over(Window.partitionBy()).alias("__all"))
    place = F.row_number().over(Window.partitionBy("__j").orderBy("__at", "__s", "__r"))
    out = (ranked.withColumn("__p", place).join(F.broadcast(places), F.col("__j") == F.col("__j2"))  # 2^range_bits rows
           .withColumn("__p", F.col("__p") + F.col("__before") - 1))
    shard = F.expr(f"cast(__p * {shards} div __all as int)")
    out = out.withColumn("shard", shard).withColumn("slot", F.expr(f"__p - (shard * __all + {shards - 1}) div {shards}"))
    return out.select(*(F.col(f"`{c}`") for c in kept), "shard", "slot")
