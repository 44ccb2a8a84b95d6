"""Pairs of rows that share a key, however many share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Members of a block that may meet in one cell, and the most wide blocks whose table is broadcast.
WIDE, FEW = 128, 1 << 14
_SALTS = 16


def _counted(rows: DataFrame, wide: DataFrame, keys: list[str], member: str) -> DataFrame:
    """rows with k, the parts that their block falls into (null: one). More than FEW wide blocks are joined by a shuffle, each spread over _SALTS tasks."""
    named = wide.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("parts").alias("__k"))
    on = " and ".join(f"`{k}` = `__{k}`" for k in keys)
    if wide.count() <= FEW:
        out = rows.join(F.broadcast(named), F.expr(on), "left")
    else:
        named = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        out = rows.withColumn("__of", F.pmod(F.xxhash64(member), F.lit(_SALTS)).cast("int")).join(named, F.expr(f"{on} and __of = __salt"), "left").drop("__of", "__salt")
    return out.drop(*(f"__{k}" for k in keys))


def pairs_within(rows: DataFrame, keys: list[str], member: str = "pid", wide: int | None = None) -> DataFrame:
    """keys, a, b (a < b): every two members of rows (keys, member; distinct) that share all keys, once for each key. Null keys meet nothing.

    Blocks are counted first. One of n members is cut by a hash into parts of about WIDE members, and its pairs are the cells of a triangle: part i
    meets part j in cell (i, j), i <= j. A cell is a join key of its own, so the pairs of one hot block are dealt over all tasks; a member is sent
    to as many cells as its block has parts.
    """
    wide = WIDE if wide is None else wide
    rows = stored(rows.select(*keys, member).dropna(subset=keys), "blocks")
    parts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > wide).select(*keys, F.ceil(F.col("n") / wide).cast("int").alias("parts"))
    rows = _counted(rows, stored(parts, "wide-blocks"), keys, member)
    rows = rows.withColumn("__k", F.coalesce("__k", F.lit(1))).withColumn("__i", F.pmod(F.xxhash64(F.col(member), F.lit(1)), F.col("__k")).cast("int"))

    def side(name: str, cells: Column, i: str, j: str) -> DataFrame:
        return rows.select(*(F.col(k).alias(f"{name}{n}") for n, k in enumerate(keys)), F.col(member).alias(name), F.col("__i"), F.explode(cells).alias("__c")).select(
            *(f"{name}{n}" for n in range(len(keys))), name, F.col(i).alias(f"{name}i"), F.col(j).alias(f"{name}j"))

    x = side("x", F.sequence(F.col("__i"), F.col("__k") - 1), "__i", "__c")
    y = side("y", F.sequence(F.lit(0), F.col("__i")), "__c", "__i")
    met = x.join(y, F.expr(" and ".join([*(f"x{n} = y{n}" for n in range(len(keys))), "xi = yi", "xj = yj", "(xi < xj or x < y)"])))
    return met.select(*(F.col(f"x{n}").alias(k) for n, k in enumerate(keys)), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
