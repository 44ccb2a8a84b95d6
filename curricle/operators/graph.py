"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b. Large: a node's greater neighbours, small: its lesser ones and itself, go to the least it knows."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("m", "a").alias("m"))
        out = near.join(least, F.col("a") == F.col("c")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        out = links.join(least, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for each end of links (a, b), both longs: the least id reachable. Ids without links are absent."""
    now = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    old = None
    for _ in range(most_rounds):
        new = now.agg(mark.alias("x")).first().x
        if new == old or new[0] == 0:
            break
        old, now = new, stored(_star(_star(now, True), False), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
