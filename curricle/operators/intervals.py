"""Algebra of employment intervals in months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import month_index
from ..types import TIME_HORIZON


def month_intervals(jobs: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, s, e (month indexes): an open end is the horizon, an end before the start is the start, a bad or missing start drops the row."""
    s, e = month_index(F.col(start)), month_index(F.coalesce(F.col(end), F.lit(TIME_HORIZON)))
    return jobs.select(*keys, s.alias("s"), e.alias("e")).where("s is not null and e is not null").withColumn("e", F.greatest("s", "e"))


def merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, g, s, e: the union of intervals (s, e); adjacent months join. g numbers the parts from 1."""
    order = Window.partitionBy(*keys).orderBy("s", "e")
    rows = intervals.withColumn("e", F.greatest("s", "e"))
    rows = rows.withColumn("__m", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    opens = F.when(F.col("__m").isNull() | (F.col("s") > F.col("__m") + 1), 1).otherwise(0)
    rows = rows.withColumn("g", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    return rows.groupBy(*keys, "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def spans(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_months, years (one decimal, half to even) of the union of intervals."""
    months = F.sum(F.col("e") - F.col("s"))
    return merged(intervals, keys).groupBy(*keys).agg(months.cast("bigint").alias("n_months"), F.bround(months / F.lit(12.0), 1).alias("years"))


def covered(parts: Column) -> Column:
    """The months that an array of intervals STRUCT<s, e>, sorted by start, covers: one pass over it."""
    start = F.struct(F.lit(None).cast("int").alias("hi"), F.lit(0).cast("bigint").alias("n"))
    step = lambda done, p: F.struct(F.greatest(done["hi"], p["e"]).alias("hi"), (done["n"] + F.greatest(F.lit(0), p["e"] - F.greatest(p["s"], done["hi"]))).alias("n"))
    return F.aggregate(parts, start, step, lambda done: done["n"])


def overlap_of_pairs(pairs: DataFrame, intervals: DataFrame, key: str, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with shared and total months and their ratio `iou` (0 where both are empty) of the unions of intervals of a and b.

    A pair takes one row with both sorted lists of parts, and one pass over the two together: what the union covers, of which the shared months follow.
    """
    none = F.array().cast("array<struct<s:int,e:int>>")
    parts = merged(intervals, [key]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias("p"))
    parts = parts.select(F.col(key).alias("__k"), "p", covered(F.col("p")).alias("n"))
    out = pairs
    for k in (a, b):
        held = parts.select("__k", F.struct("p", "n").alias(f"__of_{k}"))
        out = out.join(held, F.col(k) == F.col("__k"), "left").drop("__k")
    x, y = F.col(f"__of_{a}"), F.col(f"__of_{b}")
    out = out.withColumn("total", covered(F.array_sort(F.concat(F.coalesce(x["p"], none), F.coalesce(y["p"], none)))))
    zero = F.lit(0).cast("bigint")
    out = out.withColumn("shared", F.coalesce(x["n"], zero) + F.coalesce(y["n"], zero) - F.col("total")).drop(f"__of_{a}", f"__of_{b}")
    out = out.select(*pairs.columns, "shared", "total")
    return out.withColumn("iou", F.when(F.col("total") > 0, F.col("shared") / F.col("total").cast("double")).otherwise(0.0))


def extents(intervals: DataFrame, keys: list[str], width: int = 1000) -> DataFrame:
    """Rows of intervals with the least start `lo` and last end `hi` of all, and their place x, w on a bar of `width`."""
    ends = intervals.agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    rows = intervals.join(F.broadcast(ends))  # one row
    scale = lambda c: F.expr(f"cast(({c}) * {width} div greatest(hi - lo, 1) as int)")
    return rows.select(*keys, "s", "e", "lo", "hi", scale("s - lo").alias("x"), scale("e - s").alias("w"))
