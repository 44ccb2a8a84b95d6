"""Numbers of rows in an order over all partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def numbered(df: DataFrame, order: list[str | Column], out: str, start: int = 0) -> DataFrame:
    """df with start + 1, start + 2, ... in an order. Rows are sorted over all tasks; the driver sees one count for each."""
    rows = stored(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "numbered").withColumn("__p", F.shiftright("__m", 33))
    at, before = start, {}
    for r in sorted(rows.groupBy("__p").count().collect()):
        before[r["__p"]] = at
        at += r["count"]
    if not before:
        return rows.withColumn(out, F.lit(None).cast("bigint")).drop("__m", "__p")
    base = F.create_map(*(F.lit(v) for kv in before.items() for v in kv))
    return rows.withColumn(out, F.element_at(base, F.col("__p")).cast("bigint") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__m", "__p")
