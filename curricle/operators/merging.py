"""Versions of one person's record: which is newer, what it overrules, and where they contradict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import month_index, strip
from ..types import SCALAR_FIELDS, TIME_HORIZON
from .matching import normalize_email, normalize_phone


def latest_month(experiences: Column) -> Column:
    """The last month of any employment (the horizon of an open one), -1 without any."""
    ends = F.transform(experiences, lambda e: F.when(F.coalesce(e["end"], F.lit("")) != "", month_index(e["end"])).when(F.coalesce(e["start"], F.lit("")) != "", month_index(F.lit(TIME_HORIZON))))
    return F.coalesce(F.array_max(ends), F.lit(-1))


def freshness(experiences: Column, parsed_at: Column) -> Column:
    """A struct that orders records by age: last month, number of employments, time of parsing."""
    return F.struct(latest_month(experiences).alias("latest"), F.coalesce(F.size(experiences), F.lit(0)).alias("n"), F.coalesce(parsed_at, F.lit("")).alias("parsed_at"))


def resume_date(experiences: Column, parsed_at: Column) -> Column:
    """YYYY-MM of the last end (the horizon of an open one), else of parsing."""
    ends = F.transform(experiences, lambda e: F.coalesce(e["end"], F.lit(TIME_HORIZON)))
    return F.coalesce(F.array_max(ends), F.substring(parsed_at, 1, 7))


def latest_values(rows: DataFrame, keys: list[str], values: list[str], freshness_: Column) -> DataFrame:
    """Of each group, the freshest value of each column that isn't blank: a newer record overrules, a missing value is filled from older ones."""
    return rows.withColumn("__f", freshness_).groupBy(*keys).agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull() & (strip(F.col(c).cast("string")) != ""), F.col("__f"))).alias(c) for c in values))


def normal_form(field: str, value: Column) -> Column:
    return {"phone": normalize_phone, "email": normalize_email}.get(field, strip)(value)


def conflicts(pairs: DataFrame, fields: list[str] | None = None, a: str = "pa", b: str = "pb") -> DataFrame:
    """One row for each field that both records (structs a and b) have in different normal forms, in the order of the fields."""
    fields = fields or SCALAR_FIELDS
    blank = lambda v: v.isNull() | (strip(v) == "")
    each = [F.when(~blank(F.col(a)[f]) & ~blank(F.col(b)[f]) & ~F.coalesce(normal_form(f, F.col(a)[f]), F.lit("")).eqNullSafe(F.coalesce(normal_form(f, F.col(b)[f]), F.lit(""))),
                   F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), F.col(a)[f].alias("option_a"), F.col(b)[f].alias("option_b"))) for i, f in enumerate(fields)]
    rows = pairs.withColumn("__c", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())))
    return rows.select(*pairs.columns, "__c.*")


def remap(children: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """children with ids of merged records (mapping: source, target) replaced, equal rows once."""
    rows = children.join(mapping.select(F.col("source").alias("__s"), F.col("target").alias("__t")), F.col(key) == F.col("__s"), "left")
    return rows.withColumn(key, F.coalesce("__t", key)).drop("__s", "__t").distinct()


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows with those of changes in their place or added."""
    return rows.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def first_by_hash(rows: DataFrame, sha: str, order: list[str], known: DataFrame | None = None) -> DataFrame:
    """rows with status `new` or `duplicate`: only the first of each hash that isn't known yet is new.

    The first comes from a partial minimum and a join, so that a hash of very many rows is not sorted in one task.
    """
    first = rows.groupBy(F.col(sha).alias("__sha")).agg(F.min(F.struct(*order)).alias("__first"))
    if known is not None:
        first = first.join(known.select(F.col(sha).alias("__sha")).distinct(), "__sha", "left_anti")
    out = rows.join(first, (F.col(sha) == F.col("__sha")) & (F.struct(*order) == F.col("__first")), "left")
    return out.withColumn("status", F.when(F.col("__sha").isNotNull(), "new").otherwise("duplicate")).drop("__sha", "__first")
