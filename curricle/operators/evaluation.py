"""Scores of predictions against the truth: fields, multisets, pairs and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..types import LIST_GROUPS, SCALAR_FIELDS
from .merging import normal_form

FAILURES = 50


def _counted(rows: DataFrame, keys: list[str], tp: Column, fp: Column, fn: Column) -> DataFrame:
    n = lambda c: F.sum(c.cast("bigint"))
    return rows.groupBy(*keys).agg(n(tp).alias("tp"), n(fp).alias("fp"), n(fn).alias("fn"))


def scalar_counts(predicted: DataFrame, truth: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys with tp, fp, fn of single values: a wrong value counts as both missing and false, one that nobody asked for as false."""
    p, t = (df.select(*keys, F.col(value).alias(n)) for df, n in ((predicted, "__p"), (truth, "__t")))
    both = p.join(t, keys, "full")
    same = F.coalesce(F.col("__p") == F.col("__t"), F.lit(False))
    return _counted(both, keys, same, F.col("__p").isNotNull() & ~same, F.col("__t").isNotNull() & ~same)


def multiset_counts(predicted: DataFrame, truth: DataFrame, keys: list[str], items: list[str]) -> DataFrame:
    """keys with tp, fp, fn of items counted with their multiplicity; nulls equal nulls."""
    def counts(df: DataFrame, n: str) -> DataFrame:
        return df.select(*keys, F.struct(*(F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in items)).alias("__i")).groupBy(*keys, "__i").agg(F.count("*").alias(n))

    both = counts(predicted, "__p").join(counts(truth, "__t"), [*keys, "__i"], "full").fillna(0, ["__p", "__t"])
    tp = F.least("__p", "__t")
    return _counted(both, keys, tp, F.col("__p") - tp, F.col("__t") - tp)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b.cast("double")).otherwise(0.0)


def prf(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f1, 0 where undefined, not rounded."""
    rows = counts.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    total = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def macro_f1(scores: DataFrame) -> DataFrame:
    """One row: the mean of f1 over all groups."""
    return scores.agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_groups"))


def failures(counts: DataFrame, order: list[str], limit: int = FAILURES) -> DataFrame:
    """The first rows with anything false or missing."""
    return counts.where("fp > 0 or fn > 0").orderBy(*order).limit(limit)


def card_counts(cards: DataFrame, truth: DataFrame) -> DataFrame:
    """file, grp (field or list), tp, fp, fn of parsed cards against a truth file's rows (sources.documents.read_truth)."""
    files = cards.withColumn("file", F.regexp_extract("source_file", r"([^/\\]*)$", 1)).join(truth.select("file"), "file", "left_semi")
    def scalars(df: DataFrame, fields: Column) -> DataFrame:
        rows = df.select("file", F.explode(fields).alias("grp", "v")).where(F.col("grp").isin(SCALAR_FIELDS))
        value = F.lit(None).cast("string")
        for f in SCALAR_FIELDS:
            value = F.when(F.col("grp") == f, F.coalesce(normal_form(f, F.col("v")), F.lit(""))).otherwise(value)
        return rows.select("file", "grp", value.alias("value"))

    out = scalar_counts(scalars(files, F.transform_values("fields", lambda _, v: v["value"])), scalars(truth, F.col("truth_fields")), ["file", "grp"])
    jobs = ["company", "title", "start", "end"]
    clean = [F.coalesce(strip(F.col(f"e.{c}")), F.lit("")).alias(c) for c in jobs[:2]] + [F.col(f"e.{c}").alias(c) for c in jobs[2:]]
    have = files.select("file", F.explode("experiences").alias("e")).select("file", F.lit("experiences").alias("grp"), *clean)
    want = truth.select("file", F.explode("truth_experiences").alias("e")).select("file", F.lit("experiences").alias("grp"), *clean)
    out = out.unionByName(multiset_counts(have, want, ["file", "grp"], jobs))
    for name in ("skills", "certificates"):
        have = files.select("file", F.lit(name).alias("grp"), F.explode(F.col(f"{name}.value")).alias("v")).withColumn("v", F.lower(strip(F.col("v"))))
        want = truth.select("file", F.lit(name).alias("grp"), F.explode(f"truth_{name}").alias("v")).withColumn("v", F.lower(strip(F.col("v"))))
        out = out.unionByName(multiset_counts(have, want, ["file", "grp"], ["v"]))
    return out


def parse_report(counts: DataFrame) -> DataFrame:
    """grp, tp, fp, fn, precision, recall, f1 of each of the eleven groups, also those that nobody has."""
    spark = counts.sparkSession
    groups = spark.createDataFrame([(g,) for g in SCALAR_FIELDS + LIST_GROUPS], "grp string")
    total = groups.join(counts.groupBy("grp").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))), "grp", "left").fillna(0)
    return prf(total)


def cluster_pairs(members: DataFrame, cluster: str = "cluster", key: str = "pid") -> DataFrame:
    """(a, b) with a < b of all pairs within a cluster."""
    x, y = members.select(cluster, F.col(key).alias("a")), members.select(F.col(cluster).alias("__c"), F.col(key).alias("b"))
    return x.join(y, (F.col(cluster) == F.col("__c")) & (F.col("a") < F.col("b"))).select("a", "b")


def pair_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 and false_merge_rate of predicted pairs (a, b)."""
    both = predicted.select("a", "b", F.lit(1).alias("p")).distinct().join(truth.select("a", "b", F.lit(1).alias("t")).distinct(), ["a", "b"], "full")
    n = lambda c: F.count_if(F.expr(c))
    rows = prf(both.agg(n("p = 1 and t = 1").alias("tp"), n("p = 1 and t is null").alias("fp"), n("p is null and t = 1").alias("fn")))
    return rows.withColumn("false_merge_rate", _ratio(F.col("fp"), F.col("tp") + F.col("fp")))


def member_metrics(members: DataFrame, cluster: str = "cluster", truth: str = "grp") -> DataFrame:
    """pair_metrics() of clusters against true groups from counts alone: pairs of a set of n number n (n - 1) / 2, so none is made."""
    pairs = F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("bigint")
    count = lambda *keys: members.groupBy(*keys).agg(F.count("*").alias("n")).agg(pairs.alias("n"))
    one = count(cluster, truth).select(F.col("n").alias("tp")).join(count(cluster).select(F.col("n").alias("__p"))).join(count(truth).select(F.col("n").alias("__t")))
    rows = prf(one.select("tp", (F.col("__p") - F.col("tp")).alias("fp"), (F.col("__t") - F.col("tp")).alias("fn")))
    return rows.withColumn("false_merge_rate", _ratio(F.col("fp"), F.col("tp") + F.col("fp")))


def manual_pairs(decisions: DataFrame, members: DataFrame, key: str = "pid", truth: str = "grp") -> DataFrame:
    """One row: how many pairs are left to a reader (n_pairs), and how many of them are of the same true group (n_same) or not (n_cross)."""
    rows = decisions.where("decision = 'manual_review'").select("a", "b").distinct()
    for k in "ab":
        rows = rows.join(members.select(F.col(key).alias(k), F.col(truth).alias(f"__{k}")), k)
    same = F.count_if(F.col("__a") == F.col("__b"))
    return rows.agg(F.count("*").alias("n_pairs"), same.alias("n_same"), (F.count("*") - same).alias("n_cross"))


def passes(row, least: float = 0.95, most_false: float = 0.0) -> bool:
    """The gate of matching: precision and recall, and no false merge."""
    return row["precision"] >= least and row["recall"] >= least and row["false_merge_rate"] <= most_false


def gated(metrics: DataFrame, least: float = 0.95, most_false: float = 0.0) -> DataFrame:
    """metrics with `passed`, the same gate as a column."""
    return metrics.withColumn("passed", (F.col("precision") >= least) & (F.col("recall") >= least) & (F.col("false_merge_rate") <= most_false))


def markdown(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of a table in Markdown, in the order of the first column."""
    cells = F.concat_ws(" | ", *(F.coalesce(F.format_string("%.4f", c) if scores.schema[c].dataType.simpleString() == "double" else F.col(c).cast("string"), F.lit("")) for c in columns))
    return scores.orderBy(columns[0]).select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
