"""Quality rules by host: documents that break rules are counted by host, and whole hosts get a verdict.

A host's rate of broken rules is shrunk towards the pooled rate by a beta prior whose strength is estimated from how much
rates differ among hosts beyond chance (method of moments), so that small hosts aren't judged by a few documents. The
verdict is joined back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, mapped, pieces, raw, small_batches, stored
from .textstats import statistics

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_statistics(df: DataFrame, id_: str, host: str, text: str) -> DataFrame:
    """id, host and the counts in NAMES of each text."""
    small_batches(df.sparkSession)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, at = raw(batch.column(2))
        for i, j in pieces(at):
            s = statistics(data[at[i]: at[j]], at[i: j + 1] - at[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array(s[k], pa.int64()) for k in NAMES)],
                                             ["id", "host", *NAMES])

    rows = df.select(F.col(f"`{id_}`").cast("bigint").alias("id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").cast("binary").alias("text"))
    return mapped(rows, f, "id bigint, host string, " + ", ".join(f"{k} bigint" for k in NAMES))


def beta_prior(sites: DataFrame, good: str, total: str) -> DataFrame:
    """One row: mean (pooled share of good) and strength of a beta prior for sites with `good` out of `total`."""
    pooled = sites.agg(F.sum(good).alias("g"), F.sum(total).alias("t"), F.count("*").alias("h"),
                       F.sum(F.expr(f"{good} * {good} / {total}")).alias("q"))
    # sum of t (g/t - m)^2 = q - m^2 t; chance alone gives about (h - 1) m (1 - m)
    pooled = pooled.withColumn("m", F.expr("(g + 0.5D) / (t + 1.0D)"))
    pooled = pooled.withColumn("between", F.expr("(q - 2 * m * g + m * m * t - (h - 1) * m * (1 - m)) / greatest(t, 1)"))
    strength = F.expr("least(1e6D, greatest(1D, m * (1 - m) / greatest(between, 1e-9D) - 1))")
    return pooled.select(F.coalesce("m", F.lit(0.5)).alias("prior_mean"), F.coalesce(strength, F.lit(1.0)).alias("prior_strength"))


def judge(df: DataFrame, id_: str = "doc_id", host: str = "source", text: str = "text", least_words: int = 50,
          most_repeated: int = 50, most_failing: float = 0.5) -> DataFrame:
    """One row for each row of df: id, host, the counts, base_failed, host_rate (shrunk), host_ok.

    Base rules: at least `least_words` words, and at most `most_repeated` percent of them in repeated 3-word windows.
    A null or empty text has no words and fails. Null hosts are one host. Ids must be whole numbers (or text that says one) or null; rows
    that repeat are judged each. An empty table gives an empty result.
    """
    counted = text_statistics(df, id_, host, text).withColumn(
        "base_failed", F.expr(f"n_words < {least_words} or 100 * n_repeat_words > {most_repeated} * n_words"))
    rows = stored(counted.withColumn("site", F.coalesce(F.concat(F.lit("="), "host"), F.lit("-"))), "statistics")
    sites = rows.groupBy("site").agg(F.sum(F.col("base_failed").cast("double")).alias("bad"), F.count("*").cast("double").alias("all"))
    prior = beta_prior(sites, "bad", "all")
    rates = sites.join(F.broadcast(prior))  # one row
    rates = rates.select(F.col("site").alias("s2"), F.expr("(bad + prior_mean * prior_strength) / (all + prior_strength)").alias("host_rate"))
    out = looked_up(rows, rates, "site = s2", "rates")
    return out.select("id", "host", *NAMES, "base_failed", "host_rate", (F.col("host_rate") <= most_failing).alias("host_ok"))
