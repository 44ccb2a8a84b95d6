"""A quality classifier whose verdict weighs a document's own evidence with its host's and its path's.

1. A logistic model over shares of characters, words and lines gives each document its log-odds of being good.
2. All documents' probabilities are summed by host and by path within it. Hosts are shrunk towards the global mean and
   paths towards their host, by beta priors whose strengths are estimated from how much sites differ (empirical Bayes).
3. The document's log-odds move by what its path's posterior differs from the global mean.

The model is fitted on all labelled documents: each Newton step is a job that adds up gradient and curvature over them, of which
the driver sees one vector of fixed size for each task. All else covers all documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, mapped, maybe_in, pieces, raw, small_batches, stored, without
from .host_rules import beta_prior
from .textstats import FEATURES, features


def _features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns in keep and `x`, the features of a text as doubles."""
    small_batches(df.sparkSession)
    rows = df.select(*keep, F.col(f"`{text}`").cast("binary").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, at = raw(batch.column(len(keep)))
        for i, j in pieces(at):
            x = features(data[at[i]: at[j]], at[i: j + 1] - at[i])
            values = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), values], [*keep, "x"])

    return mapped(rows, f, f"{schema}x array<double>")


#: A vector of sums over some rows: their features (a row each) and labels.
Sums = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Logistic:
    """Ridge logistic regression over standardised features and their squares, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
        self._fit(lambda f: f(x, y), ridge, steps)

    @classmethod
    def over(cls, total: Callable[[Sums], np.ndarray], ridge: float = 1.0, steps: int = 30) -> Logistic:
        """The model of rows that are in many places: total(f) adds up f over all of them."""
        out = cls.__new__(cls)
        out._fit(total, ridge, steps)
        return out

    def _fit(self, total: Callable[[Sums], np.ndarray], ridge: float, steps: int) -> None:
        wide = self._wide
        n, *sums = total(lambda x, y: np.concatenate([[len(x)], wide(x).sum(axis=0)]))
        mean = np.array(sums) / n
        scale = np.sqrt(total(lambda x, y: ((wide(x) - mean) ** 2).sum(axis=0)) / n) + 1e-9
        w = np.zeros(len(mean) + 1)
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6

        def slopes(w: np.ndarray) -> Sums:
            def f(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                x = np.hstack([np.clip((wide(x) - mean) / scale, -8, 8), np.ones((len(x), 1))])
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                return np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            return f

        for _ in range(steps):
            all_ = total(slopes(w))
            step = np.linalg.solve(all_[len(w):].reshape(len(w), len(w)) + np.diag(penalty), all_[: len(w)] - penalty * w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        self.mean, self.scale, self.weights = mean, scale, w

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, x * x])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Each row by itself, so that its value doesn't depend on what it is computed with."""
        x = np.clip((self._wide(x) - self.mean) / self.scale, -8, 8)
        return np.clip((x * self.weights[:-1]).sum(axis=1) + self.weights[-1], -30, 30)


def _total(rows: DataFrame) -> Callable[[Sums], np.ndarray]:
    """What adds up a function over all rows (x, y): each task gives one vector, added in the order of the tasks."""
    def total(f: Sums) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                    more = f(x, batch.column(1).to_numpy())
                    sums = more if sums is None else sums + more
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(sums)], pa.int32()), pa.array(sums))], ["v"])

        parts = rows.mapInArrow(run, "v array<double>").withColumn("at", F.spark_partition_id()).collect()
        return np.sum([r["v"] for r in sorted(parts, key=lambda r: r["at"])], axis=0)

    return total


def fit(rows: DataFrame, labels: DataFrame, id_: str, label: str) -> Logistic:
    """The model from all labelled rows (id, x: features; labels: id_ and a 0/1 column). Without both kinds of labels it says nothing (log-odds 0)."""
    known = labels.select(F.col(f"`{id_}`").alias("i2"), F.col(f"`{label}`").cast("double").alias("y")).dropna().dropDuplicates(["i2"])
    held = stored(maybe_in(rows.select("id", "x"), "id", known, "i2").join(known, F.expr("id = i2")).select("x", "y"), "labelled")
    ends = held.agg(F.min("y").alias("a"), F.max("y").alias("b")).first()
    if ends["a"] == ends["b"]:
        return Logistic(np.zeros((2, len(FEATURES))), np.array([0.0, 1.0]))
    return Logistic.over(_total(held))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def posterior(scores: DataFrame) -> DataFrame:
    """scores (site, path, log_odds) with host_posterior, path_posterior and quality (probability of being good)."""
    p = 1 / (1 + F.exp(-F.col("log_odds")))
    paths = stored(scores.groupBy("site", "path").agg(F.sum(p).alias("g"), F.count("*").cast("double").alias("n")), "paths")
    sites = paths.groupBy("site").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    hosts = sites.join(F.broadcast(beta_prior(sites, "g", "n")))  # one row
    hosts = hosts.select(F.col("site").alias("s2"), F.col("prior_mean").alias("base"), F.expr("(g + prior_mean * prior_strength) / (n + prior_strength)").alias("host_posterior"))
    within = paths.join(F.broadcast(beta_prior(paths, "g", "n").select("prior_strength")))
    each = within.join(hosts, F.expr("site = s2")).select(
        F.col("site").alias("s3"), F.col("path").alias("p3"), "base", "host_posterior",
        F.expr("(g + host_posterior * prior_strength) / (n + prior_strength)").alias("path_posterior"))
    out = looked_up(scores, each, "site = s3 and path = p3", "posteriors").drop("s3", "p3")
    total = F.col("log_odds") + _logit(F.col("path_posterior")) - _logit(F.col("base"))
    return out.withColumn("quality", 1 / (1 + F.exp(-total))).drop("base")


def classify(df: DataFrame, labels: DataFrame, id_: str = "doc_id", host: str = "source", path: str = "lang", text: str = "text",
             label: str = "quality", least: float = 0.5) -> DataFrame:
    """One row for each row of df: id, log_odds, host_posterior, path_posterior, quality, kept.

    A document is kept if its quality is `least` or more. Null hosts and paths are sites of their own; a null or empty text
    has zero features; rows are scored each, so repeated rows have equal results. An empty table gives an empty result.
    """
    site = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    rows = df.select(F.col(f"`{id_}`").alias("id"), site(host).alias("site"), site(path).alias("path"), F.col(f"`{text}`").alias("text"))
    rows = stored(_features(rows, "text", ["id", "site", "path"]), "features")
    model = fit(rows, labels, id_, label)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model.log_odds(x))], ["id", "site", "path", "log_odds"])

    scores = stored(mapped(rows, f, f"id {rows.schema['id'].dataType.simpleString()}, site string, path string, log_odds double"), "scores")
    out = posterior(scores)
    return out.select("id", "log_odds", "host_posterior", "path_posterior", "quality", (F.col("quality") >= least).alias("kept"))


def keep_good(df: DataFrame, labels: DataFrame, id_: str = "doc_id", **how) -> DataFrame:
    """The rows of df that classify() keeps, all columns as they are. Rows that share an id go together, if any of them is rejected; a null id stays."""
    verdict = stored(classify(df, labels, id_, **how).where(~F.col("kept")).select("id"), "rejected")
    return without(df, id_, verdict, "id")
