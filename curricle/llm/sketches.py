"""Bottom-k sketches of word shingles as column expressions: the k smallest distinct 64-bit hashes, ascending.

Two sketches merge by uniting their hashes and keeping the k smallest, so parts may be sketched anywhere and in any
order. Everything here is built-in SQL functions; an array column per document is all that is held.

A text without words (or null) has an empty sketch; fewer words than a shingle make one shingle. Two empty sketches are
alike (1.0), an empty and another one aren't (0.0). Equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

K = 128
SHINGLE = 5
SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of_hashes(h: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """h must be a column of its own (not an inlined expression), as each shingle refers to it."""
    full = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(shingle))))
    short = F.array(F.xxhash64(F.lit(shingle), F.array_join(h.cast("array<string>"), " ")))
    hashes = F.when(F.size(h) >= shingle, full).when(F.size(h) > 0, short).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """df with the sketch of a text column; a column of that name is replaced, all others stay. A null or empty text has an empty sketch,
    rows that repeat have equal ones, and an empty table stays empty."""
    h, = fresh(df, "h")
    return df.withColumn(h, word_hashes(F.col(f"`{text}`"))).withColumn(out, sketch_of_hashes(F.col(h), k, shingle)).drop(h)


def merged(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: of the k smallest hashes of the union, the share that both have."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union).cast("double"))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a share of the range."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too (1.0 where a has none)."""
    shared = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def merged_by(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """One sketch for each value of keys. Hashes meet in `salts` parts of each key first, so that a hot key is spread."""
    cols = [F.col(f"`{c}`") for c in keys]
    x, salt, r = fresh(df, "x", "salt", "r")
    rows = df.select(*cols, F.explode_outer(F.col(f"`{sketch}`")).alias(x)).distinct()
    rows = rows.withColumn(salt, F.pmod(F.col(x), F.lit(salts)))
    near = rows.withColumn(r, F.row_number().over(Window.partitionBy(*cols, salt).orderBy(x))).where(F.col(r) <= k)
    last = near.withColumn(r, F.row_number().over(Window.partitionBy(*cols).orderBy(F.col(x).asc_nulls_last()))).where(F.col(r) <= k)
    return last.groupBy(*cols).agg(F.sort_array(F.collect_list(x)).alias(sketch))


def as_text(a: Column) -> Column:
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def with_next(df: DataFrame, key: str, value: Column, out: str, per_bucket: int = 200, most_buckets: int = 1 << 16) -> DataFrame:
    """Adds to each row the `value` of the row that follows by key (the last row: of the first), in one shuffle.

    Rows go to buckets between quantiles of the key, whose number grows with the rows; the first row of each bucket goes
    also to the bucket before it, where it ends the order. The driver sees two numbers for each bucket, at most 65,536.
    A null key comes first; rows of one key follow each other in the order of `value`. Columns may have any other names.
    """
    k_, b_, to = fresh(df, "k", "b", "to")
    keyed = df.withColumn(k_, F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(-(1 << 63)))).withColumn(out, value)
    keys = keyed.select(k_)
    n = min(most_buckets, keys.count() // per_bucket + 1)
    at = keys.agg(F.percentile_approx(k_, [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n)).alias("q")).first().q
    bounds = sorted(set(at or [0]))
    listed = F.expr(f"cast(split('{','.join(map(str, bounds))}', ',') as array<bigint>)")
    steps = F.expr(f"array({', '.join(str(1 << i) for i in reversed(range(len(bounds).bit_length())))})")
    bucket = F.aggregate(steps, F.lit(0), lambda p, s: F.when(
        (p + s <= len(bounds)) & (F.col(k_) >= F.get(listed, p + s - 1)), p + s).otherwise(p))
    firsts = {r[0]: r[1] for r in keys.select(bucket.alias("b"), k_).groupBy("b").agg(F.min(k_)).collect()}
    there = sorted(firsts)
    if not there:
        return df.withColumn(out, value)
    before = {b: there[i - 1] for i, b in enumerate(there)}
    text = ",".join(str(firsts.get(b, "")) for b in range(len(bounds) + 1))
    first_of = F.expr(f"transform(split('{text}', ','), x -> try_cast(x as bigint))")
    prior = F.expr(f"cast(split('{','.join(str(before.get(b, -1)) for b in range(len(bounds) + 1))}', ',') as array<int>)")
    own = F.struct(F.col(b_).alias("b"), F.lit(0).alias("late"))
    copy = F.struct(F.get(prior, F.col(b_)).alias("b"), F.lit(1).alias("late"))
    keyed = keyed.withColumn(b_, bucket)
    keyed = keyed.withColumn(to, F.explode(F.when(F.col(k_) == F.get(first_of, F.col(b_)), F.array(own, copy)).otherwise(F.array(own))))
    order = Window.partitionBy(f"{to}.b").orderBy(f"{to}.late", k_, out)
    return (keyed.withColumn(out, F.lead(out).over(order)).where(F.col(f"{to}.late") == 0).drop(k_, b_, to))
