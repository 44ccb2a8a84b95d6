"""What the operators of this subpackage share: tables, Arrow plumbing and a vectorised text kernel.

The kernel works on the UTF-8 bytes of many texts at once (an Arrow column's own buffers), so that a word
costs a few numpy operations and no Python object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship
from ..storage import scratch, stored  # noqa: F401  (operators take them from here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256, mb: int = 4) -> None:
    """Arrow batches of at most so many rows and MB, so that long texts don't fill a Python worker; sees to it that workers have this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        made, k = f"__{name}", 0
        while any(t.startswith(made.lower()) for t in taken):
            k += 1
            made = f"__{name}{k}"
        out.append(made)
    return out


def flagged(df: DataFrame, col: str, members: DataFrame, key: str, out: str = "__maybe") -> DataFrame:
    """df with a boolean column `out`: false where col is certainly no key of members; a few other rows get true too.

    A table of bits is the one thing broadcast, so that big rows are shuffled only where a later join needs them. It has 32 bits for each member,
    counted first, and at most 2^18 words (4 MB with their numbers). Beyond that it would mark ever more rows, so then all get true and are shuffled. Null is no key.
    """
    n = members.count()
    words = 1 << max(6, min(18, (n // 2).bit_length()))
    if n > 24 * words:
        return df.withColumn(out, F.col(f"`{col}`").isNotNull())
    w, b, w2, bits_ = fresh(df, "word", "bit", "of", "bits")

    def place(c: str) -> tuple:
        h = F.xxhash64(F.col(f"`{c}`"))
        return F.pmod(h, F.lit(words)).cast("int"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")

    word, bit = place(key)
    bits = members.where(F.col(f"`{key}`").isNotNull()).select(word.alias(w2), bit.alias(b)).groupBy(w2).agg(
        F.bit_or(F.expr(f"shiftleft(1L, {b})")).alias(bits_))
    word, bit = place(col)
    return (df.withColumn(w, word).withColumn(b, bit)
            .join(F.broadcast(bits), F.col(w) == F.col(w2), "left")
            .withColumn(out, F.expr(f"`{col}` is not null and (shiftrightunsigned(coalesce({bits_}, 0L), {b}) & 1L) = 1L"))
            .drop(w, b, w2, bits_))


def maybe_in(df: DataFrame, col: str, members: DataFrame, key: str) -> DataFrame:
    """The rows of df whose col may be a key of members: none is missed, a few others stay."""
    maybe, = fresh(df, "maybe")
    return flagged(df, col, members, key, out=maybe).where(F.col(maybe)).drop(maybe)


def without(df: DataFrame, col: str, dropped: DataFrame, key: str) -> DataFrame:
    """df without the rows whose col is a key of dropped; only rows that may be are shuffled."""
    maybe, gone_ = fresh(df, "maybe", "gone")
    marked = flagged(df, col, dropped, key, out=maybe)
    sure = marked.where(~F.col(maybe)).drop(maybe)
    near = marked.where(F.col(maybe)).drop(maybe)
    gone = dropped.select(F.col(f"`{key}`").alias(gone_)).distinct()
    return sure.unionByName(near.join(gone, F.col(f"`{col}`") == F.col(gone_), "left_anti"))


def looked_up(rows: DataFrame, sites: DataFrame, on: str, name: str, most: int = 1 << 16) -> DataFrame:
    """rows joined with a table of sites, which is broadcast only if it has at most `most` rows; a larger one is shuffled, hot sites being split."""
    sites = stored(sites, name)
    return rows.join(F.broadcast(sites) if sites.count() <= most else sites, F.expr(on))


# --- Arrow ---------------------------------------------------------------------------------------------------

def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1) of a binary or string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mapped(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow of a function on one batch, which finds columns by their place: df's names may repeat and hold any character."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


# --- hashing and words ---------------------------------------------------------------------------------------

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse up to n."""
    if len(_pow[0]) <= n:
        for k, base in enumerate((_MULT, _INV)):
            p = np.full(max(n + 1, 1 << 18), base, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0][: n + 1], _pow[1][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of which span() takes the hash of any span of data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0][:-1], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(sums) - 1)[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words ([^ \\x09-\\x0D]+) of the texts data[offsets[i]:offsets[i+1]]: spans, 64-bit hashes, first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        if lower:
            data = _LOWER[data]
        text = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], text[:-1]]) if n else text
        after = np.concatenate([text[1:], [False]]) if n else text
        self.start = np.flatnonzero(text & (~before | edge[:-1]))
        self.end = np.flatnonzero(text & (~after | edge[1:])) + 1
        self.sums = prefix_hash(data)
        self.hash = span(self.sums, self.start, self.end)
        self.first = np.searchsorted(self.start, offsets)  # of each text, and the end of the last
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes of k-word shingles by text, ascending in each, and offsets. Fewer words make one shingle, none make none."""
        h, n = self.hash, len(self.hash)
        docs = len(self.first) - 1
        if not n:
            return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
        full = self.first[1:][self.doc] - np.arange(n)  # words left in the text
        have = np.flatnonzero(full >= k)
        out = np.zeros(len(have), np.uint64)
        for j in range(k):
            out = mix(out + h[have + j] * np.uint64(2 * j + 3))
        owner = self.doc[have]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            more = []
            for d in short:
                x = np.array([self.count[d]], np.uint64)
                for w in h[self.first[d]: self.first[d + 1]]:
                    x = mix(x + w)
                more.append(x[0])
            out, owner = np.concatenate([out, np.array(more, np.uint64)]), np.concatenate([owner, short])
        order = np.lexsort((out, owner))
        out, owner = out[order], owner[order]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        out, owner = out[new], owner[new]
        return out, np.searchsorted(owner, np.arange(docs + 1))
