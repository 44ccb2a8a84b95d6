"""How far the sources of a language differ in their terms.

Terms are counted by group (language and source) within each task first. Terms that enough documents of their language hold are kept, and
range-partitioned by language and term: neighbouring partitions are a chunk of a language's sorted array of kept terms, and the ids of terms, found
in it by binary search, keep the order of their bytes over all chunks. By chunk, counts go into dense vectors, one for each group, by
their ids; probabilities and divergences of all pairs of groups and of all terms are sums and sorts of such vectors, a tile at a time.
All arithmetic is of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, pieces, raw, small_batches, stored

#: Probabilities are whole parts of this.
ONE = 1_000_000_000
#: Rows of counts in a chunk, and entries of the dense vectors that are held at once.
ROWS, TILE = 1 << 17, 1 << 18
#: Counts that a task holds before it hands on what it has.
HELD = 1 << 19

_TERM = np.ones(256, bool)
_TERM[:0x41] = _TERM[0x5B:0x61] = _TERM[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts (runs of letters A-Z, lower-cased, and of all characters beyond ASCII) in order, and the text of each."""
    inside = _TERM[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][np.diff(at) > 0]
    begins[first] = inside[first]
    start = np.flatnonzero(begins)
    doc = np.searchsorted(at, start, "right") - 1
    letters = _LOWER[data[inside]]
    place = np.cumsum(inside)[start] - 1 if len(start) else start
    offsets = np.append(place, len(letters)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters)]), doc


def _counted(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """lang, source, term, n, docs of runs of a batch's rows."""
    data, at = raw(batch.column(2))
    langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
    wide = len(sources.dictionary)
    group = np.asarray(langs.indices).astype(np.int64) * wide + np.asarray(sources.indices)
    for i, j in pieces(at, 1 << 22):
        terms, doc = _terms(data[at[i]: at[j]], at[i: j + 1] - at[i])
        coded = terms.dictionary_encode()
        size = max(len(coded.dictionary), 1)
        held, n = np.unique(doc * size + np.asarray(coded.indices), return_counts=True)
        keys, which, docs = np.unique(group[i + held // size] * size + held % size, return_inverse=True, return_counts=True)
        total = np.bincount(which, n, len(keys)).astype(np.int64)
        g = keys // size
        yield pa.table([langs.dictionary.take(pa.array(g // wide)), sources.dictionary.take(pa.array(g % wide)),
                        coded.dictionary.take(pa.array(keys % size)).cast(pa.binary()), pa.array(total), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def term_counts(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term (binary), n (occurrences), docs (documents that hold it); each task sums its own, so the same key may have several rows.

    Null languages, sources and texts are empty. Rows that repeat count each; other columns don't matter.
    """
    small_batches(df.sparkSession, 2048)

    def summed(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return out.rename_columns(["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for found in _counted(batch):
                held.append(found)
                rows += found.num_rows
                if rows > 2 * HELD:
                    held = [summed(held)]
                    rows = held[0].num_rows
                    if rows > HELD:
                        yield from held.pop().to_batches(1 << 16)
                        rows = 0
        if held:
            yield from summed(held).to_batches(1 << 16)

    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n bigint, docs bigint")


def kept_terms(counts: DataFrame, least: int = 3) -> DataFrame:
    """lang, source, term, n of the terms that at least so many documents of their language hold; one shuffle, by language and term."""
    rows = counts.repartition(F.col("lang"), F.col("term")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return rows.withColumn("all", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("all") >= least).select("lang", "source", "term", "n")


def probability(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(ONE * (count + 1) / total), by long division in three digits of a thousand, so that nothing overflows below 9e15."""
    out, rest = np.divmod(count + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


class Chunk:
    """A chunk of a language: its sorted terms, and the counts of its groups by id."""

    def __init__(self, terms: pa.Array, n: np.ndarray, owner: np.ndarray, totals: np.ndarray, kept: int):
        coded = terms.dictionary_encode()
        self.names = np.empty(len(coded.dictionary), object)
        self.names[:] = coded.dictionary.to_pylist()
        ordered = np.sort(self.names)
        self.id = np.searchsorted(ordered, self.names)[np.asarray(coded.indices)] if len(ordered) else np.zeros(0, np.int64)
        self.names, self.n, self.owner, self.totals, self.kept = ordered, n, owner, totals, kept
        order = np.argsort(self.id, kind="stable")
        self.id, self.n, self.owner = self.id[order], self.n[order], self.owner[order]

    def tiles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By runs of ids: the first one, counts of all groups (rows) and probabilities of groups and of the language."""
        groups, every = len(self.totals), int(self.totals.sum())
        width = max(1, TILE // max(groups, 1))
        for a in range(0, len(self.names), width):
            b = min(len(self.names), a + width)
            i, j = np.searchsorted(self.id, [a, b])
            count = np.zeros(groups * (b - a), np.int64)
            np.add.at(count, self.owner[i:j] * (b - a) + self.id[i:j] - a, self.n[i:j])
            count = count.reshape(groups, b - a)
            yield a, count, probability(count, (self.totals + self.kept)[:, None]), probability(count.sum(axis=0), every + self.kept)

    def audit(self, most: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """Sums of distances of all pairs of groups over the chunk, and by group the ids and values of its `most` farthest terms."""
        groups = len(self.totals)
        sums = np.zeros((groups, groups), np.int64)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * groups
        for a, count, p, q in self.tiles():
            for k in range(groups):
                sums[k] += _distance(p[k], p).sum(axis=1)
                over = np.flatnonzero((count[k] > 0) & (p[k] > q))
                ids = np.concatenate([best[k][0], over + a])
                values = np.concatenate([best[k][1], _distance(p[k, over], q[over])])
                first = np.lexsort((ids, -values))[:most]
                best[k] = ids[first], values[first]
        return sums, [(k, *best[k]) for k in range(groups)]


def _chunked(kept: DataFrame) -> DataFrame:
    """kept with the chunk of each row: neighbouring range partitions of a language that have about ROWS rows together, however finely they are dealt."""
    parts = kept.count() // ROWS + 1
    kept = stored(kept.repartitionByRange(parts, "lang", "term").withColumn("part", F.spark_partition_id()), "term-parts")
    before = F.sum("n").over(Window.partitionBy("l2").orderBy("p2").rowsBetween(Window.unboundedPreceding, -1))
    sizes = kept.groupBy(F.col("lang").alias("l2"), F.col("part").alias("p2")).agg(F.count("*").alias("n"))
    chunks = sizes.select("l2", "p2", F.floor(F.coalesce(before, F.lit(0)) / ROWS).cast("int").alias("chunk"))
    return kept.join(chunks, F.expr("lang = l2 and part = p2")).select("lang", "source", "term", "n", "chunk")


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: by group of a language and a source

    - part pair: each other source of the language, with the distance from its distribution of kept terms, farthest first;
    - part term: kept terms that are more likely in the group than in the whole language, with their share of the distance from it, at most `most`.

    A term is kept if `least` documents of its language hold it. With N occurrences of kept terms in a group and V kept terms, p = 1 + floor(ONE (count + 1)
    / (N + V)), and the distance of p from q is the sum of floor((p - q)^2 / q). Ties go by the bytes of the item. Null languages, sources and texts
    are empty ones; an empty table gives an empty result; a language without kept terms has pairs of value 0. Other columns don't matter.

    A task holds one chunk: about ROWS counts, and the groups of one language, whose pairs are the result.
    """
    docs = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))))
    kept = _chunked(stored(kept_terms(term_counts(df, lang, source, text), least), "kept-terms"))
    seen = kept.groupBy("lang", "chunk").agg(F.count_distinct("term").alias("terms"))
    sizes = seen.groupBy("lang").agg(F.sum("terms").alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (docs.distinct().alias("d").join(totals.alias("t"), F.expr("d.lang = t.lang and d.source = t.source"), "left").join(sizes.alias("s"), F.expr("d.lang = s.lang"), "left")
              .select("d.lang", "d.source", F.coalesce("t.total", F.lit(0)).alias("total"), F.coalesce("s.kept", F.lit(0)).alias("kept")))
    # every chunk is told all groups of its language; a language without terms has one chunk for its groups
    heads = (groups.join(seen.select(F.col("lang").alias("l2"), "chunk"), F.expr("lang = l2"), "left")
             .select("lang", F.coalesce("chunk", F.lit(-1)).alias("chunk"), "source", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("bigint").alias("n"), "total", "kept"))
    none = F.lit(None).cast("bigint")
    rows = kept.select("lang", "chunk", "source", "term", "n", none.alias("total"), none.alias("kept")).unionByName(heads)

    def by_chunk(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        head = table.filter(pc.is_null(table["term"])).sort_by("source")
        body = table.filter(pc.is_valid(table["term"]))
        names = head["source"].combine_chunks()
        owner = np.asarray(pc.index_in(body["source"], names)).astype(np.int64)
        chunk = Chunk(body["term"].combine_chunks() if body.num_rows else pa.array([], pa.binary()), np.asarray(body["n"]).astype(np.int64), owner, np.asarray(head["total"]).astype(np.int64), head["kept"][0].as_py())
        sums, best = chunk.audit(most)
        size = len(names)
        a, b = np.divmod(np.arange(size * size), max(size, 1))
        other = a != b
        a, b = a[other], b[other]
        out = [("pair", a, names.take(pa.array(b)), sums.reshape(-1)[other])]
        for k, ids, values in best:
            out.append(("term", np.full(len(ids), k), pa.array(list(chunk.names[ids]), pa.binary()).cast(pa.string()), values))
        one = table["lang"][0].as_py()
        return pa.concat_tables([pa.table([pa.array([one] * len(x), pa.string()), names.take(pa.array(x)), pa.array([part] * len(x), pa.string()), item, pa.array(v, pa.int64())],
                                          ["lang", "source", "part", "item", "value"]) for part, x, item, v in out])

    found = stored(rows.groupBy("lang", "chunk").applyInArrow(by_chunk, "lang string, source string, part string, item string, value bigint"), "divergences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= most))
