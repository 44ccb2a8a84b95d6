"""Near-duplicates by an inverted join over MinHash signature coordinates, confirmed on full shingle sets.

1. Each text becomes a set of word shingles and a signature of K minima. Texts of equal sets form a class at once, known by a number of its own.
2. Classes are posted under each (coordinate, value) pair. A link needs at least M equal coordinates, so a class that
   shares fewer than M of its postings with anyone is out, and of the others only the K - M + 1 rarest postings are
   merged (two classes with M equal coordinates meet in one of them); the long lists are skipped.
3. The lists are merged: each class meets a few members of each of its lists - the class whose postings are shared most, as the original of
   many near copies is, and one of each of DRAWN parts of the list - and the lists in which a pair meets are counted. The lists that were
   skipped are probed for such pairs only, in both signatures; pairs with M collisions or more are retained.
4. Every retained pair is confirmed on the full sets, and components of the confirmed links are contracted. As a list's members don't all
   meet each other, this is a number of pairs in proportion to the postings, and it settles most groups.
5. Where a list still holds several components, what could link them is found exactly: by a join over the full sets under their rarest shingles.

A pair at similarity s has Binomial(K, s) equal coordinates: at 0.8 with K = 64 and M = 36 fewer than M have a chance of
about four in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lists, mapped, maybe_in, mix, pieces, raw, small_batches, stored
from ..operators.graph import components

K, M = 64, 36
#: Members of a list that all others meet, besides the one whose postings are shared most.
DRAWN = 1
_SEEDS = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = raw(batch.column(1))
    for i, j in pieces(at):
        hashes, of = Words(data[at[i]: at[j]], at[i: j + 1] - at[i], lower=True).shingles(shingle)
        yield i, j, hashes, of


def _digests(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over the hashes of each set x[of[i]:of[i+1]], 0 for empty ones."""
    has = np.flatnonzero(np.diff(of))
    s = np.zeros((2, len(of) - 1), np.uint64)
    if len(has):
        s[0, has] = np.add.reduceat(mix(x + np.uint64(1)), of[:-1][has])
        s[1, has] = np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D)), of[:-1][has])
    return s


def signatures(df: DataFrame, id_: str, text: str, shingle: int) -> DataFrame:
    """id, n (set size), s1, s2 (a 128-bit digest of the set), sig (K minima), b1, b2 (two low bits of each)."""
    small_batches(df.sparkSession)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, x, of in _sets(batch, shingle):
            n = np.diff(of)
            has = np.flatnonzero(n)
            sig = np.zeros((K, j - i), np.uint32)
            s = _digests(x, of)
            if len(has):
                cut = of[:-1][has]
                for k in range(K):
                    sig[k, has] = np.minimum.reduceat(((x * _SEEDS[k]) >> np.uint64(32)).astype(np.uint32), cut)
            bits = [np.bitwise_or.reduce((sig.astype(np.uint64) >> np.uint64(q) & np.uint64(1)) << np.arange(K, dtype=np.uint64)[:, None], axis=0) for q in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *(pa.array(v.view(np.int64)) for v in s),
                 lists(np.ascontiguousarray(sig.T).view(np.int32).ravel(), np.arange(j - i + 1) * K), *(pa.array(v.view(np.int64)) for v in bits)],
                ["id", "n", "s1", "s2", "sig", "b1", "b2"])

    return mapped(df.select(F.col(f"`{id_}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")), f,
                  "id bigint, n bigint, s1 bigint, s2 bigint, sig array<int>, b1 bigint, b2 bigint")


def shingle_sets(df: DataFrame, id_: str, text: str, shingle: int) -> DataFrame:
    """id, s1, s2 (the digest of signatures()) and its full set of shingle hashes."""
    small_batches(df.sparkSession)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, x, of in _sets(batch, shingle):
            s = _digests(x, of)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(v.view(np.int64)) for v in s), lists(x.view(np.int64), of)], ["id", "s1", "s2", "set"])

    rows = df.select(F.col(f"`{id_}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return mapped(rows, f, "id bigint, s1 bigint, s2 bigint, set array<bigint>")


def _alike(m: int) -> str:
    """Two classes may have m equal coordinates: so many agree in both stored bits."""
    return f"bit_count(~((x.b1 ^ y.b1) | (x.b2 ^ y.b2))) >= {m}"


def _torn(rows: DataFrame, key: str) -> DataFrame:
    """Those rows whose key has more than one group g."""
    torn = rows.groupBy(key).agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 != g2").select(F.col(key).alias("k2"))
    return rows.join(torn, F.col(key) == F.col("k2"), "left_semi")


def _across(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different groups g that may be linked, exactly: sets of the ratio asked for share one of their rarest shingles.

    With shingles in order of rarity and need = ceil(t / (1 + t) (nx + ny)), two sets that share `need` have the first that they
    share at a place of n - need or before in each. Shingles that no other set has take the first places and are not posted.
    """
    each = sets.join(groups.select(F.col("id").alias("i2"), "g"), F.col("id") == F.col("i2")).select("id", "g", F.size("set").alias("n"), F.explode("set").alias("x"))
    known = each.groupBy("x").agg(F.count("*").alias("c")).where("c > 1").select(F.col("x").alias("x2"), "c")
    rare = each.join(known, F.col("x") == F.col("x2")).groupBy("id", "g", "n").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("s"))
    left = F.expr(f"cast(greatest(0, n - (n * {percent} + 99) div 100 + 1 - (n - size(s))) as int)")
    post = rare.select("id", "g", "n", F.expr("n - size(s)").alias("u"), F.posexplode(F.slice(F.col("s.x"), F.lit(1), left)).alias("i", "x"))
    post = stored(_torn(post.select("id", "g", "n", F.expr("u + i").alias("i"), "x"), "x"), "rare")
    need = f"(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"
    return post.alias("x").join(post.alias("y"), F.expr(f"""x.x = y.x and x.id > y.id and x.g != y.g
        and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and x.i <= x.n - {need} and y.i <= y.n - {need}""")).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def collisions(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with `n_equal`: in how many coordinates the signatures (id, sig of classes) are equal, the skipped lists included."""
    a, b = (classes.select(F.col("id").alias(f"i{c}"), F.col("sig").alias(f"sig{c}")) for c in "ab")
    both = pairs.join(a, F.col("a") == F.col("ia")).join(b, F.col("b") == F.col("ib"))
    return both.withColumn("n_equal", F.size(F.filter(F.zip_with("siga", "sigb", lambda x, y: x == y), lambda e: e))).drop("ia", "ib", "siga", "sigb")


def _merged(lists_: DataFrame, m: int) -> DataFrame:
    """Pairs (a, b) that meet in a list and may have m equal coordinates, with `n_lists`: in how many they met."""
    one = F.struct("known", "id", "b1", "b2")
    hubs = lists_.groupBy("key").agg(F.max(one).alias("h"), F.count("*").alias("c")).where("c > 1").select("key", "h.id", "h.b1", "h.b2")
    part = lists_.withColumn("r", F.xxhash64("key", "id"))
    drawn = part.groupBy("key", F.pmod("r", F.lit(DRAWN)).alias("part")).agg(F.min(F.struct("r", "id", "b1", "b2")).alias("h")).select("key", "h.id", "h.b1", "h.b2")
    some = stored(hubs.unionByName(drawn).distinct(), "list-members")
    met = lists_.alias("x").join(some.alias("y"), F.expr(f"x.key = y.key and x.id != y.id and {_alike(m)}"))
    met = met.select("x.key", F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))
    return met.distinct().groupBy("a", "b").agg(F.count("*").alias("n_lists"))


def near_duplicates(df: DataFrame, id_: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of df: id, n_shingles, component_id (the least id of its group of linked texts).

    Links have 100 * |A & B| >= percent * |A | B| over sets of word shingles of the A-Z lower-cased text. A text without
    words (or null) has an empty set and is linked with nothing. Rows of equal sets are one class whatever their number, and rows
    that share an id but not a text are classes each. A null id stays null and never names a group; ids must be whole numbers (or text
    that says one). Other columns don't matter. An empty table gives an empty result. percent must be 80 or more for M to hold.
    """
    if percent < 80:
        raise ValueError("M is chosen for 80 percent or more")
    sigs = stored(signatures(df, id_, text, shingle), "signatures")
    some = sigs.where("n > 0 and id is not null")
    least = stored(some.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")).withColumn("c", F.monotonically_increasing_id()), "class-digests")
    of = least.select(F.col("n").alias("n2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), "rep", "c")
    classes = stored(some.join(of, F.expr("id = rep and n = n2 and s1 = t1 and s2 = t2"))
                     .select(F.col("c").alias("id"), "n", "sig", "b1", "b2").dropDuplicates(["id"]), "classes")
    post = classes.select("id", F.posexplode("sig").alias("c", "v")).select(
        "id", F.expr("shiftleft(cast(c as bigint), 32) | (cast(v as bigint) & 4294967295L)").alias("key"))
    many = post.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select(F.col("key").alias("k2"), "df")
    shared = post.join(many, F.col("key") == F.col("k2")).select("id", F.struct("df", "key").alias("p"))
    prefix = shared.groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum("p.df").alias("known")).where(F.size("p") >= M)
    prefix = prefix.select("id", "known", F.explode(F.slice(F.col("p.key"), F.lit(1), F.size("p") - (M - 1))).alias("key"))
    bits = classes.select(F.col("id").alias("i2"), "b1", "b2")
    lists_ = stored(prefix.join(bits, F.col("id") == F.col("i2")).select("key", "id", "b1", "b2", "known"), "postings")

    near = stored(_merged(lists_, M), "pairs")
    first = stored(collisions(near, maybe_in(classes, "id", _ends(near), "id")).where(F.col("n_equal") >= M).select("a", "b"), "retained")
    docs = df.select(F.col(f"`{id_}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))

    def sets_of(ends: DataFrame) -> DataFrame:
        """id (of a class) and set: from the first document with the class's least id and its digest."""
        mine = least.join(ends.select(F.col("id").alias("i2")), F.col("c") == F.col("i2"), "left_semi").select("rep", F.col("s1").alias("t1"), F.col("s2").alias("t2"), "c")
        own = mine.select("rep").distinct()
        found = maybe_in(docs, "id", own, "rep").join(own, F.col("id") == F.col("rep"), "left_semi")
        found = shingle_sets(found, "id", "text", shingle).join(mine, F.expr("id = rep and s1 = t1 and s2 = t2"))
        return stored(found.select(F.col("c").alias("id"), "set").dropDuplicates(["id"]), "sets")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("id").alias(f"i{c}"), F.col("set").alias(f"s{c}")) for c in "ab")
        both = pairs.join(a, F.col("a") == F.col("ia")).join(b, F.col("b") == F.col("ib"))
        both = both.withColumn("same", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.expr(f"100L * same >= {percent}L * (size(sa) + size(sb) - same)")).select("a", "b")

    links = stored(confirmed(first, sets_of(_ends(first))), "confirmed")
    group = components(links)

    marked = lists_.join(group.select(F.col("id").alias("i2"), "component"), F.col("id") == F.col("i2"), "left").select(
        "key", "id", F.coalesce("component", "id").alias("g"))
    rest = stored(_torn(marked, "key").select("id", "g").distinct(), "rest")
    if rest.take(1):
        sets = sets_of(rest.select("id"))
        more = confirmed(_across(sets, rest, percent), sets)
        group = components(links.unionByName(more))

    named = least.select("n", "s1", "s2", "rep", "c").join(group.select("id", "component"), F.col("c") == F.col("id"), "left")
    named = named.withColumn("g", F.coalesce("component", "c"))
    first_id = named.where("component is not null").groupBy("g").agg(F.min("rep").alias("m")).select(F.col("g").alias("g2"), "m")
    named = named.join(first_id, F.col("g") == F.col("g2"), "left").select(
        F.col("n").alias("n2"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.coalesce("m", "rep").alias("component"))
    whole = sigs.select("id", "n", "s1", "s2").join(named, F.expr("n > 0 and n = n2 and s1 = t1 and s2 = t2"), "left")
    return whole.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
