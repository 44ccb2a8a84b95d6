"""Removal of repeated byte strings with enhanced suffix arrays over content-chosen suffixes.

Every window of the given length holds an anchor: a position whose gram (up to Q bytes) has the least hash of the window (all of them, if
several are). Equal windows have anchors at equal places, so strings that repeat meet in the group of one Q-gram hash.

Anchors with the same surroundings, as far as any window around them reaches, are repeats as they stand; they are found
by counting hashes, whatever their number. Each group of anchors with different surroundings gets a sparse enhanced suffix
array: suffixes from the anchors on in order, their common prefixes, and a stack scan over the intervals of common
prefixes, from the deepest to the widest. The left sides of an interval's members are scanned the same way, as an interval tree of
common left extensions. A set of members is a maximal repeat if it is diverse on both sides: it is an interval on the left (so no longer
left extension is common to it), and its members lie in several child intervals on the right. All its members are its
occurrences. repeat_groups() returns these groups, and the ranges that repeated_spans() gives are those of their members.

Two anchors that share a string of the length share its part up to the anchor's middle or from there on, so a group is first split by
what its members have on the right and, as a second copy, on the left; a frequent gram with many surroundings thus makes many small groups.
Groups that still have more than MOST different surroundings go another exact way: the windows around their anchors are hashed and
counted, which spreads over all tasks.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, flagged, fresh, mapped, maybe_in, mix, pieces, prefix_hash, raw, small_batches, span, stored

Q = 128
MOST = 50_000
SEGMENT = 1 << 20
#: Suffixes whose groups are scanned together, and neighbours on a side that a suffix is compared with at most.
TOGETHER, STEPS = 4000, 500


def gram(length: int) -> int:
    """Bytes of a gram: as many as Q, but a third of a short string, so that anchors stay rare."""
    return max(1, min(Q, length // 3))


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over each run of w values of x."""
    size = 1
    while size * 2 <= w:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - (w - size)], x[w - size:]) if size < w else x


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, their Q-gram hashes, and the running sums. Texts are data[offsets[i]:offsets[i+1]]."""
    q, n = gram(length), len(data)
    sums = prefix_hash(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, np.zeros(0, np.uint64), sums
    at = np.arange(n - q + 1)
    g = np.maximum(span(sums, at, at + q), np.uint64(1))
    w = length - q + 1
    low = _slide(g, w, np.minimum)
    step = np.zeros(n + 1, np.int32)
    start, end = offsets[:-1], offsets[1:]
    has = end - start >= length
    np.add.at(step, start[has], 1)
    np.add.at(step, end[has] - length + 1, -1)
    low = np.where(np.cumsum(step)[: len(low)] > 0, low, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    high = _slide(np.concatenate([pad, low, pad]), w, np.maximum)
    p = np.flatnonzero(high == g)
    return p, g[p], sums


def _regions(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, int, int]]:
    """Rows i to j, their bytes and offsets, the first byte's place in a text that is cut, and the core of places that count."""
    for i, j in pieces(at):
        n = int(at[j] - at[i])
        if j - i > 1 or n <= SEGMENT:
            yield i, j, data[at[i]: at[j]], at[i: j + 1] - at[i], 0, 0, n
            continue
        for s in range(0, n, SEGMENT):  # a very long text, in parts that overlap by more than surroundings reach
            lo, hi = max(0, s - 4096), min(n, s + SEGMENT + 4096)
            yield i, j, data[at[i] + lo: at[i] + hi], np.array([0, hi - lo]), lo, s - lo, min(n, s + SEGMENT) - lo


def anchors(df: DataFrame, id_: str, text: str, length: int) -> DataFrame:
    """id, pos, h (Q-gram hash), ctx (hash of the surroundings), l, r (bytes of them before and from pos on)."""
    small_batches(df.sparkSession)
    left = length - gram(length)

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, at = raw(batch.column(1))
        ids = batch.column(0)
        for i, _, part, of, shift, lo, hi in _regions(data, at):
            p, g, sums = anchors_of(part, of, length)
            keep = (p >= lo) & (p < hi)
            p, g = p[keep], g[keep]
            if not len(p):
                continue
            d = np.searchsorted(of, p, "right") - 1
            begin, end = np.maximum(of[d], p - left), np.minimum(of[d + 1], p + length)
            ctx = mix(span(sums, begin, end) + ((p - begin) * 65536 + (end - p)).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(i + d)), pa.array((p - of[d] + shift).astype(np.int64)), pa.array(g.view(np.int64)), pa.array(ctx.view(np.int64)),
                 pa.array((p - begin).astype(np.int32)), pa.array((end - p).astype(np.int32))], ["id", "pos", "h", "ctx", "l", "r"])

    return mapped(df, f, "id bigint, pos bigint, h bigint, ctx bigint, l int, r int")


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class SuffixGroup:
    """The enhanced suffix array of some suffixes, each with what stands before it (reversed)."""

    def __init__(self, rights: list[bytes], lefts: list[bytes]):
        self.n = len(rights)
        self.order = np.array(sorted(range(self.n), key=rights.__getitem__))
        self.lcp = [common(rights[a], rights[b]) for a, b in zip(self.order[:-1], self.order[1:], strict=True)]
        by_left = sorted(range(self.n), key=lefts.__getitem__)
        self.place, self.rank = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        self.rank[by_left] = np.arange(self.n)
        self.by_left = np.array(by_left)
        lcs = np.array([common(lefts[a], lefts[b]) for a, b in zip(by_left[:-1], by_left[1:], strict=True)] or [0])
        self.low = [lcs]  # of runs of 1, 2, 4, ... neighbours
        while len(self.low[-1]) > 1 << (len(self.low) - 1):
            k = 1 << (len(self.low) - 1)
            self.low.append(np.minimum(self.low[-1][:-k], self.low[-1][k:]))

    def shared_left(self, ranks: np.ndarray) -> np.ndarray:
        """Common left bytes of neighbours among ascending left ranks."""
        a, b = ranks[:-1], ranks[1:]
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            t = self.low[level]
            out[at] = np.minimum(t[a[at]], t[b[at] - (1 << int(level))])
        return out

    def groups(self, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(common prefix, common left extension, members) of each maximal repeat of at least `length` bytes around the anchor."""
        lcp = np.array(self.lcp)
        for depth, first, last in intervals(self.lcp):
            ranks = np.sort(self.rank[self.order[first: last + 1]])
            shared = self.shared_left(ranks)
            need = max(0, length - depth)
            if shared.max() < need:
                continue
            members = self.by_left[ranks]
            starts = first + 1 + np.flatnonzero(lcp[first:last] == depth)  # where child intervals begin, but the first
            child = np.searchsorted(starts, self.place[members], "right")
            for left, i, j in intervals(shared.tolist()):
                if left >= need and (child[i: j + 1] != child[i]).any():
                    yield depth, left, members[i: j + 1]


def intervals(common_: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common part, first, last) of each interval of a row of strings whose neighbours have these in common: a stack scan, inner intervals first."""
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*common_, -1], 1):
        first = i - 1
        while stack and stack[-1][0] > x:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


class _Order:
    """Strings of many groups in order within their groups, the common prefix of neighbours (-1 across groups) and least ones of runs of 1, 2, 4, ... of these."""

    def __init__(self, strings: list[bytes], group: np.ndarray):
        n = len(strings)
        order = np.array(sorted(range(n), key=strings.__getitem__))
        self.order = order[np.argsort(group[order], kind="stable")]
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        size = np.array([len(x) for x in strings])
        width = int(size.max()) + 1
        body = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in strings]), np.uint8).reshape(n, width)
        self.near = np.full(n, -1)
        for lo in range(0, n - 1, 1000):  # few bytes at once stay near the processor
            a, b = self.order[lo: min(n - 1, lo + 1000)], self.order[lo + 1: lo + 1001]
            differ = body[a] != body[b]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
            self.near[lo: lo + len(a)] = np.where(group[a] == group[b], np.minimum(same, np.minimum(size[a], size[b])), -1)
        self.low = [self.near]
        while n >> len(self.low):
            k = 1 << (len(self.low) - 1)
            self.low.append(np.minimum(self.low[-1][:-k], self.low[-1][k:]))

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of different strings of one group."""
        a, b = self.place[a], self.place[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            t = self.low[level]
            out[at] = np.minimum(t[a[at]], t[b[at] - (1 << int(level))])
        return out


def _most_shared(one: _Order, other: _Order, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix, the longest common part on the side of `one` with any suffix of its group that shares at least `length` bytes with it on both sides together; and who is left open.

    What is shared with neighbours falls with their distance, so each looks on both sides until nothing longer can come; after STEPS neighbours it is left open.
    """
    n = len(one.order)
    best = np.maximum(other.near, np.concatenate([[-1], other.near[:-1]]))[other.place]  # no suffix shares more with it on the other side
    out, open_ = np.zeros(n, np.int64), np.zeros(n, bool)
    for step in (1, -1):
        i, part = np.arange(n), np.full(n, np.iinfo(np.int64).max)  # places in the order
        for d in range(STEPS + 1):
            at = i + d if step == 1 else i - d - 1
            part = np.minimum(part, np.where(at >= 0, one.near[at], -1))
            me = one.order[i]
            on = (part > out[me]) & (part + best[me] >= length)
            i, part, me = i[on], part[on], me[on]
            if not len(i):
                break
            if d == STEPS:
                open_[me] = True
                break
            they = one.order[i + step * (d + 1)]
            hit = part + other.shared(me, they) >= length
            for who in (me[hit], they[hit]):
                out[who] = np.maximum(out[who], part[hit])
    return out, open_


def covered(rights: list[bytes], lefts: list[bytes], length: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, how far before and after its start it is part of a repeat of at least `length` bytes (0, 0: of none).

    `group` says which suffixes belong together, all of a group standing in a row; without it they are one group. A group with a suffix whose STEPS
    neighbours on a side don't settle it is scanned by its maximal repeats, which are as many at most as its suffixes and their common parts allow.
    """
    group = np.zeros(len(rights), np.int64) if group is None else group
    right, left = _Order(rights, group), _Order(lefts, group)
    (after, open_a), (before, open_b) = _most_shared(right, left, length), _most_shared(left, right, length)
    for g in np.unique(group[open_a | open_b]):
        at = np.flatnonzero(group == g)
        before[at] = after[at] = 0
        for depth, shared, members in SuffixGroup([rights[k] for k in at], [lefts[k] for k in at]).groups(length):
            before[at[members]] = np.maximum(before[at[members]], shared)
            after[at[members]] = np.maximum(after[at[members]], depth)
    return before, after


def _surroundings(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Bytes around each place: g (the group), id, pos, left (reversed), right; twice, in the group of its right and in that of its left side.

    The gram is q bytes. A string of `length` that holds it has (length - q + 1) // 2 bytes or more before or after it.
    """
    q = gram(length)
    left, half = length - q, (length - q + 1) // 2
    wanted = places.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("at"))
    near = maybe_in(docs, "id", wanted, "id").join(wanted.withColumnRenamed("id", "i2"), F.expr("id = i2")).select("id", "text", "at")

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts, lists_ = batch.columns
        at, flat = np.concatenate([[0], np.cumsum(lists_.value_lengths())]), lists_.flatten()
        pos, h = np.asarray(flat.field(0)), np.asarray(flat.field(1))
        for i, id_ in enumerate(ids):
            body = texts[i].as_py()
            for lo in range(at[i], at[i + 1], 1000):
                hi = min(at[i + 1], lo + 1000)
                ps = pos[lo:hi].tolist()
                sides = [body[max(0, p - left): p][::-1] for p in ps], [body[p: p + length] for p in ps]
                for part, side in enumerate(sides):
                    keys = [x[:half] if not part else x[q: q + half] for x in side]
                    has = [k for k, x in enumerate(keys) if len(x) == half]
                    g = [int.from_bytes(hashlib.blake2b(b"%d %d " % (part, h[lo + k]) + keys[k], digest_size=8).digest(), "big", signed=True) for k in has]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g, pa.int64()), pa.array([id_] * len(has), pa.int64()), pa.array(pos[lo:hi][has] if has else [], pa.int64()), *(binaries([x[k] for k in has]) for x in sides)],
                        ["g", "id", "pos", "l", "r"])

    return mapped(near, f, "g bigint, id bigint, pos bigint, l binary, r binary")


def _scan_groups(df: DataFrame, length: int, whole: bool = False) -> DataFrame:
    """Suffix arrays of groups: id, begin, end of what repeats; with `whole`, one row for each occurrence of each maximal repeat: repeat (a digest of its bytes), id, pos, begin, end."""
    names = ["repeat", "id", "pos", "begin", "end"] if whole else ["id", "begin", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def found(rows: list[tuple]) -> Iterator[tuple]:
            lefts, rights = [x[3] for x in rows], [x[4] for x in rows]
            for depth, left, members in SuffixGroup(rights, lefts).groups(length):
                body = lefts[members[0]][:left][::-1] + rights[members[0]][:depth]
                digest = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "big", signed=True)
                for k in members.tolist():
                    yield digest, rows[k][1], rows[k][2], rows[k][2] - left, rows[k][2] + depth

        def closed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            """Of whole groups, one after the other."""
            group = np.cumsum(np.array([0, *(a[0] != b[0] for a, b in itertools.pairwise(rows))]))
            if not whole:
                before, after = covered([x[4] for x in rows], [x[3] for x in rows], length, group)
                at = np.flatnonzero(after)
                ids, pos = (np.array([rows[k][c] for k in at.tolist()], np.int64) for c in (1, 2))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids, pos - before[at], pos + after[at])], names)
                return
            out = []
            for one in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(group)) + 1):
                if len(one) > 1:
                    for row in found(rows[one[0]: one[-1] + 1]):
                        out.append(row)
                        if len(out) == 10_000:
                            yield made(out)
                            out = []
            if out:
                yield made(out)

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], names)

        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(held) >= TOGETHER and rows and rows[-1][0] != held[-1][0]:  # the group that is open ends here
                end = next(k for k, row in enumerate(rows) if row[0] != held[-1][0])
                yield from closed(held + rows[:end])
                held, rows = [], rows[end:]
            held += rows
        if held:
            yield from closed(held)

    rows = df.repartition("g").sortWithinPartitions("g", "id", "pos")
    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def _count_windows(df: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: all windows in the surroundings are hashed and counted."""
    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for id_, pos, l, r in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            text = np.frombuffer(l[::-1] + r, np.uint8)
            starts = np.arange(len(text) - length + 1)
            sums = prefix_hash(text)
            w = [span(sums, starts, starts + length), span(sums, starts, starts + length // 2)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(starts), id_, np.int64)), pa.array(pos - len(l) + starts), *(pa.array(x.view(np.int64)) for x in w)], ["id", "begin", "w1", "w2"])

    windows = mapped(df, f, "id bigint, begin bigint, w1 bigint, w2 bigint").distinct()
    many = windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select(F.col("w1").alias("v1"), F.col("w2").alias("v2"))
    return windows.join(many, F.expr("w1 = v1 and w2 = v2"), "left_semi").select("id", "begin", (F.col("begin") + length).alias("end"))


def _kinds(df: DataFrame, id_: str, text: str, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (id, text), all anchors, and their kinds: h, ctx, c (how many), one (id and pos of the first), mixed (the gram has several surroundings)."""
    docs = df.select(F.col(f"`{id_}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text")).where("id is not null")
    found = stored(anchors(docs, "id", "text", length), "anchors")
    kinds = found.groupBy("h", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("id", "pos")).alias("one"))
    per = found.groupBy("h").agg(F.min("ctx").alias("c1"), F.max("ctx").alias("c2"), F.count("*").alias("n")).where("n > 1")
    kinds = stored(kinds.join(per.select(F.col("h").alias("h2"), F.expr("c1 != c2").alias("mixed")), F.expr("h = h2")).drop("h2"), "kinds")
    return docs, found, kinds


def _counted(found: DataFrame, kinds: DataFrame) -> DataFrame:
    """The anchors of kinds that occur more than once."""
    return found.join(kinds.where("c > 1").select(F.col("h").alias("h2"), F.col("ctx").alias("x2")), F.expr("h = h2 and ctx = x2"), "left_semi")


def repeated_spans(df: DataFrame, id_: str = "doc_id", text: str = "text", length: int = 400, most: int = MOST) -> DataFrame:
    """(id, begin, end): byte ranges, overlapping ones too, whose union is every byte in a string of `length` bytes that also
    starts elsewhere, in the same text or another. Texts are UTF-8 bytes; null is empty; rows with a null id are left out."""
    docs, found, kinds = _kinds(df, id_, text, length)
    same = _counted(found, kinds).select("id", F.expr("pos - l").alias("begin"), F.expr("pos + r").alias("end"))
    around = stored(_surroundings(docs, kinds.where("mixed").select("h", "one.*"), length), "surroundings")
    sizes = around.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select(F.col("g").alias("g2"), "n")
    large = sizes.where(F.col("n") > most)
    out = same.unionByName(_scan_groups(around.join(sizes.where(F.col("n") <= most), F.expr("g = g2"), "left_semi"), length))
    if large.take(1):
        out = out.unionByName(_count_windows(around.join(large, F.expr("g = g2"), "left_semi"), length))
    return out


def repeat_groups(df: DataFrame, id_: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """(repeat, n_bytes, id, begin, end): every maximal repeat of at least `length` bytes with all its occurrences, one row each.

    `repeat` is a digest of the repeated bytes. Anchors see `length` bytes to the right and length - q to the left (q: bytes of a gram), so a longer
    repeat appears as several overlapping ones, each as long as its anchor sees. Occurrences with equal surroundings are counted, not compared:
    each is an occurrence of whatever their first one is an occurrence of. Nulls and ids as for repeated_spans(), whose ranges have the same union.
    """
    docs, found, kinds = _kinds(df, id_, text, length)
    same = _counted(found, kinds).select(F.xxhash64("h", "ctx").alias("repeat"), "id", F.expr("pos - l").alias("begin"), F.expr("pos + r").alias("end"))
    ones = kinds.where("mixed").select("h", "one.*")
    rows = _scan_groups(_surroundings(docs, ones, length), length, whole=True).distinct()
    named = kinds.where("mixed").select(F.col("one.id").alias("id1"), F.col("one.pos").alias("pos1"), F.col("h").alias("h1"), F.col("ctx").alias("x1"))
    rows = rows.join(named, F.expr("id = id1 and pos = pos1")).select("repeat", "h1", "x1", F.expr("pos - begin").alias("before"), F.expr("end - pos").alias("after"))
    each = rows.join(found.select("h", "ctx", "id", "pos"), F.expr("h1 = h and x1 = ctx")).select("repeat", "id", F.expr("pos - before").alias("begin"), F.expr("pos + after").alias("end"))
    return same.unionByName(each).distinct().select("repeat", F.expr("end - begin").alias("n_bytes"), "id", "begin", "end")


def _snapped(body: bytes, begin: int, end: int) -> list[int]:
    """A range without the characters that it has only part of."""
    while begin < end and body[begin] & 0xC0 == 0x80:
        begin += 1
    while begin < end < len(body) and body[end] & 0xC0 == 0x80:
        end -= 1
    return [begin, end]


def without_repeats(df: DataFrame, id_: str = "doc_id", text: str = "text", length: int = 400, most: int = MOST, characters: bool = False) -> DataFrame:
    """df with `text` as binary without the bytes that repeat, and `n_removed`, `n_spans` (columns of those names are replaced).

    With `characters`, a cut that would begin or end inside a character leaves that character whole, so that valid UTF-8 stays valid.

    Only texts that may have such bytes are shuffled. Null is empty. Rows that share an id share the union of their ranges; ids must be whole
    numbers (or text that says one), and a row with a null id loses nothing. Other columns may have any names. An empty table stays empty.
    """
    df = df.drop("n_removed", "n_spans")
    maybe, own, ranges_, other = fresh(df, "maybe", "id", "spans", "owner")
    spans = stored(repeated_spans(df, id_, text, length, most), "spans")
    body = df.withColumn(text, F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))).withColumn(own, F.col(f"`{id_}`").cast("bigint"))
    marked = flagged(body, own, spans.select("id").distinct(), "id", out=maybe)
    clean = marked.where(~F.col(maybe)).drop(maybe, own).withColumns({"n_removed": F.lit(0).cast("bigint"), "n_spans": F.lit(0).cast("bigint")})
    per = spans.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias(ranges_)).withColumnRenamed("id", other)
    cut = marked.where(F.col(maybe)).join(per, F.col(own) == F.col(other), "left").drop(maybe, own, other)
    names = cut.columns
    where, which = names.index(text), names.index(ranges_)
    keep = [c for c in names if c != ranges_]

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out, removed, spans_ = [], [], []
        for k, body_ in enumerate(batch.column(where).to_pylist()):
            ranges = batch.column(which)[k].values
            begin, end = (np.zeros(0, np.int64),) * 2 if ranges is None else (np.asarray(ranges.field(n)) for n in (0, 1))
            runs: list[list[int]] = []
            for b, e in zip(begin.tolist(), end.tolist(), strict=True):  # in order of b
                if runs and b <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([b, e])
            if characters:
                runs = [x for x in (_snapped(body_, b, e) for b, e in runs) if x[0] < x[1]]
            edges = [0, *(x for run in runs for x in run), len(body_)]
            out.append(b"".join(body_[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            removed.append(sum(e - b for b, e in runs))
            spans_.append(len(runs))
        columns = [binaries(out) if c == text else batch.column(names.index(c)) for c in keep]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64()), pa.array(spans_, pa.int64())], [*keep, "n_removed", "n_spans"])

    small_batches(df.sparkSession)
    return clean.unionByName(mapped(cut, f, clean.schema))
