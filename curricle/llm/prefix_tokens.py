"""Exact token counts of every prefix of a text, by dynamic programming over a sentencepiece BPE model.

The tokens of a prefix are those of a shorter one and a last piece that ends it. Two pieces may stand side by side if encoding both
together gives just these two; a row of pieces is what the model gives if that holds for all neighbours, and exactly one such row exists.
So for each prefix there is exactly one piece that ends it and may follow the last piece of the prefix before it:

    last[i] = the piece p with text[i - len(p): i] = p that may follow last[i - len(p)],    count[i] = count[i - len(p)] + 1

Nothing is encoded again for another prefix: truncation and budget questions are answered from the counts.

Texts are cut where no piece has the two neighbouring characters side by side (before a space that follows none, above all). Nothing
merges across, so counts add up over the parts; equal parts of a batch are counted once, all of them together, one end position at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lists, mapped, pieces, raw, small_batches

#: The character that stands for a space, and the kinds of pieces in a model file.
SPACE, NORMAL, UNKNOWN, CONTROL, BYTE = "▁", 1, 2, 3, 6
#: Longer parts are counted alone, as they would lengthen the loop for all.
LONG = 64
_SLOTS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at: at + size]
        at += size


def load_pieces(path: str) -> tuple[dict[str, float], bool]:
    """Scores of the pieces that text can be cut in, and whether a space is put before a text, of a sentencepiece model file.

    Refuses what these counts don't cover: models other than BPE with byte fallback, normalisers other than the identity, and pieces of other kinds.
    """
    with open(path, "rb") as f:
        model = list(_fields(f.read()))
    trainer, norm = ({k: v for k, v in _fields(b"".join(v for n, v in model if n == field))} for field in (2, 3))
    if trainer.get(3) != 2 or not trainer.get(35) or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
        raise ValueError("only BPE models with byte fallback and the identity normaliser that keeps all spaces")
    scores = {}
    for field, value in model:
        if field == 1:
            piece = dict(_fields(value))
            kind = piece.get(3, NORMAL)
            if kind == NORMAL:
                scores[piece[1].decode()] = struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
            elif kind not in (UNKNOWN, CONTROL, BYTE):
                raise ValueError("user-defined and unused pieces aren't covered")
    return scores, bool(norm.get(3, 1))


class PrefixCounter:
    """Counts in one worker. It holds tables of the model's size and a table of _SLOTS answers to which pieces may stand side by side."""

    def __init__(self, path: str):
        self.scores, self.lead = load_pieces(path)
        self.names = list(self.scores)
        chars = sorted({c for p in self.names for c in p})
        self.class_of = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.class_of[32] = self.space = self.class_of[ord(SPACE)]
        # nodes of a trie of all pieces, numbered from the root (0); edges sorted by node and class
        self.classes = len(chars) + 1
        node_of, edges = {"": 0}, {}
        for p in self.names:
            for k in range(len(p)):
                if p[: k + 1] not in node_of:
                    node_of[p[: k + 1]] = len(node_of)
                    edges[node_of[p[:k]] * self.classes + int(self.class_of[ord(p[k])])] = node_of[p[: k + 1]]
        self.edges = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.edges.tolist()], np.int64)
        self.first = np.full(self.classes, -1, np.int64)
        at_root = self.edges < self.classes
        self.first[self.edges[at_root]] = self.child[at_root]
        self.piece = np.full(len(node_of), -1, np.int64)
        self.piece[[node_of[p] for p in self.names]] = np.arange(len(self.names))
        self.longest = max(map(len, self.names))
        # after the pieces' numbers: one for each class of characters that are no piece, then one for nothing
        self.names += [next(chr(k) for k in range(0x110000) if not self.class_of[k]), *chars]
        self.single = len(self.scores)
        self.none = len(self.names)
        self.keys = np.full(_SLOTS, -1, np.int64)
        self.answers = np.zeros(_SLOTS, bool)
        # may two neighbouring characters be inside one piece? by byte below 128, all others alike
        self.inside = np.zeros((129, 129), bool)
        kinds = lambda c: (32, 128) if c == SPACE else (min(ord(c), 128),)
        for p in self.names[: self.single]:
            for a, b in zip(p, p[1:]):
                for x in kinds(a):
                    self.inside[x, list(kinds(b))] = True

    def stand(self, left: str, right: str) -> bool:
        """Whether encoding left + right gives these two (left may be empty: whether right stays whole)."""
        parts, border, scores = [*left, *right], len(left), self.scores  # border: parts that are left's
        while True:
            best, where = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, where = score, k
            if best is None:
                return len(parts) == (2 if left else 1)
            if where + 1 == border:
                return False
            parts[where: where + 2] = [parts[where] + parts[where + 1]]
            border -= where + 1 < border

    def may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * (self.none + 1) + right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        out = self.answers[slot]
        missed = np.flatnonzero(self.keys[slot] != key)
        if len(missed):
            new, which = np.unique(key[missed], return_inverse=True)
            names, none = [*self.names, ""], self.none + 1
            found = np.array([self.stand(names[k // none], names[k % none]) for k in new.tolist()], bool)
            out[missed] = found[which]
            self.keys[slot[missed]], self.answers[slot[missed]] = key[missed], out[missed]
        return out

    def _candidates(self, cls: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (start, length, piece) in characters whose part ends at `end`; a character that is no piece is one all the same."""
        at = np.arange(len(cls))
        node = self.first[cls]
        piece = np.where(node >= 0, self.piece[node], -1)
        starts, lengths, found = [at], [np.ones(len(at), np.int64)], [np.where(piece >= 0, piece, self.single + cls)]
        at = at[node >= 0]
        node = node[at]
        for k in range(1, self.longest):
            more = at + k < end[at]
            at, node = at[more], node[more]
            if not len(at):
                break
            key = node * self.classes + cls[at + k]
            edge = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[edge] == key
            at, node = at[hit], self.child[edge[hit]]
            piece = self.piece[node]
            whole = piece >= 0
            starts.append(at[whole])
            lengths.append(np.full(int(whole.sum()), k + 1))
            found.append(piece[whole])
        return np.concatenate(starts), np.concatenate(lengths), np.concatenate(found)

    def counts(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Counts of all prefixes, the empty one included, of parts of the given sizes (each at least 1) whose code points follow each other."""
        cls = self.class_of[chars].astype(np.int64)
        part = np.repeat(np.arange(len(sizes)), sizes)
        end = np.cumsum(sizes)
        begin = end - sizes
        start, length, piece = self._candidates(cls, end[part])
        owner = part[start]
        cost = self._cost(chars[start], piece)
        total = np.zeros(len(chars) + len(sizes), np.int64)
        last = np.full(len(total), -1, np.int64)
        last[begin + np.arange(len(sizes))] = self.none
        step = start + length - begin[owner]  # where in its part a candidate ends
        order = np.argsort(step.astype(np.uint8), kind="stable")  # parts are short
        start, length, piece, cost, owner = (x[order] for x in (start, length, piece, cost, owner))
        start = start + owner  # places in total and last
        cuts = np.searchsorted(step[order], np.arange(1, int(step.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            s = start[a:b]
            ok = np.flatnonzero(self.may_follow(last[s], piece[a:b]))
            s, k = s[ok], a + ok
            last[s + length[k]] = piece[k]
            total[s + length[k]] = total[s] + cost[k]
        if (last < 0).any():
            raise RuntimeError("a prefix has no last piece")
        return total

    def _parts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Where parts begin in the bytes of texts, and the parts."""
        n = len(data)
        kind = np.minimum(data, 128)
        cut = np.zeros(n + 1, bool)
        cut[1:-1] = ~self.inside[kind[:-1], kind[1:]]
        cut[:-1] &= (data & 0xC0) != 0x80
        cut[at] = True
        begin = np.flatnonzero(cut[:-1])
        offsets = np.append(begin, n).astype(np.int64)
        return begin, pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])

    def texts(self, data: np.ndarray, at: np.ndarray) -> Texts:
        """The counts of the texts data[at[i]: at[i + 1]] (valid UTF-8)."""
        begin, found = self._parts(data, at)
        coded = found.dictionary_encode()
        code, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary
        leads = np.zeros(len(begin), np.int64)
        leads[np.searchsorted(begin, at[:-1][np.diff(at) > 0])] = int(self.lead)
        keys, part = np.unique(code * 2 + leads, return_inverse=True)
        lead, code = keys % 2, keys // 2
        # code points of all distinct parts, with a space before those that begin a text
        letters, where = raw(words)
        points = np.frombuffer(letters.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        seen = np.concatenate([[0], np.cumsum((letters & 0xC0) != 0x80)])[where]
        own = np.diff(seen)[code]
        sizes = own + lead
        to = np.cumsum(sizes) - sizes
        chars = np.full(int(sizes.sum()), 32, np.uint32)
        inner = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        chars[np.repeat(to + lead, own) + inner] = points[np.repeat(seen[:-1][code], own) + inner]
        counted = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        base = to + np.arange(len(sizes))
        short = np.flatnonzero(sizes <= LONG)
        for i in range(0, len(short), 30_000):
            self._count(short[i: i + 30_000], chars, to, sizes, base, counted)
        for k in np.flatnonzero(sizes > LONG):
            self._count(np.array([k]), chars, to, sizes, base, counted)
        return Texts(np.searchsorted(begin, at), part, sizes, lead, base, counted)

    def _count(self, which: np.ndarray, chars: np.ndarray, to: np.ndarray, sizes: np.ndarray, base: np.ndarray, out: np.ndarray) -> None:
        n = sizes[which]
        spread = lambda begin, n: np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        mine = chars[spread(to[which], n)]
        out[spread(base[which], n + 1)] = self.long(mine) if len(which) == 1 and n[0] > LONG else self.counts(mine, n)

    def long(self, chars: np.ndarray) -> np.ndarray:
        """counts() of one long part, one character after the other."""
        cls = self.class_of[chars].astype(np.int64)
        n = len(cls)
        total, last = [0] * (n + 1), [-1] * (n + 1)
        last[0] = self.none
        known, names, block = {}, [*self.names, ""], 1 << 14
        for a in range(0, n, block):
            b = min(n, a + block + self.longest)
            start, length, piece = self._candidates(cls[a:b], np.full(b - a, b - a))
            inside = np.flatnonzero(start < block)  # the others begin in the next block
            inside = inside[np.argsort(start[inside], kind="stable")]
            start, length, piece = start[inside] + a, length[inside], piece[inside]
            cost = self._cost(chars[start], piece)
            for s, k, p, c in zip(start.tolist(), length.tolist(), piece.tolist(), cost.tolist(), strict=True):
                pair = last[s], p
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = self.stand(names[pair[0]], names[p])
                if ok:
                    last[s + k], total[s + k] = p, total[s] + c
            if len(known) > _SLOTS:
                known = {}
        if min(last) < 0:
            raise RuntimeError("a prefix has no last piece")
        return np.array(total)

    def _cost(self, chars: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Tokens of a candidate: one, but one for each byte of a character that is no piece."""
        return np.where(piece < self.single, 1, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF))


class Texts:
    """Counts of texts as parts, of which equal ones are held once."""

    def __init__(self, first: np.ndarray, part: np.ndarray, sizes: np.ndarray, lead: np.ndarray, base: np.ndarray, counted: np.ndarray):
        self.first, self.part, self.lead, self.base, self.counted = first, part, lead, base, counted
        self.own = sizes - lead  # characters of the text in each part
        whole = counted[base + sizes]
        self.before = np.concatenate([[0], np.cumsum(whole[part])])  # tokens before each part, over all texts
        self.chars = np.concatenate([[0], np.cumsum(self.own[part])])

    def totals(self) -> np.ndarray:
        return self.before[self.first[1:]] - self.before[self.first[:-1]]

    def n_chars(self) -> np.ndarray:
        return self.chars[self.first[1:]] - self.chars[self.first[:-1]]

    def _of(self, k: int) -> np.ndarray:
        """Counts of the prefixes of part k that end with a character of the text."""
        p = self.part[k]
        a = self.base[p] + self.lead[p] + 1
        return self.counted[a: a + self.own[p]]

    def prefix(self, i: int) -> np.ndarray:
        """Counts of all prefixes of text i, from the empty one on."""
        a, b = self.first[i], self.first[i + 1]
        return np.concatenate([[0], *(self._of(k) + (self.before[k] - self.before[a]) for k in range(a, b))])

    def within(self, budget: int) -> np.ndarray:
        """By text, the characters of its longest prefix of at most `budget` tokens."""
        out = self.n_chars()
        for i in np.flatnonzero(self.totals() > budget):
            a, b = self.first[i], self.first[i + 1]
            left = budget - (self.before[a:b] - self.before[a])
            out[i] = 0
            for k in np.flatnonzero(left >= 1)[::-1]:  # a prefix that isn't empty has a token at least; the first part that has one within is the last that does
                fit = np.flatnonzero(self._of(a + k) <= left[k])
                if len(fit):
                    out[i] = self.chars[a + k] - self.chars[a] + fit[-1] + 1
                    break
        return out


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def _rows(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, str]:
    own, = fresh(df, "text")
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(own))
    return rows, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != own)


def _batches(batch: pa.RecordBatch, path: str) -> Iterator[tuple[int, int, np.ndarray, Texts]]:
    """Runs of rows of a batch whose last column is text, with their bytes' offsets and counts."""
    data, at = raw(batch.column(batch.num_columns - 1))
    for i, j in pieces(at, 1 << 22):
        own = at[i: j + 1] - at[i]
        yield i, j, own, _counter(path).texts(data[at[i]: at[j]], own)


def count(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, budget: int | None = None) -> DataFrame:
    """n_bytes, n_chars, n_tokens of each text beside the columns in `keep` (all others than text, but for those of the names made), and with a
    budget fit_chars: the characters of the longest prefix of at most so many tokens.

    Without begin, end or other added tokens; a null or empty text has no token. Repeated rows are counted each. Texts are whole, one Arrow
    batch at a time; those in a batch share the work for equal parts. Columns may have any names; an empty table gives an empty result.
    """
    small_batches(df.sparkSession, 2048)
    made = ["n_bytes", "n_chars", "n_tokens"] + ["fit_chars"] * (budget is not None)
    keep = [c for c in df.columns if c != text and c.lower() not in made] if keep is None else keep

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, at, texts in _batches(batch, model_path):
            out = [np.diff(at), texts.n_chars(), texts.totals()] + ([] if budget is None else [texts.within(budget)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), *(pa.array(x, pa.int64()) for x in out)], [*keep, *made])

    rows, schema = _rows(df, keep, text)
    return mapped(rows, f, schema + ", ".join(f"{c} bigint" for c in made))


def prefix_counts(df: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, out: str = "counts") -> DataFrame:
    """The array of the token counts of all prefixes of each text, from the empty one (0) to the whole, beside the columns in `keep`
    (all others than text and one named like `out`). Rows are as in count(); an array has one number more than the text has characters."""
    small_batches(df.sparkSession, 256)
    keep = [c for c in df.columns if c != text and c.lower() != out.lower()] if keep is None else keep

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, _, texts in _batches(batch, model_path):
            found = [texts.prefix(k) for k in range(j - i)]
            values = lists(np.concatenate(found).astype(np.int32), np.cumsum([0, *map(len, found)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), values], [*keep, out])

    rows, schema = _rows(df, keep, text)
    return mapped(rows, f, f"{schema}`{out}` array<int>")


def tokens_of_prefix(counts: Column, chars: Column | int) -> Column:
    """The tokens of the first `chars` characters (of the whole text, if it is shorter), from stored counts."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.get(counts, F.least(chars, F.size(counts) - 1).cast("int"))


def longest_prefix(counts: Column, budget: Column | int) -> Column:
    """The characters of the longest prefix of at most `budget` tokens, from stored counts. (Counts may fall where a character completes a piece.)"""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(counts, lambda n, i: F.when(n <= budget, i)))
