"""Sum-of-squares online packing of token sequences, in two passes.

Each document's last piece (what is left after whole windows) goes to the fill level that leaves the least sum of squared
counts of partly filled windows by level; a level array holds the counts. Every partition packs what it reads, one document
at a time. A piece leaves at once, with the number of its window and its place there, so a task holds a number for each open window and no ids.

The windows that are open at the end of a partition stay as they are and are packed once more, each as one piece, by the same rule over few tasks.
Only what that second pass leaves open is laid end to end and cut into whole windows, so that each of its tasks pads one window.
"""

from __future__ import annotations

import os
import struct
import threading
import time
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .common import binaries, flagged, small_batches, stored

#: Open windows that a task of the second pass packs; more make more tasks.
BLOCKS = 100_000
#: Sequences that the second pass makes are numbered from here on, those of the first from its partition's number, shifted likewise.
SECOND = 1 << 62
#: Marks that make one pre-token when they follow a word together, and a letter whose lower case depends on its place.
MARKS, CAPITAL_SIGMA = ".,;:!?#*$%&|()\"", "Σ"


class WordEncoder:
    """Ids of a text by a tokenizer that never merges across a space; keeps at most `cache` words' ids.

    The text is cut at ASCII white space only, which the tokenizer drops, so the ids of the parts are those of the whole. It must
    be one that composes (NFC), lower-cases, tells letters from other characters and maps bytes to characters.
    """

    def __init__(self, path: str, cache: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), cache, {"": b""}
        self.tokens, self.used = self.tokenizer.model.tokenize, time.monotonic()
        self.letters = dict(enumerate(byte_characters()))
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.packed = [struct.pack("<I", i) for i in range(top + 1)]

    def _one_by_one(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i: i + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = b"".join(map(self.packed.__getitem__, e.ids))

    def _learn(self, new: list[str]) -> None:
        """Words of letters, with marks after them or not, go to the tokenizer's model as its normaliser and its splitting would leave them."""
        known, packed, odd, tails = self.known, self.packed, [], []
        for w in new:
            core = w.rstrip(MARKS)
            if not core.isalpha():
                odd.append(w)
                continue
            if core.isascii():
                base = core.lower()
            elif CAPITAL_SIGMA in core or not (base := unicodedata.normalize("NFC", core).lower()).isalpha():
                odd.append(w)
                continue
            ids = known.get(base)
            if ids is None:
                piece = base if base.isascii() else base.encode().decode("latin-1").translate(self.letters)
                ids = known[base] = b"".join([packed[t.id] for t in self.tokens(piece)])
            if len(core) != len(w):
                tail = known.get(w[len(core):])
                if tail is None:
                    tails.append((w, ids, w[len(core):]))
                    continue
                ids = ids + tail
            known[w] = ids
        self._one_by_one([*odd, *{t for _, _, t in tails}])
        for w, ids, tail in tails:
            known[w] = ids + known[tail]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column (no nulls) and where each text's begin, and the last one's end."""
        self.used = time.monotonic()
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        ids = list(map(self.known.get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            if len(self.known) + 2 * len(new) > self.most:
                self.known = {"": b""}
            self._learn([words[i] for i in new])
            for i in new:
                ids[i] = self.known[words[i]]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        n = size[place]
        end = np.cumsum(n)
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(start[place] - end + n, n) + np.arange(n.sum())]
        return out, np.concatenate([[0], end])[np.asarray(split.offsets) - split.offsets[0].as_py()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def rest(self, seconds: float = 4.0) -> None:
        """Forgets its words when no task has used it for so long, so that a worker that is kept for other work is small."""
        while True:
            time.sleep(seconds)
            if len(self.known) > 1 and time.monotonic() - self.used > seconds:
                self.known = {"": b""}


class SumOfSquares:
    """Numbers of the open windows by fill level. place() says where a piece goes."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id = size, first_id
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size)]

    def level_for(self, s: int) -> int:
        """The level that a piece of s goes to, 0 for a new window: where the sum of squared counts grows least."""
        c, b = self.count, self.size
        cost = 2 * (c[s + 1: b + 1] - c[1: b - s + 1]) + 2
        if len(cost):
            cost[-1] = 1 - 2 * c[b - s]  # the window is full then and counts no more
            cost[c[1: b - s + 1] == 0] = np.iinfo(np.int64).max
            best = len(cost) - 1 - int(np.argmin(cost[::-1]))  # of equals, the fullest
            if cost[best] <= 2 * c[s] + 1:
                return best + 1
        return 0

    def place(self, s: int) -> tuple[int, int]:
        """The window that a piece of s goes to, and its place there."""
        level = self.level_for(s)
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            window = self.next_id
            self.next_id += 1
        if level + s < self.size:
            self.open[level + s].append(window)
            self.count[level + s] += 1
        return window, level

    def left(self) -> Iterator[tuple[int, int]]:
        """The windows that are open and how full each is."""
        return ((window, level) for level, windows in enumerate(self.open) for window in windows)


def settled(blocks: list[tuple[int, int]], size: int, first_id: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The second pass over open windows (number, fill): (window, begin, end, sequence, offset) says where its places from begin to end go.

    A window goes whole wherever the rule puts it; those of sequences that aren't full in the end are laid end to end and may be cut once.
    """
    packer = SumOfSquares(size, first_id)
    placed = [(window, s, *packer.place(s)) for window, s in blocks]
    at, laid = 0, {}
    for sequence, fill in packer.left():
        laid[sequence] = at
        at += fill
    for window, s, sequence, offset in placed:
        if sequence not in laid:
            yield window, 0, s, sequence, offset
            continue
        p = laid[sequence] + offset
        n = min(s, size - p % size)
        yield window, 0, n, packer.next_id + p // size, p % size
        if n < s:
            yield window, n, s, packer.next_id + (p + n) // size, 0


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str, words: int) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
        threading.Thread(target=_encoders[path].rest, daemon=True).start()
    _encoders[path].most = words
    return _encoders[path]


def _first(df: DataFrame, tokenizer_path: str, size: int, end_id: int, words: int) -> DataFrame:
    """The first pass: pieces with their window and place there (at), and a row for each window that stays open: its number and fill."""
    closing = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what other stages left in this worker
        encoder = _encoder(tokenizer_path, words)
        packer = SumOfSquares(size, TaskContext.get().partitionId() << 32)
        long = lambda x: pa.array(x, pa.int64())

        for batch in batches:
            found = []
            tokens, at = encoder.encode_column(batch.column(1).fill_null(""))
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                ids = tokens[a:b].tobytes() + closing
                whole = len(ids) // 4
                for start in range(0, whole, size):
                    part = ids[4 * start: 4 * (start + size)]
                    found.append((*packer.place(len(part) // 4), doc, start, whole, part))
            if found:
                *numbers, ids = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*map(long, numbers), binaries(list(ids)), pa.nulls(len(ids), pa.int64())], ["window", "at", "doc", "start", "doc_tokens", "ids", "fill"])
        left = list(packer.left())
        for k in range(0, len(left), 10_000):
            window, fill = zip(*left[k: k + 10_000], strict=True)
            none = pa.nulls(len(fill), pa.int64())
            yield pa.RecordBatch.from_arrays([long(window), none, none, none, none, pa.nulls(len(fill), pa.binary()), long(fill)], ["window", "at", "doc", "start", "doc_tokens", "ids", "fill"])

    return df.mapInArrow(run, "window bigint, at bigint, doc bigint, start bigint, doc_tokens bigint, ids binary, fill bigint")


def _second(left: DataFrame, size: int, blocks: int) -> DataFrame:
    """The second pass: where the places of each open window go (settled())."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        out = list(settled(held, size, SECOND + (TaskContext.get().partitionId() << 32)))
        for k in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[k: k + 10_000], strict=True)], ["block", "begin", "end", "sequence", "offset"])

    tasks = -(-left.count() // blocks) or 1
    rows = left.repartition(tasks, "window").sortWithinPartitions("window")
    return rows.mapInArrow(run, "block bigint, begin bigint, end bigint, sequence bigint, offset bigint")


def pack(df: DataFrame, tokenizer_path: str, id_: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, words: int = 1_000_000, blocks: int = BLOCKS) -> DataFrame:
    """Pieces: doc (id), start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit, binary).

    A document's tokens are its text's ids and end_id; a null or empty text has end_id alone. Each token is in exactly one piece,
    and the pieces of a sequence follow each other without gaps from offset 0. Rows that share an id, or have none, are packed each; ids must be whole numbers
    (or text that says one). Other columns don't matter, and an empty table gives an empty result.
    A task of the second pass takes about `blocks` open windows and pads one sequence. The pieces of the first pass are stored, so a lost executor changes no place.
    A worker keeps the ids of up to `words` words (about 250 bytes each); fewer take less memory and more time, for the same result.
    """
    small_batches(df.sparkSession, 256, mb=1)  # encoding takes some twenty times a batch's bytes for a moment
    rows = df.select(F.col(f"`{id_}`").cast("bigint").alias("doc"), F.col(f"`{text}`").alias("text"))
    first = stored(_first(rows, tokenizer_path, size, end_id, words), "pieces")
    second = stored(_second(first.where("fill is not null").select("window", "fill"), size, blocks), "settled")
    marked = flagged(first.where("fill is null").drop("fill"), "window", second, "block", out="open")
    n = F.expr("octet_length(ids) div 4")
    result = ["doc", "start", F.expr("octet_length(ids) div 4").alias("length"), "doc_tokens", "sequence_id", "offset", "ids"]
    closed = marked.where("not open").withColumnsRenamed({"window": "sequence_id", "at": "offset"}).select(result)
    moved = (marked.where("open").withColumn("n", n).join(second, F.expr("window = block and at < end and at + n > begin"), "left")
             .withColumn("skip", F.greatest(F.lit(0), F.expr("begin - at")))  # tokens of the piece before the part that goes here
             .withColumn("ids", F.when(F.col("block").isNull(), F.col("ids")).otherwise(F.expr("substring(ids, int(4 * skip + 1), int(4 * (least(at + n, end) - at - skip)))")))
             .withColumn("sequence_id", F.coalesce("sequence", "window"))
             .withColumn("offset", F.coalesce(F.expr("offset + at + skip - begin"), "at"))
             .withColumn("start", F.expr("start + skip")).select(result))
    return closed.unionByName(moved)
