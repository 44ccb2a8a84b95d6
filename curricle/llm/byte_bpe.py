"""Byte-level BPE with a sentencepiece model serialised directly from a rank file.

Every vocabulary entry becomes one piece: its bytes are mapped one to one onto printable characters, and its score is
the negative rank, so that sentencepiece's best-score-first merging is lowest-rank-first merging. The normaliser is the
identity. Pre-tokens (matches of a pattern) are encoded one by one; decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, lists, mapped, small_batches


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it prints, else the next one from U+0100 on."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printing else next(spare)) for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a file of `base64 rank` lines; ranks must be 0, 1, 2, ..."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _field(number, 2, _varint(len(body)) + body)


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: piece i is vocabulary[i] with score -i; the last piece is the obligatory unknown one."""
    letters = byte_characters()
    out = bytearray()
    for rank, token in enumerate(vocabulary):
        piece = "".join(map(letters.__getitem__, token)).encode()
        out += _message(1, _message(1, piece) + _field(2, 5, struct.pack("<f", -float(rank))))
    unknown = _message(1, b"<unk>") + _field(2, 5, struct.pack("<f", 0.0)) + _field(3, 0, _varint(2))
    out += _message(1, unknown)
    off = _field(3, 0, b"\0") + _field(4, 0, b"\0") + _field(5, 0, b"\0")  # no dummy prefix, no space removal, no escapes
    size = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(vocabulary) + 1))  # model type BPE
    ids = b"".join(_field(k, 0, _varint(v & (1 << 64) - 1)) for k, v in ((40, len(vocabulary)), (41, -1), (42, -1), (43, -1)))
    return bytes(out) + _message(2, size + ids) + _message(3, _message(1, b"identity") + off)


class Codec:
    """Encodes and decodes in one worker; keeps at most `cache` pre-tokens."""

    def __init__(self, ranks_path: str, pattern: str, cache: int = 200_000):
        self.vocabulary = load_ranks(ranks_path)
        self.rank = {t: i for i, t in enumerate(self.vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.vocabulary))
        self.letters = dict(enumerate(byte_characters()))
        self.find = regex.compile(pattern).findall
        self.packed = [struct.pack("<i", i) for i in range(len(self.vocabulary) + 1)]
        self.most, self.known = cache, {}  # a pre-token's ids as little-endian bytes

    def _learn(self, tokens: list[str]) -> None:
        rest = []
        for t in tokens:
            whole = self.rank.get(t.encode())
            if whole is None:
                rest.append(t)
            else:
                self.known[t] = self.packed[whole]
        as_pieces = [t.encode().decode("latin-1").translate(self.letters) for t in rest]
        for t, ids in zip(rest, self.model.encode(as_pieces, num_threads=1) if rest else [], strict=True):
            self.known[t] = b"".join(map(self.packed.__getitem__, ids))

    def encode(self, text: str) -> np.ndarray:
        tokens = self.find(text)
        distinct = set(tokens)
        new = [t for t in distinct if t not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(distinct)
        self._learn(new)
        return np.frombuffer(b"".join(map(self.known.__getitem__, tokens)), np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(ranks_path: str, pattern: str) -> Codec:
    key = ranks_path, pattern
    if key not in _codecs:
        _codecs[key] = Codec(ranks_path, pattern)
    return _codecs[key]


def _kept(df: DataFrame, *but: str) -> list[str]:
    return [c for c in df.columns if c not in but]


def _schema(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*(F.col(f"`{c}`") for c in columns)).schema)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, ids: str = "ids") -> DataFrame:
    """The array of ids of each text beside the columns in `keep` (all others than text; one named like `ids` is replaced).

    A null or empty text has no ids; repeated rows are encoded each. Long texts are held whole, one Arrow batch at a time. Columns may have any names;
    an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    keep = _kept(df, text, ids) if keep is None else keep

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        found = [codec.encode(t or "") for t in batch.column(len(keep)).to_pylist()]
        at = np.cumsum([0, *map(len, found)])
        values = np.concatenate(found) if found else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists(values.astype(np.int32), at)], [*keep, ids])

    return mapped(df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text")), f, f"{_schema(df, keep)}`{ids}` array<int>")


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None, out: str = "decoded") -> DataFrame:
    """The bytes that the ids stand for (null: none) beside the columns in `keep` (all others than ids). Columns may have any names; an empty table gives an empty result."""
    small_batches(df.sparkSession)
    keep = _kept(df, ids, out) if keep is None else keep

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        column = batch.column(len(keep))
        values, at = np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0))])
        rows = [codec.decode(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], binaries(rows)], [*keep, out])

    return mapped(df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids}`").alias("__ids")), f, f"{_schema(df, keep)}`{out}` binary")
