"""Counts of a text's words, lines and characters, for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import _SPACE, Words, mix, span

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _among(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _among(SYMBOLS)
_KINDS = {
    "upper": _among(bytes(range(65, 91))), "lower": _among(bytes(range(97, 123))), "digit": _among(bytes(range(48, 58))),
    "bang": _among(b"!?"), "pipe": _among(b"|"), "other_symbol": _among(b"#*$%&<>@^~=_+{}[]\\/"), "stop": _among(b".,;:"),
    "wide": _among(bytes(range(128, 256))),
}


def _per_text(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mark) + 1, np.int64)
    np.cumsum(mark, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of entries equal to another of the same owner, and of all but one of each such set."""
    key = mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E6C63D0876A9A35))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.concatenate([[False], same]) if len(key) else np.zeros(0, bool)
    any_ = again | np.concatenate([same, [False]]) if len(key) else again
    out = np.zeros((2, len(key)), bool)
    out[0, order], out[1, order] = any_, again
    return out[0], out[1]


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """By text: n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    docs, n = len(offsets) - 1, len(data)
    words = Words(data, offsets)
    body = ~_SPACE[data]
    lead = (data & 0xC0) != 0x80
    out = {"n_words": words.count.astype(np.int64), "word_chars": _per_text(body & lead, offsets), "n_symbols": _per_text(_SYMBOL[data], offsets)}

    start = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    start = start[start < n]
    end = np.concatenate([start[1:], [n]]) if len(start) else start
    end = end - (data[end - 1] == 10) if len(end) else end
    filled = np.zeros(n + 1, np.int64)
    np.cumsum(body, out=filled[1:])
    has = filled[end] > filled[start]
    start, end = start[has], end[has]
    owner = np.searchsorted(offsets, start, "right") - 1
    _, again = _repeated(span(words.sums, start, end), owner)
    out["n_lines"] = np.bincount(owner, minlength=docs)
    out["n_dup_lines"] = np.bincount(owner[again], minlength=docs)

    h, left = words.hash, words.first[1:][words.doc] - np.arange(len(words.hash))
    at = np.flatnonzero(left >= 3)
    three = mix(mix(h[at] * np.uint64(3) + h[at + 1]) * np.uint64(5) + h[at + 2]) if len(at) else np.zeros(0, np.uint64)
    twice, _ = _repeated(three, words.doc[at])
    mark = np.zeros(len(h), bool)
    for j in range(3):
        mark[at[twice] + j] = True
    out["n_repeat_words"] = np.bincount(words.doc[mark], minlength=docs)
    return out


FEATURES = ["words_log", "word_length", "symbols", "dup_lines", "repeats", "words_per_line", "distinct", "shouting", *_KINDS]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text (see FEATURES), most of them shares between 0 and 1; a text without words has zeros."""
    s = statistics(data, offsets)
    docs = len(offsets) - 1
    words = Words(data, offsets)
    _, again = _repeated(words.hash, words.doc)
    n, chars, lines = (np.maximum(s[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    kinds = {k: _per_text(m[data], offsets) for k, m in _KINDS.items()}
    columns = [np.log1p(s["n_words"]), np.minimum(s["word_chars"] / n, 30) / 10, s["n_symbols"] / chars, s["n_dup_lines"] / lines, s["n_repeat_words"] / n,
               np.log1p(s["n_words"] / lines), 1 - np.bincount(words.doc[again], minlength=docs) / n, kinds["upper"] / np.maximum(kinds["upper"] + kinds["lower"], 1),
               *(v / chars for v in kinds.values())]
    return np.where((s["n_words"] > 0)[:, None], np.stack(columns, axis=1), 0.0)
