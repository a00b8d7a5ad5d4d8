"""Words of many texts at once: bytes run through a skip-and-fold table into polynomial hashes, never into strings.

A text column is decoded once per batch to code points. One table lookup per code point says whether it is skipped
(0) or which folded code point it stands for; runs of kept code points are words, and each word is hashed as a
polynomial in its folded code points modulo 2**64. Nothing is ever built per row or per word in Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """For each code point 0 if it is neither letter nor digit, else the code point it folds to (simple case folding)."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x323B0):
        ch = chr(c)
        if ch.isalnum():
            low = ch.casefold()
            low = low if len(low) == 1 else ch.lower()
            out[c] = ord(low) if len(low) == 1 and low.isalnum() else c
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(seed: int, n: int) -> np.ndarray:
    out = np.full(n, _BASE[seed] | np.uint64(1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(seed: int, n: int) -> np.ndarray:
    return _powers(seed, max(1024, 1 << (int(n) - 1).bit_length()))


def codepoints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all rows one after another, where each row starts and the last ends). Null is like empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])) if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if len(raw) == 0 or int(raw.max()) < 128:
        return raw.astype(np.uint32), off
    try:
        cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that aren't UTF-8: each row by itself, bad bytes as U+FFFD
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
        return np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return cps, starts[off]


@dataclass
class Words:
    """Words of a batch in reading order, as places in the code points that were read; no folded text is kept.

    `raw` holds all code points, `begin` and `span` where a word stands in them, signs that are skipped within it
    included, `length` how many letters it has, `start` how many letters stand before it, `row` its row.
    """

    raw: np.ndarray
    begin: np.ndarray
    span: np.ndarray
    length: np.ndarray
    row: np.ndarray
    n_rows: int
    once: np.ndarray | None = None  # the code points through the table, let go of as letters are first made

    @property
    def start(self) -> np.ndarray:
        return np.cumsum(self.length) - self.length

    @property
    def letters(self) -> np.ndarray:
        """The folded letters of all words one after another, made when asked for: whatever the table doesn't skip is in a word."""
        fold, self.once = fold_table()[self.raw] if self.once is None else self.once, None
        return fold[fold > 0]

    def hashes(self, seed: int = 0, letters: np.ndarray | None = None) -> np.ndarray:
        """One 64-bit hash of each word."""
        if not len(self.begin):
            return np.zeros(0, np.uint64)
        letters, start = self.letters if letters is None else letters, self.start
        at = np.arange(len(letters), dtype=np.int64) - np.repeat(start, self.length)
        term = (letters.astype(np.uint64) + np.uint64(0x51)) * powers(seed, int(self.length.max()))[at]
        return mix(np.add.reduceat(term, start) ^ (self.length.astype(np.uint64) * _BASE[1 - seed]))

    def first_of_row(self) -> np.ndarray:
        """The number of the first word of each row, and the number of all words at the end."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))


def folded(raw: np.ndarray, begin: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The letters of slices of code points through the table, what it skips left out."""
    fold = fold_table()[raw[gather(begin, span)]]
    return fold[fold > 0]


def words(col: pa.Array, joining: str = "") -> Words:
    """Words of each row. A sign of `joining`, or several, between two letters or digits are skipped without parting the word."""
    cps, off = codepoints(col)
    fold = fold_table()[cps]
    kept = fold > 0
    inside = kept  # letters, and signs that don't part a word
    if joining and len(cps) > 2:
        sign = np.isin(cps, np.array([ord(x) for x in joining], np.uint32))
        at = np.flatnonzero(sign)
        if len(at):
            # the nearest other sign or letter before and after each
            place = np.arange(len(cps))
            last = np.maximum.accumulate(np.where(sign, -1, place))[at]
            next_ = np.minimum.accumulate(np.where(sign, len(cps), place)[::-1])[::-1][at]
            row = np.searchsorted(off, at, side="right")
            own = (last >= off[row - 1]) & (next_ < off[row])  # at the very edge of a row it touches another row's letter
            skip = at[own & kept[np.maximum(last, 0)] & kept[np.minimum(next_, len(cps) - 1)]]
            inside = kept.copy()
            inside[skip] = True
    edge = np.zeros(len(inside) + 1, bool)
    edge[off[off <= len(inside)]] = True  # a row begins or ends here
    begin = np.flatnonzero(inside & np.concatenate([[True], edge[1:-1] | ~inside[:-1]])) if len(inside) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & np.concatenate([edge[1:-1] | ~inside[1:], [True]])) if len(inside) else begin
    span = end + 1 - begin
    length = span
    if inside is not kept:
        count = np.concatenate([[0], np.cumsum(kept)])
        length = count[end + 1] - count[begin]
    return Words(cps, begin, span, length, np.searchsorted(off, begin, side="right") - 1, len(off) - 1, fold)


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions of several slices one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    return np.arange(total, dtype=np.int64) - np.repeat(begin, length) + np.repeat(start, length)
