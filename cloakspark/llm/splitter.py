"""Texts over a token limit, cut into pieces at natural boundaries with a fixed overlap.

Recursive bisection: a stretch of more than `limit - overlap` tokens is cut at the strongest boundary near its
midpoint, each part again while it is too long, and in the end every piece but the first is extended back by `overlap`
tokens. Boundaries, strongest first: paragraph, line, sentence, word, sign; a run without any is cut between tokens,
never within a character. A text needs no other text, so this is one narrow pass without a shuffle; words are counted
once per task in a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import encoder, vocabulary_path, word_pattern

KINDS = ("token", "sign", "word", "sentence", "line", "paragraph")
_BLANKS = regex.compile(r"\s+")
_SENTENCE = regex.compile(r"[.!?…。！？｡।؟]+[\p{Pe}\p{Pf}\"']*(?=\s|$)|[。！？｡]+[\p{Pe}\p{Pf}]*")
_BREAK = regex.compile(r"\r\n|[\n\r\v\f\x85  ]")
_TABLE_WORDS = 400_000
COLUMNS = "doc_id long, piece_no int, char_start long, char_end long, n_tokens int, n_shared int, boundary string, piece string"


class Counts(dict):
    """Tokens of a word; forgets all when it has grown to its bound."""

    def __init__(self, path: str):
        super().__init__()
        self.enc = encoder(path)

    def __missing__(self, word: str) -> int:
        if len(self) >= _TABLE_WORDS:
            self.clear()
        n = self[word] = len(self.enc.encode_ordinary(word))
        return n


class _Text:
    """One text: its words with their places in characters and in tokens, and what stands between them."""

    def __init__(self, text: str, words: list[str], counts: Counts):
        self.text, self.words, self.counts = text, words, counts
        self.char = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        self.token = np.concatenate([[0], np.cumsum(np.fromiter(map(counts.__getitem__, words), np.int64, len(words)))])
        self.total = int(self.token[-1])

    def boundaries(self) -> None:
        """Strength of the boundary before each word."""
        self.strength = np.ones(len(self.char), np.int8)
        ends = {m.end() for m in _SENTENCE.finditer(self.text)}
        at, kind = list(ends), [3] * len(ends)
        for m in _BLANKS.finditer(self.text):  # the cut is where the paragraph, line, sentence or word ends, before the blanks
            lines = len(_BREAK.findall(m.group()))
            at.append(m.start())
            kind.append(5 if lines > 1 else 4 if lines else 3 if m.start() in ends else 2)
        if at:
            at, kind = np.array(at), np.array(kind, np.int8)
            word = np.searchsorted(self.char, at)
            real = self.char[word] == at
            np.maximum.at(self.strength, word[real], kind[real])

    def inside(self, token: int) -> tuple[int, int]:
        """(character, token) of the last place at or before a token that is no middle of a character."""
        k = int(np.searchsorted(self.token, token, side="right")) - 1
        if self.token[k] == token or k >= len(self.words):
            return int(self.char[k]), int(self.token[k])
        ids = self.counts.enc.encode_ordinary(self.words[k])
        ends = np.cumsum([len(self.counts.enc.decode_single_token_bytes(i)) for i in ids[: token - int(self.token[k])]])
        raw = self.words[k].encode()
        for n in range(len(ends), 0, -1):
            e = int(ends[n - 1])
            if e >= len(raw) or raw[e] & 0xC0 != 0x80:
                return int(self.char[k]) + len(raw[:e].decode()), int(self.token[k]) + n
        return int(self.char[k]), int(self.token[k])

    def cut(self, lo: int, hi: int) -> tuple[int, int, int]:
        """(token, character, strength) of the strongest boundary near the midpoint of a stretch of tokens."""
        mid, quarter = (lo + hi) / 2, (hi - lo) / 4
        for a, b in ((lo + quarter, hi - quarter), (lo, hi)):
            i, j = np.searchsorted(self.token, a, side="right"), np.searchsorted(self.token, b, side="left")
            if i < j:
                s = self.strength[i:j]
                best = np.flatnonzero(s == s.max())
                k = int(i + best[np.argmin(np.abs(self.token[i:j][best] - mid))])
                return int(self.token[k]), int(self.char[k]), int(self.strength[k])
        char, token = self.inside(int(mid))
        if not lo < token < hi:  # one character of many tokens around the midpoint
            for t in range(int(mid) + 1, hi):
                char, token = self.inside(t)
                if lo < token < hi:
                    break
            else:
                return hi, -1, 0
        return token, char, 0

    def size(self, start: int, end: int) -> int:
        """Tokens of a piece encoded by itself; only its two edges can differ from the whole text's."""
        count = self.counts.enc.encode_ordinary
        i = int(np.searchsorted(self.char, start, side="left"))
        j = int(np.searchsorted(self.char, end, side="right")) - 1
        if self.char[j] != end or i >= j:
            return len(count(self.text[start:end]))
        n = 0
        if self.char[i] != start:
            i = min(i + 1, j)
            n = len(count(self.text[start : self.char[i]]))
            if i == j:
                return n
        while j > i and self.words[j - 1].isspace():
            j -= 1
        tail = self.text[self.char[j] : end]
        return n + int(self.token[j] - self.token[i]) + (len(count(tail)) if tail else 0)


def pieces_of(text: str, limit: int, overlap: int, counts: Counts) -> list[tuple[int, int, int, int, int]]:
    """(start, end, tokens, shared tokens, strength of the cut) of each piece of one text."""
    if not text:
        return []
    t = _Text(text, word_pattern().findall(text), counts)
    if t.total <= limit:
        return [(0, len(text), t.total, 0, 5)]
    t.boundaries()
    out, todo = [], [(0, t.total, 0, len(text), 5)]
    while todo:
        lo, hi, a, b, strength = todo.pop()
        start, token = t.inside(lo - overlap) if lo > overlap else (0, 0)
        small = hi - lo <= limit - overlap
        n = t.size(start, b) if small else 0
        if small and n <= limit:
            out.append((start, b, n, lo - token, strength))
            continue
        k, c, s = t.cut(lo, hi)
        if c <= a or c >= b:  # a single character can't be cut
            out.append((start, b, t.size(start, b), lo - token, strength))
            continue
        todo += [(k, hi, c, b, s), (lo, k, a, c, strength)]
    return out


def split_oversized(docs: DataFrame, limit: int = 512, overlap: int = 64, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row per piece: `doc_id, piece_no, char_start, char_end, n_tokens, n_shared, boundary, piece`.

    `n_tokens` is the size of the piece encoded by itself and at most `limit`; `char_start` and `char_end` are places in
    the whole text in code points; `n_shared` is how many of the whole text's tokens the piece shares with the one before:
    `overlap`, or the few more it takes not to begin within a character, or all of them if fewer stand before;
    `boundary` is the kind of place at which its own part begins. The pieces without what they share give the text
    again, so nothing is lost. A text within the limit is one piece; null and empty texts have none; blank ones are
    text; an empty table gives an empty table; repeated rows give repeated pieces; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    path = path or vocabulary_path()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(path)
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            size = 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for no, (start, end, n, shared, strength) in enumerate(pieces_of(text, limit, overlap, counts)):
                    for col, x in zip(rows, (i, no, start, end, n, shared, KINDS[strength] if no else "start", text[start:end])):
                        col.append(x)
                    size += end - start
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)
                    rows, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.where("text is not null and text <> ''").mapInArrow(split, COLUMNS)
