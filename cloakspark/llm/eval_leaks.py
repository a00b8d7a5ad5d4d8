"""Evaluation passages inside training texts.

Every window of `n_words` consecutive words of a text is embedded by a CGK random walk (Chakraborty, Goldenberg,
Koucky: a pointer walks along the window; each step writes the word under the pointer and moves on or stays by a
shared random function of step and word), which turns edit distance between windows into Hamming distance between
walks. Bit-sampling LSH then takes a few places of the walk as a signature; the walk and the sampling are repeated with
other randomness until windows within `max_edits` meet with probability `recall`. Windows of equal signature are
verified exactly on their letters. Equal windows (`max_edits` 0) have equal walks, so one repetition meets all.

The walk is cut short where nothing can meet any more: sampled places come in rising order and a window is dropped as
soon as its signature so far is no item's. That is exact, since all sampled places must agree in the end.

Texts are streamed once, in the tasks that read them; nothing of the corpus is shuffled but the pairs found. The items
are held-out material of bounded size: they are sent to the tasks in blocks of at most `block_words` words, one pass
per block, so what a task holds is bounded whatever the number of items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordhash import Words, fold_table, mix, words

CHUNK_BYTES = 8 << 20
MAX_REPETITIONS = 64
_BITS = 20


def edit_distance_at_most(a: list, b: list, limit: int) -> bool:
    """Whether the edit distance between two sequences (insert, delete, replace) is within the limit; banded."""
    if abs(len(a) - len(b)) > limit:
        return False
    if limit == 0:
        return a == b
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        if min(row) > limit:
            return False
    return row[-1] <= limit


class _Walk:
    """One repetition: the random function of the walk and the places that are sampled."""

    def __init__(self, n_words: int, samples: int, seed: int, from_first: bool):
        rng = np.random.default_rng(seed)
        self.n = n_words
        self.step = rng.integers(0, 2**63, 3 * n_words, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.salt = np.uint64(rng.integers(1, 2**62))
        # equal windows agree in every place, so there the first may always be one: what it drops needs no walk
        places = rng.choice(np.arange(int(from_first), 3 * n_words), samples - int(from_first), replace=False).tolist()
        self.places = sorted([0, *places] if from_first else places)

    def signatures(self, h: np.ndarray, starts: np.ndarray, tries: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(windows that are left, their signatures, all signatures so far by sampled place if tries is None)."""
        at, sig = np.zeros(len(starts), np.int64), np.full(len(starts), self.salt)
        left, seen, sampled = starts, [], 0
        for j in range(self.places[-1] + 1):
            inside = at < self.n
            word = np.where(inside, h[np.minimum(left + at, len(h) - 1)], np.uint64(0))
            if j == self.places[sampled]:
                sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + word)
                if tries is None:
                    seen.append(sig)
                else:
                    ok = tries[sampled][(sig >> np.uint64(65 - len(tries[sampled]).bit_length())).astype(np.int64)]
                    left, at, sig, word = left[ok], at[ok], sig[ok], word[ok]
                sampled += 1
            at = at + ((mix(word + self.step[j]) >> np.uint64(63)).astype(np.int64))
        return left, sig, seen


@lru_cache(maxsize=32)
def _repetitions(n_words: int, samples: int, max_edits: int, recall: float, seed: int) -> tuple[int, int]:
    """How many places to sample and how often to repeat until random windows with `max_edits` random edits between them
    meet with the recall asked for. Where that takes too many repetitions, fewer places are sampled, one at last.

    Measured with the very walks that will be used, on windows whose edits lie anywhere: what meets often and what seldom
    does is averaged as the recall is, not as the chance of one repetition.
    """
    if max_edits == 0:
        return samples, 1
    rng, n_pairs = np.random.default_rng(seed), 1000
    left, right = [], []
    for _ in range(n_pairs):
        a = rng.integers(1, 2**62, n_words + 2 * max_edits).astype(np.uint64)
        b = a.copy()
        for _ in range(max_edits):
            p, kind = int(rng.integers(0, n_words)), int(rng.integers(0, 3))
            new = rng.integers(1, 2**62, 1).astype(np.uint64)
            b = np.concatenate([b[:p], new if kind else b[:0], b[p + (kind != 1) :], rng.integers(1, 2**62, 1).astype(np.uint64)])
        left.append(a[:n_words])
        right.append(b[:n_words])
    h, half = np.concatenate([*left, *right]), np.arange(n_pairs) * n_words
    met = np.zeros(n_pairs, bool)
    for r in range(MAX_REPETITIONS):
        sig = _Walk(n_words, samples, seed + 104729 * r, False).signatures(h, np.concatenate([half, half + n_pairs * n_words]), None)[1]
        met |= sig[:n_pairs] == sig[n_pairs:]
        if met.mean() >= recall:
            return samples, r + 1
    if samples == 1:
        raise ValueError("windows with so many edits hardly share a word; take fewer edits or longer windows")
    return _repetitions(n_words, samples - 1, max_edits, recall, seed)


def _starts(w: Words, n: int) -> np.ndarray:
    """The first word of every window that lies within one row."""
    if len(w.row) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(w.row[: len(w.row) - n + 1] == w.row[n - 1 :])


class _Index:
    """The signatures of a block of items, by repetition."""

    def __init__(self, ids: list[int], texts: list[str], n: int, samples: int, repetitions: int, max_edits: int, seed: int):
        self.n, self.max_edits, self.ids = n, max_edits, ids
        self.w = words(pa.array(texts, pa.string()))
        self.h = self.w.hashes()
        starts = _starts(self.w, n)
        self.walks = [_Walk(n, samples, seed + 104729 * r, max_edits == 0) for r in range(repetitions)]
        self.tries, self.by_sig = [], []
        for walk in self.walks:
            left, sig, seen = walk.signatures(self.h, starts, None)
            bits = _BITS if repetitions <= 8 else _BITS - 2  # 1 MB or 256 KB a sampled place, 80 MB in all at most
            maps = [np.zeros(1 << bits, bool) for _ in seen]
            for m, s in zip(maps, seen):
                m[(s >> np.uint64(64 - bits)).astype(np.int64)] = True
            by = defaultdict(list)
            for s, a in zip(sig.tolist(), left.tolist()):
                by[s].append(a)
            self.tries.append(maps)
            self.by_sig.append(dict(by))

    def letters(self, w: Words, first: int) -> list[bytes]:
        table, places = fold_table(), slice(first, first + self.n)
        return [table[w.raw[s : s + k]].tobytes() for s, k in zip(w.begin[places].tolist(), w.span[places].tolist())]  # no sign is skipped within a word here

    def pairs(self, col: pa.Array) -> list[tuple[int, int]]:
        """(row, item id) of the rows of a column and the items that share a window."""
        w = words(col)
        starts = _starts(w, self.n)
        if not len(starts) or not len(self.h):
            return []
        h, out = w.hashes(), set()
        for walk, tries, by in zip(self.walks, self.tries, self.by_sig):
            left, sig, _ = walk.signatures(h, starts, tries)
            for a, s in zip(left.tolist(), sig.tolist()):
                mine = None
                for b in by.get(s, ()):
                    pair = (int(w.row[a]), self.ids[int(self.w.row[b])])
                    if pair not in out:
                        mine = mine or self.letters(w, a)
                        if edit_distance_at_most(mine, self.letters(self.w, b), self.max_edits):
                            out.add(pair)
        return list(out)


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text",
           n_words: int = 12, max_edits: int = 0, samples: int = 5, recall: float = 0.99, block_words: int = 500_000, seed: int = 17) -> DataFrame:
    """`doc_id, item_id` of each text and item with a window of `n_words` consecutive words within `max_edits` word edits.

    A word is a run of letters and digits, whatever the case; all else parts words. Each pair comes once. Null and
    empty texts and items, and those of fewer than `n_words` words, pair with nothing; an empty table on either side
    gives an empty table; texts are read whole, whatever their length; rows that come twice give the same pairs;
    other columns are ignored.
    """
    spark = docs.sparkSession
    samples, repetitions = _repetitions(n_words, samples, max_edits, recall, seed)
    schema = "doc_id long, item_id long"

    def block(rows: list) -> DataFrame:
        ids, texts = [int(r[0]) for r in rows], [r[1] for r in rows]
        held = spark.sparkContext.broadcast((ids, texts))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _Index(*held.value, n_words, samples, repetitions, max_edits, seed)
            for b in batches:
                step = max(1, int(b.num_rows * CHUNK_BYTES / max(b.nbytes, 1)))
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    found = index.pairs(part.column(1))
                    if found:
                        rows, hits = zip(*found)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(hits, pa.int64())], ["doc_id", "item_id"])

        return docs.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"cast(`{text}` as string) as text").where("doc_id is not null and text is not null").mapInArrow(scan, schema)

    blocks, held, size = [], [], 0
    wanted = items.selectExpr(f"cast(`{item_id}` as long)", f"cast(`{item_text}` as string)").where(f"`{item_id}` is not null and `{item_text}` is not null")
    for row in wanted.toLocalIterator():
        held.append(row)
        size += len(row[1]) // 2 + 1
        if size >= block_words:
            blocks.append(block(held))
            held, size = [], 0
    if held or not blocks:
        blocks.append(block(held))
    return reduce(DataFrame.union, blocks).distinct()
