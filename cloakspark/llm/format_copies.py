"""Copies of a record that differ only in how they are written down.

Two rows are copies if they hold the same words equally often in the pooled text columns, and the same words in the
key column. Each task hashes its rows (`wordhash`), sums the word hashes of a row (order doesn't matter, counts do),
folds rows of equal hash into one and so sends at most one row per layout-free record and chunk into the single
shuffle; a record that makes up a third of all rows is thus a handful of rows there. Wherever rows of equal hash meet,
in the task or after the shuffle, their letters are compared with two pointers that skip what isn't a word, so a
collision of hashes can't merge different records.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import folded, gather, mix, words

#: Signs that don't part a word when they stand within it.
APOSTROPHES = "'‘’ʼ"
CHUNK_ROWS = 100_000
CHUNK_BYTES = 24 << 20


class _Records:
    """The words of a chunk's rows, each row's words put in the order of their hashes."""

    def __init__(self, pooled: Sequence[pa.Array], key: Sequence[pa.Array], joining: str):
        parts = [(words(c, joining), 0) for c in pooled] + [(words(c, joining), 1) for c in key]
        self.n = parts[0][0].n_rows
        base = np.cumsum([0] + [len(w.raw) for w, _ in parts])
        self.raw = np.concatenate([w.raw for w, _ in parts])  # as read: nothing canonical is kept
        begin = np.concatenate([w.begin + b for (w, _), b in zip(parts, base)])
        span = np.concatenate([w.span for w, _ in parts])
        length = np.concatenate([w.length for w, _ in parts])
        row = np.concatenate([w.row for w, _ in parts])
        field = np.concatenate([np.full(len(w.begin), f, np.uint64) for w, f in parts])
        each = [(w.hashes(0, letters), w.hashes(1, letters)) for w, _ in parts for letters in (w.letters,)]
        one, two = (np.concatenate([h[s] for h in each]) for s in (0, 1))
        one, two = mix(one + field * np.uint64(0xA24BAED4963EE407)), mix(two + field * np.uint64(0x9FB21C651E98DF25))
        self.h1, self.h2 = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)
        np.add.at(self.h1, row, one)
        np.add.at(self.h2, row, two)
        order = np.lexsort((one, field, row))
        self.begin, self.span, self.length, self.field = begin[order], span[order], length[order], field[order]
        self.first = np.searchsorted(row[order], np.arange(self.n + 1))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a[i] and b[i] hold the same words: two pointers walk their code points and skip what is no letter."""
        na, nb = self.first[a + 1] - self.first[a], self.first[b + 1] - self.first[b]
        ok = na == nb
        for pointers in (self._words, self._letters):
            at = np.flatnonzero(ok)
            if not len(at):
                break
            bad, pair = pointers(a[at], b[at])
            ok[at[np.unique(pair[bad])]] = False
        return ok

    def _words(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.first[a + 1] - self.first[a]
        x, y = gather(self.first[a], n), gather(self.first[b], n)
        return (self.length[x] != self.length[y]) | (self.field[x] != self.field[y]), np.repeat(np.arange(len(a)), n)

    def _letters(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.first[a + 1] - self.first[a]
        x, y = gather(self.first[a], n), gather(self.first[b], n)
        differ = folded(self.raw, self.begin[x], self.span[x]) != folded(self.raw, self.begin[y], self.span[y])
        return differ, np.repeat(np.repeat(np.arange(len(a)), n), self.length[x])


def _collapse(t: pa.Table, pooled: Sequence[str], key: Sequence[str], joining: str) -> pa.Table:
    """Rows of the same record become one: the least id, the sum of the copies, the hash; sorted by hash."""
    if not t.num_rows:
        return t
    rec = _Records([t[c] for c in pooled], [t[c] for c in key], joining)
    h1, h2 = rec.h1.view(np.int64), rec.h2.view(np.int64)
    ids, n = t["first_id"].to_numpy(), t["n_copies"].to_numpy()
    order = np.lexsort((ids, h2, h1))
    a, b = order[:-1], order[1:]
    starts = np.concatenate([[True], (h1[a] != h1[b]) | (h2[a] != h2[b])])
    run = np.cumsum(starts) - 1
    rep = order[np.flatnonzero(starts)][run]  # the row that each row, in sorted order, is held against
    odd = np.flatnonzero(rep != order)
    odd = odd[~rec.same(order[odd], rep[odd])]
    while len(odd):  # rows of equal hash that hold other words: records of their own, settled among themselves
        lead = np.concatenate([[True], run[odd[1:]] != run[odd[:-1]]])
        rep[odd] = order[odd[np.flatnonzero(lead)]][np.cumsum(lead) - 1]
        rest = odd[rep[odd] != order[odd]]
        odd = rest[~rec.same(order[rest], rep[rest])]
    copies = np.zeros(t.num_rows, np.int64)
    np.add.at(copies, rep, n[order])
    keep = np.flatnonzero(copies)
    keep = keep[np.lexsort((ids[keep], h2[keep], h1[keep]))]
    out = t.take(pa.array(keep))
    out = out.set_column(out.schema.get_field_index("n_copies"), "n_copies", pa.array(copies[keep]))
    for name, h in (("h1", h1), ("h2", h2)):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(h[keep]))
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def collapse_copies(df: DataFrame, id_col: str, pooled: Sequence[str], key: Sequence[str] = (), joining: str = APOSTROPHES) -> DataFrame:
    """One row per record: `first_id` (least id) and `n_copies` (rows), plus the text columns of one of its rows.

    Words are runs of letters and digits whatever the case (simple case folding); order and column of a word among
    `pooled` don't matter, the `key` columns are held apart. Null counts as no words, so a row without any word is a
    copy of every other such row; an empty table gives an empty table; repeated rows, ids included, count as often
    as they occur; other columns of `df`, whatever their names, are ignored; texts are read whole.
    """
    names = [*pooled, *key]
    inner = [f"t{i}" for i in range(len(names))]
    pool_in, key_in = inner[: len(pooled)], inner[len(pooled) :]
    schema = "h1 long, h2 long, first_id long, n_copies long, " + ", ".join(f"{c} string" for c in inner)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches):
            yield from _collapse(t, pool_in, key_in, joining).to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last run may go on in the next chunk
        for t in _chunks(batches):
            t = _collapse(t if held is None else pa.concat_tables([held, t]).combine_chunks(), pool_in, key_in, joining)
            same = pc.and_(pc.equal(t["h1"], t["h1"][-1]), pc.equal(t["h2"], t["h2"][-1]))
            held, t = t.filter(same), t.filter(pc.invert(same))
            yield from t.to_batches()
        if held is not None:
            yield from held.to_batches()

    zero = F.lit(0).cast("long")
    rows = df.select(zero.alias("h1"), zero.alias("h2"), F.col(id_col).cast("long").alias("first_id"), F.lit(1).cast("long").alias("n_copies"), *(F.col(c).cast("string").alias(i) for c, i in zip(names, inner)))
    reps = rows.mapInArrow(local, schema).repartition("h1").sortWithinPartitions("h1", "h2", "first_id")
    return reps.mapInArrow(merge, schema).select("first_id", "n_copies", *(F.col(i).alias(c) for c, i in zip(names, inner)))


def found(sheet: DataFrame) -> DataFrame:
    """`first_row_id, n_copies` of each record of the master sheets that is written down twice or more."""
    named = sheet.where("name is not null and name rlike '(?U)\\\\S'")
    out = collapse_copies(named, "row_id", ["category", "name"], ["internal_id"])
    return out.where("n_copies >= 2").select(F.col("first_id").alias("first_row_id"), "n_copies")
