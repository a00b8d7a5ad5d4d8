"""Words of lines of business, learned from the names of organisations themselves.

A word such as the one for insurers or printers stands behind many different first words; the words that make up a name
of its own stand behind one or two. So for each word the different first words before it are counted, over all names,
and a word that follows at least `share` of all first words (and three at least) is one of a line of business. Names are
counted once for each first word, so one firm typed many times counts once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread
from .namerules import COMPANY_FORMS, SMALL_WORDS, Lines, plain, tokens

#: Stands for any word in the counts, so that first words are counted in the same pass.
_ANY = ""
_BRACKETS = re.compile(r"\([^)]*\)?")


def _first_and_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen = set()
        for name in b.column(0).to_pylist():
            words = [t for t, _ in tokens(re.sub(r"['’‘`ʼ]", "", _BRACKETS.sub(" ", plain(name)))) if t not in SMALL_WORDS and t not in COMPANY_FORMS]
            if words:
                seen.add((words[0], _ANY))
                seen.update((words[0], w) for w in words[1:] if len(w) > 1)
        pairs = list(zip(*seen)) if seen else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()) for p in pairs], ["first", "word"])


def frequent(names: DataFrame, share: float = 0.005, least: int = 3) -> set[str]:
    """The words of `name` that follow at least `share` of all first words. Null names are ignored; an empty table has none.

    What comes to the driver is bounded by the share: names of w words on average have w / share such words at most.
    """
    rows = names.select(F.col("name").cast("string").alias("name")).where("name is not null")
    pairs = spread(rows).mapInArrow(_first_and_rest, "first string, word string").distinct()
    counts = materialise(pairs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    firsts = counts.where(F.col("word") == _ANY).first()
    if firsts is None:
        return set()
    return {r[0] for r in counts.where((F.col("word") != _ANY) & (F.col("n") >= share * firsts["n"])).select("word").collect()}


def lines_of(words: set[str], typed: set[str] | None = None) -> tuple[list[str], list[str]]:
    """(words in full, words in short) of learned words: one that shortens a longer learned one is in short.

    With `typed`, words learned elsewhere, these too are taken as short forms where they shorten one in full.
    """
    full: list[str] = []
    for w in sorted(words, key=lambda w: (-len(w), w)):
        if w not in Lines(full, [w]).short:
            full.append(w)
    short = sorted(Lines(full, (words | (typed or set())) - set(full)).short)
    return sorted(full), short
