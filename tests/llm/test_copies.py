import random
from collections import defaultdict

import numpy as np
import pytest

from cloakspark.llm import format_copies as C

from test_words import plain

SCHEMA = "row_id long, category string, internal_id string, name string, h1 string, n_copies int"


def brute(rows):
    groups = defaultdict(list)
    for i, c, d, n, *_ in rows:
        if n is not None and n.strip():
            groups[tuple(sorted(plain(c, C.APOSTROPHES) + plain(n, C.APOSTROPHES))), tuple(sorted(plain(d, C.APOSTROPHES)))].append(i)
    return {(min(g), len(g)) for g in groups.values() if len(g) > 1}


def found(spark, rows):
    return {tuple(r) for r in C.found(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_layouts(spark):
    rows = [
        (5, "Vendor", "12", "O'Brien & Sons Ltd", "x", 9), (3, "vendor ", "#12", "ltd SONS o’brien", None, 9), (4, "O'Brien Sons", "12.", "Vendor Ltd", "", 9), (6, "Vendor", "12", "O Brien & Sons Ltd", "", 9),
        (7, "Vendor", None, "A A B", "", 9), (8, "Vendor", "", "A B", "", 9), (9, "Vendor", " - ", "b a a", "", 9), (10, None, "1", "x", "", 9), (11, None, "1", None, "", 9), (12, None, "1", "  ", "", 9), (13, "", "1", "X!", "", 9),
        (17, "Vendor", "3", "D''Lo Sulo", "", 9), (18, "Vendor", "3", "d’lo sulo", "", 9), (19, "Vendor", "3", "D' 'Lo Sulo", "", 9), (20, "Vendor", "3", "'D'Lo' Sulo", "", 9),
        (14, "Staff", "a b", "é", "", 9), (15, "Staff", "b A", "É", "", 9), (16, "Staff", "ab", "É", "", 9),
    ]
    assert found(spark, rows) == {(3, 3), (7, 2), (10, 2), (14, 2), (17, 3)} == brute(rows)


def test_empty_and_repeated(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "a", "b", "c", "", 1)] * 3) == {(1, 3)}


def test_random_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["a", "b", "A", "'", "é", " ", "-", "1"]) for _ in range(rng.randrange(6)))
    rows = [(i, rng.choice([None, word()]), rng.choice([None, "", "1", "1 2", "2,1"]), rng.choice([None, word(), word()]), "", 0) for i in range(4000)]
    assert found(spark, rows) == brute(rows)


def test_one_record_is_a_third_of_all_rows(spark):
    hot = [(i, "Vendor", "7", ("Hot  name" if i % 2 else "NAME, hot") + "." * (i % 50), "", 0) for i in range(9000)]
    rest = [(i, "Vendor", str(i), "cold", "", 0) for i in range(9000, 27000)]
    assert found(spark, hot + rest) == {(0, 9000)}


def test_long_text(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    assert found(spark, [(1, "", "", long, "", 0), (2, "", "", long.upper() + "!", "", 0), (3, "", "", long + " w", "", 0)]) == {(1, 2)}


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_colliding_hashes_merge_nothing(monkeypatch, chunk):
    """With every hash equal only the comparison of letters tells records apart."""
    import pyarrow as pa

    monkeypatch.setattr(C._Records, "__init__", _blind(C._Records.__init__))
    names = ["a b", "B a", "a c", "c  a", "a b b", "ab", "a  B"]
    t = pa.table({"h1": [0] * 7, "h2": [0] * 7, "first_id": list(range(7)), "n_copies": [1] * 7, "t0": names})
    out = C._collapse(t, ["t0"], [], "")
    assert sorted(zip(out["first_id"].to_pylist(), out["n_copies"].to_pylist())) == [(0, 3), (2, 2), (4, 1), (5, 1)]


def _blind(init):
    def run(self, *args):
        init(self, *args)
        self.h1, self.h2 = np.zeros(self.n, np.uint64), np.zeros(self.n, np.uint64)

    return run
