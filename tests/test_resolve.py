import random

import pytest

from cloakspark.operators import resolve as R
from cloakspark.operators import splice as S
from cloakspark.operators.detect import COLUMNS
from cloakspark.schemas import DETECTION
from cloakspark.settings import SOURCE_PRIORITY

M, P, C, D = "master list", "pattern match", "custom word", "model"


def spans(spark, *rows):
    """rows: text_id, start, end, source[, score[, type]]"""
    return spark.createDataFrame([(r[0], n, (r[5:] or ("X",))[0], r[1], r[2], float((r[4:] or (0.5,))[0]), "", r[3]) for n, r in enumerate(rows)], DETECTION)


def kept(df):
    return sorted((r.text_id, r.start, r.end, r.source) for r in df.collect())


@pytest.mark.parametrize("given,expected", [
    ([(0, 10, D), (0, 5, D), (8, 15, D)], [(0, 10)]), ([(0, 10, M), (0, 25, D)], [(0, 10)]), ([(0, 15, D), (5, 15, M)], [(5, 15)]),
    ([(0, 10, C), (0, 25, D)], [(0, 10)]), ([(0, 10, P), (0, 25, C)], [(0, 10)]), ([(0, 10, M), (0, 25, P)], [(0, 10)]), ([(0, 5, D), (5, 9, D)], [(0, 5), (5, 9)]),
])
def test_overlaps(spark, given, expected):
    got = kept(R.without_overlaps(spans(spark, *[(1, *g) for g in given])))
    assert [g[1:3] for g in got] == expected


def greedy(rows):
    out = []
    for r in sorted(rows, key=lambda r: (SOURCE_PRIORITY[r[3]], r[1], -r[2])):
        if all(r[2] <= k[1] or r[1] >= k[2] for k in out):
            out.append(r)
    return out


def test_random_overlaps_against_a_plain_loop(spark):
    rng = random.Random(5)
    rows = []
    for t in range(300):
        for _ in range(rng.randrange(9)):
            s = rng.randrange(20)
            rows.append((t, s, s + 1 + rng.randrange(8), rng.choice([M, P, C, D])))
    rows = list(dict.fromkeys(rows))
    want = sorted(k for t in range(300) for k in greedy([r for r in rows if r[0] == t]))
    assert kept(R.without_overlaps(spans(spark, *rows))) == want


def test_best_per_span_and_threshold(spark):
    df = spans(spark, (1, 0, 4, D, 0.45, "A"), (1, 0, 4, D, 0.85, "B"), (1, 0, 5, D, 0.2, "A"), (1, 0, 4, M, 0.85, "C"))
    best = {(r.start, r.end): r.entity_type for r in R.best_per_span(df).collect()}
    assert best == {(0, 4): "B", (0, 5): "A"}  # the earlier of equal scores
    assert R.above(df, 0.45).count() == 3 and R.best_per_span(df).columns == COLUMNS
    assert kept(R.engine(spans(spark, (1, 0, 10, D, 0.40), (1, 0, 5, D, 0.44)), 0.35)) == [(1, 0, 10, D)]


def test_two_stages_differ_from_one(spark):
    model, word = spans(spark, (1, 0, 10, D), (1, 8, 15, D)), spans(spark, (1, 0, 3, C))
    assert kept(R.staged(R.engine(model, 0.1), word)) == [(1, 0, 3, C)]
    assert kept(R.single_pass(model, 0.1, word)) == [(1, 0, 3, C), (1, 8, 15, D)]


def test_splice(spark):
    df = spark.createDataFrame([(1, "aaa NAME bbb NAME ccc"), (2, "😀x y"), (3, "plain"), (4, None)], "text_id long, text string")
    values = spark.createDataFrame([(1, 4, 8, "X"), (1, 13, 17, "X"), (2, 1, 2, "long")], "text_id long, start int, end int, value string")
    assert {r.text_id: r.redacted for r in S.redact(df, values).collect()} == {1: "aaa X bbb X ccc", 2: "😀long y", 3: "plain", 4: None}
    black = {r.text_id: r.redacted for r in S.redact(df, S.blacked_out(values)).collect()}
    assert black[1] == "aaa ████ bbb ████ ccc"


def test_runs(spark):
    runs = [(0, 0, "Hello "), (1, 6, "World"), (2, 11, " and more text")]
    df = spark.createDataFrame([(runs, [(0, 11, "ID")]), (runs, [(8, 13, "ID")]), (runs, None), (runs, [(0, 5, "A"), (6, 8, "B")])], "runs array<struct<run_idx:int,start:int,text:string>>, spans array<struct<start:int,end:int,value:string>>")
    got = [[r["text"] for r in x.new] for x in df.select(S.spliced_runs("runs", "spans").alias("new")).collect()]
    assert got == [["ID", "", " and more text"], ["Hello ", "WoID", "nd more text"], ["Hello ", "World", " and more text"], ["A ", "Brld", " and more text"]]
    box = spark.createDataFrame([((0.0, 0.0, 1.0, 10.0),)], "r struct<x0:double,y0:double,x1:double,y1:double>").select(S.tightened("r").alias("b")).collect()[0].b
    assert (round(box.y0, 6), round(box.y1, 6)) == (1.8, 8.2)
