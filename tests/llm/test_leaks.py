import random

from cloakspark.llm import eval_leaks as E

from test_words import plain


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, item_text string, text string, doc_id int")


def brute(d, i, n, edits=0):
    windows = lambda t: [w[k : k + n] for w in [plain(t)] for k in range(len(w) - n + 1)]
    return {(a, b) for a, t, *_ in d for b, u, *_ in i if any(E.edit_distance_at_most(x, y, edits) for x in windows(t) for y in windows(u))}


def leaked(spark, d, i, **kw):
    return {tuple(r) for r in E.leaked(docs(spark, d), items(spark, i), **kw).collect()}


def test_twelve_words(spark):
    words = [f"word{k}" for k in range(40)]
    item = " ".join(words[:20])
    i = [(1, item, "", 0), (2, " ".join(words[10:22]), "", 0), (3, " ".join(words[:11]), "", 0), (4, None, "", 0), (5, "", "", 0)]
    d = [(1, "x, " + "--".join(w.upper() for w in words[3:15]) + " y", ""), (2, " ".join(words[3:14]), ""), (3, " ".join(words[9:30]), ""), (4, None, ""), (5, "", ""), (6, " ".join(words[0:6] + ["z"] + words[6:12]), "")]
    assert leaked(spark, d, i) == {(1, 1), (3, 2)} == brute(d, i, 12)
    assert leaked(spark, d + d, i + i) == {(1, 1), (3, 2)}


def test_empty_tables(spark):
    d, i = [(1, "a " * 30, "")], [(1, "a " * 30, "", 0)]
    assert leaked(spark, [], i) == set() == leaked(spark, d, []) and leaked(spark, d, i) == {(1, 1)}


def test_random_texts_in_blocks(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("abcde") for _ in range(n))
    d = [(k, text(rng.randrange(60)), "") for k in range(80)]
    i = [(k, text(rng.randrange(15)), "", 0) for k in range(60)]
    want = brute(d, i, 5)
    assert want and leaked(spark, d, i, n_words=5) == want == leaked(spark, d, i, n_words=5, block_words=40)


def test_a_very_long_text(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    assert leaked(spark, [(1, long, "")], [(7, " ".join(f"W{k}" for k in range(199_980, 199_995)), "", 0)]) == {(1, 7)}


def test_edits_reach_their_recall(spark):
    rng = random.Random(6)
    base = [[f"v{rng.randrange(10**6)}" for _ in range(12)] for _ in range(150)]
    i = [(k, " ".join(b), "", 0) for k, b in enumerate(base)]
    d = []
    for k, b in enumerate(base):
        b = list(b)
        b[rng.randrange(12)] = "changed"
        d.append((k, "before " + " ".join(b) + " after", ""))
    got, want = leaked(spark, d, i, max_edits=1, samples=4, recall=0.95), brute(d, i, 12, 1)
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 150


def test_edit_distance():
    assert E.edit_distance_at_most(list("abc"), list("abc"), 0) and not E.edit_distance_at_most(list("abc"), list("abd"), 0)
    assert E.edit_distance_at_most(list("kitten"), list("sitting"), 3) and not E.edit_distance_at_most(list("kitten"), list("sitting"), 2)
