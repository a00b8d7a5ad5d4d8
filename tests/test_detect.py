import random

import numpy as np

from cloakspark.operators import detect as D


def texts(spark, *ts):
    return spark.createDataFrame(list(enumerate(ts)), "text_id long, text string")


def names(spark, *pairs):
    return spark.createDataFrame(list(pairs), "entity_type string, key string")


def spans(df):
    return sorted((r.text_id, r.start, r.end, r.entity_type, r.text) for r in df.collect())


def test_dictionary_both_ways(spark):
    t = texts(spark, "Paid Acme Limited in full", "acme", "Acme LTD.", "xAcme Ltd", None, "  ", "İx Acme Ltd, Acme Ltd", "A-B a-b A", "😀 acme ltd")
    n = names(spark, ("ORGANIZATION", "Acme Ltd"), ("ORGANIZATION", "Acme Limited"), ("PERSON", "acme"), ("ORGANIZATION", "a-b"), ("PERSON", "A"), ("PERSON", " "), ("PERSON", "ltd."))
    a, b = spans(D.dictionary(t, n, strategy="automaton")), spans(D.dictionary(t, n, strategy="join"))
    assert a == b
    assert (0, 5, 17, "ORGANIZATION", "Acme Limited") in a and (8, 2, 10, "ORGANIZATION", "acme ltd") in a
    assert not [s for s in a if s[0] == 3] and (6, 13, 21, "ORGANIZATION", "Acme Ltd") in a


def test_dictionary_random(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab &.") for _ in range(rng.randrange(1, 6)))
    keys = sorted({k.strip() for k in (word() for _ in range(60)) if k.strip()})
    ts = ["".join(rng.choice("ab &._") for _ in range(rng.randrange(40))) for _ in range(150)]
    n = names(spark, *[("PERSON", k) for k in keys])
    got = spans(D.dictionary(texts(spark, *ts), n, strategy="automaton"))
    is_word = lambda c: c.isalnum() or c == "_"
    want = sorted((i, s, s + len(k), "PERSON", t[s : s + len(k)]) for i, t in enumerate(ts) if t.strip() for k in keys for s in range(len(t)) if t.startswith(k, s) and not (s and is_word(t[s - 1])) and not (s + len(k) < len(t) and is_word(t[s + len(k)])))
    assert got == want and spans(D.dictionary(texts(spark, *ts), n, strategy="join")) == want


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "text_id long, text string")
    n = names(spark, ("PERSON", "a"))
    assert D.dictionary(none, n).count() == 0 and D.dictionary(texts(spark, "a b"), n.limit(0)).count() == 0
    assert D.patterns(texts(spark, "x@y.zz"), ()).count() == 0 and D.custom_words(texts(spark, "a"), [" ", ""]).count() == 0


def test_patterns(spark):
    t = texts(spark, "mail jane.doe+x@mail.example.org now", "see https://example.org/report.", "www.example.org/a?b=1, or http://x.yz", "a@b", "@x.com a@b.c1", "x.y@z.com.", "(https://h.example:8080/p;q=1)")
    got = {(r.text_id, r.entity_type): r.text for r in D.patterns(t).collect()}
    assert got[0, "EMAIL_ADDRESS"] == "jane.doe+x@mail.example.org" and (0, "URL") not in got
    assert got[1, "URL"] == "https://example.org/report"
    assert got[5, "EMAIL_ADDRESS"] == "x.y@z.com" and got[6, "URL"] == "https://h.example:8080/p;q=1"
    assert (3, "EMAIL_ADDRESS") not in got and D.patterns(t, ("URL",)).where("text_id = 2").count() == 2


def test_custom_words(spark):
    t = texts(spark, "category cat Cat", "project   NIGHTINGALE\nproject", "Case 4471-B!", "été Été")
    got = spans(D.custom_words(t, ["cat", "Project Nightingale", " ", "Case 4471-B", "été", "cat"]))
    assert [s[:3] for s in got] == [(0, 9, 12), (0, 13, 16), (1, 0, 21), (2, 0, 11), (3, 0, 3), (3, 4, 7)]
    assert {s[3] for s in got} == {"CUSTOM"}


def test_plugin_sees_both_cases(spark):
    def analyze(text):
        return [("PERSON", i, i + 4, 0.8) for i in [text.find("Mary")] if i >= 0]

    got = D.plugin(texts(spark, "paid MARY", "paid Mary", "x"), analyze).collect()
    assert sorted((r.text_id, r.seq, r.text, r.source) for r in got) == [(0, 2000, "MARY", "model"), (1, 1000, "Mary", "model")]
    assert D.plugin(texts(spark, "Mary"), analyze, ["ORGANIZATION"]).count() == 0


def test_both_strategies_agree_on_every_letter(spark):
    """Lower case and word characters come from one side only, whatever the release of Unicode of either."""
    sample = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    t = texts(spark, *("".join(f"{c}ab {c} ab{c} " for c in sample[a : a + 500]) for a in range(0, len(sample), 500)))
    n = names(spark, ("PERSON", "ab"), ("ORGANIZATION", "ß"), ("PERSON", "İx"))
    key = lambda df: df.groupBy("text_id", "start", "end", "entity_type").count()
    a, b = key(D.dictionary(t, n, strategy="automaton")), key(D.dictionary(t, n, strategy="join"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 < a.count()


def test_join_of_keys_that_begin_alike(spark):
    """Keys of one beginning don't meet every text with it: a text's stretches are joined with whole keys, without a window over its words."""
    keys = [f"to Customer#{i:09d}" for i in range(300)] + [f"Customer#{i:09d}" for i in range(300)] + ["to Customer", "to", "#"]
    t = texts(spark, *(f"Paid to Customer#{i:09d} by 1-URGENT / Customer#{i + 299:09d}" for i in range(50)), "to Customer#0000000011", "", None)
    n = names(spark, *[("PERSON", k) for k in keys], ("ORGANIZATION", "TO"))
    joined = D.dictionary(t, n, strategy="join")
    got = spans(joined)
    assert got == spans(D.dictionary(t, n, strategy="automaton")) and (3, 5, 26, "PERSON", "to Customer#000000003") in got and len([s for s in got if s[0] < 50]) == 50 * 5 + 1
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "(key#" in plan.split("Join Inner, ")[1].split("\n")[0] and "Window" not in plan


def test_join_with_a_crowded_filter(spark):
    """The filter may let more pass, never less: a hit of any length, in texts of any length."""
    rng = random.Random(11)
    keys = sorted({"".join(rng.choice("abé😀 -") for _ in range(n)).strip() or "a" for n in (1, 2, 3, 5, 6, 7, 62, 63, 64, 65, 200) for _ in range(8)})
    ts = [" ".join(rng.choices(keys, k=30)) for _ in range(20)] + [keys[-1], "x" * 70_000 + " " + keys[3]]
    n = names(spark, *[("PERSON", k) for k in keys])
    assert spans(D.dictionary(texts(spark, *ts), n, strategy="join")) == spans(D.dictionary(texts(spark, *ts), n, strategy="automaton"))
    sieve = D._Filter(3, 0)
    sieve.add(keys)
    which, start, size = (x.tolist() for x in sieve.spans(["", keys[-1]], np.zeros(0x110001, bool)))
    assert (1, 0, len(keys[-1])) in set(zip(which, start, size))


def test_a_list_alone_is_settled_in_its_pass(spark):
    """The same as all hits settled afterwards, and nothing is shuffled."""
    from cloakspark.operators.resolve import engine

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab é&.") for _ in range(rng.randrange(1, 9))).strip() or "Σ"
    n = names(spark, *{(rng.choice(["PERSON", "ORGANIZATION", "AGENCY"]), word()) for _ in range(150)}, ("ORGANIZATION", "😀 ltd"), ("PERSON", "Paid to " * 30 + "x"))
    t = texts(spark, *("".join(rng.choice("AbÉab é&._") for _ in range(rng.randrange(60))) for _ in range(200)), "by 😀 LTD.", "paid to " * 30 + "X", None, " ", "x" * 70_000 + " a")
    row = lambda df: sorted(tuple(r[c] for c in D.COLUMNS) for r in df.collect())
    got = D.settled_dictionary(t, n)
    assert row(got) == row(engine(D.dictionary(t, n, strategy="automaton"), 0.35)) != []
    assert D.settled_dictionary(t, n, max_bytes=1000) is None and D.settled_dictionary(t, n.limit(0)).count() == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
