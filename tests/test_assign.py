from difflib import SequenceMatcher

from cloakspark.operators import assign as A
from cloakspark.operators import fuzzy

MAP = "entity_type string, norm_name string, pseudonym string, category string, display_name string, cand_ord long"


def master(spark, *rows):
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], MAP)


def named(spark, *rows):
    return A.distinct_names(spark.createDataFrame([(e, t, n) for n, (e, t) in enumerate(rows)], "entity_type string, text string, n int"), ["n"])


def test_curated_and_made_up(spark):
    m = master(spark, ("PERSON", "brian thuo", "STF-91345", "Staff", "Brian Thuo"))
    got = {r.norm_name: r for r in A.assign(named(spark, ("PERSON", "brian  thuo"), ("PERSON", "Jane Doe"), ("PERSON", "JANE   doe"), ("CUSTOM", "Project Nightingale")), m).collect()}
    assert got["brian thuo"].pseudonym == "STF-91345" and not got["brian thuo"].auto and got["brian thuo"].category == "Staff"
    assert got["jane doe"].pseudonym == "PSN-AUTO-BC225" and got["jane doe"].auto and got["jane doe"].original_name == "Jane Doe"
    assert got["project nightingale"].pseudonym == "CST-AUTO-22CC7" and len(got) == 3


def test_hints(spark):
    m = master(spark, ("PERSON", "michael mugo", "STF-1", "Staff", "Michael Mugo"), ("ORGANIZATION", "co", "VND-1", "Vendor", "Co"), ("PERSON", "diet", "STF-2", "Staff", "Diet"))
    got = {r.norm_name: r for r in A.assign(named(spark, ("PERSON", "Micheal Mugo"), ("ORGANIZATION", "Micheal Mugo"), ("ORGANIZATION", "Company"), ("PERSON", "tide")), m).where("entity_type = 'PERSON' or norm_name = 'company'").collect()}
    assert round(got["micheal mugo"].suggested_score, 4) == 0.9167 and got["micheal mugo"].suggested_pseudonym == "STF-1" and got["micheal mugo"].auto
    assert got["company"].suggested_name is None and got["tide"].suggested_name is None


def test_hints_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randrange(4, 12))).strip() or "a"
    cands, asked = sorted({word() for _ in range(150)}), sorted({word() for _ in range(80)})
    m = master(spark, *[("PERSON", c, f"P{i}", "Staff", c) for i, c in enumerate(cands)])
    n = spark.createDataFrame([("PERSON", a) for a in asked], "entity_type string, norm_name string")
    for block in (1000, 40):
        got = {r.norm_name: (r.suggested_name, r.suggested_score) for r in fuzzy.hints(n, m, 0.7, block=block).collect()}
        want = {}
        for a in asked:
            best = None
            for c in cands:
                if abs(len(a) - len(c)) <= 3 and (s := SequenceMatcher(None, a, c).ratio()) >= 0.7 and (best is None or s > best[1]):
                    best = (c, s)
            if best:
                want[a] = best
        assert got == want


def test_crosswalk_order_collisions_counts(spark):
    m = master(spark, ("PERSON", "b", "STF-1", "Staff", "B"))
    done = A.assign(named(spark, ("PERSON", "z"), ("PERSON", "B"), ("PERSON", "a")), m, with_hints=False)
    rows = A.crosswalk(done).collect()
    assert [r.auto for r in rows] == [False, True, True] and rows[1].pseudonym < rows[2].pseudonym
    c = A.flag_counts(done).collect()[0]
    assert (c.n, c.n_flagged, c.n_suggested) == (3, 2, 0)
    twice = done.selectExpr("norm_name", "auto", "'X' as pseudonym")
    assert A.collisions(twice).collect()[0].n_names == 2


def test_empty(spark):
    none = spark.createDataFrame([], "entity_type string, text string, n int")
    assert A.assign(A.distinct_names(none, ["n"]), None).count() == 0
    assert fuzzy.hints(spark.createDataFrame([("PERSON", "x")], "entity_type string, norm_name string"), master(spark, ("PERSON", "x", "P", "S", "x")).limit(0)).count() == 0


def test_hints_among_many_names_alike(spark):
    """Numbered names have very many candidates; only those a letter away are met, and of equal likeness the first in the list is given, whatever its bound."""
    number = lambda k: f"customer#{k:09d}"
    cands = [number(k) for k in range(0, 3000, 7)] + ["to " + number(k) for k in range(1, 3000, 70)] + ["xcustomer#000000005", "customer#00000000"]
    m = master(spark, *[("PERSON", c, f"P{i}", "Staff", c) for i, c in enumerate(cands)], ("ORGANIZATION", number(1), "O", "Vendor", "o"))
    asked = [number(k) for k in range(1, 3000, 210)] + ["customer#999999999", "ab", "a"]
    n = spark.createDataFrame([("PERSON", a) for a in asked], "entity_type string, norm_name string")
    want = {}
    for a in asked:
        scores = [(SequenceMatcher(None, a, c).ratio(), -i) for i, c in enumerate(cands) if abs(len(a) - len(c)) <= 3]
        if scores and max(scores)[0] >= 0.84:
            want[a] = (cands[-max(scores)[1]], max(scores)[0])
    for block in (10_000, 100):
        assert {r.norm_name: (r.suggested_name, r.suggested_score) for r in fuzzy.hints(n, m, 0.84, block=block).collect()} == want
    listed = m.select("entity_type", "norm_name", "cand_ord")
    near = {r.norm_name: list(r.rest) for r in fuzzy._near(n, listed, 0.84, 3, {"PERSON": [17, 18, 19, 21]}).collect()}
    assert near[number(1)] == [] and near["customer#999999999"] == [17, 18, 19, 21]
