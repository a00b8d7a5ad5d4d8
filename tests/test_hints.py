"""Hints in the memo flow against a loop over all pairs; SQL has no such ratio."""

from difflib import SequenceMatcher

import pytest

from cloakspark.operators import assign as A
from cloakspark.operators.masterlist import master_map
from cloakspark.plans.queries import QUERIES

CUSTOMERS = [(1, "Michael Mugo", 5.0), (2, "Micheal Mugo", -1.0), (3, "Michaela Mugo", 2.0), (4, "Zotade Buthe", -3.0), (5, "Anna Kanevo", 1.0), (6, "Anne Kanevo", 1.0), (7, "Anni Kanevo", -1.0), (8, "Anny Kanevo", 1.0)]


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame(CUSTOMERS, "c_custkey long, c_name string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    orders = [(10 * k + n, k, "1-URGENT") for k, _, _ in CUSTOMERS for n in range(2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def nearest(name):
    best = None
    for key, other, balance in CUSTOMERS:
        if balance >= 0 and abs(len(other) - len(name)) <= 3:
            score = SequenceMatcher(None, name.lower(), other.lower()).ratio()
            if score >= 0.84 and (best is None or score > best[0]):
                best = (score, f"{other} (STF-{key}, {score * 100:.0f}% match)")
    return best[1] if best else ""


def test_memo_queries_against_all_pairs(spark, tables):
    want = {name: nearest(name) if balance < 0 else "" for _, name, balance in CUSTOMERS}
    assert sum(x != "" for x in want.values()) == 2 and want["Anni Kanevo"].startswith("Anna Kanevo")
    assert {r["Original name"]: r["Possible match"] for r in QUERIES["crosswalk_view"](spark, tables).collect()} == want
    counts = QUERIES["flag_counts"](spark, tables).collect()[0]
    assert (counts.n, counts.n_flagged, counts.n_suggested) == (8, 3, 2)


def test_equal_likeness_goes_by_the_order_of_the_list(spark):
    rows = [(7, "Abcdefghik Ltd", "VND-7"), (3, "Abcdefghil Ltd", "VND-3"), (5, "Abcdefghim Limited", "VND-5"), (4, "Abcdefghin Ltd", "VND-4"), (9, "Abcdefghil Ltd", "VND-3")]
    m = master_map(spark.createDataFrame([(o, "Vendor", n, "ORGANIZATION", p) for o, n, p in rows], "row_ord long, category string, name string, entity_type string, pseudonym string"))
    ordered = [r.norm_name for r in m.orderBy("cand_ord").collect()]
    assert ordered[:4] == ["abcdefghil ltd", "abcdefghin ltd", "abcdefghim limited", "abcdefghik ltd"] and ordered[4].startswith("abcdefghil ")
    asked = A.distinct_names(spark.createDataFrame([("ORGANIZATION", "Abcdefghix Ltd", 1)], "entity_type string, text string, n int"), ["n"])
    assert A.assign(asked, m).collect()[0].suggested_pseudonym == "VND-3"


def test_hints_against_all_pairs_of_few_letters(spark, monkeypatch):
    """Where the first candidate of the highest bound doesn't reach it, and where it does: then the others aren't listed."""
    import random

    from cloakspark.operators import fuzzy

    listings, best_met = [], fuzzy._best_met
    monkeypatch.setattr(fuzzy, "_best_met", lambda lists, *rest: listings.append(1) or best_met(lists, *rest))
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(4, 11)))
    listed, asked = [(i, w) for i, w in enumerate(dict.fromkeys(word() for _ in range(150)))], sorted({word() for _ in range(120)})
    candidates = spark.createDataFrame([("PERSON", w, f"P-{i}", w, i) for i, w in listed], "entity_type string, norm_name string, pseudonym string, display_name string, cand_ord long")
    got = lambda words: {r.norm_name: (r.suggested_name, r.suggested_score) for r in fuzzy.hints(spark.createDataFrame([("PERSON", w) for w in words], "entity_type string, norm_name string"), candidates, 0.6, 3).collect()}
    want = {}
    for w in asked:
        best = max(((SequenceMatcher(None, w, o).ratio(), -i, o) for i, o in listed if abs(len(w) - len(o)) <= 3), default=(0,))
        if best[0] >= 0.6:
            want[w] = (best[2], best[0])
    assert got(asked) == want and len(listings) == 2
    own = listed[0][1]
    assert got([own]) == {own: (own, 1.0)} and len(listings) == 3


def test_few_names_are_sent_to_the_list(spark):
    """The list's forms aren't shuffled for a few names, and the pairs are the same."""
    from cloakspark.operators import fuzzy

    listed = spark.createDataFrame([("PERSON", f"anna kanev{c}", i) for i, c in enumerate("abcdefgh")], "entity_type string, norm_name string, cand_ord long")
    asked = spark.createDataFrame([("PERSON", "anna kanevz"), ("PERSON", "anna kanevaa")], "entity_type string, norm_name string")
    few, many = fuzzy._met(asked, listed, 3, few=True), fuzzy._met(asked, listed, 3)
    assert sorted(map(tuple, few.distinct().collect())) == sorted(map(tuple, many.distinct().collect())) != []
    assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString() and "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
