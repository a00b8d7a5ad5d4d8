from cloakspark.llm import canon_map as M
from cloakspark.llm import name_variants as N
from cloakspark.llm.linewords import frequent, lines_of
from cloakspark.llm.namerules import Lines, Near, Rules, distance, nickname_table, parse, shortens

NICK = [("Bob", "Robert"), ("Becky", "Rebecca"), ("Théo", "Théophile"), ("Kit", "Christopher"), ("X", "A1"), ("X", "B1")]
NAMES = "id long, name string, entity_type string, trusted boolean, key string, class int"


def nick(spark):
    return spark.createDataFrame(NICK, "short_form string, full_form string")


def classes(spark, rows):
    df = spark.createDataFrame([(i, n, e, t, "k", 0) for i, n, e, t in rows], NAMES)
    out = {}
    for r in N.link_classes(df, nick(spark)).collect():
        out.setdefault(r["class"], set()).add(r.id)
    return {frozenset(s) for s in out.values()}


def test_rules():
    nicks = nickname_table(NICK)
    rules = Rules(nicks, Lines(["power", "light", "supplies", "office", "seed", "bank", "caterers", "printers"]))
    key = lambda n, e=None: parse(n, e, rules).key
    same = [["Dr. Bob Kanevo", "KANEVO, Robert", "robert  kanevo", "Ｒｏｂｅｒｔ Kanev0", "Rob​ert Kanevo", "Mr Robrt Kanevo - 123"], ["Robert T. Kanevo", "Kanevo Bob T", "kanevo, robert t."]]
    for group in same:
        assert len({key(n, "PERSON") for n in group}) == 1
    assert key("Robert T. Kanevo", "PERSON") != key("Robert S. Kanevo", "PERSON") != key("Robert Kanevo", "PERSON")
    firms = ["The Dewe Shabipe Power & Light Ltd", "DEWE-SHABIPE POWER AND LIGHT", "Power and Light Limited, Dewe Shabipe", "Deweshabipe (Power & Light) plc.", "Attn: Dewe Shabipe Pwr. & Lihgt Co (Zamboro)"]
    assert len({key(n, "ORGANIZATION") for n in firms}) == 1
    assert key("Dewe Shabipe Supplies", "ORGANIZATION") != key("Dewe Shabipe Office Supplies", "ORGANIZATION") != key("Dewe Shabipe Seed Bank", "ORGANIZATION")
    assert key("Gikija Roshu (Cat", "ORGANIZATION") == key("Gikija Roshu Caterers Ltd", "ORGANIZATION")
    assert parse("Dewe Shabipe Printers Ltd", None, rules).kind == "O" and parse("Bob Kanevo", None, rules).kind == "P"
    assert key("Игнат Тисушеко", "PERSON") == key("ИГНАТ ТИСУШЕКО", "PERSON") and nicks.get("x") is None
    assert distance("abcd", "abdc") == 1 and distance("", "ab") == 2


def test_classes(spark):
    rows = [
        (1, "Robert Kanevosuti", "PERSON", True), (2, "Bob Kanevosuti", "PERSON", False), (3, "R. Kanevosuti", "PERSON", False), (4, "Robert Kanevossuti", "PERSON", False), (5, "KANEVOSUTY, Robert", "PERSON", False), (6, "Rebecca Kanevozuti", "PERSON", False),
        (7, "Christopher Kanevosuti", "PERSON", True), (8, "Robert T Kanevosuti", "PERSON", False), (9, "C Kanevosuti", "PERSON", False), (10, "Dewe Shabipe Motors Ltd", "ORGANIZATION", True), (11, "Dewe Shbaipe Motors", "ORGANIZATION", False), (12, "Dewe Shabipe Seed Bank", "ORGANIZATION", True),
        (13, None, "PERSON", False), (14, " ​", "PERSON", False), (15, "***", None, False), (16, "***", None, False), (17, "Dewe Shabipe Motors", None, False), (2, "Bob Kanevosuti", "PERSON", False),
        (18, "Pafebo Motors Ltd", "ORGANIZATION", True), (19, "Tiloju Motors", "ORGANIZATION", True),
    ]
    got = classes(spark, rows)
    assert {frozenset({1, 2, 3, 4, 5}), frozenset({7, 9}), frozenset({8}), frozenset({6}), frozenset({10, 11, 17}), frozenset({12}), frozenset({15, 16}), frozenset({18}), frozenset({19})} == got
    assert classes(spark, []) == set()


def test_an_initial_of_two_people_is_neither(spark):
    got = classes(spark, [(1, "Robert Kanevosuti", "PERSON", True), (2, "Rebecca Kanevosuti", "PERSON", True), (3, "R Kanevosuti", "PERSON", False), (4, "R. KANEVOSUTI", "PERSON", False)])
    assert got == {frozenset({1}), frozenset({2}), frozenset({3, 4})}


def test_pairs_of_a_class(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (2, "a")], "id long, class string")
    assert {tuple(r) for r in N.pairs(df).collect()} == {(1, 2), (1, 3), (2, 3)}


CANON = [(1, "PERSON", "Robert Kanevosuti", "STF-1"), (2, "PERSON", "Rebecca Kanevosuti", None), (3, "ORGANIZATION", "Dewe Shabipe Motors Ltd", "VND-1"), (4, "ORGANIZATION", "Dewe Shabipe Seed Bank", "VND-2"), (5, "ORGANIZATION", "Zotade Buthe Insurance Ltd", "VND-3"), (6, None, None, None)]
# the firms that words of lines of business are learned from
CANON += [(10 + 10 * i + k, "ORGANIZATION", f"{core} {line}", None) for k, core in enumerate(("Pafebo", "Tiloju", "Gunaki")) for i, line in enumerate(("Motors", "Seed Bank", "Insurance", "Printers"))]


def canon(spark, rows=CANON):
    return spark.createDataFrame([(i, e, None if n is None else n.lower(), p, "c", n) for i, e, n, p in rows], "canon_id long, entity_type string, norm_name string, pseudonym string, category string, display_name string")


def mapped(spark, values, rows=CANON, **kw):
    df = spark.createDataFrame([(n, e, 1) for n, e in values], "name string, entity_type string, canon_id int")
    return {r.name: r.canon_id for r in M.map_to_list(df, canon(spark, rows), nick(spark), **kw).collect()}


def test_list(spark):
    values = {
        "bob kanevosuti": 1, "Dr. KANEVOSUTI Robert": 1, "Robert Kanevosuit (Korvale)": 1, "B. Kanevosuti": 0, "R. Kanevosuti": 0, "Becky Kanevousti": 2, "Christopher Kanevosuti": 0,
        "Dewe Shabipe Mtrs.": 3, "motors limited, dewe shabipe": 3, "Dewe Shabipe Printers": 0, "Zotade Buthe": 5, "Zotade Buthe In": 5, "Dewe Shabipe": 0, "balance b/f": 0, "***": 0, "x" * 5000: 0,
    }
    kinds = {n: "ORGANIZATION" if n[:2] in ("De", "mo", "Zo") else "PERSON" for n in values}
    want = values
    got = mapped(spark, [*kinds.items(), (None, "PERSON"), (" ", "PERSON"), *kinds.items()])
    assert got == want == mapped(spark, kinds.items(), max_sent=0)
    assert mapped(spark, [("Bob Kanevosuti", "PERSON")], []) == {"Bob Kanevosuti": 0} and mapped(spark, []) == {}


def test_found(spark):
    x = spark.createDataFrame([(1, "Bob Kanevosuti", "PERSON", True), (2, "Bob Kanevosuti", "PERSON", False), (3, "none such", "PERSON", True), (4, None, "PERSON", True), (5, " ", "PERSON", True), (1, "Bob Kanevosuti", "PERSON", True), (6, "x", None, None)], "xwalk_id long, original_name string, entity_type string, auto boolean")
    assert {tuple(r) for r in M.found(x, canon(spark), nick(spark)).collect()} == {(1, 1), (3, 0)}


def test_two_errors_in_a_long_word(spark):
    rows = [(1, "Humphrey Rumunofobu", "PERSON", True), (2, "Humphrey Rymunofohu", "PERSON", False), (3, "Edward Tugizaseeshe", "PERSON", True), (4, "Edward Tugziaseshe", "PERSON", False), (5, "Edward Tugizasobshe", "PERSON", False), (6, "Anna Kanevo", "PERSON", True), (7, "Anna Kenova", "PERSON", False), (8, "H. Rumanofobe", "PERSON", False)]
    assert classes(spark, rows) == {frozenset({1, 2, 8}), frozenset({3, 4, 5}), frozenset({6}), frozenset({7})}


def test_a_long_chain_is_one_class(spark):
    word, rows = list("bdfghlmn"), []
    for n in range(24):  # each spelling one error from the next, which more names have
        rows += [(1000 * n + k, f"Robert {''.join(word)}", "PERSON", False) for k in range(n + 1)]
        word[n % 8] = "aeou"[n // 8] if n % 2 else "qtbr"[n // 8]
    assert len(classes(spark, rows)) == 1


def test_a_key_turned_away_by_the_centre_finds_the_next(spark):
    rows = [(k, "Robert Xmob", "PERSON", True) for k in range(4)] + [(10, "Robert Mobu", "PERSON", False), (11, "Robert Mobu", "PERSON", False), (12, "Robert Mobe", "PERSON", False)]
    assert classes(spark, rows) == {frozenset({0, 1, 2, 3}), frozenset({10, 11, 12})}


def test_words_are_learned_from_names(spark):
    firms = [f"{core} {line}{form}" for core in ("Pafe Bo", "Tilo Ju", "Guna Ki", "Dewe") for line in ("Water Works", "Wtr Wks", "Trust") for form in ("", " Ltd")] + ["The Bo Ju Trust (Zamboro)", None, ""]
    df = spark.createDataFrame([(f,) for f in firms], "name string")
    assert frequent(df) == {"water", "works", "wtr", "wks", "trust"}
    assert lines_of({"water", "works", "wtr", "trust"}, {"wks", "zamboro"}) == (["trust", "water", "works"], ["wks", "wtr"])
    assert frequent(df.limit(0)) == set()


def test_short_forms():
    lines = Lines(["construction", "consulting", "printers", "partners", "services"], ["ptnrs"])
    want = {"const": "construction", "cnslt": "consulting", "ptrs": "printers", "ptnrs": "partners", "svcs": "services", "sore": None, "seve": None, "s": None}
    assert {t: lines.word(t, True) for t in want} == want
    assert lines.word("svcs", False) is None and lines.word("ptnrs", False) == "partners" and lines.word("sevrices", False) == "services"
    assert shortens("intl", "international") and not shortens("international", "international") and not shortens("", "bank")


def test_near_is_the_same_as_trying_every_word():
    words = ["printers", "partners", "telecommunications", "bank", "power"]
    near = Near(words)
    for typed in ("printes", "prniters", "partnerss", "telecomunicatons", "telcommunication", "powr", "bank", "bnk", "x" * 5000, ""):
        want = {w: d for w in words if len(w) >= 5 and len(typed) >= 4 and abs(len(w) - len(typed)) <= 1 and (d := distance(typed, w)) <= (2 if len(w) >= 10 else 1)}
        assert near(typed) == want, typed


def test_spellings_between_two(spark):
    """A spelling between two established ones goes to the better only; where none is established it joins them."""
    many = lambda word, start, n: [(start + k, f"{given} {word}", "PERSON", True) for k, given in enumerate(("Robert", "Anna", "Zora", "Ugo", "Pia")[:n])]
    rows = many("Kanevosu", 100, 5) + many("Kanevola", 200, 4) + [(1, "Robert Kanevola", "PERSON", False), (2, "Robert Kanevoa", "PERSON", False)]
    got = classes(spark, rows)
    assert {100, 2} <= next(c for c in got if 100 in c) or {200, 2} <= next(c for c in got if 200 in c)
    assert next(c for c in got if 100 in c).isdisjoint(next(c for c in got if 200 in c))
    word, chain = "bdfghlmn", []
    for n in range(14):
        chain.append((n, f"Robert {word}", "PERSON", False))
        word = word[: n % 8] + "aeou"[n // 8] + word[n % 8 + 1 :]
    assert classes(spark, chain) == {frozenset(range(14))}


def test_a_hint_decides_between_people_that_an_initial_fits(spark):
    rows = [(1, "Robert Kanevosuti", "PERSON", True, None), (2, "Rebecca Kanevosuti", "PERSON", True, None), (3, "R Kanevosuti", "PERSON", False, "Becky Kanevosuti"), (4, "R. Kanevosuti", "PERSON", False, "Anna Other"), (5, "A. Else", "PERSON", False, "Robert Kanevosuti")]
    df = spark.createDataFrame(rows, "id long, name string, entity_type string, trusted boolean, hint string")
    by = {r.id: r["class"] for r in N.link_classes(df, nick(spark), hint="hint").collect()}
    assert by[2] == by[3] == by[4] != by[1] != by[5]


def test_pairs_of_a_hot_class_are_made_in_blocks(spark):
    df = spark.createDataFrame([(i, "a") for i in range(50)] + [(99, "b")], "id long, class string")
    assert {tuple(r) for r in N.paired(df, "class", block=7).collect()} == {(a, b) for a in range(50) for b in range(a + 1, 50)}
