import unicodedata
from collections import defaultdict

from cloakspark.llm import lookalike as L
from cloakspark.llm import same_look as S

NAMES = [
    (1, "José Anne"), (2, "Jose\u0301 Anne"), (3, "Jose Anne"), (4, "ＪＯＳＥ"), (5, "JOSE"), (6, "Ann​e"), (7, "Anne"), (8, "Аnne"), (9, "ﬁne oﬃce"), (10, "fine office"), (11, "a b"), (12, "a　b"), (13, "a b"), (14, "a-b"),
    (15, None), (16, ""), (17, " ​"), (18, "Юлий"), (19, "Юлий"), (20, "Юлии\u0306"), (21, "anne"), (22, "Anne"), (23, "Anne"), (24, "Ё"), (25, "Ë"), (26, "x" * 20_000), (27, "x" * 20_000 + "⁠"), (7, "Anne"),
]


def form(s):
    return unicodedata.normalize("NFC", s.translate(L.python_table()))


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", 0) for r in rows], "id long, name string, canonical string, form int")


def test_pairs_against_a_plain_form(spark):
    groups = defaultdict(set)
    for i, n in NAMES:
        if n and form(n).strip():
            groups[form(n)].add((i, n))
    want = {(a, b) for g in groups.values() for a, x in g for b, y in g if a < b and x != y}
    got = {tuple(r) for r in S.pairs(table(spark, NAMES)).collect()}
    assert got == want and {(1, 2), (4, 5), (6, 7), (6, 8), (9, 10), (11, 13), (18, 20), (24, 25), (26, 27)} <= got
    assert not {(1, 3), (7, 21), (13, 14)} & got
    assert S.pairs(table(spark, [])).count() == 0


def test_ascii_characters_stay_apart(spark):
    rows = [(i, "q" + chr(c) + "q") for i, c in enumerate(range(0x21, 0x7F))]
    assert S.pairs(table(spark, rows)).count() == 0


def test_unify(spark):
    out = {r.id: r.canonical for r in S.unify(table(spark, [r for r in NAMES if r[0] < 18]), "name").collect()}
    assert out[6] == out[7] == out[8] and out[1] == out[2] != out[3] and out[15] is None and out[16] == "" and out[9] == out[10]


def test_tables():
    single, multi, gone = L.tables()
    assert single["ａ"] == "a" and single[" "] == " " and multi["ﬃ"] == "ffi" and "‍" in gone and single["ё"] == "ë"
    assert not any(k.isascii() for k in [*single, *multi, *gone])
