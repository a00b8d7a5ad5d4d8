import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakspark.functions import aliases as A
from cloakspark.functions import text as T


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(expression.alias("x")).collect()[0][0]


def test_normalize_name(spark):
    for given_, expected in [("  Jane   DOE ", "jane doe"), ("Straße", "strasse"), ("ΟΔΥΣΣΕΥΣ", "οδυσσευσ"), ("ﬁrm", "firm"), ("", "")]:
        assert one(spark, T.normalize_name("t"), t=given_) == expected
    assert one(spark, T.normalize_name(F.lit(None).cast("string"))) is None


def test_cleaning(spark):
    names = {"Isaac Henry - 22463": "Isaac Henry", "  Domonyang   Nelly - 92972  ": "Domonyang Nelly", "Jean-Paul Sartre": "Jean-Paul Sartre", "Alice - Bob": "Alice", "": ""}
    for raw, expected in names.items():
        assert one(spark, T.clean_name("t"), t=raw) == expected
    assert one(spark, T.clean_id(F.lit(520638.0), "double")) == "520638"
    assert one(spark, T.clean_id(F.lit(float("nan")), "double")) is None
    assert one(spark, T.clean_id("t"), t="  ") is None
    assert one(spark, T.curated_pseudonym(F.lit("VND"), F.lit(None).cast("string"))) is None


def test_auto_ids(spark):
    assert one(spark, T.auto_pseudonym(F.lit("PERSON"), F.lit("jane doe"))) == "PSN-AUTO-BC225"
    assert one(spark, T.auto_pseudonym(F.lit("CUSTOM"), F.lit("project nightingale"))) == "CST-AUTO-22CC7"
    assert one(spark, T.auto_pseudonym(F.lit("animal"), F.lit("x"))).startswith("ANI-AUTO-")


def test_recasing(spark):
    for raw, expected in [("Payment - MARY WANJIRU expense", "Payment - Mary Wanjiru expense"), ("INV2024 paid R2D2 A", "INV2024 paid R2D2 A"), ("ÉCOLE ok", "École ok"), ("", "")]:
        assert one(spark, T.recase_uppercase("t"), t=raw) == expected


def test_page_text_and_offsets(spark):
    cases = {"Sup-\nplies": "Supplies", "ﬁnance": "finance", "Acme Supplies - Ltd": "Acme Supplies - Ltd", " a \n b ": "a b", "": "", "  ": "", "x-\n \n": "x-", "-\nab": "ab", "é😀 x-\r\n y": "é😀 xy", "a \x1c b": "a b", "a -\n- b": "a - - b"}
    df = spark.createDataFrame(list(cases.items()), "raw string, expected string")
    for r in df.select("raw", "expected", T.normalize_page_text("raw").alias("plain"), T.page_offsets("raw").alias("o")).collect():
        assert r.plain == r.expected and len(r.o) == len(r.plain)
        for c, at in zip(r.plain, r.o):
            assert r.raw[at] == c or (c == " " and r.raw[at].isspace()) or r.raw[at] in T.LIGATURES


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab-\n ﬁ .é😀", max_size=40))
def test_offsets_lead_back(raw):
    o = T._offsets(raw)
    plain = re.sub(r"\s+", " ", re.sub(r"-\s*\n\s*(?=[^\W_])", "", raw.replace("ﬁ", "fi"))).strip()
    assert len(o) == len(plain) and all(a <= b for a, b in zip(o, o[1:]))
    assert all(raw[i] == c or (c == " " and raw[i].isspace()) or raw[i] == "ﬁ" for i, c in zip(o, plain))


def test_raw_spans(spark):
    df = spark.createDataFrame([([3, 4, 9],)], "o array<int>")
    assert tuple(df.select(T.to_raw_span("o", F.lit(1), F.lit(3)).alias("s")).collect()[0].s) == (4, 10)
    assert tuple(df.select(T.to_raw_span("o", F.lit(2), F.lit(2)).alias("s")).collect()[0].s) == (2, 2)


def test_regex_spans_count_code_points(spark):
    spans = one(spark, T.regex_spans("t", r"[a-z]\d+"), t="😀 a1 b22")
    assert [tuple(s) for s in spans] == [(2, 4, "a1"), (5, 8, "b22")]
    rng = random.Random(3)
    texts = ["".join(rng.choice("a1 😀b") for _ in range(rng.randrange(30))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.regex_spans("t", "[ab]1*").alias("s")).collect():
        assert [tuple(s) for s in r.s] == [(m.start(), m.end(), m.group()) for m in re.finditer("[ab]1*", r.t)]


def test_aliases(spark):
    def forms(name):
        return one(spark, A.aliases("n"), n=name)

    assert forms("A & B & C") == ["A & B & C", "A & B and C", "A and B & C", "A and B and C"]
    assert forms("Co Op Bank") == ["Co Op Bank"] and forms("Ltd") == ["Ltd"] and forms("  ") == []
    assert {"Smith & Co", "Smith and company", "Smith and company."} <= set(forms("Smith & Co"))
    assert all(f.startswith("Thailand ") for f in forms("Thailand Corp"))
    for name in ("Acme Limited", "Smith & Sons Ltd.", "X and Y", "Plain Name"):
        for f in forms(name):
            assert re.fullmatch(A.name_pattern(name) + r"\.?", f, re.I), (name, f)


def test_search_variants_and_names(spark):
    assert "Acme Supplies" in one(spark, T.search_variants("t"), t="Acme Supplies Ltd")
    assert "Thailand Corp" not in " ".join(v for v in one(spark, T.search_variants("t"), t="Thailand & Co") if "Thail&" in v)
    assert one(spark, T.output_base_name("t"), t="a b-ü.x.xlsx") == "a_b-ü_x"
    assert one(spark, T.html_escaped("t"), t="<b>&\"'") == "&lt;b&gt;&amp;&quot;&#x27;"
