from collections import Counter

import pytest
from pyspark.sql import functions as F

from cloakspark.operators import detect
from cloakspark.operators.masterlist import master_map
from cloakspark.plans import flows, views

ROWS = "row_ord long, category string, name string, entity_type string, pseudonym string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(0, "Staff", "Jane Doe", "PERSON", "STF-91345"), (1, "Vendor", "Acme Ltd", "ORGANIZATION", "VND-1"), (2, "Staff", "No Id", "PERSON", None)], ROWS)


def test_cells(spark, rows):
    df = spark.createDataFrame([(0, "John and JANE  doe", "y", 1), (1, "jane doe, acme limited", "no id", 2), (2, None, "plain", 3), (3, "jane doe, acme limited", "", 4)], "row_id long, a string, b string, n int")
    result = flows.cells(df, flows.documents_detector(rows), master_map(rows), ["a", "b", "missing"])
    got = {r.row_id: r for r in result.redacted.collect()}
    assert got[1].a == "STF-91345, VND-1" and got[1].b.startswith("PSN-AUTO-") and got[1].changed == ["a", "b"]
    assert got[0].a == "John and JANE  doe" and got[2].a is None and got[2].b == "plain" and got[3].n == 4 and got[3].a == "STF-91345, VND-1"
    counts = views.scan_counts(result.findings).collect()[0]
    assert (counts.entity_count, counts.cell_count) == (5, 3)
    assert {r.pseudonym for r in result.crosswalk.where("not auto").collect()} == {"STF-91345", "VND-1"}


def test_each_text_is_analysed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def detector(texts):
        def analyze(t):
            seen.add(1)
            return [("PERSON", 0, 4, 0.9)] if t.startswith("John") else []

        return detect.plugin(texts, analyze)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["John paid", "John paid", "no name", "John paid", "no name"])], "row_id long, notes string")
    long = flows.unpivot(df, ["notes"])
    assert flows.distinct_texts(flows.with_text_ids(long)).count() == 2
    found = flows.cells(df, detector, None).findings
    assert sorted(r.row_id for r in found.collect()) == [0, 1, 3] and seen.value <= 4


def test_text_columns_and_routing(spark):
    df = spark.sql("select 'a' as Payee, 1 as Amount, timestamp'2024-01-01' as Date")
    assert flows.text_columns(df) == ["Payee"]
    assert [flows.flow_of(f) for f in ("a.XLSX", "b.xls", "c.pdf", "d.docx")] == ["cells", "cells", "pages", "blocks"]
    with pytest.raises(ValueError):
        flows.flow_of("x.txt")
    assert flows.unpivot(df.withColumn("row_id", F.lit(0)), ["zz"]).count() == 0


def test_pages(spark):
    units = spark.createDataFrame([(1, 0, "Acme Sup-\nplies invoice a@b.example"), (1, 1, "none"), (2, 0, "Jane Doe Enterprises invoice"), (2, 1, "  "), (3, 0, None)], "doc_id long, unit_idx int, text string")
    words = ["Acme Supplies", "Jane Doe Enterprises", "Doe Enterprises"]
    r = flows.pages(units, words)
    got = {(x.doc_id, x.unit_idx): x.redacted for x in r.redacted.collect()}
    assert got[1, 0].startswith("CST-AUTO-") and " invoice EML-AUTO-" in got[1, 0] and got[1, 1] == "none" and got[3, 0] is None
    assert [x.text for x in r.findings.where("doc_id = 2").collect()] == ["Jane Doe Enterprises"]
    black = {(x.doc_id, x.unit_idx): x.redacted for x in flows.pages(units, words, flows.BLACKOUT).redacted.collect()}
    assert black[2, 0] == "█" * 20 + " invoice" and flows.pages(units, words, flows.BLACKOUT).crosswalk.count() == 3
    assert views.findings_of_units(r.findings).where("Page = 1").count() == 3


def test_blocks(spark, rows):
    units = spark.createDataFrame([(1, 0, "Paid to Jane Doe for services", [(0, 0, "Paid to Ja"), (1, 10, "ne Doe"), (2, 16, " for services")]), (1, 1, "", []), (1, 2, "Project Nightingale", [(0, 0, "Project Nightingale")])], "doc_id long, unit_idx int, text string, runs array<struct<run_idx:int,start:int,text:string>>")
    r = flows.blocks(units, flows.documents_detector(rows), master_map(rows), ["project nightingale"])
    got = {x.unit_idx: x for x in r.redacted.collect()}
    assert got[0].redacted == "Paid to STF-91345 for services" and [y["text"] for y in got[0].redacted_runs] == ["Paid to STF-91345", "", " for services"]
    assert got[2].redacted == "CST-AUTO-22CC7" and got[1].redacted == ""
    plain = flows.blocks(units.drop("runs"), flows.documents_detector(rows), master_map(rows))
    assert plain.redacted.where("unit_idx = 0").collect()[0].redacted == "Paid to STF-91345 for services"


def test_views(spark):
    cw = spark.createDataFrame([("Jane", "PERSON", None, "PSN-AUTO-1", True, "STF-1", "Jana", 0.9167), ("B", "PERSON", "Staff", "STF-2", False, None, None, None)], "original_name string, entity_type string, category string, pseudonym string, auto boolean, suggested_pseudonym string, suggested_name string, suggested_score double")
    a, b = views.crosswalk_view(cw).collect()
    assert (a["Category"], a["Flagged"], a["Possible match"]) == ("(unknown)", "yes", "Jana (STF-1, 92% match)") and (b["Flagged"], b["Possible match"]) == ("", "")
    red = spark.createDataFrame([(0, "<script>", None, ["a"])], "row_id long, a string, b string, changed array<string>")
    html = views.html_rows(red, ["a", "b"]).collect()[0].html
    assert "&lt;script&gt;" in html and html.count('class="changed"') == 1 and html.endswith("<td></td></tr>")
    assert views.html_table(red, ["a", "b"], 10).count("<tr>") == 2


def test_observed(spark):
    df, watch = flows.observed(spark.range(7))
    df.write.format("noop").mode("overwrite").save()
    assert watch.get == {"rows": 7}


def test_units_of_different_documents_are_never_one_text(spark):
    units = spark.createDataFrame([(1, 1 << 20, "write to a@b.example"), (2, 0, "nothing here"), (1 << 50, 3, "c@d.example")], "doc_id long, unit_idx int, text string")
    for result in (flows.pages(units), flows.blocks(units, lambda t: detect.patterns(t), None)):
        assert {(r.doc_id, r.unit_idx) for r in result.findings.collect()} == {(1, 1 << 20), (1 << 50, 3)}
        got = {(r.doc_id, r.unit_idx): r.redacted for r in result.redacted.collect()}
        assert got[2, 0] == "nothing here" and got[1, 1 << 20].startswith("write to EML-AUTO-") and got[1 << 50, 3].startswith("EML-AUTO-")


def test_nothing_asked_for_is_nothing_found(spark):
    units = spark.createDataFrame([(1, 0, "a@b.example")], "doc_id long, unit_idx int, text string")
    assert flows.blocks(units, lambda t: detect.patterns(t, ()), None).findings.count() == 0


def test_images_are_covered_in_either_style(spark):
    box = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    units = spark.createDataFrame([(1, 0, "John paid", [(10.0, 10.0, 50.0, 50.0), (0.0, 1.0, 2.0, 3.0)]), (1, 1, None, []), (2, 0, "x", None)], f"doc_id long, unit_idx int, text string, images {box}")
    for words, style in (([], flows.BLACKOUT), (["John"], flows.PSEUDONYMIZE), ([], flows.PSEUDONYMIZE)):
        result = flows.pages(units, words, style, redact_images=True)
        got = {(r.doc_id, r.unit_idx, r.image_idx, r.x0, r.y1, r.fill) for r in result.boxes.collect()}
        assert got == {(1, 0, 0, 10.0, 50.0, "black"), (1, 0, 1, 0.0, 3.0, "black")}
    text = {(r.doc_id, r.unit_idx): r.redacted for r in flows.pages(units, ["John"], redact_images=True).redacted.collect()}
    assert text[1, 0].startswith("CST-AUTO-")  # the text is still pseudonymised, not blacked out
    assert flows.pages(units, ["John"]).boxes is None and flows.pages(units.drop("images"), redact_images=True).boxes is None


def test_search_on_a_page_takes_the_first_that_hits(spark):
    rows = [(1, "Acme & Sons Ltd, ACME AND SONS", "Acme and Sons Ltd.", None), (2, "Acme Sup-\nplies and more", "Acme Supplies", "Acme Sup-\nplies"), (3, "none of it", "Acme", None), (4, None, "Acme", None), (5, "acme acme", "Acme", None)]
    df = spark.createDataFrame(rows, "id int, page string, text string, raw string")
    got = {r.id: (r.candidate, r.n_places) for r in flows.searched(df, raw="raw").collect()}
    assert got == {1: ("Acme and Sons", 1), 2: ("Acme Sup-\nplies", 1), 3: (None, 0), 4: (None, 0), 5: ("Acme", 2)}


def test_cells_of_rows_without_an_id_and_of_blank_cells(spark):
    """One or two columns are spliced where they stand: a row without an id, or with one that another has, too, is redacted like any other."""
    rows = spark.createDataFrame([(1, "Staff", "Jane Doe", "PERSON", "STF-1")], "row_ord long, category string, name string, entity_type string, pseudonym string")
    df = spark.createDataFrame([(None, "Jane Doe", "x"), (7, "by Jane Doe", " "), (7, "JANE DOE / Jane Doe", "Jane Doe"), (8, "", None), (9, "y", "z")], "row_id long, memo string, `b.c` string")
    for columns in (["memo"], ["memo", "b.c"]):
        out = flows.cells(df, flows.documents_detector(rows), master_map(rows), columns)
        got = Counter(tuple(r)[:3] + (tuple(r.changed),) for r in out.redacted.collect())
        other = ("STF-1", ("b.c", "memo")) if len(columns) == 2 else ("Jane Doe", ("memo",))
        assert got == Counter([(None, "STF-1", "x", ("memo",)), (7, "by STF-1", " ", ("memo",)), (7, "STF-1 / STF-1", *other), (8, "", None, ()), (9, "y", "z", ())])
        assert out.redacted.columns == ["row_id", "memo", "b.c", "changed"]


def test_redaction_needs_no_first_places(spark, rows):
    """Forms are looked up once, and joined with the spans alone: no first place of a text is sought for an id."""
    df = spark.createDataFrame([(1, "by Jane Doe"), (2, "JANE  doe / No Id"), (3, "")], "row_id long, memo string")
    result = flows.cells(df, flows.documents_detector(rows, entities=("PERSON",)), None, with_hints=False)
    plan = result.redacted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "min(" not in plan
    ids = {r.original_name: r.pseudonym for r in result.crosswalk.collect()}
    assert {r.row_id: r.memo for r in result.redacted.collect()} == {1: f"by {ids['Jane Doe']}", 2: f"JANE  doe / {ids['No Id']}", 3: ""}
