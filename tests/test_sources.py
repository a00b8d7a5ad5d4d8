import io
import json
import zipfile

import pytest

from cloakspark import settings
from cloakspark.sources import migrate, office

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def document(*paragraphs, table=(), header=()):
    p = lambda runs: "<w:p>" + "".join(f'<w:r><w:rPr/><w:t xml:space="preserve">{t}</w:t></w:r>' for t in runs) + "</w:p>"
    body = "".join(map(p, paragraphs)) + (f"<w:tbl><w:tr><w:tc>{''.join(map(p, table))}</w:tc></w:tr></w:tbl>" if table else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {_W}>{''.join(map(p, header))}</w:hdr>")
    return out.getvalue()


def test_workbook_round_trip(spark, tmp_path):
    data = office.write_workbook({"Staff": (["Name", "Internal ID"], [["Jane <&> Doe", 5], [None, "x"]]), "More": (["A"], [])}, {(0, 0)})
    assert office.read_workbook(data) == {"Staff": [["Name", "Internal ID"], ["Jane <&> Doe", "5"], [None, "x"]], "More": [["A"]]}
    (tmp_path / "a.xlsx").write_bytes(data)
    df = office.read_sheet(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["row_id", "Name", "Internal ID"] and [tuple(r) for r in df.orderBy("row_id").collect()] == [(0, "Jane <&> Doe", "5"), (1, None, "x")]
    red = spark.createDataFrame([(0, "X", ["name"])], "row_id long, name string, changed array<string>")
    cw = spark.createDataFrame([("Jane", "STF-1")], "original_name string, pseudonym string")
    office.save_redacted_workbook(red, cw, str(tmp_path / "out.xlsx"))
    assert office.read_workbook((tmp_path / "out.xlsx").read_bytes()) == {"Redacted": [["row_id", "name"], ["0", "X"]], "Crosswalk": [["original_name", "pseudonym"], ["Jane", "STF-1"]]}
    office.save_crosswalk(cw, str(tmp_path / "cw"))
    assert spark.read.option("header", True).csv(str(tmp_path / "cw")).collect() == cw.collect()


def test_workbook_takes_no_more_than_a_sheet_holds(spark, tmp_path, monkeypatch):
    assert getattr(office, "MAX_SHEET_ROWS", 1 << 20) == (1 << 20) - 1  # and a header
    monkeypatch.setattr(office, "MAX_SHEET_ROWS", 3)
    rows = lambda n: spark.range(n).selectExpr("cast(id as string) as name")
    for redacted, crosswalk in ((3, 4), (4, 3)):
        with pytest.raises(ValueError):
            office.save_redacted_workbook(rows(redacted), rows(crosswalk), str(tmp_path / "out.xlsx"))
        assert not (tmp_path / "out.xlsx").exists()
    office.save_redacted_workbook(rows(3), rows(3), str(tmp_path / "out.xlsx"))
    assert {n: len(r) for n, r in office.read_workbook((tmp_path / "out.xlsx").read_bytes()).items()} == {"Redacted": 4, "Crosswalk": 4}


def test_document_blocks(spark, tmp_path):
    data = document(["Hello ", "World"], ["x"], table=[["in cell"]], header=[["top"]])
    assert office.read_blocks(data) == [["Hello ", "World"], ["x"], ["in cell"], ["top"]]
    changed = office.write_blocks(data, {0: {0: "ID", 1: ""}, 3: {0: "T"}})
    assert office.read_blocks(changed) == [["ID", ""], ["x"], ["in cell"], ["T"]]
    (tmp_path / "d.docx").write_bytes(data)
    rows = office.block_units(spark, str(tmp_path)).orderBy("unit_idx").collect()
    assert [r.text for r in rows] == ["Hello World", "x", "in cell", "top"] and rows[0].runs[1]["start"] == 6


def test_migration(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# head\nname\nJane Doe - 12\nBob # note\n\nJean - Paul\n")
    (tmp_path / "o.txt").write_text("Acme\n")
    new = migrate.people(migrate.read_lines(spark, str(tmp_path / "p.txt"))).unionByName(migrate.organisations(migrate.read_lines(spark, str(tmp_path / "o.txt"))))
    old = spark.createDataFrame([(0, "Staff", None, "Jane Doe", "HQ"), (1, "Staff", "7", "Bob", None)], "ord long, Category string, `Internal ID` string, Name string, Country string")
    got = {(r["Category"], r["Name"]): r["Internal ID"] for r in migrate.merged(old, new).collect()}
    assert got == {("Staff", "Jane Doe"): "12", ("Staff", "Bob"): "7", ("Staff", "Jean - Paul"): None, ("Vendor", "Acme"): None}
    assert {(r["Category"], r.n_rows, r.n_with_id) for r in migrate.totals(migrate.merged(old, new)).collect()} == {("Staff", 3, 2), ("Vendor", 1, 0)}
    assert migrate.merged(None, new).count() == 4


def test_settings(tmp_path):
    f = tmp_path / "sub" / "s.json"
    assert settings.read_saved(f) == {}
    settings.save(f, data_dir="/a")
    settings.save(f, other="b")
    assert settings.read_saved(f) == {"data_dir": "/a", "other": "b"}
    f.write_text("[1]")
    assert settings.read_saved(f) == {}
    f.write_text("{broken")
    assert settings.read_saved(f) == {} and json.dumps(settings.AUTO_PREFIXES)
    assert settings.data_dir({"data_dir": "/s"}, "V", "/f", {"V": "/e"}) == "/s"
    assert settings.data_dir({}, "V", "/f", {"V": " /e "}) == "/e" and settings.data_dir({}, "V", "/f", {"V": ""}) == "/f"


def test_cached_list_follows_its_file(spark, tmp_path):
    import os

    from cloakspark.operators.masterlist import parse_sheets

    f = tmp_path / settings.LIST_FILE
    assert settings.list_path(tmp_path) is None
    f.write_bytes(office.write_workbook({"Staff": (["Category", "Internal ID", "Name"], [["Staff", 1, "Jane Doe"]]), "Vendors": (["Category", "Name"], [["Vendor", "Acme"]])}))
    assert settings.list_path(tmp_path) == f
    held = office.CachedList(spark, str(f), parse_sheets)
    first = held.rows()
    assert sorted((r.name, r.pseudonym or "") for r in first.collect()) == [("Acme", ""), ("Jane Doe", "STF-1")] and held.rows() is first
    f.write_bytes(office.write_workbook({"Staff": (["Category", "Internal ID", "Name"], [["Staff", 2, "Bob"]])}))
    os.utime(f, ns=(1, 1))
    assert [(r.name, r.pseudonym) for r in held.rows().collect()] == [("Bob", "STF-2")]


def test_migration_run(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Zed - 3\nAnn\n")
    (tmp_path / "o.txt").write_text("Acme\n")
    got = [(r["Category"], r["Name"], r["Internal ID"]) for r in migrate.run(spark, str(tmp_path / "p.txt"), str(tmp_path / "o.txt")).collect()]
    assert got == [("Staff", "Ann", None), ("Staff", "Zed", "3"), ("Vendor", "Acme", None)]


def test_columns_of_a_sheet_have_types_and_a_header_alone_has_columns(spark, tmp_path):
    data = office.write_workbook({"A": (["Name", "Id", "Amount", "Empty", "Mixed"], [["x", 5, 1.5, None, 1], [None, None, 2, None, "y"]]), "B": (["Name", "Internal ID"], [])})
    (tmp_path / "a.xlsx").write_bytes(data)
    path = str(tmp_path / "a.xlsx")
    a, b = office.read_sheet(spark, path), office.read_sheet(spark, path, "B")
    assert a.dtypes == [("row_id", "bigint"), ("Name", "string"), ("Id", "bigint"), ("Amount", "double"), ("Empty", "string"), ("Mixed", "string")]
    assert [tuple(r) for r in a.orderBy("row_id").collect()] == [(0, "x", 5, 1.5, None, "1"), (1, None, None, 2.0, None, "y")]
    assert b.columns == ["row_id", "Name", "Internal ID"] and b.count() == 0
