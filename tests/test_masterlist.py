import pytest
from pyspark.sql import Row

from cloakspark.operators import masterlist as M


def rows_of(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_ord long, category string, name string, entity_type string, pseudonym string")


def org(name, pid, category="Vendor"):
    return (category, name, "ORGANIZATION", pid)


def by_key(df):
    return {(r.entity_type, r.norm_name): r for r in df.collect()}


def test_sheets(spark):
    schema = "row_id long, Category string, `Internal ID` double, Name string, Country string"
    staff = spark.createDataFrame([(0, "Staff", 91345.0, "Brian Thuo", None), (1, "Staff", None, "No Id Person", None), (2, "Staff", 99.0, " ", None), (3, None, 7.0, "Lost", None), (4, "Staff", 5.0, "Isaac Henry - 22463", "x")], schema)
    funders = spark.createDataFrame([(0, "Mystery", 5.0, "Unknown Category", None), (1, "Funder", 520638.0, "Barka", None)], schema)
    got = [tuple(r)[1:] for r in M.parse_sheets({"Staff": staff, "Funders": funders}).orderBy("row_ord").collect()]
    assert got == [("Staff", "Brian Thuo", "PERSON", "STF-91345"), ("Staff", "No Id Person", "PERSON", None), ("Staff", "Isaac Henry", "PERSON", "STF-5"), ("Funder", "Barka", "ORGANIZATION", "FND-520638")]
    with pytest.raises(ValueError):
        M.parse_sheets({"Staff": spark.createDataFrame([(1,)], "x int")})
    only_names = spark.createDataFrame([("A",)], "Name string")
    assert M.parse_sheets({"Vendors": only_names}).select("category", "pseudonym").collect() == [Row(category="Vendor", pseudonym=None)]


def test_map_collisions(spark):
    rows = rows_of(spark, org("Acme Ltd", "VND-1"), org("Acme Limited", "VND-2"), org("ACME ltd", "VND-1"), org("Acme Ltd", "VND-9"), org("Smith & Co", "VND-200"), org("No Id", None))
    m = by_key(M.master_map(rows))
    assert m["ORGANIZATION", "acme ltd"].pseudonym == "VND-1" and m["ORGANIZATION", "acme ltd"].display_name == "ACME ltd"
    assert m["ORGANIZATION", "acme limited"].pseudonym == "VND-2"
    assert m["ORGANIZATION", "acme ltd."].pseudonym == "VND-1"  # an alias of the first row, free
    assert m["ORGANIZATION", "smith and company"].pseudonym == "VND-200"
    assert ("ORGANIZATION", "no id") not in m


def test_same_name_in_two_sheets(spark):
    m = by_key(M.master_map(rows_of(spark, org("Twin", "VND-1"), org("Twin", "FND-1", "Funder"))))
    assert m["ORGANIZATION", "twin"].pseudonym == "VND-1"


def report(spark, *rows):
    return {r.kind: r for r in M.quality_report(rows_of(spark, *rows)).collect()}


def test_quality_report(spark):
    assert report(spark, org("Alpha", "1"), org("Beta", "2")) == {}
    r = report(spark, ("Staff", "Acme Corp", "PERSON", "STF-1"), org("acme  corp", "VND-1"))
    assert r["cross_category_duplicate"].total == 1 and r["cross_category_duplicate"].examples == ["`acme corp` appears in: Staff, Vendor"]
    r = report(spark, org("Acme Ltd", "100"), org("Acme Ltd", "200"))
    assert r["conflicting_ids"].examples == ["`acme ltd` (Vendor) has IDs: 100, 200"] and set(r) == {"conflicting_ids"}
    r = report(spark, org("Acme Ltd", "100"), org("Beta Inc", "100"))
    assert r["duplicate_ids"].severity == "warning" and r["duplicate_ids"].examples == ["ID `100` (Vendor) used by: Acme Ltd, Beta Inc"]
    assert report(spark, org("Alpha", "1"), org("Alpha", "1")) == {}
    r = report(spark, org("Across", "1"), org("The Company", "2"), org("Xyz", None))
    assert r["ambiguous_common_word"].total == 1 and r["blank_ids"].severity == "info"
    r = report(spark, *[org(f"n{i}", None) for i in range(6)])
    assert r["blank_ids"].total == 6 and len(r["blank_ids"].examples) == 5 and r["blank_ids"].title.startswith("6 ")


def test_groups(spark):
    rows = rows_of(spark, org("A", "1"), org("B", None), ("Staff", "C", "PERSON", None))
    assert {(r.category, r.n) for r in M.counts_by_category(rows).collect()} == {("Vendor", 2), ("Staff", 1)}
    assert {(r.category, r.n) for r in M.summary(rows).collect()} == {("Vendor", 2), ("Staff", 1), (None, 3)}
    assert [r.name for r in M.names_by_entity(rows).where("entity_type = 'ORGANIZATION'").orderBy("row_ord").collect()] == ["A", "B"]
    assert len(M.COMMON_WORDS) == 167


def test_places_in_sheets_never_meet(spark):
    """Rows without an id are numbered as they stand, however many partitions there are; an id out of bounds is refused."""
    staff = spark.range(0, 260, 1, 130).selectExpr("concat('Person ', id) as Name")
    vendors = spark.createDataFrame([("V1",), ("V2",)], "Name string")
    rows = M.parse_sheets({"Staff": staff, "Vendors": vendors})
    ords = {r.name: r.row_ord for r in rows.collect()}
    assert len(set(ords.values())) == 262 and [ords[f"Person {i}"] for i in range(260)] == list(range(260))
    assert {r.name: r.row_ord for r in rows.collect()} == ords
    for bad in (1 << 40, -1):
        with pytest.raises(Exception, match="place in a sheet"):
            M.parse_sheets({"Staff": spark.createDataFrame([(bad, "A")], "row_id long, Name string")}).collect()
