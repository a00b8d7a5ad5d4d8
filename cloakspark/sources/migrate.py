"""From text lists of names to the sheets of a master list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text

# The columns of a sheet, and how a line of the old lists carries an id.
COLUMNS = ["Category", "Internal ID", "Name", "Primary Subsidiary", "Country"]

LINE_WITH_ID = r"(?sU)^(.*?)\s+-\s+(\d+)\s*$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """`ord, line`: lines without comments (from `#` on), blank ones dropped."""
    return clean_lines(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def clean_lines(lines: DataFrame) -> DataFrame:
    return lines.select("ord", clean_text(F.substring_index("value", "#", 1)).alias("line")).where("line <> ''")


def people(lines: DataFrame) -> DataFrame:
    """Staff of lines `name - digits`; without the number the id is null; a line that says `name` is a header."""
    full = LINE_WITH_ID
    has = F.col("line").rlike(full)
    return lines.where("lower(line) <> 'name'").select("ord", F.lit("Staff").alias("Category"), F.when(has, F.regexp_extract("line", full, 2)).alias("Internal ID"), clean_text(F.when(has, F.regexp_extract("line", full, 1)).otherwise(F.col("line"))).alias("Name"))


def organisations(lines: DataFrame) -> DataFrame:
    """Every line is a vendor without an id."""
    return lines.select("ord", F.lit("Vendor").alias("Category"), F.lit(None).cast("string").alias("Internal ID"), F.col("line").alias("Name"))


def merged(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row per category and name, the one with an id before one without, then the earlier; existing rows come first, then new ones by `list_no`, if they have it."""
    fit = lambda df, n: df.select((F.lit(n) + (F.col("list_no") if "list_no" in df.columns else 0)).alias("origin"), F.col("ord"), *(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS))
    rows = fit(new, 1) if existing is None else fit(existing, 0).unionByName(fit(new, 1))
    rest = F.struct("Internal ID", "Primary Subsidiary", "Country")
    kept = rows.groupBy("Category", "Name").agg(F.min_by(rest, F.struct(F.col("Internal ID").isNull().alias("n"), "origin", "ord")).alias("k"))
    return kept.select("Category", "k.Internal ID", "Name", "k.Primary Subsidiary", "k.Country")


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("Category").agg(F.count("*").alias("n_rows"), F.count("Internal ID").alias("n_with_id"))


def run(spark: SparkSession, people_path: str | None, organisations_path: str | None, existing: DataFrame | None = None) -> DataFrame:
    """The rows of a new master list from the old text lists, merged into the rows there are; a missing list is none."""
    parts = [f(read_lines(spark, p)) for f, p in ((people, people_path), (organisations, organisations_path)) if p]
    if not parts:
        raise ValueError("no list to migrate")
    new = reduce(DataFrame.unionByName, (p.withColumn("list_no", F.lit(n)) for n, p in enumerate(parts)))
    return merged(existing, new).orderBy("Category", "Name", F.col("Internal ID").isNull())
