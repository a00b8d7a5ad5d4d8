"""One form for names that look alike to a reader but differ in their characters.

A built-in `translate` maps look-alikes (`lookalike.tables`: wide and narrow forms, blanks, signs without width, letters
of other scripts with a Latin shape), a few `replace` calls part joined letters, and the mapped values are grouped under
the accent- and case-sensitive UNICODE collation, which takes composed and decomposed accents for equal and ignores what
has no width. Each class gets its least member, in the order of bytes, as canonical form, joined back to all members.
Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookalike import tables
from .name_variants import paired


def folded(column: str) -> Column:
    """The value with every look-alike mapped; accents and letter case stay."""
    single, multi, gone = tables()
    value = F.col(column)
    joined = {k: v for k, v in multi.items() if ord(k) < 0x10000 and all(ord(x) < 0x250 for x in v)}  # joined letters of Latin scripts
    other = {k: v for k, v in multi.items() if k not in joined}
    for part in (joined, other):
        guard = "[" + "".join(part) + "]"
        inner = value
        for k, v in part.items():
            inner = F.replace(inner, F.lit(k), F.lit(v))
        value = F.when(value.rlike(guard), inner).otherwise(value)
    return F.translate(value, "".join(single) + gone, "".join(single.values()))


def canonical_forms(values: DataFrame, column: str) -> DataFrame:
    """`value, canonical, n_spellings` of each distinct value that is neither null nor blank.

    `canonical` is the least spelling, in the order of bytes, of the values that look the same, itself if there is no
    other. Values of nothing but blanks and signs without width are blank. Repeated rows count once; an empty table
    gives an empty table; other columns are ignored. Distinct values are grouped, so a value held by a third of all
    rows is one row here.
    """
    distinct = values.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    mapped = distinct.withColumn("form", folded("value")).where("trim(form) <> ''")
    spark = values.sparkSession
    classes = spark.sql(
        "select collate(form, 'UNICODE') as form, min(value) as canonical, count(*) as n_spellings from {mapped} group by collate(form, 'UNICODE')",
        mapped=mapped,
    )
    return spark.sql(
        "select m.value, c.canonical, c.n_spellings from {mapped} m join {classes} c on collate(m.form, 'UNICODE') = c.form",
        mapped=mapped,
        classes=classes,
    )


def unify(df: DataFrame, column: str, out: str = "canonical") -> DataFrame:
    """The table with a further column, the form that all values of the same look share; null or blank values keep themselves.

    A column that is already called like the new one gives way to it.
    """
    forms = canonical_forms(df, column).select(F.col("value").alias("__value"), F.col("canonical").alias("__canonical"))
    joined = df.join(forms, df[column] == forms["__value"], "left")
    return joined.select(*(df[c] for c in df.columns if c != out), F.coalesce("__canonical", df[column]).alias(out))


def pairs(named: DataFrame) -> DataFrame:
    """`id_a, id_b` (id_a < id_b) of the ids of a table `id, name` whose names look the same but differ in a character.

    A name delivered twice under one id counts once; an id that carries several names pairs by each. Classes of one
    spelling are gone before ids come in, so the join handles only names that have a look-alike; a class of many rows is paired in blocks.
    """
    rows = named.select(F.col("id").cast("long").alias("id"), F.col("name").cast("string").alias("name")).where("id is not null and name is not null").distinct()
    alike = canonical_forms(rows, "name").where("n_spellings > 1").select(F.col("value").alias("name"), "canonical")
    return paired(rows.join(alike, "name").select("id", "name", "canonical"), "canonical")


def names_of(master_row: DataFrame, assignment: DataFrame) -> DataFrame:
    """`id, name` of both tables; their ids never coincide."""
    return master_row.select(F.col("row_ord").alias("id"), "name").unionByName(assignment.select(F.col("assign_id").alias("id"), F.col("original_name").alias("name")))
