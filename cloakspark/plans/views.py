"""Tables for readers: findings, crosswalk, counts, a shaded table in HTML."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_escaped


def findings_of_cells(findings: DataFrame) -> DataFrame:
    """Rows counted from 1."""
    return findings.select((F.col("row_id") + 1).alias("Row"), F.col("column").alias("Column"), F.col("text").alias("Detected text"), F.col("entity_type").alias("Entity type"), F.round("score", 2).alias("Confidence"), F.col("source").alias("Source"))


def findings_of_units(findings: DataFrame, unit: str = "Page") -> DataFrame:
    """Pages or paragraphs counted from 1."""
    return findings.select("doc_id", (F.col("unit_idx") + 1).alias(unit), F.col("text").alias("Detected text"), F.col("entity_type").alias("Entity type"), F.round("score", 2).alias("Confidence"), F.col("source").alias("Source"))


def crosswalk_view(crosswalk: DataFrame) -> DataFrame:
    hint = F.format_string("%s (%s, %.0f%% match)", "suggested_name", "suggested_pseudonym", F.col("suggested_score") * 100)
    return crosswalk.select(
        F.col("original_name").alias("Original name"),
        F.col("entity_type").alias("Entity type"),
        F.when(F.coalesce("category", F.lit("")) == "", "(unknown)").otherwise(F.col("category")).alias("Category"),
        F.col("pseudonym").alias("Pseudonym"),
        F.when(F.col("auto"), "yes").otherwise("").alias("Flagged"),
        F.when(F.coalesce("suggested_pseudonym", F.lit("")) == "", "").otherwise(hint).alias("Possible match"),
    )


def scan_counts(findings: DataFrame) -> DataFrame:
    """Detections, and cells that have some."""
    cells = findings.groupBy("row_id", "column").agg(F.count("*").alias("n"))
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("entity_count"), F.count("*").alias("cell_count"))


def cell_keys(findings: DataFrame) -> DataFrame:
    return findings.select("row_id", "column").distinct()


def master_summary(rows: DataFrame) -> DataFrame:
    """All rows, then rows by category in order of name, with thousands parted."""
    out = rows.rollup("category").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("category", F.lit("Total")).alias("category"), F.format_number("n", 0).alias("entries"))


def html_rows(redacted: DataFrame, columns: list[str], row_id: str = "row_id") -> DataFrame:
    """`row_id, html`: each row as a table row, changed cells of class `changed`, text escaped, null blank."""
    opening = lambda c: F.when(F.array_contains("changed", c), '<td class="changed">').otherwise("<td>")
    cells = [F.concat(opening(c), html_escaped(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return redacted.select(row_id, F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def html_table(redacted: DataFrame, columns: list[str], limit: int, shade: str = "#fff3a3", row_id: str = "row_id") -> str:
    """A preview of the first rows as one table in HTML; `limit` is the feature, as a page can't show a whole table."""
    body = [r["html"] for r in html_rows(redacted, columns, row_id).orderBy(row_id).limit(limit).collect()]
    head = "".join(f"<th>{escape(c)}</th>" for c in columns)
    return f"<style>td.changed {{ background: {shade} }}</style><table><thead><tr>{head}</tr></thead><tbody>{''.join(body)}</tbody></table>"
