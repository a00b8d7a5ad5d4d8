"""Replacement of spans in texts and in formatted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col

BLOCK_SIGN = "█"


def spliced(text: Column | str, spans: Column | str) -> Column:
    """A text with spans (`array<struct<start,end,value>>`, disjoint, in order) replaced by their values, left to right."""
    t = col(text)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, d: F.struct(F.concat(s["out"], F.substring(t, s["at"] + 1, d["start"] - s["at"]), d["value"]).alias("out"), d["end"].alias("at"))
    whole = lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.length(t)))
    return F.when(F.coalesce(F.size(col(spans)), F.lit(0)) <= 0, t).otherwise(F.aggregate(col(spans), start, step, whole))


def span_lists(spans: DataFrame, key: str = "text_id") -> DataFrame:
    """`key, spans` from one row per span with `start, end, value`."""
    return spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("spans"))


def redact(texts: DataFrame, spans: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """The texts with a column `redacted`; texts without spans keep theirs."""
    return texts.join(span_lists(spans, key), key, "left").withColumn("redacted", spliced(text, "spans")).drop("spans")


def blacked_out(spans: DataFrame) -> DataFrame:
    """The spans with a bar of the text's own length as their value."""
    return spans.withColumn("value", F.repeat(F.lit(BLOCK_SIGN), F.col("end") - F.col("start")))


def spliced_runs(runs: Column | str, spans: Column | str) -> Column:
    """Runs (`array<struct<run_idx,start,text>>`) of one paragraph with its spans replaced.

    A value stands once, in the run where its span starts; what the span covers in other runs goes; runs that no span
    touches, and the text around spans, stay.
    """
    def one(run: Column) -> Column:
        lo, hi = run["start"], run["start"] + F.length(run["text"])
        mine = F.filter(col(spans), lambda s: (s["start"] < hi) & (s["end"] > lo))
        cut = F.transform(
            mine,
            lambda s: F.struct(
                F.greatest(s["start"] - lo, F.lit(0)).alias("start"),
                F.least(s["end"] - lo, F.length(run["text"])).alias("end"),
                F.when(s["start"] >= lo, s["value"]).otherwise(F.lit("")).alias("value"),
            ),
        )
        return F.struct(run["run_idx"].alias("run_idx"), run["start"].alias("start"), spliced(run["text"], cut).alias("text"))

    return F.when(F.coalesce(F.size(col(spans)), F.lit(0)) <= 0, col(runs)).otherwise(F.transform(col(runs), one))


def runs_text(runs: Column | str) -> Column:
    return F.array_join(F.transform(col(runs), lambda r: r["text"]), "")


def tightened(rect: Column | str, ratio: float = 0.18) -> Column:
    """A box with its upper and lower edge drawn in by a share of its height."""
    r = col(rect)
    inset = (r["y1"] - r["y0"]) * ratio
    return F.struct(r["x0"].alias("x0"), (r["y0"] + inset).alias("y0"), r["x1"].alias("x1"), (r["y1"] - inset).alias("y1"))
