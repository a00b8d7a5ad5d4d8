"""From many overlapping detections to the ones that stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import SOURCE_PRIORITY
from .detect import COLUMNS


def priority(source: str = "source") -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv)), F.col(source))


def above(detections: DataFrame, threshold: float) -> DataFrame:
    return detections.where(F.col("score") >= threshold)


def best_per_span(detections: DataFrame) -> DataFrame:
    """Of detections of exactly the same span, whatever their type, the one of the highest score, then the earliest."""
    key = ["text_id", "start", "end"]
    rest = [c for c in COLUMNS if c not in key]
    best = F.min_by(F.struct(*rest), F.struct((-F.col("score")).alias("s"), "seq", priority().alias("p"), "entity_type", "source"))
    return detections.groupBy(*key).agg(best.alias("b")).select("text_id", "b.seq", "b.entity_type", "start", "end", "b.score", "b.text", "b.source")


def without_overlaps(detections: DataFrame) -> DataFrame:
    """Kept are, in order of source, start and length (longest first), those that overlap none kept before.

    Detections that don't touch one another, not even by way of others, can't affect each other, so a text is first cut
    into islands of overlapping spans by one window; only an island is folded in order, never a whole text, and the
    fold uses the window's partitioning.
    """
    order = Window.partitionBy("text_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") >= F.coalesce(F.col("reach"), F.lit(-1)), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = detections.withColumn("reach", reach).withColumn("island", island)
    item = F.struct(priority().alias("p"), "start", (-F.col("end")).alias("neg"), "seq", "end", "entity_type", "score", "text", "source")
    sets = marked.groupBy("text_id", "island").agg(F.array_sort(F.collect_list(item)).alias("all"))
    clash = lambda kept, d: F.exists(kept, lambda k: (d["start"] < k["end"]) & (d["end"] > k["start"]))
    kept = F.when(F.size("all") == 1, F.col("all")).otherwise(F.aggregate("all", F.slice("all", 1, 0), lambda acc, d: F.when(clash(acc, d), acc).otherwise(F.concat(acc, F.array(d)))))
    return sets.select("text_id", F.explode(kept).alias("k")).select("text_id", "k.seq", "k.entity_type", "k.start", "k.end", "k.score", "k.text", "k.source")


def engine(detections: DataFrame, threshold: float) -> DataFrame:
    """What one analysis of a text gives: threshold, best per span, no overlaps; detections are dealt out by text, once for all steps."""
    return without_overlaps(best_per_span(above(detections, threshold).repartition("text_id")))


def staged(detections: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Typed words join what an analysis kept, and overlaps are settled again; a span that lost before stays lost."""
    return detections if words is None else without_overlaps(detections.unionByName(words.select(*COLUMNS)))


def single_pass(detections: DataFrame, threshold: float, words: DataFrame) -> DataFrame:
    """The safer option: all detections settled at once, so a span that lost only to one that lost itself is kept."""
    return without_overlaps(best_per_span(above(detections, threshold)).unionByName(words.select(*COLUMNS)))
