"""Detection and assignment over a stream of texts, against a list that stands still."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import auto_pseudonym, normalize_name
from ..operators.detect import Detector
from ..operators.resolve import without_overlaps
from ..plans.flows import blocks
from ..settings import DEFAULTS, Settings


def pattern_findings(stream: DataFrame, detector: Callable[[DataFrame], DataFrame], settings: Settings = DEFAULTS) -> DataFrame:
    """Detections of a stateless detector with made-up ids, as a stream; no overlaps are settled."""
    found = detector(stream)
    norm = normalize_name("text")
    return found.withColumn("norm_name", norm).withColumn("pseudonym", auto_pseudonym("entity_type", "norm_name", settings.auto_hash_length, settings.auto_prefixes))


def crosswalk_stream(findings: DataFrame, master: DataFrame, time: str = "at", delay: str = "1 hour") -> DataFrame:
    """Each name once per state horizon, with its curated id if there is one: a stream-static join and bounded state."""
    named = findings.withWatermark(time, delay).dropDuplicatesWithinWatermark(["entity_type", "norm_name"])
    return named.join(master.select("entity_type", "norm_name", F.col("pseudonym").alias("curated")), ["entity_type", "norm_name"], "left").select("entity_type", "norm_name", F.coalesce("curated", "pseudonym").alias("pseudonym"), F.col("curated").isNull().alias("auto"))


def redact_batches(stream: DataFrame, detector: Detector, master: DataFrame | None, write: Callable[[DataFrame, int], None], settings: Settings = DEFAULTS):
    """A writer that redacts each micro-batch of units (`doc_id, unit_idx, text`) with the blocks flow and hands it on."""
    def each(batch: DataFrame, epoch: int) -> None:
        write(blocks(batch, detector, master, (), settings, with_hints=False).redacted, epoch)

    return stream.writeStream.foreachBatch(each)


__all__ = ["crosswalk_stream", "pattern_findings", "redact_batches", "without_overlaps"]
