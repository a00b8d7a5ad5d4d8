"""Pseudonyms for detected names, and the crosswalk of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import auto_pseudonym, normalize_name
from ..session import materialise
from ..settings import DEFAULTS, Settings
from .fuzzy import hints


def distinct_names(named: DataFrame, order: list[str]) -> DataFrame:
    """`entity_type, norm_name, original_name, ord`: one row per key with the first surface form in the order given."""
    rows = named.withColumn("norm_name", normalize_name("text")).withColumn("ord", F.struct(*order))
    return rows.groupBy("entity_type", "norm_name").agg(F.min_by("text", "ord").alias("original_name"), F.min("ord").alias("ord"))


def assign(names: DataFrame, master: DataFrame | None, settings: Settings = DEFAULTS, with_hints: bool = True) -> DataFrame:
    """The crosswalk with `norm_name` and `ord`: curated ids by type and normalised name, else made-up ones with a hint.

    A hint never changes the id. Only distinct names come here, whatever the number of their occurrences.
    """
    hinted = master is not None and with_hints
    if hinted:  # read by the look-up and by the hints
        master = materialise(master.withColumn("cand_ord", F.col("norm_name")) if "cand_ord" not in master.columns else master)  # a list without an order goes by name
    if master is None:
        joined = names.select("*", *(F.lit(None).cast("string").alias(c) for c in ("pseudonym", "category")))
    else:
        joined = names.join(master.select("entity_type", "norm_name", "pseudonym", "category"), ["entity_type", "norm_name"], "left")
    joined = materialise(joined) if hinted else joined  # else names are found anew for the hints, and normalised where they were found
    out = joined.withColumn("auto", F.col("pseudonym").isNull()).withColumn("pseudonym", F.coalesce("pseudonym", auto_pseudonym("entity_type", "norm_name", settings.auto_hash_length, settings.auto_prefixes)))
    blank = {"suggested_pseudonym": "string", "suggested_name": "string", "suggested_score": "double"}
    if hinted:
        found = hints(joined.where("pseudonym is null").select("entity_type", "norm_name"), master, settings.fuzzy_threshold, settings.length_slack)
        out = out.join(found, ["entity_type", "norm_name"], "left")
    else:
        out = out.select("*", *(F.lit(None).cast(t).alias(c) for c, t in blank.items()))
    return out.select("norm_name", "ord", "original_name", "entity_type", "category", "pseudonym", "auto", *blank)


def crosswalk(assigned: DataFrame) -> DataFrame:
    """Curated entries first, then by pseudonym; of one pseudonym the earlier name first."""
    return assigned.orderBy("auto", "pseudonym", "ord").drop("ord", "norm_name")


def collisions(assigned: DataFrame) -> DataFrame:
    """Made-up ids that several names share; five hexadecimal digits make some likely from a few thousand names on."""
    by = assigned.where("auto").groupBy("pseudonym").agg(F.count_distinct("norm_name").alias("n_names"), F.array_sort(F.collect_set("norm_name")).alias("names"))
    return by.where("n_names > 1")


def flag_counts(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.count("*").alias("n"), F.count_if("auto").alias("n_flagged"), F.count_if(F.col("suggested_pseudonym").isNotNull()).alias("n_suggested"))
