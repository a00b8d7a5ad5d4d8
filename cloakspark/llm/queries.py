"""The queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import canon_map, eval_leaks, format_copies, name_variants, same_look, splitter, survivor, tokenizer


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.found(table(spark, sf, "master_merge"), table(spark, sf, "stand_in"))


def p1_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """The same fields where trust adds up, so that many rows can outvote one."""
    return survivor.voted(table(spark, sf, "master_merge"), table(spark, sf, "stand_in"))


def p1_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The category that the rows of a group vote for: a consensus of one token, which SQL can express."""
    return survivor.voted(table(spark, sf, "master_merge"), table(spark, sf, "stand_in")).where("field = 'category'").select("group_no", "value")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return canon_map.found(table(spark, sf, "crosswalk"), table(spark, sf, "canon_name"), table(spark, sf, "nickname"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return format_copies.found(table(spark, sf, "master_sheet"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    named = name_variants.names_of(table(spark, sf, "master_row"), table(spark, sf, "assignment"))
    return name_variants.pairs(name_variants.link_classes(named, table(spark, sf, "nickname"), hint="hint"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_look.pairs(same_look.names_of(table(spark, sf, "master_row"), table(spark, sf, "assignment")))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, sf, "documents"))


def p6_decode(spark: SparkSession, sf: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokenizer.decode_corpus(tokenizer.encode_corpus(table(spark, sf, "documents")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return eval_leaks.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitter.split_oversized(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_consensus, p1_votes, p2_found, p3_found, p4_found, p5_found, p6_ids, p6_decode, p7_found, p8_pieces)}
