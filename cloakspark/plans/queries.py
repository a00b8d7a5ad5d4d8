"""Named queries over the test tables, one or more for each operator; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.aliases import aliases
from ..operators import assign as A
from ..operators import detect, fuzzy, masterlist, resolve, splice
from ..session import table, widened
from ..sources import migrate
from . import flows, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WORDS = ("petty cash", "voucher", "imprest", "Hadrowa Bay")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- inputs -----------------------------------------------------------------------------------------------------------


def customers_list(spark: SparkSession, sf: str) -> DataFrame:
    """A list of staff from the customers; those in debt have no id, and every tenth stands in it with the word before its name, too."""
    c = table(spark, sf, "customer")
    own = c.select(F.col("c_custkey").alias("row_ord"), F.lit("Staff").alias("category"), F.col("c_name").alias("name"), F.lit("PERSON").alias("entity_type"), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("STF-"), F.col("c_custkey").cast("string"))).alias("pseudonym"))
    longer = c.where("c_custkey % 10 = 9").select((F.col("c_custkey") + (1 << 40)).alias("row_ord"), F.lit("Staff").alias("category"), F.concat(F.lit("to "), F.col("c_name")).alias("name"), F.lit("PERSON").alias("entity_type"), F.concat(F.lit("STF-L"), F.col("c_custkey").cast("string")).alias("pseudonym"))
    return own.unionByName(longer)


def order_memos(spark: SparkSession, sf: str) -> DataFrame:
    """One memo for each order, which names its customer twice; where the list has the longer name, the first place holds two overlapping ones."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("Paid to "), F.col("c_name"), F.lit(" by "), F.col("o_orderpriority"), F.lit(" / "), F.col("c_name")).alias("memo"))


def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    return masterlist.from_raw_sheet(table(spark, sf, "master_sheet"))


def documents(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return widened(table(spark, sf, "documents").select("doc_id", "text", *more))


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("doc_id").alias("text_id"), "text")


def line_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping spans made from the line items, one text per order."""
    source = F.element_at(F.array(*(F.lit(s) for s in ("master list", "pattern match", "custom word", "model"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    start = (F.col("l_partkey") % 40).cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("text_id"), F.col("l_linenumber").cast("int").alias("seq"), F.col("l_returnflag").alias("entity_type"), start.alias("start"),
        (start + 1 + F.col("l_suppkey") % 15).cast("int").alias("end"), (F.lit(30) + F.col("l_partkey") % 70).cast("double").alias("score"), F.lit("").alias("text"), source.alias("source"),
    )


def canon_map_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "canon_name").where("pseudonym is not null")
    return c.select("entity_type", "norm_name", "pseudonym", "category", "display_name", F.col("canon_id").alias("cand_ord"))


def crosswalk_names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct names of the exported crosswalks, first by id."""
    x = table(spark, sf, "crosswalk").where("original_name is not null and original_name rlike '(?U)\\\\S'")
    return A.distinct_names(x.select("entity_type", F.col("original_name").alias("text"), "xwalk_id"), ["xwalk_id"])


def memo_result(spark: SparkSession, sf: str, with_hints: bool = False) -> flows.Result:
    """Hints stand in the crosswalk only; queries of redacted cells and findings go without."""
    rows = customers_list(spark, sf)
    detector = flows.documents_detector(rows, entities=("PERSON",))
    return flows.cells(order_memos(spark, sf), detector, masterlist.master_map(rows), ["memo"], with_hints=with_hints)


# --- detection to redaction ---------------------------------------------------------------------------------------------


@query
def redact_order_memos(spark: SparkSession, sf: str) -> DataFrame:
    return memo_result(spark, sf).redacted.select("row_id", "memo")


@query
def crosswalk_order_memos(spark: SparkSession, sf: str) -> DataFrame:
    return A.crosswalk(memo_result(spark, sf, with_hints=True).crosswalk).select("original_name", "entity_type", "category", "pseudonym", "auto")


@query
def findings_view(spark: SparkSession, sf: str) -> DataFrame:
    return views.findings_of_cells(memo_result(spark, sf).findings)


@query
def crosswalk_view(spark: SparkSession, sf: str) -> DataFrame:
    return views.crosswalk_view(memo_result(spark, sf, with_hints=True).crosswalk)


@query
def exported_crosswalk_view(spark: SparkSession, sf: str) -> DataFrame:
    """The exported crosswalks as readers see them, hints included."""
    return views.crosswalk_view(table(spark, sf, "crosswalk").drop("loaded_at").distinct())


@query
def entity_cell_counts(spark: SparkSession, sf: str) -> DataFrame:
    return views.scan_counts(memo_result(spark, sf).findings)


@query
def flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.flag_counts(memo_result(spark, sf, with_hints=True).crosswalk)


@query
def html_rows(spark: SparkSession, sf: str) -> DataFrame:
    return views.html_rows(memo_result(spark, sf).redacted, ["memo"])


def listed_names(spark: SparkSession, sf: str) -> DataFrame:
    """The master list and all given names: with single words in it, hits are many and some overlap."""
    n = table(spark, sf, "nickname")
    given = n.select(F.explode(F.array("short_form", "full_form")).alias("name")).select(F.lit("PERSON").alias("entity_type"), "name")
    return table(spark, sf, "master_row").select("entity_type", "name").unionByName(given)


@query
def dictionary_hits(spark: SparkSession, sf: str) -> DataFrame:
    names = masterlist.dictionary(listed_names(spark, sf))
    hits = detect.dictionary(document_texts(spark, sf), names)
    return hits.groupBy(F.col("text_id").alias("doc_id"), "entity_type", F.lower("text").alias("key")).agg(F.count("*").alias("n"))


@query
def dictionary_hits_by_join(spark: SparkSession, sf: str) -> DataFrame:
    names = masterlist.dictionary(listed_names(spark, sf))
    hits = detect.dictionary(document_texts(spark, sf), names, strategy="join")
    return hits.groupBy(F.col("text_id").alias("doc_id"), "entity_type", F.lower("text").alias("key")).agg(F.count("*").alias("n"))


@query
def email_findings(spark: SparkSession, sf: str) -> DataFrame:
    hits = detect.patterns(document_texts(spark, sf), ("EMAIL_ADDRESS",))
    return hits.select(F.col("text_id").alias("doc_id"), "start", "end", "text")


@query
def url_findings(spark: SparkSession, sf: str) -> DataFrame:
    hits = detect.patterns(document_texts(spark, sf), ("URL",))
    return hits.groupBy(F.col("text_id").alias("doc_id")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda s: s["text"]), " ").alias("urls"))


@query
def email_redacted_docs(spark: SparkSession, sf: str) -> DataFrame:
    texts = document_texts(spark, sf)
    hits = detect.patterns(texts, ("EMAIL_ADDRESS",)).withColumn("value", T.auto_pseudonym("entity_type", T.normalize_name("text")))
    return splice.redact(texts, hits).select(F.col("text_id").alias("doc_id"), "redacted")


@query
def run_splice(spark: SparkSession, sf: str) -> DataFrame:
    """The same redaction in paragraphs cut into runs of 40 characters: values once, runs kept apart."""
    lines = documents(spark, sf).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit_idx", "text"))
    texts = lines.withColumn("text_id", F.struct("doc_id", "unit_idx"))
    hits = detect.patterns(texts, ("EMAIL_ADDRESS",)).withColumn("value", T.auto_pseudonym("entity_type", T.normalize_name("text")))
    joined = texts.join(splice.span_lists(hits), "text_id")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 40).cast("int")), lambda i: F.struct(i.alias("run_idx"), (i * 40).alias("start"), F.substring("text", i * 40 + 1, F.lit(40)).alias("text")))
    cut = joined.select("doc_id", "unit_idx", "spans", F.explode(F.array(runs)).alias("runs"))  # worked out once, not in each expression that reads it
    done = cut.select("doc_id", "unit_idx", F.explode(F.array(splice.spliced_runs("runs", "spans"))).alias("new"))
    return done.select("doc_id", "unit_idx", splice.runs_text("new").alias("redacted"), F.size("new").alias("n_runs"))


@query
def blackout(spark: SparkSession, sf: str) -> DataFrame:
    texts = document_texts(spark, sf)
    return splice.redact(texts, splice.blacked_out(detect.patterns(texts, ("EMAIL_ADDRESS",)))).select(F.col("text_id").alias("doc_id"), "redacted")


@query
def custom_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    hits = detect.custom_words(document_texts(spark, sf), WORDS)
    return hits.groupBy(F.col("text_id").alias("doc_id")).agg(F.count("*").alias("n"))


@query
def best_per_span(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.best_per_span(line_spans(spark, sf)).select("text_id", "seq", "entity_type", "start", "end", "score", "source")


@query
def threshold_filter(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.above(line_spans(spark, sf), 65.0).groupBy("entity_type").agg(F.count("*").alias("n"))


@query
def overlap_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.without_overlaps(resolve.best_per_span(line_spans(spark, sf))).select("text_id", "seq", "start", "end", "source")


@query
def staged_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Engine first, then typed words: two stages, as in the blocks flow."""
    spans = line_spans(spark, sf)
    engine = resolve.engine(spans.where("source <> 'custom word'"), 35.0)
    return resolve.staged(engine, spans.where("source = 'custom word'")).select("text_id", "seq", "start", "end", "source")


@query
def distinct_text_scan(spark: SparkSession, sf: str) -> DataFrame:
    """How often each distinct text occurs and where first: what a scan analyses once."""
    d = documents(spark, sf).where("text is not null and text rlike '(?U)\\\\S'")
    return d.groupBy(F.sha1(F.col("text").cast("binary")).alias("text_sha1")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"))


@query
def unpivot_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "master_sheet").select("row_id", "name", "primary_subsidiary", "country")
    return flows.unpivot(c, ["name", "primary_subsidiary", "country", "not_there"])


@query
def cells_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Spreadsheet flow over the exported crosswalks: every string column is scanned for list names and addresses."""
    rows = table(spark, sf, "master_row")
    x = table(spark, sf, "crosswalk").drop("made_at", "loaded_at").distinct().withColumnRenamed("xwalk_id", "row_id")
    done = flows.cells(x, flows.documents_detector(rows), masterlist.master_map(rows.where("entity_type is not null")), with_hints=False).redacted
    return done.select("row_id", *flows.text_columns(x), F.size("changed").alias("n_changed"))


@query
def pages_flow(spark: SparkSession, sf: str) -> DataFrame:
    units = documents(spark, sf).select("doc_id", F.lit(0).alias("unit_idx"), "text").where("text is not null")
    return flows.pages(units, WORDS).redacted.select("doc_id", "redacted")


def pages_with_images(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as pages; a page has as many images as the last digit of its id is above 6."""
    box = lambda i: F.struct(*((i * 10 + n).cast("double").alias(c) for n, c in enumerate(("x0", "y0", "x1", "y1"))))
    n = F.greatest((F.col("doc_id") % 10 - 6).cast("int"), F.lit(0))
    images = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), box)).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))
    return documents(spark, sf).select("doc_id", F.lit(0).alias("unit_idx"), "text", images.alias("images"))


@query
def page_images(spark: SparkSession, sf: str) -> DataFrame:
    return flows.pages(pages_with_images(spark, sf), redact_images=True).boxes.select("doc_id", "unit_idx", "image_idx", "x0", "y0", "x1", "y1", "fill")


@query
def page_images_blackout(spark: SparkSession, sf: str) -> DataFrame:
    boxes = flows.pages(pages_with_images(spark, sf), WORDS, flows.BLACKOUT, redact_images=True).boxes
    return boxes.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.expr("(x1 - x0) * (y1 - y0)")).alias("area"))


@query
def page_search(spark: SparkSession, sf: str) -> DataFrame:
    """The hint of each crosswalk row looked for in the name that was typed, as it stands and in its variants."""
    x = table(spark, sf, "crosswalk").where("suggested_name is not null and original_name is not null").select("xwalk_id", "original_name", "suggested_name").distinct()
    return flows.searched(x, "original_name", "suggested_name").where("candidate is not null").select("xwalk_id", "candidate", "n_places")


@query
def blocks_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraph flow: documents cut at line ends, list names, addresses and typed words."""
    rows = table(spark, sf, "master_row")
    units = documents(spark, sf).where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("unit_idx", "text"))
    out = flows.blocks(units, flows.documents_detector(rows), masterlist.master_map(rows.where("entity_type is not null")), WORDS, with_hints=False).redacted
    return out.select("doc_id", "unit_idx", "redacted")


# --- names, ids, hints ------------------------------------------------------------------------------------------------


@query
def normalize_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "master_sheet").select("row_id", T.normalize_name("name").alias("norm_name"))


@query
def auto_ids(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "assignment").where("original_name is not null").select("entity_type", T.normalize_name("original_name").alias("norm_name")).distinct()
    return a.select("entity_type", "norm_name", T.auto_pseudonym("entity_type", "norm_name").alias("pseudonym"))


@query
def auto_id_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all names of the assignments, the crosswalks and the sheets: enough for some to meet."""
    a, x, s = table(spark, sf, "assignment"), table(spark, sf, "crosswalk"), table(spark, sf, "master_sheet")
    names = a.select("entity_type", F.col("original_name").alias("name")).unionByName(x.select("entity_type", F.col("original_name").alias("name"))).unionByName(s.select(F.lit("ORGANIZATION").alias("entity_type"), "name"))
    a = names.where("name is not null").select("entity_type", T.normalize_name("name").alias("norm_name")).distinct()
    ids = a.select("norm_name", F.lit(True).alias("auto"), T.auto_pseudonym("entity_type", "norm_name").alias("pseudonym"))
    return A.collisions(ids).select("pseudonym", "n_names", F.array_join("names", "|").alias("names"))


@query
def assign_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    done = A.assign(crosswalk_names(spark, sf), canon_map_rows(spark, sf), with_hints=False)
    return done.select("original_name", "entity_type", "category", "pseudonym", "auto")


@query
def fuzzy_hint(spark: SparkSession, sf: str) -> DataFrame:
    done = A.assign(crosswalk_names(spark, sf), canon_map_rows(spark, sf))
    return done.where("suggested_name is not null").select("norm_name", "entity_type", "suggested_pseudonym", "suggested_name", F.round("suggested_score", 6).alias("suggested_score"))


@query
def fuzzy_candidates(spark: SparkSession, sf: str) -> DataFrame:
    band = fuzzy.length_band(crosswalk_names(spark, sf), canon_map_rows(spark, sf))
    return band.groupBy("entity_type", "norm_name").agg(F.count("*").alias("n"))


@query
def alias_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "master_row").select("name").distinct().select("name", F.posexplode(aliases("name")).alias("alias_ord", "alias"))


@query
def search_variants(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "master_row").select("name").distinct()
    return names.select("name", F.explode(T.search_variants("name")).alias("variant")).distinct()


@query
def recase_upper(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where("text is not null").select("doc_id", F.sha1(T.recase_uppercase("text").cast("binary")).alias("recased_sha1"))


@query
def page_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with broken words and joined letters put in by rule, as running text again."""
    broken = F.replace(F.regexp_replace("text", "([a-z]{4})([a-z]{4})", "$1-\n $2"), F.lit("fi"), F.lit("ﬁ"))
    return documents(spark, sf).where("text is not null").select("doc_id", F.sha1(T.normalize_page_text(broken).cast("binary")).alias("normal_sha1"))


@query
def offset_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses found in running text, and how many of them stand, broken or not, where their offsets lead in the raw text."""
    broken = F.regexp_replace("text", "([a-z]{4})([a-z]{4})", "$1-\n $2")
    raw = documents(spark, sf).where("text is not null").select(F.col("doc_id").alias("text_id"), F.explode(F.array(broken)).alias("raw"))
    plain = raw.select("text_id", "raw", F.explode(F.array(T.normalize_page_text("raw"))).alias("text"))
    hits = detect.patterns(plain, ("EMAIL_ADDRESS",))
    back = flows.raw_spans(raw.withColumnRenamed("raw", "text"), hits)
    lists = back.groupBy("text_id").agg(F.collect_list(F.struct("start", "end", "text")).alias("found"))
    same = F.filter("found", lambda d: T.normalize_page_text(F.substring("raw", d["start"] + 1, d["end"] - d["start"])) == d["text"])
    return raw.join(lists, "text_id").select(F.col("text_id").alias("doc_id"), F.size("found").cast("long").alias("n"), F.size(same).cast("long").alias("n_same"))


# --- master list --------------------------------------------------------------------------------------------------------


@query
def master_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sheet_rows(spark, sf)


@query
def master_map_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return masterlist.master_map(sheet_rows(spark, sf)).drop("cand_ord")


@query
def names_by_entity(spark: SparkSession, sf: str) -> DataFrame:
    return masterlist.names_by_entity(sheet_rows(spark, sf))


@query
def counts_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return masterlist.counts_by_category(sheet_rows(spark, sf))


@query
def master_summary(spark: SparkSession, sf: str) -> DataFrame:
    return views.master_summary(sheet_rows(spark, sf))


@query
def duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return masterlist.duplicate_names(sheet_rows(spark, sf)).select("name", F.array_join("categories", ", ").alias("categories"))


@query
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    r = masterlist.quality_report(sheet_rows(spark, sf))
    return r.select("kind", "severity", "title", F.array_join("examples", " ; ").alias("examples"), "total")


@query
def conflicting_ids(spark: SparkSession, sf: str) -> DataFrame:
    return masterlist.conflicting_ids(sheet_rows(spark, sf)).select("category", "norm_name", F.array_join("ids", ", ").alias("ids"))


@query
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return masterlist.duplicate_ids(sheet_rows(spark, sf)).select("category", "pseudonym", F.array_join("names", ", ").alias("names"))


def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Given names and stand-ins as rows of a list: some are ordinary words."""
    names = table(spark, sf, "nickname").select(F.explode(F.array("short_form", "full_form")).alias("name")).unionByName(table(spark, sf, "stand_in").select(F.col("word").alias("name"))).distinct()
    return names.select(F.crc32(F.col("name").cast("binary")).alias("row_ord"), F.lit("Staff").alias("category"), "name", F.lit("PERSON").alias("entity_type"), F.lit(None).cast("string").alias("pseudonym"))


@query
def ambiguous_words(spark: SparkSession, sf: str) -> DataFrame:
    return masterlist.ambiguous_words(word_rows(spark, sf)).select("category", "name")


@query
def quality_common(spark: SparkSession, sf: str) -> DataFrame:
    r = masterlist.quality_report(word_rows(spark, sf))
    return r.select("kind", "severity", "title", "total")


@query
def quality_blank(spark: SparkSession, sf: str) -> DataFrame:
    return sheet_rows(spark, sf).where("pseudonym is null").groupBy("category").agg(F.count("*").alias("n"))


@query
def whitespace_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "master_sheet").where("name is not null").select("row_id", T.collapse_blanks("name").alias("name"))


@query
def migration_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Text lists made from customers and suppliers, merged into a sheet made from the nations and some customers.

    A third of the customers stand in the list twice, with and without an id, a fifth with another id before their own,
    and every seventh is in the sheet already, half of them with an id.
    """
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    person = c.select(F.col("c_custkey").alias("ord"), F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.when(F.col("c_acctbal") >= 0, F.concat(F.lit(" - "), F.col("c_custkey").cast("string"))).otherwise(F.lit(" # no id"))).alias("value"))
    again = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") - (1 << 30)).alias("ord"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("value"))
    other = c.where("c_custkey % 5 = 0").select((F.col("c_custkey") - (1 << 31)).alias("ord"), F.concat(F.replace("c_name", F.lit("#"), F.lit(" ")), F.lit(" - "), (F.col("c_custkey") + 1000000).cast("string")).alias("value"))
    person = person.unionByName(again).unionByName(other)
    firm = s.select((F.col("s_suppkey") + (1 << 40)).alias("ord"), F.replace("s_name", F.lit("#"), F.lit(" ")).alias("value"))
    new = migrate.people(migrate.clean_lines(person)).unionByName(migrate.organisations(migrate.clean_lines(firm)))
    old = n.select(F.col("n_nationkey").cast("long").alias("ord"), F.lit("Funder").alias("Category"), F.col("n_nationkey").cast("string").alias("Internal ID"), F.col("n_name").alias("Name"))
    known = c.where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("long").alias("ord"), F.lit("Staff").alias("Category"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("old"), F.col("c_custkey").cast("string"))).alias("Internal ID"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("Name"))
    return migrate.merged(old.unionByName(known), new)


@query
def migration_totals(spark: SparkSession, sf: str) -> DataFrame:
    return migrate.totals(migration_merge(spark, sf))
