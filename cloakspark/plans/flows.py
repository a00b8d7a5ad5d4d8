"""The three flows: spreadsheet cells, pages, paragraph blocks. Each returns a `Result` of DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_name, normalize_page_text, page_offsets, search_variants, to_raw_span
from ..operators import assign as A
from ..operators import detect, resolve, splice
from ..session import materialise
from ..settings import DEFAULTS, Settings

PSEUDONYMIZE, BLACKOUT = "pseudonymize", "blackout"


@dataclass(frozen=True)
class Result:
    """`redacted` texts or table, `findings` that stand, the `crosswalk` of the run, and `boxes` to draw on pages. Keep the crosswalk apart: it names people."""

    redacted: DataFrame
    findings: DataFrame
    crosswalk: DataFrame
    boxes: DataFrame | None = None


def text_columns(df: DataFrame) -> list[str]:
    """What a scan takes when no columns are named: those of strings."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def unpivot(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """`row_id, col_pos, column, text`, columns that aren't there ignored, null as the empty text."""
    kept = [c for c in columns if c in df.columns]
    if not kept:
        return df.sparkSession.createDataFrame([], "row_id long, col_pos int, column string, text string")
    cells = F.array(*(F.struct(F.lit(n).alias("col_pos"), F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("text")) for n, c in enumerate(kept)))
    return df.select(F.col(row_id).cast("long").alias("row_id"), F.explode(cells).alias("c")).select("row_id", "c.col_pos", "c.column", "c.text")


def _not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def _digest(text: Column) -> Column:
    """A `text_id` that equal texts share: 256 bits of SHA-2, so whole texts are sorted and joined by it."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def with_text_ids(cells: DataFrame) -> DataFrame:
    """Cells that aren't blank with their `text_id`."""
    return cells.where(_not_blank(F.col("text"))).withColumn("text_id", _digest(F.col("text")))


def distinct_texts(cells: DataFrame) -> DataFrame:
    """`text_id, text`: each distinct text once. The only shuffle that carries texts, folded before it by hash, not by sorting."""
    return cells.select("text").distinct().select(_digest(F.col("text")).alias("text_id"), "text")


#: Scanned columns that a table is joined with its findings by, one after the other; with more of them, cells are joined and put into rows.
_DIRECT = 2


def _spliced_columns(df: DataFrame, chosen: Sequence[str], lists: DataFrame, row_id: str) -> DataFrame:
    """The table with its columns spliced where they stand, and `changed`; a join for each column, and no row is put together anew."""
    out, names = df, []
    for n, c in enumerate(chosen):
        text, key, spans = F.col(f"`{c}`").cast("string"), f"__text_{n}", f"__spans_{n}"
        # no digest is as short as these numbers, so blank cells meet nothing and are dealt out evenly
        out = out.withColumn(key, F.when(_not_blank(text), _digest(text)).otherwise(F.xxhash64(row_id).cast("string").cast("binary")))
        out = out.join(lists.withColumnsRenamed({"text_id": key, "spans": spans}), key, "left").withColumn(c, splice.spliced(text, spans))
        names.append(F.when(F.col(spans).isNotNull(), F.lit(c)))
    changed = F.array_sort(F.array_compact(F.array(*names)))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), changed.alias("changed"))


def documents_detector(rows: DataFrame, settings: Settings = DEFAULTS, entities: Iterable[str] | None = None):
    """The detections of cells and blocks: list names and patterns, thresholded and settled. Types not asked for are not planned."""
    from ..operators.masterlist import dictionary

    wanted = tuple(settings.entities if entities is None else entities)

    def run(texts: DataFrame) -> DataFrame:
        if set(wanted) <= {"PERSON", "ORGANIZATION"} and settings.master_score >= settings.score_threshold:  # the list alone: settled in the pass over the texts
            alone = detect.settled_dictionary(texts, dictionary(rows).where(F.col("entity_type").isin(*wanted)), settings.master_score)
            if alone is not None:
                return alone
        parts = []
        if {"PERSON", "ORGANIZATION"} & set(wanted):
            parts.append(detect.dictionary(texts, dictionary(rows).where(F.col("entity_type").isin(*wanted)), settings.master_score))
        if {"EMAIL_ADDRESS", "URL"} & set(wanted):
            parts.append(detect.patterns(texts, wanted, settings.pattern_score, "model"))
        return resolve.engine(detect.combine(*parts), settings.score_threshold)

    return run


def _values(spans: DataFrame, master: DataFrame | None, settings: Settings) -> DataFrame:
    """The spans with what they are replaced by: the id that the crosswalk has for the name.

    Each distinct surface form is normalised and looked up once, without its first place, which an id doesn't depend on.
    """
    forms = spans.select("entity_type", "text").distinct().select("entity_type", normalize_name("text").alias("norm_name"), F.col("text").alias("original_name"), F.lit(0).alias("ord"))
    valued = A.assign(forms, master, settings, with_hints=False).select("entity_type", F.col("original_name").alias("text"), F.col("pseudonym").alias("value"))
    return spans.join(valued.hint("shuffle_hash"), ["entity_type", "text"])  # distinct forms, far fewer than the spans, which needn't be sorted


def cells(df: DataFrame, detector: detect.Detector, master: DataFrame | None, columns: Sequence[str] | None = None, settings: Settings = DEFAULTS, row_id: str = "row_id", with_hints: bool = True) -> Result:
    """Scans the chosen (else all string) columns, each distinct text once, and replaces what is found in them.

    Cells without a finding and columns not scanned keep their values and types.
    """
    chosen = [c for c in (columns or [c for c in text_columns(df) if c != row_id]) if c in df.columns]
    long = with_text_ids(unpivot(df, chosen, row_id))
    texts = distinct_texts(long)
    places = long.select("row_id", "col_pos", "column", "text_id")
    spans = materialise(detector(texts))  # read by the crosswalk and by the splicing; far smaller than the texts
    findings = places.join(spans, "text_id")
    # the first surface form of a name: column by column, row by row, and the rightmost in a cell; a text's first place is that of its names
    first = places.groupBy("text_id").agg(F.min(F.struct("col_pos", "row_id")).alias("place"))
    named = spans.select("text_id", "entity_type", "text", (-F.col("start")).alias("from_right")).join(first, "text_id")
    forms = named.groupBy("entity_type", "text").agg(F.min(F.struct("place", "from_right")).alias("o")).select("entity_type", "text", "o.*")
    assigned = A.assign(A.distinct_names(forms, ["place", "from_right"]), master, settings, with_hints)
    values = _values(spans, master, settings)
    if 0 < len(chosen) <= _DIRECT:
        return Result(_spliced_columns(df, chosen, splice.span_lists(values), row_id), findings, assigned)
    with_spans = texts.join(spans.select("text_id").distinct(), "text_id", "left_semi")
    done = splice.redact(with_spans, values).select("text_id", "redacted")
    changed = places.join(done, "text_id").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "redacted"))).alias("new"))  # a row has a bounded number of columns
    out = df.join(changed.withColumnRenamed("row_id", "__row"), F.col(row_id).cast("long") == F.col("__row"), "left")
    redacted = out.select(*(F.coalesce(F.col("new")[c], F.col(f"`{c}`").cast("string")).alias(c) if c in chosen else F.col(f"`{c}`") for c in df.columns), F.coalesce(F.array_sort(F.map_keys("new")), F.expr("cast(array() as array<string>)")).alias("changed"))
    return Result(redacted, findings, assigned)


def _unit_id(units: DataFrame) -> DataFrame:
    """A text is named by its document and its place in it, both whole, so no two have one name."""
    return units.withColumn("text_id", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("unit_idx").cast("long").alias("unit_idx")))


def _units_result(units: DataFrame, spans: DataFrame, assigned: DataFrame, values: DataFrame) -> Result:
    done = splice.redact(units, values.select("text_id", "start", "end", "value"))
    back = [F.col("text_id.doc_id").alias("doc_id"), F.col("text_id.unit_idx").cast(dict(units.dtypes)["unit_idx"]).alias("unit_idx")]
    return Result(done.drop("text_id"), spans.select(*back, *(c for c in spans.columns if c != "text_id")), assigned)


def raw_spans(units: DataFrame, spans: DataFrame) -> DataFrame:
    """Detections in running text as ones in the raw texts (`text_id, text`); offsets are made once per text, where something was found."""
    rest = [c for c in spans.columns if c not in ("text_id", "start", "end")]
    lists = spans.groupBy("text_id").agg(F.collect_list(F.struct("start", "end", *rest)).alias("found"))
    placed = units.select("text_id", "text").join(lists, "text_id").select("text_id", "found", page_offsets("text").alias("o"))
    moved = F.transform("found", lambda d: F.struct(to_raw_span(F.col("o"), d["start"], d["end"]).alias("raw"), d.alias("d")))
    each = placed.select("text_id", F.explode(moved).alias("m"))
    return each.select("text_id", *(F.col(f"m.raw.{c}" if c in ("start", "end") else f"m.d.{c}").alias(c) for c in spans.columns if c != "text_id"))


def image_boxes(units: DataFrame) -> DataFrame:
    """`doc_id, unit_idx, image_idx, x0, y0, x1, y1, fill` of every image of pages with `images array<struct<x0,y0,x1,y1>>`.

    An image is covered by a black box of its own size, whatever the style of the text; null and empty lists have none.
    """
    each = units.select("doc_id", "unit_idx", F.posexplode("images").alias("image_idx", "box")).where("box is not null")
    return each.select("doc_id", "unit_idx", "image_idx", *(F.col(f"box.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit("black").alias("fill"))


def searched(found: DataFrame, page: str = "page", text: str = "text", raw: str | None = None) -> DataFrame:
    """The rows with `candidate`, what to look for on the page, and `n_places`, how often it stands there.

    Tried are the text found, its variants, then what stands at its place in the raw page, and the variants of that; the
    first that the page holds, in any case of letters, is taken. Null and 0 if it holds none.
    """
    tried = [F.array(F.col(text)), search_variants(text)] + ([F.array(F.col(raw)), search_variants(raw)] if raw else [])
    low = F.lower(F.col(page))
    fits = F.filter(F.array_distinct(F.concat(*tried)), lambda c: low.contains(F.lower(c)))
    out = found.withColumn("candidate", F.try_element_at(fits, F.lit(1)))
    sought = F.lower("candidate")
    return out.withColumn("n_places", F.coalesce((F.length(low) - F.length(F.replace(low, sought, F.lit("")))) / F.length(sought), F.lit(0)).cast("int"))


def pages(units: DataFrame, words: Iterable[str] = (), style: str = PSEUDONYMIZE, settings: Settings = DEFAULTS, redact_images: bool = False) -> Result:
    """Pages `doc_id, unit_idx, text[, images]`: patterns and typed words on the running text, replaced in the raw text. No list is used.

    With `redact_images` the result has the boxes that cover the images, in either style and whether or not words are found.
    """
    ids, words = _unit_id(units), tuple(words)
    plain = ids.select("text_id", F.col("text").alias("raw"), F.explode(F.array(normalize_page_text("text"))).alias("text"))  # a generator, so that it is worked out once and not in every expression that reads it
    # one pass over the pages, offsets in the raw text included; far smaller than they are
    found = materialise(detect.patterns_and_words(plain, settings.entities, words, settings.pattern_score, settings.custom_score, "raw"))
    addresses = resolve.engine(found.where("source = 'pattern match'"), settings.pages_threshold)
    spans = materialise(resolve.staged(addresses, found.where("source = 'custom word'"))) if words else addresses
    ranked = spans.withColumn("p", resolve.priority())
    assigned = A.assign(A.distinct_names(ranked, ["text_id", "p", "start"]), None, settings)
    where = ["text_id", "start", "end"]
    raw = spans.join(found.select(*where, "raw_start", "raw_end").distinct(), where).drop("start", "end").withColumnsRenamed({"raw_start": "start", "raw_end": "end"})
    result = _units_result(ids, spans, assigned, splice.blacked_out(raw) if style == BLACKOUT else _values(raw, None, settings))
    return replace(result, boxes=image_boxes(units)) if redact_images and "images" in units.columns else result


def blocks(units: DataFrame, detector: detect.Detector, master: DataFrame | None, words: Iterable[str] = (), settings: Settings = DEFAULTS, with_hints: bool = True) -> Result:
    """Paragraphs `doc_id, unit_idx, text[, runs]`: the detector's findings, then typed words, settled in two stages.

    With a column `runs` the redacted runs come as `redacted_runs`, a value in the run where its span starts.
    """
    ids, words = _unit_id(units), tuple(words)
    texts = ids.select("text_id", "text")
    found = detector(texts)
    spans = materialise(resolve.staged(found, detect.custom_words(texts, words, settings.custom_score)) if words else found)
    ranked = spans.withColumn("p", resolve.priority())
    assigned = A.assign(A.distinct_names(ranked, ["text_id", "p", "start"]), master, settings, with_hints)
    values = _values(spans, master, settings)
    result = _units_result(ids, spans, assigned, values)
    if "runs" not in units.columns:
        return result
    lists = splice.span_lists(values.select("text_id", "start", "end", "value"))
    with_runs = ids.join(lists, "text_id", "left").withColumn("redacted_runs", splice.spliced_runs("runs", "spans"))
    return Result(with_runs.withColumn("redacted", splice.runs_text("redacted_runs")).drop("text_id", "spans"), result.findings, assigned)


def observed(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that counts them as they go by: progress without a second pass."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch


def flow_of(file_name: str) -> str:
    """Which flow takes a file, by its extension."""
    extension = file_name.rpartition(".")[2].lower() if "." in file_name else ""
    flows = {"xlsx": "cells", "xls": "cells", "pdf": "pages", "docx": "blocks"}
    if extension not in flows:
        raise ValueError(f"no flow for files of type {extension or 'none'}")
    return flows[extension]
