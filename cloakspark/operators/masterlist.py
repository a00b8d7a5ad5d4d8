"""The curated master list: from raw sheets to rows, look-up map and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aliases import aliases
from ..functions.text import clean_id, clean_name, clean_text, curated_pseudonym, normalize_name
from ..session import materialise, numbered
from ..settings import DEFAULTS, Settings

# Ordinary English words that a name of one word may collide with.
COMMON_WORDS = frozenset(
    """a about above across after again against all almost along already also although always am among an and another any are
    around as at be became because been before being below between both but by can cannot could did do does doing done down
    during each either else even ever every few for from further had has have having he her here hers herself him himself his
    how however i if in into is it its itself just like may me might more most much must my myself near neither never no nor
    not now of off often on once only or other our ours ourselves out over own rather same shall she should since so some
    still such than that the their theirs them themselves then there these they this those through thus to too under until up
    upon us used very was we were what when where whether which while who whom whose why will with within without would yet
    you your yours yourself yourselves""".split()
)
EXAMPLES = 5
#: Rows that one sheet may have; places of different sheets never meet.
ROWS = 1 << 40


def _table(pairs: dict[str, str]):
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def parse_sheets(sheets: dict[str, DataFrame], settings: Settings = DEFAULTS) -> DataFrame:
    """Rows of all sheets: `row_ord, category, name, entity_type, pseudonym`.

    `sheets` maps a sheet's name to its table with `Name` and, if it has them, `Category`, `Internal ID` and a `row_id`
    that gives the order, else rows are numbered as they stand. Blank names and rows of another category than the sheet's are dropped; a missing sheet is
    skipped; categories come in the order of the settings.
    """
    parts = []
    for order, (category, sheet) in enumerate(settings.sheets.items()):
        df = sheets.get(sheet)
        if df is None:
            continue
        if "Name" not in df.columns:
            raise ValueError(f"sheet {sheet} has no column Name")
        own = F.col("Category") if "Category" in df.columns else F.lit(category)
        dtype = dict(df.dtypes).get("Internal ID")
        internal = clean_id("`Internal ID`", dtype) if dtype else F.lit(None).cast("string")
        if "row_id" not in df.columns:
            df = numbered(df, "row_id")
        parts.append(df.select(F.lit(order).alias("sheet_ord"), F.lit(category).alias("wanted"), F.col("row_id").cast("long").alias("row_id"), clean_text(own).alias("category"), clean_name("Name").alias("name"), internal.alias("internal_id")))
    if not parts:
        raise ValueError("no sheet of the master list is there")
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return _parsed(df, settings)


def _parsed(df: DataFrame, settings: Settings) -> DataFrame:
    """List rows from `sheet_ord, wanted, row_id, category, name, internal_id`."""
    prefixes, types = _table(settings.prefix_of), _table(settings.entity_of)
    place = F.when(F.col("row_id").between(0, ROWS - 1), F.col("row_id")).otherwise(F.raise_error(F.format_string("row_id %s is not within 0 and 2^40 - 1, so it can't be a place in a sheet", F.col("row_id").cast("string"))))
    order = (F.col("sheet_ord").cast("long") * ROWS + place).alias("row_ord")
    kept = df.where((F.col("category") == F.col("wanted")) & (F.col("name") != ""))
    return kept.select(order, "category", "name", F.element_at(types, F.col("category")).alias("entity_type"), curated_pseudonym(F.element_at(prefixes, F.col("category")), F.col("internal_id")).alias("pseudonym"))


def from_raw_sheet(sheet: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows of one table that holds all sheets, with a column `sheet` that says which; read once."""
    of = F.create_map(*(x for order, (category, name) in enumerate(settings.sheets.items()) for x in (F.lit(name), F.struct(F.lit(order).alias("sheet_ord"), F.lit(category).alias("wanted")))))
    named = sheet.select(F.try_element_at(of, F.col("sheet")).alias("s"), F.col("row_id").cast("long").alias("row_id"), clean_text("category").alias("category"), clean_name("name").alias("name"), clean_id("internal_id").alias("internal_id"))
    return _parsed(named.where("s is not null").select("s.sheet_ord", "s.wanted", "row_id", "category", "name", "internal_id"), settings)


def master_map(rows: DataFrame) -> DataFrame:
    """`entity_type, norm_name, pseudonym, category, display_name, cand_ord` with one entry per type and normalised name.

    Only rows with a pseudonym count. A name itself goes before any alias of another; among names the first row holds the
    key, and a later row of the same pseudonym renews the entry; aliases fill what is free, by row and then by their order.
    `cand_ord` is the order of the list: names by the first row that has the key, then aliases.
    """
    curated = rows.where("pseudonym is not null and entity_type is not null")
    key = ["entity_type", "norm_name"]
    order = lambda alias, row, form: F.struct(F.lit(alias).alias("alias"), F.col(row).alias("row_ord"), form.cast("int").alias("form_ord")).alias("cand_ord")
    # one row for each spelling of a name, so a name typed many times is expanded once and weighs as one in the joinless rest
    spelt = curated.groupBy("entity_type", "name", "pseudonym").agg(F.min("row_ord").alias("first_ord"), F.min_by("category", "row_ord").alias("first_category"), F.max("row_ord").alias("last_ord"), F.max_by("category", "row_ord").alias("last_category"))
    # a name's entry: of its rows with the first row's pseudonym the last
    latest = F.max_by(F.struct(F.col("last_category").alias("category"), F.col("name").alias("display_name")), "last_ord")
    names = spelt.groupBy("entity_type", normalize_name("name").alias("norm_name"), "pseudonym").agg(F.min("first_ord").alias("first_ord"), latest.alias("e"))
    names = names.select(*key, "pseudonym", "e.category", "e.display_name", order(False, "first_ord", F.lit(0)))
    forms = spelt.select("entity_type", "pseudonym", F.col("first_category").alias("category"), F.col("name").alias("display_name"), "first_ord", F.posexplode(aliases("name")).alias("form_ord", "form")).where("form_ord > 0")
    forms = forms.select("entity_type", normalize_name("form").alias("norm_name"), "pseudonym", "category", "display_name", order(True, "first_ord", F.col("form_ord")))
    entry = F.min_by(F.struct("pseudonym", "category", "display_name", "cand_ord"), "cand_ord")
    return names.unionByName(forms).groupBy(*key).agg(entry.alias("e")).select(*key, "e.pseudonym", "e.category", "e.display_name", "e.cand_ord")


def dictionary(rows: DataFrame) -> DataFrame:
    """`entity_type, key` of every surface form of every name, rows without a pseudonym included."""
    return rows.where("entity_type is not null").select("entity_type", F.explode(aliases("name")).alias("key")).where("trim(key) <> ''").distinct()


def names_by_entity(rows: DataFrame) -> DataFrame:
    """`entity_type, row_ord, name`: the names of each type in list order. A relation, not one list per type, so it stays distributed."""
    return rows.where("entity_type is not null").select("entity_type", "row_ord", "name")


def counts_by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def summary(rows: DataFrame) -> DataFrame:
    """Rows in all (category null) and by category."""
    return rows.rollup("category").agg(F.count("*").alias("n"))


def duplicate_names(rows: DataFrame) -> DataFrame:
    """`name, categories` of each normalised name that stands in several categories."""
    by = rows.groupBy(normalize_name("name").alias("name")).agg(F.array_sort(F.collect_set("category")).alias("categories"), F.min("row_ord").alias("first_ord"))
    return by.where(F.size("categories") > 1)


def _issue(items: DataFrame, kind: str, severity: str, title: str, detail: str) -> DataFrame:
    """One row from `ord, example`: the total, and the first examples by a bounded top-k."""
    ranked = items.orderBy("ord").limit(EXAMPLES)  # the five examples are what the report shows
    examples = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "example"))), lambda s: s["example"]).alias("examples"))
    total = items.agg(F.count("*").alias("total"))
    joined = total.join(F.broadcast(examples)).where("total > 0")  # one row each
    return joined.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.concat(F.col("total").cast("string"), F.lit(title)).alias("title"), F.lit(detail).alias("detail"), "examples", "total")


def conflicting_ids(rows: DataFrame) -> DataFrame:
    by = rows.where("pseudonym is not null").groupBy("category", normalize_name("name").alias("norm_name")).agg(F.array_sort(F.collect_set("pseudonym")).alias("ids"), F.min("row_ord").alias("ord"))
    return by.where(F.size("ids") > 1)


def duplicate_ids(rows: DataFrame) -> DataFrame:
    by = rows.where("pseudonym is not null").groupBy("category", "pseudonym").agg(F.array_sort(F.collect_set("name")).alias("names"), F.min("row_ord").alias("ord"))
    return by.where(F.size("names") > 1)


def ambiguous_words(rows: DataFrame) -> DataFrame:
    name = clean_text("name")
    return rows.where(~name.contains(" ") & F.lower(name).isin(*sorted(COMMON_WORDS)))


def quality_report(rows: DataFrame) -> DataFrame:
    """Up to five findings about the list (kinds, severities, titles and examples are fixed values): `kind, severity, title, detail, examples, total`; none that doesn't occur."""
    rows = materialise(rows)  # read by each finding twice, for the total and for the first examples
    tick = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    listed = lambda c: F.array_join(c, ", ")
    of_category = F.concat(F.lit(" ("), F.col("category"), F.lit(")"))
    one = lambda d: d.select(F.col("row_ord").alias("ord"), F.concat(tick("name"), of_category).alias("example"))
    cross = duplicate_names(rows).select(F.col("first_ord").alias("ord"), F.concat(tick("name"), F.lit(" appears in: "), listed("categories")).alias("example"))
    conflict = conflicting_ids(rows).select("ord", F.concat(tick("norm_name"), of_category, F.lit(" has IDs: "), listed("ids")).alias("example"))
    reused = duplicate_ids(rows).select("ord", F.concat(F.lit("ID "), tick("pseudonym"), of_category, F.lit(" used by: "), listed("names")).alias("example"))
    parts = [
        _issue(cross, "cross_category_duplicate", "warning", " name(s) appear under multiple categories", "One name in several categories can get conflicting pseudonyms; keep it in one."),
        _issue(conflict, "conflicting_ids", "warning", " name(s) have multiple Internal IDs", "One ID is used per name and the others are ignored; keep one."),
        _issue(one(rows.where("pseudonym is null")), "blank_ids", "info", " name(s) have no Internal ID", "Such names are found but get a made-up, flagged ID; add an Internal ID."),
        _issue(reused, "duplicate_ids", "warning", " Internal ID(s) reused by multiple names", "Different names share one pseudonym; give each its own ID."),
        _issue(one(ambiguous_words(rows)), "ambiguous_common_word", "info", " name(s) are also ordinary English words", "Every ordinary use of the word is found too; check that this is meant."),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
