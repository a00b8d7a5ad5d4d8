"""Scalar text functions as column expressions; offsets are code points throughout."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import AUTO_PREFIXES

# Joined letters that typesetting puts for several, and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
# Letters whose full case folding isn't their lower case, as far as names hold them.
CASE_FOLDS = {"ß": "ss", "ς": "σ", "µ": "μ", "ſ": "s", **{k: v for k, v in LIGATURES.items() if k != "ﬅ"}, "ﬅ": "st"}
# Company forms that stand for one another.
COMPANY_FORMS = {"ltd": ["ltd", "limited"], "inc": ["inc", "incorporated"], "corp": ["corp", "corporation"], "co": ["co", "company"], "llc": ["llc"], "plc": ["plc"]}
WORD = r"[\p{L}\p{N}_]"
BLANK = r"(?U)[\s\x1c-\x1f]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _replaced(x: Column, pairs: dict[str, str]) -> Column:
    """All replacements, made only where one of the letters occurs."""
    return F.when(x.rlike("[" + "".join(pairs) + "]"), reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), x)).otherwise(x)


def collapse_blanks(x: Column | str) -> Column:
    """Runs of blanks, of any kind, as one space; none at the ends."""
    return F.trim(F.regexp_replace(col(x), BLANK + "+", " "))


def normalize_name(x: Column | str) -> Column:
    """The key under which a name is looked up: blanks collapsed, case folded."""
    return _replaced(F.lower(collapse_blanks(x)), CASE_FOLDS)


def clean_text(x: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(col(x).cast("string"), rf"^{BLANK}+|{BLANK}+$", ""), F.lit(""))


def clean_name(x: Column | str) -> Column:
    """A list entry's name without what follows the first dash between blanks, blanks collapsed."""
    return collapse_blanks(F.regexp_replace(clean_text(x), r"(?Us)\s+-\s.*$", ""))


def clean_id(x: Column | str, dtype: str = "string") -> Column:
    """A list entry's id as text: whole numbers without a decimal part, null for nothing."""
    x = col(x)
    if dtype in ("double", "float"):
        whole = F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
        return F.when(F.isnan(x), None).otherwise(whole)
    return F.nullif(clean_text(x), F.lit(""))


def curated_pseudonym(prefix: Column, internal_id: Column) -> Column:
    """`prefix-id`, null for a null id."""
    return F.concat(prefix, F.lit("-"), internal_id)


def auto_pseudonym(entity_type: Column | str, norm: Column | str, length: int = 5, prefixes: dict[str, str] | None = None) -> Column:
    """A made-up id that depends on the normalised name only, behind a prefix for its type."""
    prefixes = AUTO_PREFIXES if prefixes is None else prefixes
    table = F.create_map(*(F.lit(x) for kv in prefixes.items() for x in kv))
    prefix = F.coalesce(F.element_at(table, col(entity_type)), F.upper(F.substring(col(entity_type), 1, 3)))
    return F.concat(prefix, F.lit("-AUTO-"), F.upper(F.substring(F.sha1(col(norm).cast("binary")), 1, length)))


def recase_uppercase(x: Column | str) -> Column:
    """Words of two or more letters, all upper case, with only the first left so; every length stays."""
    runs = F.regexp_extract_all(col(x), F.lit(f"({WORD}+|[^\\p{{L}}\\p{{N}}_]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.when(w.rlike(r"^\p{Lu}{2,}$"), F.concat(F.substring(w, 1, 1), F.lower(F.substring(w, 2, 1_000_000)))).otherwise(w)), "")


def without_ligatures(x: Column | str) -> Column:
    return _replaced(col(x), LIGATURES)


_HYPHEN_BREAK = r"(?U)-\s*\n\s*(?=[\p{L}\p{N}])"


def normalize_page_text(x: Column | str) -> Column:
    """Page text as running text: joined letters parted, words broken at a line's end put together, blanks collapsed."""
    return collapse_blanks(F.regexp_replace(without_ligatures(x), _HYPHEN_BREAK, ""))


_BREAK = re.compile(r"-\s*\n\s*(?=[^\W_])")
_BLANKS = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def _offsets(raw: str) -> np.ndarray:
    """Hyphen breaks are gone, of a run of blanks between letters the first is left, a joined letter counts as many as it stands for."""
    letters = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.arange(len(letters), dtype=np.int32)
    if "-" in raw:
        keep = np.ones(len(letters), bool)
        for m in _BREAK.finditer(raw):
            keep[m.start() : m.end()] = False
        at, letters = at[keep], letters[keep]
    blank = np.isin(letters, _BLANKS)
    before = np.concatenate([[True], blank[:-1]]) if len(blank) else blank
    kept = ~blank | ~before
    at, letters, blank = at[kept], letters[kept], blank[kept]
    if len(at) and blank[-1]:
        at, letters = at[:-1], letters[:-1]
    joined = [c for c in LIGATURES if c in raw]
    if joined:
        n = np.ones(len(at), np.int64)
        for c in joined:
            n[letters == ord(c)] = len(LIGATURES[c])
        at = np.repeat(at, n)
    return at


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def page_offsets(raw: pd.Series) -> pd.Series:
    """For each code point of `normalize_page_text` the place in the raw text it came from.

    One linear pass. Column expressions can't keep a running sum over a long array without copying it at every step, so
    this is an Arrow-batched function; flows call it only on texts in which something was found.
    """
    return raw.map(lambda t: None if t is None else _offsets(t))


def to_raw_span(offsets: Column | str, start: Column | str, end: Column | str) -> Column:
    """A span of the normalised text as one of the raw text; without offsets or for an empty span, itself."""
    o, s, e = col(offsets), col(start), col(end)
    plain = (F.size(o) == 0) | (e <= s)
    return F.struct(F.when(plain, s).otherwise(F.get(o, s)).cast("int").alias("start"), F.when(plain, e).otherwise(F.get(o, e - 1) + 1).cast("int").alias("end"))


def regex_spans(x: Column | str, pattern: str) -> Column:
    """`array<struct<start,end,text>>` of all matches of a pattern, by lengths of what stands between them.

    Neither `regexp_instr` (it counts UTF-16 units) nor a running sum over the whole text is used.
    """
    t = col(x)
    between = F.split(t, pattern, -1)
    hits = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out"))

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), p["hit"].alias("text"))
        return F.when(p["hit"].isNull(), s).otherwise(F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out")))

    zipped = F.zip_with(between, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))  # what follows the last match has none
    return F.aggregate(zipped, state, step, lambda s: s["out"])


def without_company_form(x: Column | str) -> Column:
    """A name without the stops at its end, and then without the company form there."""
    forms = "|".join(form for forms in COMPANY_FORMS.values() for form in forms)
    bare = F.regexp_replace(col(x), r"(?U)\s*[.,;]*\s*$", "")
    return F.trim(F.regexp_replace(bare, rf"(?iU)\s*(?<!{WORD})(?:{forms})$", ""))


def search_variants(x: Column | str) -> Column:
    """What else to look for when a text isn't found as it is: fewer blanks, no final stop, the other `and`, no company form."""
    t = col(x)
    changed = F.array(
        collapse_blanks(t),
        F.trim(F.regexp_replace(t, r"[.,;]+$", "")),
        F.replace(t, F.lit("&"), F.lit("and")),
        F.regexp_replace(t, r"(?i)\band\b", "&"),
        without_company_form(t),
    )
    return F.array_distinct(F.filter(changed, lambda v: (v != t) & (v != "")))


def output_base_name(x: Column | str) -> Column:
    """A file name without its extension, with `_` for all that isn't a word character or a dash."""
    return F.regexp_replace(F.regexp_replace(col(x), r"\.[^.]*$", ""), r"[^\p{L}\p{N}_\-]", "_")


def html_escaped(x: Column | str) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")], col(x))
