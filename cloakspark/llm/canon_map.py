"""Freely typed names mapped to the entries of a canonical list.

Distinct values are normalised (`namerules`), their character n-grams look up candidates in an inverted index of the
list, candidates are scored by the cosine of their n-gram weights (rare n-grams weigh more), and the best at or above a
threshold is accepted, if it agrees word by word with the value and stands off from the next by a margin. What has no
such entry is reported as 0. Typed copies of one name cost one look-up, however many rows have it.

The index is a table of (n-gram, entry, weight) that the n-grams of the values are joined with; scores are grouped sums.
An index of at most `MAX_SENT` rows, counted, is sent to the tasks, so that a value's scores are summed where it is;
beyond that both sides are shuffled by n-gram. No task and no driver holds the list. Words of lines of business are
learned from the list itself (`linewords`), short forms of them from the typed names too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread
from .linewords import frequent, lines_of
from .name_variants import by_sound, is_named, nicknames_of, parsed, sound
from .namerules import Name, distance

#: Rows of the index up to which it is sent to the tasks (about 50 MB); a larger one is joined by n-gram.
MAX_SENT = 1_000_000

#: Stands for the errors of a value that ends in the midst of its entry.
CUT_SHORT = 9


def grams(n: Name, size: int = 3) -> list[str]:
    """The n-grams of each word by sound, with its two ends; of a given name also its initial."""
    out = []
    for w in (*n.parts, *n.lines):
        padded = f"^{by_sound(w)}$"
        out += [padded[i : i + size] for i in range(max(1, len(padded) - size + 1))]
    if n.kind == "P":
        out += [f"^{w[:1]}." for w in n.parts] if len(n.parts) > 1 else [f"^{c}." for c in n.initials[:1]]
    return out


def same_name(value: Name, entry: Name, givens: Collection[str]) -> int | None:
    """Errors between a value and an entry if they can mean the same, else None.

    An organisation must have the entry's line of business, a person its given name in full, short, by initial or with
    an error that doesn't make it another known given name. An organisation's name may also break off after its core.
    """
    if value.kind != entry.kind:
        return None
    if value.kind == "O":
        if value.lines != entry.lines:
            return CUT_SHORT if len(value.letters) >= len(entry.parts[0]) and entry.letters.startswith(value.letters) else None
        return _errors(value.parts[0], entry.parts[0])
    if len(entry.parts) != 2:
        return 0 if sorted(value.parts) == sorted(entry.parts) else None
    given, last = entry.parts
    if len(value.parts) == 1:
        if not value.initials or value.initials[0] != given[0]:
            return None
        return _errors(value.parts[0], last)
    if len(value.parts) > 2:  # a word typed in two
        value = min((Name("P", (value.parts[0], "".join(value.parts[1:]))), Name("P", ("".join(value.parts[:-1]), value.parts[-1]))), key=lambda v: min(distance(p, last) for p in v.parts))
    best = None
    for a, b in (value.parts, value.parts[::-1]):
        if a != given and a in givens:
            continue
        g = 0 if a == given else _errors(a, given)
        s = _errors(b, last)
        if g is not None and s is not None and g + s <= 3 and (best is None or g + s < best):
            best = g + s
    return best


def _errors(a: str, b: str) -> int | None:
    """Errors that make one word the other; none in very short words, three at most in long ones."""
    n, short = min(distance(a, b), distance(by_sound(a), by_sound(b))), min(len(a), len(b))
    return n if n <= (0 if short < 3 else 1 if short < 6 else 2 if short < 9 else 3) else None


_GRAMS = ("grams", pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int32())])), "array<struct<gram:string,n:int>>", lambda n: [{"gram": f"{n.kind}{g}", "n": k} for g, k in Counter(grams(n)).items()])
_LETTERS = ("letters", pa.string(), "string", lambda n: n.letters)
_NAME = ("kind", "parts", "initials", "lines", "letters")


def _index(listed: DataFrame) -> DataFrame:
    """`gram, entry, weight, idf` of the list: the weights of an entry have length one."""
    n = listed.count()
    each = listed.select("entry", F.explode("grams").alias("g")).select("entry", "g.gram", "g.n")
    idf = each.groupBy("gram").agg(F.log(1 + n / F.count("*")).alias("idf"))
    weighed = each.join(idf, "gram").withColumn("w", F.col("idf") * F.col("n"))
    norms = weighed.groupBy("entry").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "entry").select("gram", "entry", (F.col("w") / F.col("norm")).alias("weight"), "idf")


def scored(keys: DataFrame, index: DataFrame, max_sent: int = MAX_SENT) -> DataFrame:
    """`value, entry, score`: the cosine of each value `value, grams` with every entry that it shares an n-gram with."""
    size, unseen = index.agg(F.count("*"), F.coalesce(F.max("idf"), F.lit(1.0))).first()
    sent = F.broadcast if size <= max_sent else lambda df: df.hint("merge")
    each = keys.repartition("value").select("value", F.explode("grams").alias("g")).select("value", "g.gram", "g.n")
    weighed = each.join(sent(index.select("gram", "idf").distinct()), "gram", "left").select("value", "gram", (F.coalesce("idf", F.lit(unseen)) * F.col("n")).alias("w"))
    # an n-gram of the value that no entry has lengthens it as the rarest would
    norms = weighed.groupBy("value").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(sent(index.select("gram", "entry", "weight")), "gram").groupBy("value", "entry").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    return dots.join(norms, "value").select("value", "entry", (F.col("dot") / F.col("norm")).alias("score"))


def _known(keys: DataFrame, listed: DataFrame, nicknames: dict[str, str]) -> DataFrame:
    """The values with `known`: those of their words, two run together included, that are given names of the list or full forms of nicknames."""
    spark = keys.sparkSession
    givens = listed.where("kind = 'P' and size(parts) = 2").select(F.col("parts")[0].alias("word"))
    givens = givens.unionByName(spark.createDataFrame([(w,) for w in nicknames.values()], "word string")).distinct()
    joined = F.when(F.size("parts") > 2, F.array(F.array_join(F.slice("parts", 2, 1 << 20), ""), F.array_join(F.slice("parts", F.lit(1), F.size("parts") - 1), ""))).otherwise(F.array().cast("array<string>"))
    words = keys.where("kind = 'P'").select("value", F.explode(F.array_distinct(F.concat("parts", joined))).alias("word"))
    return keys.join(words.join(givens, "word").groupBy("value").agg(F.collect_set("word").alias("known")), "value", "left")


def _plausible() -> Column:
    """What `same_name` asks for at least, of columns: the entry's line of business or its beginning, the initial, or few letters between the words."""
    v, e = F.col("v_parts"), F.col("e_parts")
    initial = F.substring("v_initials", 1, 1) == F.substring(e[0], 1, 1)
    apart = lambda a, b: F.least(F.levenshtein(a, b), F.levenshtein(sound(a), sound(b)))
    firm = ((F.col("v_lines") == F.col("e_lines")) & (apart(v[0], e[0]) <= 6)) | F.startswith("e_letters", "v_letters")
    # three errors at most, and a swap of neighbours counts twice here
    two = F.least(apart(v[0], e[0]) + apart(v[1], e[1]), apart(v[1], e[0]) + apart(v[0], e[1])) <= 6
    return F.when(F.col("v_kind") == "O", firm).when((F.size(e) != 2) | (F.size(v) > 2), True).when(F.size(v) == 1, initial).otherwise(two)


def _checked(pairs: DataFrame) -> DataFrame:
    """`value, canon_id, errors, score` of the pairs that can mean the same, word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(c).to_pylist() for c in b.schema.names}
            name = lambda side, i: Name(col[f"{side}_kind"][i], tuple(col[f"{side}_parts"][i]), col[f"{side}_initials"][i], tuple(col[f"{side}_lines"][i].split()), col[f"{side}_letters"][i])
            errors = pa.array([same_name(name("v", i), name("e", i), col["known"][i] or ()) for i in range(b.num_rows)], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("value"), b.column("canon_id"), errors, b.column("score")], ["value", "canon_id", "errors", "score"])

    return pairs.mapInArrow(run, "value long, canon_id long, errors int, score double").where("errors is not null")


def map_to_list(values: DataFrame, canon: DataFrame, nickname: DataFrame, threshold: float = 0.3, margin: float = 0.02, max_sent: int = MAX_SENT) -> DataFrame:
    """`name, entity_type, canon_id, score` of each distinct value: `canon_id` 0 and the best score of any entry if none is meant.

    Null and blank names are left out; a null entity type is read off the name (company form or line of business). Two
    entries that fit equally well within `margin`, in errors and score, decide nothing, so the value is reported as 0, and
    so is an initial that fits two given names;
    list entries without a name or an id are ignored; repeated rows count once; an empty list reports every value, an
    empty table gives an empty table; names are read whole; other columns are ignored.
    """
    entries = canon.select(F.col("canon_id").cast("long").alias("canon_id"), F.col("entity_type").cast("string").alias("entity_type"), F.coalesce("display_name", "norm_name").alias("name")).where("canon_id is not null and name is not null").distinct()
    distinct = values.select(F.col("name").cast("string").alias("name"), F.col("entity_type").cast("string").alias("entity_type")).where(is_named("name")).distinct()
    firms = lambda df: df.where("upper(trim(entity_type)) = 'ORGANIZATION'").select("name")
    words, short = lines_of(frequent(firms(entries)), frequent(firms(entries).unionByName(firms(distinct))))
    nicknames = nicknames_of(nickname)
    take_apart = lambda df: parsed(df, nicknames, words, short, (_LETTERS, _GRAMS))
    listed = materialise(take_apart(entries).where("kind is not null").withColumn("entry", F.monotonically_increasing_id()))
    # values of one normal form are looked up once
    form = F.concat_ws("|", "kind", F.concat_ws(" ", "parts"), "initials", "lines", "letters").alias("form")
    typed = materialise(take_apart(spread(distinct)).select("name", "entity_type", form, *_NAME, "grams"))
    keys = materialise(typed.where("kind is not null").dropDuplicates(["form"]).select("form", *_NAME, "grams").withColumn("value", F.monotonically_increasing_id()))
    index = materialise(_index(listed))
    scores = materialise(scored(keys.select("value", "grams"), index, max_sent).where(F.col("score") >= min(threshold, 0.2)))
    side = lambda df, s: df.select(*(F.col(c).alias(f"{s}_{c}") for c in _NAME), *(c for c in df.columns if c in ("value", "entry", "canon_id", "known")))
    pairs = scores.where(F.col("score") >= threshold).join(side(listed, "e"), "entry").join(side(_known(keys, listed, nicknames), "v"), "value").where("e_kind = v_kind").where(_plausible())
    fit = _checked(pairs).groupBy("value").agg(F.sort_array(F.collect_list(F.struct("errors", (-F.col("score")).alias("s"), "canon_id"))).alias("fit"))
    # what a value agrees with word by word are a few entries: those of one name
    best, next_ = F.col("fit")[0], F.try_element_at("fit", F.lit(2))
    apart = ((F.size("parts") > 1) | (F.col("kind") == "O")) & (next_["s"] - best["s"] >= margin)
    clear = next_.isNull() | ((best["errors"] < CUT_SHORT) & ((best["errors"] < next_["errors"]) | apart))
    top = scores.groupBy("value").agg(F.max("score").alias("top"))
    decided = keys.select("value", "form", "kind", "parts").join(top, "value", "left").join(fit, "value", "left")
    decided = decided.select("form", F.when(clear, best["canon_id"]).alias("found"), F.when(clear & best.isNotNull(), -best["s"]).otherwise(F.coalesce("top", F.lit(0.0))).alias("score"))
    return typed.select("name", "entity_type", "form").join(decided, "form", "left").select("name", "entity_type", F.coalesce("found", F.lit(0)).alias("canon_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def found(crosswalk: DataFrame, canon: DataFrame, nickname: DataFrame) -> DataFrame:
    """`xwalk_id, canon_id` of each freely typed name of the crosswalks; the hints they carry are not used."""
    typed = crosswalk.where("auto").select("xwalk_id", F.col("original_name").alias("name"), "entity_type").where("name is not null").distinct()
    mapped = map_to_list(typed, canon, nickname).select(F.col("name").alias("m_name"), F.col("entity_type").alias("m_type"), "canon_id")
    joined = typed.join(mapped, (typed["name"] == mapped["m_name"]) & typed["entity_type"].eqNullSafe(mapped["m_type"]))
    return joined.select("xwalk_id", "canon_id").distinct()
