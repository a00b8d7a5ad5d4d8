"""Variant spellings of one person or organisation, linked by canonical rewritings.

Each distinct name is rewritten by rule (`namerules`: look-alikes, accents, titles, nicknames, company forms, lines of
business in short or in full, order) to a key, which joins all spellings without an error. Errors are bridged word by
word: each distinct word of the keys, not each name, is exploded into its rewritings (by sound, with one letter left
out, or two of a long word), which are equi-joined; a word that is rare beside one of them, by the number of keys that
have it, may be an error of it. Every key is then rewritten with one or two of its words replaced so, and the rewritings
are equi-joined with the keys. A key points to its best rewriting: one that is a key itself, then the fewest errors, then
the commoner word. An initial is a rewriting of every given name, and is resolved only if one single person fits it.

Pointers lead to commoner words, so there are no circles, and they are followed until none changes. A spelling that lies
between two established ones (more than `RARE` keys have each of their words) goes to the better and doesn't join them;
if neither is established, it does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread
from .linewords import frequent, lines_of
from .namerules import Lines, Rules, nickname_table, parse

#: Letters from which on a word may have two errors that no spelling in between bridges.
_LONG = 9
#: Keys that may have a word before it counts as established.
RARE = 2
#: Names that a task holds parsed at once.
_PARSED_AT_ONCE = 10_000
#: Rows of a class that meet in one task when pairs are made.
_PAIR_BLOCK = 2000

# Letters that are written for one another because they sound alike.
SOUNDS = (("ph", "f"), ("y", "i"), ("j", "i"), ("z", "s"), ("w", "v"), ("k", "c"))


def by_sound(word: str) -> str:
    """The word with letters of like sound made one."""
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return word


def sound(word: Column) -> Column:
    """`by_sound` of a column."""
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), SOUNDS, word)


def _one_left_out(w: Column) -> Column:
    """The word and each rewriting with one letter left out; words of three letters or fewer stand as they are."""
    one = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.when(F.length(w) <= 3, F.array(w)).otherwise(F.concat(F.array(w), one))


def _two_left_out(w: Column) -> Column:
    """The word and each rewriting with one or two letters left out."""
    cut = lambda i, j: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, j - i - 1), F.substring(w, j + 1, F.length(w)))
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.transform(F.sequence(i + 1, F.length(w)), lambda j: cut(i, j))))
    return F.concat(_one_left_out(w), two)


def nicknames_of(nickname: DataFrame) -> dict[str, str]:
    """The nickname list, a fixed table of given names in use: it grows with languages, not with rows."""
    return nickname_table([(r[0], r[1]) for r in nickname.select("short_form", "full_form").where("short_form is not null and full_form is not null").distinct().toLocalIterator()])


def is_named(column: str) -> str:
    """SQL: neither null nor blank."""
    return f"{column} is not null and {column} rlike '(?U)[^\\\\s\\\\p{{Cf}}]'"


def parsed(names: DataFrame, nicknames: dict[str, str], words: list[str], short: list[str], more: Sequence[tuple] = ()) -> DataFrame:
    """The table of `name, entity_type` with `key` and what it is made of: `kind` (null without letters), `parts`, `initials`, `lines`.

    `more` adds columns: (name, type in Arrow, type in SQL, function of a `Name`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(nicknames, Lines(words, short))
        for b in (whole.slice(i, _PARSED_AT_ONCE) for whole in batches for i in range(0, whole.num_rows, _PARSED_AT_ONCE)):
            names = b.column("name").to_pylist()
            got = [parse(n, e, rules) for n, e in zip(names, b.column("entity_type").to_pylist())]
            real = [any(g.parts) for g in got]
            cols = [
                pa.array([g.key if r else f"R|{n}" for g, n, r in zip(got, names, real)], pa.string()),
                pa.array([g.kind if r else None for g, r in zip(got, real)], pa.string()),
                pa.array([list(g.parts) if r else [] for g, r in zip(got, real)], pa.list_(pa.string())),
                pa.array([g.initials for g in got], pa.string()),
                pa.array([" ".join(g.lines) for g in got], pa.string()),
            ]
            cols += [pa.array([f(g) for g in got], kind) for _, kind, _, f in more]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "key", "kind", "parts", "initials", "lines", *(m[0] for m in more)])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema)
    return names.mapInArrow(run, f"{own}, key string, kind string, parts array<string>, initials string, lines string" + "".join(f", {m[0]} {m[2]}" for m in more))


def _key(parts: Column) -> Column:
    """`namerules.Name.key` of other parts."""
    return F.concat(F.col("kind"), F.lit("|"), F.array_join(F.array_sort(parts), " "), F.lit("|"), F.col("initials"), F.col("lines"))


def _replaced(at: str, word: str, parts: Column) -> Column:
    return F.transform(parts, lambda w, i: F.when(i == F.col(at), F.col(word)).otherwise(w))


def _meeting(words: DataFrame, rewritings: Callable[[Column], Column]) -> DataFrame:
    """`a, b`: the numbers of each two words of one kind that share a rewriting, each pair once."""
    split = words.withColumn("m", sound(F.replace("word", F.lit("rn"), F.lit("m")))).withColumn("s", sound(F.col("word")))
    every = F.when(F.col("s") == F.col("m"), rewritings(F.col("s"))).otherwise(F.concat(rewritings(F.col("s")), rewritings(F.col("m"))))
    forms = split.select("kind", "w", F.explode(every).alias("form")).select(F.xxhash64("kind", "form").alias("form"), F.col("w").alias("a"))
    # never a broadcast: what an explosion makes is no size that the planner knows
    return forms.hint("merge").join(forms.withColumnRenamed("a", "b"), "form").where("a < b").select("a", "b").distinct()


def similar_words(words: DataFrame) -> DataFrame:
    """`kind, word, to, errors, weight`: what each of the distinct words `kind, word, df, trusted` may be an error of.

    `to` stands higher: more keys have it, or as many and it is on the list, or it is later in the alphabet. The word must
    be rare beside it, or just rarer where one error parts two long words, unless both sound alike; `weight` says how much commoner `to` is. First all words meet with one
    letter left out; then the long ones that this finds no `to` for meet each other and the established ones with two
    left out. However many rows there are, a rewriting is shared by one word at most for each letter of the alphabet in
    each place (or two).
    """
    words = words.withColumn("w", F.xxhash64("kind", "word"))

    def judged(met: DataFrame) -> DataFrame:
        one, two = (words.select(*(F.col(c).alias(f"{c}_{x}") for c in ("w", "kind", "word", "df", "trusted"))) for x in "ab")
        both = met.join(one, met["a"] == one["w_a"]).join(two, met["b"] == two["w_b"]).where("kind_a = kind_b")
        low, high = (F.struct(*(F.col(f"{c}_{x}").alias(c) for c in ("df", "trusted", "word"))) for x in "ab")
        both = both.select(F.col("kind_a").alias("kind"), F.least(low, high).alias("low"), F.greatest(low, high).alias("high"))
        near = both.select("kind", F.col("low.word").alias("word"), F.col("low.df").alias("df"), F.col("high.word").alias("to"), F.col("high.df").alias("to_df"))
        x, y = sound(F.col("word")), sound(F.col("to"))
        m, n = (sound(F.replace(c, F.lit("rn"), F.lit("m"))) for c in ("word", "to"))
        # hashes only bring words together; whether they are near enough is seen here
        near = near.withColumn("errors", F.least(F.levenshtein(x, y), F.levenshtein(m, y) + 1, F.levenshtein(x, n) + 1)).where(F.col("errors") <= F.when(F.least(F.length("word"), F.length("to")) <= 4, 1).otherwise(3))
        slip = (F.col("errors") == 1) & (F.least(F.length("word"), F.length("to")) >= _LONG) & (F.col("df") < F.col("to_df"))
        rare = (F.col("errors") == 0) | (F.col("df") <= RARE) | (F.col("df") * 2 <= F.col("to_df")) | slip
        return near.where(rare).select("kind", "word", "to", "errors", (F.col("to_df") / F.col("df")).alias("weight"))

    first = materialise(judged(_meeting(words, _one_left_out)))
    done = first.select("kind", "word").distinct()
    long = words.where(F.length("word") >= _LONG)
    open_ = long.where((F.col("df") > RARE) | F.col("trusted")).unionByName(long.where((F.col("df") <= RARE) & ~F.col("trusted")).join(done, ["kind", "word"], "left_anti"))
    second = judged(_meeting(open_, _two_left_out)).join(done, ["kind", "word"], "left_anti")
    return first.unionByName(second)


def _rewritten(nodes: DataFrame, similar: DataFrame) -> DataFrame:
    """`key, to, errors, weight, at, word`: each key with one of its words replaced (then `at, word` say which and by what), or two."""
    parts = nodes.where("kind is not null and (kind = 'O' or size(parts) > 1 or initials <> '')").select("key", "kind", "parts", "initials", "lines", F.posexplode("parts").alias("at", "word"))
    one = parts.join(similar.withColumnRenamed("to", "new"), ["kind", "word"]).select("key", "kind", "parts", "initials", "lines", "at", "new", "errors", "weight")
    two = one.join(one.select("key", F.col("at").alias("at2"), F.col("new").alias("new2"), F.col("errors").alias("e2"), F.col("weight").alias("w2")), "key").where("at < at2")
    both = two.select("key", _key(_replaced("at2", "new2", _replaced("at", "new", F.col("parts")))).alias("to"), (F.col("errors") + F.col("e2")).alias("errors"), F.least("weight", "w2").alias("weight"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("string").alias("word"))
    return one.select("key", _key(_replaced("at", "new", F.col("parts"))).alias("to"), "errors", "weight", "at", F.col("new").alias("word")).unionByName(both)


def _follow(pointers: DataFrame) -> DataFrame:
    """`key, root` of `key, root` pointers without circles: each round doubles the steps, until one changes none."""
    while True:
        up = pointers.select(F.col("key").alias("root"), F.col("root").alias("above"))
        pointers = materialise(pointers.join(up, "root", "left").select("key", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        if pointers.where("moved").isEmpty():
            return pointers.drop("moved")
        pointers = pointers.drop("moved")


def _components(edges: DataFrame) -> DataFrame:
    """`key, root` of every end of undirected edges `a, b`: the least end that it can be reached from; rounds until none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = materialise(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        least = both.join(label, both["b"] == label["key"]).groupBy("a").agg(F.min("root").alias("near"))
        up = label.select(F.col("key").alias("root"), F.col("root").alias("above"))
        new = label.join(least, label["key"] == least["a"]).join(up, "root", "left")
        new = new.select("key", F.least("root", "near", F.coalesce("above", "root")).alias("new"), "root")
        label = materialise(new.select("key", F.col("new").alias("root"), (F.col("new") != F.col("root")).alias("moved")))
        if label.where("moved").isEmpty():
            return label.drop("moved")
        label = label.drop("moved")


def link_classes(named: DataFrame, nickname: DataFrame, trusted: str = "trusted", hint: str | None = None) -> DataFrame:
    """`id, name, class` of each named row; rows of one class mean the same person or organisation.

    `named` has `id, name, entity_type` and a boolean column that says whether the row comes from a curated list, whose
    spelling is preferred. Null and blank names are left out. An id that comes twice with one name counts once; names
    without letters are a class for each spelling; an empty table gives an empty table; further columns are ignored;
    names are read whole. Names spelt the same are always one class, unless their entity types differ. `hint` names a
    column with another name that the row may mean; it is weak evidence, read only where an initial fits several people.
    """
    hinted = F.col(hint).cast("string") if hint else F.lit(None).cast("string")
    rows = named.select(F.col("id").cast("long").alias("id"), F.col("name").cast("string").alias("name"), "entity_type", F.coalesce(trusted, F.lit(False)).alias("trusted"), hinted.alias("hint"))
    rows = rows.where(f"id is not null and {is_named('name')}")
    distinct = rows.groupBy("name", "entity_type").agg(F.count("*").alias("n"), F.max("trusted").alias("trusted"))
    nicknames = nicknames_of(nickname)
    words, short = lines_of(frequent(rows.where("upper(trim(entity_type)) = 'ORGANIZATION'").select("name").distinct()))
    keyed = materialise(parsed(spread(distinct), nicknames, words, short))
    # tables that several steps read are written, so that no step's plan holds another's
    nodes = materialise(keyed.groupBy("key").agg(F.max("trusted").alias("trusted"), F.first("kind").alias("kind"), F.first("parts").alias("parts"), F.first("initials").alias("initials"), F.first("lines").alias("lines")))
    vocabulary = nodes.select("kind", "trusted", F.explode("parts").alias("word")).groupBy("kind", "word").agg(F.count("*").alias("df"), F.max("trusted").alias("trusted"))
    vocabulary = materialise(vocabulary)
    similar = materialise(similar_words(vocabulary))
    rewritten = materialise(_rewritten(nodes, similar))
    # a rewriting links if it is a key, or if it is one of two keys at least
    shared = rewritten.select("key", "to").distinct().groupBy("to").agg(F.count("*").alias("n"))
    real = nodes.select(F.col("key").alias("to"), F.lit(True).alias("real"))
    edges = materialise(rewritten.join(shared, "to").join(real, "to", "left").where("real or n > 1").select("key", "to", "errors", "weight", F.coalesce("real", F.lit(False)).alias("real")))
    best = F.max_by("to", F.struct("real", (-F.col("errors")).alias("near"), "weight", "to"))
    root = _follow(edges.groupBy("key").agg(best.alias("root")))

    # spellings that none is established of are one class by way of any between them
    ends = edges.select("key", "to").join(root.withColumnRenamed("root", "a"), "key").join(root.select(F.col("key").alias("to"), F.col("root").alias("up")), "to", "left").select("a", F.coalesce("up", "to").alias("b")).where("a <> b").distinct()
    ends = materialise(ends)
    if not ends.isEmpty():
        least = nodes.join(ends.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key").select("key", "kind", F.explode("parts").alias("word")).join(vocabulary, ["kind", "word"]).groupBy("key").agg(F.min("df").alias("least"))
        rare = least.where(F.col("least") <= RARE).select("key")
        loose = materialise(ends.join(rare.withColumnRenamed("key", "a"), "a").join(rare.withColumnRenamed("key", "b"), "b"))
        if not loose.isEmpty():
            joined = _components(loose).where("key <> root").select(F.col("key").alias("root"), F.col("root").alias("joint"))
            moved = root.join(joined, "root", "left").select("key", F.coalesce("joint", "root").alias("root"))
            root = materialise(moved.unionByName(joined.select(F.col("root").alias("key"), F.col("joint").alias("root")).join(root.select("key"), "key", "left_anti")))

    rooted = materialise(nodes.drop("trusted", "lines").join(root, "key", "left").withColumn("root", F.coalesce("root", "key")))
    settled = _settled(rooted, rewritten, rows, keyed, nicknames, words, short)
    classes = materialise(rooted.select("key", "root").join(settled, "root", "left").select("key", F.coalesce("settled", "root").alias("class")))
    held = keyed.select(F.col("name").alias("k_name"), F.col("entity_type").alias("k_type"), "key").join(classes, "key")
    return rows.join(held, (rows["name"] == held["k_name"]) & rows["entity_type"].eqNullSafe(held["k_type"])).select("id", "name", "class").distinct()


def _settled(rooted: DataFrame, rewritten: DataFrame, rows: DataFrame, keyed: DataFrame, nicknames: dict[str, str], words: list[str], short: list[str]) -> DataFrame:
    """`root, settled`: the one person that each class of names with an initial for the given name means.

    A full name offers each of its two words with the initial of the other, as it stands and as its errors are put
    right; an exact word goes before one put right. Where several people fit, a hint decides that names one of them.
    """
    people = rooted.where("kind = 'P'").select("key", "root", "parts", "initials")
    full = people.where("size(parts) = 2")
    offered = lambda word, other: F.concat(word, F.lit("#"), F.substring(other, 1, 1), F.lit("#"), F.col("initials"))
    each = full.select("root", F.explode(F.array(*(F.struct(offered(F.col("parts")[i], F.col("parts")[1 - i]).alias("form")) for i in (0, 1)))).alias("o")).select("root", "o.form")
    right = full.join(rewritten.where("at is not null").select("key", "at", "word"), "key")
    # where one word is put right, it is offered itself, and its initial beside the other word
    right = right.select("root", F.explode(F.array(offered(F.col("word"), F.element_at("parts", 2 - F.col("at"))), offered(F.element_at("parts", 2 - F.col("at")), F.col("word")))).alias("form"))
    offers = each.withColumn("own", F.lit(True)).unionByName(right.withColumn("own", F.lit(False))).groupBy("root", "form").agg(F.max("own").alias("own"))
    open_ = people.where("size(parts) = 1 and initials <> ''")
    asked = lambda word: F.concat(word, F.lit("#"), F.substring("initials", 1, 1), F.lit("#"), F.substring("initials", 2, 1 << 20))
    exact = open_.select("root", asked(F.col("parts")[0]).alias("form"), F.lit(True).alias("exact"))
    near = open_.join(rewritten.where("at is not null").select("key", "word"), "key").select("root", asked(F.col("word")).alias("form"), F.lit(False).alias("exact"))
    met = exact.unionByName(near).distinct().join(offers.withColumnRenamed("root", "person"), "form")
    one = met.groupBy("root", "person").agg(F.max(F.col("exact") & F.col("own")).alias("exact")).groupBy("root").agg(F.collect_set(F.when(F.col("exact"), F.col("person"))).alias("exact"), F.collect_set("person").alias("all"))
    one = one.select("root", F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("all")).alias("fit"))  # people of one surname and initial
    one = materialise(one)
    many = one.where("size(fit) > 1")
    clear = one.where("size(fit) = 1").select("root", F.col("fit")[0].alias("settled"))
    if many.isEmpty():
        return clear
    asking = keyed.select("name", "entity_type", "key").join(rooted.select("key", "root"), "key").join(many.select("root"), "root")
    hints = rows.where(is_named("hint")).join(asking, ["name"]).where(rows["entity_type"].eqNullSafe(asking["entity_type"])).select("root", F.col("hint").alias("name"), asking["entity_type"]).groupBy("root", "name", "entity_type").agg(F.count("*").alias("n"))
    meant = parsed(hints, nicknames, words, short).select(F.col("root").alias("r"), "key", "n").join(rooted.select("key", F.col("root").alias("person")), "key").join(many, F.col("r") == many["root"]).where("array_contains(fit, person)")
    votes = meant.groupBy("r", "person").agg(F.sum("n").alias("n"))
    return clear.unionByName(votes.groupBy(F.col("r").alias("root")).agg(F.max_by("person", F.struct("n", "person")).alias("settled")))


def paired(held: DataFrame, key: str, block: int = _PAIR_BLOCK) -> DataFrame:
    """All `id_a < id_b` of the distinct rows `id, key[, name]` of each key; with a column `name` only of different names.

    A key of many rows is dealt into blocks, and each two blocks meet in a place of their own, so no task holds a whole key.
    """
    held = materialise(held)  # counted, and read from both sides
    counts = held.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    dealt = held.join(counts, key).withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id", *(["name"] if "name" in held.columns else [])), F.col("blocks"))).otherwise(F.lit(0)).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = dealt.select(key, F.col("own").alias("p"), F.explode(others).alias("q"), *(F.col(c).alias(f"{c}_a") for c in held.columns if c != key))
    b = dealt.select(key, F.explode(others).alias("p"), F.col("own").alias("q"), *(F.col(c).alias(f"{c}_b") for c in held.columns if c != key))
    met = a.join(b, [key, "p", "q"]).where("id_a < id_b")
    return (met.where("name_a <> name_b") if "name" in held.columns else met).select("id_a", "id_b").distinct()


def pairs(classes: DataFrame) -> DataFrame:
    """`id_a, id_b` (id_a < id_b) of each pair of different ids of one class: what TESTDATA.md asks for."""
    return paired(classes.select("id", "class").distinct(), "class")


def names_of(master_row: DataFrame, assignment: DataFrame) -> DataFrame:
    """`id, name, entity_type, trusted, hint` of both tables; their ids never coincide."""
    curated = master_row.select(F.col("row_ord").alias("id"), "name", "entity_type", F.lit(True).alias("trusted"), F.lit(None).cast("string").alias("hint"))
    return curated.unionByName(assignment.select(F.col("assign_id").alias("id"), F.col("original_name").alias("name"), "entity_type", F.lit(False).alias("trusted"), F.col("suggested_name").alias("hint")))
