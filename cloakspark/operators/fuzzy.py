"""Advisory hints: the curated name most like a name that isn't curated."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..settings import DEFAULTS

#: Curated names of one block that is sent to the tasks; more names are more blocks, one narrow pass each.
BLOCK = 200_000
#: Names asked for of which, counted, the forms are sent to the list in place of a shuffle of the list's.
FEW = 10_000
_BUCKETS = 48


def _profile(names: list[str]) -> np.ndarray:
    """How often each letter, by bucket, occurs in each name; shared counts are never below the shared letters."""
    out = np.zeros((len(names), _BUCKETS), np.int16)
    for k, n in enumerate(names):
        for c in n:
            out[k, ord(c) % _BUCKETS] += 1
    return out


def length_band(names: DataFrame, candidates: DataFrame, slack: int = DEFAULTS.length_slack) -> DataFrame:
    """`entity_type, norm_name, candidate`: all pairs of one type whose lengths differ by at most `slack`, as an equi-join on length."""
    asked = names.select("entity_type", "norm_name", F.explode(F.sequence(F.length("norm_name") - slack, F.length("norm_name") + slack)).alias("n"))
    return asked.join(candidates.select("entity_type", F.col("norm_name").alias("candidate"), F.length("norm_name").alias("n")), ["entity_type", "n"]).select("entity_type", "norm_name", "candidate")


def _forms(kind: str) -> Column:
    """Hashes of a name itself and of what is left of it without any one letter."""
    n = F.length("norm_name")
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(kind, F.concat(F.substring("norm_name", F.lit(1), i - 1), F.substring(F.col("norm_name"), i + 1, n))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(kind, "norm_name")), without))


def _reach(n: int, m: int) -> float:
    """The best ratio of names of these lengths that `_forms` doesn't bring together, as `SequenceMatcher` works it out: a letter more than it reaches is apart."""
    apart = {0: 4, 1: 3}.get(abs(n - m), abs(n - m))
    return 2.0 * ((n + m - apart) // 2) / (n + m)


def _met(names: DataFrame, listed: DataFrame, slack: int, few: bool = False) -> DataFrame:
    """`entity_type, norm_name, bound, cand_ord, candidate`: pairs that share a form, by the join of the forms' hashes; `bound` is the best ratio they can have, negative."""
    asked = names.select("entity_type", "norm_name", F.explode(_forms("entity_type")).alias("form"))
    other = listed.select("entity_type", F.col("norm_name").alias("candidate"), "cand_ord", F.explode(_forms("entity_type")).alias("form"))
    n, m = F.length("norm_name"), F.length("candidate")
    apart = F.when(F.col("norm_name") == F.col("candidate"), 0).when(n == m, 2).otherwise(F.abs(n - m))
    return (F.broadcast(asked) if few else asked).join(other, ["entity_type", "form"]).where(F.abs(n - m) <= slack).select("entity_type", "norm_name", (-(n + m - apart) / (n + m)).alias("bound"), "cand_ord", "candidate")


def _best_met(lists: DataFrame, threshold: float, slack: int, lengths: dict[str, list[int]]) -> DataFrame:
    """`entity_type, norm_name, candidate, score, rest, done` of names with their `bounds` and `candidates` in the order of the list.

    Candidates are taken by their bound, then in the order of the list, until no bound betters the ratio found; `done` is
    whether no other can do better by the highest bound. Of equal ratio the first in the list is given.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = SequenceMatcher(None, "", "")
        for b in batches:
            out, bounds, others = [], b.column(2), b.column(3)
            at = bounds.offsets.to_numpy().tolist(), others.offsets.to_numpy().tolist()
            flat, names_of = bounds.values.to_numpy(zero_copy_only=False), others.values
            for i, (kind, name) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                own = flat[at[0][i] : at[0][i + 1]]
                best, score, where, top = None, 0.0, 0, -own.min() if len(own) else 0.0
                for place in np.argsort(own, kind="stable").tolist():
                    if best is not None and (-own[place], -place) < (score, -where):  # so are all that follow
                        break
                    other = names_of[at[1][i] + place].as_py()
                    match.set_seqs(name, other)
                    ratio = match.ratio()
                    if ratio >= threshold and (best is None or (ratio, -place) > (score, -where)):
                        best, score, where = other, ratio, place
                least = max(score, threshold)
                rest = [k for k in lengths.get(kind, ()) if abs(k - len(name)) <= slack and _reach(len(name), k) >= least]
                out.append((kind, name, best, score if best is not None else None, rest, bool(not len(own) or top < threshold or best is not None and score >= top)))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int32()), pa.bool_()))], ["entity_type", "norm_name", "candidate", "score", "rest", "done"])

    return lists.select("entity_type", "norm_name", "bounds", "candidates").mapInArrow(run, "entity_type string, norm_name string, candidate string, score double, rest array<int>, done boolean")


def _near(names: DataFrame, listed: DataFrame, threshold: float, slack: int, lengths: dict[str, list[int]]) -> DataFrame:
    """`entity_type, norm_name, candidate, score, rest`: the best of the candidates that a letter left out of either makes equal, and the lengths where there may be others as good.

    For most names the first candidate of the highest bound reaches it, so no other can do better: only that one is
    looked at. All candidates are listed for the names where it doesn't, counted first.
    """
    key = ["entity_type", "norm_name"]
    top = _met(names, listed, slack).groupBy(*key).agg(F.min(F.struct("bound", "cand_ord", "candidate")).alias("top"))
    one = names.select(*key).join(top, key, "left").select(*key, *(F.array_compact(F.array(f"top.{c}")).alias(a) for c, a in (("bound", "bounds"), ("candidate", "candidates"))))
    tried = materialise(_best_met(one, threshold, slack, lengths))
    open_names, columns = tried.where("not done").select(*key), [*key, "candidate", "score", "rest"]
    n_open = open_names.count()
    if not n_open:
        return tried.select(*columns)
    lists = _met(open_names, listed, slack, few=n_open <= FEW).groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("cand_ord", "candidate", "bound"))).alias("met"))
    every = lists.select(*key, F.col("met.bound").alias("bounds"), F.col("met.candidate").alias("candidates"))
    return tried.where("done").select(*columns).unionByName(_best_met(every, threshold, slack, lengths).select(*columns))


def _far(near: DataFrame, listed: DataFrame, threshold: float, block: int) -> list[DataFrame]:
    """`entity_type, norm_name, candidate, score` of the best candidate of the lengths left (`rest`), if it is as good as what was found; a pass for each block of candidates."""
    asked = near.where(F.size("rest") > 0)
    wanted = asked.select("entity_type", F.explode("rest").alias("n")).distinct()
    ordered = listed.withColumn("n", F.length("norm_name")).join(F.broadcast(wanted), ["entity_type", "n"]).select("entity_type", "norm_name", "cand_ord").orderBy("cand_ord", "entity_type", "norm_name")  # types and lengths are few

    def pass_over(rows: list) -> DataFrame:
        held = near.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict[tuple[str, int], list] = defaultdict(list)
            for row in held.value:
                by[row[0], len(row[1])].append(row)
            table = {k: (v, _profile([r[1] for r in v])) for k, v in by.items()}
            for b in batches:
                out = []
                for kind, name, floor, rest in zip(*(c.to_pylist() for c in b.columns)):
                    least = max(threshold, floor or 0.0)
                    own, best, near = _profile([name])[0], None, []
                    match = SequenceMatcher(None, "", "")
                    for n in rest:
                        rows_n, profile = table.get((kind, n), ((), None))
                        if not rows_n or 2 * min(n, len(name)) < least * (n + len(name)) - 1e-9:
                            continue
                        shared = np.minimum(profile, own).sum(1)
                        bound = 2.0 * shared / (n + len(name))
                        near += [(-bound[k], rows_n[k][2], rows_n[k]) for k in np.flatnonzero(2 * shared >= least * (n + len(name)) - 1e-9)]
                    for bound, place, row in sorted(near):
                        if best and (-bound, -place) < (best[0], -best[1][2]):  # so are all that follow
                            break
                        match.set_seqs(name, row[1])
                        if match.quick_ratio() < (best[0] if best else least):
                            continue
                        score = match.ratio()
                        if score >= least and (best is None or (score, -place) > (best[0], -best[1][2])):
                            best = (score, row)
                    if best:
                        out.append((kind, name, best[1][1], best[0]))
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64()))], ["entity_type", "norm_name", "candidate", "score"])

        return asked.select("entity_type", "norm_name", F.col("score"), "rest").mapInArrow(run, "entity_type string, norm_name string, candidate string, score double")

    passes, held = [], []
    for place, row in enumerate(ordered.toLocalIterator()):
        held.append((row[0], row[1], place))
        if len(held) == block:
            passes.append(pass_over(held))
            held = []
    return passes + [pass_over(held)] if held else passes


def hints(names: DataFrame, candidates: DataFrame, threshold: float = DEFAULTS.fuzzy_threshold, slack: int = DEFAULTS.length_slack, block: int = BLOCK) -> DataFrame:
    """`entity_type, norm_name, suggested_pseudonym, suggested_name, suggested_score` of names that have a likeness of `threshold` or more.

    Likeness is the matching-block ratio of name against candidate, in this order of arguments. Of equal likeness the
    earlier candidate (`cand_ord`, of any type that has an order) is suggested. Candidates of another type, or of a length
    more than `slack` away, are out. Those a letter away are found by a join; only for names, and lengths of candidates,
    where one farther away may be as good as the best of them, all candidates of the length are bounded from above, by
    letters, before the ratio itself is made, highest bound first, until no bound can better the ratio found; this loses none.
    """
    listed = materialise(candidates.select("entity_type", "norm_name", "pseudonym", "display_name", "cand_ord").where("norm_name is not null"))
    lengths: dict[str, list[int]] = defaultdict(list)
    for kind, n in listed.select("entity_type", F.length("norm_name")).distinct().sort("entity_type", F.length("norm_name")).collect():
        lengths[kind].append(n)
    asked = names.select("entity_type", "norm_name").where("norm_name <> ''").distinct()
    near = materialise(_near(asked, listed, threshold, slack, dict(lengths)))
    found = near.where("candidate is not null").select("entity_type", "norm_name", "candidate", "score")
    found = reduce(DataFrame.union, [found, *_far(near, listed, threshold, block)])
    named = found.join(listed.withColumnRenamed("norm_name", "candidate"), ["entity_type", "candidate"])
    best = F.min_by(F.struct("pseudonym", "display_name", "score"), F.struct((-F.col("score")).alias("s"), "cand_ord"))
    return named.groupBy("entity_type", "norm_name").agg(best.alias("b")).select("entity_type", "norm_name", F.col("b.pseudonym").alias("suggested_pseudonym"), F.col("b.display_name").alias("suggested_name"), F.col("b.score").alias("suggested_score"))
