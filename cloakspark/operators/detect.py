"""Detectors: functions from texts (`text_id, text`) to detections (`schemas.DETECTION`)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD, col, page_offsets, recase_uppercase, regex_spans, to_raw_span
from ..schemas import DETECTION
from ..session import materialise
from ..settings import DEFAULTS

Detector = Callable[[DataFrame], DataFrame]
#: A dictionary of at most this many keys is sent to every task as an automaton; a larger one is joined.
MAX_AUTOMATON_KEYS = 500_000
#: Where the list is all that is asked for, keys that take at most so many bytes with their hashes are sent to every task whole.
MAX_PACKED_BYTES = 64 << 20
COLUMNS = [f.name for f in DETECTION]

# The patterns are this project's own: an address with a plain local part and a domain of two labels or more, and a web
# address with a scheme or a leading www.
EMAIL = r"(?<![\p{L}\p{N}_.+-])(?=[A-Za-z0-9_])[A-Za-z0-9._%+-]{1,64}+(?<![.-])@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\p{L}\p{N}_])"
URL = r"(?i)(?<![\p{L}\p{N}_@.])(?:https?://|www\.)[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{2,5})?(?:[/?#](?:[.,:;!?'@*$]?[A-Za-z0-9_~%&=+/#-])*)?"


def _shaped(df: DataFrame, entity_type: Column | str, score: Column | float, source: str, seq: Column | int = 0) -> DataFrame:
    typed = entity_type if isinstance(entity_type, Column) else F.lit(entity_type)
    scored = score if isinstance(score, Column) else F.lit(float(score))
    number = seq if isinstance(seq, Column) else F.lit(seq)
    return df.select("text_id", number.cast("int").alias("seq"), typed.alias("entity_type"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), scored.alias("score"), F.col("hit").alias("text"), F.lit(source).alias("source"))


def _marked(pattern: str, seq: int, entity_type: str, score: float, source: str) -> Column:
    """The spans of a pattern in `text` as detections."""
    return F.transform(
        regex_spans("text", pattern),
        lambda m: F.struct(F.lit(seq).alias("seq"), F.lit(entity_type).alias("entity_type"), m["start"].alias("start"), m["end"].alias("end"), F.lit(float(score)).alias("score"), m["text"].alias("text"), F.lit(source).alias("source")),
    )


def with_text(texts: DataFrame) -> DataFrame:
    """Without null and blank texts."""
    return texts.where("text is not null and text rlike '(?U)\\\\S'")


def by_pattern(texts: DataFrame, entity_type: str, pattern: str, score: float = DEFAULTS.pattern_score, source: str = "pattern match") -> DataFrame:
    """Matches of one pattern. Texts without it are gone after one search, before any offsets are made."""
    hits = with_text(texts).where(F.col("text").rlike(pattern)).select("text_id", F.explode(regex_spans("text", pattern)).alias("m"))
    return _shaped(hits.select("text_id", "m.start", "m.end", F.col("m.text").alias("hit")), entity_type, score, source)


def _pattern_parts(entities: Iterable[str], score: float, source: str) -> list[tuple[Column, Column]]:
    """(sign, spans) of each kind asked for; the sign is a plain search for what a match must hold."""
    signs = {"EMAIL_ADDRESS": F.col("text").contains("@"), "URL": F.col("text").contains("://") | F.lower("text").contains("www.")}
    return [(signs[e], _marked(p, 0, e, score, source)) for e, p in (("EMAIL_ADDRESS", EMAIL), ("URL", URL)) if e in set(entities)]


def patterns(texts: DataFrame, entities: Iterable[str] = ("EMAIL_ADDRESS", "URL"), score: float = DEFAULTS.pattern_score, source: str = "pattern match") -> DataFrame:
    """Mail and web addresses; a type that isn't asked for is no part of the plan. The domain of an address is no web address."""
    return _scan(texts, _pattern_parts(entities, score, source))


def word_pattern(word: str) -> str | None:
    """A pattern for one typed word or phrase: any blanks between its parts, any case, no word character at its sides."""
    parts = word.split()
    return rf"(?iU)(?<!{WORD})" + r"\s+".join(re.escape(p).replace("/", r"\/") for p in parts) + rf"(?!{WORD})" if parts else None


def _low(c: Column) -> Column:
    """Lower case, with the letters that a pattern takes for others in any case made those."""
    return F.lower(F.translate(c, "ſıİ", "sii"))


def _word_parts(words: Iterable[str], score: float) -> list[tuple[Column, Column]]:
    """(sign, spans) of each word; the sign is a plain search for the phrase's parts in `low`."""
    kept = [(n, w, p) for n, w in enumerate(dict.fromkeys(w.strip() for w in words)) if (p := word_pattern(w))]
    return [(reduce(lambda a, b: a & b, (F.col("low").contains(_low(F.lit(x))) for x in w.split())), _marked(p, n, "CUSTOM", score, "custom word")) for n, w, p in kept]


def custom_words(texts: DataFrame, words: Iterable[str], score: float = DEFAULTS.custom_score) -> DataFrame:
    """Words and phrases typed for one run; a short list, so each is a column expression and nothing is joined."""
    return _scan(texts, _word_parts(words, score), True)


def patterns_and_words(texts: DataFrame, entities: Iterable[str], words: Iterable[str], pattern_score: float = DEFAULTS.pattern_score, word_score: float = DEFAULTS.custom_score, raw: str | None = None) -> DataFrame:
    """Both at once, in one pass over the texts; `source` tells them apart.

    With `raw`, a column with the page text that `text` is the running text of, detections have `raw_start` and `raw_end`, too.
    """
    typed = _word_parts(words, word_score)
    return _scan(texts, _pattern_parts(entities, pattern_score, "pattern match") + typed, bool(typed), raw)


def _scan(texts: DataFrame, parts: list[tuple[Column, Column]], in_lower_case: bool = False, raw: str | None = None) -> DataFrame:
    """One pass for all parts: texts without any sign go first, and a part's spans are made only in texts with its sign."""
    if not parts:  # nothing asked for: no rows, and no scan
        nothing = texts.where("false").select("text_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("hit"))
        empty = _shaped(nothing, "", 0.0, "")
        return empty.select("*", F.lit(0).alias("raw_start"), F.lit(0).alias("raw_end")) if raw else empty
    rows = with_text(texts).select("text_id", "text", *([F.col(raw).alias("raw")] if raw else []), *([F.explode(F.array(_low(F.col("text")))).alias("low")] if in_lower_case else []))
    none = F.expr("cast(array() as array<struct<seq:int,entity_type:string,start:int,end:int,score:double,text:string,source:string>>)")
    held = reduce(lambda a, b: a | b, (sign for sign, _ in parts))
    found = F.concat(*(F.when(sign, spans).otherwise(none) for sign, spans in parts))
    if raw is None:
        return rows.where(held).select("text_id", F.explode(found).alias("m")).select("text_id", "m.*")
    hit = rows.where(held).select("text_id", "raw", F.explode(F.array(found)).alias("all")).where(F.size("all") > 0)
    placed = hit.select("text_id", "all", page_offsets("raw").alias("o"))  # only of texts with a detection
    moved = F.transform("all", lambda m: F.struct(m.alias("m"), to_raw_span(F.col("o"), m["start"], m["end"]).alias("raw")))
    return placed.select("text_id", F.explode(moved).alias("x")).select("text_id", "x.m.*", F.col("x.raw.start").alias("raw_start"), F.col("x.raw.end").alias("raw_end"))


def lowered(x: Column | str) -> Column:
    """Lower case of the same length: the one letter whose lower case is two is made one."""
    return F.lower(F.replace(col(x), F.lit("İ"), F.lit("i")))


def _keys(names: DataFrame) -> DataFrame:
    return names.select("entity_type", lowered(F.trim("key")).alias("key")).where("key is not null and key <> ''").distinct()


def dictionary(texts: DataFrame, names: DataFrame, score: float = DEFAULTS.master_score, strategy: str = "auto", max_keys: int = MAX_AUTOMATON_KEYS) -> DataFrame:
    """Every occurrence of every key (`entity_type, key`) in every text, any case, no word character at its sides.

    Overlapping hits are all given. `automaton`: one narrow pass over the texts with all keys in one automaton per task;
    only for a dictionary within `max_keys`. `join`: one narrow pass with a filter of the keys of bounded size, then a join
    with the whole keys, for a dictionary of any size. `auto` counts the keys and decides.
    """
    keys = _keys(names) if strategy == "automaton" else materialise(_keys(names))  # read several times, and dear to make
    if strategy == "auto":
        strategy = "automaton" if keys.limit(max_keys + 1).count() <= max_keys else "join"
    hits = _by_automaton(texts, keys, max_keys) if strategy == "automaton" else _by_join(texts, keys)
    return _shaped(hits, F.col("entity_type"), score, "master list", _rank())


def settled_dictionary(texts: DataFrame, names: DataFrame, score: float = DEFAULTS.master_score, max_bytes: int = MAX_PACKED_BYTES) -> DataFrame | None:
    """What `resolve.engine` keeps of the hits of `dictionary`, if they are all there is: in each text the leftmost, of those the longest, of its types the first.

    One narrow pass that looks whole keys up, counted first. None for a dictionary over `max_bytes`, which is to be joined.
    """
    packed = _packed_of(materialise(_keys(names)), max_bytes)
    return None if packed is None else _shaped(_by_packed(texts, packed), F.col("entity_type"), score, "master list", _rank())


def _rank() -> Column:
    return F.when(F.col("entity_type") == "PERSON", 0).otherwise(1)


def _by_automaton(texts: DataFrame, keys: DataFrame, max_keys: int) -> DataFrame:
    spark = texts.sparkSession
    rows = keys.limit(max_keys + 1).collect()
    if len(rows) > max_keys:
        raise ValueError(f"the dictionary has more than {max_keys} keys; use the join")
    table: dict[str, list[str]] = {}
    for r in rows:
        table.setdefault(r["key"], []).append(r["entity_type"])
    held, name = spark.sparkContext.broadcast(table), uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(name, held)
        for b in batches:
            rows, types, starts, ends, found, around = [], [], [], [], [], []
            for i, (text, low) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())) if len(machine) else ():
                for last, (size, kinds) in machine.iter(low):
                    s, e = last + 1 - size, last + 1
                    beside = low[s - 1 : s] + low[e : e + 1] if s else low[e : e + 1]
                    if beside.isascii() and any(c.isalnum() or c == "_" for c in beside):
                        continue
                    for k in kinds:
                        rows.append(i)
                        types.append(k)
                        starts.append(s)
                        ends.append(e)
                        found.append(text[s:e])
                        around.append(beside)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(types, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string()), pa.array(around, pa.string())], ["text_id", "entity_type", "start", "end", "hit", "beside"])

    # lower case and word characters are the JVM's, as in the join, so that both strategies give the same rows
    rows = with_text(texts).select("text_id", "text", lowered("text").alias("low"))
    hits = rows.mapInArrow(scan, f"text_id {rows.schema['text_id'].dataType.simpleString()}, entity_type string, start int, end int, hit string, beside string")
    return hits.where(~F.col("beside").rlike(WORD)).drop("beside")


#: The automaton of the list that this worker saw last, by the list's name.
_MACHINES: dict = {}


def _machine(name: str, held: Broadcast):
    """The automaton of a list, built once for a worker and not for each of its tasks."""
    if name not in _MACHINES:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for k, types in held.value.items():
            machine.add_word(k, (len(k), types))
        if len(machine):
            machine.make_automaton()
        _MACHINES.clear()
        _MACHINES[name] = machine
    return _MACHINES[name]


#: Length of the prefixes that tell which lengths of keys may start at a place; shorter keys are looked up whole.
_PREFIX = 6
#: Code points of texts that are looked through at once.
_CHUNK = 1 << 20
_SEPARATOR = 0x110000
_WORDS: list[np.ndarray] = []
_POWERS: list[np.ndarray] = []
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def _word_table(spark: SparkSession) -> np.ndarray:
    """For each code point, as packed bits, whether the JVM takes it for a word character; asked for once."""
    if not _WORDS:
        points = [c for c in range(_SEPARATOR) if not 0xD800 <= c < 0xE000]
        blocks = [(n, "".join(map(chr, points[n : n + 8192]))) for n in range(0, len(points), 8192)]
        sign = F.regexp_replace(F.regexp_replace("s", "[^\\p{L}\\p{N}_]", "-"), WORD, "w")
        table = np.zeros(_SEPARATOR + 1, bool)
        for n, signs in spark.createDataFrame(blocks, "n int, s string").select("n", sign).collect():
            table[points[n : n + 8192]] = [x == "w" for x in signs]
        _WORDS.append(np.packbits(table))
    return _WORDS[0]


def _chunks(strings: list[str]) -> Iterator[tuple[int, int]]:
    """From where to where strings are looked through at once."""
    done, size = 0, 0
    for i, s in enumerate(strings):
        if i > done and size + len(s) >= _CHUNK:
            yield done, i
            done, size = i, 0
        size += len(s) + 1
    if strings:
        yield done, len(strings)


class _Codes:
    """Strings, each followed by a separator, as one array of code points, with hashes of any stretch of it."""

    def __init__(self, strings: list[str]):
        self.points = np.frombuffer("".join(s + "\0" for s in strings).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        self.ends = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)) + 1) - 1
        self.points[self.ends] = _SEPARATOR
        size = len(self.points)
        if not _POWERS or len(_POWERS[0]) < size:
            with np.errstate(over="ignore"):
                _POWERS[:] = [np.cumprod(np.full(max(size, _CHUNK), x, np.uint64)) for x in (0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64))]
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum((self.points.astype(np.uint64) + _ODD[2]) * _POWERS[0][:size], out=self.sums[1:])

    def within(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which string, place in it) of places in the array."""
        which = np.searchsorted(self.ends, start)
        return which, start - np.concatenate([[0], self.ends[:-1] + 1])[which]

    def hashes(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """64 bits that depend on the stretch's code points only, not on its place."""
        h = (self.sums[start + n] - self.sums[start]) * _POWERS[1][start]
        h = (h ^ (h >> np.uint64(32))) * _ODD[0]
        h = (h ^ (h >> np.uint64(29))) * _ODD[1]
        return h ^ (h >> np.uint64(32))


class _Filter:
    """What may be a key: two bits for each key, and by its prefix the lengths of the keys with it. All keys pass, and few other stretches do; of very many keys, more."""

    def __init__(self, bits: int, slots: int):
        self.bits, self.slots, self.lengths = np.zeros(1 << bits >> 3, np.uint8), np.zeros(1 << slots, np.uint64), set()
        self.b, self.s = np.uint64(64 - bits), np.uint64(64 - slots)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h >> self.b, (h * _ODD[2]) >> self.b

    def add(self, keys: list[str]) -> None:
        codes, n = _Codes(keys), np.fromiter(map(len, keys), np.int64, len(keys))
        start = codes.ends - n
        for at in self._places(codes.hashes(start, n)):
            np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        long = n >= _PREFIX
        np.bitwise_or.at(self.slots, codes.hashes(start[long], _PREFIX) >> self.s, np.uint64(1) << np.minimum(n[long], 63).astype(np.uint64))
        self.lengths |= set(n.tolist())

    def union(self, bits: bytes, slots: bytes, lengths: list[int]) -> None:
        self.bits |= np.frombuffer(bits, np.uint8)
        self.slots |= np.frombuffer(slots, np.uint64)
        self.lengths |= set(lengths)

    def _passed(self, codes: _Codes, start: np.ndarray, n: int, ends: np.ndarray) -> np.ndarray:
        start = start[start + n < len(ends)]
        start = start[ends[start + n]]
        one, two = self._places(codes.hashes(start, n))
        held = lambda at: (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return start[(held(one) & held(two)) == 1]

    def spans(self, strings: list[str], word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which string, start, length) of what may be a key, without word characters at its sides."""
        codes = _Codes(strings)
        start, n = self.places(codes, word)
        return *codes.within(start), n

    def places(self, codes: _Codes, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the same in the array of all strings."""
        inner = word[codes.points]
        ends = ~inner
        begin = ends & (codes.points != 0x20)
        begin[1:] = ~inner[:-1] & (codes.points[1:] != 0x20)
        begin[0] = codes.points[0] != 0x20
        start = np.flatnonzero(begin)
        found = [(n, self._passed(codes, start, n, ends)) for n in sorted(self.lengths) if n < _PREFIX]
        start = start[start + _PREFIX < len(ends)]
        masks = self.slots[codes.hashes(start, _PREFIX) >> self.s]
        start, masks = start[masks != 0], masks[masks != 0]
        for n in sorted(self.lengths) if len(start) else ():
            if n >= _PREFIX:
                found.append((n, self._passed(codes, start[(masks >> np.uint64(min(n, 63))) & np.uint64(1) == 1], n, ends)))
        start = np.concatenate([s for _, s in found]) if found else np.zeros(0, np.int64)
        n = np.concatenate([np.full(len(s), n) for n, s in found]) if found else start
        within = start + n <= codes.ends[np.searchsorted(codes.ends, start)]
        return start[within], n[within]


def _shape(size: int) -> tuple[int, int]:
    """Bits of the filter's tables by the number of keys: at most 16 MB and 8 MB."""
    return min(max((16 * size).bit_length(), 16), 27), min(max((4 * size).bit_length(), 12), 20)


def _filter_of(keys: DataFrame) -> _Filter:
    """The filter of all keys; parts of it are made where the keys are."""
    shape = _shape(keys.count())

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Filter(*shape)
        for b in batches:
            if b.num_rows:
                own.add(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([own.bits.tobytes()], pa.binary()), pa.array([own.slots.tobytes()], pa.binary()), pa.array([sorted(own.lengths)], pa.list_(pa.int32()))], ["bits", "slots", "lengths"])

    out = _Filter(*shape)
    for r in keys.select("key").coalesce(4).mapInArrow(part, "bits binary, slots binary, lengths array<int>").toLocalIterator():
        out.union(r["bits"], r["slots"], r["lengths"])
    return out


class _Packed:
    """All keys of a dictionary by length, each length sorted by hash: hashes, letters, and the types as bits; `sieve` turns most stretches away before."""

    def __init__(self, types: list[str], n_keys: int):
        self.types, self.sieve, self.by = types, _Filter(*_shape(n_keys)), {}

    def add(self, keys: list[str], kinds: np.ndarray) -> None:
        self.sieve.add(keys)
        codes, n = _Codes(keys), np.fromiter(map(len, keys), np.int64, len(keys))
        for k in np.unique(n).tolist():
            start = (codes.ends - n)[n == k]
            letters = codes.points[start[:, None] + np.arange(k)]
            self.by.setdefault(k, []).append((codes.hashes(start, k), letters.astype(np.uint8) if letters.max() < 256 else letters, kinds[n == k]))

    def sort(self) -> bool:
        """False if two different keys have one hash."""
        for k, parts in self.by.items():
            hashes, letters, kinds = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            hashes, letters, kinds = hashes[order], letters[order], kinds[order]
            again = hashes[1:] == hashes[:-1]
            if (letters[1:][again] != letters[:-1][again]).any():
                return False
            first = np.flatnonzero(np.concatenate([[True], ~again]))
            self.by[k] = hashes[first], letters[first], np.bitwise_or.reduceat(kinds, first)
        return True

    def kinds(self, codes: _Codes, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The types of each stretch as bits, 0 if it is no key."""
        out = np.zeros(len(start), np.uint64)
        for k in np.unique(n).tolist():
            hashes, letters, kinds = self.by[k]
            own = np.flatnonzero(n == k)
            for part in np.array_split(own, 1 + len(own) * k // _CHUNK):
                h = codes.hashes(start[part], k)
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                part, at = part[hashes[at] == h], at[hashes[at] == h]
                same = (letters[at] == codes.points[start[part][:, None] + np.arange(k)]).all(1)
                out[part[same]] = kinds[at[same]]
        return out


def _leftmost_longest(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the stretches that stand, in order: the leftmost, of those the longest, and on from its end."""
    order = np.lexsort((-n, start))
    begin, end = start[order], (start + n)[order]
    stands = np.ones(len(order), bool)
    stands[1:] = begin[1:] >= np.maximum.accumulate(end)[:-1]
    reach, clash = 0, np.flatnonzero(~stands)
    for i, before in zip(clash.tolist(), stands[clash - 1].tolist()):  # only those that touch one before them
        if before:
            reach = end[i - 1]
        if begin[i] >= reach:
            stands[i], reach = True, end[i]
    return order[stands]


def _packed_of(keys: DataFrame, max_bytes: int) -> _Packed | None:
    """The keys packed, if they are within the bound and no two of one length have one hash."""
    sizes = keys.groupBy(F.length("key").alias("n")).agg(F.count("*").alias("rows"), F.max(F.octet_length("key") > F.length("key")).alias("wide"), F.collect_set("entity_type").alias("types")).collect()
    types = sorted({t for r in sizes for t in r["types"]}, key=lambda t: (t != "PERSON", t))
    if sum(r["rows"] * (16 + r["n"] * (4 if r["wide"] else 1)) for r in sizes) > max_bytes or len(types) > 64:
        return None
    out = _Packed(types, sum(r["rows"] for r in sizes))
    bits = {t: np.uint64(1) << np.uint64(i) for i, t in enumerate(types)}
    for b in keys.select("key", "entity_type").toArrow().to_batches(1 << 16):
        if b.num_rows:
            out.add(b.column(0).to_pylist(), np.array([bits[t] for t in b.column(1).to_pylist()], np.uint64))
    return out if out.sort() else None


def _by_packed(texts: DataFrame, packed: _Packed) -> DataFrame:
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast((packed, _word_table(spark)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, word = held.value[0], np.unpackbits(held.value[1])[: _SEPARATOR + 1].astype(bool)
        types = pa.array(keys.types, pa.string())
        for b in batches:
            raw, low = (b.column(i).to_numpy(zero_copy_only=False).tolist() for i in (1, 2))
            for done, upto in _chunks(low) if len(types) else ():
                codes = _Codes(low[done:upto])
                start, n = keys.sieve.places(codes, word)
                kinds = keys.kinds(codes, start, n)
                start, n, kinds = start[kinds > 0], n[kinds > 0], kinds[kinds > 0]
                stands = _leftmost_longest(start, n)
                start, n, kinds = start[stands], n[stands], kinds[stands]
                kind = np.log2((kinds & (~kinds + np.uint64(1))).astype(float)).astype(np.int64)  # the lowest bit, a power of two
                which, at = codes.within(start)
                which, end = which + done, at + n
                hit = [raw[i][s:e] for i, s, e in zip(which.tolist(), at.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), types.take(pa.array(kind)), pa.array(at.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(hit, pa.string())], ["text_id", "entity_type", "start", "end", "hit"])

    rows = with_text(texts).select("text_id", "text", lowered("text").alias("low"))
    return rows.mapInArrow(scan, f"text_id {rows.schema['text_id'].dataType.simpleString()}, entity_type string, start int, end int, hit string")


def _by_join(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """What may be a key, found in one narrow pass over the texts, joined with the keys by the whole key.

    The pass holds a filter of bounded size in place of the keys; it lets no key slip, and the join drops what isn't one,
    so only stretches about as many as the hits are shuffled, never texts, and no two keys meet in the join.
    """
    spark = texts.sparkSession
    held = spark.sparkContext.broadcast((_filter_of(keys), _word_table(spark)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, word = held.value[0], np.unpackbits(held.value[1])[: _SEPARATOR + 1].astype(bool)
        for b in batches:
            raw, low = (b.column(i).to_numpy(zero_copy_only=False).tolist() for i in (1, 2))
            for done, upto in _chunks(low):
                which, start, n = (x.tolist() for x in sieve.spans(low[done:upto], word))
                rows = [done + w for w in which]
                end = [s + k for s, k in zip(start, n)]
                key, hit = ([x[i][s:e] for i, s, e in zip(rows, start, end)] for x in (low, raw))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(key, pa.string()), pa.array(hit, pa.string())], ["text_id", "start", "end", "key", "hit"])

    rows = with_text(texts).select("text_id", "text", lowered("text").alias("low"))
    found = rows.mapInArrow(scan, f"text_id {rows.schema['text_id'].dataType.simpleString()}, start int, end int, key string, hit string")
    return found.join(keys, "key").select("text_id", "entity_type", "start", "end", "hit")


def plugin(texts: DataFrame, analyze: Callable[[str], list[tuple[str, int, int, float]]], entities: Iterable[str] | None = None) -> DataFrame:
    """A model detector: `analyze(text)` gives (entity_type, start, end, score). Called on a text, and again on the text
    with its upper-case words recased if that differs; both passes' hits are given, the recased ones later in `seq`."""
    wanted = set(entities) if entities is not None else None

    @F.pandas_udf("array<struct<entity_type:string,start:int,end:int,score:double>>")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [dict(zip(("entity_type", "start", "end", "score"), d)) for d in analyze(t) if wanted is None or d[0] in wanted])

    base = with_text(texts).select("text_id", "text", recase_uppercase("text").alias("recased"))
    passes = base.select("text_id", "text", F.lit(1000).alias("from"), F.col("text").alias("given")).unionByName(base.where("recased <> text").select("text_id", "text", F.lit(2000).alias("from"), F.col("recased").alias("given")))
    hits = passes.select("text_id", "text", "from", F.posexplode(run("given")).alias("n", "d"))
    out = hits.select("text_id", (F.col("from") + F.col("n")).alias("number"), "d.*", F.substring("text", F.col("d.start") + 1, F.col("d.end") - F.col("d.start")).alias("hit"))
    return _shaped(out, F.col("entity_type"), F.col("score"), "model", F.col("number"))


def combine(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out


def only(detections: DataFrame, entities: Iterable[str]) -> DataFrame:
    return detections.where(F.col("entity_type").isin(*entities))
