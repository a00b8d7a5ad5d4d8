"""Tokens of a public byte-level BPE vocabulary for a whole corpus, by a table of its distinct words.

`encode_corpus` splits texts into the tokenizer's words, encodes each distinct word of the corpus once, and joins the
ids back by position. Texts travel in chunks of bounded size; each chunk ships only its distinct words to the word
table and gets a dictionary back, so the shuffle carries the texts once and a fraction of their words, not one row per
token. A word of very many chunks is answered from a counted table that is sent to the tasks, so its chunks never meet in
one. Partitions of chunks are counted by bytes, so what a task holds doesn't grow with the corpus. `decode_corpus` is the way back, a join of ids with the id-to-piece table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

#: Where the public vocabulary files lie, and which one is used; both are parameters.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: how byte-level BPE vocabularies of this family part a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_BYTES = 4 << 20
#: Texts that a task puts together from chunks, in bytes.
TASK_BYTES = 64 << 20
#: A word of more chunks than this is looked up where its chunk is, and not joined.
HOT_CHUNKS = 10_000
#: Words in the table sent to the tasks for that, the commonest first; about 10 MB. The rest is joined, hot or not.
HOT_WORDS = 100_000


def vocabulary_path(vocabulary: str = VOCABULARY, directory: str | None = None) -> str:
    return os.path.join(directory or TOKENIZER_DIR, f"{vocabulary}.tiktoken")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """Encodes without special tokens: text that looks like one is ordinary text."""
    return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=1)
def word_pattern() -> regex.Pattern:
    return regex.compile(WORD_PATTERN)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most CHUNK_BYTES of text, and one text at least, with the slice's first id as their `chunk`."""
    for b in batches:
        upto = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = upto[at - 1] if at else 0
            n = max(1, int(np.searchsorted(upto, done + CHUNK_BYTES, side="right")) - at)
            part = b.slice(at, n)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0)[0].as_py()] * n, pa.int64()), *part.columns], ["chunk", "id", "text"])
            at += n


def _chunk_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = word_pattern().findall
    for part in _chunked(batches):
        seen: set[str] = set()
        for t in part.column(2).to_pylist():
            seen.update(split(t))
        yield pa.RecordBatch.from_arrays([pa.array([part.column(0)[0].as_py()] * len(seen), pa.int64()), pa.array(list(seen), pa.string())], ["chunk", "word"])


def word_table(words: DataFrame, path: str) -> DataFrame:
    """`word, ids` of each row, one for each distinct word: the only place where the tokenizer runs."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode_ordinary(w) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return words.select("word").mapInArrow(encode, "word string, ids array<int>")


def _dictionary(words: DataFrame, path: str, hot_chunks: int) -> DataFrame:
    """`chunk, word, ids` of `chunk, word`, each distinct word encoded once."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    if words.select("chunk").distinct().count() <= hot_chunks:  # so no word can have more
        return words.join(word_table(counts, path), "word").select("chunk", "word", "ids")
    common = counts.where((F.col("n") > hot_chunks) & (F.length("word") <= 256)).orderBy(F.desc("n"), "word").limit(HOT_WORDS)  # the limit is the feature: what isn't sent is joined
    hot = materialise(word_table(common, path))
    rest = words.join(F.broadcast(hot.select("word")), "word", "left_anti")
    joined = rest.join(word_table(rest.select("word").distinct(), path), "word")
    return words.join(F.broadcast(hot), "word").select("chunk", "word", "ids").unionByName(joined.select("chunk", "word", "ids"))


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, hot_chunks: int = HOT_CHUNKS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """`doc_id, ids` of each row. Null and empty texts have the empty list; blank ones have tokens like any other.

    `doc_id` names a row and should be unique; rows that repeat an id come out as often as they came in. An empty
    table gives an empty table; texts are encoded whole, whatever their length; other columns are ignored.
    """
    path = path or vocabulary_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # both passes read the same rows in the same order; a word that a chunk's dictionary should lack is encoded on the spot
    texts = rows.mapInArrow(_chunked, "chunk long, id long, text string")
    words = materialise(rows.mapInArrow(_chunk_words, "chunk long, word string"))  # split once, read by the counts and by the join
    dictionary = _dictionary(words, path, hot_chunks)
    spark = docs.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))

    def assemble(texts: pa.Table, entries: pa.Table) -> pa.Table:
        split, lists = word_pattern().findall, entries["ids"].combine_chunks()
        flat, off = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        off = off - (off[0] if len(off) else 0)
        extra: list[list[int]] = []

        class Place(dict):
            def __missing__(self, w: str) -> int:
                extra.append(encoder(path).encode_ordinary(w))
                k = self[w] = len(lists) - 1 + len(extra)
                return k

        place = Place({w: k for k, w in enumerate(entries["word"].to_pylist())}).__getitem__
        at: list[int] = []
        ends = [0]
        for t in texts["text"].to_pylist():
            at.extend(map(place, split(t)))
            ends.append(len(at))
        if extra:
            flat = np.concatenate([flat, *(np.array(x, flat.dtype) for x in extra)])
            off = np.concatenate([off, off[-1] + np.cumsum([len(x) for x in extra])])
        pos = np.array(at, np.int64)
        n = (off[1:] - off[:-1])[pos] if len(pos) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        where = np.arange(total[-1]) - np.repeat(total[:-1] - off[:-1][pos], n) if len(pos) else np.zeros(0, np.int64)
        ids = pa.ListArray.from_arrays(pa.array(total[np.array(ends)], pa.int32()), pa.array(flat[where], pa.int32()))
        return pa.table([texts["id"], ids], names=["doc_id", "ids"])

    texts, dictionary = (df.repartition(parts, "chunk") for df in (texts, dictionary))
    return texts.groupBy("chunk").cogroup(dictionary.groupBy("chunk")).applyInArrow(assemble, "doc_id long, ids array<int>")


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """`token, piece` (bytes) of the vocabulary; its size is that of the vocabulary file, about 50,000 rows."""
    table = ranks(path or vocabulary_path())
    return spark.createDataFrame(pa.table({"token": pa.array(list(table.values()), pa.int32()), "piece": pa.array(list(table.keys()), pa.binary())}))


def decode_corpus(encoded: DataFrame, path: str | None = None, part: int = 4096) -> DataFrame:
    """`doc_id, text` of ids as `encode_corpus` gives them; unknown ids decode to nothing, null ids to the empty text.

    Ids are joined with the id-to-piece table in parts of at most `part` tokens, so the longest text is no single
    group of the aggregation that puts the pieces in order; the parts are put together in a second step.
    """
    table = F.broadcast(pieces(encoded.sparkSession, path))  # bounded by the vocabulary
    at = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "token"))
    one = at.join(table, "token", "left").withColumn("no", F.coalesce(F.floor(F.col("pos") / part), F.lit(0)))
    parts = one.groupBy("doc_id", "no").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    joined = parts.select("doc_id", "no", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, coalesce(x.piece, cast('' as binary))))").alias("bytes"))
    whole = joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("no", "bytes"))).alias("p"))
    return whole.select("doc_id", F.expr("cast(aggregate(p, cast('' as binary), (a, x) -> concat(a, x.bytes)) as string)").alias("text"))
