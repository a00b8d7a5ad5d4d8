import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakspark.llm import splitter as S
from cloakspark.llm import tokenizer as K

ENC = K.encoder(K.vocabulary_path())
ODD = ["", None, "   ", "hello", "<|endoftext|> x", "á ﬁ 字字 😀\r\n\n x's 12 ", "\x00￾", "a" * 3000, "字" * 2000, " " * 500 + "x", "don't DON'T it's"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_ids_are_those_of_the_tokenizer(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab '\n.字é😀1-") for _ in range(rng.randrange(200))) for _ in range(300)]
    got = {r.doc_id: r.ids for r in K.encode_corpus(docs(spark, texts)).collect()}
    assert got == {i: ENC.encode_ordinary(t or "") for i, t in enumerate(texts)}


def test_json_vocabulary_agrees(spark):
    import os

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(K.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = [r.ids for r in K.encode_corpus(docs(spark, ODD)).orderBy("doc_id").collect()]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in ODD]


def test_hot_words_and_many_partitions(spark):
    df = docs(spark, [*ODD, *(f"the same words {i}" for i in range(50))]).repartition(6)
    got = {r.doc_id: r.ids for r in K.encode_corpus(df, hot_chunks=1, task_bytes=50).collect()}
    assert got == {r.doc_id: ENC.encode_ordinary(r.text or "") for r in df.collect()}


def test_round_trip(spark):
    back = {r.doc_id: r.text for r in K.decode_corpus(K.encode_corpus(docs(spark, ODD)), part=100).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_empty_table_and_repeated_rows(spark):
    assert K.encode_corpus(docs(spark, [])).count() == 0
    df = docs(spark, ["a b", "c"])
    assert sorted(r.doc_id for r in K.encode_corpus(df.union(df)).collect()) == [0, 0, 1, 1]


def check(text, limit, overlap):
    pieces = S.pieces_of(text, limit, overlap, S.Counts(K.vocabulary_path()))
    at = 0
    for k, (start, end, n, shared, _) in enumerate(pieces):
        assert len(ENC.encode_ordinary(text[start:end])) == n <= limit
        assert start <= at < end and (k == 0 or shared >= min(overlap, 1)) and (k > 0 or start == 0)
        at = end
    assert at == len(text)
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab '\n.字é😀!1s-", max_size=400), st.integers(12, 60))
def test_nothing_is_lost_and_nothing_is_too_large(text, limit):
    check(text, limit, limit // 4)


@pytest.mark.parametrize("text", ["a" * 5000, "字" * 3000, "😀" * 2000, " " * 5000, "\n" * 4000, "'s" * 3000, "x \n" * 2000])
def test_texts_without_boundaries(text):
    assert len(check(text, 512, 64)) > 1


def test_cuts_at_the_strongest_boundary():
    text = ("One two three four five. " * 12).strip() + "\n\n" + ("Six seven eight nine ten. " * 12).strip()
    pieces = check(text, 100, 10)
    assert S.KINDS[pieces[1][4]] in ("paragraph", "sentence") and text.index("\n\n") in {p[1] for p in pieces}


def test_split_table(spark):
    long = " ".join(f"Word{i} is here." for i in range(900))
    df = docs(spark, [long, "short", "", None, "  "])
    rows = S.split_oversized(df).orderBy("doc_id", "piece_no").collect()
    assert {r.doc_id for r in rows} == {0, 1, 4} and all(r.n_tokens <= 512 for r in rows)
    first = [r for r in rows if r.doc_id == 0]
    assert all(r.n_shared == 64 and r.boundary == "sentence" for r in first[1:]) and long.startswith(first[0].piece)
    for a, b in zip(first, first[1:]):
        shared = long[b.char_start : a.char_end]
        assert ENC.encode_ordinary(a.piece)[-64:] == ENC.encode_ordinary(shared) == ENC.encode_ordinary(b.piece)[:64]
    assert S.split_oversized(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        S.split_oversized(df, 10, 10)
