import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from binframe.llm import bpe, token_count

PARTS = ["a", "b", " ", "  ", "\n", "\t", " \n", "'s", "'t", "é", "12", ".", "!?", "<|endoftext|>", "　", "日本", "aaaa", "the ", "x́", "\x1c"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def model():
    return bpe.encoder(bpe.default_path())


def odd_texts(n=500):
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(14))) for _ in range(n)]


def test_ids_and_text_equal_the_library(model, library):
    for s in odd_texts():
        want = library.encode(s, add_special_tokens=False).ids
        got = model.encode([s])[0]
        assert np.frombuffer(got, "<u4").tolist() == want, s
        assert model.decode(got) == library.decode(want, skip_special_tokens=False)


def test_long_word_by_heap(model, library):
    r = random.Random(3)
    for alphabet in ("abcdefgh", "a", "é "):
        s = "".join(r.choice(alphabet) for _ in range(5000))
        assert np.frombuffer(model.encode([s])[0], "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_small_cache_gives_the_same(library):
    tiny = bpe.ByteBPE(bpe.default_path(), cache_words=3)
    for s in odd_texts(80):
        assert np.frombuffer(tiny.encode([s, s + " end"])[0], "<u4").tolist() == library.encode(s, add_special_tokens=False).ids


def test_decode_of_cut_bytes(model, library):
    ids = library.encode("é日本").ids[:-1]
    assert model.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_frames(spark, library):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "a b\nc", 7), (3, "a b\nc", 7)], "doc_id long, text string, n_tokens int")
    rows = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert rows == {1: [], 2: [], 3: library.encode("a b\nc").ids}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {1: "", 2: "", 3: "a b\nc"}
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(df).collect()} == {1: 0, 2: 0, 3: len(rows[3])}
    assert bpe.round_trip(df.limit(0)).count() == 0 and token_count.count_tokens(df.limit(0)).count() == 0


def test_counts_equal_the_library(model, library):
    c = token_count.Counter(model, token_count.frequent_lengths(model), cache_words=60_000)
    texts = odd_texts()
    assert c.count(texts) == [len(library.encode(s, add_special_tokens=False).ids) for s in texts]


def test_queries(spark, small, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {k: library.encode(v, add_special_tokens=False).ids for k, v in docs.items()}
    rows = bpe.op3_bpe(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.n_tokens == len(ids[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(ids[r.doc_id], "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    for r in token_count.op5_token_count(spark, small).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 512)
