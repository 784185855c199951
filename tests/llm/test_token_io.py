import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from binframe.llm import token_io as t
from binframe.llm.bpe import default_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path(t.VOCABULARY))


@pytest.mark.parametrize("sizes,kinds", [([], 1), ([0], 1), ([1], 1), ([4096], 1), ([4097, 3], 5), ([20_000, 0, 1], 300), ([9000], 200_000)])
def test_round_trip(sizes, kinds):
    r = np.random.default_rng(7)
    ids = [(r.zipf(1.3, n) % kinds).astype(np.int32) if kinds > 1 else np.zeros(n, np.int32) for n in sizes]
    keys = [None, *range(len(sizes) - 1)] if sizes else []
    got, counts, flat = t.unpack(t.pack(keys, ids))
    assert got == keys and counts.tolist() == sizes
    assert flat.tolist() == (np.concatenate(ids).tolist() if sizes else [])


def test_predictable_ids_take_little_room():
    ids = np.tile(np.arange(50, dtype=np.int32), 2000)
    assert len(t.pack([1], [ids])) < len(ids) // 8


def test_damage_is_found():
    data = bytearray(t.pack([1, 2], [np.arange(3000, dtype=np.int32), np.arange(3000, dtype=np.int32)]))
    for at in (10, 60, len(data) - 40):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(t.CorruptSegment):
            t.unpack(bytes(bad))
    with pytest.raises(t.CorruptSegment):
        t.unpack(bytes(data[:-10]))


@pytest.mark.parametrize("n", [1, 4095, 4096, 20_000])
def test_blocks_alone(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 40_000).astype(np.int32)
    s = t.Segment(t.pack([5], [ids]))
    for k in range(len(s.lengths)):
        assert s.ids(k, k + 1).tolist() == ids[k * t.BLOCK : (k + 1) * t.BLOCK].tolist()


def test_damage_of_one_block_leaves_the_others():
    ids = (np.random.default_rng(3).zipf(1.2, 20_000) % 40_000).astype(np.int32)
    data = bytearray(t.pack([5], [ids]))
    s = t.Segment(bytes(data))
    first = len(data) - 2 * int(s.starts[-1])
    for at in range(first + 2 * int(s.starts[2]), first + 2 * int(s.starts[3]), 97):
        bad = bytearray(data)
        bad[at] ^= 0x10
        broken = t.Segment(bytes(bad))
        for k in range(len(s.lengths)):
            if k != 2:
                assert broken.ids(k, k + 1).tolist() == ids[k * t.BLOCK : (k + 1) * t.BLOCK].tolist()
        with pytest.raises(t.CorruptSegment):
            broken.ids(2, 3)


def test_shares():
    for n in (1, 2, 100, 60_000, 1 << 18):
        shares, bits = t._shares(np.sort(np.random.default_rng(n).zipf(1.3, n).clip(1, 10**6))[::-1])
        assert shares.sum() == 1 << bits and shares.min() >= 1


def test_long_text(spark, tmp_path, library):
    docs = {1: "the old tree, " * 60_000, 2: "x" * 300_000, 3: "a"}
    t.write(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), f"file://{tmp_path}/l", segment=50_000)
    check(t.read(spark, f"file://{tmp_path}/l").collect(), docs, library)


def test_encoder_equals_the_library(library):
    r = random.Random(11)
    parts = ["Aß", "b", " ", "  ", "\n", "\t", "'s", "É", "é", "12", ".", "!?", "<|endoftext|>", "　", "日本", "İ", "Σς", "the ", "Thé,", "x́", "\x1c", "ﬁ.", "'ll"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(500)]
    e = t.WordEncoder(default_path(t.VOCABULARY), cache_words=40)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, library):
    start = 0
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for k in sorted(docs):
        ids = library.encode(docs[k] or "", add_special_tokens=False).ids + [2]
        r = by[k]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_query(spark, small, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check(t.op7_token_io(spark, small).collect(), docs, library)


def test_odd_tables(spark, tmp_path, library):
    for k, data in enumerate(([], [(3, None), (1, ""), (2, "a b a b")])):
        t.write(spark.createDataFrame(data, "doc_id long, text string"), f"file://{tmp_path}/{k}")
        check(t.read(spark, f"file://{tmp_path}/{k}").collect(), dict(data), library)
    t.write(spark.createDataFrame([(None, "x"), (1, "y"), (1, "y")], "doc_id long, text string"), f"file://{tmp_path}/n", segment=2)
    rows = sorted(t.read(spark, f"file://{tmp_path}/n", ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1] and [r.start for r in rows] == [0, 2, 4] and rows[1].ids[-1] == 2


def test_words_of_letters_skip_the_normalizer(library):
    e = t.WordEncoder(default_path(t.VOCABULARY))
    whole, seen = e.library, []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            seen.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

    e.library = Counted()
    texts = ["The old tree, the OLD tree.\nÉté, été öde.", "a tree  isn't (old)"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert sorted(seen) == ["", "(old)", ",", ".", "isn't"]
    seen.clear()
    e.encode(texts)
    assert not seen


def test_steps_of_the_coder_take_few_new_arrays():
    import tracemalloc

    b = 1000
    m, rank = t._Model(b), np.arange(b, dtype=np.int32)
    m.predict()
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        m.predict()
        assert tracemalloc.get_traced_memory()[1] - before < 16 * b
    finally:
        tracemalloc.stop()
    m.update(rank, m.k)
    m.predict()
    assert (m.last == rank).all()


def test_flat_ids_and_forgetting(library):
    import pyarrow as pa

    r = random.Random(4)
    e = t.WordEncoder(default_path(t.VOCABULARY), cache_words=60)
    for n in range(8):
        texts = [r.choice([None, "", " ", "x" * 300, *(" ".join("".join(r.choice("abcdeéÀ.,'1") for _ in range(r.randrange(7))) for _ in range(20)) for _ in range(3))]) for _ in range(n)]
        flat, counts = e.flat(pa.array(texts, pa.string()), 2)
        want = [library.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]
        assert counts.tolist() == [len(x) for x in want] and flat.tolist() == sum(want, [])
        assert len(e.words) == len(set(e.words.to_pylist())) <= 60
    part = pa.array(["b", "a c", "d"], pa.string()).slice(1, 2)
    assert e.flat(part, 2)[1].tolist() == [3, 2] and e.flat(part)[1].tolist() == [2, 1]


def test_other_vocabularies_take_the_whole_library(tmp_path):
    import json

    with open(default_path(t.VOCABULARY), encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    (tmp_path / "v.json").write_text(json.dumps(spec))
    e, texts = t.WordEncoder(str(tmp_path / "v.json")), ["The OLD tree, Été.", "old"]
    assert not e.simple
    want = Tokenizer.from_file(str(tmp_path / "v.json")).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in want]


@pytest.mark.parametrize("n", [3 * 4096, 3 * 4096 + 1, 4 * 4096 - 1])
def test_last_block_alone_is_as_in_step(n):
    ids = np.r_[(np.random.default_rng(n).zipf(1.1, n - 900) % 200_000), np.tile(np.arange(9), 100)].astype(np.int32)
    s = t.Segment(t.pack([1], [ids]))
    assert s.ids().tolist() == ids.tolist()
    k = len(s.lengths) - 1
    assert s.ids(k).tolist() == ids[k * t.BLOCK :].tolist()
