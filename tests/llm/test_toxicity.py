import zlib

import numpy as np
import pytest

from binframe.llm import toxicity as t

SCHEMA = "doc_id long, text string"


def sample(n=400, seed=2):
    r = np.random.default_rng(seed)
    rows, y = [], []
    for k in range(n):
        words = [f"w{x}" for x in r.integers(0, 300, r.integers(1, 60))]
        if k % 4 == 0:
            words.insert(int(r.integers(0, len(words) + 1)), str(r.choice(["scum", "moron"])))
        rows.append(" ".join(words))
        y.append(int(k % 4 == 0))
    return rows, np.array(y)


@pytest.fixture(scope="module")
def model():
    rows, y = sample()
    return t.fit([t.word_ids(x) for x in rows], y)


def test_learns_from_words(model):
    rows, y = sample(200, seed=9)
    s = model.scores([t.word_ids(x) for x in rows])
    assert ((s >= 0.5) == y).mean() > 0.95


def test_one_bad_word_in_a_long_text_counts(model):
    rows, _ = sample(400, seed=4)
    clean = " ".join(r for r in rows if "scum" not in r and "moron" not in r)
    a, b, c = model.scores([t.word_ids(clean[: len(clean) // 2] + " scum " + clean[len(clean) // 2 :]), t.word_ids(clean), t.word_ids("")])
    assert a >= 0.5 > max(b, c)


def test_tables_equal_plain_convolution(model):
    ids = [model.pick(t.word_ids(x)) for x in ("scum a", "w1 w2 w3 w4", "", "w7")]
    flat, at = t._lay_out(ids)
    got = model._pool(flat, at)
    for k, row in enumerate(ids):
        x = model.embed[np.r_[row, [0, 0, 0, 0]]]
        want = np.concatenate([np.maximum.reduce([sum(x[p + j] @ f[j] for j in range(len(f))) for p in range(len(row) + 1)]) for f in model.filters])
        np.testing.assert_allclose(got[k], np.maximum(want + model.bias, 0), atol=1e-4)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = t.op6_toxicity(spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = np.array([r.score for r in held if labels[r.doc_id]])
    other = np.array([r.score for r in held if not labels[r.doc_id]])
    assert (good[:, None] > other[None]).mean() > 0.6


def test_odd_tables(spark, model):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "scum"), (3, "scum"), (3, "scum")], SCHEMA)
    rows = t.score(docs, model).collect()
    assert len(rows) == 5 and rows[0].score == rows[1].score < 0.5 and rows[3].predicted == 1
    none = t.train(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert {r.score for r in t.score(docs, none).collect()} == {0.0}
    assert t.score(docs.limit(0), model).count() == 0
