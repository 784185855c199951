import zlib

import numpy as np

from binframe.llm import langid as g


def test_grams_stay_in_their_text():
    texts = ["abc", "", None, "é x", "abc"]
    bucket, at = g.grams(texts)
    for k, t in enumerate(texts):
        alone, _ = g.grams([t])
        assert bucket[at[k] : at[k + 1]].tolist() == alone.tolist()


def test_only_letters_are_letters():
    m = g.Model.fit([("en", *g.features("the tree and the house")), ("de", *g.features("der baum und das haus"))] * 5)
    texts = [None, "", "12 %", "\u00bd \u00b2 \u2163", "the tree", "\u00e9"]
    assert [x == "und" for x in m.predict(texts)[0]] == [True, True, True, True, False, False]


def test_machine_separates():
    r = np.random.default_rng(1)
    rows, sign = [], []
    for k in range(200):
        s = 1 if k % 3 else -1
        at = np.unique(r.integers(0, 500, 30)) + (0 if s > 0 else 300)
        rows.append((at, np.full(len(at), 1 / np.sqrt(len(at)), np.float32)))
        sign.append(s)
    w = g.svm(rows, np.array(sign, float))
    assert np.mean([np.sign(w[a] @ x) == s for (a, x), s in zip(rows, sign, strict=True)]) > 0.97


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = g.op4_langid(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.9


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    data = [(k, ("the house and the tree " if k % 2 else "la casa y el arbol ") * 5, "en" if k % 2 else "es", "x") for k in range(40)]
    df = spark.createDataFrame([*data, (100, None, "en", "x"), (101, "", "en", "x"), (102, "12 3!", None, "x"), (None, "the tree", "xx", "x"), (103, "the tree and", None, None)], schema)
    model = g.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in g.predict(df, model).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == got[None][0] == "en" and got[2][0] == "es"
    assert {r.lang_pred for r in g.predict(df, g.train(df.limit(0))).collect()} == {"und"}
    assert g.predict(df.limit(0), model).count() == 0


def test_long_text():
    m = g.Model.fit([("en", *g.features("the house and the tree")), ("de", *g.features("das haus und der baum")), ("fr", *g.features("la maison et l'arbre"))] * 3)
    assert m.predict(["the tree and the house " * 20_000])[0] == ["en"]
