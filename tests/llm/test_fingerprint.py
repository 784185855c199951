import hashlib
import math
import struct

import xxhash
from pyspark.sql import functions as F

from binframe.llm import fingerprint as fp


def check(rows, docs):
    order = sorted(docs, reverse=True)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        text = docs[r.doc_id] or ""
        nxt = docs[order[(order.index(r.doc_id) + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def digest(text):
    """Count, lanes that decide equality and bits that are counted, piece by piece."""
    lanes, bits = [0] * fp.EQUAL, [0] * fp.LIKE
    parts = fp.split_pieces(text or "")
    for piece in parts:
        h = [xxhash.xxh64_intdigest(piece.encode(), xxhash.xxh64_intdigest(struct.pack("<i", k), 42)) for k in range(fp.SEEDS + fp.WORDS // 32)]
        for k in range(fp.SEEDS):
            lanes[2 * k] = (lanes[2 * k] + h[k]) % (1 << 32)
            lanes[2 * k + 1] = (lanes[2 * k + 1] + (h[k] >> 32)) % (1 << 32)
        for k in range(fp.LIKE):
            bits[k] += h[fp.SEEDS + k // 64] >> k % 64 & 1
    return len(parts), lanes, bits


def written(d):
    return "".join([f"{d[0]:08X}", *(f"{x:08X}" for x in d[1]), *(f"{d[2][k] | d[2][k + 1] << 31:016X}" for k in range(0, fp.LIKE, 2))])


def alike(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * v - d[0] for v in d[2]] for d in (a, b))
    norm = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
    return max(0.0, min(1.0, sum(v * w for v, w in zip(x, y, strict=True)) / norm)) if norm else 0.0


def test_lanes_and_likeness_equal_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    order = sorted(docs, reverse=True)
    for r in fp.op2_fingerprint(spark, small).collect():
        text, nxt = docs[r.doc_id] or "", docs[order[(order.index(r.doc_id) + 1) % len(order)]] or ""
        half = len(text) // 2
        own, edit, other = digest(text), digest(text[: len(text) - half] + nxt[:half]), digest(nxt)
        assert (r.fingerprint, r.edited_fingerprint) == (written(own), written(edit))
        assert abs(r.near_edited - alike(own, edit)) < 1e-9 and abs(r.near_next - alike(own, other)) < 1e-9


def test_query(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = fp.op2_fingerprint(spark, small).collect()
    check(rows, docs)
    by_text = {}
    for r in rows:
        by_text.setdefault(docs[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert len({f for x in by_text.values() for f in x}) == len({frozenset(__import__("collections").Counter(fp.split_pieces(t)).items()) for t in by_text})
    assert sum(r.near_edited for r in rows) > sum(r.near_next for r in rows) + 0.2 * len(rows)


def test_small_and_odd(spark):
    for data in ([], [(5, None)], [(3, "é"), (1, None), (2, "")], [(k * k * k, f"text {k}. é {k * 7}\n" * (k % 5)) for k in range(1000)]):
        df = spark.createDataFrame(data, "doc_id long, text string")
        check(fp.edited(fp.with_next(df, "doc_id", "text")).collect(), dict(data))
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "x" * 50_000)], "doc_id long, text string")
    assert fp.edited(fp.with_next(df, "doc_id", "text")).count() == 4


def test_sum_is_order_free_and_incremental(spark):
    df = spark.createDataFrame([("a b\nc d. e f", "e f\nc d.\na b", "c d.")], "x string, y string, z string")
    vec = lambda c: fp.vector(fp.pieces(F.col(c)))
    r = df.select(vec("x").alias("x"), vec("y").alias("y"), fp.remove(fp.insert(vec("x"), fp.pieces(F.col("z"))), fp.pieces(F.col("z"))).alias("back"), fp.remove(vec("x"), fp.pieces(F.col("x"))).alias("none")).first()
    assert r.x == r.y == r.back and not any(r.none)


def test_likeness_follows_the_overlap(spark):
    words = [f"sentence {k} ends." for k in range(200)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:100] + [w.upper() for w in words[:100]]), " ".join(w.upper() for w in words))], "a string, b string, c string")
    vec = lambda c: fp.vector(fp.pieces(F.col(c)))
    r = df.select(fp.likeness(vec("a"), vec("b")).alias("half"), fp.likeness(vec("a"), vec("c")).alias("none"), fp.likeness(vec("a"), vec("a")).alias("same")).first()
    assert abs(r.half - 0.5) < 0.25 and r.none < 0.3 and r.same == 1.0


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", "old")], "text string, fingerprint string")
    assert fp.fingerprint(df).first().fingerprint != "old"


def test_lanes_of_long_texts_do_not_wrap(spark):
    n = 75_000
    own, other = [[f"{c}{k}" for k in range(n)] for c in "ab"]
    texts = {"own": own, "edit": own[: n - n // 10] + other[: n // 10], "other": other, "same": ["x"] * n, "more": ["x"] * n + own[: n // 10], "far": ["y"] * n}
    df = spark.createDataFrame([tuple("\n".join(x) for x in texts.values())], ", ".join(f"{k} string" for k in texts))
    vecs = df.select(*[fp.vector(fp.pieces(F.col(k))).alias(k) for k in texts]).persist()
    r = vecs.first()
    for k in texts:  # a lane counts pieces
        lanes = [w >> s & (1 << 31) - 1 for w in r[k][1 + fp.EQUAL :] for s in (0, 31)]
        assert len(lanes) == 128 and r[k][0] == len(texts[k]) and max(lanes) <= r[k][0]
        assert set(lanes) == {0, n} if k in ("same", "far") else k == "more" or all(abs(2 * x - n) < 0.05 * n for x in lanes)
    near = vecs.select(*[fp.likeness(F.col(a), F.col(b)).alias(a + b) for a, b in (("own", "edit"), ("own", "other"), ("same", "more"), ("same", "far"))]).first()
    assert near.ownedit > 0.7 and near.ownother < 0.4 and near.samemore > 0.9 and near.samefar < 0.4
