import hashlib
import random
import re

import pytest

from binframe.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, w=10):
    out = []
    windows = {}
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - w + 1) if ws else 0):
            windows.setdefault(tuple(ws[k : k + w]), set()).add(str(i))
    sizes = {len(x) for x in windows}
    for i, t in docs:
        ws, hit, who = words(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    who |= windows[tuple(ws[k : k + n])]
        out.append((i, len(ws), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return out


def random_case(seed):
    r = random.Random(seed)
    text = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(["A", "b", "é", "b9"]) for _ in range(n))
    docs = [(k, r.choice([None, "", text(r.randrange(60))])) for k in range(12)]
    items = [(k, r.choice([None, "...", text(r.randrange(1, 14))])) for k in range(8)]
    return docs, items


def digest(rows):
    return [(i, n, sum(e - s for s, e in hits), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(hits)) for i, n, hits, items in rows]


@pytest.mark.parametrize("seed", range(30))
def test_shards_equal_brute_force(seed):
    docs, items = random_case(seed)
    shard = d.load(d.dump(d.build_shard([t for _, t in docs])))
    found = d._by_document(shard, d.Queries([(str(i), t) for i, t in items]))
    assert digest([(i, n, *f) for (i, _), n, f in zip(docs, shard.n_words.tolist(), found, strict=True)]) == brute(docs, items)


def test_proximity():
    shard = d.build_shard(["x a q b c y", "c b a", "a x x x x x b c", "a b", "c"])
    window, begin, end = d.search_shard(shard, d.Queries([("1", "a b c")]), slop=1)
    assert [(int(b), int(e)) for b, e in zip(begin, end, strict=True)] == [(1, 5), (7, 10)]


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = d.op10_decontaminate(spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(brute(docs, items))


def test_items_without_an_id_count(spark):
    text = " ".join(f"w{k}" for k in range(14))
    df = spark.createDataFrame([(1, f"a {text} b"), (2, "w1 w2"), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (None, text), (7, "w1 w2"), (7, "w1 w2"), (8, None)], "item_id long, text string")
    for frame in (d.search(d.build_index(df), bench), d.contamination(df, bench)):
        got = {r.doc_id: ([tuple(h) for h in r.hits], list(r["items"])) for r in frame.collect()}
        assert got == {1: ([(1, 15)], ["", "7"]), 2: ([(0, 2)], ["7"]), None: ([(0, 14)], ["", "7"])}


def test_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = random_case(99)
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items))
    for words_ in (1_000_000, 5):
        monkeypatch.setattr(d, "BLOCK_WORDS", words_)
        for frame in (d.search(d.build_index(df), bench), d.contamination(df, bench)):
            got = [(r.doc_id, r.n_words, [tuple(h) for h in r.hits], list(r["items"])) for r in frame.collect()]
            assert sorted(digest(got)) == want
    assert d.search(d.build_index(df.limit(0)), bench).count() == 0
    assert not any(r.hits for r in d.contamination(df, bench.limit(0)).collect())
