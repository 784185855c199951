import random
import re

import numpy as np
import pytest

from binframe.llm import jaccard_join as j


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        low[r] = min(low.get(r, i), i)
    return sorted((i, len(sets[k]), low[find(k)]) for k, (i, _) in enumerate(docs))


def corpus(seed, groups=6, size=12):
    r = random.Random(seed)
    out = [None, "", "a", "A", "a b", "\x0b a\x1cb c"]
    for _ in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([5, 12, 20, 60, 150]))]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"x{r.randrange(50)}"
            if r.random() < 0.2:
                words = words[: -r.randrange(1, 4)]
            out.append(" ".join(words))
    r.shuffle(out)
    return [(k * 3, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", range(20))
def test_linked_sets_share_a_list(seed):
    sets = [j.shingles(t) for _, t in corpus(seed, 8, 10)]
    keys = [set(j.signatures(u).tolist()) for u in sets]
    for a in range(len(sets)):
        for b in range(a):
            c, t = j.linked(sets[a], sets[b])
            if t and 100 * c >= 90 * t and not np.array_equal(sets[a], sets[b]):
                assert keys[a] & keys[b]


def fold(p, words):
    return [int(np.bitwise_xor.reduce(np.array(p[k::words], np.int64))) for k in range(words)]


def test_parity_bounds_the_difference():
    sets = [j.shingles(t) for _, t in corpus(3, 4, 8)] + [j.shingles(" ".join(f"v{k}" for k in range(n))) for n in (300, 1000, 1100, 5000)]
    for a in sets:
        for b in sets:
            p, q = j.parity(a), j.parity(b)
            words = min(len(p), len(q))
            bits = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(fold(p, words), fold(q, words), strict=True))
            c, t = j.linked(a, b)
            assert bits <= t - c


def test_parities_are_folded_alike(spark):
    p, q = j.parity(j.shingles(" ".join(f"v{k}" for k in range(6000)))), j.parity(j.shingles(" ".join(f"v{k}" for k in range(250))))
    df = spark.createDataFrame([(6000, p, 250, q)], "n long, p array<long>, m long, q array<long>")
    assert list(df.selectExpr(j.folded("p", "4")).first()[0]) == fold(p, 4)
    assert [df.select(j.may_link(*x, 80)).first()[0] for x in (("n", "p", "n", "p"), ("n", "p", "m", "q"))] == [True, False]
    sets = [j.shingles(t) for _, t in corpus(5, 3, 6) if t]
    pairs = [(len(x), j.parity(x), len(y), j.parity(y)) for x in sets for y in sets]
    short = spark.createDataFrame([r for r in pairs if len(r[1]) == len(r[3]) == 4], "n long, p array<long>, m long, q array<long>")
    assert short.where(j.may_link("n", "p", "m", "q", 80) != j.may_link_short("n", "p", "m", "q", 80)).count() == 0 < short.where(j.may_link_short("n", "p", "m", "q", 80)).count()


def test_sizes_have_their_classes():
    for percent in (80, 90):
        for s in range(1, 3000, 7):
            mine = {c for c, _, _ in j.classes(s, percent)}
            for t in {s, s + 1, s * 100 // percent}:
                if s * 100 >= t * percent:
                    own = min(c for c, _, _ in j.classes(t, percent))
                    need = {c: n for c, n, _ in j.classes(t, percent)}[own]
                    assert own in mine and need > (s + t) * (100 - percent) // (100 + percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_with_empty_blocks_meet(percent):
    """Linked sets of every small size share a list, whatever blocks are empty."""
    r = np.random.default_rng(percent)
    for size in list(range(2, 60)) * 40:
        x = r.integers(0, 1 << 63, size, dtype=np.uint64)
        y = x.copy()
        y[: r.integers(0, max(1, size * (100 - percent) // (100 + percent)) + 1)] = r.integers(0, 1 << 63)
        x, y = np.unique(x), np.unique(y)
        c, t = j.linked(x, y)
        if 100 * c >= percent * t and not np.array_equal(x, y):
            assert set(j.signatures(x, percent).tolist()) & set(j.signatures(y, percent).tolist())


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("size", [50, 500, 5000, 20000])
def test_unlinked_sets_share_no_list(n, percent, size):
    r = np.random.default_rng(size)
    seen = [k for _ in range(30) for k in set(j.signatures(np.unique(r.integers(0, 1 << 63, size + r.integers(0, size // 10), dtype=np.uint64)), percent).tolist())]
    assert len(seen) == len(set(seen))


@pytest.mark.parametrize("share", [0.0, 0.1, 0.9, 1.0])
def test_linked_sets_share_a_list_whatever_is_common(share):
    sets = [j.shingles(t, 5) for _, t in corpus(11, 8, 10)]
    every = np.unique(np.concatenate(sets))
    common = every[np.random.default_rng(2).random(len(every)) < share]
    keys = [set(j.signatures(u, 80, common).tolist()) for u in sets]
    for a in range(len(sets)):
        for b in range(a):
            c, t = j.linked(sets[a], sets[b])
            if t and 100 * c >= 80 * t and not np.array_equal(sets[a], sets[b]):
                assert keys[a] & keys[b]


def test_a_common_passage_makes_no_list(spark):
    """Unrelated texts with one passage: its shingles are found, and no list is made of the blocks that hold nothing else."""
    r = random.Random(5)
    texts = [" ".join([f"p{k}" for k in range(20)] + [f"v{r.randrange(10**9)}" for _ in range(80)]) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    common = j.common_shingles(df, "doc_id", "text", 5)
    assert set(common.tolist()) == set(j.shingles(" ".join(f"p{k}" for k in range(20)), 5).tolist())

    def meetings(*more):
        keys = [k for t in texts for k in set(j.signatures(j.shingles(t, 5), 80, *more).tolist())]
        return len(keys) - len(set(keys))

    assert meetings() > 200 and meetings(common) == 0


def test_few_pairs_of_a_large_group_are_compared(spark, monkeypatch):
    """Near copies of one text, a third of them too far from all others: most pairs are ruled out before they are compared."""
    r = random.Random(6)
    base = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(150):
        spots = set(r.sample(range(300), k % 24))
        docs.append((k, " ".join(f"e{k}x{at}" if at in spots else w for at, w in enumerate(base))))
    compared, real = [], j._compare

    def count(pairs, held, percent):
        compared.append(pairs.count())
        return real(pairs, held, percent)

    monkeypatch.setattr(j, "_compare", count)
    got = sorted(map(tuple, j.join(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(docs) and len({c for _, _, c in got}) > 40
    assert sum(compared) < 1000, compared


def test_null_ids_keep_their_links(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [(5, 60), (None, 58), (9, 56), (12, 54), (None, 20), (30, 3), (None, 0)]
    df = spark.createDataFrame([(i, " ".join(words[:k])) for i, k in texts], "doc_id long, text string")
    got = {r.n_shingles: (r.doc_id, r.component_id) for r in j.join(df).collect()}
    assert got == {58: (5, 5), 56: (None, 5), 54: (9, 5), 52: (12, 5), 18: (None, None), 1: (30, 30), 0: (None, None)}


def test_long_texts(spark):
    docs = []
    for base, size in enumerate((5000, 9000, 20000)):
        words = [f"{base}w{k}" for k in range(size)]
        for copy in range(5):
            for _ in range(copy * size // 150):
                words[(copy * 7919 + _ * 104729) % size] = f"{base}x{copy}y{_}"
            docs.append((len(docs), " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, j.join(df).select("doc_id", "n_shingles", "component_id").collect())) == brute(docs)


@pytest.mark.parametrize("most", [1, 50])
def test_all_links(spark, most, monkeypatch):
    monkeypatch.setattr(j, "MORE", 1 + most)
    monkeypatch.setattr(j, "LOOKS", 100)
    docs = corpus(7)
    docs += [(1000 + k, t) for k, (_, t) in enumerate(docs[:15])]
    sets = {i: shingles(t) for i, t in docs}
    expected = {i: sum(1 for k, y in sets.items() if k != i and x and y and 100 * len(x & y) >= 90 * len(x | y)) for i, x in sets.items()}
    pairs, members = j.links(spark.createDataFrame(docs, "doc_id long, text string"))
    found = members.collect()
    assert {r.doc_id: r.n_links for r in found} == expected
    texts = {r["class"]: frozenset(sets[r.doc_id]) for r in found}
    want = {frozenset((x, y)) for x in set(texts.values()) for y in set(texts.values()) if x and y and x != y and 100 * len(x & y) >= 90 * len(x | y)}
    got = [frozenset((texts[r.a], texts[r.b])) for r in pairs.collect()]
    assert set(got) == want and len(got) == len(want)


def test_components_that_go_on_changing_raise(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long")
    assert {r.component for r in j.components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        j.components(edges, most=2)


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, component_id int")
    assert sorted(map(tuple, j.join(df).select("doc_id", "n_shingles", "component_id").collect())) == brute(docs)


def test_chain_of_near_copies(spark):
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(40):
        docs.append((100 - k, " ".join(base)))
        base[(k * 7) % 120] = f"y{k}"
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, j.join(df).select("doc_id", "n_shingles", "component_id").collect())) == brute(docs)


def test_empty(spark):
    assert j.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, j.op8_jaccard_join(spark, small).collect())) == brute(docs)


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("seed", range(6))
def test_linked_sets_differ_alike_from_a_reference(seed, percent):
    """Whatever the reference, linked sets are both near, or their prefixes meet."""
    r = random.Random(seed)
    sets = [u for u in (j.shingles(t) for _, t in corpus(seed, 5, 14)) if len(u)]
    some = r.sample(sets, 5) if seed % 2 else sorted(sets, key=len)[-9:]
    base, known, often = j.reference(some)
    rarity = dict(zip(known.tolist(), often.tolist(), strict=True))
    rest = [sorted(np.setxor1d(u, base).tolist(), key=lambda e: (rarity.get(e, 0), e)) for u in sets]
    over = [j.excess(len(d), len(u), percent) for d, u in zip(rest, sets, strict=True)]
    cut = [j.prefixes(len(d), o, min(over), percent) for d, o in zip(rest, over, strict=True)]
    nearest = sets[over.index(min(over))]
    for (far, _, _), u in zip(cut, sets, strict=True):
        c, t = j.linked(u, nearest)
        assert far or 100 * c >= percent * t
    for a in range(len(sets)):
        for b in range(len(sets)):
            c, t = j.linked(sets[a], sets[b])
            if 100 * c >= percent * t and not np.array_equal(sets[a], sets[b]) and cut[b][0]:
                long = cut[b][1] if cut[a][0] else cut[b][2]
                assert set(rest[a][: cut[a][1]]) & set(rest[b][:long])


def test_far_copies_of_one_text(spark, monkeypatch):
    """Pairs of long texts, all of them too far from the text that they come from, in groups that have references."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(1500)]
    docs = [(0, " ".join(base))]
    for k in range(50):
        spots = set(r.sample(range(1500), 150))
        for _ in range(2):
            docs.append((len(docs), " ".join(f"e{k}x{at}" if at in spots else w for at, w in enumerate(base))))
            spots = set(sorted(spots)[:-3])
    monkeypatch.setattr(j, "COMMON", 10**9)
    monkeypatch.setattr(j, "MORE", 8)
    got = sorted(map(tuple, j.join(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute(docs) and len({c for _, _, c in got}) == 51
