import __spark_entry__
import corpus_pipeline as c
import pytest

from tests.llm.test_decontaminate import brute as contaminated


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_keeps_clean_documents(spark, docs, small):
    kept, before = rows(c.language(spark, docs, small)), rows(docs)
    assert len(kept) > 0.95 * len(before) and all(kept[k].text == before[k].text for k in kept)
    assert c.language(spark, docs.limit(0), small).columns == docs.columns


def near_groups(docs, n=5, percent=80):
    """Smallest linked id of each (id, text), by comparing all pairs of n-word shingle sets."""
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if (w := t.lower().split()) else set() for _, t in docs]
    low = [i for i, _ in docs]
    links = [(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets[:a]) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    for _ in docs:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return dict(zip([i for i, _ in docs], low, strict=True))


def test_near_duplicates_by_five_words(spark, docs, small):
    all_docs = [(r.doc_id, r.text) for r in docs.collect()]
    assert set(rows(c.near_duplicates(spark, docs, small))) == set(near_groups(all_docs).values())
    texts = [[f"w{k}x{base}" for k in range(size)] for base, size in enumerate((50, 49, 48, 55, 300))]
    edited = []
    for words in texts:
        for spots in ((), (25,), (10,), (20, 40), (15, 30, 45)):
            edited.append((len(edited), " ".join("changed" if k in spots else w for k, w in enumerate(words))))
    low = near_groups(edited)
    assert low[1] == 0 and near_groups(edited, 3, 90)[1] == 1  # linked by five words alone
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in edited], "doc_id long, text string, lang string, source string, n_chars long")
    assert set(rows(c.near_duplicates(spark, df, small))) == set(low.values())


def test_another_text_under_a_removed_id_stays(spark, small):
    a, b = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    near = a.replace("a40", "changed")
    rows_ = [(1, a), (2, near), (2, b), (None, near), (None, "c d e f g h"), (7, ""), (7, ""), (1, a)]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in c.near_duplicates(spark, df, small).collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, "c d e f g h"), (7, "")], key=str)


def test_contaminated_documents_go(spark, docs, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = set(rows(c.benchmark(spark, docs, small)))
    assert got == {x[0] for x in contaminated([(r.doc_id, r.text) for r in docs.collect()], items) if not x[5]}


def test_masked_texts(spark, docs, small):
    out = c.personal_data(spark, docs, small)
    assert out.dtypes == docs.dtypes
    got, before = rows(out), rows(docs)
    assert set(got) == set(before) and all(r.n_chars == len(r.text) for r in got.values())
    assert any("[EMAIL]" in r.text for r in got.values())


def test_odd_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", None, None, None), (3, "the tree and the house", "en", "a", 1), (3, "the tree and the house", "en", "a", 1), (4, "der baum und das haus", "de", "a", 1), (5, "The tree and the house", None, "a", 1)], schema)
    for _, stage in c.STAGES[:-1]:
        df = stage(spark, df, small)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in c.tokens(spark, df, small).collect()) == [3, 4]


def test_run(spark, small):
    out = __spark_entry__.queries()["pipeline"](spark, small).collect()
    assert len(out) > 100 and all(r.n_tokens > 0 for r in out)
