"""Benchmark decontamination by a distributed positional inverted index.

The index is dealt by documents: a shard holds some documents' terms, sorted, and for each term the positions at which it
stands, documents lying one after another with a gap between. Shards are rows of a table in a shared folder, so an index is
built once and searched often, and no posting is shuffled.

A search takes the windows of the benchmark's items in blocks of bounded size. In each shard a window's candidates are the
postings of its rarest term there, moved by the term's offset; the lists of the other terms, rarest first, are intersected
with them. What is left are exact phrases; with ``slop``, windows whose terms stand within so many more words in any order.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case. Null or empty text has no words
and no hits, an item without words has no window, an empty benchmark hits nothing. Rows with equal ids stay apart.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe.llm._util import map_text, slices, spill, table

WINDOW = 10
#: Words of the benchmark to a broadcast block: about 100 MB in a worker at most.
BLOCK_WORDS = 1_000_000
#: Bytes of text to a shard that lives in a worker only.
SHARD_BYTES = 1 << 20
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


class Shard(NamedTuple):
    """terms[k] stands at positions[starts[k]:starts[k + 1]]; document d at [first[d], first[d] + n_words[d])."""

    terms: list[bytes]
    starts: np.ndarray
    positions: np.ndarray
    first: np.ndarray
    n_words: np.ndarray


def build_shard(texts: list[str | None]) -> Shard:
    lists = [words(t) for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    first = np.r_[0, np.cumsum(n + 1)[:-1]].astype(np.int64) if len(n) else np.zeros(0, np.int64)
    seen: dict[bytes, int] = {}
    put = seen.setdefault
    flat = np.fromiter((put(w, len(seen)) for x in lists for w in x), np.int32, int(n.sum()))
    terms = sorted(seen)
    rank = np.empty(len(terms), np.int32)
    rank[[seen[t] for t in terms]] = np.arange(len(terms), dtype=np.int32)
    flat = rank[flat] if len(terms) else flat
    at = np.arange(len(flat), dtype=np.int64) + np.repeat(np.arange(len(n)), n)
    order = np.argsort(flat, kind="stable")
    starts = np.r_[0, np.cumsum(np.bincount(flat, minlength=len(terms)))].astype(np.int64)
    return Shard(terms, starts, at[order], first, n)


def dump(shard: Shard) -> bytes:
    terms = b" ".join(shard.terms)
    return b"".join([struct.pack("<4I", len(shard.terms), len(terms), len(shard.positions), len(shard.n_words)), terms, np.diff(shard.starts).astype("<u4").tobytes(), shard.positions.astype("<u4").tobytes(), shard.n_words.astype("<u4").tobytes()])


def load(raw: bytes) -> Shard:
    k, size, p, d = struct.unpack_from("<4I", raw)
    terms = raw[16 : 16 + size].split()
    lengths = np.frombuffer(raw, "<u4", k, 16 + size).astype(np.int64)
    positions = np.frombuffer(raw, "<u4", p, 16 + size + 4 * k).astype(np.int64)
    n = np.frombuffer(raw, "<u4", d, 16 + size + 4 * (k + p)).astype(np.int64)
    return Shard(terms, np.r_[0, np.cumsum(lengths)], positions, np.r_[0, np.cumsum(n + 1)[:-1]] if d else np.zeros(0, np.int64), n)


class Queries:
    """Windows of some items: ``grid`` holds their term numbers (-1 beyond a short window), ``items`` who has each."""

    def __init__(self, rows: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        owners: dict[tuple[bytes, ...], dict[str, None]] = {}
        for item, text in rows:
            ws = words(text)
            for k in range(max(1, len(ws) - window + 1) if ws else 0):
                owners.setdefault(tuple(ws[k : k + window]), {})[item] = None
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in owners for w in x}))}
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.grid = np.full((len(owners), window), -1, np.int64)
        for k, x in enumerate(owners):
            self.grid[k, : len(x)] = [self.vocabulary[w] for w in x]
        self.items = [list(x) for x in owners.values()]


def search_shard(shard: Shard, queries: Queries, slop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window number, first position and end (exclusive) of every match."""
    none = (np.zeros(0, np.int64),) * 3
    local = np.full(len(queries.vocabulary) + 1, -1, np.int64)
    get = queries.vocabulary.get
    for k, t in enumerate(shard.terms):
        if (q := get(t)) is not None:
            local[q] = k
    if not len(queries.grid):
        return none
    size = np.diff(shard.starts)
    used = queries.grid >= 0
    term = local[queries.grid]
    keep = np.flatnonzero(((term >= 0) | ~used).all(axis=1))
    if not len(keep):
        return none
    term, used = term[keep], used[keep]
    frequency = np.where(used, size[term], np.iinfo(np.int64).max)
    by_rarity = np.argsort(frequency, axis=1, kind="stable")
    rarest = by_rarity[:, 0]
    lead = term[np.arange(len(keep)), rarest]
    many = size[lead]
    # Postings of the rarest term of each window, moved to where the window would begin.
    window = np.repeat(np.arange(len(keep)), many)
    inside = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
    hits = shard.positions[shard.starts[lead][window] + inside]
    length = queries.lengths[keep]
    if slop is not None:
        return _near(shard, keep, term, used, window, hits, length, slop)
    begin = hits - rarest[window]
    # The other lists, from the rarest on, moved likewise and intersected with what is left. All lists of a shard stand one
    # after another in order of (term, position), so that one binary search looks all candidates up.
    end = int(shard.first[-1] + shard.n_words[-1] + 1) if len(shard.first) else 1
    lists = np.repeat(np.arange(len(shard.terms), dtype=np.int64) * end, size) + shard.positions
    ok = (begin >= 0) & (begin + length[window] <= end)
    window, begin = window[ok], begin[ok]
    for k in range(1, term.shape[1]):
        j = by_rarity[window, k]
        there = used[window, j]
        want = term[window, j] * end + begin + j
        at = np.minimum(np.searchsorted(lists, want), len(lists) - 1)
        ok = (lists[at] == want) | ~there
        window, begin = window[ok], begin[ok]
    return keep[window], begin, begin + length[window]


def _near(shard: Shard, keep, term, used, window, hits, length, slop):
    """Windows all of whose terms stand in length + slop words around a posting of the rarest."""
    out = []
    doc = np.searchsorted(shard.first, hits, "right") - 1
    lo, hi = shard.first[doc], shard.first[doc] + shard.n_words[doc]
    for w, p, a, b in zip(window.tolist(), hits.tolist(), lo.tolist(), hi.tolist(), strict=True):
        span = int(length[w]) + slop
        lists = [shard.positions[shard.starts[t] : shard.starts[t + 1]] for t in set(term[w][used[w]].tolist())]
        for s in range(max(a, p - span + 1), p + 1):
            nxt = [int(x[k]) if (k := int(np.searchsorted(x, s))) < len(x) else 1 << 60 for x in lists]
            if min(nxt) == s and max(nxt) < min(s + span, b):
                out.append((keep[w], s, max(nxt) + 1))
                break
    found = np.array(sorted(set(out)), np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _by_document(shard: Shard, queries: Queries, slop: int | None = None) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Merged hit ranges (in words of the document) and sorted items of each document."""
    window, begin, end = search_shard(shard, queries, slop)
    out: list = [((), ())] * len(shard.n_words)
    if not len(window):
        return out
    doc = np.searchsorted(shard.first, begin, "right") - 1
    order = np.lexsort((begin, doc))
    window, begin, end, doc = window[order], begin[order], end[order], doc[order]
    edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1], True])
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        d = int(doc[s])
        first = int(shard.first[d])
        spans: list[tuple[int, int]] = []
        for x, y in zip((begin[s:e] - first).tolist(), (end[s:e] - first).tolist(), strict=True):
            if spans and x <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(y, spans[-1][1]))
            else:
                spans.append((x, y))
        out[d] = (spans, sorted({i for w in set(window[s:e].tolist()) for i in queries.items[w]}))
    return out


def blocks(items: DataFrame, id_col: str, text: str, window: int) -> list[Queries]:
    """The benchmark in blocks of about BLOCK_WORDS words; one for a usual benchmark. A null id counts as an empty one."""
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // (4 * BLOCK_WORDS)))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return [Queries([(r.i, r.t) for r in rows.where(part == k).collect()], window) for k in range(n)]


INDEX = "doc_ids array<long>, shard binary"


def build_index(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index of all texts in the shared folder; returns its table of shards."""
    frame = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                shard = build_shard(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([dump(shard)], pa.binary())], ["doc_ids", "shard"])

    return spill(frame.mapInArrow(run, INDEX), "postings")


RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hits", RANGES), T.StructField("items", T.ArrayType(T.StringType()))]
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _columns(shard: Shard, queries: Queries, slop: int | None) -> list[pa.Array]:
    found = _by_document(shard, queries, slop)
    return [pa.array(shard.n_words), pa.array([[{"start": s, "end": e} for s, e in x] for x, _ in found], _HITS), pa.array([list(x) for _, x in found], pa.list_(pa.string()))]


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text: str = "text", *, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """doc_id, n_words, hits and items of every indexed document: the word ranges that windows of items cover."""
    schema = T.StructType([T.StructField("shard_no", T.StringType()), T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), *FOUND])

    def one(queries: Queries) -> DataFrame:
        held = index.sparkSession.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    name = hashlib.md5(raw + repr(ids).encode()).hexdigest()
                    cols = [pa.array([name] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64()), *_columns(load(raw), held.value, slop)]
                    yield pa.RecordBatch.from_arrays(cols, schema.names)

        return index.mapInArrow(run, schema)

    many = blocks(items, id_col, text, window)
    found = one(many[0])
    if len(many) > 1:  # a benchmark beyond one broadcast: what each block hit, put together for each row
        for q in many[1:]:
            found = found.unionByName(one(q))
        found = found.groupBy("shard_no", "row", "doc_id").agg(F.max("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.drop("shard_no", "row")


def _merged(ranges):
    """Overlapping or touching ranges as one; ranges of a document are few, one list for each block."""
    start = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    empty = F.array().cast(RANGES)
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, x: F.when((F.size(a) > 0) & (x["start"] <= F.get(a, F.size(a) - 1)["end"]), F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(start(x))))
    return F.aggregate(F.array_sort(ranges), empty, joined)


def contamination(df: DataFrame, items: DataFrame, text: str = "text", *, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Append n_words, hits and items to rows without a stored index: shards live in the workers. Such columns are replaced."""
    out = df
    for k, queries in enumerate(blocks(items, item_id, item_text, window)):
        held = df.sparkSession.sparkContext.broadcast(queries)

        def make(held=held):
            return lambda texts: _columns(build_shard(texts.to_pylist()), held.value, None)

        if k == 0:
            out = map_text(out, make, FOUND, text, keep, limit=SHARD_BYTES)
        else:
            more = [T.StructField("n_words", T.LongType()), T.StructField("__hits", RANGES), T.StructField("__items", FOUND[2].dataType)]
            out = map_text(out, make, more, text, limit=SHARD_BYTES).withColumn("hits", _merged(F.concat("hits", "__hits"))).withColumn("items", F.array_sort(F.array_union("items", "__items"))).drop("__hits", "__items")
    return out


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of benchmark items cover, and the items."""
    found = search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), ks AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE len(ws) >= k)
), hit AS (SELECT doc_id, i, bw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""
