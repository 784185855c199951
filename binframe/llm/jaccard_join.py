"""N-gram Jaccard join with set relations: lists skipped by position blocks, answers taken over from similar sets.

Every text becomes a set of hashed word n-grams in one global order. Equal sets are one node from the start: a copy takes
over its original's answers whole.

Index: sets whose sizes can match differ in at most H shingles, so when the hash range is cut by position into more than H
blocks, two linked sets have a block in common. Lists are kept for (size class, block, content of the block); a probe skips
every list but those, hence all entries that share just some frequent shingle. Empty blocks get no list, as unrelated sets
would meet there: a set with more than H blocks that aren't empty shares one of those with each of its partners. One that
has fewer is cut anew in another order of the hashes, where it meets the partners that had fewer too. Shingles that a sample
shows to be common are left out of the first cuts, so that a block which holds nothing else makes no list of unrelated sets;
whatever is left out, linked sets differ in no more of the rest. Classes, H and blocks follow from sizes alone, and nothing
is capped.

Answers: lists with one pivot are a group, in which all sets that sizes and parities don't rule out are compared with it.
Jaccard distance is a metric, so the pivot's answers tell much of the others': sets whose distances to it add up to no more
than the limit are linked, and those whose distances differ by more are not. ``join`` needs components only: groups that lie
within one component are done, in open ones of up to 64 sets pairs of different components are compared, and a larger one gets
a reference, the shingles that most of a sample of its sets hold. Sets near enough to it are linked with the nearest; a set that
is far can be linked only with sets that differ from the reference in the same shingles, and those that differ alike are found
by lists of their differences, rare ones first. ``links`` gives every linked pair of different sets: it takes more pivots in
each round, 64 times as many until every set has been one, and leaves out sets that differ too much in what they hold of the
pivot and in shingles that no other set of an open group has. Two sets are compared only if their parities differ in no more
bits than linked sets may differ in shingles.

Two texts link when 100 * |intersection| >= 90 * |union| (``percent``). Sets hold 64-bit hashes of n-grams and are known by
64-bit hashes of their own. Null or empty texts have no shingles and are linked with nothing, rows with equal ids are
separate texts with one id; rows with a null id take part like others, and their component is null only where no row with
an id is reachable. Texts are fetched by a hash of id and text, so that neither null nor repeated ids lose a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe.llm._util import drop, keeps, map_text, spill, table

N, PERCENT = 3, 90
#: Cuts of a set, one after another until it has blocks enough: whether common shingles take part, and how many times the
#: blocks of its class. In the last one its empty blocks get lists as well.
CUTS = ((False, 1), (False, 4), (True, 1), (True, 4))
#: A shingle is common if so many of the different sets in a sample hold it. One set in SAMPLE is in the sample.
COMMON, SAMPLE = 6, 16
#: Common shingles at most that are told to the workers, the most frequent ones (8 bytes each).
MOST_COMMON = 1 << 20
#: Blocks are so many that a set has too few that aren't empty only if it lies so many standard deviations below the mean.
DEVIATIONS = 2.5
#: Parities of a set: so many at least and at most, four times as many until there is one for each shingle.
SHARES = (256, 16384)
#: Size classes grow by this ratio.
RATIO = 1.5
#: More pivots in each round.
MORE = 64
#: Comparisons of one pivot that go to one task.
PAIRS = 1000
#: Sets of a large group that its reference is made of.
SAMPLED = 64
#: Pairs of a list that one task looks at.
LOOKS = 200_000
NO_SHINGLES = np.zeros(0, np.uint64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Words()
keeps(__name__, _HASHES.clear)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words; of fewer words, of the whole."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _M1 + h[k : len(h) - size + 1 + k])
    return np.unique(out)


@lru_cache(4096)
def _edges(blocks: int) -> np.ndarray:
    return np.array([(k << 64) // blocks for k in range(1, blocks)], np.uint64)


@lru_cache(4096)
def blocks_of(low: int, need: int) -> int:
    """Blocks for a class of sets of ``low`` shingles at least, so that ``need`` of them are hardly ever lacking."""

    def enough(b: int) -> bool:
        hit = 1 - 1 / b
        mean = b * hit**low
        spread = max(0.0, mean + b * (b - 1) * max(0.0, 1 - 2 / b) ** low - mean * mean) ** 0.5
        return b - mean - DEVIATIONS * spread >= need

    below, b = need, need + 1
    while not enough(b) and b < 4 * low + 8:
        below, b = b, b + max(1, b // 4)
    while b - below > 1:
        mid = (below + b) // 2
        below, b = (below, mid) if enough(mid) else (mid, b)
    return b


def classes(size: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """Size classes (number, H + 1, blocks) in which a set takes part: its own, and above it where partners can be."""
    out, low, number = [], 1, 0
    while low * percent <= size * 100:
        high = max(low, int(low * RATIO))
        if size <= high:
            # |x ^ y| <= (|x| + |y|) (100 - p) / (100 + p), both sizes at most ``high``
            need = 2 * high * (100 - percent) // (100 + percent) + 1
            out.append((number, need, blocks_of(low, need)))
        low, number = high + 1, number + 1
    return out


@lru_cache(100_000)
def _classes(size: int, percent: int) -> list[tuple[int, int, int]]:
    return classes(size, percent)


def without(u: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Shingles of a set that aren't among the sorted common ones."""
    if not len(common):
        return u
    at = np.searchsorted(common, u)
    at[at == len(common)] = 0
    return u[common[at] != u]


def signatures(u: np.ndarray, percent: int = PERCENT, common: np.ndarray = NO_SHINGLES) -> np.ndarray:
    """List keys of a set.

    Of two linked sets at most H blocks differ, whichever shingles are left out of both. If one of them has more than H blocks
    that aren't empty, one of these is the other's as well; if neither has, both go on to the next cut.
    """
    keys: list[np.ndarray] = []
    orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for number, need, blocks in _classes(len(u), percent):
        if need == 1:
            continue  # only equal sets can match
        for order, (whole, times) in enumerate(CUTS):
            if order not in orders:
                w = u if whole else without(u, common)
                v = np.sort(mix(w * _M1 + np.uint64(order))) if order else w
                orders[order] = v, np.r_[np.zeros(1, np.uint64), np.cumsum(mix(v ^ _M1), dtype=np.uint64)]
            v, total = orders[order]
            n = blocks * times
            cut = np.r_[0, np.searchsorted(v, _edges(n)), len(v)]
            here = mix((total[cut[1:]] - total[cut[:-1]]) * _M1 + np.arange(n, dtype=np.uint64) * _M2 + np.uint64(number * len(CUTS) + order))
            full = cut[1:] > cut[:-1]
            enough = int(full.sum()) >= need
            keys.append(here[full] if enough or order < len(CUTS) - 1 else here)
            if enough:
                break
    return np.concatenate(keys) if keys else NO_SHINGLES


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> tuple[int, int]:
    """Sizes of intersection and union."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common, len(x) + len(y) - common


def parity(u: np.ndarray) -> list[int]:
    """For each of some shares of the hashes, whether a set has an odd number there; the larger the set, the more shares.

    Two sets differ in as many shingles at least as their parities in bits.
    """
    shares = SHARES[0]
    while shares < SHARES[1] and len(u) > shares:
        shares *= 4
    odd = (np.bincount((u & np.uint64(shares - 1)).astype(np.int64), minlength=shares) & 1).astype(np.uint8)
    return np.packbits(odd).view("<i8").tolist()


def folded(p: str, words: str) -> str:
    """A parity in so many words: shares whose numbers are equal modulo the words' bits become one."""
    return f"if(size({p}) = {words}, {p}, transform(sequence(0, {words} - 1), k -> aggregate(filter({p}, (x, i) -> i % {words} = k), 0L, (s, x) -> s ^ x)))"


def may_link(n: str, p: str, m: str, q: str, percent: int) -> Column:
    """Whether sizes n, m and parities p, q leave a link open. Parities of different lengths are folded to the shorter."""
    words = f"least(size({p}), size({q}))"
    bits = f"aggregate(zip_with({folded(p, words)}, {folded(q, words)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and ({bits}) * {100 + percent} <= ({n} + {m}) * {100 - percent}")


def may_link_short(n: str, p: str, m: str, q: str, percent: int) -> Column:
    """The same for parities of the least length, without loops: this is asked for every pair that a list leaves open."""
    bits = " + ".join(f"bit_count({p}[{k}] ^ {q}[{k}])" for k in range(SHARES[0] // 64))
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and ({bits}) * {100 + percent} <= ({n} + {m}) * {100 - percent}")


SETS = [T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("parity", T.ArrayType(T.LongType()))]
KEYS = [T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))]


def _node(packed: bytes) -> int | None:
    """What a set is known by; None for an empty one."""
    return xxhash.xxh3_64_intdigest(packed) - (1 << 63) if packed else None


def _rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, text and row: a hash of both, which is the same whenever the row is read."""
    frame = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return frame.withColumn("row", F.xxhash64("doc_id", "text"))


def index(df: DataFrame, id_col: str, text: str, n: int = N) -> DataFrame:
    """doc_id, row, n_shingles, node (null for an empty set) and parity of each row, as a written table."""

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles(t, n) for t in texts.to_pylist()]
            return [pa.array([len(u) for u in sets], pa.int64()), pa.array([_node(u.tobytes()) for u in sets], pa.int64()), pa.array([parity(u) for u in sets], pa.list_(pa.int64()))]

        return fn

    return spill(map_text(_rows(df, id_col, text), make, SETS, keep=["doc_id", "row"], limit=2 << 20), "sets")


def common_shingles(df: DataFrame, id_col: str, text: str, n: int = N) -> np.ndarray:
    """Sorted shingles that many of the different sets in a sample of the rows hold.

    Any set of shingles gives the same links: this one decides only which of them get lists of their own.
    """

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles(t, n) for t in texts.to_pylist()]
            return [pa.array([_node(u.tobytes()) for u in sets], pa.int64()), pa.array([u.view(np.int64) for u in sets], pa.list_(pa.int64()))]

        return fn

    some = _rows(df, id_col, text).where(F.pmod("row", F.lit(SAMPLE)) == 0)
    sets = map_text(some, make, [T.StructField("node", T.LongType()), T.StructField("held", T.ArrayType(T.LongType()))], keep=[], limit=2 << 20)
    each = sets.where("node is not null").dropDuplicates(["node"]).select(F.explode("held").alias("shingle"))
    found = each.groupBy("shingle").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON)
    return np.sort(found.toArrow().column("shingle").to_numpy().astype(np.int64).view(np.uint64))


def _keyed(df: DataFrame, text: str, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """node, n and list keys of the rows with words; a task gives the keys of equal sets once.

    Keys are many, so they go from here into the shuffle and are written nowhere else.
    """

    told = df.sparkSession.sparkContext.broadcast(common)

    def make():
        given: set[int] = set()
        common = told.value

        def fn(texts: pa.Array) -> list[pa.Array]:
            sets = [shingles(t, n) for t in texts.to_pylist()]
            nodes = [_node(u.tobytes()) for u in sets]
            keys = []
            for u, node in zip(sets, nodes, strict=True):
                keys.append(signatures(u, percent, common) if node not in given else np.zeros(0, np.uint64))
                given.add(node)
            if len(given) > 1 << 20:
                given.clear()
            offsets = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            return [pa.array(nodes, pa.int64()), pa.array([len(u) for u in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

        return fn

    return map_text(df, make, KEYS, text, keep=[], limit=2 << 20)


def _lists(keyed: DataFrame) -> DataFrame:
    """Groups pivot, node, n: the nodes of all lists that have a pivot, itself included, of the lists with two nodes or more.

    A list's pivot is its smallest node. Lists of one group of near copies mostly have the same nodes, so that their nodes are far
    fewer than their entries. A sorted partition streams by, no list is held.
    """
    rows = keyed.where("node is not null").select(F.explode("keys").alias("key"), "node", "n")
    names = ["pivot", "node", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key, pivot, node and n of the last row, and whether the pivot has been given out
        for batch in batches:
            key, node, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(key):
                continue
            if last is not None:
                key, node, n = np.r_[last[0], key], np.r_[last[2], node], np.r_[last[3], n]
            new = np.r_[True, key[1:] != key[:-1]]
            fresh = new | np.r_[True, node[1:] != node[:-1]]
            if last is not None:
                fresh[0] = False
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            pivot = node[first]
            given = False
            if last is not None:
                same = first == 0
                pivot = np.where(same, last[1], pivot)
                given = last[4]
            other = fresh & (node != pivot)
            emit = np.flatnonzero(other)
            # The pivot's own row comes with the first other node of its list.
            lead = emit[np.r_[True, key[emit][1:] != key[emit][:-1]]] if len(emit) else emit
            if given and len(lead) and first[lead[0]] == 0:
                lead = lead[1:]
            sizes = n[first[lead]]
            if len(lead) and first[lead[0]] == 0 and last is not None:
                sizes[0] = last[5]
            out = [np.r_[pivot[emit], pivot[lead]], np.r_[node[emit], pivot[lead]], np.r_[n[emit], sizes].astype(np.int32)]
            tail = int(first[-1])
            carried = tail == 0 and last is not None
            given = bool(other[tail:].any()) or carried and given
            last = (key[-1], pivot[-1], node[-1], n[-1], given, last[5] if carried else n[tail])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return spill(rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "pivot long, node long, n int").distinct(), "lists")


def _beside(pairs: DataFrame, held: DataFrame, other: DataFrame) -> DataFrame:
    """a, b and columns of both: pairs a, b with those of ``held`` (by a) and ``other`` (by b). A b with many pairs goes to several tasks."""
    share = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).alias("salts"))
    salted = pairs.join(share, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "salts"))
    left = salted.select("a", "b", "salt").join(held, "a")
    right = other.join(share, "b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return left.join(right, ["b", "salt"]).drop("salt")


def _compare(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """a, b, common, total of pairs of nodes; held: node, packed set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in both], pa.int64()), pa.array([t for _, t in both], pa.int64())], ["a", "b", "common", "total"])

    joined = _beside(pairs, *(held.select(F.col("node").alias(x), F.col("packed").alias(y)) for x, y in (("a", "x"), ("b", "y")))).select("a", "b", "x", "y")
    return spill(joined.mapInArrow(run, "a long, b long, common long, total long"), "compared")


def reference(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that most of some sets hold; those that are known of the sets, sorted, and how many of the sets differ from most in each.

    A shingle that just one set has is not among the known ones; nothing differs there, as far as is known.
    """
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    most = 2 * counts > len(sets)
    known = most | (counts > 1)
    return every[most], every[known], np.where(most, len(sets) - counts, counts)[known].astype(np.uint16)


def excess(differ: int, size: int, percent: int) -> int:
    """How far a set's difference from a reference is beyond its part of what a link allows, in units of 1 / (100 + percent).

    Two sets are linked if their excesses add up to no more than nothing. Otherwise they are linked only if their differences
    have at least that sum over 2 * (100 + percent) shingles in common.
    """
    return (100 + percent) * differ - (100 - percent) * size


def prefixes(differ: int, over: int, least: int, percent: int) -> tuple[bool, int, int]:
    """Whether a set is far, and how many of its difference's shingles, rare ones first, meet all far partners and all partners.

    ``least`` is the least excess of the group. Sets that aren't far are linked with the one that has it, so that just pairs with
    a far set are open. Of two sets that must have c shingles in common, all but the last c - 1 of one meet those of the other.
    """
    far = over + least > 0
    shared = [max(1, -(-(over + partner) // (2 * (100 + percent)))) for partner in (max(1 - least, least), least)]
    short, long = (max(0, differ - c + 1) for c in shared)
    return far, short, max(short, long) if far else short


def _references(sampled: DataFrame) -> DataFrame:
    """pivot, b (what its reference is known by), base, known and differ of each pivot; sampled: pivot, packed, some sets of each."""
    names = ["pivot", "b", "base", "known", "differ"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            base, known, differ = (x.tobytes() for x in reference(sets))
            b = xxhash.xxh3_64_intdigest(base) - (1 << 63)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([b], pa.int64()), *(pa.array([x], pa.binary()) for x in (base, known, differ))], names)

        at, sets = None, []
        for batch in batches:
            for pivot, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if pivot != at:
                    if sets:
                        yield made()
                    at, sets = pivot, []
                sets.append(np.frombuffer(packed.as_py(), np.uint64))
        if sets:
            yield made()

    return sampled.repartition("pivot").sortWithinPartitions("pivot").mapInArrow(run, "pivot long, b long, base binary, known binary, differ binary")


def _by_reference(lists: DataFrame, held: DataFrame, parities: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) and open pairs (a, b) of large groups: together they join what is to be joined.

    lists: pivot, node, component, n; held: node, packed; parities: node, parity, of the least length. A group's reference is what most of SAMPLED sets hold; groups with one reference
    are one. Every set is compared with the reference alone, and what it differs in decides: whoever is near enough is linked with
    the nearest set, and any other pair has to differ from the reference in the same shingles, which are lists again. The sample
    decides how long these lists are, never which links are found.
    """
    rank = F.row_number().over(Window.partitionBy("pivot").orderBy(F.xxhash64("node"), "node"))
    some = lists.withColumn("rank", rank).where(F.col("rank") <= SAMPLED).select("pivot", "node")
    made = spill(_references(some.join(held, "node").select("pivot", "packed")), "references")
    refs = made.groupBy("b").agg(F.min(F.struct("pivot", "base", "known", "differ")).alias("r")).select("b", "r.base", "r.known", "r.differ")
    members = spill(lists.join(made.select("pivot", "b"), "pivot").select(F.col("node").alias("a"), "b", "component").distinct(), "members")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over, rest = [], []
            for packed, *ref in zip(*(batch.column(k) for k in range(2, 6)), strict=True):
                x, base, known = (np.frombuffer(v.as_buffer(), np.uint64) for v in (packed, *ref[:2]))
                often = np.frombuffer(ref[2].as_buffer(), np.uint16)
                d = np.setxor1d(x, base, assume_unique=True)
                k = np.zeros(len(d), np.uint16)
                if len(known):
                    at = np.minimum(np.searchsorted(known, d), len(known) - 1)
                    k = np.where(known[at] == d, often[at], 0)
                over.append(excess(len(d), len(x), percent))
                rest.append(d[np.lexsort((d, k))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(over, pa.int64()), pa.array(rest, pa.binary())], ["a", "b", "over", "rest"])

    both = _beside(members.select("a", "b"), held.select(F.col("node").alias("a"), "packed"), refs).select("a", "b", "packed", "base", "known", "differ")
    measured = spill(both.mapInArrow(measure, "a long, b long, over long, rest binary"), "measured")
    rows = measured.join(members, ["a", "b"])
    least = spill(rows.groupBy("b").agg(F.min(F.struct("over", "a", "component")).alias("least")), "least")
    nearest = measured.select("a", "b", "over").join(least, "b").where("over + least.over <= 0 and a <> least.a").select("a", F.col("least.a").alias("b"))
    nearest = spill(nearest.distinct(), "nearest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rest = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(5)]
                told = [prefixes(len(x), over, low, percent) for x, over, low in zip(rest, part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                sizes = [long for _, _, long in told]
                cols = [np.repeat(c.to_numpy(zero_copy_only=False), sizes) for c in (part.column(0), part.column(1), part.column(2))]
                far = np.repeat(np.array([f for f, _, _ in told], bool), sizes)
                short = np.concatenate([np.arange(long) < s for _, s, long in told]) if told else far
                shingle = np.concatenate([x[:long] for x, (_, _, long) in zip(rest, told, strict=True)]) if told else cols[0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, shingle, far, short)], ["a", "b", "component", "shingle", "far", "short"])

    # Sets that aren't far are of the nearest one's component from here on.
    own = F.when(F.col("over") + F.col("least.over") > 0, F.col("component")).otherwise(F.col("least.component"))
    cuts = rows.join(least, "b").select("a", "b", own.alias("component"), "over", F.col("least.over").alias("low"), "rest")
    entries = cuts.mapInArrow(cut, "a long, b long, component long, shingle long, far boolean, short boolean")
    at = Window.partitionBy("b", "shingle")
    entries = entries.withColumn("lo", F.min("component").over(at)).withColumn("hi", F.max("component").over(at)).where("lo <> hi")
    sizes = lists.select(F.col("node").alias("a"), "n").distinct().join(parities.withColumnRenamed("node", "a"), "a")
    entries = spill(entries.join(sizes, "a").select("b", "shingle", "a", "component", "far", "short", "n", "parity"), "entries")
    left = entries.where("short").select("b", "shingle", F.col("a").alias("x"), F.col("component").alias("xc"), F.col("far").alias("xfar"), F.col("n").alias("xn"), F.col("parity").alias("xp"))
    right = entries.where("far").select("b", "shingle", F.col("a").alias("y"), F.col("component").alias("yc"), "short", F.col("n").alias("yn"), F.col("parity").alias("yp"))
    pairs = left.join(right, ["b", "shingle"]).where(F.expr("xc <> yc and (not xfar or short and x < y)") & may_link_short("xn", "xp", "yn", "yp", percent))
    pairs = spill(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "pairs")
    for x in (made, members, measured, least, entries):
        drop(x)
    return nearest, pairs


def components(edges: DataFrame, most: int = 200) -> DataFrame:
    """node, component (the smallest node reachable) of the nodes of edges (a, b), by alternating large and small stars.

    Every node hooks its neighbours to its smallest one until each is joined to the smallest of its component alone; edges are
    only ever replaced, so that no step makes more than two for each. The answer is written after each step, and steps go on
    until one changes nothing (about the logarithm of the longest chain); should ``most`` steps not do, this raises.
    """
    edges = spill(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    digest = None
    for _ in range(most):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        old, edges = edges, spill(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        before, digest = digest, tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        drop(old)
        if before == digest or not digest[0]:
            break
    else:
        raise RuntimeError(f"components are still changing after {most} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _label(frame: DataFrame, found: DataFrame) -> DataFrame:
    return frame.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _search(df: DataFrame, id_col: str, text: str, n: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Sets of all rows; with ``every`` all links (a, b) of nodes, else node and component of those that have a link."""
    sets = index(df, id_col, text, n)
    lists = _lists(_keyed(df, text, n, percent, common_shingles(df, id_col, text, n)))
    nodes = lists.select("node").distinct()

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            packed = [shingles(t, n).tobytes() for t in texts.to_pylist()]
            return [pa.array(map(_node, packed), pa.int64()), pa.array(packed, pa.binary())]

        return fn

    # One row stands for each node; rows that share an id and a text are one.
    first = sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("parity").alias("parity"))
    first = spill(first, "first")
    parities = first.select("node", F.expr(folded("parity", str(SHARES[0] // 64))).alias("parity"))

    ends = [first.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab"]

    def open_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.join(ends[0], "a").join(ends[1], "b").where(may_link("na", "pa", "nb", "pb", percent)).select("a", "b")

    def fetch(asked: DataFrame) -> DataFrame:
        """Sets of some nodes. Only their texts are fetched: what is asked for is written first, so that a short list of rows
        reaches the texts by broadcast and a long one by shuffle, as its size says."""
        rows = spill(first.join(asked, "node", "left_semi").select("row"), "rows")
        hashed = map_text(_rows(df, id_col, text).join(rows, "row", "left_semi"), make, [T.StructField("node", T.LongType()), T.StructField("packed", T.BinaryType())], keep=[], limit=2 << 20)
        # A set is its node's, whatever else has the hash of its row.
        held = spill(hashed.join(asked, "node", "left_semi").groupBy("node").agg(F.first("packed").alias("packed")), "held")
        drop(rows)
        return held

    def compare(pairs: DataFrame) -> DataFrame:
        """Pairs that parities leave open, compared."""
        pairs = spill(open_pairs(pairs), "pairs")
        held = fetch(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
        out = _compare(pairs, held, percent)
        for x in (pairs, held):
            drop(x)
        return out

    def alone(asked: DataFrame) -> DataFrame:
        """node, t: how many shingles of each asked node no other of them holds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 64):
                    part = batch.slice(k, 64)
                    packed = [x.as_buffer() for x in part.column(1)]
                    node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [x.size // 8 for x in packed])
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(node)], ["shingle", "node"])

        asked = spill(asked, "asked")
        held = fetch(asked)
        own = held.select("node", "packed").mapInArrow(run, "shingle long, node long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1")
        out = spill(own.groupBy("node").agg(F.count("*").alias("t")), "alone")
        drop(held)
        drop(asked)
        return out

    compared = [compare(lists.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))]
    far = compared[0].select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("common") / F.col("total")).alias("d"), F.col("common").alias("c"))
    wide = 1.0 - percent / 100 + 1e-9
    # Distances are sums of few rounded numbers; those that come out just at the limit are compared.
    sure = 1.0 - percent / 100 - 1e-9
    derived: list[DataFrame] = []

    def linked_pairs(tables: list[DataFrame]) -> DataFrame:
        return tables[0].where(f"100 * common >= {percent} * total").select("a", "b") if len(tables) == 1 else linked_pairs(tables[:1]).union(linked_pairs(tables[1:]))

    found: DataFrame | None = None
    own: DataFrame | None = None
    pivots = 1

    def joined() -> DataFrame:
        """What is new joins the components that were found before."""
        new_links = linked_pairs(compared[-1:])
        for x in derived[-1:]:
            new_links = new_links.union(x)
        if found is not None:
            new_links = new_links.union(found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        return components(new_links)

    while True:
        if every:
            labelled = lists.withColumn("component", F.col("node"))
        else:
            found = joined()
            labelled = _label(lists, found)
        # Groups with more than one component (of two nodes, both have been compared), and how far each of their sets is from
        # the first pivot.
        open_ = spill(labelled.groupBy("pivot").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many")).where(f"lo <> hi and many > {max(pivots, 2)}").select("pivot", "many"), "open")
        if open_.isEmpty():
            drop(open_)
            break
        pivots *= MORE
        large, kept = None, []
        if every:
            if own is None:
                # Later rounds are about some of these groups.
                own = alone(lists.join(open_.where(f"many > {MORE}"), "pivot", "left_semi").select("node").distinct())
        else:
            large = open_.where(f"many > {pivots}")
            open_groups = open_.where(f"many <= {pivots}")
        rest = labelled.join(open_ if every else open_groups, "pivot").join(far, ["node", "pivot"], "left").join(parities, "node")
        rest = rest.withColumn("t", F.lit(None).cast("long")) if own is None else rest.join(own, "node", "left")
        is_pivot = F.col("node") == F.col("pivot")
        rest = rest.withColumn("d", F.when(is_pivot, 0.0).otherwise(F.col("d"))).withColumn("c", F.when(is_pivot, F.col("n")).otherwise(F.col("c")))
        # What a pivot alone holds is counted as lacking in the others.
        rest = spill(rest.withColumn("t", F.when(is_pivot, 0).otherwise(F.coalesce("t", F.lit(0)))), "open")
        # Groups are cut into shares of their sets, each of which meets all pivots of this round in a task of its own. Pivots
        # are the sets with the fewest shingles of their own: those that most of the others can be linked with.
        rest_ = rest.withColumn("salts", F.ceil(F.col("many") * F.least("many", F.lit(pivots)) / LOOKS)).withColumn("salt", F.pmod(F.xxhash64("node", "pivot"), "salts"))
        ranked = rest_.withColumn("rank", F.row_number().over(Window.partitionBy("pivot").orderBy("t", F.xxhash64("node"), "node"))).where(F.col("rank") <= pivots)
        chosen = ranked.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("node").alias("b"), *(F.col(x).alias(f"b{x}") for x in ("n", "component", "d", "parity", "c", "t")))
        # Without a distance to the pivot only sizes, parities and what a set alone holds tell. Two sets differ in the shingles
        # that just one of them holds, none of which is the pivot's, and in as many of the pivot's as their shares differ in.
        differ = F.col("t") + F.col("bt") + F.coalesce(F.abs(F.col("c") - F.col("bc")), F.lit(0))
        near = (F.col("component") != F.col("bcomponent")) & F.coalesce(F.abs(F.col("d") - F.col("bd")) <= wide, F.lit(True)) & (differ * (100 + percent) <= (F.col("n") + F.col("bn")) * (100 - percent)) & may_link_short("n", "parity", "bn", "bparity", percent)
        more = rest_.join(chosen, ["pivot", "salt"]).where(near).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"), F.coalesce(F.col("d") + F.col("bd") <= sure, F.lit(False)).alias("sure"))
        more = spill(more.groupBy("a", "b").agg(F.max("sure").alias("sure")), "pairs")
        sure_links, new = more.where("sure").select("a", "b"), more.where("not sure").select("a", "b")
        if large is not None and not large.isEmpty():
            groups = spill(labelled.join(large, "pivot", "left_semi").select("pivot", "node", "component", "n"), "groups")
            asked = spill(groups.select("node").distinct(), "asked")
            held = fetch(asked)
            nearest, wanted = _by_reference(groups, held, parities, percent)
            sure_links, new = sure_links.union(nearest), new.union(wanted).distinct()
            kept = [nearest, wanted]
            for x in (groups, asked, held):
                drop(x)
        seen = [c.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) for c in compared]
        for x in seen:
            new = new.join(x, ["a", "b"], "left_anti")
        derived.append(sure_links)
        compared.append(compare(new))
        drop(rest)
        drop(open_)
        if not every:
            found = joined()
            for x in kept:
                drop(x)
            break
    if every:
        all_links = linked_pairs(compared)
        for x in derived:
            all_links = all_links.union(x)
        out = spill(all_links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    else:
        out = found
    for x in (lists, first, *compared, *derived, *([] if own is None else [own])):
        drop(x)
    return sets, out


def join(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row for each row: doc_id, row, n_shingles, component (null for an empty set), component_id (the smallest id reachable
    by links) and class_id (the smallest id of equal sets)."""
    sets, labels = _search(df, id_col, text, n, percent, every=False)
    by_node = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("class_id"))
    smallest = _label(by_node, labels).select("component", "class_id").groupBy("component").agg(F.min("class_id").alias("component_id"))
    known = spill(_label(by_node, labels).join(smallest, "component").select("node", "component", "class_id", "component_id"), "components")
    out = sets.join(known, "node", "left").select("doc_id", "row", "n_shingles", "component", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))
    out = spill(out, "joined")
    drop(sets)
    drop(known)
    return out


def links(df: DataFrame, id_col: str = "doc_id", text: str = "text", *, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every link, and the rows that have it.

    Returns (pairs, members): pairs (a, b) of linked classes of different sets, a > b; members doc_id, n_shingles, class (null
    for an empty set) and n_links, the number of other rows that the row is linked with, equal sets included.
    """
    sets, pairs = _search(df, id_col, text, n, percent, every=True)
    size = sets.where("node is not null").groupBy("node").agg(F.count("*").alias("rows"))
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = both.join(size.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("rows").alias("others"))
    known = size.join(other, "node", "left").select("node", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    members = sets.join(known, "node", "left").select("doc_id", "n_shingles", F.col("node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return pairs, members


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
