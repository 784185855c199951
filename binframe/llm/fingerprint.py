"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions only.

A text is cut into paragraphs (at line breaks) and those at sentence ends. Each piece is hashed to a wide vector, and the
vectors are summed: EQUAL lanes of 32 bits modulo 2**32, which decide equality, and LIKE lanes of 31 bits that count one
random bit of each piece, packed two to a word and summed modulo 2**62, from which a likeness follows. A lane is exact below
2**31 pieces, more than one text can have. The sum doesn't depend on the order of pieces, and pieces can be added or taken
away (``insert`` and ``remove``).

Null text counts as empty: the fingerprint of no pieces. Empty pieces don't count. Rows with equal ids are ordered by text
where an order is asked for, null ids come last.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binframe.llm._util import table

SEEDS, WORDS = 4, 64
EQUAL, LIKE = 2 * SEEDS, 2 * WORDS
_LOW32, _CAP = (1 << 32) - 1, (1 << 62) - 1
_LANE = (1 << 31) - 1
_SPREAD, _BITS = 1 + (1 << 30), 1 + (1 << 31)
#: Java pattern between pieces.
SPLIT = r"\n+|(?<=[.!?]) +"


def pieces(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda p: p != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _hashes(parts: Column, seed: int) -> Column:
    return F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))


def _spread(shift: int):
    """Two bits of a hash, each in a lane of its own."""
    return lambda x: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(3)) * F.lit(_SPREAD)).bitwiseAND(F.lit(_BITS))


def vector(parts: Column) -> Column:
    """array<bigint>: piece count, EQUAL lanes, WORDS packed words."""
    total = lambda xs, f, cap: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: (a + f(x)).bitwiseAND(F.lit(cap)))

    def lanes(h: Column) -> Column:
        out = [F.size(F.get(h, 0)).cast("long")]
        for k in range(SEEDS):
            out += [total(F.get(h, k), lambda x: x.bitwiseAND(F.lit(_LOW32)), _LOW32), total(F.get(h, k), lambda x: F.shiftrightunsigned(x, 32), _LOW32)]
        for w in range(WORDS):
            out.append(total(F.get(h, SEEDS + w // 32), _spread(2 * (w % 32)), _CAP))
        return F.array(*out)

    hashed = lambda ps: F.array(*[_hashes(ps, k) for k in range(SEEDS + WORDS // 32)])
    return _let(parts, lambda ps: _let(hashed(ps), lanes))


def _caps() -> Column:
    return F.array(*[F.lit(x).cast("long") for x in [_LOW32] * (1 + EQUAL) + [_CAP] * WORDS])


def insert(vec: Column, parts: Column) -> Column:
    """Vector of a text with the pieces added."""
    return F.transform(F.arrays_zip(vec.alias("a"), vector(parts).alias("b"), _caps().alias("c")), lambda x: (x["a"] + x["b"]).bitwiseAND(x["c"]))


def remove(vec: Column, parts: Column) -> Column:
    """Vector of a text with the pieces taken away."""
    return F.transform(F.arrays_zip(vec.alias("a"), vector(parts).alias("b"), _caps().alias("c")), lambda x: (x["a"] - x["b"]).bitwiseAND(x["c"]))


def text_of(vec: Column) -> Column:
    """The fingerprint as hexadecimal digits."""
    return F.concat_ws("", F.transform(vec, lambda x, i: F.lpad(F.hex(x), F.when(i <= EQUAL, 8).otherwise(16), "0")))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the centred LIKE lanes, within 0 and 1; 1 for equal fingerprints, 0 if just one has no pieces.

    Its expected value is that of the multisets of pieces; its standard error about 1 / sqrt(LIKE).
    """
    lanes = lambda v: F.flatten(F.transform(F.slice(v, 2 + EQUAL, WORDS), lambda w: F.array(*[F.shiftrightunsigned(w, s).bitwiseAND(F.lit(_LANE)) for s in (0, 31)])))
    centre = lambda v: F.transform(lanes(v), lambda x: (2 * x - F.get(v, 0)).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    cosine = lambda xy: dot(F.get(xy, 0), F.get(xy, 1)) / F.nullif(F.sqrt(dot(F.get(xy, 0), F.get(xy, 0))) * F.sqrt(dot(F.get(xy, 1), F.get(xy, 1))), F.lit(0.0))
    near = _let(F.array(centre(a), centre(b)), cosine)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(near, F.lit(0.0)))))


def fingerprint(df: DataFrame, text: str = "text", *, output: str = "fingerprint") -> DataFrame:
    """Append ``output``, replacing a column of that name."""
    return df.withColumn(output, text_of(vector(pieces(F.col(text)))))


#: Rows to a range of ids, and ranges at most; the list of their bounds is what is held for all rows.
RANGE_ROWS, RANGES = 4_000, 100_000


def with_next(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, text and the vector of each row, and those of the next row in descending order of ids (after the last: the first).

    Ids are cut into ranges of about equal rows; each range also gets the first rows of the range below (the last one:
    those of the first), so that neighbours meet in one task and a text is shuffled once.
    """
    spark = df.sparkSession
    ids = df.select(F.col(id_col).cast("long").alias("i"))
    n = ids.count()
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    many = min(RANGES, max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))
    many = max(1, min(many, n // 64))
    # Some ranges to a task, so that chance doesn't give one task many of them; tasks grow with the rows.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-many // 2))
    cuts: list[int] = []
    if many > 1:
        at = [k / many for k in range(1, many)]
        cuts = sorted(set(ids.agg(F.percentile_approx("i", at, max(10_000, 20 * many))).first()[0] or []))
    place = F.lit(0)
    if cuts:
        bounds, steps = F.lit(cuts), F.lit([1 << k for k in reversed(range(len(cuts).bit_length()))])
        # The number of bounds below the id, by binary search; null ids are below all.
        place = F.aggregate(steps, F.lit(0), lambda pos, s: pos + F.when(F.coalesce(F.get(bounds, pos + s - 1) < F.col("id"), F.lit(False)), s).otherwise(0))
    tops = sorted(((r["range"], r["top"]) for r in base.select(place.alias("range"), "id").groupBy("range").agg(F.max("id").alias("top")).collect()), key=lambda x: x[0])
    placed = base.withColumn("range", place)
    # A range's highest id also goes to the range above; the highest of all to the lowest range, behind its rows.
    width = (tops[-1][0] + 1) if tops else 1
    heads, target = [None] * width, [None] * width
    for k, (r, top) in enumerate(tops):
        heads[r] = top
        if k + 1 < len(tops):
            target[r] = tops[k + 1][0]
    first, lowest = (tops[-1][1], tops[0][0]) if tops else (None, 0)
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if len(xs) < 64 else F.from_json(F.lit(str(xs).replace("None", "null")), "array<bigint>")
    head = F.get(longs(heads), F.col("range"))
    own = F.struct(F.col("range").cast("long").alias("range"), F.lit(0).alias("copy"))
    up = F.struct(F.get(longs(target), F.col("range")).alias("range"), F.lit(1).alias("copy"))
    wrap = F.struct(F.lit(lowest).cast("long").alias("range"), F.lit(2).alias("copy"))
    is_head = F.col("id").eqNullSafe(head)
    goes = F.filter(F.array(own, F.when(is_head, up), F.when(F.col("id").eqNullSafe(F.lit(first)), wrap)), lambda g: g["range"].isNotNull())
    spread = placed.select("id", "text", F.explode(goes).alias("g")).select("id", "text", "g.range", "g.copy").repartition(tasks, "range")
    order = Window.partitionBy("range").orderBy("copy", F.col("id").desc_nulls_last(), "text")
    lead = spread.withColumn("vec", vector(pieces(F.col("text"))))
    return lead.select("id", "text", "vec", "copy", F.lead("text").over(order).alias("next_text"), F.lead("vec").over(order).alias("next_vec")).where("copy = 0").drop("copy")


def edited(df: DataFrame) -> DataFrame:
    """op2's rows from those of ``with_next``."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    cut = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    vec = cut.select("*", vector(pieces(F.col("edited"))).alias("edited_vec"), F.sha2("edited", 256).alias("edited_sha256"))
    return vec.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", text_of(F.col("vec")).alias("fingerprint"), text_of(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"), likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return edited(with_next(table(spark, sf_dir, "documents"), "doc_id", "text"))


def split_pieces(text: str) -> list[str]:
    """The pieces of a text, for tests."""
    return [p for p in re.split(SPLIT, text or "") if p]
