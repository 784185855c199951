"""Language identification in two steps: the language's family, then one-versus-one machines within it.

Features are hashed byte trigrams of letters. Family machines (one against the rest) and pair machines are linear support
vector machines without bias, trained by dual coordinate descent on texts scaled to length one; a prediction just adds weights
over the whole text, as the sign doesn't depend on the scale. The fit takes at most ``per_language`` texts of each language,
chosen by a hash of the id; counts of languages cover all rows.

Null text, or text without a letter, is ``und`` with score 0, as is everything when no row has a language. Rows with null
languages or null ids teach nothing. Repeated rows are predicted one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe.llm._util import fold, map_text, table

#: Texts of each language to fit on at most.
PER_LANGUAGE = 1500
BUCKETS = 1 << 15
#: Languages by family; one that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "hr", "sr"),
    "uralic": ("fi", "hu", "et"),
}
_LETTER = regex.compile(r"\p{L}")
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def family(lang: str, families: dict[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, members in families.items() if lang in members), f"only {lang}")


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the texts, and where each text's begin (one more at the end)."""
    raw = [b" " + (t or "").encode("utf-8", "surrogatepass") + b"  " for t in texts]
    sizes = np.array([len(b) for b in raw], np.int64)
    data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    h = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) + data[2:] * np.uint32(0x27D4EB2F)
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    # The last two of a text reach into the next one: they are those of its trailing spaces, so blank them.
    out = (h >> np.uint32(17)).astype(np.int32)
    ends = np.cumsum(sizes)
    keep = np.ones(len(data), bool)
    keep[ends - 1] = keep[ends - 2] = False
    return out[keep[:-2]] if len(out) else out, np.r_[0, np.cumsum(sizes - 2)]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their share of a text's vector of length one."""
    bucket, count = np.unique(grams([text])[0], return_counts=True)
    return bucket, (count / np.sqrt(float((count.astype(float) ** 2).sum()) or 1.0)).astype(np.float32)


def svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, *, cost: float = 4.0, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """Weights of a linear machine with hinge loss, by dual coordinate descent."""
    w, alpha = np.zeros(BUCKETS, np.float32), np.zeros(len(rows))
    weight = np.where(sign > 0, 0.5 / max(1e-9, (sign > 0).mean()), 0.5 / max(1e-9, (sign < 0).mean())) * cost
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in order.permutation(len(rows)).tolist():
            at, x = rows[k]
            gradient = sign[k] * float(w[at] @ x) - 1.0
            new = min(max(alpha[k] - gradient, 0.0), weight[k])
            if new != alpha[k]:
                w[at] += np.float32((new - alpha[k]) * sign[k]) * x
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    """families and, of each, its languages; columns of ``weights``: families, then pairs of languages."""

    families: list[str] = field(default_factory=list)
    members: list[list[str]] = field(default_factory=list)
    pairs: list[list[tuple[int, int, int]]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 1), np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1, np.float32))

    @classmethod
    def fit(cls, rows: list[tuple[str, np.ndarray, np.ndarray]], families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
        m = cls()
        langs = sorted({r[0] for r in rows})
        m.families = sorted({family(x, families) for x in langs})
        m.members = [[x for x in langs if family(x, families) == f] for f in m.families]
        data, lang = [(a, x) for _, a, x in rows], np.array([r[0] for r in rows])
        group = np.array([m.families.index(family(x, families)) for x in lang])
        columns, scale = [], []

        def add(which: np.ndarray, sign: np.ndarray) -> int:
            some = [data[k] for k in which.tolist()]
            w = svm(some, sign)
            columns.append(w)
            scale.append(3.0 / max(1e-6, float(np.median([abs(float(w[a] @ x)) for a, x in some]))))
            return len(columns) - 1

        every = np.arange(len(data))
        for k in range(len(m.families)):
            if len(m.families) > 1:
                add(every, np.where(group == k, 1.0, -1.0))
        for members in m.members:
            here = []
            for i in range(len(members)):
                for j in range(i + 1, len(members)):
                    which = np.flatnonzero((lang == members[i]) | (lang == members[j]))
                    here.append((i, j, add(which, np.where(lang[which] == members[i], 1.0, -1.0))))
            m.pairs.append(here)
        if columns:
            m.weights, m.scale = np.ascontiguousarray(np.stack(columns, 1)), np.array(scale, np.float32)
        return m

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known or not self.families:
            return langs, scores
        bucket, at = grams([texts[k] for k in known])
        sums = np.stack([np.add.reduceat(np.ascontiguousarray(self.weights[:, c])[bucket], at[:-1]) for c in range(self.weights.shape[1])], 1)
        # Margins of the text scaled to length one, as in the fit.
        norm = np.array([np.sqrt(float((np.bincount(bucket[s:e], minlength=1).astype(np.float64) ** 2).sum())) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        margin = sums / np.maximum(norm, 1e-9)[:, None] * self.scale
        sure = lambda x: 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
        for k, m in zip(known, margin, strict=True):
            f = int(np.argmax(m[: len(self.families)])) if len(self.families) > 1 else 0
            score = float(sure(m[f])) if len(self.families) > 1 else 1.0
            members = self.members[f]
            votes = np.zeros(len(members))
            for i, j, c in self.pairs[f]:
                votes[i if m[c] >= 0 else j] += 1 + 1e-3 * abs(float(m[c]))
            best = int(np.argmax(votes))
            beaten = [float(sure(m[c] if i == best else -m[c])) for i, j, c in self.pairs[f] if best in (i, j)]
            langs[k], scores[k] = members[best], min([score, *beaten])
        return langs, scores


def train(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", *, per_language: int = PER_LANGUAGE, families: dict[str, tuple[str, ...]] = FAMILIES) -> Model:
    """Fit on at most ``per_language`` rows of each language that have an id, a text with letters and a language."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("id is not null and lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    slot = F.xxhash64("id", "text").bitwiseAND(F.lit((1 << 63) - 1))
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen = chosen | ((F.col("lang") == name) & (slot <= F.lit(int(min(1.0, (1.1 * per_language + 40) / n) * ((1 << 63) - 1024)))))

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            found = [features(t) if _LETTER.search(t or "") else (np.zeros(0, np.int32), np.zeros(0, np.float32)) for t in texts.to_pylist()]
            return [pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())]

        return fn

    # Rows that repeat an id and a text count once, so that what comes to the driver is bounded.
    some = rows.where(chosen).withColumn("slot", slot).dropDuplicates(["lang", "slot"])
    sample = map_text(some, make, [T.StructField("bucket", T.BinaryType()), T.StructField("share", T.BinaryType())], keep=["slot", "lang"])
    by: dict[str, list] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["slot"], r["bucket"])):
        if r["bucket"] and len(by.setdefault(r["lang"], [])) < per_language:
            by[r["lang"]].append((r["lang"], np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["share"], np.float32)))
    return Model.fit([x for rows_ in by.values() for x in rows_], families)


def predict(df: DataFrame, model: Model, text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred and score. Columns of those names are replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            langs, scores = held.value.predict(texts.to_pylist())
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

        return fn

    return map_text(df, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], text, keep, limit=2 << 20)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])
