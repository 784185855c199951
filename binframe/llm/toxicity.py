"""Toxicity by a convolutional text classifier, trained in numpy.

Words in lower case are hashed to embeddings; a word that few texts of the fit hold shares one with all words of its first four
letters, or has none where these are as rare. Filters over one, two and three words are pooled by their maximum over the whole
text, and a linear layer gives the score. Thresholds are calibrated by language: a text's language is told by its function
words, and the score is moved so that the best threshold of its language is 0.5. Filters' products with all embeddings are
tabulated, so that scoring a text is adding rows of tables.

The fit takes at most ``most`` labelled rows, chosen by a hash of the id, positives first up to a third. Null text counts as
empty; an empty text has the score of no evidence. Rows without a label, of unknown documents or with null ids teach nothing;
of several labels of an id the highest counts. Without any label of both kinds every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe.llm._util import fold, keeps, map_text, table

#: Labelled rows to fit on at most.
MOST = 4000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 16, (1, 2, 3)
#: Letters that a rare word is known by, and the least length of such a word, in bytes.
PREFIX, LONGER = 4, 6
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 or b == 39 else 32 for b in range(256))
#: Function words by which a text's language is told, for its threshold.
FUNCTION_WORDS = {
    "en": "the of and to in is was that it for on with as are this be at by from have",
    "fr": "le la les de des du et un une est que dans pour qui sur pas au par il elle",
    "de": "der die das und ist nicht von zu den mit ein eine im dem des auf für sich es auch",
    "es": "el la los las de del y un una es que en por con para se no su al lo",
}


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        k = 1 + xxhash.xxh3_64_intdigest(word) % (BUCKETS - 1)
        p = 1 + xxhash.xxh3_64_intdigest(word[:PREFIX] + b"*") % (BUCKETS - 1) if len(word) >= LONGER else 0
        self[word] = k = k | p << 15
        return k


_KNOWN = _Buckets()
keeps(__name__, _KNOWN.clear)


def word_ids(text: str | None) -> np.ndarray:
    """Bucket of each word, and 15 bits up that of its first letters (0: none)."""
    return np.fromiter(map(_KNOWN.__getitem__, (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()), np.int32)


def _language_table() -> tuple[list[str], np.ndarray]:
    langs = sorted(FUNCTION_WORDS)
    out = np.zeros((BUCKETS, len(langs)), np.int32)
    for k, lang in enumerate(langs):
        for w in FUNCTION_WORDS[lang].split():
            out[_KNOWN[w.encode()] & BUCKETS - 1, k] = 1
    return langs, out


_LANGS, _TABLE = _language_table()


def languages(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of the language with most function words in each text, -1 without any."""
    counts = np.stack([np.diff(np.r_[0, np.cumsum(_TABLE[flat, k])][at]) for k in range(len(_LANGS))], 1) if len(flat) else np.zeros((len(at) - 1, len(_LANGS)), np.int64)
    return np.where(counts.max(1) > 0, counts.argmax(1), -1)


def _lay_out(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each with three empty words behind, and where they begin.

    Filters laid at the last two would reach into the next text; they don't count.
    """
    sizes = np.array([len(r) + 3 for r in rows], np.int64)
    at = np.r_[0, np.cumsum(sizes)]
    flat = np.zeros(int(at[-1]) + 2, np.int32)
    for r, s in zip(rows, at.tolist(), strict=False):
        flat[s : s + len(r)] = r
    return flat, at


@dataclass
class Model:
    embed: np.ndarray
    known: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(_LANGS) + 1))
    trained: bool = True
    tables: list[list[np.ndarray]] | None = None

    @classmethod
    def start(cls, seed: int) -> Model:
        r = np.random.default_rng(seed)
        return cls((r.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32) * (np.arange(BUCKETS) > 0)[:, None].astype(np.float32), np.arange(BUCKETS) > 0, [(r.standard_normal((w, DIM, FILTERS)) / np.sqrt(w * DIM)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), (r.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32), 0.0)

    def pick(self, row: np.ndarray) -> np.ndarray:
        """The embedding of each word: its own, that of its first letters, or none (0)."""
        word, prefix = row & BUCKETS - 1, row >> 15
        return np.where(self.known[word], word, np.where(self.known[prefix], prefix, 0)).astype(np.int32)

    def _pool(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Maximum of every filter over every text, from the tables."""
        if self.tables is None:
            self.tables = [[self.embed @ f[k] for k in range(len(f))] for f in self.filters]
        out, n = [], int(at[-1])
        for taps in self.tables:
            y = taps[0][flat[:n]]
            for k in range(1, len(taps)):
                y += taps[k][flat[k : n + k]]
            y[at[1:] - 1] = y[at[1:] - 2] = -np.inf
            out.append(np.maximum.reduceat(y, at[:-1], axis=0))
        return np.maximum(np.concatenate(out, 1) + self.bias, 0)

    def logits(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Score before calibration, and language number of each text."""
        if not rows:
            return np.zeros(0), np.zeros(0, np.int64)
        flat, at = _lay_out(rows)
        return self._pool(self.pick(flat), at) @ self.out + self.out_bias, languages(flat[: int(at[-1])] & BUCKETS - 1, at)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(rows))
        z, lang = self.logits(rows)
        return 1 / (1 + np.exp(-np.clip(z - self.shift[lang], -30, 30)))


def fit(rows: list[np.ndarray], label: np.ndarray, *, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 3, negatives: float = 1.0) -> Model:
    """Adam on the logistic loss with classes in balance, then thresholds by language on a fifth that was left out."""
    m = Model.start(seed)
    if not len(rows) or label.min() == label.max():
        m.trained = False
        return m
    r = np.random.default_rng(seed)
    # A word of few texts can only be learnt by heart.
    spread = np.bincount(np.concatenate([np.unique(np.r_[x & BUCKETS - 1, x >> 15]) for x in rows]), minlength=BUCKETS)
    m.known = spread >= max(3, len(rows) // 400)
    m.known[0] = False
    m.embed[~m.known] = 0
    whole, rows = rows, [m.pick(x) for x in rows]
    order = r.permutation(len(rows))
    check, learn = order[: len(order) // 5], order[len(order) // 5 :]
    if label[learn].min() == label[learn].max():
        check, learn = order, order
    weight = np.where(label == 1, 0.5 / label[learn].mean(), 0.5 / (1 - label[learn].mean()))
    flat_params = [m.embed, *m.filters, m.bias, m.out]
    first, second = [np.zeros_like(p) for p in flat_params], [np.zeros_like(p) for p in flat_params]
    step, bias_out = 0, [0.0, 0.0]
    best: tuple[float, list] | None = None
    # Few rows get more epochs, up to some 800 steps in all.
    for _ in range(max(epochs, min(60, 800 * batch // max(1, len(learn))))):
        for some in np.array_split(r.permutation(learn), max(1, len(learn) // batch)):
            flat, at = _lay_out([rows[k] for k in some])
            n, d = int(at[-1]), len(some)
            x = m.embed[flat]
            pooled, where = [], []
            for f in m.filters:
                y = x[:n] @ f[0]
                for k in range(1, len(f)):
                    y += x[k : n + k] @ f[k]
                place = np.stack([y[s : e - 2].argmax(0) + s for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                top = np.take_along_axis(y, place, 0)
                pooled.append(top)
                where.append(place)
            pre = np.concatenate(pooled, 1) + m.bias
            act = np.maximum(pre, 0)
            keep = (r.random(act.shape) < 0.7) / 0.7
            z = (act * keep) @ m.out + m.out_bias
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]) * weight[some] / d).astype(np.float32)
            g_out = (act * keep).T @ g
            g_act = np.outer(g, m.out) * keep * (pre > 0)
            g_act = g_act.astype(np.float32)
            g_embed, g_filters = np.zeros_like(x), [np.zeros_like(f) for f in m.filters]
            for j, f in enumerate(m.filters):
                part = g_act[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(len(f)):
                    at_word = where[j] + k
                    g_filters[j][k] = np.einsum("dfe,df->ef", x[at_word], part)
                    np.add.at(g_embed, at_word.ravel(), (part[:, :, None] * f[k].T[None]).reshape(-1, DIM))
            used = np.flatnonzero(g_embed.any(1))
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.99**step
            words, inverse = np.unique(flat[used], return_inverse=True)
            words_grad = np.zeros((len(words), DIM), np.float32)
            np.add.at(words_grad, inverse, g_embed[used])
            live = words > 0
            words, words_grad = words[live], words_grad[live]
            first[0][words] = 0.9 * first[0][words] + 0.1 * words_grad
            second[0][words] = 0.99 * second[0][words] + 0.01 * words_grad**2
            m.embed[words] -= rate * (first[0][words] / fix1) / (np.sqrt(second[0][words] / fix2) + 1e-6)
            for p, grad, a, b in zip(flat_params[1:], [*g_filters, g_act.sum(0), g_out], first[1:], second[1:], strict=True):
                a += 0.1 * (grad - a)
                b += 0.01 * (grad**2 - b)
                p -= rate * (a / fix1) / (np.sqrt(b / fix2) + 1e-6)
            gb = float(g.sum())
            bias_out = [0.9 * bias_out[0] + 0.1 * gb, 0.99 * bias_out[1] + 0.01 * gb * gb]
            m.out_bias -= rate * (bias_out[0] / fix1) / (np.sqrt(bias_out[1] / fix2) + 1e-6)
        m.tables = None
        z, _ = m.logits([whole[k] for k in check])
        y = label[check]
        ranked = float(np.mean(np.searchsorted(np.sort(z[y == 0]), z[y == 1]))) / max(1, (y == 0).sum())
        if best is None or ranked >= best[0]:
            best = (ranked, [p.copy() for p in flat_params] + [m.out_bias])
    m.embed, m.filters, m.bias, m.out, m.out_bias = best[1][0], best[1][1 : 1 + len(WIDTHS)], best[1][-3], best[1][-2], best[1][-1]
    m.tables = None
    z, lang = m.logits([whole[k] for k in check])
    y = label[check]
    everywhere = _threshold(z, y, negatives)
    m.shift = np.array([_threshold(z[lang == k], y[lang == k], negatives) if (y[lang == k] == 1).sum() >= 10 and (y[lang == k] == 0).sum() >= 10 else everywhere for k in [*range(len(_LANGS)), -1]])
    return m


def _threshold(z: np.ndarray, y: np.ndarray, negatives: float) -> float:
    """Where the F score that counts a false alarm twice is best, halfway to the next lower score.

    negatives: how many rows without the label each one here stands for.
    """
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    alarms = (np.arange(1, len(z) + 1) - hits) * negatives
    f = 1.25 * hits / (hits + alarms + 0.25 * max(1, y.sum()))
    k = int(np.argmax(f))
    return float(z[order[k]] + z[order[min(k + 1, len(z) - 1)]]) / 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", *, most: int = MOST) -> Model:
    """Fit on at most ``most`` labelled rows."""
    rows = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return fit([], np.zeros(0))
    positive = min(counts[1], max(most // 3, most - counts[0]))
    wanted = {1: positive, 0: min(counts[0], most - positive)}
    slot = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    share = {y: int(1_100_000 * wanted[y] / counts[y]) + 1 for y in (0, 1)}
    found = rows.withColumn("slot", slot).where(F.col("slot") < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).collect()
    chosen = [x for y in (0, 1) for x in sorted((r for r in found if r.y == y), key=lambda r: (r.slot, r.id))[: wanted[y]]]
    # At most ``most`` ids are broadcast, whatever the tables' sizes.
    ids = docs.sparkSession.createDataFrame([(r.id, r.y) for r in chosen], "id long, y int")
    some = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(ids), "id")
    # Rows that repeat an id count once (the least text), so that what comes to the driver is bounded.
    some = some.groupBy("id", "y").agg(F.min("text").alias("text"))

    def make():
        return lambda texts: [pa.array([word_ids(t).tobytes() for t in texts.to_pylist()], pa.binary())]

    got = sorted(map_text(some, make, [T.StructField("words", T.BinaryType())], keep=["id", "y"]).collect(), key=lambda r: (r.id, r.words))
    return fit([np.frombuffer(r.words, np.int32) for r in got], np.array([r.y for r in got]), negatives=counts[0] / max(1, wanted[0]) * wanted[1] / counts[1])


def score(df: DataFrame, model: Model, text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Append score and predicted (1 from 0.5). Columns of those names are replaced."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def fn(texts: pa.Array) -> list[pa.Array]:
            s = held.value.scores([word_ids(t) for t in texts.to_pylist()])
            return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]

        return fn

    return map_text(df, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], text, keep, limit=2 << 20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four of five folds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold("doc_id", 5) != 0))
    return score(docs.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False))), model, keep=["doc_id", "held_out"])
