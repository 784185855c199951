"""Token counts by a two-tier lookup on the map side; nothing is shuffled.

Tier one is a hash table of frequent pre-tokens and their lengths in tokens, broadcast to every worker. It comes from the
vocabulary, which lists what was frequent in the text that it was made from, so its size is bounded by the vocabulary's
whatever the corpus holds. Tier two is a cache in each worker for everything else; what neither knows is encoded. The
tables only save time: a count is that of the tokens whatever they hold.

Null text counts as empty: 0 bytes, 0 tokens. Special strings in a text are one token each. Repeated rows are counted one
by one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from binframe.llm._util import keeps, map_text, table
from binframe.llm.bpe import _ODD, BATCH_BYTES, CACHE_WORDS, ByteBPE, default_path, encoder

#: Entries of tier one at most, shortest ids (the most frequent merges) first: under 4 MB broadcast.
TABLE_WORDS = 50_000


def frequent_lengths(model: ByteBPE, most: int = TABLE_WORDS) -> dict[str, int]:
    """Pre-tokens that the vocabulary lists, and the number of tokens each is encoded to."""
    words = []
    for raw in model.token_bytes:
        try:
            w = raw.decode()
        except UnicodeDecodeError:
            continue
        if w and w not in model.special and model.findall(w) == [w]:
            words.append(w)
    words = words[:most]
    return {w: len(x) // 4 for w, x in zip(words, model._encode_words([[w] for w in words]), strict=True)}


class Counter:
    """Counts tokens; ``table`` is tier one, the dictionaries grown from it are tier two."""

    def __init__(self, model: ByteBPE, table: dict[str, int], cache_words: int = CACHE_WORDS) -> None:
        self.model, self.table, self.cache_words = model, table, cache_words
        # Pieces between spaces stand for themselves with a space before, see ByteBPE.pieces.
        self.first = {w[1:]: n for w, n in table.items() if w[0] == " " and len(w) > 1}
        self.pieces: dict[str, int] = dict(self.first)
        self.head = len(model.encode(["\n"])[0]) // 4

    def _words(self, lists: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens: tier one, then the encoder and its cache."""
        get = self.table.get
        missing: list[list[str]] = [[w for w in x if w not in self.table] for x in lists]
        rest = self.model._encode_words(missing)
        return [sum(get(w, 0) for w in x) + len(r) // 4 for x, r in zip(lists, rest, strict=True)]

    def count(self, texts: list[str | None]) -> list[int]:
        model, out, plain = self.model, [0] * len(texts), []
        for i, t in enumerate(texts):
            if not t:
                continue
            if model._specials and model._specials.search(t):
                parts = [p for p in model._specials.split(t) if p]
                out[i] = sum(1 if p in model.special else self.count([p])[0] for p in parts)
            elif t[0].isspace() or _ODD.search(t):
                out[i] = self._words([model.findall(t)])[0]
            else:
                plain.append(i)
        if plain:
            cut = [model.pieces(texts[i]) for i in plain]
            missing = set().union(*cut) - self.pieces.keys()
            if missing:
                if len(self.pieces) + len(missing) > self.cache_words:
                    self.pieces = dict(self.first)
                    missing = set().union(*cut) - self.pieces.keys()
                missing = list(missing)
                self.pieces.update(zip(missing, self._words([model.findall(p if p[0] == "\n" else " " + p) for p in missing]), strict=True))
            get = self.pieces.__getitem__
            for i, x in zip(plain, cut, strict=True):
                out[i] = sum(map(get, x)) - self.head
        return out


#: One counter in each Python worker.
_COUNTERS: dict[str, Counter] = {}
keeps(__name__, _COUNTERS.clear)


def count_tokens(df: DataFrame, text: str = "text", *, path: str | None = None, limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit (n_tokens > limit). Columns of those names are replaced."""
    path = path or default_path()
    spark = df.sparkSession
    lengths = spark.sparkContext.broadcast(frequent_lengths(encoder(path)))

    def make():
        if path not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[path] = Counter(encoder(path), lengths.value)
        counter = _COUNTERS[path]

        def fn(texts: pa.Array) -> list[pa.Array]:
            import pyarrow.compute as pc

            n = counter.count(texts.to_pylist())
            return [pc.fill_null(pc.binary_length(texts), 0), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]

        return fn

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return map_text(df, make, fields, text, keep, limit=BATCH_BYTES)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 512 tokens."""
    return count_tokens(table(spark, sf_dir, "documents"), keep=["doc_id"])
