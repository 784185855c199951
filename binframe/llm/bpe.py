"""Byte-pair encoding in batched numpy merge rounds, and decoding.

A batch's unseen pre-tokens lie as symbols in one flat array. Each round looks every neighbouring pair up by binary
search over the sorted pair keys, takes the lowest rank of each word and merges it wherever it occurs in that word, until
no word has a known pair. Very long pre-tokens are merged one by one with a heap, which gives the same result.

Null text counts as empty: no ids, empty decoded text. Special strings in a text are special tokens, as the tokenizers
library has them by default. Repeated rows are encoded one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe.llm._util import keeps, map_text, table

VOCABULARY = "byte_bpe_50k.json"
#: Pieces kept in a worker's cache; past it the cache starts anew (about 150 bytes a piece).
CACHE_WORDS = 330_000
#: Bytes of text that are cut into pieces at once.
BATCH_BYTES = 3 << 20
#: Symbols from which a pre-token is merged by heap.
LONG = 256

#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class Merges:
    """Merge tables: pairs of ids as sorted keys, with their ranks and the ids they become."""

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.none = np.int32(len(pairs))
        self.made_by_rank = made
        self.table: dict[int, int] | None = None

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or ``none``."""
        want = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.ranks[at], self.none)

    def rounds(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words at once. flat: their symbols one after another; returns the ids and new lengths."""
        done_ids: list[np.ndarray] = []
        done_words: list[np.ndarray] = []
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        flat = flat.astype(np.int32)
        out_len = np.zeros(len(lengths), np.int64)
        while len(flat):
            rank = np.full(len(flat), self.none, np.int32)
            if len(flat) > 1:
                inside = np.flatnonzero(word[1:] == word[:-1])
                rank[inside] = self.lookup(flat[inside], flat[inside + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(flat)])
            low = np.repeat(lowest, size)
            active = low < self.none
            if not active.all():
                rest = ~active
                done_ids.append(flat[rest])
                done_words.append(word[rest])
                flat, word, rank, low = flat[active], word[active], rank[active], low[active]
                if not len(flat):
                    break
            hit = rank == low
            # A run of overlapping equal pairs (x x x) merges from the left: every other one.
            if (hit[1:] & hit[:-1]).any():
                at = np.flatnonzero(hit)
                first = np.r_[True, np.diff(at) != 1]
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - run) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            flat[at] = self.made_by_rank[rank[at]]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            flat, word = flat[stay], word[stay]
        if not done_ids:
            return np.zeros(0, np.int32), out_len
        ids, words = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=len(lengths))

    def heap(self, symbols: list[int]) -> list[int]:
        """One long word: lowest rank first, leftmost of equals, by a heap over a linked list."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        n = len(symbols)
        sym, after, before = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*p, i, sym[i], sym[i + 1]) for i in range(n - 1) if (p := self.table.get(sym[i] << 32 | sym[i + 1]))]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) >= 0 and (p := self.table.get(sym[x] << 32 | sym[y])):
                    heapq.heappush(heap, (p[0], x, p[1], sym[x], sym[y]))
        return [x for x in sym if x >= 0]


#: White space other than one space or line break between other characters; such texts take the pattern as it stands.
_ODD = re.compile(r"\s\s|[^\S \n]|\s\Z")


class ByteBPE:
    """Encoder and decoder of a byte-level vocabulary file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        chars = byte_chars()
        self.byte_ids = np.array([vocab[c] for c in chars], np.int32)
        self.merges = Merges(vocab, spec["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        value = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.findall = regex.compile(PATTERN).findall
        self.cache_words = cache_words
        #: What stands between two spaces: its ids as little-endian unsigned 32-bit integers.
        self.chunk: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens."""
        out: dict[str, bytes] = {}
        short, longer = [], []
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            (short if len(b) < LONG else longer).append((w, b))
        if short:
            flat = self.byte_ids[np.frombuffer(b"".join(b for _, b in short), np.uint8)]
            ids, lengths = self.merges.rounds(flat, np.array([len(b) for _, b in short]))
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths) * 4
            start = 0
            for (w, _), end in zip(short, ends.tolist(), strict=True):
                out[w] = raw[start:end]
                start = end
        for w, b in longer:
            out[w] = np.array(self.merges.heap(self.byte_ids[np.frombuffer(b, np.uint8)].tolist()), "<u4").tobytes()
        return out

    def _encode_words(self, lists: list[list[str]]) -> list[bytes]:
        get = self._learn(set().union(*lists)).__getitem__
        return [b"".join(map(get, x)) for x in lists]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Cut a text without odd white space at its spaces; a piece goes with the space before it.

        Pre-tokens never reach across such a cut. A line break opens a piece of its own that has no space; so does the
        start of the text, which gets one here and gives its id back in ``encode``.
        """
        return ("\n" + text).replace("\n", " \n").split(" ")[1:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[int] = []
        odd: list[int] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self._specials and self._specials.search(t):
                parts = [p for p in self._specials.split(t) if p]
                out[i] = b"".join(np.uint32(self.special[p]).astype("<u4").tobytes() if p in self.special else self.encode([p])[0] for p in parts)
            elif t[0].isspace() or _ODD.search(t):
                odd.append(i)
            else:
                plain.append(i)
        if odd:
            for i, x in zip(odd, self._encode_words([self.findall(texts[i]) for i in odd]), strict=True):
                out[i] = x
        if plain:
            cut = [self.pieces(texts[i]) for i in plain]
            missing = set().union(*cut) - self.chunk.keys()
            if missing:
                if len(self.chunk) + len(missing) > self.cache_words:
                    self.chunk.clear()
                    missing = set().union(*cut)
                missing = list(missing)
                self.chunk.update(zip(missing, self._encode_words([self.findall(p if p[0] == "\n" else " " + p) for p in missing]), strict=True))
            get = self.chunk.__getitem__
            head = len(get("\n")) if "\n" in self.chunk else len(self._encode_words([["\n"]])[0])
            for i, x in zip(plain, cut, strict=True):
                out[i] = b"".join(map(get, x))[head:]
        return out

    def count(self, texts: list[str | None]) -> list[int]:
        return [len(x) // 4 for x in self.encode(texts)]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that aren't UTF-8 become replacement characters, and ids outside the vocabulary nothing."""
        tokens, size = self.token_bytes, len(self.token_bytes)
        values = np.frombuffer(ids, "<u4")
        if len(values) and int(values.max()) >= size:
            values = values[values < size]
        return b"".join(map(tokens.__getitem__, values.tolist())).decode("utf-8", "replace")


@lru_cache(4)
def encoder(path: str) -> ByteBPE:
    """One encoder in each Python worker."""
    return ByteBPE(path)


keeps(__name__, encoder.cache_clear)


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, text: str = "text", *, path: str | None = None, output: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Append ``output``: the ids of each text as array<int>."""
    path = path or default_path()

    def make():
        model = encoder(path)

        def fn(texts: pa.Array) -> list[pa.Array]:
            found = model.encode(texts.to_pylist())
            offsets = np.r_[0, np.cumsum([len(x) // 4 for x in found])].astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))]

        return fn

    return map_text(df, make, [T.StructField(output, T.ArrayType(T.IntegerType()))], text, keep, limit=BATCH_BYTES)


def decode(df: DataFrame, ids: str = "ids", *, path: str | None = None, output: str = "text") -> DataFrame:
    """Replace the ids by the text they stand for, as ``output``; null ids give null."""
    path = path or default_path()

    def make():
        model = encoder(path)

        def fn(packed: pa.Array) -> list[pa.Array]:
            return [pa.array([None if x is None else model.decode(np.array([int(i) for i in x.split(",") if i], "<u4").tobytes()) for x in packed.to_pylist()], pa.string())]

        return fn

    packed = df.withColumn("__ids", F.array_join(F.col(ids).cast("array<string>"), ","))
    return map_text(packed, make, [T.StructField(output, T.StringType())], "__ids", [c for c in df.columns if c not in (ids, output)])


ROUND_TRIP = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def round_trip(df: DataFrame, text: str = "text", *, path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Encode and decode; append n_tokens, ids_sha256 and decoded_sha256."""
    path = path or default_path()

    def make():
        model = encoder(path)

        def fn(texts: pa.Array) -> list[pa.Array]:
            ids = model.encode(texts.to_pylist())
            return [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]

        return fn

    return map_text(df, make, ROUND_TRIP, text, keep, limit=BATCH_BYTES)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    return round_trip(table(spark, sf_dir, "documents"), keep=["doc_id"])
