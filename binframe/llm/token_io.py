"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A segment holds the ids of whole documents. Its ids are ranked by frequency in a dictionary and cut into blocks of equal
length; every block starts from an empty model and can be decoded alone, and all blocks of a segment are coded in step, one
id of each at a time, as numpy vectors.

Three predictions of each id are mixed. Order 2 and order 1 name the id that last followed the last two ids and the last
one; order 0 is the distribution of the segment's ids, as rounded frequencies beside the dictionary. How much of the range
goes to the first two is learned in the block: the outcomes of each state of confidence (how often the predictions held of
late, whether they agree) and those of the block as a whole are counted, and the two estimates are averaged with weights that
follow their errors. Counts are taken over every 64 ids, more often at a block's start, as integers throughout. What is left
goes to order 0.

Segments are rows of a Parquet table (part, seg, offset, n_docs, n_ids, data), so that writing has Spark's commit protocol and
any store that Spark reaches will do. ``data`` is self-contained:

    "CMR3", then little-endian 32-bit counts: docs, ids, dictionary entries, ids to a block, bytes of the packed index
    index (zlib): document ids (int64, a null as the least), null flags (uint8), ids of each document (uint32),
                  dictionary and frequencies (uint32 each), of each block its 16-bit words and the CRC-32 of its ids (uint32 each)
    CRC-32 of the index, then the blocks' words

Null text counts as empty: just the end id. Rows with equal ids are written in the order of their texts; null ids come first.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binframe.llm._util import enter, keeps, shared_dir, slices, table
from binframe.llm.bpe import default_path

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Ids to a block and to a segment at most (a longer document makes a longer segment).
BLOCK, SEGMENT = 4096, 4 << 20
#: Contexts that a block remembers, of order 1 and of order 2.
_T1, _T2 = 512, 1024
#: Different ids of a segment at most, as a power of two; frequencies add up to a power of two up to that.
_MOST = 18
#: States of confidence, and the places of each one's outcomes: neither, order 1, order 2, both.
_STATES, _PLACES = 32, 4
#: Steps after which the shares follow what was counted: every so many, and four times in the first of them.
_WEIGH = 64
#: Outcomes that the first estimates stand for, and those after which older ones count half: of a state, of a block.
_PRIOR, _HALVE_STATE, _HALVE_BLOCK = 2, 256, 1024
#: Nothing has followed a context yet: no rank is so high.
_NONE = ((1 << 24) - 1) << 6
_U4, _U16, _U32, _U48 = (np.uint64(k) for k in (4, 16, 32, 48))
_SMALL, _LOW = np.uint64(1 << 48), np.uint64((1 << 32) - 1)


class CorruptSegment(ValueError):
    """A checksum or the layout of a segment doesn't hold."""


class _Model:
    """Predictions of B blocks, and how much of the range each gets."""

    def __init__(self, blocks: int) -> None:
        b = self.b = blocks
        row = np.arange(b, dtype=np.int64)
        # What last followed a context, above it two bits for each order: how often that held of late.
        self.after2, self.after1 = np.full(b * _T2, _NONE, np.int32), np.full(b * _T1, _NONE, np.int32)
        # Outcomes of each state and of the block (neither, order 1, order 2), in sixteenths; the errors of both.
        self.of_state = np.empty((3, b, _STATES), np.int64)
        self.of_state[:] = np.array([9, 2, 5])[:, None, None] * _PRIOR
        self.of_block = np.empty((3, b, 1), np.int64)
        self.of_block[:] = np.array([13, 1, 2])[:, None, None] * _PRIOR
        self.wrong_state, self.wrong_block = np.zeros((b, 1), np.int64), np.zeros((b, 1), np.int64)
        #: Of each outcome of each state: where its share of 65536 begins (above 32 bits) and how much it is.
        self.shares = np.empty((b, _STATES, _PLACES), np.uint64)
        self.flat = self.shares.reshape(-1)
        self.met, self.n_met, self.steps = np.empty((_WEIGH, b), np.int64), 0, 0
        self.last, self.prev = np.zeros(b, np.int32), np.zeros(b, np.int32)
        self.at1, self.at2, self.at = row * _T1, row * _T2, row * (_STATES * _PLACES)
        ints, index = (lambda: np.empty(b, np.int32)), (lambda: np.empty(b, np.int64))
        self.e1, self.e2, self.c1, self.c2, self.p1, self.p2, self.x, self.y = (ints() for _ in range(8))
        self.s1, self.s2, self.k = index(), index(), index()
        self.held = np.empty(b, bool)
        self._share()

    def _share(self) -> None:
        """Shares from the estimates: a state's and its block's are averaged with weights that follow their errors."""
        self.rate_state = (self.of_state[1:] << 16) // self.of_state.sum(0)
        self.rate_block = (self.of_block[1:] << 16) // self.of_block.sum(0)
        weight = ((self.wrong_block + 1) << 8) // (self.wrong_state + self.wrong_block + 2)
        mixed = self.rate_block + ((self.rate_state - self.rate_block) * weight >> 8)
        mixed *= 15
        mixed >>= 4
        f1, f2 = (mixed[0] + 1).view(np.uint64), (mixed[1] + 64).view(np.uint64)
        both = f1 + f2
        s = self.shares
        s[:, :, 0] = both << _U32 | np.uint64(65536) - both
        s[:, :, 1] = f2 << _U32 | f1
        s[:, :, 2] = s[:, :, 3] = f2

    def _count(self) -> None:
        """What was met since the last time goes into the estimates."""
        seen = np.bincount(self.met[: self.n_met].ravel(), minlength=self.flat.size).reshape(self.b, _STATES, _PLACES)
        self.n_met = 0
        new = np.stack([seen[:, :, 0], seen[:, :, 1], seen[:, :, 2] + seen[:, :, 3]])
        n, held = new.sum(0), new[2]
        for rate, wrong in ((self.rate_state[1], "wrong_state"), (self.rate_block[1], "wrong_block")):
            error = (held << 16) + (n - 2 * held) * rate
            old = getattr(self, wrong)
            setattr(self, wrong, old - (old >> 3) + (error.sum(1, keepdims=True) >> 8))
        new <<= 4
        self.of_state += new
        self.of_block += new.sum(2, keepdims=True)
        self.of_state >>= (self.of_state.sum(0) > _HALVE_STATE * 16).view(np.int8)
        self.of_block >>= (self.of_block.sum(0) > _HALVE_BLOCK * 16).view(np.int8)
        # An outcome that was never met keeps a trace.
        np.maximum(self.of_state, 1, out=self.of_state)
        np.maximum(self.of_block, 1, out=self.of_block)
        self._share()

    def predict(self) -> None:
        """Ranks that order 1 (p1) and order 2 (p2) name, and the place of the state's outcomes (k)."""
        x, y, e1, e2 = self.x, self.y, self.e1, self.e2
        np.bitwise_and(self.last, _T1 - 1, out=x)
        np.add(x, self.at1, out=self.s1)
        np.multiply(self.last, 2909, out=x)
        np.multiply(self.prev, 10007, out=y)
        x += y
        x &= _T2 - 1
        np.add(x, self.at2, out=self.s2)
        self.after1.take(self.s1, None, e1, "clip")
        self.after2.take(self.s2, None, e2, "clip")
        np.right_shift(e1, 6, out=self.p1)
        np.right_shift(e2, 6, out=self.p2)
        np.bitwise_and(e1, 12, out=self.c1)
        np.bitwise_and(e2, 48, out=self.c2)
        np.equal(self.p1, self.p2, out=self.held)
        np.left_shift(self.held.view(np.int8), 6, out=x, dtype=np.int32)
        x |= self.c1
        x |= self.c2
        np.add(x, self.at, out=self.k)

    def update(self, rank: np.ndarray, place: np.ndarray) -> None:
        """``place``: that of the outcome, the state's and 0 for neither, 1, 2, 3 for both."""
        x, y = self.x, self.y
        np.left_shift(rank, 6, out=y)
        for p, c, one, top, after, s in ((self.p2, self.c2, 16, 48, self.after2, self.s2), (self.p1, self.c1, 4, 12, self.after1, self.s1)):
            np.equal(p, rank, out=self.held)
            np.add(c, one, out=x)
            np.minimum(x, top, out=x)
            x *= self.held
            x |= y
            after[s] = x
        self.met[self.n_met] = place
        self.n_met += 1
        self.steps += 1
        if self.n_met == _WEIGH or (self.steps < _WEIGH and self.steps % (_WEIGH // 4) == 0):
            self._count()
        self.prev, self.last = self.last, rank


def _shares(freq: np.ndarray) -> tuple[np.ndarray, int]:
    """Frequencies rounded so that they add up to a power of two, none to nothing; and the power."""
    bits = min(_MOST, max(10, len(freq).bit_length() + 3))
    spare = (1 << bits) - len(freq)
    out = 1 + freq.astype(np.int64) * spare // max(1, int(freq.sum()))
    if len(out):
        out[0] += (1 << bits) - int(out.sum())
    return out, bits


def _order0(shares: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Where each rank's share begins and its size; behind the ranks, the whole for ids that a prediction names."""
    size = np.r_[shares, 1 << bits].astype(np.uint64)
    return np.r_[0, np.cumsum(size[:-1])[:-1], 0].astype(np.uint64) if len(shares) else np.zeros(1, np.uint64), size, np.uint64(bits)


def _encode_blocks(ranks: np.ndarray, shares: np.ndarray, bits: int) -> list[np.ndarray]:
    """16-bit words of each block of the flat ranks."""
    n, length = len(ranks), min(BLOCK, max(1, len(ranks)))
    b = -(-n // length) if n else 0
    if not b:
        return []
    tail = n - (b - 1) * length
    grid = np.zeros((b, length), np.int32)
    grid.ravel()[:n] = ranks
    grid = np.ascontiguousarray(grid.T)
    start0, size0, shift0 = _order0(shares, bits)
    nothing = len(shares)
    m = _Model(b)
    low, rng = np.zeros(b, np.uint64), np.full(b, (1 << 64) - 1, np.uint64)
    # An id takes three words at most, and the end two.
    room = 3 * length + 8
    words, pos = np.zeros(b * room, np.uint16), np.arange(b, dtype=np.int64) * room
    r, more, share, size = (np.empty(b, np.uint64) for _ in range(4))
    is1, is2, need = (np.empty(b, bool) for _ in range(3))
    place, which = np.empty(b, np.int64), np.empty(b, np.int32)
    out: list[np.ndarray] = []

    def carry(over: np.ndarray) -> None:
        at = pos[over] - 1
        while len(at):
            words[at] += 1
            at = at[words[at] == 0] - 1

    def finish(j: int) -> None:
        """Two words that lie in the block's range whatever follows them."""
        value = (int(low[j]) >> 32) + 1
        if value >> 32:
            carry(np.array([j]))
        words[pos[j] : pos[j] + 2] = (value >> 16) & 0xFFFF, value & 0xFFFF
        out.append(words[j * room : pos[j] + 2].astype("<u2"))

    for i in range(length):
        if i == tail:
            # The last block ends; what is coded behind it counts for nothing.
            finish(b - 1)
        rank = grid[i]
        m.predict()
        np.equal(m.p1, rank, out=is1)
        np.equal(m.p2, rank, out=is2)
        np.add(m.k, is1, out=place)
        place += is2
        place += is2
        m.flat.take(place, None, share, "clip")
        # Ids that a prediction names take no share of order 0.
        is1 |= is2
        np.copyto(which, rank)
        np.putmask(which, is1, nothing)
        np.right_shift(rng, _U16, out=r)
        np.right_shift(share, _U32, out=more)
        more *= r
        share &= _LOW
        r *= share
        r >>= shift0
        start0.take(which, None, size, "clip")
        size *= r
        more += size
        size0.take(which, None, size, "clip")
        np.multiply(r, size, out=rng)
        low += more
        over = np.flatnonzero(np.less(low, more, out=need))
        if len(over):
            carry(over)
        np.less(rng, _SMALL, out=need)
        np.right_shift(low, _U48, out=more)
        words[pos] = more
        pos += need
        np.multiply(need, _U16, out=more)
        low <<= more
        rng <<= more
        while len(small := np.flatnonzero(np.less(rng, _SMALL, out=need))):
            words[pos[small]] = low[small] >> _U48
            pos[small] += 1
            low[small] <<= _U16
            rng[small] <<= _U16
        m.update(rank, place)
    first = len(out)
    for j in range(b - first):
        finish(j)
    return out[first:] + out[:first]


def _decode_blocks(words: np.ndarray, lengths: np.ndarray, n: int, length: int, shares: np.ndarray, bits: int) -> np.ndarray:
    """Flat ranks of n ids from the blocks' words; the last block may have fewer ids than ``length``."""
    b = len(lengths)
    if not b:
        return np.zeros(0, np.int32)
    words = np.r_[words, np.zeros(4, np.uint16)].astype(np.uint64)
    at = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    rel = words[at] << _U48 | words[at + 1] << _U32 | words[np.minimum(at + 2, len(words) - 1)] << _U16 | words[np.minimum(at + 3, len(words) - 1)]
    at += 4
    start0, size0, shift0 = _order0(shares, bits)
    nothing = len(shares)
    by_slot = np.repeat(np.arange(len(shares), dtype=np.int32), shares)
    rng = np.full(b, (1 << 64) - 1, np.uint64)
    m = _Model(b)
    out = np.zeros((length, b), np.int32)
    most = len(words) - 1
    r, share, size, end1, end2 = (np.empty(b, np.uint64) for _ in range(5))
    in1, in2, need = (np.empty(b, bool) for _ in range(3))
    place, slot, which = np.empty(b, np.int64), np.empty(b, np.int64), np.empty(b, np.int32)

    # The last block's words end before the others'; what is read behind them counts for nothing.
    for i in range(length):
        rank = out[i]
        m.predict()
        np.right_shift(rng, _U16, out=r)
        m.flat.take(m.k, None, share, "clip")
        np.right_shift(share, _U32, out=end1)
        end1 *= r
        np.bitwise_or(m.k, 2, out=place)
        m.flat.take(place, None, end2, "clip")
        end2 *= r
        np.less(rel, end1, out=in1)
        np.less(rel, end2, out=in2)
        np.add(m.k, in1, out=place)
        place += in2
        m.flat.take(place, None, share, "clip")
        np.right_shift(share, _U32, out=size)
        size *= r
        rel -= size
        share &= _LOW
        r *= share
        r >>= shift0
        np.floor_divide(rel, r, out=size)
        by_slot.take(size.view(np.int64), None, rank, "clip")
        np.copyto(which, rank)
        np.putmask(which, in1, nothing)
        start0.take(which, None, size, "clip")
        size *= r
        rel -= size
        size0.take(which, None, size, "clip")
        np.multiply(r, size, out=rng)
        np.copyto(rank, m.p1, where=in1)
        np.copyto(rank, m.p2, where=in2)
        np.less(rng, _SMALL, out=need)
        np.multiply(need, _U16, out=size)
        rel <<= size
        rng <<= size
        words.take(at, None, size, "clip")
        size *= need
        rel |= size
        at += need
        while len(small := np.flatnonzero(np.less(rng, _SMALL, out=need))):
            rel[small] = rel[small] << _U16 | words[np.minimum(at[small], most)]
            at[small] += 1
            rng[small] <<= _U16
        m.update(rank, place)
    return np.ascontiguousarray(out.T).ravel()[:n]


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A segment of the ids of documents."""
    counts = np.array([len(x) for x in ids], "<u4")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    n = len(flat)
    freq = np.bincount(flat) if n else np.zeros(0, np.int64)
    words = np.flatnonzero(freq)
    dictionary = words[np.argsort(-freq[words], kind="stable")]
    if len(dictionary) > 1 << _MOST:
        raise ValueError(f"more than {1 << _MOST} different ids")
    rank = np.zeros(len(freq), np.int32)
    rank[dictionary] = np.arange(len(dictionary))
    shares, bits = _shares(freq[dictionary])
    blocks = _encode_blocks(rank[flat], shares, bits)
    length = min(BLOCK, max(1, n))
    crcs = [zlib.crc32(flat[k : k + length].astype("<u4").tobytes()) for k in range(0, n, length)]
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    keys = np.array([-(1 << 63) if x is None else x for x in doc_ids], "<i8")
    index = zlib.compress(b"".join([keys.tobytes(), nulls.tobytes(), counts.tobytes(), dictionary.astype("<u4").tobytes(), shares.astype("<u4").tobytes(), np.array([len(x) for x in blocks], "<u4").tobytes(), np.array(crcs, "<u4").tobytes()]), 1)
    head = b"CMR3" + struct.pack("<5I", len(doc_ids), n, len(dictionary), length, len(index))
    return b"".join([head, index, struct.pack("<I", zlib.crc32(head + index)), *(x.tobytes() for x in blocks)])


class Segment:
    """A segment's index; blocks are decoded on demand, all at once or one alone."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"CMR3" or len(data) < 28:
            raise CorruptSegment("not a segment")
        docs, self.n, size, self.length, packed = struct.unpack_from("<5I", data, 4)
        end = 24 + packed
        if len(data) < end + 4 or struct.unpack_from("<I", data, end)[0] != zlib.crc32(data[:end]):
            raise CorruptSegment("the index is damaged")
        index = zlib.decompress(data[24:end])
        blocks, at = -(-self.n // self.length), 0

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(index, dtype, count, at)
            at += x.nbytes
            return x

        keys, nulls, counts, self.dictionary, shares, lengths, self.crcs = (take(d, c) for d, c in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", size), ("<u4", size), ("<u4", blocks), ("<u4", blocks)))
        self.doc_ids = [None if z else int(x) for x, z in zip(keys, nulls, strict=True)]
        self.counts, self.shares, self.lengths = counts.astype(np.int64), shares.astype(np.int64), lengths.astype(np.int64)
        self.bits = int(self.shares.sum()).bit_length() - 1
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        if (len(data) - end - 4) // 2 < int(self.starts[-1]):
            raise CorruptSegment("blocks are missing")
        self.words = np.frombuffer(data, "<u2", int(self.starts[-1]), end + 4)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks from ``first`` to before ``last``; only these are read and checked."""
        last = len(self.lengths) if last is None else last
        n = min(self.n, last * self.length) - first * self.length
        words = self.words[self.starts[first] : self.starts[last]]
        ranks = _decode_blocks(words, self.lengths[first:last], n, self.length, self.shares, self.bits)
        # Damage can lead to a prediction where there was none.
        flat = self.dictionary[np.minimum(ranks, max(0, len(self.dictionary) - 1))] if n > 0 else np.zeros(0, np.uint32)
        for k in range(first, last):
            at = (k - first) * self.length
            if zlib.crc32(flat[at : at + self.length].astype("<u4").tobytes()) != int(self.crcs[k]):
                raise CorruptSegment(f"block {k} is damaged")
        return flat


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and the flat ids of a segment; checks every checksum."""
    s = Segment(data)
    return s.doc_ids, s.counts, s.ids()


#: Pieces that are one word for the vocabulary, and perhaps a mark behind it. Letters that lower case and NFC leave single.
_SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
#: Words kept in each worker's cache (about 40 bytes a word), and how much text is cut into pieces at once.
CACHE_WORDS, TEXT_BYTES = 800_000, 6 << 20
#: Pieces whose ids are put in place at once.
_EXPAND = 1 << 19
#: What a word of letters goes through before the library's model sees it, as far as words of other vocabularies may differ.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _ragged(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``start``, one behind the other."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return pool.take(at)


class WordEncoder:
    """Ids by the tokenizers library, which sees each different word between spaces once as long as the cache holds it.

    For vocabularies whose pre-tokens never hold white space: pieces at spaces and line breaks are then independent. Texts are
    cut and their pieces numbered by Arrow. Words of letters go to the library's model as its normalizer and pre-tokenizer
    would hand them over (upper case doesn't matter to the vocabulary, and a stop or comma is a word of its own), where the
    file has those that this holds for; everything else goes through the whole library.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cache_words = cache_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        simple = model["type"] == "BPE" and (spec["normalizer"] or {}).get("normalizers") == _NORMALIZERS and len(split) == 2
        simple = simple and split[0].get("behavior") == "Removed" and "|[\\p{L}]+|" in split[0]["pattern"].get("Regex", "")
        simple = simple and split[1].get("type") == "ByteLevel" and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        self.simple = bool(simple) and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and not any(re.match(_SIMPLE, x["content"]) for x in spec["added_tokens"])
        if self.simple:
            # A word comes here once, so that the model's own cache would only cost time.
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.model = models.BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model.get("end_of_word_suffix"))
            # The byte-level alphabet: bytes that print stand for themselves.
            prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = iter(range(256, 512))
            letters = [chr(k) if k in prints else chr(next(others)) for k in range(256)]
            self.letters = {c: "".join(letters[k] for k in chr(c).encode()) for c in range(128, 256)}
        self._keep(pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.turn = 0

    def _keep(self, words: pa.Array, start: np.ndarray, size: np.ndarray, pool: np.ndarray, used: np.ndarray) -> None:
        self.words, self.start, self.size, self.pool, self.used = words, start, size, pool, used

    def _learn(self, words: list[str], simple: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words, simple ones first, and how many each has."""
        ids: list[int] = []
        ends: list[int] = []
        other = [w for w, s in zip(words, simple, strict=True) if not s]
        if len(other) < len(words):
            tokenize = self.model.tokenize
            for w, s in zip(words, simple, strict=True):
                if s:
                    ids += [x.id for x in tokenize(w if w.isascii() else w.translate(self.letters))]
                    ends.append(len(ids))
        for k in range(0, len(other), 4096):
            for e in self.library.encode_batch_fast(other[k : k + 4096], add_special_tokens=False):
                ids += e.ids
                ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array([0, *ends], np.int64))

    def _lookup(self, words: pa.Array, simple: np.ndarray) -> np.ndarray:
        """Places in the cache of different words; those that it hasn't are learned."""
        import pyarrow.compute as pc

        self.turn += 1
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            missing = missing[np.argsort(~simple[missing], kind="stable")]
            new = words.take(pa.array(missing))
            ids, size = self._learn(new.to_pylist(), simple[missing].tolist())
            at[missing] = len(self.words) + np.arange(len(missing))
            start = len(self.pool) + np.cumsum(size) - size
            self._keep(pa.concat_arrays([self.words, new]), np.r_[self.start, start], np.r_[self.size, size], np.r_[self.pool, ids], np.r_[self.used, np.zeros(len(missing), np.int64)])
        self.used[at] = self.turn
        return at

    def _forget(self) -> None:
        """Let go of the words that were met least recently, half of what the cache may hold and more."""
        if len(self.words) > self.cache_words:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.cache_words // 2])
            size = self.size[keep]
            self._keep(self.words.take(pa.array(keep)), np.cumsum(size) - size, size, _ragged(self.pool, self.start[keep], size), self.used[keep])

    def flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts and how many each has; ``end`` goes behind each text's ids. Null counts as empty."""
        import pyarrow.compute as pc

        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        numbered = cut.flatten().cast(pa.large_string()).dictionary_encode()
        pieces = numbered.dictionary.cast(pa.string())
        # Pieces are a word and a mark, or only a word.
        simple = np.zeros(len(pieces), bool)
        if self.simple:
            simple = pc.match_substring_regex(pieces, _SIMPLE).to_numpy(zero_copy_only=False)
            lower = pc.utf8_lower(pieces)
            stop = simple & pc.ends_with(lower, ".").to_numpy(zero_copy_only=False)
            comma = simple & pc.ends_with(lower, ",").to_numpy(zero_copy_only=False)
            words = pc.if_else(pa.array(simple), pc.utf8_rtrim(lower, ".,"), pieces)
        else:
            stop = comma = simple
            words = pieces
        marks = pa.array([".", ","])
        different = pa.concat_arrays([words, marks]).dictionary_encode()
        which = different.indices.to_numpy().astype(np.int64)
        plain = np.zeros(len(different.dictionary), bool)
        plain[which[: len(pieces)][simple]] = True
        at = self._lookup(different.dictionary, plain)[which]
        mark = np.where(stop, at[-2], at[-1])
        # The ids of each piece lie together: its word's, then its mark's.
        both = np.empty((len(pieces), 2), np.int64)
        both[:, 0], both[:, 1] = at[:-2], mark
        sizes = self.size[both]
        sizes[:, 1] *= stop | comma
        pool = _ragged(self.pool, self.start[both].ravel(), sizes.ravel())
        size = sizes.sum(1)
        start = np.cumsum(size) - size
        codes = numbered.indices.to_numpy()
        if end is not None:
            start, size, pool = np.r_[start, len(pool)], np.r_[size, 1], np.r_[pool, np.uint32(end)]
        first = np.asarray(cut.offsets).astype(np.int64)
        first -= first[0]
        if end is not None:
            codes, first = np.insert(codes, first[1:], len(pieces)), first + np.arange(n + 1)
        per = size[codes]
        counts = np.diff(np.r_[0, np.cumsum(per)][first])
        out = [_ragged(pool, start[codes[k : k + _EXPAND]], per[k : k + _EXPAND]) for k in range(0, len(codes), _EXPAND)]
        self._forget()
        return np.concatenate(out), counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        flat, counts = self.flat(pa.array(texts, pa.string()))
        raw, ends = flat.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


keeps(__name__, word_encoder.cache_clear)

SEGMENTS = "part long, seg long, offset long, n_docs long, n_ids long, data binary"


def write(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", *, vocabulary: str | None = None, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encode texts and write their ids in ascending order of ``id_col`` as a table of segments at ``path``."""
    vocabulary = vocabulary or default_path(VOCABULARY)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(parts, F.col("id").asc()).sortWithinPartitions("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(__name__)
        encoder, part = word_encoder(vocabulary), TaskContext.get().partitionId()
        keys, held, size, seg, offset = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = pack(keys, held)
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (part, seg, offset, len(keys), size)), pa.array([data], pa.binary())], ["part", "seg", "offset", "n_docs", "n_ids", "data"])

        for batch in batches:
            for some in slices(batch, "text", TEXT_BYTES):
                flat, counts = encoder.flat(some.column(1), end_id)
                ends = np.cumsum(counts).tolist()
                for i, a, b in zip(some.column(0).to_pylist(), [0, *ends], ends):
                    if held and size + b - a > segment:
                        yield flush()
                        seg, offset = seg + 1, offset + size
                        keys, held, size = [], [], 0
                    keys.append(i)
                    held.append(flat[a:b])
                    size += b - a
        if held:
            yield flush()

    dealt.mapInArrow(run, SEGMENTS).write.mode("overwrite").option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, *, ids: bool = False) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, the ids of each document of a table of segments."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # One count for each part that was written, however many segments it has.
    before, total = {}, 0
    for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[r.part] = total
        total += r.n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, offset, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys, counts, flat = unpack(data)
                raw, ends = flat.astype("<u4").tobytes(), np.cumsum(counts)
                starts = ends - counts
                crcs = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(keys, pa.int64()), pa.array(starts + offset + before[part]), pa.array(counts), pa.array(crcs, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return segments.select("part", "offset", "data").mapInArrow(run, schema)


def op7_token_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to the shared folder and read back."""
    import uuid

    path = f"{shared_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
