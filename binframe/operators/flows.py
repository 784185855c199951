"""Reassembly of byte streams from segments that come late, twice, torn or in conflict, and messages framed in them."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BUFFERED = 1 << 20


@dataclass
class Assembler:
    """Bytes of one stream by absolute offset. The first bytes to arrive for an offset stay."""

    most: int = MOST_BUFFERED
    base: int | None = None
    done: int = 0  # offsets below are consumed
    pieces: list[tuple[int, bytes, int]] = field(default_factory=list)  # (offset, bytes, file position), sorted, apart
    front: bytearray = field(default_factory=bytearray)  # bytes from the consumed point on, up to the first gap
    held: int = 0  # bytes that aren't consumed
    conflicts: int = 0
    truncated: bool = False

    def _from(self, offset: int) -> int:
        """Number of the first piece that reaches beyond an offset."""
        k = bisect_right(self.pieces, offset, key=lambda x: x[0])
        return k - 1 if k and self.pieces[k - 1][0] + len(self.pieces[k - 1][1]) > offset else k

    def add(self, offset: int, data: bytes, position: int) -> str:
        """added, rebased, duplicate, conflict, dropped or truncated."""
        if self.truncated:
            return "truncated"
        if self.base is None:
            self.base = self.done = offset
        trimmed = ""
        if offset < self.done and self.done > self.base:
            cut = self.done - offset
            if cut >= len(data):
                return "dropped"
            offset, data, position, trimmed = self.done, data[cut:], position + cut, "below"
        fresh: list[tuple[int, bytes, int]] = []
        at, end, clash, k = offset, offset + len(data), False, self._from(offset)
        while k < len(self.pieces):
            o, b, _ = self.pieces[k]
            if o >= end:
                break
            e = o + len(b)
            lo, hi = max(at, o), min(end, e)
            if lo > at:
                fresh.append((at, data[at - offset : lo - offset], position + at - offset))
            clash |= data[lo - offset : hi - offset] != b[lo - o : hi - o]
            at = max(at, hi)
            k += 1
        if at < end:
            fresh.append((at, data[at - offset :], position + at - offset))
        self.conflicts += clash
        if not fresh:
            return "conflict" if clash else "duplicate"
        more = sum(len(b) for _, b, _ in fresh)
        if self.held + more > self.most:
            self.truncated = True
            return "truncated"
        self.held += more
        for x in fresh:
            insort(self.pieces, x, key=lambda y: y[0])
        if offset < self.base:
            self.base = self.done = offset
            self.front.clear()
            self._extend()
            return "rebased"
        self._extend()
        return trimmed or "added"

    def _extend(self) -> None:
        top = self.done + len(self.front)
        for k in range(self._from(top), len(self.pieces)):
            o, b, _ = self.pieces[k]
            if o > top:
                break
            self.front += b[top - o :]
            top = o + len(b)

    def ready(self) -> bytearray:
        """Bytes from the consumed point on, up to the first gap; not to be changed."""
        return self.front

    def top(self) -> int:
        """Where the last bytes that came end."""
        return max(self.done, self.pieces[-1][0] + len(self.pieces[-1][1])) if self.pieces else self.done

    def take(self, n: int) -> list[tuple[int, int]]:
        """Consume n bytes; returns the file ranges they came from, merged."""
        start, end, found = self.done, self.done + n, []
        for k in range(self._from(start), len(self.pieces)):
            o, b, p = self.pieces[k]
            lo, hi = max(o, start), min(o + len(b), end)
            if lo >= hi:
                break
            found.append((p + lo - o, p + hi - o))
        self.done = end
        self.held -= n
        del self.front[:n]
        keep = self._from(self.done - self.most)
        if keep > 64 and 2 * keep > len(self.pieces):
            del self.pieces[:keep]
        return merge(found)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with overlapping and touching ones put together, empty ones left out."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(r for r in ranges if r[0] < r[1]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def unwrap(raw: int, last: int | None, bits: int = 32) -> int:
    """Absolute offset nearest to the last one; a stream starts one period up, so that earlier bytes have room below."""
    period = 1 << bits
    if last is None:
        return raw + period
    delta = (raw - last) % period
    return last + (delta if delta < period // 2 else delta - period)


Framer = Callable[[bytes], int | None]


def length_prefixed(view: bytes) -> int | None:
    """Two bytes of length, then the message: DNS over TCP. A length of nothing is no message."""
    if len(view) < 2:
        return None
    size = int.from_bytes(view[:2], "big")
    if not size:
        raise ValueError("an empty message")
    return 2 + size


def tls_record(view: bytes) -> int | None:
    if len(view) < 5:
        return None
    size = int.from_bytes(view[3:5], "big")
    if not 0x14 <= view[0] <= 0x18 or not 1 <= size <= 18_432:
        raise ValueError("not a record")
    return 5 + size


FRAMERS: dict[str, Framer] = {"dns": length_prefixed, "tls": tls_record}


@dataclass
class Generation:
    """One connection of a stream key: its bytes, messages and state. The first one of a key is number 1."""

    number: int
    assembler: Assembler = field(default_factory=Assembler)
    first: int = 0
    opened: bool = False
    open_at: int | None = None
    close_at: int | None = None
    reset: bool = False
    last: int | None = None
    segments: list[tuple[int, int, int, int]] = field(default_factory=list)
    count: int = 0
    bytes: int = 0
    messages: int = 0
    stalled: bool = False

    def reason(self) -> str | None:
        return "rst" if self.reset else "fin" if self.close_at is not None else None

    def status(self) -> str:
        a = self.assembler
        if a.truncated:
            return "truncated"
        if self.stalled:
            return "error"
        ready = a.done + len(a.ready()) if a.base is not None else 0
        if a.top() > ready or self.close_at is not None and self.close_at > ready and a.base is not None:
            return "gap"
        return "complete"


class Stream:
    """State of one stream key: feed segments in order of arrival. Without ``keep`` no list of segments is held."""

    def __init__(self, framer: Framer | None, most: int = MOST_BUFFERED, keep: bool = True) -> None:
        self.framer, self.most, self.generations, self.keep = framer, most, [], keep

    def feed(self, packet: int, seq: int, syn: bool, fin: bool, rst: bool, data: bytes, position: int) -> Iterator[dict[str, Any]]:
        """Messages that this segment completes."""
        if not data and not (syn or fin or rst):
            return
        raw = (seq + syn) % (1 << 32)
        g = self.generations[-1] if self.generations else None
        if g is None or syn and (g.opened and g.open_at % (1 << 32) != raw or not g.opened and g.assembler.base is not None and g.assembler.base % (1 << 32) != raw):
            g = Generation(g.number + 1 if g else 1, Assembler(self.most), packet)
            self.generations.append(g)
        at = unwrap(raw, g.last)
        g.last = at
        if syn:
            g.opened, g.open_at = True, at
            if g.assembler.base is None:
                g.assembler.base = g.assembler.done = at
        g.reset |= rst
        if fin:
            g.close_at = max(at + len(data), g.close_at or 0)
        if not data:
            if self.keep:
                g.segments.append((packet, at, position, position))
            return
        outcome = g.assembler.add(at, data, position)
        g.count += 1
        if outcome == "rebased":
            g.stalled = False
        if outcome in ("added", "rebased", "below"):
            g.bytes += len(data)
            if self.keep:
                g.segments.append((packet, at, position, position + len(data)))
        while self.framer and not g.stalled:
            view = g.assembler.ready()
            try:
                n = self.framer(view)
                if n is not None and n <= 0:
                    raise ValueError("no length")
            except ValueError:
                g.stalled = True
                return
            if n is None or len(view) < n:
                return
            offset, data_ = g.assembler.done - g.assembler.base, bytes(view[:n])
            ranges = g.assembler.take(n)
            g.messages += 1
            yield {"generation": g.number, "packet_id": packet, "offset": offset, "data": data_, "ranges": ranges}


FLOW = "_src_file string, src_addr string, src_port int, dst_addr string, dst_port int, tag string, generation long, first_packet long, packet_id long, offset long, data binary, ranges array<struct<start:long,end:long>>, segment_count long, byte_count long, message_count long, pending_bytes long, status string, handshake boolean, close_reason string, conflict_count long, _src_start long, _src_end long"
KEYS = ["_src_file", "src_addr", "src_port", "dst_addr", "dst_port"]


#: Segments that belong to no stream.
NO_STREAM = "src_addr is null or dst_addr is null or src_port is null or dst_port is null or seq is null"


def stream_key() -> Column:
    """The key of a directed stream, ``source:port->destination:port``; null where a part is missing."""
    return F.concat(F.col("src_addr"), F.lit(":"), F.col("src_port").cast("string"), F.lit("->"), F.col("dst_addr"), F.lit(":"), F.col("dst_port").cast("string"))


def stream_errors(segments: DataFrame) -> DataFrame:
    """Segments that can't be fed to a stream, as error rows: without a key, or without a place in the stream."""
    code = F.when(stream_key().isNull(), "STREAM_KEY_INVALID").otherwise("STREAM_ERROR")
    return segments.where(NO_STREAM).select(F.lit("streaming").alias("stage"), F.col("packet_id").cast("int").alias("record"), code.alias("code"), F.lit("no key or no offset").alias("message"), F.lit(True).alias("recoverable"), "_src_file")


def flow_rows(segments: DataFrame, framers: dict[int, str] | None = None, most: int = MOST_BUFFERED) -> DataFrame:
    """Tagged rows (flow, segment, message) of every stream of TCP rows with payloads.

    A stream's segments come sorted to one task and are fed one by one; at most ``most`` unread bytes of it are held. framers:
    destination or source port to the name of a framer, the first that fits.
    """
    framers = framers if framers is not None else {443: "tls", 53: "dns"}
    order = ["packet_id", "seq", "flags", "payload", "payload_start"]
    rows = segments.where(f"not ({NO_STREAM})").select(*KEYS, *order)

    def finish(key: tuple, s: Stream) -> Iterator[dict[str, Any]]:
        head = dict(zip(KEYS, key, strict=True))
        for g in s.generations:
            a = g.assembler
            base = a.base if a.base is not None else g.last or 0
            spans = merge([(x, y) for _, _, x, y in g.segments if x < y])
            yield head | {"tag": "flow", "generation": g.number, "first_packet": g.first, "segment_count": g.count, "byte_count": g.bytes, "message_count": g.messages, "pending_bytes": len(a.ready()) if a.base is not None else 0, "status": g.status(), "handshake": g.opened, "close_reason": g.reason(), "conflict_count": a.conflicts, "ranges": _pieces(spans), "_src_start": spans[0][0] if spans else min((x for _, _, x, _ in g.segments), default=None), "_src_end": spans[-1][1] if spans else max((y for _, _, _, y in g.segments), default=None)}
            for packet, at, x, y in g.segments:
                yield head | {"tag": "segment", "generation": g.number, "first_packet": g.first, "packet_id": packet, "offset": at - base, "_src_start": x, "_src_end": y}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow()
        held: list[dict[str, Any]] = []
        key, stream = None, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:5] != key:
                    if stream is not None:
                        held += finish(key, stream)
                    key = r[:5]
                    name = next((n for p, n in framers.items() if p in (key[2], key[4])), None)
                    stream = Stream(FRAMERS[name] if name else None, most)
                packet, seq, flags, data, position = r[5:]
                kinds = set((flags or "").split("|"))
                for m in stream.feed(packet, seq, "SYN" in kinds, "FIN" in kinds, "RST" in kinds, data or b"", position):
                    ranges = m.pop("ranges")
                    held.append(dict(zip(KEYS, key, strict=True)) | {"tag": "message", "first_packet": stream.generations[-1].first, "ranges": _pieces(ranges), "_src_start": ranges[0][0], "_src_end": max(e for _, e in ranges)} | m)
                if len(held) > 2000:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if stream is not None:
            held += finish(key, stream)
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "packet_id").mapInArrow(run, FLOW)


def _pieces(spans: list[tuple[int, int]]) -> list[dict[str, int]] | None:
    """A list of ranges only where one range doesn't say it all."""
    return [{"start": s, "end": e} for s, e in spans] if len(spans) > 1 else None


def _arrow() -> pa.Schema:
    return pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}.get(k) or pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))) for n, k in _columns()])


def _columns() -> list[tuple[str, str]]:
    import re

    return [(m[1], m[2]) for m in re.finditer(r"(\w+) (array<[^ ]*>|\w+)(?:, |$)", FLOW)]


def streams(rows: DataFrame) -> DataFrame:
    """One row for each connection with its stream_id (1, 2, ... in each file by first packet)."""
    w = Window.partitionBy("_src_file").orderBy("first_packet", "src_addr", "src_port", "dst_addr", "dst_port", "generation")
    return rows.where("tag = 'flow'").select(F.row_number().over(w).cast("long").alias("stream_id"), *KEYS, "segment_count", "byte_count", "message_count", "pending_bytes", "status", "handshake", "close_reason", "generation", "conflict_count", "_src_start", "_src_end", F.col("ranges").alias("_src_ranges"))


def messages(rows: DataFrame) -> DataFrame:
    """Messages with their stream_id and exact byte ranges."""
    ids = streams(rows).select("stream_id", *KEYS, "generation")
    return rows.where("tag = 'message'").join(ids, [*KEYS, "generation"]).select("stream_id", "packet_id", *KEYS, "generation", "offset", "data", "_src_start", "_src_end", F.col("ranges").alias("_src_ranges"))


def message_tables(messages_: DataFrame) -> dict[str, DataFrame]:
    """dns and tls rows beneath messages; each inherits the span, the pieces, the stream and the completing packet of its message.

    What can't be parsed is in ``errors``.
    """
    from binframe.operators import dissect

    carried = ["packet_id", "stream_id"]
    where = ["_src_start", "_src_end", "_src_ranges", "_src_file"]
    of = lambda port: (F.col("src_port") == port) | (F.col("dst_port") == port)
    names = messages_.where(of(dissect.PORT_DNS) & ~of(dissect.PORT_TLS)).withColumn("m", dissect.parse_dns(F.substring(F.col("data"), 3, 1 << 20)))
    hellos = messages_.where(of(dissect.PORT_TLS) & (F.substring(F.col("data"), 1, 1) == F.lit(b"\x16")) & (F.substring(F.col("data"), 6, 1) == F.lit(b"\x01"))).withColumn("m", dissect.parse_hello("data"))
    key = lambda name: F.row_number().over(Window.partitionBy("_src_file").orderBy("packet_id", "stream_id", "offset")).cast("long").alias(name)
    bad = [m.where("not coalesce(m.ok, false)").select(F.lit("dissecting").alias("stage"), F.col("packet_id").cast("int").alias("record"), F.lit("DISSECT_PARSE_FAILED").alias("code"), F.lit(f"{kind} message").alias("message"), F.lit(True).alias("recoverable"), "_src_start", "_src_end", "_src_file") for kind, m in (("dns", names), ("tls", hellos))]
    return {
        "dns": names.where("m.ok").select(key("dns_id"), *carried, *[F.col(f"m.{c}").alias(c) for c in dissect.DNS.names if c != "ok"], *where),
        "tls": hellos.where("m.ok").select(key("tls_id"), *carried, "m.tls_version", "m.sni", *where),
        "errors": bad[0].unionByName(bad[1]),
    }


def stream_segments(rows: DataFrame) -> DataFrame:
    ids = streams(rows).select("stream_id", *KEYS, "generation")
    w = Window.partitionBy("_src_file").orderBy("packet_id", "stream_id")
    return rows.where("tag = 'segment'").join(ids, [*KEYS, "generation"]).select(F.row_number().over(w).cast("long").alias("segment_id"), "stream_id", "packet_id", "offset", "_src_start", "_src_end", "_src_file")
