"""Tables of captured packets: every file is framed and dissected in one pass, rows of all layers stand side by side.

A row is a frame: an interface, an issue, or a packet with the columns of all layers that its bytes hold. A layer that can't be
parsed names itself in ``bad``; what lies beneath it is null, what lies above stays. Keys are given while the file is read, so that
neither tables nor keys need a pass of their own: each table is a selection of columns and rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe.operators import layers as L
from binframe.operators.layers import FLAGS, PORT_DNS, PORT_TLS, dns_message  # noqa: F401
from binframe.sources.framing import COMMON, Memory, frames_of
from binframe.sources.pcap import FIELDS, MAGIC, MOST, read_capture

#: Packets to an Arrow batch.
BATCH = 32_768
BASE = [f for f in COMMON + FIELDS if f.name not in ("body", "body_offset")]


def _schema() -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import from_arrow_type, to_arrow_schema

    fields = BASE + [T.StructField(n, from_arrow_type(t)) for n, t in L.COLUMNS]
    return T.StructType(fields), to_arrow_schema(T.StructType(fields))


ROWS, ARROW = _schema()


def uint(body: Column, offset: Column | int, size: int) -> Column:
    """Big-endian unsigned number of up to seven bytes; null past the end."""
    at = (F.lit(offset) if isinstance(offset, int) else offset) + 1
    part = F.substring(body, at, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def ip4_str(b: Column) -> Column:
    return F.when(F.length(b) == 4, F.concat_ws(".", *[uint(b, k, 1).cast("string") for k in range(4)]))


@F.pandas_udf(T.StringType())
def ip6_str(b: pd.Series) -> pd.Series:
    import ipaddress

    return b.map(lambda x: str(ipaddress.IPv6Address(bytes(x))) if x is not None and len(x) == 16 else None)


def client_hello(b: bytes) -> dict | None:
    """Version and first server name of a TLS ClientHello record; None if it isn't one or can't be read."""
    try:
        if b[0] != 0x16 or b[5] != 1:
            return None
        out = {"tls_version": f"{b[9]}.{b[10]}", "sni": None, "ok": True}
        at = 43 + 1 + b[43]
        at += 2 + struct.unpack_from(">H", b, at)[0]
        at += 1 + b[at]
        if at >= len(b):
            return out
        end = at + 2 + struct.unpack_from(">H", b, at)[0]
        at += 2
        if end > len(b):
            return None
        while at + 4 <= end:
            kind, size = struct.unpack_from(">HH", b, at)
            if kind == 0 and size >= 5 and out["sni"] is None:
                n = struct.unpack_from(">H", b, at + 7)[0]
                if at + 9 + n <= end:
                    out["sni"] = b[at + 9 : at + 9 + n].decode("utf-8", "replace")
            at += 4 + size
        return out
    except (IndexError, struct.error):
        return None


def _batch(n: int, columns: dict[str, Any]) -> pa.RecordBatch:
    arrays = []
    for f in ARROW:
        x = columns.get(f.name)
        arrays.append(pa.nulls(n, f.type) if x is None else x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def _mixed(rows: list[dict[str, Any]], buf: np.ndarray, counts: dict[str, int]) -> pa.RecordBatch:
    """Frames of any kind as rows; packets' bytes lie in ``buf`` at their places in the file."""
    columns: dict[str, Any] = {f.name: pa.array([r.get(f.name) for r in rows], ARROW.field(f.name).type) for f in BASE}
    which = np.array([r["kind"] == "packet" for r in rows], bool)
    some = [r for r in rows if r["kind"] == "packet"]
    if some:
        start = np.array([r["_src_start"] + r["body_offset"] for r in some], np.int64)
        found = L.layers(buf, start, start + np.array([len(r["body"]) for r in some]), np.array([r["linktype"] for r in some]), np.zeros(len(some), np.int64), counts)
        at = pa.array(np.cumsum(which) - 1, mask=~which)
        columns |= {k: x.take(at) for k, x in found.items()}
    return _batch(len(rows), columns)


def _classic(name: str, data: Any, buf: np.ndarray, order: str, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows of a classic capture: record heads are walked one by one, all else is done for many records at once."""
    linktype = struct.unpack_from(order + "I", data, 20)[0]
    counts: dict[str, int] = {}
    head = next(iter(read_capture(Memory(bytes(data[:24])))))
    yield _mixed([{"_src_file": name, "ordinal": 0, **head}], buf, counts)
    size, at, ordinal = len(data), 24, 1
    length = struct.Struct(order + "I").unpack_from
    from binframe.sources.framing import issue

    issues: list[dict[str, Any]] = []
    places: list[int] = []

    def flush() -> pa.RecordBatch:
        nonlocal ordinal
        rec = np.array(places, np.int64)
        n = len(rec)
        sec, frac, incl, orig = np.ascontiguousarray(buf[rec[:, None] + np.arange(16)]).view(order + "u4").astype(np.int64).T
        ns = sec * 1_000_000_000 + frac * scale
        start = rec + 16
        kind = np.full(n, linktype, np.int64)
        if linktype == 101:  # raw IP names its version by the first half byte
            first = np.where(incl > 0, buf[np.minimum(start, size - 1)] >> 4, 0)
            kind = np.select([first == 4, first == 6], [L.RAW4, L.RAW6], linktype)
        columns = L.layers(buf, start, start + incl, kind, np.zeros(n, np.int64), counts)
        columns |= {"_src_file": pa.array([name] * n), "ordinal": np.arange(ordinal, ordinal + n), "kind": pa.array(["packet"] * n), "_src_start": rec, "_src_end": start + incl, "interface_id": np.ones(n, np.int64), "linktype": kind, "ts_us": ns // 1000, "ts_ns": ns, "caplen": incl, "len": orig}
        ordinal += n
        places.clear()
        return _batch(n, columns)

    while at < size:
        incl = length(data, at + 8)[0] if at + 16 <= size else size
        end = at + 16 + incl
        if end > size:
            issues.append(issue("TRUNCATED_RECORD", at, size))
            break
        if incl > MOST:
            issues.append(issue("OVERSIZED_RECORD", at, end))
        else:
            places.append(at)
            if len(places) >= BATCH:
                yield flush()
        at = end
    if places:
        yield flush()
    if issues:
        yield _mixed([{"_src_file": name, "ordinal": ordinal + k, **x} for k, x in enumerate(issues)], buf, counts)


def decode_file(name: str, data: Any) -> Iterator[pa.RecordBatch]:
    """Rows of one capture's bytes."""
    buf = np.frombuffer(data, np.uint8)
    known = MAGIC.get(int.from_bytes(bytes(data[:4]), "big")) if len(data) >= 24 else None
    if known:
        yield from _classic(name, data, buf, *known)
        return
    counts: dict[str, int] = {}
    held: list[dict[str, Any]] = []
    for row in frames_of(read_capture, Memory(bytes(data)), name):
        held.append(row)
        if len(held) >= BATCH:
            yield _mixed(held, buf, counts)
            held = []
    if held:
        yield _mixed(held, buf, counts)


def decode(files: DataFrame) -> DataFrame:
    """Rows of captures given as (name, content): framed and dissected in one pass, a file to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if data.is_valid:
                    yield from decode_file(name, memoryview(data.as_buffer()))

    return files.select("name", "content").mapInArrow(run, ROWS)


def dissect(frames: DataFrame) -> DataFrame:
    """Rows of frames that were read before; frames of a file go to one task in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, counts = None, {}
        for batch in batches:
            for file in dict.fromkeys(batch.column("_src_file").to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column("_src_file"), file))
                if file != name:
                    name, counts = file, {}
                columns: dict[str, Any] = {f.name: part.column(f.name) for f in BASE}
                which = np.array([k == "packet" for k in part.column("kind").to_pylist()], bool)
                some = part.filter(pa.array(which))
                if some.num_rows:
                    offset = some.column("_src_start").to_numpy(zero_copy_only=False) + some.column("body_offset").to_numpy(zero_copy_only=False)
                    found = L.of_frames(some.column("body"), some.column("linktype").to_numpy(zero_copy_only=False), offset, counts)
                    at = pa.array(np.cumsum(which) - 1, mask=~which)
                    columns |= {k: x.take(at) for k, x in found.items()}
                yield _batch(part.num_rows, columns)

    return frames.repartition("_src_file").sortWithinPartitions("_src_file", "ordinal").mapInArrow(run, ROWS)


def _parse(make: Any, names: list[str]) -> Any:
    def run(b: pd.Series) -> pd.DataFrame:
        none = dict.fromkeys(names) | {"ok": False}
        return pd.DataFrame([none if x is None else make(bytes(x)) or none for x in b], columns=names)

    return run


DNS = T.StructType([T.StructField("tx_id", T.IntegerType()), T.StructField("qr", T.ByteType()), T.StructField("query_name", T.StringType()), T.StructField("query_type", T.IntegerType()), T.StructField("qd_count", T.IntegerType()), T.StructField("an_count", T.IntegerType()), T.StructField("ok", T.BooleanType())])
TLS = T.StructType([T.StructField("tls_version", T.StringType()), T.StructField("sni", T.StringType()), T.StructField("ok", T.BooleanType())])


@F.pandas_udf(DNS)
def parse_dns(b: pd.Series) -> pd.DataFrame:
    return _parse(dns_message, DNS.names)(b).astype({"tx_id": "Int32", "qr": "Int8", "query_type": "Int32", "qd_count": "Int32", "an_count": "Int32", "ok": "boolean"})


@F.pandas_udf(TLS)
def parse_hello(b: pd.Series) -> pd.DataFrame:
    return _parse(client_hello, TLS.names)(b).astype({"ok": "boolean"})


def _where(start: str, end: str) -> list[Column]:
    return [F.col(start).alias("_src_start"), F.col(end).alias("_src_end"), F.col("_src_file")]


def segments(rows: DataFrame) -> DataFrame:
    """TCP segments with their payload, for reassembly."""
    return rows.where("tcp_id is not null").select("tcp_id", "packet_id", "ts_us", "src_addr", "dst_addr", "src_port", "dst_port", "seq", "ack", "flags", "window", "payload", "payload_start", *_where("l4_start", "l4_end"))


def errors(rows: DataFrame) -> DataFrame:
    """error_id, stage, record, code, message, recoverable and range: what framing reported, then what layers couldn't parse."""
    framing = rows.where("kind in ('issue', 'fatal')").select("_src_file", F.lit(0).alias("rank"), F.col("ordinal").alias("at"), "stage", F.lit(None).cast("int").alias("record"), "code", "message", "recoverable", "_src_start", "_src_end")
    layers_ = rows.where("bad is not null").select("_src_file", F.lit(1).alias("rank"), F.col("packet_id").alias("at"), F.lit("dissecting").alias("stage"), F.col("packet_id").cast("int").alias("record"), F.lit("DISSECT_PARSE_FAILED").alias("code"), F.concat("bad", F.lit(": a size runs past the captured bytes")).alias("message"), F.lit(True).alias("recoverable"), F.col("bad_start").alias("_src_start"), F.col("bad_end").alias("_src_end"))
    w = Window.partitionBy("_src_file").orderBy("rank", "at")
    return framing.unionByName(layers_).select(F.row_number().over(w).cast("long").alias("error_id"), "stage", "record", "code", "message", "recoverable", "_src_start", "_src_end", "_src_file")


def capture_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """All tables of captures, as selections of the rows of ``decode`` (or of frames, which are dissected first)."""
    if "packet_id" not in rows.columns:
        rows = dissect(rows)
    ts = F.timestamp_micros("ts_us").cast("timestamp_ntz")
    of = lambda key: rows.where(f"{key} is not null")
    pick = lambda key, *names: of(key).select(key, "packet_id", *names, *_where("l4_start", "l4_end"))
    echo = (F.col("type"), F.col("echo_id"), F.col("echo_seq"))
    return {
        "interfaces": rows.where("kind = 'interface'").select("interface_id", "section", "if_index", "linktype", "snaplen", "name", "description", "os", "comment", "ts_resolution", "ts_offset_s", "_src_start", "_src_end", "_src_file"),
        "packets": of("packet_id").select("packet_id", ts.alias("ts"), "caplen", "len", "linktype", "interface_id", "comment", "ts_ns", "_src_start", "_src_end", "_src_file"),
        "ip": of("ip_id").select("ip_id", "packet_id", "version", "src_addr", "dst_addr", "proto", "hop_limit", "length", *_where("l3_start", "l3_end")),
        "tcp": pick("tcp_id", "src_port", "dst_port", "seq", "ack", "flags", "window"),
        "udp": pick("udp_id", "src_port", "dst_port", F.col("udp_length").alias("length")),
        "icmp": pick("icmp_id", *echo),
        "icmpv6": pick("icmpv6_id", echo[0], F.col("type_code").alias("code"), *echo[1:]),
        "dns": of("dns_id").select("dns_id", "packet_id", F.lit(None).cast("long").alias("stream_id"), "tx_id", "qr", "query_name", "query_type", "qd_count", "an_count", *_where("payload_start", "dns_end")),
        "errors": errors(rows),
    }
