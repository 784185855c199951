"""Binary formats end to end: rows of the test tables are encoded, read back by the engine, and compared with the rows."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binframe import sources
from binframe.operators import dissect, flows
from binframe.sources import encode, session

#: Rows are dealt to files: four in turn for each so many ids, so that files grow in number and not in size.
FILE_ROWS = 16_384
#: Bytes of a turn to a message at most; a longer turn is several messages.
MESSAGE = 65_000
#: Where encoded rows stand instead of files: (name, content) tables that readers take like files.
Encoded = DataFrame


def _file(key: str) -> Column:
    return F.expr(f"({key} div {FILE_ROWS}) * 4 + {key} % 4")


def encoded(df: DataFrame, file: str, order: list[str], make: Callable[[list[dict]], bytes]) -> Encoded:
    """One file for each value of the column ``file``, its rows in the given order."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: tuple(r[c] for c in order))
        return pa.table({"name": [str(key[0].as_py())], "content": pa.array([make(rows)], pa.binary())})

    return df.groupBy(file).applyInArrow(run, "name string, content binary")


def frames_of(files: Encoded, name: str) -> DataFrame:
    """Frames of encoded files, by the reader of the named format."""
    return sources.frames_of_files(files, next(f for f in sources.FORMATS if f.name == name))


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows as Parquet in the shared folder, decoded once for all tables that are made of them."""
    path = f"{session.shared_root(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _number(column: str = "_src_file") -> Column:
    return F.col(column).cast("long").alias("file")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", us.alias("us"), _file("event_id").alias("file"))


def _ip(user: int) -> str:
    return f"10.{user >> 16 & 255}.{user >> 8 & 255}.{user & 255}"


def _captured(spark: SparkSession, sf_dir: str, packet: Callable[[dict], bytes], linktype: int = 1, cut: int = 0) -> DataFrame:
    """Rows of captures with one packet for each event; ``cut`` bytes are missing at the end of each."""

    def make(rows: list[dict]) -> bytes:
        data = encode.pcap([(r["us"] * 1000, packet(r)) for r in rows], linktype=linktype, nano=True)
        return data[: len(data) - cut]

    return dissect.decode(encoded(_events(spark, sf_dir), "file", ["us", "event_id"], make))


def _dns_packet(r: dict) -> bytes:
    name = f"{r['event_type'].replace('_', '-')}.n{r['event_id']}.example"
    udp = encode.udp(encode.dns(r["event_id"] & 0xFFFF, name), 40_000, 53)
    if r["event_id"] % 5 == 4:
        v6 = bytes(12) + int(r["user_id"]).to_bytes(4, "big")
        return encode.ethernet(encode.ipv6(udp, 17, v6, v6), 0x86DD)
    return encode.ethernet(encode.ipv4(udp, 17, _ip(r["user_id"]), "10.0.0.53"), vlan=7 if r["event_id"] % 5 == 3 else None)


def _ng(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda rows: encode.pcapng([(r["event_id"] % 2, r["us"], _dns_packet(r)) for r in rows], [(1, "eth0"), (1, "eth1")], ">")
    return dissect.decode(encoded(_events(spark, sf_dir), "file", ["us", "event_id"], make))


def pcap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = dissect.capture_tables(_stored(spark, _captured(spark, sf_dir, _dns_packet)))
    packets = t["packets"].select("packet_id", "_src_file", "ts")
    return t["dns"].join(packets, ["packet_id", "_src_file"]).select("packet_id", _number(), "ts", "tx_id", "query_name", F.col("query_type").cast("int").alias("query_type"))


def pcapng_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = dissect.capture_tables(_stored(spark, _ng(spark, sf_dir)))
    names = t["interfaces"].select("interface_id", "_src_file", "name")
    return t["packets"].join(names, ["interface_id", "_src_file"]).select("packet_id", _number(), "name", "ts", "caplen")


def pcap_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = dissect.capture_tables(_ng(spark, sf_dir))["interfaces"]
    return i.select(_number(), "interface_id", "section", "if_index", "linktype", "name", "ts_resolution")


def dissect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = dissect.capture_tables(_captured(spark, sf_dir, _dns_packet))
    return t["ip"].select("ip_id", "packet_id", _number(), F.col("version").cast("int").alias("version"), F.col("proto").cast("int").alias("proto"), F.when(F.col("version") == 4, F.col("src_addr")).alias("src4"), "length", (F.col("_src_end") - F.col("_src_start")).alias("size"))


def scan_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = dissect.capture_tables(_captured(spark, sf_dir, _dns_packet))
    return t["packets"].where("caplen > 80").select("ts", "caplen", "len")


def parquet_scan_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _stored(spark, dissect.capture_tables(_captured(spark, sf_dir, _dns_packet))["packets"])
    return session.parquet_scan(spark, sorted(stored.inputFiles())).where("caplen > 80").select("ts", "caplen", "len")


def files_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = encoded(_events(spark, sf_dir), "file", ["us", "event_id"], lambda rows: encode.pcap([(r["us"], b"") for r in rows]))
    other = spark.createDataFrame([("a.txt", b"text"), ("z.zip", encode.zip_stored([("a", b"b")])), ("0", encode.smf([[]]))], "name string, content binary")
    heads = captures.union(other).select("name", F.substring("content", 1, sources.HEAD).alias("head"), F.length("content").alias("size"))
    # A line for each file, as the catalog has one. Captures come before what is named like one of them.
    found = sorted(((r.name, bytes(r["head"]), r["size"]) for r in heads.collect()), key=lambda r: (r[0], -r[2]))
    plan = spark.createDataFrame([tuple(p.values()) for p in sources.plan_batch(found)], sources.FILES)
    return plan.select("file", "original_name", "ingest_order", "status", "error")


def errors_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lambda r: _dns_packet(r)[: -2 if r["event_id"] % 7 == 0 else None]
    e = dissect.capture_tables(_captured(spark, sf_dir, cut, cut=3))["errors"]
    return e.select(_number(), "error_id", "stage", "record", "code", "recoverable")


def _broken(r: dict) -> bytes:
    """A packet of which one layer can't be parsed, by the event's number."""
    dns, kind = encode.dns(r["event_id"] & 0xFFFF, "a.example"), r["event_id"] % 6
    proto, l4 = {0: (17, encode.udp(dns, 9, 53)), 1: (6, bytearray(encode.tcp(b"abc", 1, 2, 3))), 2: (17, bytearray(encode.udp(dns, 9, 53))), 3: (1, b"\x08\0"), 4: (17, encode.udp(dns[:-1], 9, 53)), 5: (17, encode.udp(dns, 9, 53))}[kind]
    if kind == 1:
        l4[12] = 4 << 4
    if kind == 2:
        l4[4:6] = b"\0\4"
    packet = encode.ethernet(encode.ipv4(bytes(l4), proto, _ip(r["user_id"]), "10.0.0.53"))
    return packet[:-1] if kind == 0 else packet


def dissect_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dissect.capture_tables(_captured(spark, sf_dir, _broken))["errors"]
    return e.select(_number(), "error_id", "record", "code", F.substring_index("message", ":", 1).alias("layer"), (F.col("_src_end") - F.col("_src_start")).alias("size"))


def dissect_sll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both cooked link layers, over IPv4, IPv6 and a protocol that isn't dissected."""

    def packet(two: bool) -> Callable[[dict], bytes]:
        def make(r: dict) -> bytes:
            udp = encode.udp(b"xy", 9, 10)
            kind, body = {0: (0x0800, encode.ipv4(udp, 17, _ip(r["user_id"]), "10.0.0.1")), 1: (0x86DD, encode.ipv6(udp, 17, bytes(16), bytes(16))), 2: (0x0806, bytes(28))}[r["event_id"] % 3]
            return (struct.pack(">HHIHBB8x", kind, 0, 1, 1, 0, 6) if two else struct.pack(">HHH8xH", 0, 1, 6, kind)) + body

        return make

    out = None
    for linktype, two in ((113, False), (276, True)):
        t = dissect.capture_tables(_stored(spark, _captured(spark, sf_dir, packet(two), linktype)))
        ip = t["ip"].select("packet_id", "_src_file", F.col("version").cast("int").alias("version"), (F.col("_src_end") - F.col("_src_start")).alias("size"))
        rows = t["packets"].join(ip, ["packet_id", "_src_file"], "left").select(_number(), "packet_id", "linktype", "version", "size")
        out = rows if out is None else out.unionByName(rows)
    return out


def dissect_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    def packet(r: dict) -> bytes:
        src = bytes.fromhex("20010db8000000010001ffff") + struct.pack(">HH", 1 + (r["user_id"] >> 16), 1 + r["user_id"] % 65_535)
        return encode.ethernet(encode.ipv6(encode.udp(bytes(r["event_id"] % 9), 9, 10), 17, src, bytes(15) + b"\1", hops=r["event_id"] % 256), 0x86DD)

    ip = dissect.capture_tables(_captured(spark, sf_dir, packet))["ip"]
    return ip.select(_number(), "packet_id", "src_addr", "dst_addr", F.col("hop_limit").cast("int").alias("hop_limit"), "length")


def dissect_icmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    def packet(r: dict) -> bytes:
        six, kind = r["event_id"] % 2, r["event_id"] // 2 % 3
        body = struct.pack(">BBHHH", ((8, 0, 3), (128, 129, 135))[six][kind], 0, 0, r["event_id"] & 0xFFFF, r["user_id"] & 0xFFFF)
        return encode.ethernet(encode.ipv6(body, 58, bytes(16), bytes(16)), 0x86DD) if six else encode.ethernet(encode.ipv4(body, 1, _ip(r["user_id"]), "10.0.0.1"))

    t = dissect.capture_tables(_stored(spark, _captured(spark, sf_dir, packet)))
    both = [t[k].select(_number(), F.lit(k).alias("protocol"), F.col(f"{k}_id").alias("id"), "packet_id", F.col("type").cast("int").alias("type"), "echo_id", "echo_seq") for k in ("icmp", "icmpv6")]
    return both[0].unionByName(both[1])


def tcp_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    def packet(r: dict) -> bytes:
        l4 = bytearray(encode.tcp(b"", 1 + r["event_id"] % 60_000, 80, r["event_id"], ack=7))
        l4[13] = r["event_id"] % 256
        return encode.ethernet(encode.ipv4(bytes(l4), 6, _ip(r["user_id"]), "10.0.0.1"))

    t = dissect.capture_tables(_captured(spark, sf_dir, packet))["tcp"]
    return t.select(_number(), "tcp_id", "src_port", "seq", "ack", "flags", "window")


def dns_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, answers, a name that is a pointer, and an operation whose questions aren't read."""

    def packet(r: dict) -> bytes:
        i = r["event_id"]
        m = encode.dns(i & 0xFFFF, f"{r['event_type'].replace('_', '-')}.u{r['user_id']}", 1 + i % 50, response=i % 2 == 1)
        if i % 11 == 0:
            m = m[:12] + b"\xc0\x0c" + m[-4:]
        if i % 13 == 0:
            m = m[:2] + bytes([m[2] & 0x87 | 3 << 3]) + m[3:]
        return encode.ethernet(encode.ipv4(encode.udp(m, 53, 40_000), 17, "10.0.0.53", _ip(r["user_id"])))

    t = dissect.capture_tables(_captured(spark, sf_dir, packet))["dns"]
    return t.select(_number(), "dns_id", "tx_id", F.col("qr").cast("int").alias("qr"), "query_name", "query_type", "qd_count")


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text", _file("conv_id").alias("file"))


class _Wire:
    """Packets of one capture, of connections that are told apart by their conversation."""

    def __init__(self, port: int) -> None:
        self.port, self.packets, self.seqs = port, [], {}

    def send(self, c: int, data: bytes, seq: int, flags: str = "ACK") -> None:
        tcp = encode.tcp(data, 1024 + (c >> 24), self.port, seq, flags)
        self.packets.append((len(self.packets) * 1_000_000, encode.ethernet(encode.ipv4(tcp, 6, _ip(c), "10.0.0.53"))))

    def open(self, c: int, seq: int) -> None:
        self.send(c, b"", seq, "SYN")
        self.seqs[c] = seq + 1

    def torn(self, c: int, data: bytes) -> None:
        """In three pieces, the last one first, the first one twice."""
        a, b, s = len(data) // 3, 2 * len(data) // 3, self.seqs[c]
        for x, y in ((b, len(data)), (0, a), (0, a), (a, b)):
            self.send(c, data[x:y], s + x)
        self.seqs[c] = s + len(data)

    def close(self, c: int) -> None:
        self.send(c, b"", self.seqs[c], "FIN|ACK")


def _conv(address: str = "src_addr", port: str = "src_port") -> Column:
    """The conversation that an address and a port stand for."""
    return F.expr(f"cast(split({address}, '[.]')[1] as long) * 65536 + cast(split({address}, '[.]')[2] as long) * 256 + cast(split({address}, '[.]')[3] as long) + ({port} - 1024) * 16777216L").alias("conv_id")


def _fed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as length-prefixed messages, torn, late and twice; sequence numbers wrap soon."""

    def make(rows: list[dict]) -> bytes:
        wire = _Wire(53)
        for r in rows:
            c, body = r["conv_id"], (r["text"] or "").encode()
            if c not in wire.seqs:
                wire.open(c, (1 << 32) - 40)
            for k in range(0, len(body), MESSAGE):
                part = body[k : k + MESSAGE]
                wire.torn(c, len(part).to_bytes(2, "big") + part)
        for c in wire.seqs:
            wire.close(c)
        return encode.pcap(wire.packets)

    rows = dissect.decode(encoded(_conversations(spark, sf_dir), "file", ["conv_id", "turn"], make))
    return _stored(spark, flows.flow_rows(dissect.segments(rows)))


def tcp_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = flows.messages(_fed(spark, sf_dir))
    return m.select(_conv(), F.length("data").cast("long").alias("n_bytes"), F.md5(F.substring(F.col("data"), 3, 1 << 20)).alias("digest"))


def tcp_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their offsets, and the bytes that their ranges cover."""
    m = flows.messages(_fed(spark, sf_dir))
    covered = F.expr("if(_src_ranges is null, _src_end - _src_start, aggregate(_src_ranges, 0L, (s, r) -> s + r.end - r.start))")
    return m.select(_conv(), "offset", F.length("data").cast("long").alias("n_bytes"), covered.alias("covered"), F.coalesce(F.size("_src_ranges"), F.lit(1)).alias("pieces"))


def tcp_wraparound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each connection's offsets go past the point where its numbers start anew."""
    s = flows.stream_segments(_fed(spark, sf_dir)).groupBy("_src_file", "stream_id").agg(F.max("offset").alias("last"), F.min("offset").alias("first"))
    return s.select(_number(), "stream_id", "first", "last", (F.col("last") > 39).alias("wrapped"))


def tcp_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = flows.streams(_fed(spark, sf_dir))
    return s.select(_conv(), "stream_id", "message_count", "byte_count", "status", "handshake", "close_reason", "pending_bytes")


def tcp_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = _fed(spark, sf_dir)
    ids = flows.streams(fed).select("stream_id", "_src_file", _conv())
    return flows.stream_segments(fed).join(ids, ["stream_id", "_src_file"]).select("conv_id", "offset", (F.col("_src_end") - F.col("_src_start")).alias("size"))


def flow_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(rows: list[dict]) -> bytes:
        wire = _Wire(53)
        for r in rows:
            wire.send(r["conv_id"], b"x" * (1 + r["turn"]), 1)
        return encode.pcap(wire.packets)

    rows = dissect.segments(dissect.decode(encoded(_conversations(spark, sf_dir), "file", ["conv_id", "turn"], make)))
    return rows.groupBy(flows.stream_key().alias("key")).agg(F.count("*").alias("segments"), F.sum(F.length("payload")).alias("bytes"))


def tcp_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn has a connection of its own between the same ends, ended in two ways."""

    def make(rows: list[dict]) -> bytes:
        wire = _Wire(9)
        for r in rows:
            c = r["conv_id"]
            wire.open(c, 1000 * (r["turn"] + 1))
            wire.send(c, b"x" * (1 + r["turn"]), wire.seqs[c])
            wire.seqs[c] += 1 + r["turn"]
            if r["turn"] % 2:
                wire.send(c, b"", wire.seqs[c], "RST")
            else:
                wire.close(c)
        return encode.pcap(wire.packets)

    s = flows.streams(flows.flow_rows(dissect.segments(dissect.decode(encoded(_conversations(spark, sf_dir), "file", ["conv_id", "turn"], make)))))
    return s.select(_conv(), "generation", "byte_count", "handshake", "close_reason", "status")


def _beneath(spark: SparkSession, sf_dir: str, port: int, message: Callable[[dict], bytes]) -> dict[str, DataFrame]:
    def make(rows: list[dict]) -> bytes:
        wire = _Wire(port)
        for r in rows:
            if r["conv_id"] not in wire.seqs:
                wire.open(r["conv_id"], 7)
            wire.torn(r["conv_id"], message(r))
        return encode.pcap(wire.packets)

    rows = dissect.decode(encoded(_conversations(spark, sf_dir), "file", ["conv_id", "turn"], make))
    return flows.message_tables(flows.messages(_stored(spark, flows.flow_rows(dissect.segments(rows)))))


def dns_tcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    def message(r: dict) -> bytes:
        m = encode.dns(r["turn"] & 0xFFFF, f"c{r['conv_id']}.t{r['turn']}", 28)
        return len(m).to_bytes(2, "big") + m

    t = _beneath(spark, sf_dir, 53, message)["dns"]
    return t.select(_number(), "dns_id", "tx_id", "query_name", "query_type", F.size("_src_ranges").alias("pieces"))


def tls_sni(spark: SparkSession, sf_dir: str) -> DataFrame:
    hello = lambda r: encode.client_hello(f"c{r['conv_id']}.t{r['turn']}.example", (3, 1 + r["turn"] % 3))
    t = _beneath(spark, sf_dir, 443, hello)["tls"]
    return t.select(_number(), "tls_id", "sni", "tls_version", F.size("_src_ranges").alias("pieces"))


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("file", F.col("user_id"))

    def make(rows: list[dict]) -> bytes:
        events, before, user = [], 0, rows[0]["user_id"]
        for k, r in enumerate(rows):
            tick = (r["us"] - rows[0]["us"]) // 10_000_000
            note = r["event_id"] % 128
            events.append((tick - before, bytes([0x90, note, 64]) if k == 0 else bytes([note, 64])))  # running status
            before = tick
        tempo = lambda us: b"\xff\x51\x03" + us.to_bytes(3, "big")
        return encode.smf([[(0, tempo(400_000 + user % 1000)), (480, tempo(500_000 + len(rows) % 1000))], [*events, (0, b"\xff\x2f\0")]])

    return frames_of(encoded(rows, "file", ["us", "event_id"], make), "midi")


def midi_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = session.frame_tables(_songs(spark, sf_dir), "midi")["events"].where("event = 'note_on'")
    return e.select(F.col("_src_file").cast("long").alias("user_id"), "event_id", "event_index", "tick", F.col("note").cast("int").alias("note"))


def midi_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = session.frame_tables(_songs(spark, sf_dir), "midi")["tempo"]
    return t.select(F.col("_src_file").cast("long").alias("user_id"), "tempo_id", "tick", "us_per_quarter")


def zip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", _file("doc_id").alias("file"))
    make = lambda rows: encode.zip_stored([(f"d/{r['doc_id']}.txt", (r["text"] or "").encode()) for r in rows])
    f = frames_of(encoded(docs, "file", ["doc_id"], make), "zip")
    both = f.where("kind = 'local_file'").alias("l").join(f.where("kind = 'central_dir_entry'").alias("c"), ["_src_file", "file_name"])
    return both.select("file_name", F.col("l.uncompressed_size").alias("n_bytes"), F.col("l.compression").alias("compression"), (F.col("l._src_start") == F.col("c.ofs_local_header")).alias("linked"))


def _at(key: str) -> str:
    return f"({key} // {FILE_ROWS}) * 4 + {key} % 4"


_NAME = "replace(event_type, '_', '-') || '.n' || event_id || '.example'"
#: Events with the file and the place that their packet has in it.
_P = f"p AS (SELECT *, {_at('event_id')} AS file, row_number() OVER (PARTITION BY {_at('event_id')} ORDER BY ts, event_id) AS id, count(*) OVER (PARTITION BY {_at('event_id')}) AS many FROM events) "
#: Messages of conversations: length without the prefix, bytes in hex, offset.
_M = f"""t AS (SELECT conv_id, turn, encode(coalesce(text, '')) AS b FROM conversations),
    m AS (SELECT conv_id, turn, k, least({MESSAGE}, octet_length(b) - {MESSAGE} * k) AS n, substr(hex(b), {2 * MESSAGE} * k + 1, {2 * MESSAGE}) AS h FROM (SELECT *, unnest(range(0, (octet_length(b) + {MESSAGE - 1}) // {MESSAGE})) AS k FROM t)),
    o AS (SELECT *, n + 2 AS len, CAST(coalesce(sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM m),
    c AS (SELECT conv_id, count(off) AS messages, CAST(coalesce(sum(len), 0) AS BIGINT) AS total, {_at('conv_id')} AS file FROM (SELECT DISTINCT conv_id FROM t) LEFT JOIN o USING (conv_id) GROUP BY conv_id),
    s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY conv_id) AS stream_id FROM c) """
_KEY = "'10.' || (conv_id // 65536 % 256) || '.' || (conv_id // 256 % 256) || '.' || (conv_id % 256) || ':' || (1024 + conv_id // 16777216) || '->10.0.0.53:53'"
_FLAGS = ", ".join(f"CASE WHEN (event_id % 256) & {1 << k} <> 0 THEN '{n}' END" for k, n in enumerate(dissect.FLAGS))
_LEN = f"CAST(14 + CASE event_id % 5 WHEN 4 THEN 40 WHEN 3 THEN 24 ELSE 20 END + 26 + length({_NAME}) AS BIGINT)"
_SCAN = f"SELECT CAST(ts AS TIMESTAMP) AS ts, n AS caplen, n AS len FROM (SELECT ts, {_LEN} AS n FROM events) x WHERE n > 80"
QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "pcap_roundtrip": (pcap_roundtrip, f"WITH {_P} SELECT id AS packet_id, file, CAST(ts AS TIMESTAMP) AS ts, CAST(event_id & 65535 AS INTEGER) AS tx_id, {_NAME} AS query_name, 1 AS query_type FROM p"),
    "pcapng_roundtrip": (pcapng_roundtrip, f"WITH {_P} SELECT id AS packet_id, file, 'eth' || (event_id % 2) AS name, CAST(ts AS TIMESTAMP) AS ts, {_LEN} AS caplen FROM p"),
    "pcap_interfaces": (pcap_interfaces, f"SELECT file, CAST(i + 1 AS BIGINT) AS interface_id, CAST(0 AS BIGINT) AS section, CAST(i AS BIGINT) AS if_index, CAST(1 AS BIGINT) AS linktype, 'eth' || i AS name, '10^-6' AS ts_resolution FROM (SELECT DISTINCT {_at('event_id')} AS file FROM events) f, range(2) r(i)"),
    "dissect_chain": (dissect_chain, f"WITH {_P}, q AS (SELECT *, CAST(CASE WHEN event_id % 5 = 4 THEN 40 ELSE 20 END + 26 + length({_NAME}) AS BIGINT) AS n FROM p) SELECT id AS ip_id, id AS packet_id, file, CASE WHEN event_id % 5 = 4 THEN 6 ELSE 4 END AS version, 17 AS proto, CASE WHEN event_id % 5 <> 4 THEN '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) END AS src4, n AS length, n AS size FROM q"),
    "scan_packets": (scan_packets, _SCAN),
    "parquet_scan_pushdown": (parquet_scan_pushdown, _SCAN),
    "files_catalog": (files_catalog, f"WITH f AS (SELECT DISTINCT CAST({_at('event_id')} AS VARCHAR) AS name, 0 AS kind FROM events UNION ALL SELECT * FROM (VALUES ('0', 1), ('a.txt', 2), ('z.zip', 3)) v) SELECT name || CASE WHEN kind = 1 THEN ' (2)' ELSE '' END AS file, name AS original_name, CAST(row_number() OVER (ORDER BY name, kind) - 1 AS INTEGER) AS ingest_order, CASE WHEN kind = 0 THEN 'ok' ELSE 'skipped' END AS status, CASE kind WHEN 1 THEN 'is midi, not capture' WHEN 2 THEN 'format not recognized' WHEN 3 THEN 'is zip, not capture' END AS error FROM f"),
    "errors_table": (errors_table, f"WITH {_P} SELECT file, CAST(1 AS BIGINT) AS error_id, 'framing' AS stage, CAST(NULL AS INTEGER) AS record, 'TRUNCATED_RECORD' AS code, true AS recoverable FROM p WHERE id = many UNION ALL SELECT file, 1 + row_number() OVER (PARTITION BY file ORDER BY id), 'dissecting', CAST(id AS INTEGER), 'DISSECT_PARSE_FAILED', true FROM p WHERE event_id % 7 = 0 AND id < many"),
    "dissect_errors": (dissect_errors, f"WITH {_P} SELECT file, row_number() OVER (PARTITION BY file ORDER BY id) AS error_id, CAST(id AS INTEGER) AS record, 'DISSECT_PARSE_FAILED' AS code, CASE event_id % 6 WHEN 0 THEN 'ip' WHEN 1 THEN 'tcp' WHEN 2 THEN 'udp' WHEN 3 THEN 'icmp' ELSE 'dns' END AS layer, CAST(CASE event_id % 6 WHEN 0 THEN 54 WHEN 1 THEN 23 WHEN 2 THEN 35 WHEN 3 THEN 2 ELSE 26 END AS BIGINT) AS size FROM p WHERE event_id % 6 < 5"),
    "dissect_sll": (dissect_sll, f"WITH {_P} SELECT file, id AS packet_id, CAST(l AS BIGINT) AS linktype, CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 END AS version, CAST(CASE event_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 50 END AS BIGINT) AS size FROM p, (VALUES (113), (276)) v(l)"),
    "dissect_ipv6": (dissect_ipv6, f"WITH {_P} SELECT file, id AS packet_id, '2001:db8:0:1:1:ffff:' || format('{{:x}}', 1 + user_id // 65536) || ':' || format('{{:x}}', 1 + user_id % 65535) AS src_addr, '::1' AS dst_addr, CAST(event_id % 256 AS INTEGER) AS hop_limit, 48 + event_id % 9 AS length FROM p"),
    "dissect_icmp": (dissect_icmp, f"WITH {_P}, q AS (SELECT *, event_id % 2 = 1 AS six, event_id // 2 % 3 AS kind FROM p) SELECT file, CASE WHEN six THEN 'icmpv6' ELSE 'icmp' END AS protocol, row_number() OVER (PARTITION BY file, six ORDER BY id) AS id, id AS packet_id, CAST(CASE WHEN six THEN CASE kind WHEN 0 THEN 128 WHEN 1 THEN 129 ELSE 135 END ELSE CASE kind WHEN 0 THEN 8 WHEN 1 THEN 0 ELSE 3 END END AS INTEGER) AS type, CASE WHEN kind < 2 THEN CAST(event_id & 65535 AS INTEGER) END AS echo_id, CASE WHEN kind < 2 THEN CAST(user_id & 65535 AS INTEGER) END AS echo_seq FROM q"),
    "tcp_flags": (tcp_flags, f"WITH {_P} SELECT file, id AS tcp_id, CAST(1 + event_id % 60000 AS INTEGER) AS src_port, event_id AS seq, CAST(7 AS BIGINT) AS ack, concat_ws('|', {_FLAGS}) AS flags, 1024 AS window FROM p"),
    "dns_names": (dns_names, f"WITH {_P} SELECT file, id AS dns_id, CAST(event_id & 65535 AS INTEGER) AS tx_id, CAST(event_id % 2 AS INTEGER) AS qr, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN replace(event_type, '_', '-') || '.u' || user_id END AS query_name, CASE WHEN event_id % 13 <> 0 THEN CAST(1 + event_id % 50 AS INTEGER) END AS query_type, CASE WHEN event_id % 13 = 0 THEN 0 ELSE 1 END AS qd_count FROM p"),
    "tcp_reassembly": (tcp_reassembly, f"WITH {_M} SELECT conv_id, len AS n_bytes, md5(unhex(h)) AS digest FROM o"),
    "tcp_messages": (tcp_messages, f"WITH {_M} SELECT conv_id, off AS \"offset\", len AS n_bytes, len AS covered, 3 AS pieces FROM o"),
    "tcp_wraparound": (tcp_wraparound, f"WITH {_M} SELECT file, stream_id, CAST(0 AS BIGINT) AS first, total AS last, total > 39 AS wrapped FROM s"),
    "tcp_flows": (tcp_flows, f"WITH {_M} SELECT conv_id, stream_id, messages AS message_count, total AS byte_count, 'complete' AS status, true AS handshake, 'fin' AS close_reason, CAST(0 AS BIGINT) AS pending_bytes FROM s"),
    "tcp_segments": (tcp_segments, f"WITH {_M} SELECT conv_id, off + x AS \"offset\", y - x AS size FROM (SELECT conv_id, off, unnest([{{'x': 2 * len // 3, 'y': len}}, {{'x': CAST(0 AS BIGINT), 'y': len // 3}}, {{'x': len // 3, 'y': 2 * len // 3}}], recursive := true) FROM o) z UNION ALL SELECT conv_id, 0, 0 FROM s UNION ALL SELECT conv_id, total, 0 FROM s"),
    "flow_key": (flow_key, f"SELECT {_KEY} AS key, count(*) AS segments, CAST(sum(1 + turn) AS BIGINT) AS bytes FROM conversations GROUP BY 1"),
    "tcp_generations": (tcp_generations, "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS generation, 1 + turn AS byte_count, true AS handshake, CASE WHEN turn % 2 = 1 THEN 'rst' ELSE 'fin' END AS close_reason, 'complete' AS status FROM conversations"),
    "dns_tcp": (dns_tcp, f"SELECT {_at('conv_id')} AS file, row_number() OVER (PARTITION BY {_at('conv_id')} ORDER BY conv_id, turn) AS dns_id, CAST(turn & 65535 AS INTEGER) AS tx_id, 'c' || conv_id || '.t' || turn AS query_name, 28 AS query_type, 3 AS pieces FROM conversations"),
    "tls_sni": (tls_sni, f"SELECT {_at('conv_id')} AS file, row_number() OVER (PARTITION BY {_at('conv_id')} ORDER BY conv_id, turn) AS tls_id, 'c' || conv_id || '.t' || turn || '.example' AS sni, '3.' || (1 + turn % 3) AS tls_version, 3 AS pieces FROM conversations"),
    "midi_roundtrip": (midi_roundtrip, "SELECT user_id, row_number() OVER w AS event_id, row_number() OVER w - 1 AS event_index, CAST((epoch_us(ts) - first_value(epoch_us(ts)) OVER w) // 10000000 AS BIGINT) AS tick, CAST(event_id % 128 AS INTEGER) AS note FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "midi_tempo": (midi_tempo, "SELECT user_id, CAST(i + 1 AS BIGINT) AS tempo_id, CAST(480 * i AS BIGINT) AS tick, CAST(CASE i WHEN 0 THEN 400000 + user_id % 1000 ELSE 500000 + n % 1000 END AS BIGINT) AS us_per_quarter FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u, range(2) r(i)"),
    "zip_roundtrip": (zip_roundtrip, "SELECT 'd/' || doc_id || '.txt' AS file_name, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, 'stored' AS compression, true AS linked FROM documents"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in QUERIES.items()}
