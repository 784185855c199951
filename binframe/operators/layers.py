"""Protocol layers of many packets at once: header fields are gathered from one buffer with numpy, not parsed packet by packet."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Link types, protocol numbers of the network and transport layers, ports.
ETHERNET, SLL, SLL2, RAW4, RAW6 = 1, 113, 276, 228, 229
IP4, IP6, VLAN = 0x0800, 0x86DD, 0x8100
ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58
PORT_DNS, PORT_TLS = 53, 443
FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")
FLAG_TEXT = np.array(["|".join(n for k, n in enumerate(FLAGS) if v >> k & 1) for v in range(256)], object)


def dns_message(b: bytes) -> dict | None:
    """Head and first question of a message; None if any part of it can't be read."""
    try:
        tx, flags, qd, an, ns, ar = struct.unpack_from(">6H", b)
        opcode = flags >> 11 & 15
        out = {"tx_id": tx, "qr": flags >> 15, "query_name": None, "query_type": None, "qd_count": qd, "an_count": an, "ok": True}
        if opcode not in (0, 1, 2):
            return out | {"qd_count": 0, "an_count": 0}
        at = 12

        def name(at: int) -> tuple[str | None, int]:
            parts: list[str] = []
            while True:
                n = b[at]
                if n >= 192:
                    b[at + 1]
                    return (".".join(parts) if parts else None), at + 2
                if n == 0:
                    return ".".join(parts), at + 1
                label = b[at + 1 : at + 1 + n]
                if len(label) < n:
                    raise IndexError
                parts.append(label.decode("utf-8", "replace"))
                at += 1 + n

        for k in range(qd):
            text, at = name(at)
            kind, _ = struct.unpack_from(">HH", b, at)
            at += 4
            if k == 0:
                out |= {"query_name": text, "query_type": kind}
        for _ in range(an + ns + ar):
            _, at = name(at)
            size = struct.unpack_from(">H", b, at + 8)[0]
            at += 10 + size
            if at > len(b):
                raise IndexError
        return out
    except (IndexError, struct.error):
        return None


#: Columns of a packet's layers, beside those of its frame.
COLUMNS = [
    ("packet_id", pa.int64()),
    ("ip_id", pa.int64()), ("version", pa.int8()), ("src_addr", pa.string()), ("dst_addr", pa.string()), ("proto", pa.int16()), ("hop_limit", pa.int16()), ("length", pa.int64()), ("l3_start", pa.int64()), ("l3_end", pa.int64()), ("l4_start", pa.int64()), ("l4_end", pa.int64()),
    ("tcp_id", pa.int64()), ("udp_id", pa.int64()), ("src_port", pa.int32()), ("dst_port", pa.int32()), ("seq", pa.int64()), ("ack", pa.int64()), ("flags", pa.string()), ("window", pa.int32()), ("udp_length", pa.int32()), ("payload", pa.binary()), ("payload_start", pa.int64()),
    ("icmp_id", pa.int64()), ("icmpv6_id", pa.int64()), ("type", pa.int16()), ("type_code", pa.int16()), ("echo_id", pa.int32()), ("echo_seq", pa.int32()),
    ("dns_id", pa.int64()), ("tx_id", pa.int32()), ("qr", pa.int8()), ("query_name", pa.string()), ("query_type", pa.int32()), ("qd_count", pa.int32()), ("an_count", pa.int32()), ("dns_end", pa.int64()),
    ("bad", pa.string()), ("bad_start", pa.int64()), ("bad_end", pa.int64()),
]
KEYS = ("packet_id", "ip_id", "tcp_id", "udp_id", "icmp_id", "icmpv6_id", "dns_id")
TYPES = dict(COLUMNS)


def addresses(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Texts of the addresses of ``size`` bytes at the given places; each different one is formatted once."""
    raw = np.ascontiguousarray(buf[at[:, None] + np.arange(size)]) if len(at) else np.zeros((0, size), np.uint8)
    kinds, which = np.unique(raw.view(f"V{size}").ravel(), return_inverse=True)
    make: Callable[[bytes], str] = (lambda x: f"{x[0]}.{x[1]}.{x[2]}.{x[3]}") if size == 4 else lambda x: str(ipaddress.IPv6Address(x))
    return np.array([make(x.tobytes()) for x in kinds], object)[which] if len(at) else np.zeros(0, object)


def layers(buf: np.ndarray, start: np.ndarray, end: np.ndarray, linktype: np.ndarray, offset: np.ndarray, counts: dict[str, int]) -> dict[str, pa.Array]:
    """Columns of packets whose bytes are buf[start:end].

    offset: what is added to a place in ``buf`` for the place in the file. counts: the last key given of each table, by name;
    it is moved on, so that a file's packets in order get keys 1, 2, ... without a window over the file.
    """
    n = len(start)
    top = max(0, len(buf) - 1)
    buf = buf if len(buf) else np.zeros(1, np.uint8)

    def number(at: np.ndarray, size: int) -> np.ndarray:
        """Big-endian numbers; of no use where they run past the end."""
        out = buf[np.minimum(at, top)].astype(np.int64)
        for k in range(1, size):
            out = out << 8 | buf[np.minimum(at + k, top)]
        return out

    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def put(name: str, where: np.ndarray, values: np.ndarray) -> None:
        """Values (one for each packet or for each of ``where``) of some packets."""
        if name in found:
            old, mask = found[name]
            old[where] = values[where] if len(values) == n else values
            mask |= where
        else:
            full = values.copy() if len(values) == n else np.zeros(n, values.dtype)
            if len(values) != n:
                full[where] = values
            found[name] = (full, where.copy())

    def key(name: str, where: np.ndarray) -> None:
        put(name, where, counts.get(name, 0) + np.cumsum(where))
        counts[name] = counts.get(name, 0) + int(where.sum())

    bad_layer = np.zeros(n, object)

    def fails(layer: str, where: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
        if where.any():
            bad_layer[where] = layer
            put("bad", where, bad_layer)
            put("bad_start", where, at + offset)
            put("bad_end", where, to + offset)

    key("packet_id", np.ones(n, bool))
    if not n:
        return {name: pa.array([], kind) for name, kind in COLUMNS}
    # Link layer.
    ether = linktype == ETHERNET
    tagged = ether & (start + 14 <= end) & (number(start + 12, 2) == VLAN)
    skip = np.select([tagged, ether, linktype == SLL, linktype == SLL2], [18, 14, 16, 20], 0)
    type_at = start + np.select([tagged, ether, linktype == SLL], [16, 12, 14], 0)
    kind = np.select([linktype == RAW4, linktype == RAW6, ether | (linktype == SLL) | (linktype == SLL2)], [IP4, IP6, np.where(type_at + 2 <= end, number(type_at, 2), 0)], 0)
    version = np.select([kind == IP4, kind == IP6], [4, 6], 0)
    l3 = np.minimum(start + skip, end)
    # Network layer.
    is4, is_ip = version == 4, version > 0
    head = np.where(is4, (number(l3, 1) & 15) * 4, 40)
    size = np.where(is4, number(l3 + 2, 2), number(l3 + 4, 2) + 40)
    sound = is_ip & (l3 + np.where(is4, 20, 40) <= end) & (head >= 20) & (size >= head) & (size <= end - l3)
    fails("ip", is_ip & ~sound, l3, end)
    key("ip_id", sound)
    l4, l4_end = l3 + head, l3 + size
    proto = number(l3 + np.where(is4, 9, 6), 1)
    for name, values in (("version", version), ("proto", proto), ("hop_limit", number(l3 + np.where(is4, 8, 7), 1)), ("length", size), ("l3_start", l3 + offset), ("l3_end", end + offset), ("l4_start", l4 + offset), ("l4_end", l4_end + offset)):
        put(name, sound, values)
    for name, at4, at6 in (("src_addr", 12, 8), ("dst_addr", 16, 24)):
        for some, at, width in ((sound & is4, at4, 4), (sound & ~is4, at6, 16)):
            if some.any():
                put(name, some, addresses(buf, (l3 + at)[some], width) if some.sum() < n else addresses(buf, l3 + at, width))
    # Transport layers.
    room = l4_end - l4
    is_tcp, is_udp = sound & (proto == TCP), sound & (proto == UDP)
    tcp_head = (number(l4 + 12, 1) >> 4) * 4
    tcp = is_tcp & (room >= 20) & (tcp_head >= 20) & (tcp_head <= room)
    fails("tcp", is_tcp & ~tcp, l4, l4_end)
    key("tcp_id", tcp)
    udp_size = number(l4 + 4, 2)
    udp = is_udp & (room >= 8) & (udp_size >= 8) & (udp_size <= room)
    fails("udp", is_udp & ~udp, l4, l4_end)
    key("udp_id", udp)
    ports = tcp | udp
    src_port, dst_port = number(l4, 2), number(l4 + 2, 2)
    for name, where, values in (("src_port", ports, src_port), ("dst_port", ports, dst_port), ("seq", tcp, number(l4 + 4, 4)), ("ack", tcp, number(l4 + 8, 4)), ("window", tcp, number(l4 + 14, 2)), ("udp_length", udp, udp_size)):
        put(name, where, values)
    if tcp.any():
        put("flags", tcp, FLAG_TEXT[number(l4 + 13, 1)])
    body = l4 + np.where(udp, 8, tcp_head)
    put("payload_start", ports, body + offset)
    if tcp.any():
        data = np.zeros(n, object)
        raw = buf.data
        data[tcp] = [bytes(raw[a:b]) for a, b in zip(body[tcp].tolist(), l4_end[tcp].tolist(), strict=True)]
        put("payload", tcp, data)
    for name, number_, kinds in (("icmp", ICMP, (0, 8)), ("icmpv6", ICMPV6, (128, 129))):
        some = sound & (proto == number_)
        what = number(l4, 1)
        echo = (what == kinds[0]) | (what == kinds[1])
        good = some & (room >= np.where((room > 0) & echo, 8, 4))
        fails(name, some & ~good, l4, l4_end)
        key(f"{name}_id", good)
        if good.any():
            for column, where, values in (("type", good, what), ("type_code", good, number(l4 + 1, 1)), ("echo_id", good & echo, number(l4 + 4, 2)), ("echo_seq", good & echo, number(l4 + 6, 2))):
                put(column, where, values)
    # Names have a layout of their own: message by message.
    asked = np.flatnonzero(udp & ((src_port == PORT_DNS) | (dst_port == PORT_DNS)))
    raw = buf.data
    messages = [dns_message(bytes(raw[a:b])) for a, b in zip(body[asked].tolist(), (l4 + udp_size)[asked].tolist(), strict=True)]
    good = np.zeros(n, bool)
    good[[k for k, m in zip(asked.tolist(), messages, strict=True) if m]] = True
    wrong = np.zeros(n, bool)
    wrong[asked] = True
    fails("dns", wrong & ~good, body, l4 + udp_size)
    key("dns_id", good)
    put("dns_end", good, l4 + udp_size + offset)
    known = [m for m in messages if m]
    out: dict[str, pa.Array] = {}
    for name, kind_ in COLUMNS:
        if name in ("tx_id", "qr", "query_name", "query_type", "qd_count", "an_count"):
            some = pa.array([m[name] for m in known], kind_)
            at = np.cumsum(good) - 1
            out[name] = some.take(pa.array(at, mask=~good)) if known else pa.nulls(n, kind_)
        elif name in found:
            values, mask = found[name]
            out[name] = pa.array(values, kind_, mask=~mask, from_pandas=False) if values.dtype != object else pa.array([v if m else None for v, m in zip(values, mask, strict=True)], kind_)
        else:
            out[name] = pa.nulls(n, kind_)
    return out


def of_frames(bodies: pa.Array, linktype: np.ndarray, offset: np.ndarray, counts: dict[str, int]) -> dict[str, pa.Array]:
    """Columns of packets whose bytes are an Arrow column; offset: where each packet's bytes begin in the file."""
    places = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1, 4 * bodies.offset).astype(np.int64) if len(bodies) else np.zeros(1, np.int64)
    data = bodies.buffers()[2] if len(bodies) else None
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return layers(buf, places[:-1], places[1:], linktype, offset - places[:-1], counts)
