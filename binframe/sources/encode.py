"""Encoders that write rows as captures, songs and archives: inputs for tests and benchmarks, independent of the readers."""

from __future__ import annotations

import struct
import zlib


def pcap(records: list[tuple[int, bytes]], linktype: int = 1, order: str = "<", nano: bool = False) -> bytes:
    """(timestamp in ns, bytes) as a classic capture."""
    out = [struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 262_144, linktype)]
    for ns, body in records:
        sec, frac = divmod(ns, 1_000_000_000)
        out.append(struct.pack(order + "IIII", sec, frac if nano else frac // 1000, len(body), len(body)) + body)
    return b"".join(out)


def _block(kind: int, body: bytes, order: str) -> bytes:
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))


def pcapng(packets: list[tuple[int, int, bytes]], interfaces: list[tuple[int, str]], order: str = "<") -> bytes:
    """(interface, timestamp in us, bytes) as one section with named interfaces."""
    out = [_block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)]
    for linktype, name in interfaces:
        raw = name.encode()
        out.append(_block(1, struct.pack(order + "HHI", linktype, 0, 0) + struct.pack(order + "HH", 2, len(raw)) + raw + b"\0" * (-len(raw) % 4) + b"\0\0\0\0", order))
    for which, us, body in packets:
        out.append(_block(6, struct.pack(order + "IIIII", which, us >> 32, us & 0xFFFFFFFF, len(body), len(body)) + body, order))
    return b"".join(out)


def ethernet(payload: bytes, ether_type: int = 0x0800, vlan: int | None = None) -> bytes:
    tag = b"" if vlan is None else struct.pack(">HH", 0x8100, vlan)
    return b"\2\0\0\0\0\1\2\0\0\0\0\2" + tag + struct.pack(">H", ether_type) + payload


def ipv4(payload: bytes, proto: int, src: str, dst: str, ttl: int = 64) -> bytes:
    ip = lambda s: bytes(map(int, s.split(".")))
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(payload), 0, 0, ttl, proto, 0) + ip(src) + ip(dst) + payload


def ipv6(payload: bytes, proto: int, src: bytes, dst: bytes, hops: int = 64) -> bytes:
    return struct.pack(">IHBB", 6 << 28, len(payload), proto, hops) + src + dst + payload


def udp(payload: bytes, sport: int, dport: int) -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


FLAG = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16}


def tcp(payload: bytes, sport: int, dport: int, seq: int, flags: str = "ACK", ack: int = 0) -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, ack, 5 << 4, sum(FLAG[f] for f in flags.split("|")), 1024, 0, 0) + payload


def dns(tx: int, name: str, kind: int = 1, response: bool = False) -> bytes:
    labels = b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0"
    return struct.pack(">6H", tx, 0x8000 if response else 0x0100, 1, 0, 0, 0) + labels + struct.pack(">HH", kind, 1)


def client_hello(host: str, version: tuple[int, int] = (3, 3)) -> bytes:
    raw = host.encode()
    name = struct.pack(">HBH", len(raw) + 3, 0, len(raw)) + raw
    ext = struct.pack(">HH", 0, len(name)) + name
    body = bytes(version) + b"\7" * 32 + b"\0" + struct.pack(">HH", 2, 0x1301) + b"\1\0" + struct.pack(">H", len(ext)) + ext
    hand = b"\1" + struct.pack(">I", len(body))[1:] + body
    return struct.pack(">BHH", 0x16, 0x0301, len(hand)) + hand


def vlq(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def smf(tracks: list[list[tuple[int, bytes]]], division: int = 480, format_: int = 1) -> bytes:
    """(delta time, event bytes) of each track as a song."""
    body = [b"".join(vlq(d) + e for d, e in t) for t in tracks]
    return struct.pack(">4sIHHh", b"MThd", 6, format_, len(tracks), division) + b"".join(b"MTrk" + struct.pack(">I", len(b)) + b for b in body)


def zip_stored(members: list[tuple[str, bytes]], date: int = (2021 - 1980) << 9 | 6 << 5 | 15, time: int = 12 << 11 | 30 << 5 | 22) -> bytes:
    local, central = [], []
    at = 0
    for name, data in members:
        raw = name.encode()
        head = struct.pack("<HHHHHIIIHH", 20, 0x800, 0, time, date, zlib.crc32(data), len(data), len(data), len(raw), 0)
        local.append(b"PK\3\4" + head + raw + data)
        central.append(b"PK\1\2" + struct.pack("<H", 20) + head + struct.pack("<HHHII", 0, 0, 0, 0, at) + raw)
        at += len(local[-1])
    body = b"".join(central)
    return b"".join(local) + body + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(body), at, 0)
