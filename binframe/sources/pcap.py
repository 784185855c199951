"""Packet captures, classic and next generation, as frames of interfaces and packets."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T

from binframe.sources.framing import FatalFormatError, Source, issue

L, S = T.LongType(), T.StringType()
FIELDS = [T.StructField(n, t) for n, t in (("interface_id", L), ("section", L), ("if_index", L), ("linktype", L), ("snaplen", L), ("name", S), ("description", S), ("os", S), ("comment", S), ("ts_resolution", S), ("ts_offset_s", L), ("ts_us", L), ("ts_ns", L), ("caplen", L), ("len", L), ("body_offset", L), ("body", T.BinaryType()))]

#: Longest record that is read; longer ones are skipped.
MOST = 16 << 20
#: Fixed values of the classic format: magic as read big-endian, byte order, nanoseconds to a fraction.
MAGIC = {0xA1B2C3D4: (">", 1000), 0xA1B23C4D: (">", 1), 0xD4C3B2A1: ("<", 1000), 0x4D3CB2A1: ("<", 1)}


def _linktype(kind: int, body: bytes) -> int:
    """Raw IP captures name their version by the first half byte."""
    if kind == 101 and body:
        return {4: 228, 6: 229}.get(body[0] >> 4, kind)
    return kind


def read_pcap(source: Source) -> Iterator[dict[str, Any]]:
    head = source.read(0, 24)
    known = MAGIC.get(int.from_bytes(head[:4], "big")) if len(head) == 24 else None
    if not known:
        raise FatalFormatError("UNRECOGNIZED_PCAP_MAGIC")
    order, scale = known
    snaplen, linktype = struct.unpack_from(order + "II", head, 16)
    yield {"kind": "interface", "interface_id": 1, "section": 0, "if_index": 0, "linktype": linktype, "snaplen": snaplen, "ts_resolution": "10^-9" if scale == 1 else "10^-6", "ts_offset_s": 0, "_src_start": 0, "_src_end": 24}
    at, issues = 24, []
    while at < source.size:
        record = source.read(at, 16)
        if len(record) < 16:
            issues.append(issue("TRUNCATED_RECORD", at, source.size))
            break
        sec, frac, incl, orig = struct.unpack(order + "IIII", record)
        end = at + 16 + incl
        if end > source.size:
            issues.append(issue("TRUNCATED_RECORD", at, source.size))
            break
        if incl > MOST:
            issues.append(issue("OVERSIZED_RECORD", at, end))
        else:
            body, ns = source.read(at + 16, incl), sec * 1_000_000_000 + frac * scale
            yield {"kind": "packet", "interface_id": 1, "linktype": _linktype(linktype, body), "ts_us": ns // 1000, "ts_ns": ns, "caplen": incl, "len": orig, "body_offset": 16, "body": body, "_src_start": at, "_src_end": end}
        at = end
    yield from issues


#: Fixed values of the next-generation format: block types, least lengths, types that are passed over.
SHB, IDB, OPB, SPB, EPB = 0x0A0D0D0A, 1, 2, 3, 6
LEAST = {SHB: 28, IDB: 20, OPB: 32, EPB: 32, SPB: 16}
QUIET = {4, 5, 9, 10, 0xBAD, 0x40000BAD}


def options(data: bytes, order: str) -> list[tuple[int, bytes]]:
    """(code, value) pairs up to the end mark; ValueError if one runs over."""
    out, at = [], 0
    while at + 4 <= len(data):
        code, size = struct.unpack_from(order + "HH", data, at)
        if code == 0:
            return out
        if at + 4 + size > len(data):
            raise ValueError("option runs over its block")
        out.append((code, data[at + 4 : at + 4 + size]))
        at += 4 + size + -size % 4
    return out


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace").rstrip("\0")


class _Interface:
    def __init__(self, number: int, linktype: int, snaplen: int) -> None:
        self.number, self.linktype, self.snaplen = number, linktype, snaplen
        self.base, self.power, self.offset = 10, 6, 0

    def ns(self, units: int) -> int | None:
        whole = units * 1_000_000_000 // self.base**self.power + self.offset * 1_000_000_000
        return whole if -(1 << 63) <= whole < 1 << 63 else None


def _section(source: Source, at: int) -> tuple[str, int]:
    """Byte order and block length of a section header; FatalFormatError names what is wrong."""
    head = source.read(at, 28)
    if len(head) < 28:
        raise FatalFormatError("TRUNCATED_BLOCK")
    order = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}.get(head[8:12])
    if not order:
        raise FatalFormatError("BAD_BYTE_ORDER_MAGIC")
    length, major = struct.unpack_from(order + "I", head, 4)[0], struct.unpack_from(order + "H", head, 12)[0]
    if major != 1:
        raise FatalFormatError("UNSUPPORTED_SECTION_VERSION")
    if length < 28 or length % 4 or at + length > source.size:
        raise FatalFormatError("TRUNCATED_BLOCK")
    return order, length


def read_pcapng(source: Source) -> Iterator[dict[str, Any]]:
    if source.read(0, 4) != b"\x0a\x0d\x0d\x0a":
        raise FatalFormatError("NOT_PCAPNG")
    at, order, section, number = 0, "<", -1, 0
    interfaces: list[_Interface | None] = []
    unknown: Counter[int] = Counter()
    where: dict[int, tuple[int, int]] = {}
    issues: list[dict[str, Any]] = []
    while at < source.size:
        head = source.read(at, 12)
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            try:
                order, length = _section(source, at)
            except FatalFormatError as e:
                if section < 0:
                    raise
                issues.append(issue(e.code, at, source.size))
                break
            section, interfaces = section + 1, []
            at += length
            continue
        if len(head) < 12:
            issues.append(issue("TRUNCATED_BLOCK", at, source.size))
            break
        kind, length = struct.unpack_from(order + "II", head)
        end = at + length
        if length < 12 or length % 4 or end > source.size:
            issues.append(issue("TRUNCATED_BLOCK", at, source.size))
            break
        if struct.unpack(order + "I", source.read(end - 4, 4))[0] != length:
            issues.append(issue("BLOCK_LENGTH_MISMATCH", at, end))
            break
        if kind not in LEAST:
            if kind not in QUIET:
                unknown[kind] += 1
                where.setdefault(kind, (at, end))
        elif length > MOST:
            issues.append(issue("OVERSIZED_RECORD", at, end))
        elif length < LEAST[kind]:
            issues.append(issue("MALFORMED_BLOCK", at, end))
            if kind == IDB:
                interfaces.append(None)
        elif kind == IDB:
            block = source.read(at, length)
            linktype, _, snaplen = struct.unpack_from(order + "HHI", block, 8)
            try:
                named = dict(reversed(options(block[16:-4], order)))
            except ValueError:
                issues.append(issue("MALFORMED_OPTION", at, end))
                interfaces.append(None)
                at = end
                continue
            number += 1
            one = _Interface(number, linktype, snaplen)
            if 9 in named and named[9]:
                one.base, one.power = (2 if named[9][0] & 0x80 else 10), named[9][0] & 0x7F
            if 14 in named and len(named[14]) == 8:
                one.offset = struct.unpack(order + "q", named[14])[0]
            interfaces.append(one)
            yield {"kind": "interface", "interface_id": number, "section": section, "if_index": len(interfaces) - 1, "linktype": linktype, "snaplen": snaplen, "name": _text(named[2]) if 2 in named else None, "description": _text(named[3]) if 3 in named else None, "os": _text(named[12]) if 12 in named else None, "comment": _text(named[1]) if 1 in named else None, "ts_resolution": f"{one.base}^-{one.power}", "ts_offset_s": one.offset, "_src_start": at, "_src_end": end}
        else:
            yield from _packet(source.read(at, length), kind, order, interfaces, at, end, issues)
        at = end
    yield from issues
    for kind, n in unknown.items():
        yield issue("UNSUPPORTED_BLOCK_TYPE", *where[kind], f"block type {kind:#x}, {n} times")


def _packet(block: bytes, kind: int, order: str, interfaces: list[_Interface | None], at: int, end: int, issues: list[dict[str, Any]]) -> Iterator[dict[str, Any]]:
    which = 0 if kind == SPB else struct.unpack_from(order + ("I" if kind == EPB else "H"), block, 8)[0]
    one = interfaces[which] if which < len(interfaces) else None
    if one is None:
        issues.append(issue("UNKNOWN_INTERFACE", at, end))
        return
    ns, comment = None, None
    if kind == SPB:
        size = struct.unpack_from(order + "I", block, 8)[0]
        room = len(block) - 16
        caplen, start = min(size, one.snaplen or room, room), 12
    else:
        high, low, caplen, size = struct.unpack_from(order + "IIII", block, 12)
        start = 28
        if start + caplen > len(block) - 4:
            issues.append(issue("MALFORMED_BLOCK", at, end))
            return
        try:
            comment = next((_text(v) for c, v in options(block[start + caplen + -caplen % 4 : -4], order) if c == 1), None)
        except ValueError:
            issues.append(issue("MALFORMED_OPTION", at, end))
        ns = one.ns(high << 32 | low)
        if ns is None:
            issues.append(issue("TIMESTAMP_OUT_OF_RANGE", at, end))
    body = block[start : start + caplen]
    yield {"kind": "packet", "interface_id": one.number, "linktype": _linktype(one.linktype, body), "ts_us": None if ns is None else ns // 1000, "ts_ns": ns, "caplen": caplen, "len": size, "comment": comment, "body_offset": start, "body": body, "_src_start": at, "_src_end": end}


def read_capture(source: Source) -> Iterator[dict[str, Any]]:
    """Either format, told by its first bytes."""
    return read_pcapng(source) if source.read(0, 4) == b"\x0a\x0d\x0d\x0a" else read_pcap(source)
