"""Standard MIDI files as frames: the header and one frame for each event, running status written out."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T

from binframe.sources.framing import FatalFormatError, Source, issue

L, S = T.LongType(), T.StringType()
FIELDS = [T.StructField(n, L) for n in ("format", "num_tracks", "division", "track", "event_index", "delta_time", "tick", "status", "meta_type", "channel", "note", "velocity", "controller", "value", "program", "pressure", "bend", "us_per_quarter")] + [T.StructField("event", S)]
_NAMES = {8: "note_off", 9: "note_on", 10: "poly_pressure", 11: "control_change", 12: "program_change", 13: "channel_pressure", 14: "pitch_bend"}


class _Bad(Exception):
    pass


def vlq(data: bytes, at: int) -> tuple[int, int]:
    """Value and end of a variable-length quantity of four bytes at most."""
    value = 0
    for k in range(4):
        if at + k >= len(data):
            raise _Bad("VLQ_TRUNCATED")
        value = value << 7 | data[at + k] & 0x7F
        if data[at + k] < 0x80:
            return value, at + k + 1
    raise _Bad("VLQ_TOO_LONG")


def _event(data: bytes, at: int, running: int | None) -> tuple[dict[str, Any], int, int | None]:
    """What an event after its delta time holds, where it ends, and the running status behind it."""
    if at >= len(data):
        raise _Bad("TRUNCATED_EVENT")
    status = data[at]
    if status in (0xFF, 0xF0, 0xF7):
        start = at + (2 if status == 0xFF else 1)
        if start > len(data) or status == 0xFF and at + 1 >= len(data):
            raise _Bad("TRUNCATED_EVENT")
        size, body = vlq(data, start)
        if body + size > len(data):
            raise _Bad("TRUNCATED_EVENT")
        out: dict[str, Any] = {"status": status, "event": "meta" if status == 0xFF else "sysex"}
        if status == 0xFF:
            out["meta_type"] = data[at + 1]
            if data[at + 1] == 81 and size == 3:
                out["us_per_quarter"] = int.from_bytes(data[body : body + 3], "big")
        return out, body + size, None
    if status >= 0xF0:
        raise _Bad("UNSUPPORTED_STATUS")
    if status >= 0x80:
        at += 1
    elif running is None:
        raise _Bad("RUNNING_STATUS_MISSING")
    else:
        status = running
    kind, n = status >> 4, 1 if status >> 4 in (12, 13) else 2
    args = data[at : at + n]
    if len(args) < n:
        raise _Bad("TRUNCATED_EVENT")
    if max(args) >= 0x80:
        raise _Bad("INVALID_DATA_BYTE")
    out = {"status": status, "channel": status & 15, "event": _NAMES[kind]}
    if kind in (8, 9, 10):
        out["note"] = args[0]
        out["pressure" if kind == 10 else "velocity"] = args[1]
        if kind == 9 and args[1] == 0:
            out["event"] = "note_off"
    elif kind == 11:
        out |= {"controller": args[0], "value": args[1]}
    elif kind == 14:
        out["bend"] = (args[1] << 7) + args[0] - 8192
    else:
        out["program" if kind == 12 else "pressure"] = args[0]
    return out, at + n, status


def read_smf(source: Source) -> Iterator[dict[str, Any]]:
    head = source.read(0, 14)
    if head[:4] != b"MThd"[: len(head)] or not head:
        raise FatalFormatError("INVALID_MAGIC")
    if len(head) < 14:
        raise FatalFormatError("TRUNCATED_HEADER")
    size, format_, tracks, division = struct.unpack(">IHHh", head[4:])
    if size < 6:
        raise FatalFormatError("UNSUPPORTED_HEADER_LENGTH")
    if format_ > 2:
        raise FatalFormatError("UNSUPPORTED_FORMAT")
    if format_ == 2:
        raise FatalFormatError("UNSUPPORTED_MIDI_TYPE")
    at = 8 + size
    yield {"kind": "header", "format": format_, "num_tracks": tracks, "division": division, "_src_start": 0, "_src_end": at}
    track, issues = 0, []
    while track < tracks:
        chunk = source.read(at, 8)
        if len(chunk) < 8:
            raise FatalFormatError("MISSING_TRACK")
        length = struct.unpack(">I", chunk[4:])[0]
        if at + 8 + length > source.size:
            raise FatalFormatError("TRUNCATED_TRACK")
        if chunk[:4] == b"MTrk":
            data, pos, tick, index, running = source.read(at + 8, length), 0, 0, 0, None
            while pos < length:
                start = pos
                try:
                    delta, pos = vlq(data, pos)
                    event, pos, running = _event(data, pos, running)
                except _Bad as e:
                    issues.append(issue(str(e), at + 8 + start, at + 8 + length, stage="normalizing", track=track))
                    break
                tick += delta
                yield {"kind": "event", "track": track, "event_index": index, "delta_time": delta, "tick": tick, **event, "_src_start": at + 8 + start, "_src_end": at + 8 + pos}
                index += 1
            track += 1
        at += 8 + length
    yield from issues
