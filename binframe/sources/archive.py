"""ZIP directories as frames: local files, central directory entries and the end record. Members' bodies are never read."""

from __future__ import annotations

import datetime as dt
import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import types as T

from binframe.sources.framing import Source, issue

L, S = T.LongType(), T.StringType()
_NUMBERS = ("version_made_by", "version_needed", "flags", "compression_method", "crc32", "compressed_size", "uncompressed_size", "extra_len", "disk_start", "internal_attrs", "external_attrs", "ofs_local_header", "num_entries", "central_dir_size", "ofs_central_dir")
FIELDS = [T.StructField(n, L) for n in _NUMBERS] + [T.StructField("compression", S), T.StructField("mod_time_us", L), T.StructField("file_name", S), T.StructField("comment", S)]
#: Names of the compression methods.
METHODS = {0: "stored", 8: "deflate", 12: "bzip2", 14: "lzma", 93: "zstd", 95: "xz"}


def dos_time(date: int, time: int) -> int | None:
    """Microseconds since 1970 of a DOS date and time; days past the month's end roll over, no month or day gives None."""
    year, month, day = 1980 + (date >> 9), date >> 5 & 15, date & 31
    if not 1 <= month <= 12 or day < 1:
        return None
    base = dt.datetime(year, month, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day - 1, hours=time >> 11, minutes=time >> 5 & 63, seconds=2 * (time & 31))
    return int(base.timestamp()) * 1_000_000


def _name(raw: bytes, flags: int) -> str:
    return raw.decode("utf-8" if flags & 0x800 else "cp437", "replace")


def _local(source: Source, at: int, known: dict[str, Any] | None) -> tuple[dict[str, Any] | None, int]:
    """A local file header and its body's range, and where it ends; sizes that follow the body come from the directory."""
    head = source.read(at, 30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        return None, at
    need, flags, method, time, date, crc, small, size, n, extra = struct.unpack_from("<HHHHHIIIHH", head, 4)
    rest = source.read(at + 30, n)
    if flags & 8 and not crc and not small and known:
        crc, small, size = known["crc32"], known["compressed_size"], known["uncompressed_size"]
    end = at + 30 + n + extra + small
    row = {"kind": "local_file", "version_needed": need, "flags": flags, "compression_method": method, "compression": METHODS.get(method, "unknown"), "crc32": crc, "compressed_size": small, "uncompressed_size": size, "mod_time_us": dos_time(date, time), "file_name": _name(rest, flags), "extra_len": extra, "_src_start": at, "_src_end": end}
    return row, end


def read_zip(source: Source) -> Iterator[dict[str, Any]]:
    from_ = max(0, source.size - 65_557)
    tail = source.read(from_, source.size - from_)
    at = tail.rfind(b"PK\5\6")
    if at < 0 or len(tail) - at < 22:
        at = 0
        while at < source.size:
            row, end = _local(source, at, None)
            if row is None or end > source.size:
                break
            if row["flags"] & 8 and not row["compressed_size"]:
                yield issue("STREAMED_ENTRY_UNSIZED", at, end)
                break
            yield row
            at = end
        yield issue("EOCD_NOT_FOUND", 0, source.size)
        return
    count, size, offset, n = struct.unpack_from("<HIIH", tail, at + 10)
    eocd = {"kind": "eocd", "num_entries": count, "central_dir_size": size, "ofs_central_dir": offset, "comment": tail[at + 22 : at + 22 + n].decode("cp437"), "_src_start": from_ + at, "_src_end": from_ + at + 22 + n}
    entries, issues, pos = [], [], offset
    directory = source.read(offset, size)
    if len(directory) < size:
        issues.append(issue("CENTRAL_DIRECTORY_TRUNCATED", offset, source.size))
    while pos - offset + 46 <= len(directory):
        head = directory[pos - offset : pos - offset + 46]
        if head[:4] != b"PK\1\2":
            break
        made, need, flags, method, time, date, crc, small, full, name, extra, comment, disk, inner, outer, local = struct.unpack_from("<HHHHHHIIIHHHHHII", head, 4)
        end = pos + 46 + name + extra + comment
        if end > offset + len(directory):
            issues.append(issue("RECORD_TRUNCATED", pos, offset + len(directory)))
            break
        text = directory[pos - offset + 46 : end - offset]
        entries.append({"kind": "central_dir_entry", "version_made_by": made, "version_needed": need, "flags": flags, "compression_method": method, "compression": METHODS.get(method, "unknown"), "crc32": crc, "compressed_size": small, "uncompressed_size": full, "mod_time_us": dos_time(date, time), "file_name": _name(text[:name], flags), "extra_len": extra, "disk_start": disk, "internal_attrs": inner, "external_attrs": outer, "ofs_local_header": local, "comment": _name(text[name + extra :], flags), "_src_start": pos, "_src_end": end})
        pos = end
    if len(entries) != count:
        issues.append(issue("CENTRAL_DIRECTORY_ENTRY_COUNT_MISMATCH", offset, offset + len(directory)))
    for e in sorted(entries, key=lambda e: e["ofs_local_header"]):
        row, end = _local(source, e["ofs_local_header"], e)
        if row is None:
            issues.append(issue("LOCAL_HEADER_INVALID", e["_src_start"], e["_src_end"]))
        elif end > source.size:
            issues.append(issue("RECORD_TRUNCATED", row["_src_start"], source.size))
        else:
            yield row
    yield from entries
    yield eocd
    yield from issues
