"""Packs: what a format brings along - containers and how they are told, tables, capabilities, queries - checked when it is defined."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

VERSION = "0.1"
KINDS = ("grid", "playback")
#: Tables that every session has, whatever the format.
SESSION_TABLES = frozenset({"_files"})
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
_TABLE = re.compile(r"(?i)\b(?:from|join)\s+([\"`]?)([A-Za-z_]\w*)\1(?!\w)(?!\s*\()")
_CTE = re.compile(r"(?i)(?:\bwith\s+(?:recursive\s+)?|,\s*)([A-Za-z_]\w*)\s+as\s*\(")


class PackError(ValueError):
    """What is wrong with a pack, and where."""


@dataclass(frozen=True)
class Query:
    id: str
    title: str
    sql: str
    kind: str = "grid"


@dataclass(frozen=True)
class Container:
    """An outer format: its reader, and either magic bytes as (offset, hex, confidence) or the name of a probe."""

    id: str
    framer: str
    magic: tuple[tuple[int, str, float], ...] = ()
    hook: str | None = None


@dataclass(frozen=True)
class Pack:
    id: str
    title: str
    containers: tuple[Container, ...]
    tables: tuple[str, ...]
    queries: tuple[Query, ...] = ()
    capabilities: tuple[str, ...] = ()
    errors_ordinal: str = "record"
    hooks: Mapping[str, Callable[[bytes], float | None]] = field(default_factory=dict, hash=False)
    version: str = VERSION

    def probe(self, head: bytes) -> tuple[str, float] | None:
        """The container that fits a file's first bytes best; the first of equals, none without confidence."""
        best: tuple[str, float] | None = None
        for c in self.containers:
            found = self.hooks[c.hook](head) if c.hook else max((p for at, h, p in c.magic if head[at : at + len(h) // 2] == bytes.fromhex(h)), default=None)
            if found and (best is None or found > best[1]):
                best = c.id, found
        return best


def lint(queries: Iterable[Query], tables: Iterable[str], capabilities: Iterable[str] = (), where: str = "queries") -> list[Query]:
    """The queries, if each has an id of its own, a known kind and names only tables that are there or that it defines."""
    known, able, seen, out = {t.lower() for t in tables} | SESSION_TABLES, set(capabilities), set(), []
    for k, q in enumerate(queries):
        at = f"{where}.{k}"
        for name in ("id", "title", "kind", "sql"):
            if not isinstance(getattr(q, name), str):
                raise PackError(f"{at}: {name} must be text")
        if q.id in seen:
            raise PackError(f"{at}: id {q.id!r} is there already")
        seen.add(q.id)
        if q.kind not in KINDS:
            raise PackError(f"{at}: kind {q.kind!r} isn't known")
        if q.kind == "playback" and "audio" not in able:
            raise PackError(f"{at}: playback needs the capability audio")
        own = {m[1].lower() for m in _CTE.finditer(q.sql)}
        for m in _TABLE.finditer(q.sql):
            if m[2].lower() not in known | own:
                raise PackError(f"{at}: table {m[2]!r} isn't known")
        out.append(q)
    return out


def define(pack: Pack) -> Pack:
    """The pack, once all that it says has been checked."""
    if pack.version != VERSION:
        raise PackError(f"{pack.id}: version {pack.version!r} isn't {VERSION}")
    if not pack.title or not pack.containers:
        raise PackError(f"{pack.id}: a title and a container are needed")
    for name in (pack.id, pack.errors_ordinal, *pack.capabilities, *(x for c in pack.containers for x in (c.id, c.framer))):
        if not _NAME.match(name):
            raise PackError(f"{pack.id}: {name!r} is no name")
    if len({c.id for c in pack.containers}) < len(pack.containers):
        raise PackError(f"{pack.id}: a container's id is there twice")
    for c in pack.containers:
        if bool(c.magic) == bool(c.hook):
            raise PackError(f"{pack.id}.{c.id}: either magic bytes or a probe")
        if c.hook and c.hook not in pack.hooks:
            raise PackError(f"{pack.id}.{c.id}: probe {c.hook!r} is missing")
        for at, text, sure in c.magic:
            if at < 0 or not re.fullmatch(r"(?:[0-9a-fA-F]{2})+", text) or not 0 < sure <= 1:
                raise PackError(f"{pack.id}.{c.id}: magic bytes are (offset, hex digits, confidence up to 1)")
    lint(pack.queries, pack.tables, pack.capabilities, f"{pack.id}: queries")
    return pack


def from_mapping(data: Mapping[str, Any], tables: Iterable[str], hooks: Mapping[str, Callable[[bytes], float | None]] | None = None) -> Pack:
    """A pack from plain data, as a manifest file holds it; keys that aren't known are refused."""
    allowed = {"version", "id", "title", "capabilities", "errors", "containers", "queries"}
    if extra := set(data) - allowed:
        raise PackError(f"unexpected {sorted(extra)}")
    try:
        containers = tuple(Container(c["id"], c["framer"], tuple((m["at"], m["hex"], m["confidence"]) for m in c["probe"].get("magic", ())), c["probe"].get("hook")) for c in data["containers"])
        queries = tuple(Query(q["id"], q["title"], q["sql"], q.get("kind", "grid")) for q in data.get("queries", ()))
        return define(Pack(data["id"], data["title"], containers, tuple(tables), queries, tuple(data.get("capabilities", ())), data.get("errors", {}).get("ordinal", "record"), hooks or {}, data.get("version", "")))
    except (KeyError, TypeError, AttributeError) as e:
        raise PackError(f"a manifest lacks or misplaces {e}") from e


def _overview(tables: Iterable[str]) -> Query:
    return Query("overview", "Rows of all tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in sorted(tables)) + " ORDER BY table_name LIMIT 100")


_SECTION = b"\x0a\x0d\x0d\x0a"
_CAPTURE = ("packets", "interfaces", "ip", "tcp", "udp", "dns", "icmp", "icmpv6", "tls", "streams", "stream_segments", "errors")
CAPTURE = define(
    Pack(
        "pcap", "Network captures",
        (Container("pcap", "classic", tuple((0, h, 1.0) for h in ("a1b2c3d4", "a1b23c4d", "d4c3b2a1", "4d3cb2a1"))), Container("pcapng", "next_generation", hook="section")),
        _CAPTURE,
        (
            _overview(_CAPTURE),
            Query("protocols", "Packets of each protocol", "SELECT proto, count(*) AS n FROM ip GROUP BY proto ORDER BY n DESC NULLS LAST, proto LIMIT 100"),
            Query("names_by_time", "Names that were asked for", "SELECT d.*, p.ts FROM dns d JOIN packets p ON p._src_file = d._src_file AND p.packet_id = d.packet_id ORDER BY p.ts NULLS LAST LIMIT 100"),
            Query("connections", "Streams and what they carried", "SELECT stream_id, src_addr, src_port, dst_addr, dst_port, status, message_count, byte_count, pending_bytes FROM streams ORDER BY _src_file, stream_id LIMIT 100"),
            Query("ended_early", "Ends that were used again or reset", "SELECT * FROM streams WHERE close_reason = 'rst' OR generation > 1 ORDER BY _src_file, stream_id LIMIT 100"),
            Query("by_interface", "Packets of each interface", "SELECT i._src_file, i.interface_id, i.name, i.linktype, count(p.packet_id) AS packets, sum(p.len) AS bytes FROM interfaces i LEFT JOIN packets p ON p._src_file = i._src_file AND p.interface_id = i.interface_id GROUP BY ALL ORDER BY 1, 2 LIMIT 100"),
        ),
        hooks={"section": lambda head: 1.0 if head[:4] == _SECTION and head[8:12] in (b"\x1a\x2b\x3c\x4d", b"\x4d\x3c\x2b\x1a") else None},
    )
)
_SONG = ("header", "events", "tempo", "errors")
#: Times of a song's events, by the tempo in force at each tick.
_SECONDS = """WITH t AS (SELECT _src_file, tick, max_by(us_per_quarter, tempo_id) AS us FROM tempo GROUP BY _src_file, tick),
    s AS (SELECT * FROM t UNION ALL SELECT _src_file, 0, 500000 FROM header h WHERE NOT EXISTS (SELECT 1 FROM t WHERE t._src_file = h._src_file AND t.tick = 0)),
    m AS (SELECT *, sum((tick - before) * us_before) OVER (PARTITION BY _src_file ORDER BY tick ROWS UNBOUNDED PRECEDING) AS base FROM (SELECT *, lag(tick, 1, 0L) OVER (PARTITION BY _src_file ORDER BY tick) AS before, lag(us, 1, 0L) OVER (PARTITION BY _src_file ORDER BY tick) AS us_before FROM s) x),
    u AS (SELECT _src_file, tick, NULL AS event_id, struct(tick, us, base) AS at FROM m UNION ALL SELECT _src_file, tick, event_id, NULL FROM events),
    a AS (SELECT _src_file, tick, event_id, last(at, true) OVER (PARTITION BY _src_file ORDER BY tick, event_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS at FROM u)
    SELECT e.event_id, (a.at.base + (e.tick - a.at.tick) * a.at.us) / (h.division * 1000000D) AS seconds, e.event AS kind, e.channel, e.note, e.velocity, e._src_start, e._src_end, e._src_file
    FROM events e JOIN a ON a._src_file = e._src_file AND a.event_id = e.event_id JOIN header h ON h._src_file = e._src_file ORDER BY e._src_file, seconds, e.event_id"""
MIDI = define(
    Pack(
        "midi", "Standard MIDI files", (Container("smf", "smf", ((0, "4d546864", 1.0),)),), _SONG,
        (_overview(_SONG), Query("tempo_changes", "Changes of tempo", "SELECT track, tick, us_per_quarter, 60000000D / us_per_quarter AS per_minute FROM tempo ORDER BY _src_file, tick LIMIT 100"), Query("play_all", "All events in seconds", _SECONDS, "playback")),
        ("audio",), "track",
    )
)
_ARCHIVE = ("local_files", "central_dir_entries", "end_of_central_dir", "errors")
ZIP = define(
    Pack(
        "zip", "ZIP archives", (Container("zip", "zip", ((0, "504b0304", 1.0), (0, "504b0506", 0.9))),), _ARCHIVE,
        (
            _overview(_ARCHIVE),
            Query("methods", "Members of each method", "SELECT compression, count(*) AS n, sum(uncompressed_size) AS bytes FROM local_files GROUP BY compression ORDER BY n DESC NULLS LAST, compression LIMIT 100"),
            Query("differing", "Heads that differ from the directory", "SELECT l.file_name, l.crc32 AS head, c.crc32 AS directory FROM local_files l JOIN central_dir_entries c ON c._src_file = l._src_file AND c.ofs_local_header = l._src_start AND c.crc32 <> l.crc32 ORDER BY 1 LIMIT 100"),
        ),
    )
)
#: In the order in which equal probes win.
PACKS = (MIDI, CAPTURE, ZIP)


def choose(head: bytes) -> tuple[Pack, str] | None:
    """The pack and container of a file's first bytes."""
    best: tuple[Pack, str, float] | None = None
    for p in PACKS:
        if (found := p.probe(head)) and (best is None or found[1] > best[2]):
            best = p, *found
    return best[:2] if best else None
