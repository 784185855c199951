"""What a user keeps: saved queries and what was run, in one JSON file or in memory; and what rows can be shown with."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T

HISTORY = 100


def plain_name(name: str) -> str:
    """A name without white space at its ends or repeated within."""
    return re.sub(r"\s+", " ", name).strip() or "untitled"


def plain_sql(text: str) -> str:
    """A query without white space or semicolons at its end, lines ended alike."""
    return re.sub(r"[\s;]+\Z", "", text.replace("\r\n", "\n")).strip()


class Library:
    """Saved queries by format, and the history of runs, of which the last ``limit`` are kept.

    Without a path nothing outlives the process; history is written only if that was asked for, and cleared when it no longer is.
    """

    def __init__(self, path: str | None = None, limit: int = HISTORY, now: Callable[[], float] = time.time) -> None:
        self.path, self.limit, self.now = Path(path) if path else None, limit, now
        self.saved: list[dict[str, Any]] = []
        self.history: list[dict[str, Any]] = []
        self.keep_history = False
        if self.path and self.path.exists():
            data = json.loads(self.path.read_text())
            self.saved, self.history, self.keep_history = data["saved"], data["history"][: self.limit], data["keep_history"]

    def _store(self) -> None:
        if self.path:
            text = json.dumps({"saved": self.saved, "history": self.history if self.keep_history else [], "keep_history": self.keep_history})
            new = self.path.with_suffix(".new")
            new.write_text(text)
            new.replace(self.path)

    def find(self, id_: str) -> dict[str, Any] | None:
        return next((q for q in self.saved if q["id"] == id_), None)

    def of(self, format_: str) -> list[dict[str, Any]]:
        return [q for q in self.saved if q["format"] == format_]

    def save(self, format_: str, name: str, sql: str) -> dict[str, Any]:
        at = self.now()
        query = {"id": uuid.uuid4().hex, "format": format_, "name": plain_name(name), "sql": sql, "created": at, "updated": at}
        self.saved.append(query)
        self._store()
        return query

    def update(self, id_: str, *, name: str | None = None, sql: str | None = None) -> dict[str, Any] | None:
        query = self.find(id_)
        if query:
            query |= {"name": plain_name(name) if name is not None else query["name"], "sql": query["sql"] if sql is None else sql, "updated": max(self.now(), query["updated"] + 1e-3)}
            self._store()
        return query

    def remove(self, id_: str) -> dict[str, Any] | None:
        query = self.find(id_)
        if query:
            self.saved = [q for q in self.saved if q["id"] != id_]
            self._store()
        return query

    def restore(self, query: dict[str, Any]) -> None:
        """Put a removed query back to its place."""
        self.saved = sorted([*(q for q in self.saved if q["id"] != query["id"]), query], key=lambda q: (q["created"], q["id"]))
        self._store()

    def ran(self, format_: str, sql: str, status: str, rows: int | None = None) -> None:
        """Note a run; the same query once more moves its entry up instead of adding one."""
        if not sql.strip():
            return
        newest = next((h for h in self.history if h["format"] == format_), None)
        entry = newest if newest and newest["sql"] == sql else {"id": uuid.uuid4().hex, "format": format_, "sql": sql}
        entry |= {"ran": self.now(), "status": status, "rows": rows}
        self.history = [entry, *(h for h in self.history if h["id"] != entry["id"])][: self.limit]
        self._store()

    def keep(self, history: bool) -> None:
        self.keep_history = history
        self._store()

    def clear(self) -> None:
        self.history = []
        self._store()

    def take_in(self, format_: str, queries: Iterable[tuple[str, str]]) -> tuple[int, int]:
        """Save queries that aren't there by name and text; returns how many came in and how many were there."""
        came = there = 0
        for name, sql in queries:
            name, sql = plain_name(name), plain_sql(sql)
            if any(q["name"] == name and plain_sql(q["sql"]) == sql for q in self.of(format_)):
                there += 1
            else:
                self.save(format_, name, sql)
                came += 1
        return came, there


def playable(schema: T.StructType, capabilities: Iterable[str]) -> bool:
    """Whether rows can be played: numbers seconds, note and velocity and a text kind, each there once."""
    if "audio" not in capabilities:
        return False
    by: dict[str, list[T.DataType]] = {}
    for f in schema:
        by.setdefault(f.name, []).append(f.dataType)
    if any(len(by.get(n, ())) != 1 for n in ("seconds", "note", "velocity", "kind")) or any(len(by.get(n, ())) > 1 for n in ("channel", "program")):
        return False
    numbers = ["seconds", "note", "velocity", *(["channel"] if "channel" in by else [])]
    return all(isinstance(by[n][0], T.NumericType) for n in numbers) and isinstance(by["kind"][0], T.StringType)


def read_bytes(spark: SparkSession, path: str, start: int, end: int) -> bytes:
    """Bytes [start, end) of a file in any store that Spark reaches; shorter at the end of the file."""
    if not 0 <= start <= end:
        raise ValueError("a range begins at 0 at least and ends behind its beginning")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    size, stream = fs.getFileStatus(at).getLen(), fs.open(at)
    try:
        if start >= size:
            return b""
        stream.seek(start)
        return bytes(stream.readNBytes(end - start))
    finally:
        stream.close()


def parquet_bytes(paths: Iterable[str], columns: Iterable[str] | None = None) -> int:
    """Bytes that the named columns (or all) take in Parquet files: what a query that needs no others reads."""
    import pyarrow.parquet as pq

    want = None if columns is None else set(columns)
    total = 0
    for p in paths:
        meta = pq.ParquetFile(p.removeprefix("file://").removeprefix("file:")).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                if want is None or column.path_in_schema.split(".")[0] in want:
                    total += column.total_compressed_size
    return total
