"""Byte sources and the frames table that every container reader fills."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, BinaryIO, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Source(Protocol):
    size: int

    def read(self, offset: int, length: int) -> bytes: ...


class Memory:
    """Bytes that are already there."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def read(self, offset: int, length: int) -> bytes:
        return self.data[offset : offset + max(0, length)]


class Windowed:
    """A file read through one window, so that small neighbouring reads cost one."""

    def __init__(self, file: BinaryIO, size: int, window: int = 8 << 20) -> None:
        self.file, self.size, self.window, self.start, self.data = file, size, window, 0, b""

    def read(self, offset: int, length: int) -> bytes:
        if not self.start <= offset or offset + length > self.start + len(self.data):
            self.file.seek(offset)
            self.start, self.data = offset, self.file.read(max(length, self.window))
        at = offset - self.start
        return self.data[at : at + length]


class FatalFormatError(ValueError):
    """A file that can't be read at all; ``code`` says why."""

    def __init__(self, code: str, message: str = "") -> None:
        super().__init__(message or code)
        self.code = code


#: Columns that every frame has; containers add theirs. Issues are frames of kind "issue".
COMMON = [
    T.StructField("_src_file", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("_src_start", T.LongType()), T.StructField("_src_end", T.LongType()),
    T.StructField("code", T.StringType()), T.StructField("message", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("recoverable", T.BooleanType()),
]
Framer = Callable[[Source], Iterator[dict[str, Any]]]
#: Frames to an Arrow batch.
BATCH = 8192


def issue(code: str, start: int | None, end: int | None, message: str = "", stage: str = "framing", **more: Any) -> dict[str, Any]:
    return {"kind": "issue", "code": code, "message": message or code.lower().replace("_", " "), "stage": stage, "recoverable": True, "_src_start": start, "_src_end": end, **more}


def frames_of(framer: Framer, source: Source, name: str) -> Iterator[dict[str, Any]]:
    """Frames of one file in order; a fatal error is its last frame, of kind "fatal"."""
    n = 0
    try:
        for frame in framer(source):
            yield {"_src_file": name, "ordinal": n, **frame}
            n += 1
    except FatalFormatError as e:
        yield {"_src_file": name, "ordinal": n, "kind": "fatal", "code": e.code, "message": str(e), "stage": "framing", "recoverable": False, "_src_start": 0, "_src_end": 0}


def to_batches(rows: Iterator[dict[str, Any]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict[str, Any]] = []
    for r in rows:
        held.append(r)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def read_frames(spark: SparkSession, paths: str | list[str], framer: Framer, fields: list[T.StructField]) -> DataFrame:
    """Frames of all files at ``paths`` (any store that Spark reads; a file to a task, each below 2 GB).

    Larger files on a mounted store: the registered data sources of ``binframe.sources`` read them through a window.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(COMMON + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from to_batches(frames_of(framer, Memory(data.as_py()), name), arrow)

    files = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInArrow(run, schema)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


def data_source(short_name: str, framer: Framer, fields: list[T.StructField]) -> type[DataSource]:
    """A Python data source that streams files through a window: ``spark.read.format(short_name).load(path)``."""
    schema = T.StructType(COMMON + fields)

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]) -> None:
            self.path = options.get("path", "")

        def partitions(self) -> list[InputPartition]:
            import glob
            import os

            path = self.path.removeprefix("file://")
            found = sorted(p for p in (glob.glob(f"{path}/*") if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(p))
            return [_File(p) for p in found]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            import os

            from pyspark.sql.pandas.types import to_arrow_schema

            with open(partition.path, "rb") as f:
                source = Windowed(f, os.path.getsize(partition.path))
                yield from to_batches(frames_of(framer, source, os.path.basename(partition.path)), to_arrow_schema(schema))

    class FramesSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> T.StructType:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(self.options)

    return FramesSource
