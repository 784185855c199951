"""Container formats: probing, planning of batches, and readers that turn files into frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from binframe.sources import archive, pcap, smf
from binframe.sources.framing import COMMON, Framer, Memory, data_source, frames_of, read_frames, to_batches

HEAD = 4096


@dataclass(frozen=True)
class Format:
    """magic: (offset, bytes, confidence); the best confidence above 0 wins, the first registered of equals."""

    name: str
    framer: Framer
    fields: list[T.StructField] = field(hash=False)
    magic: tuple[tuple[int, bytes, float], ...] = ()

    def confidence(self, head: bytes) -> float:
        found = max((c for at, m, c in self.magic if head[at : at + len(m)] == m), default=0.0)
        if self.name == "capture" and head[:4] == b"\x0a\x0d\x0d\x0a":
            return 1.0 if head[8:12] in (b"\x1a\x2b\x3c\x4d", b"\x4d\x3c\x2b\x1a") else 0.0
        return found


FORMATS = (
    Format("midi", smf.read_smf, smf.FIELDS, ((0, b"MThd", 1.0),)),
    Format("capture", pcap.read_capture, pcap.FIELDS, tuple((0, m.to_bytes(4, "big"), 1.0) for m in pcap.MAGIC)),
    Format("zip", archive.read_zip, archive.FIELDS, ((0, b"PK\3\4", 1.0), (0, b"PK\5\6", 0.9))),
)


def probe(head: bytes) -> Format | None:
    """The format of a file's first bytes."""
    best = max(FORMATS, key=lambda f: f.confidence(head[:HEAD]))
    return best if best.confidence(head[:HEAD]) > 0 else None


def unique_names(names: list[str]) -> list[str]:
    """Display names; a repeated one gets a number before its extension."""
    seen: set[str] = set()
    out = []
    for name in names:
        stem, dot, ext = name.rpartition(".")
        stem, ext = (stem, dot + ext) if stem else (name, "")
        k, new = 1, name
        while new in seen:
            k += 1
            new = f"{stem} ({k}){ext}"
        seen.add(new)
        out.append(new)
    return out


def plan_batch(heads: list[tuple[str, bytes, int]]) -> list[dict]:
    """Rows of _files: the first file that is recognized elects the format, files of others are skipped with a reason."""
    names = unique_names([n for n, _, _ in heads])
    elected = next((f for f in (probe(h) for _, h, _ in heads) if f), None)
    out = []
    for order, (name, (original, head, size)) in enumerate(zip(names, heads, strict=True)):
        found = probe(head)
        why = None if found and found is elected else f"is {found.name}, not {elected.name}" if found else "format not recognized"
        out.append({"file": name, "original_name": original, "size": size, "ingest_order": order, "status": "skipped" if why else "ok", "error": why})
    return out


FILES = "file string, original_name string, size bigint, ingest_order int, status string, error string"


def files_catalog(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """_files of the files at ``paths``; executors read the heads only, one row for each file comes to the driver."""
    found = spark.read.format("binaryFile").load(paths).select("path", "length").orderBy("path").collect()
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    rows = []
    for r in found:
        at = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        stream = at.getFileSystem(hadoop).open(at)
        try:
            rows.append((r.path.rpartition("/")[2], bytes(stream.readNBytes(HEAD)), r.length))
        finally:
            stream.close()
    return spark.createDataFrame([tuple(p.values()) for p in plan_batch(rows)], FILES)


def frames_of_files(files: DataFrame, f: Format) -> DataFrame:
    """Frames of files given as (name, content)."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(COMMON + f.fields)
    arrow, framer = to_arrow_schema(schema), f.framer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if data.is_valid:
                    yield from to_batches(frames_of(framer, Memory(data.as_py()), name), arrow)

    return files.mapInArrow(run, schema)


def frames(spark: SparkSession, paths: str | list[str], name: str) -> DataFrame:
    """Frames of all files at ``paths`` in the named format."""
    f = next(f for f in FORMATS if f.name == name)
    return read_frames(spark, paths, f.framer, f.fields)


def register(spark: SparkSession) -> None:
    """Register the readers as data sources binframe_midi, binframe_capture and binframe_zip."""
    for f in FORMATS:
        spark.dataSource.register(data_source(f"binframe_{f.name}", f.framer, f.fields))
