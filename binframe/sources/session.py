"""Files to columnar tables: each is decoded once into Parquet, a directory to a file, and queried through views.

A load is written beside what is there and becomes visible at once, when all views are pointed at it. A file that can't be read
leaves no rows, only its line in ``_files``; one that is no longer wanted goes with its directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from binframe import sources
from binframe.operators import dissect, flows, results

_MIDI = {"header": ("kind = 'header'", ["format", "num_tracks", "division"]), "events": ("kind = 'event' and event <> 'meta'", ["track", "event_index", "delta_time", "tick", "event", "channel", "note", "velocity", "controller", "value", "program", "pressure", "bend"]), "tempo": ("us_per_quarter is not null", ["track", "tick", "us_per_quarter"])}
_ZIP = {"local_files": ("kind = 'local_file'", ["version_needed", "flags", "compression_method", "compression", "crc32", "compressed_size", "uncompressed_size", "mod_time_us", "file_name", "extra_len"]), "central_dir_entries": ("kind = 'central_dir_entry'", ["version_made_by", "version_needed", "flags", "compression_method", "compression", "crc32", "compressed_size", "uncompressed_size", "mod_time_us", "file_name", "extra_len", "disk_start", "internal_attrs", "external_attrs", "ofs_local_header", "comment"]), "end_of_central_dir": ("kind = 'eocd'", ["num_entries", "central_dir_size", "ofs_central_dir", "comment"])}
_KEYS = {"header": "header_id", "events": "event_id", "tempo": "tempo_id", "local_files": "local_file_id", "central_dir_entries": "central_dir_id", "end_of_central_dir": "eocd_id"}


def frame_tables(rows: DataFrame, name: str) -> dict[str, DataFrame]:
    """Tables of songs or archives from their frames, with dense keys in each file, and their errors."""
    by_file = lambda key: F.row_number().over(Window.partitionBy("_src_file").orderBy("ordinal")).cast("long").alias(key)
    out = {t: rows.where(which).select(by_file(_KEYS[t]), *columns, "_src_start", "_src_end", "_src_file") for t, (which, columns) in (_MIDI if name == "midi" else _ZIP).items()}
    record = F.col("track").cast("int").alias("track") if name == "midi" else F.lit(None).cast("int").alias("record")
    out["errors"] = rows.where("kind in ('issue', 'fatal')").select(by_file("error_id"), "stage", record, "code", "message", "recoverable", "_src_start", "_src_end", "_src_file")
    return out


def parquet_scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One table of the Parquet files at an explicit list of paths."""
    if not paths:
        raise ValueError("no paths")
    return spark.read.parquet(*paths)


class Session:
    """Loaded files as views; ``root`` is a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.path, self.format, self.views = spark, root.rstrip("/"), None, None, []
        self.files: list[dict] = []

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _remove(self, path: str) -> None:
        at, fs = self._fs(path)
        fs.delete(at, True)

    def load(self, files: str | list[str] | DataFrame, name: str | None = None) -> None:
        """Load all files of one format in place of what was loaded before.

        files: paths, or a table (name, content). name: the format; by default the first file that is recognized elects it.
        Should the load fail as a whole, what was loaded before stays as it was.
        """
        if not isinstance(files, DataFrame):
            files = self.spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
        heads = files.select("name", F.substring("content", 1, sources.HEAD).alias("head"), F.length("content").alias("size"))
        # A line for each file comes to the driver, as the catalog has one.
        plan = sources.plan_batch([(r.name, bytes(r["head"]), r["size"]) for r in heads.orderBy("name").collect()])
        found = name or next((f.name for f in (sources.probe(bytes(r["head"])) for r in heads.orderBy("name").toLocalIterator()) if f), None)
        if found is None:
            raise ValueError("no file is in a known format")
        path = f"{self.root}/load-{uuid.uuid4().hex}"
        wanted = files.join(F.broadcast(self.spark.createDataFrame([(p["original_name"],) for p in plan if p["status"] == "ok"] or [(None,)], "name string").distinct()), "name")
        if found == "capture":
            rows = dissect.decode(wanted.select("name", "content"))
        else:
            f = next(f for f in sources.FORMATS if f.name == found)
            rows = sources.frames_of_files(wanted.select("name", "content"), f)
        try:
            rows.write.option("compression", "zstd").partitionBy("_src_file").parquet(path)
            stored = self._read(path, rows.schema)
            fatal = {r._src_file: r.code for r in stored.where("kind = 'fatal'").select("_src_file", "code").collect()}
        except Exception:
            self._remove(path)
            raise
        for p in plan:
            if p["original_name"] in fatal:
                p |= {"status": "failed", "error": fatal[p["original_name"]]}
                self._remove(f"{path}/_src_file={p['original_name']}")
        old, self.path, self.format, self.files, self.schema = self.path, path, found, plan, rows.schema
        self._swap()
        if old:
            self._remove(old)

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def rows(self) -> DataFrame:
        """All decoded rows."""
        return self._read(self.path, self.schema)

    def tables(self) -> dict[str, DataFrame]:
        """Every table of the format; one without rows has its columns all the same."""
        out = dissect.capture_tables(self.rows()) if self.format == "capture" else frame_tables(self.rows(), self.format)
        if self.format == "capture":
            fed = flows.flow_rows(dissect.segments(self.rows()))
            messages = flows.messages(fed)
            beneath = flows.message_tables(messages)
            out |= {"streams": flows.streams(fed), "stream_segments": flows.stream_segments(fed), "tls": beneath["tls"]}
            dense = F.row_number().over(Window.partitionBy("_src_file").orderBy("packet_id", F.coalesce("stream_id", F.lit(0)), "_src_start")).cast("long")
            out["dns"] = out["dns"].withColumn("_src_ranges", F.lit(None).cast(beneath["dns"].schema["_src_ranges"].dataType)).unionByName(beneath["dns"]).withColumn("dns_id", dense)
        return out | {"_files": self.spark.createDataFrame([tuple(p.values()) for p in self.files], sources.FILES)}

    def _swap(self) -> None:
        new = self.tables()
        for name, df in new.items():
            df.createOrReplaceTempView(name)
        for name in set(self.views) - set(new):
            self.spark.catalog.dropTempView(name)
        self.views = list(new)

    def discard(self, file: str) -> None:
        """Take one file's rows back; all other files stay."""
        self._remove(f"{self.path}/_src_file={file}")
        self.files = [p | {"status": "discarded"} if p["original_name"] == file else p for p in self.files]
        self._swap()

    def query(self, text: str) -> DataFrame:
        """A query over the views; nothing else is run."""
        return results.run_sql(self.spark, text)

    def close(self) -> None:
        for name in self.views:
            self.spark.catalog.dropTempView(name)
        if self.path:
            self._remove(self.path)
        self.path, self.views = None, []


def shared_root(spark: SparkSession) -> str:
    """A folder for loads: that of checkpoints where the session names one; a temporary one only where all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        import tempfile

        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/binframe-loads"
    return path

