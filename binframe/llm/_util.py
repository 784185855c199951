"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside a Python worker; larger Arrow batches are cut.
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch on its way to a worker; Spark would send ten thousand rows of whole texts at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


#: What modules keep in a worker between tasks: how to let go of it.
_KEPT: dict[str, Callable[[], None]] = {}
_AT: list[str] = []


def keeps(module: str, clear: Callable[[], None]) -> None:
    """Tell that ``module`` keeps something in workers, and how to let go of it."""
    _KEPT[module] = clear


def enter(module: str) -> None:
    """A task of ``module`` begins: what other modules kept in this worker goes, so that stages don't add up their caches."""
    if _AT == [module]:
        return
    _AT[:] = [module]
    for other, clear in _KEPT.items():
        if other != module:
            clear()
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of text (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(text)
    if col.nbytes <= 2 * limit:
        yield batch
        return
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    start = size = 0
    for i, k in enumerate(sizes):
        if size and size + k > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += k
    yield batch.slice(start)


def small_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches by bytes; a smaller bound of its own stays."""
    now = str(spark.conf.get(_BATCH, None) or "")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    fields: list[T.StructField],
    text: str = "text",
    keep: list[str] | None = None,
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Append columns computed from whole texts, batch by batch, without a shuffle.

    ``make`` builds, once per task, a function from the Arrow array of texts to the new columns. ``keep`` names the
    columns to carry (default: all). A carried column with the name of a new one is replaced by the new one.
    """
    small_batches(df.sparkSession)
    new = {f.name for f in fields}
    carry = [c for c in (df.columns if keep is None else keep) if c not in new]
    hidden = "__text"
    while hidden in df.columns:
        hidden += "_"
    frame = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").cast("string").alias(hidden))
    schema = T.StructType([frame.schema[c] for c in carry] + fields)
    types, owner = [_arrow(f) for f in fields], make.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        fn = make()
        for batch in batches:
            for part in slices(batch, hidden, limit):
                out = fn(part.column(hidden))
                cols = [part.column(c) for c in carry] + [a if a.type == t else a.cast(t) for a, t in zip(out, types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, [*carry, *(f.name for f in fields)])

    return frame.mapInArrow(run, schema)


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def fold(id_col: str, of: int):
    """crc32 of the id as text, modulo ``of``: the fold of a row."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(of))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where the session has none and all runs on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        import tempfile

        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not jvm.isDefined() and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = jvm.get() if jvm.isDefined() else f"file://{tempfile.gettempdir()}/binframe-checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def spill(df: DataFrame, label: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts the lineage and survives a lost executor."""
    import uuid

    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.spilled_to = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the table of a frame that ``spill`` returned, once nothing reads it any more; other frames are left alone."""
    path = getattr(df, "spilled_to", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
