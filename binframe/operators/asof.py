"""As-of joins and the other relational operators that Spark SQL lacks, from windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, *, by: list[str] | None = None, how: str = "inner", ties: list[str] | None = None) -> DataFrame:
    """Join each left row with the last right row at or before it.

    Both sides are put together and the last right row is carried along a window: one shuffle on ``by``, no pairs. Without
    ``by`` there is one order for all rows, and it goes through one task; ``asof_join_ranged`` cuts it into ranges. Of right rows at
    one time the last by ``ties`` (default: all columns) counts. Null times match nothing. Columns of the right side must not be
    named like those of the left, but for ``by``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how: {how}")
    by = by or []
    payload = [c for c in right.columns if c not in by]
    order_ties = ties or payload
    tag, time, row, key = "__side", "__time", "__right", "__ties"
    keys = lambda d: [F.col(f"`{c}`") for c in by]
    l_ = left.select(*keys(left), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"), F.col(f"`{left_time}`").alias(time), F.lit(1).alias(tag))
    r_ = right.where(F.col(f"`{right_time}`").isNotNull()).select(*keys(right), F.struct(*[F.col(f"`{c}`") for c in payload]).alias(row), F.struct(*[F.col(f"`{c}`") for c in order_ties]).alias(key), F.col(f"`{right_time}`").alias(time), F.lit(0).alias(tag))
    both = l_.unionByName(r_, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(time).asc_nulls_first(), F.col(tag), F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(row, F.last(row, ignorenulls=True).over(w)).where(F.col(tag) == 1)
    found = found.withColumn(row, F.when(F.col(time).isNotNull(), F.col(row)))
    if how == "inner":
        found = found.where(F.col(row).isNotNull())
    return found.select(*[F.col(f"__left.`{c}`") for c in left.columns], *[F.col(f"{row}.`{c}`") for c in payload])


def asof_join_ranged(left: DataFrame, right: DataFrame, left_time: str, right_time: str, *, how: str = "inner", ranges: int = 64) -> DataFrame:
    """As ``asof_join`` without ``by``, dealt by ranges of time; each range gets the last right row before it.

    Bounds and carried rows number ``ranges`` at most, however many rows there are.
    """
    def number(c: str) -> Column:
        kind = {**dict(right.dtypes), **dict(left.dtypes)}[c]
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{c}`)").cast("double") if kind == "timestamp_ntz" else F.col(c).cast("double")

    span = left.agg(F.percentile_approx(number(left_time), [k / ranges for k in range(1, ranges)], 1000).alias("b")).first()["b"]
    bounds = sorted(set(span or []))
    if not bounds:
        return asof_join(left, right, left_time, right_time, how=how)
    place = lambda c: F.size(F.filter(F.lit(bounds), lambda b: b <= number(c)))
    payload = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    r_ = right.where(F.col(right_time).isNotNull()).withColumn("__range", place(right_time))
    last = r_.groupBy("__range").agg(F.max_by(payload, F.struct(F.col(right_time), payload)).alias("row"))
    targets = last.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("to"))
    carried = last.join(targets, F.col("to") > F.col("__range")).groupBy("to").agg(F.max_by("row", "__range").alias("row"))
    extra = carried.select(F.col("to").alias("__range"), "row.*")
    return asof_join(left.withColumn("__range", F.when(F.col(left_time).isNotNull(), place(left_time)).otherwise(-1)), r_.unionByName(extra), left_time, right_time, by=["__range"], how=how).drop("__range")


def qualify(df: DataFrame, window: Column, keep) -> DataFrame:
    """Rows for which ``keep(value of the window expression)`` holds: QUALIFY as a projection and a filter."""
    return df.withColumn("__q", window).where(keep(F.col("__q"))).drop("__q")


def nulls_last(*columns: str | Column, descending: bool = False) -> list[Column]:
    """Sort keys with nulls behind in either direction."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in cols]
