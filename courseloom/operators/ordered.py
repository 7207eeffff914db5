"""Ordered scans over long keys: running counts, fill-down, previous value, runs.

A plain window puts a whole key into one task. Here a key is cut into chunks of its
position, each chunk is scanned on its own, and only one summary row per chunk is carried
from chunk to chunk. A key with a third of all rows is thus spread over many tasks; the
carry window sees rows / chunk summary rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def _chunks(df: DataFrame, pos: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(pos) / F.lit(chunk)))


def _before(keys) -> Window:
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _carried(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the carry of their chunk. NULL is a key like any other, and so is a NULL position,
    whose rows form a chunk of their own before all others."""
    on = None
    right = summary.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate([*keys, "_chunk"])], "_carry")
    for i, k in enumerate([*keys, "_chunk"]):
        same = df[k].eqNullSafe(right[f"_r{i}"])
        on = same if on is None else on & same
    return df.join(right, on).drop(*[f"_r{i}" for i in range(len(keys) + 1)])


def running_count(df: DataFrame, keys: list[str], pos: str, flag: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """How many flagged rows stand at or before each row of its key.

    ``pos`` is a whole number, unique within the key.
    """
    df = _chunks(df.withColumn("_flag", flag.cast("int")), pos, chunk)
    sums = df.groupBy(*keys, "_chunk").agg(F.sum("_flag").alias("_n"))
    sums = sums.withColumn("_carry", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0))).drop("_n")
    here = Window.partitionBy(*keys, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (_carried(df, sums, keys)
            .withColumn(out, F.col("_carry") + F.sum("_flag").over(here)).drop("_flag", "_carry", "_chunk"))


def fill_down(df: DataFrame, keys: list[str], pos: str, value: Column, out: str,
              strict: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Last non-NULL value at or before each row (``strict``: before it)."""
    df = _chunks(df.withColumn("_value", value), pos, chunk)
    every = df.groupBy(*keys, "_chunk").agg(F.max(F.when(F.col("_value").isNotNull(), F.struct(
        F.col(pos).alias("p"), F.col("_value").alias("v")))).alias("_last"))
    every = every.withColumn("_carry", F.last("_last", ignorenulls=True).over(_before(keys))["v"]).drop("_last")
    here = (Window.partitionBy(*keys, "_chunk").orderBy(pos)
            .rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    return (_carried(df, every, keys)
            .withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(here), F.col("_carry")))
            .drop("_value", "_carry", "_chunk"))


def previous_value(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """Value of the closest earlier row whose value is not NULL."""
    return fill_down(df, keys, pos, value, out, strict=True, chunk=chunk)


def runs(df: DataFrame, keys: list[str], pos: str, starts: Column, out: str = "run_no", chunk: int = CHUNK) -> DataFrame:
    """Run number of each row; a run starts at each flagged row, rows before the first are run 0."""
    return running_count(df, keys, pos, starts, out, chunk)


def first_by(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """First row of each key in an explicit order, as a partial aggregate (no window)."""
    picked = F.min(F.struct(*order, *[v for v in values if v not in order])).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_first.{v}").alias(v) for v in values])
