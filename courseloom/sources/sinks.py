"""Outputs: partitioned tables, CSV, JSON, documents, detail shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.fields import csv_cell, embeddable, shard_of

BOM = "﻿"


def write_year(df: DataFrame, path: str, keys=("university_id", "year")) -> None:
    """Replace only the years that the frame holds; a failed write leaves the old rows."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def guard_text(df: DataFrame) -> DataFrame:
    """Text cells guarded against formulas; numbers as they are."""
    return df.select(*[csv_cell(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """Header line even for no rows; the header starts with a byte-order mark."""
    out = guard_text(df)
    out = out.withColumnRenamed(out.columns[0], BOM + out.columns[0])
    if not df.take(1):
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def is_default(column: str, kind: str) -> Column:
    """Is the detail at its default (empty text or list, all-zero flags, NULL)?"""
    c = F.col(column)
    if kind.startswith("array<int"):
        return c.isNull() | F.forall(c, lambda x: x == 0)
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def split_details(catalog: DataFrame, code: str = "c", details=V.DETAIL_COLUMNS, shards: int = V.SHARDS) -> tuple[DataFrame, DataFrame]:
    """(list frame, detail frame). Defaults are not stored; a course with none is left out."""
    types = dict(catalog.dtypes)
    cols = [c for c in details if c in types]
    kept = [F.when(~is_default(c, types[c]), F.col(c)).alias(c) for c in cols]
    det = catalog.select(code, *kept)
    any_ = F.lit(False)
    for c in cols:
        any_ = any_ | F.col(c).isNotNull()
    det = det.where(any_).select(shard_of(code, shards).alias("shard"), code, F.to_json(F.struct(*cols)).alias("detail"))
    return catalog.drop(*cols), det


def write_shards(details: DataFrame, path: str, shards: int = V.SHARDS, files_per_shard: int = 1) -> None:
    """One folder per shard; old shards are replaced as a whole.

    A shard is written by ``files_per_shard`` tasks: raise it with the data so that no task
    writes more than it should.
    """
    salt = F.pmod(F.xxhash64(details.columns[1]), F.lit(files_per_shard))
    (details.repartition(shards * files_per_shard, "shard", salt).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy("shard").json(path))


def payload(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as compact JSON that is safe to embed in a page."""
    return df.select(embeddable(F.to_json(F.struct(*df.columns))).alias(out))


def write_document(catalog: DataFrame, meta: DataFrame, path: str) -> None:
    """Courses as JSON lines next to a one-row meta document."""
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    catalog.write.mode("overwrite").json(f"{path}/courses")
