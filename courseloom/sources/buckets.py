"""Stored tables in buckets of their key, which are joined without moving a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courseloom.operators.joins import KEY

BUCKETS = 64


def store(df: DataFrame, name: str, folder: str, key: list[str] = KEY, buckets: int = BUCKETS) -> DataFrame:
    """Write a table in buckets of its key, sorted by it, and read it back.

    Raw texts, structured rows and index are stored with the same key and number of buckets: a join on
    the key then reads bucket by bucket, and neither side is shuffled. Raise ``buckets`` with the data,
    for all tables at once. A task writes as many files as it has buckets, so the rows are dealt out
    by the key first, and every bucket is one file.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key)
     .option("path", folder).format("parquet").saveAsTable(name))
    return stored(spark, name)


def stored(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
