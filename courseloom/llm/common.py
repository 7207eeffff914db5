"""What the operators of this subpackage share: tables, steps in the shared folder, components."""

from __future__ import annotations

import functools
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courseloom.session import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def importable(spark: SparkSession) -> None:
    """Let Python workers started from another folder import this package, where it isn't
    installed: their PYTHONPATH gets the folder that holds it."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, under this application's folder, which goes when the
    driver ends."""
    return new_folder(spark, name)


def step(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and go on from its files: it is computed once, lineage
    ends there, and a lost executor costs its running tasks only."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_step(df: DataFrame) -> None:
    """Delete the files of a step which nothing will read again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), a > b, of long nodes: (node, root), where root is
    the component's smallest node; nodes without a link are left out.

    Alternating large-star and small-star rounds: every round hangs each node under the smallest
    node it knows of, so the rounds grow with the logarithm of the component, not with its
    diameter. A round is aggregations and equi-joins over written tables; a hub is an aggregate
    with map-side combining on one side of a join and, on the other, a shuffled file scan that
    adaptive execution splits. No link reaches the driver, only a count and a checksum do.
    """
    edges = step(edges.select("a", "b").distinct(), "links")
    seen = _signature(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = step(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = step(both.filter("v > u").join(least, "u").filter("v > m")
                     .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        under = step(large.groupBy("a").agg(F.min("b").alias("m")), "under")
        small = step(large.join(under, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .union(under.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = _signature(small)
        for old in (edges, least, large, under):
            drop_step(old)
        edges = small
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    """Row count and an order-free checksum of a set of links."""
    mixed = F.shiftright(F.xxhash64("a", "b"), 24)
    return tuple(edges.agg(F.count("*"), F.sum(mixed), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first())
