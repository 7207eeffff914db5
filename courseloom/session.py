"""Session settings and steps written to the shared folder."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings a catalog job wants; each is left alone where the cluster already set it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # a generated method above 8,000 bytes is never compiled by the JVM: plans with many
    # columns run faster in several small methods than in one huge one
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # landed Shift_JIS pages: the JVM's own charsets, bytes they lack are replaced
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
}


def local_session(cpus: str = "*", app: str = "courseloom", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.driver.memory", "12g")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false"))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers started from another folder import this package, where it isn't installed."""
    root = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only in local
    tests, where none is named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="courseloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def run_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; what is in it goes when the driver ends."""
    path = f"{shared_folder(spark)}/courseloom/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_remove, spark, path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in this application's folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:             # a stopped session can't reach the store any more
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


SPREAD_ROWS = 50_000        # rows of a spread table in a task, about


def spread(df: DataFrame) -> DataFrame:
    """Give a scan to all cores, in tasks that don't grow with the table: a scan's splits grow up to
    128 MB of packed rows, too many for work that is heavy on each row. The rows are counted from the
    files' footers; a scan with enough splits is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // SPREAD_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def fixed_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A frame of fixed values whose size the planner knows (a local list has none)."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    fields = ",".join(c.strip().replace(" ", ":", 1) for c in schema.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a step's result once to the shared folder and go on from the files.

    Later steps read it as often as they like without computing it again, lost executors
    cost nothing but their tasks, and the planner knows the table's real size: it broadcasts
    a small one and shuffles a large one.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
