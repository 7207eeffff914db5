"""Publication with gates: everything is staged, the gates are asked, then one pointer moves.

A version is a set of parts, each in a folder of its own. Readers follow the newest row set of the
``published`` table, which is appended by one small file after all parts are written: until then, and
whenever a gate or a write fails, they go on reading the version before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.operators import snapshots
from courseloom.operators.calendar import period_frame
from courseloom.plans.catalog import meta
from courseloom.plans.side import keep_if_empty
from courseloom.sources import sinks

POINTER = "v int, part string, folder string"


@dataclass
class Part:
    """A frame and how it is written to a folder. A ``guarded`` part without rows keeps the folder of
    the version before, so that a source that failed doesn't empty what it fed."""

    frame: DataFrame
    write: Callable[[DataFrame, str], None] = sinks.write_json
    guarded: bool = False


class Publication:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def history(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/published")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], POINTER)
        return self.spark.read.schema(POINTER).parquet(f"{self.path}/published")

    def current(self) -> tuple[int, dict[str, str]]:
        """Number of the version that readers see, and its parts' folders; 0 and none before the first."""
        known = self.history()
        last = known.agg(F.max("v")).first()[0] or 0
        return last, {r["part"]: r["folder"] for r in known.where(F.col("v") == last).collect()}

    def folder(self, part: str) -> str:
        return f"{self.path}/{self.current()[1][part]}"

    def publish(self, parts: dict[str, Part], gates: Iterable[Callable[[], None]] = ()) -> list[str]:
        """Stage all parts, ask the gates (each raises to stop) before and after, and move the pointer;
        the parts that were kept from the version before are returned."""
        for gate in gates:
            gate()
        last, before = self.current()
        folders, kept = {}, []
        for name, part in parts.items():
            folder = f"v={last + 1}/{name}"
            write = partial(self._replace, part, folder)
            if not part.guarded or name not in before:
                write(part.frame)
            elif not keep_if_empty(part.frame, write):
                folder = before[name]
                kept.append(name)
            folders[name] = folder
        for gate in gates:                              # a body may have landed while the parts were written
            gate()
        rows = [(last + 1, name, folder) for name, folder in folders.items()]
        self.spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        return kept

    def _replace(self, part: Part, folder: str, frame: DataFrame) -> None:
        """What a version that was never published left in the folder is replaced."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        part.write(frame, f"{self.path}/{folder}")


def site_meta(catalog: DataFrame, missing: DataFrame, calendar: dict[str, DataFrame], year: int, undergrad_only: bool, detail_url: str,
              calendar_source: str | None = None) -> DataFrame:
    """The one-row document of ``catalog.meta`` with the calendar (NULL for a year without one), the
    template of detail pages, and the names of the parts with details and missing titles.

    The calendar is bounded by its year's days and faculties, and is part of the document; the missing
    titles grow with the sources, so they are a part of their own, and the document has their number.
    """
    spark = catalog.sparkSession
    days = calendar["days"].agg(F.array_sort(F.collect_list(F.struct("faculty", "term", "weekday", "dates"))).alias("days"))
    checked = calendar["checked"].agg(F.array_sort(F.collect_list(F.struct("faculty", "differs", "note"))).alias("checked"))
    times = period_frame(spark).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("period", F.array("starts", "ends").alias("times"))))).alias("periods"))
    one = F.lit(1)
    whole = days.withColumn("_k", one).join(checked.withColumn("_k", one), "_k").join(times.withColumn("_k", one), "_k")
    source = F.lit(calendar_source).cast("string").alias("source")
    whole = whole.select("_k", F.when(F.size("days") > 0, F.struct("days", "checked", "periods", source)).alias("calendar"))
    doc = meta(catalog, missing, year, undergrad_only).withColumn("_k", one).join(whole, "_k").drop("_k")
    return doc.withColumns({"detail_url": F.lit(detail_url), "detail_part": F.lit("details"), "missing_part": F.lit("missing"),
                            "detail_columns": F.array(*map(F.lit, V.DETAIL_COLUMNS))})


def publish_site(site: Publication, catalog: DataFrame, raw: DataFrame, structured: DataFrame, missing: DataFrame, calendar: dict[str, DataFrame],
                 year: int, detail_url: str, undergrad_only: bool = True, key: list[str] = snapshots.KEY, calendar_source: str | None = None) -> list[str]:
    """Publish lists, detail shards, the document and the missing titles of a year, unless a text is
    newer than what was derived from it. Without any missing title those published before stay."""
    courses, details = sinks.split_details(catalog)
    listed = missing
    if "missing" in site.current()[1] and missing.isEmpty():
        listed = site.spark.read.schema(missing.schema).json(site.folder("missing"))
    return site.publish({
        "courses": Part(courses),
        "details": Part(details, sinks.write_shards),
        "meta": Part(site_meta(catalog, listed, calendar, year, undergrad_only, detail_url, calendar_source)),
        "missing": Part(missing, guarded=True),
    }, [lambda: snapshots.assert_fresh(raw, structured, key)])
