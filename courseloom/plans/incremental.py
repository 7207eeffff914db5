"""Structured courses kept up to date: only bodies whose hash changed are extracted again.

The rows lie in versions: a run appends the rows it extracted, the keys that these replace or that
are gone, and new counts; a small commit row written last makes them valid. The counts of categories
and of list members are corrected by signed deltas, so no run counts the whole table again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions import fields as FL
from courseloom.functions.text import exploded, text_or_empty
from courseloom.operators.facets import fold_values, prune_rare
from courseloom.plans.extraction import KEY, NESTED, STRUCTURED, structure_rows

COMMIT = "v int, base int, n_extracted bigint, n_gone bigint"
SHA = "extracted_sha256"


def undergrad() -> Column:
    return F.coalesce(F.col("is_undergrad") == 1, F.lit(False))


def category_rows(rows: DataFrame) -> DataFrame:
    """What the fold of rare categories counts: one row for each undergraduate course that has one."""
    return rows.where(undergrad() & F.col("category").isNotNull()).select("category")


def member_rows(rows: DataFrame) -> DataFrame:
    """What the pruning of rare list members counts: (f, member), once for each place in a course's list."""
    faculty = text_or_empty("faculty")
    listed = rows.where(undergrad()).select(faculty.alias("f"), FL.departments(faculty, "faculty_raw").alias("dp"))
    return exploded(listed, ["f"], F.col("dp"), "member")


COUNTED = {"categories": category_rows, "members": member_rows}


class Derived:
    """The table of structured courses under ``path``, derived from raw bodies."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _folder(self, part: str, v: int | None = None) -> str:
        return f"{self.path}/{part}" + ("" if v is None else f"/v={v}")

    def _exists(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def commits(self) -> DataFrame:
        return self.spark.read.schema(COMMIT).parquet(self._folder("commits"))

    def _last(self) -> tuple[int, int] | None:
        """Number and base of the newest version: the base and what follows it make up the table."""
        if not self._exists(self._folder("commits")):
            return None
        last = self.commits().agg(F.max(F.struct("v", "base")).alias("c")).first()["c"]
        return last and (last["v"], last["base"])

    def _write(self, df: DataFrame, part: str, v: int) -> DataFrame:
        """A part of a version that isn't committed yet; a repeated run replaces it."""
        folder = self._folder(part, v)
        df.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def _commit(self, v: int, base: int, n_extracted: int, n_gone: int) -> None:
        self.spark.createDataFrame([(v, base, n_extracted, n_gone)], COMMIT).coalesce(1).write.mode("append").parquet(self._folder("commits"))

    def rows(self, *columns: str) -> DataFrame:
        """The current rows, or some columns of them, categories not folded.

        A row counts if no later version names its key. The keys of later versions are few; by their
        size the planner broadcasts them, and the rows aren't shuffled.
        """
        v, base = self._last()
        wanted = [F.col(c) for c in (columns or (*STRUCTURED, *NESTED))]
        out = self.spark.read.parquet(self._folder("rows", base)).select(*wanted, *self._hidden(columns))
        for n in range(base + 1, v + 1):
            keys = self.spark.read.parquet(self._folder("keys", n)).select(*KEY)
            fresh = self.spark.read.parquet(self._folder("rows", n)).select(*wanted, *self._hidden(columns))
            out = out.join(keys, KEY, "left_anti").unionByName(fresh)
        return out.select(*[c for c in (columns or (*STRUCTURED, *NESTED))])

    @staticmethod
    def _hidden(columns: tuple[str, ...]) -> list[str]:
        return [k for k in KEY if columns and k not in columns]

    def counts(self, part: str) -> DataFrame:
        return self.spark.read.parquet(self._folder(part, self._last()[0]))

    def update(self, raw: DataFrame) -> None:
        """Bring the table up to ``raw`` (key, body, layout, body_sha256; one row a key).

        Hashes are compared by key and read without the texts; bodies are read for the keys that
        changed or are new, and the old rows of changed and removed keys for what they were counted by.
        """
        last = self._last()
        if last is None:
            rows = self._write(structure_rows(raw), "rows", 0)
            for part, counted in COUNTED.items():
                found = counted(rows)
                self._write(found.groupBy(*found.columns).agg(F.count("*").alias("n")), part, 0)
            self._commit(0, 0, rows.count(), 0)
            return
        v, base = last[0] + 1, last[1]
        have = self.rows(*KEY, SHA).withColumn("_had", F.lit(True))
        want = raw.select(*KEY, "body_sha256").withColumn("_is", F.lit(True))
        changed = want.join(have, KEY, "full").where("_is IS NULL OR _had IS NULL OR body_sha256 IS DISTINCT FROM " + SHA)
        keys = self._write(changed.select(*KEY, F.col("_is").isNull().alias("gone")), "keys", v)
        fresh = self._write(structure_rows(raw.join(keys.where("NOT gone"), KEY, "left_semi")), "rows", v)
        gone = self.rows(*KEY, "category", "is_undergrad", "faculty", "faculty_raw").join(keys, KEY, "left_semi")
        for part, counted in COUNTED.items():
            before, more, less = self.counts(part), counted(fresh), counted(gone)
            by = more.columns
            deltas = before.unionByName(more.withColumn("n", F.lit(1))).unionByName(less.withColumn("n", F.lit(-1)))
            self._write(deltas.groupBy(*by).agg(F.sum("n").alias("n")).where("n > 0"), part, v)
        self._commit(v, base, fresh.count(), keys.where("gone").count())

    def compact(self) -> None:
        """Make the current rows the base of a new version, so that reading takes no join."""
        v = self._last()[0]
        self._write(self.rows(), "rows", v + 1)
        for part in COUNTED:
            self._write(self.counts(part), part, v + 1)
        self._commit(v + 1, v + 1, 0, 0)

    def structured(self, least: int = V.CATEGORY_MIN_COUNT) -> DataFrame:
        """The current rows with rare categories folded, by the stored counts."""
        rare = self.counts("categories").where(F.col("n") < least).select("category")
        return fold_values(self.rows(), rare, "category", undergrad()).select(*STRUCTURED, *NESTED)

    def pruned(self, catalog: DataFrame, key: str = "c", group: str = "f", items: str = "dp", least: int = V.DEPARTMENT_MIN_COUNT) -> DataFrame:
        """Catalog records without rare list members, by the stored counts."""
        keep = self.counts("members").where(F.col("n") >= least).select(F.col("f").alias("_g"), F.col("member").alias("_m"))
        return prune_rare(catalog, key, group, items, least, keep)
