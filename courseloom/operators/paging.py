"""Result pages by seeking: the catalog lies sorted in files, and a page opens the files that hold it.

Rows are cut by ranges of their place in the rank order and sorted inside each file. A table of one
row a file says which places and how many rows it holds, so that a page far down costs what the first
one costs: neither the rows nor the files before it are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

PAGE = 300


def place(column: str, order: list[str], code: str) -> Column:
    """Where a row stands: values in a fixed order first, then the others by text; then by code."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(column)).cast("int"), F.lit(0))
    return F.struct((rank == 0).alias("late"), rank.alias("rank"), F.when(rank == 0, F.coalesce(column, F.lit(""))).otherwise("").alias("text"), F.col(code).alias("code"))


class RankedPages:
    """A catalog under ``path``, sorted for its result pages."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def build(self, catalog: DataFrame, column: str, order: list[str], code: str, files: int | None = None) -> "RankedPages":
        n = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = catalog.withColumn("_place", place(column, order, code))
        placed.repartitionByRange(n, "_place").sortWithinPartitions("_place").write.mode("overwrite").parquet(f"{self.path}/rows")
        held = self.spark.read.schema(placed.schema).parquet(f"{self.path}/rows").groupBy(F.input_file_name().alias("file")).agg(
            F.min("_place").alias("lo"), F.max("_place").alias("hi"), F.count("*").alias("n"))
        # one row a file
        held = held.withColumn("start", F.sum("n").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        held.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/files")
        return self

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def _rows(self, names: list[str]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def page(self, number: int, size: int = PAGE) -> DataFrame:
        """Page ``number``, from 0, in order, by the rows that files before it hold."""
        begin = number * size
        held = self.files().where((F.col("start") < begin + size) & (F.col("start") + F.col("n") > begin)).orderBy("start").collect()
        rows = self._rows([r["file"] for r in held])
        return rows.orderBy("_place").offset(begin - held[0]["start"] if held else 0).limit(size)

    def after(self, last: Row | None, size: int = PAGE) -> DataFrame:
        """The page that follows the row whose ``_place`` this is; the first one for None."""
        later = self.files()
        key = None
        if last is not None:
            kinds = {f.name: f.dataType for f in later.schema["lo"].dataType}
            key = F.struct(*[F.lit(last[n]).cast(t).alias(n) for n, t in kinds.items()])
            later = later.where(F.col("hi") > key)
        # the first file may be read to its last row, so ``size`` files after it hold enough; fewer, as a rule
        names, left = [], size
        for r in later.orderBy("lo").limit(size + 1).collect():
            if left <= 0:
                break
            left -= r["n"] if names or last is None else 0
            names.append(r["file"])
        rows = self._rows(names)
        return (rows if key is None else rows.where(F.col("_place") > key)).orderBy("_place").limit(size)
