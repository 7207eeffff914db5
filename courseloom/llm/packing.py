"""Best-fit packing of tokenised documents into sequences of a fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courseloom.llm.common import partitions, query, step, table
from courseloom.llm.tokens import PACKED_BY, vocabulary, word_encoder

SIZE = 4096
END_ID = 1


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Every document's ids followed by ``end_id``, cut after each ``size`` ids:
    doc_id, piece, start, length, ids_crc32. A null text is empty: its one piece is the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, width = word_encoder(path).encode, end_id.to_bytes(4, "little"), 4 * size
        for batch in batches:
            at, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for k in range(0, len(ids), width):
                    part = ids[k:k + width]
                    at.append(row)
                    out.append((k // width, k // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A segment tree over the remaining capacities 0..size: which of them have open bins. The
    tightest capacity that still takes a document is found in logarithmic time. The bins of one
    capacity are runs of bin numbers."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.most = [-1] * (2 * self.width)             # greatest capacity with a bin, of the leaves below
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, capacity: int, value: int) -> None:
        k = self.width + capacity
        self.most[k] = value
        while k > 1:
            k //= 2
            self.most[k] = max(self.most[2 * k], self.most[2 * k + 1])

    def add(self, capacity: int, first: int, count: int) -> None:
        if count:
            runs = self.runs.setdefault(capacity, [])
            runs.append((first, count))
            if len(runs) == 1:
                self._mark(capacity, capacity)

    def pop(self, capacity: int) -> tuple[int, int]:
        runs = self.runs[capacity]
        run = runs.pop()
        if not runs:
            self._mark(capacity, -1)
        return run

    def tightest(self, need: int) -> int | None:
        """The least capacity >= need that has an open bin."""
        if self.most[1] < need:
            return None
        k, low, high = 1, 0, self.width - 1
        while k < self.width:                           # the leftmost leaf that is marked and >= need
            mid = (low + high) // 2
            if self.most[2 * k] >= need:
                k, high = 2 * k, mid
            else:
                k, low = 2 * k + 1, mid + 1
        return low


def plan(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Best-fit decreasing over a histogram of lengths.

    Documents of one length are alike, so a run of them is placed at once: the tightest open bins
    take as many as fit, bin after bin, just as one document after the other would go. Rows of the
    result: length, rank of the run's first document among those of its length, first bin, how
    many go into a bin, offset of the first in the bin. The input has at most ``size`` lengths, and
    a bin is met once for each distinct length in it, so the plan is bounded by ``size`` alone,
    whatever the corpus.
    """
    bins, fresh, rows = OpenBins(size), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, each = size, size // length
                first, count = fresh, -(-left // each)
                fresh += count
            else:
                each = room // length
                first, count = bins.pop(room)
            full = min(count, left // each)
            if full:
                rows.append((length, rank, first, each, size - room))
                bins.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:                   # the last of this length: less than one bin takes
                rows.append((length, rank, first + full, left, size - room))
                bins.add(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            bins.add(room, first + full, count - full)
    return np.array(rows, np.int64).reshape(-1, 5)


RANKS = 1 << 44                                         # more documents of one length than any corpus has


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens by best-fit decreasing.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is a document: a repeated row is packed again, a null doc_id stays null,
    a null or empty text is one piece of the end id alone, extra columns aren't read, and an empty
    table gives no row. Only documents longer than ``size`` are cut. Pieces of equal length are
    ranked by doc_id and piece within salted groups.

    The packing of the whole corpus is exact best-fit decreasing, not one per shard: only the
    histogram of lengths (at most ``size`` rows) reaches the driver, where the plan is made, and
    the plan goes back as a table bounded by ``size``. Each piece then finds its place from its
    length and its rank among equal lengths. The rank is a count per (length, salt) plus the rank
    in it, so a length that a third of all pieces have is dealt over as many tasks as any other.
    Tokens are made once and written as five numbers a piece.
    """
    spark = docs.sparkSession
    found = step(pieces(docs, path, size, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = plan(histogram, size)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    where = spark.sparkContext.broadcast((placed[:, 0] * RANKS + placed[:, 1], placed))

    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
            .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = where.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        _, first, bin_, each, offset = rows[np.searchsorted(keys, length * RANKS + rank, "right") - 1].T
        return pd.DataFrame({"sequence_id": bin_ + (rank - first) // each,
                             "offset": offset + (rank - first) % each * length})

    return (salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "salt"])
            .withColumn("place", place("length", F.col("base") + F.col("rank")))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset"))


@query()
def op1_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(PACKED_BY))
