"""Nearest neighbours by inner product: multiprobe p-stable hashing and exact reranking."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courseloom.llm.common import partitions, query, step, table
from courseloom.llm.vectors import common_length, finite, matrix

NEAREST = 20
QUERY_EVERY = 20            # the query set: ids divisible by this
TABLES = (4, 8, 16)         # what a fit may choose from: hash tables,
HASHES = range(1, 8)        # hashes of a table,
WIDTHS = (1.0, 1.5, 2.0, 3.0)           # widths of a slot, in standard deviations of a projection,
PROBES = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)  # and buckets that a query visits in a table
RECALL = 0.96               # of the neighbours of the sampled queries, at least
SAMPLE_QUERIES, SAMPLE_ROWS = 128, 512  # what the index is fitted on, those with the least hash
ROW_COST = 200              # a row sent costs as much as so many comparisons
BLOCK = 512                 # rows or queries of a bucket that meet in one cell
FLUSH = 1 << 18             # found pairs that a task keeps before it shortens the lists
SEED = 42


@dataclass
class Hashing:
    """Hash tables of p-stable projections, for vectors under the mapping that turns the largest inner
    product into the least distance: a row x becomes (x, sqrt(top - x.x)), a query (q scaled to the
    greatest length, 0), where ``top`` is the greatest x.x. Hash k of a table is the number of the slot
    of ``width`` in which the projection on a Gaussian direction, shifted by a random part of a slot,
    falls."""

    top: float
    directions: np.ndarray          # tables x hashes x (length + 1)
    shifts: np.ndarray              # tables x hashes, in slots
    width: float
    probes: int

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Places of rows, in slots: rows x tables x hashes."""
        last = np.sqrt(np.maximum(self.top - (x * x).sum(axis=1), 0))
        return self._places(x, last)

    def queries(self, q: np.ndarray) -> np.ndarray:
        scaled = q * (np.sqrt(self.top) / np.sqrt((q * q).sum(axis=1)))[:, None]
        return self._places(scaled, np.zeros(len(q)))

    def _places(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.einsum("nd,lkd->nlk", np.column_stack([x, last]), self.directions, optimize=True) / self.width + self.shifts

    def buckets(self, slots: np.ndarray) -> np.ndarray:
        """A number for each (table, slots), in the last two axes; two buckets of the same number
        would only be searched together."""
        tables, hashes = slots.shape[-2:]
        random = np.random.default_rng(SEED)
        factors = random.integers(0, 1 << 63, (tables, hashes), np.uint64) * np.uint64(2) + np.uint64(1)
        mixed = (slots.astype(np.int64).view(np.uint64) * factors).sum(axis=-1) + random.integers(0, 1 << 63, tables, np.uint64)
        mixed ^= mixed >> np.uint64(29)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The buckets of each query to be visited: queries x tables x probes, in each table the
        likeliest first."""
        places = self.queries(q)
        moves, order = visits(places, self.probes)
        return np.stack([self.buckets(np.floor(places) + moves[order[:, :, p]]) for p in range(order.shape[2])], axis=2)


def perturbations(hashes: int) -> np.ndarray:
    """All ways to move each slot by -1, 0 or 1."""
    return np.array(list(itertools.product((-1, 0, 1), repeat=hashes)))


def visits(places: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The moves, and for each query and table their numbers in order of estimated success.

    A neighbour's projection differs by a Gaussian step, so the logarithm of the chance that it lies
    in a neighbouring slot falls with the square of the distance to the border that it has to cross:
    a move's score is the sum of these squares, and the least score comes first.
    """
    part = places - np.floor(places)
    moves = perturbations(places.shape[-1])
    scores = (part ** 2) @ (moves == -1).T + ((1 - part) ** 2) @ (moves == 1).T
    return moves, np.argsort(scores, axis=-1, kind="stable")[:, :, :probes]


def choose(top: float, queries: np.ndarray, rows: np.ndarray, near: np.ndarray, owner: np.ndarray, n: int, per_query: float) -> Hashing:
    """The cheapest hashing that finds RECALL of the sampled queries' neighbours, or else the one that
    finds most.

    ``near`` are the true neighbours, of the query numbered in ``owner``. For every number of tables
    and hashes, width of a slot and number of probes, the neighbours' buckets give the recall, and the
    buckets of the sampled rows the share of the ``n`` rows that a query is compared with. The cost of
    a query is its comparisons, its probes and its share, ``per_query``, of the rows in every table.
    """
    random = np.random.default_rng(SEED)
    directions = random.standard_normal((max(TABLES), max(HASHES), queries.shape[1] + 1))
    shifts = random.random((max(TABLES), max(HASHES)))
    spread = float(Hashing(top, directions, np.zeros_like(shifts), 1.0, 1).rows(rows).std()) or 1.0
    best, chosen = None, None
    for hashes, width in itertools.product(HASHES, WIDTHS):
        held = Hashing(top, directions[:, :hashes], shifts[:, :hashes], width * spread, 3 ** hashes)
        places = held.queries(queries)
        _, order = visits(places, 3 ** hashes)
        rank, slots = np.argsort(order, axis=-1), np.floor(places)      # rank: of each move

        def visited(x: np.ndarray, whose: np.ndarray) -> np.ndarray:
            """When the bucket of a row is visited, in each table."""
            move = np.floor(held.rows(x)) - slots[whose]
            close = (np.abs(move) <= 1).all(axis=-1)
            code = np.where(close, ((move + 1) * 3 ** np.arange(hashes - 1, -1, -1)).sum(axis=-1), 0).astype(int)
            return np.where(close, rank[whose[:, None], np.arange(code.shape[1]), code], 3 ** hashes)

        first = np.minimum.accumulate(visited(near, owner), axis=1)
        met = np.concatenate([visited(rows, np.full(len(rows), k)) for k in range(0, len(queries), 8)])
        for probes in (*(p for p in PROBES if p < 3 ** hashes), 3 ** hashes):
            share = np.cumsum((met < probes).mean(axis=0))
            for tables in TABLES:
                recall = float((first[:, tables - 1] < probes).mean()) if len(first) else 1.0
                cost = tables * ROW_COST * (probes + per_query) + n * share[tables - 1]
                value = (-min(recall, RECALL), cost)
                if best is None or value < best:
                    best, chosen = value, replace(held, directions=held.directions[:tables], shifts=held.shifts[:tables], probes=probes)
    return chosen


def usable(rows: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """id, v (doubles) and the 128-bit key (k1, k2) of the vectors that take part, each once an id."""
    v = F.col(vector).cast("array<double>")
    found = rows.select(F.col(vector_id).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & finite(F.col("v")))
    found = found.filter(F.exists("v", lambda x: x != 0))
    return found.select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")).dropDuplicates(["id", "k1", "k2"])


def cells(points: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (cell, asks, id, k1, k2, v) such that the points and queries of a cell are to be compared.

    ``points`` (bucket, id, v) and ``asked`` (bucket, k1, k2, v) meet where their buckets are equal. A
    bucket of many rows or queries is a grid of blocks of about BLOCK on each side, one cell each, so
    neither a hot bucket nor a bucket that all queries probe is ever one task.
    """
    blocks = lambda df, name: df.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    grid = step(blocks(points, "rows").join(blocks(asked, "columns"), "bucket"), "grid")
    cell = F.xxhash64("bucket", "row", "column").alias("cell")
    kind = points.schema["id"].dataType
    homes = (points.join(grid, "bucket").withColumn("row", F.pmod(F.xxhash64("id"), "rows").cast("int"))
             .withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
             .select(cell, F.lit(False).alias("asks"), "id", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "v"))
    calls = (asked.join(grid, "bucket").withColumn("column", F.pmod(F.xxhash64("k1", "k2"), "columns").cast("int"))
             .withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
             .select(cell, F.lit(True).alias("asks"), F.lit(None).cast(kind).alias("id"), "k1", "k2", "v"))
    return homes.unionByName(calls)


def best_of(q: np.ndarray, c: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and of rows, and scores, of at least the ``keep`` best rows of each query
    with all that tie with them. A score is summed in the same order wherever the pair is met."""
    rough = q @ c.T
    if len(c) > keep:
        least = np.partition(rough, len(c) - keep, axis=1)[:, len(c) - keep]
        reach = np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1).max())
        a, b = np.nonzero(rough >= (least - 1e-12 * reach)[:, None])
    else:
        a, b = (x.ravel() for x in np.indices(rough.shape))
    return a, b, (q[a] * c[b]).sum(axis=1)


def shortened(found: list[pa.RecordBatch], keep: int) -> list[pa.RecordBatch]:
    """The ``keep`` best of each query (k1, k2), each pair once, in order."""
    if not found:
        return []
    t = pa.Table.from_batches(found).sort_by([("k1", "ascending"), ("k2", "ascending"), ("score", "descending"), ("id", "ascending")])
    k1, k2, score = (t[c].to_numpy() for c in ("k1", "k2", "score"))
    first = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
    n = t.num_rows
    again = np.zeros(n, bool)
    again[1:] = ~first[1:] & (score[1:] == score[:-1]) & pc.equal(t["id"].slice(1), t["id"].slice(0, n - 1)).to_numpy()
    place = np.cumsum(~again)                           # a query's rows are numbered from that of its first one
    start = np.maximum.accumulate(np.where(first, place, 0))
    return t.filter(pa.array(~again & (place - start < keep))).combine_chunks().to_batches()


def compared(met: DataFrame, length: int, keep: int) -> DataFrame:
    """k1, k2, id, score of the best pairs of the cells. A task holds the points of one cell, and of
    what it has found the best of each query, up to FLUSH pairs; what is more goes out before the end."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for part in pairs(batches):
            found.append(part)
            size += part.num_rows
            if size > FLUSH:
                found = shortened(found, keep)
                size = sum(x.num_rows for x in found)
                if size > FLUSH // 2:
                    yield from found
                    found, size = [], 0
        yield from shortened(found, keep)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, c = None, [], None                  # cell, its points so far, their vectors once complete
        for batch in batches:
            cell, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            cuts = np.nonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1]))[0] + 1
            for k, end in zip([0, *cuts], [*cuts, len(cell)]):
                if k == end:
                    continue
                if cell[k] != now:
                    now, homes, c = cell[k], [], None
                part = batch.slice(k, end - k)
                if not asks[k]:
                    homes.append(part)
                elif homes:
                    if c is None:
                        held = pa.Table.from_batches(homes).combine_chunks()
                        c = matrix(held["v"].combine_chunks(), length)
                    a, b, score = best_of(matrix(part.column(5), length), c, keep)
                    at = pa.array(a)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(3).take(at), part.column(4).take(at), held["id"].combine_chunks().take(pa.array(b)), pa.array(score)],
                        ["k1", "k2", "id", "score"])

    kind = met.schema["id"].dataType.simpleString()
    dealt = met.repartition(partitions(met.sparkSession), "cell").sortWithinPartitions("cell", "asks")
    return dealt.mapInArrow(search, f"k1 long, k2 long, id {kind}, score double")


def lists(found: DataFrame, keep: int) -> DataFrame:
    """k1, k2 and ``near``, the ``keep`` best (less, id) of each query in order; less is -score. Pairs
    found by several tasks count once, and tasks send on no more than the best of a query."""
    rank = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "id"))
    pair = F.struct((-F.col("score")).alias("less"), "id")
    return (found.withColumn("rank", rank).filter(F.col("rank") <= keep)
            .groupBy("k1", "k2").agg(F.array_sort(F.collect_set(pair)).alias("near")))


def sampled_neighbours(points: DataFrame, queries: np.ndarray, keep: int) -> DataFrame:
    """asker (a query's number) and v of the exact ``keep`` best points of each of a few queries, by
    one pass over all points."""
    length = queries.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, score = best_of(queries, matrix(batch.column(1), length), keep)
            at = pa.array(b)
            yield pa.RecordBatch.from_arrays([pa.array(a), batch.column(0).take(at), batch.column(2).take(at), batch.column(3).take(at), pa.array(score)],
                                             ["asker", "id", "k1", "k2", "score"])

    kind = points.schema["id"].dataType.simpleString()
    found = points.select("id", "v", "k1", "k2").mapInArrow(scan, f"asker long, id {kind}, k1 long, k2 long, score double")
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id", "k1", "k2"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= keep)
    return points.select("id", "k1", "k2", "v").join(best, ["id", "k1", "k2"]).select("asker", "v")


def fitted(points: DataFrame, asked: DataFrame, length: int, n: int, keep: int) -> Hashing:
    """The hashing for these tables, by a bounded sample of queries with their exact neighbours among
    all points, and a bounded sample of points."""
    first = lambda df, many: np.array([r["v"] for r in df.orderBy(F.xxhash64("k1", "k2"), "k1", "k2").limit(many).collect()], float)
    queries = first(asked.select("k1", "k2", "v"), SAMPLE_QUERIES).reshape(-1, length)
    rows = first(points.select("k1", "k2", "v"), SAMPLE_ROWS).reshape(-1, length)
    top = points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    # a list without order: what is found doesn't depend on it
    got = sampled_neighbours(points, queries, keep).collect()
    near, owner = np.array([r["v"] for r in got], float).reshape(-1, length), np.array([r["asker"] for r in got], int)
    other = (near != queries[owner]).any(axis=1) if len(got) else np.zeros(0, bool)     # copies of the query are always found
    return choose(top, queries, rows, near[other], owner[other], n, n / asked.count())


def search(rows: DataFrame, asks: Column | str, nearest: int = NEAREST, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``nearest`` rows of largest inner product found for each row where ``asks`` holds for its
    id (a condition on the column ``id``): query_id, rank (from 1), vec_id, score; ties by id.

    Candidates are all rows but those with the query's own id. Null ids, and vectors that are null,
    empty, zero or hold a null or non-finite entry, take no part, nor do those of another length than
    most vectors (of two equally frequent lengths, the greater). Rows that repeat id and vector are
    one; an id with several vectors asks with each of them. With fewer candidates than ``nearest`` all
    are returned. Extra columns aren't read, and an empty table gives no row.

    Equal vectors ask once, and of equal vectors only the nearest + 1 least ids can be in a list, so
    only these are indexed. Each table's bucket of a row is equi-joined with the buckets that queries
    visit, in blocks; the best of each cell are merged by one window that tasks shorten first. Queries
    whose buckets hold too few rows are compared with all rows, in blocks. What is broadcast or
    collected is the sample of SAMPLE_QUERIES queries with their neighbours and SAMPLE_ROWS rows.
    """
    spark, keep = rows.sparkSession, nearest + 1
    all_rows = step(usable(rows, vector_id, vector), "vectors")
    length = common_length(all_rows, "v")
    all_rows = all_rows.filter(F.size("v") == length)
    copies = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    points = step(all_rows.withColumn("copy", copies).filter(F.col("copy") <= keep).drop("copy"), "points")
    askers = all_rows.filter(asks).select("id", "k1", "k2")
    asked = step(all_rows.filter(asks).select("k1", "k2", "v").dropDuplicates(["k1", "k2"]), "asked")
    n = points.count()
    empty = spark.createDataFrame([], f"k1 long, k2 long, near array<struct<less:double,id:{points.schema['id'].dataType.simpleString()}>>")
    near = empty
    if n and not asked.isEmpty():
        near = step(_probed(points, asked, length, n, keep), "near")
        short = step(asked.join(near.filter(F.size("near") >= min(n, keep)), ["k1", "k2"], "left_anti"), "short")
        if not short.isEmpty():                         # compared with all, in blocks
            everywhere = F.lit(0).cast("long").alias("bucket")
            whole = cells(points.select(everywhere, "id", "v"), short.select(everywhere, "k1", "k2", "v"))
            near = near.filter(F.size("near") >= min(n, keep)).unionByName(lists(compared(whole, length, keep), keep))
    mine = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, nearest)
    return (askers.join(near, ["k1", "k2"]).select(F.col("id").alias("query_id"), F.posexplode(mine).alias("at", "pair"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("pair.id").alias("vec_id"), (F.lit(0.0) - F.col("pair.less")).alias("score")))


def _probed(points: DataFrame, asked: DataFrame, length: int, n: int, keep: int) -> DataFrame:
    """What the queries find in the buckets they visit, as lists."""
    held = points.sparkSession.sparkContext.broadcast(fitted(points, asked, length, n, keep))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = held.value
        for batch in batches:
            found = hashing.buckets(np.floor(hashing.rows(matrix(batch.column(1), length))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(found), pa.list_(pa.int64()))], ["id", "v", "buckets"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                found = hashing.probed(matrix(part.column(2), length)).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(found), pa.list_(pa.int64()))], ["k1", "k2", "v", "buckets"])

    kind = points.schema["id"].dataType.simpleString()
    homes = points.select("id", "v").mapInArrow(home, f"id {kind}, v array<double>, buckets array<long>")
    visited = asked.select("k1", "k2", "v").mapInArrow(visit, "k1 long, k2 long, v array<double>, buckets array<long>")
    homes = step(homes.select(F.explode("buckets").alias("bucket"), "id", "v"), "homes")
    there = homes.select("bucket").distinct()
    visited = step(visited.select(F.explode("buckets").alias("bucket"), "k1", "k2", "v").join(there, "bucket", "left_semi"), "visits")
    return lists(compared(cells(homes, visited), length, keep), keep)


@query()
def op12_multiprobe_search(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), f"id % {QUERY_EVERY} = 0")
