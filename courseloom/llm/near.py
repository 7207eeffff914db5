"""Near copies by exact Jaccard similarity of word shingles: SimHash fingerprints searched by vantage-point
trees give the first candidates, bands of min-hashes those whose fingerprints lie further apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courseloom.llm.common import components, partitions, step
from courseloom.llm.simhash import RADIUS, near_links

SHINGLE = 5                 # words
SIMILARITY = 0.8            # Jaccard similarity of two texts' sets of shingles, at least
SEED = 42

ROWS, BANDS = 5, 24         # a pair of similarity s has no band in common with probability (1 - s^ROWS)^BANDS: 7e-5 at 0.8
SMALL = 32                  # in buckets up to this every pair is looked at at once, larger ones need two steps
CELL, CELL_SHINGLES = 256, 200_000      # documents, and about so many shingles, on each side of a cell
COLUMNS = 1 << 13           # shingles that are counted at a time

_RANDOM = np.random.default_rng(SEED)
FACTORS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The different hashes of a whole text's shingles, sorted; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()       # bytes: only A-Z change, only ASCII space splits
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def digest(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def bands(found: np.ndarray) -> list[int]:
    """A number for every band of min-hashes; none for an empty set, which is like no other."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    least = np.full(len(FACTORS), ~np.uint64(0))
    for k in range(0, len(found), 1 << 12):
        for i, (a, b) in enumerate(zip(FACTORS, TERMS)):
            least[i] = min(least[i], (found[k:k + (1 << 12)] * a + b).min())
    return [xxh64_intdigest(least[k * ROWS:(k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)]


def fingerprint(found: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles: a bit is set if it is set in over half of their hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[k:k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found)).tobytes(), "big", signed=True)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(max(x, y), min(x, y)) for nodes in batch.column(0).to_pylist() for k, x in enumerate(nodes) for y in nodes[:k]]
        a, b = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def banded(sets: DataFrame) -> DataFrame:
    """(band, node, m, low, drawn): the members of every bucket with more than one, its size, its least
    node and one that it draws for itself. Buckets are equi-joined aggregates, so a hot one is split."""
    rows = step(sets.select("node", F.explode("bands").alias("band")), "banded")
    drawn = F.min(F.struct(F.xxhash64("node", "band").alias("h"), "node"))["node"]
    full = step(rows.groupBy("band").agg(F.count("*").alias("m"), F.min("node").alias("low"), drawn.alias("drawn")).filter("m > 1"), "buckets")
    return step(rows.join(full, "band"), "met")


def candidates(met: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of sets (node, n, bands) with a band in common whose sizes allow the similarity.

    In a bucket of more than SMALL members each member meets only the bucket's least node, which is the
    same in most bands of a large group, and its drawn one; a group stays linear in its size. What that
    leaves open is seen to by ``unresolved`` and ``compared``.
    """
    large = (met.filter(F.col("m") > SMALL).select("node", F.explode(F.array("low", "drawn")).alias("other")).filter("node <> other")
             .select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")))
    small = (met.filter(F.col("m") <= SMALL).groupBy("band").agg(F.collect_list("node").alias("nodes")).select("nodes")
             .mapInArrow(_pairs, "a long, b long"))
    found = large.union(small).distinct()
    sizes = sets.select("node", "n")
    found = found.join(sizes.withColumnsRenamed({"node": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "n_b"}), "b")
    return step(found.filter(F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")).select("a", "b"), "pairs")


def fingerprint_pairs(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a > b, of sets (node, n, fp) whose fingerprints are linked by the vantage-point trees.

    Fingerprints are folded first; each node meets the least node of its fingerprint, and that one the
    least nodes of the fingerprints linked to its own.
    """
    mine = sets.filter("n > 0").select("node", "n", "fp")
    distinct = step(mine.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("low")).select("fp", "low.node", "low.n"), "fingerprints")
    end = lambda x: distinct.select(F.col("fp").alias(x), F.struct("node", "n").alias(f"{x}_"))
    linked = near_links(distinct.select("fp"), radius).distinct().join(end("a"), "a").join(end("b"), "b").select("a_", "b_")
    equal = mine.join(distinct.select("fp", F.struct("node", "n").alias("b_")), "fp").select(F.struct("node", "n").alias("a_"), "b_").filter("a_.node <> b_.node")
    both = linked.union(equal).filter(F.least("a_.n", "b_.n") >= SIMILARITY * F.greatest("a_.n", "b_.n"))
    return step(both.select(F.greatest("a_.node", "b_.node").alias("a"), F.least("a_.node", "b_.node").alias("b")), "fingerprint-pairs")


def unresolved(met: DataFrame, sets: DataFrame, member: DataFrame) -> DataFrame:
    """(node, n, root, family) of what large buckets leave open, given the components found so far.

    A bucket whose members are all of one component has no link to add. In the others, members of
    different components may be similar to each other though not to the two that they met. Buckets
    that share a node make up a family, so each pair is looked at in one family, not in every band.
    """
    root = F.coalesce("root", "node").alias("root")
    large = step(met.filter(F.col("m") > SMALL).select("band", "node", "low").join(member, "node", "left").select("band", "node", "low", root), "large")
    mixed = large.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("band")
    rows = step(large.join(step(mixed, "mixed"), "band", "left_semi"), "open")
    edges = rows.filter("node <> low").select(F.greatest("node", "low").alias("a"), F.least("node", "low").alias("b"))
    family = components(edges).withColumnRenamed("root", "family")
    return step(rows.select("node", "root").distinct().join(family, "node").join(sets.select("node", "n"), "node"), "families")


def cells(rows: DataFrame) -> DataFrame:
    """(cell, side, both, node, root) such that all members of a family that the sizes allow to be
    similar meet in a cell; ``both``: the cell has two sides, and only pairs across are new in it.

    Sizes are cut into classes a factor 1 / SIMILARITY wide, so only members of one class or of two
    neighbouring ones can be similar. A class is cut into blocks of at most CELL members, fewer of long
    texts, and any two blocks are a cell: no task holds more, however large a family is.
    """
    rows = rows.withColumn("class", F.floor(F.log("n") / F.lit(-np.log(SIMILARITY))).cast("int"))
    block = F.greatest(F.lit(1), F.least(F.lit(CELL), (F.lit(CELL_SHINGLES) * F.pow(F.lit(SIMILARITY), F.col("class"))).cast("int")))
    grid = step(rows.groupBy("family", "class").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
                .select("family", "class", "blocks"), "grid")
    near = lambda by, name: grid.select("family", (F.col("class") + by).alias("class"), F.col("blocks").alias(name))
    rows = (rows.join(grid, ["family", "class"]).join(near(-1, "above"), ["family", "class"], "left").join(near(1, "below"), ["family", "class"], "left")
            .withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    own, klass = F.col("own"), F.col("class")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    met = lambda kind, low, i, j, side, both: F.struct(
        F.xxhash64("family", low, F.lit(kind), i, j).alias("cell"), side.cast("boolean").alias("side"), both.cast("boolean").alias("both"))
    same = F.transform(upto(F.col("blocks")), lambda j: met("same", klass, F.least(own, j), F.greatest(own, j), own > j, own != j))
    up = F.transform(upto(F.coalesce("above", F.lit(0))), lambda j: met("next", klass, own, j, F.lit(False), F.lit(True)))
    down = F.transform(upto(F.coalesce("below", F.lit(0))), lambda j: met("next", klass - 1, j, own, F.lit(True), F.lit(True)))
    return rows.select("node", "root", F.explode(F.concat(same, up, down)).alias("c")).select("c.*", "node", "root")


def cell_links(node: np.ndarray, root: np.ndarray, side: np.ndarray, both: bool, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links of a cell's members, a star for each group of similar ones."""
    n = np.array([len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1                   # numbers of the shingles that two members have
    owner, keep = np.repeat(np.arange(len(sets)), n), times[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, (column[-1] + 1) if len(column) else 0, COLUMNS):
        at = slice(*np.searchsorted(column, [k, k + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[at], column[at] - k] = 1
        common += has @ has.T
    alike = (common >= SIMILARITY * (n[:, None] + n - common)) & (root[:, None] != root)
    if both:
        alike &= side[:, None] != side
    label = np.arange(len(sets))
    while True:
        least = np.minimum(label, np.where(alike, label, len(sets)).min(axis=1, initial=len(sets)))
        if (least == label).all():
            break
        label = least
    moved = np.nonzero(label != np.arange(len(sets)))[0]
    a, b = node[moved], node[label[moved]]
    return np.maximum(a, b), np.minimum(a, b)


def compared(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) within the families of ``rows``: every pair that can be similar, by whole sets."""
    asked = rows.select("node")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())],
                                             ["node", "found"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["found"]]
            a, b = cell_links(t["node"].to_numpy(), t["root"].to_numpy(), t["side"].to_numpy(), t["both"][0].as_py(), sets)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        now, held = None, []
        for batch in batches:
            cell = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.nonzero(cell[1:] != cell[:-1])[0] + 1
            for k, end in zip([0, *cuts], [*cuts, len(cell)]):
                if k < end:
                    if held and cell[k] != now:
                        yield linked(held)
                        held = []
                    now = cell[k]
                    held.append(batch.slice(k, end - k))
        if held:
            yield linked(held)

    whole = step(texts.join(asked, "node", "left_semi").select("node", "text").mapInArrow(read, "node long, found binary"), "open-sets")
    dealt = cells(rows).join(whole, "node").select("cell", "side", "both", "node", "root", "found")
    dealt = dealt.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell")
    return step(dealt.mapInArrow(search, "a long, b long"), "compared")


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates (a, b) that are similar, by their whole sets; ``texts`` has one text a node."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())],
                                             ["node", "found"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    whole = step(texts.join(asked, "node").select("node", "text").mapInArrow(read, "node long, found binary"), "sets")
    one, two = (whole.select(F.col("node").alias(x), F.col("found").alias(f"found_{x}")) for x in "ab")
    return step(pairs.join(one, "a").join(two, "b").select("a", "b", "found_a", "found_b").mapInArrow(check, "a long, b long"), "similar")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, with its own columns, for every group of documents linked, over any number
    of links, by a similarity of at least SIMILARITY: the row of the group's least doc_id (of rows that
    share it, one with the group's least such digest).

    Rows with the same set of shingles are folded first, with map-side combining; empty and null texts
    have the same empty set. Two sets are compared if their SimHash fingerprints are linked, or if they
    have one of BANDS bands of min-hashes in common; in buckets that many sets share, all pairs that the components found so far leave open are
    compared, in blocks. A null doc_id is a member, and stays only where nothing else is in the
    group. Extra columns are kept as they are, an empty table gives no row.
    """
    at = docs.columns.index("text")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()),
                 pa.array([bands(x) for x in found], pa.list_(pa.int64())), pa.array([fingerprint(x) for x in found], pa.int64())],
                ["doc_id", "node", "n", "bands", "fp"])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([digest(shingles(t.as_py())) for t in batch.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "__mark"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    marked = step(docs.select("doc_id", "text").mapInArrow(mark, f"doc_id {id_type}, node long, n long, bands array<long>, fp long"), "marked")
    sets = step(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")), "nodes")
    tagged = docs.mapInArrow(tag, T.StructType([*docs.schema.fields, T.StructField("__mark", T.LongType())]))
    own = (tagged.join(sets.select(F.col("node").alias("__node"), F.col("first").alias("__first")),
                       (F.col("__mark") == F.col("__node")) & tagged["doc_id"].eqNullSafe(F.col("__first")))
           .dropDuplicates(["__mark"]).select(*(tagged[c] for c in docs.columns), "__mark"))
    own = step(own, "firsts")
    texts = own.select(F.col("__mark").alias("node"), "text")
    met = banded(sets)
    found = links(fingerprint_pairs(sets).union(candidates(met, sets)).distinct(), texts)
    member = step(components(found), "components")
    rest = unresolved(met, sets, member)
    if not rest.isEmpty():
        member = components(found.union(compared(rest, texts)))
    rooted = sets.join(member, "node", "left")
    best = F.min(F.struct(F.col("first").isNull().alias("no_id"), "first", "node"))
    chosen = rooted.groupBy(F.coalesce("root", "node").alias("group")).agg(best["node"].alias("__chosen")).select("__chosen")
    return own.join(chosen, own["__mark"] == F.col("__chosen")).select(*(own[c] for c in docs.columns))
