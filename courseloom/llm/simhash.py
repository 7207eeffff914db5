"""SimHash fingerprints of word shingles, and exact near-duplicate groups by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseloom.llm.common import components, partitions, query, step, table

SHINGLE = 3
RADIUS = 2
SEED = 42

SHARD = 1024                # fingerprints a shard is meant to hold
SAMPLE = 1 << 17            # fingerprints the tree is fitted on, at most
LEAF = 128                  # fingerprints of a leaf inside a shard: compared directly
FLUSH = 1 << 20             # pairs kept before they are folded into labels


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()       # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = words[k:k + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(g, seed) for g in grams), np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every whole text (null: empty, 0)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col(text)).mapInArrow(
        mark, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def distance(a, b):
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """A vantage-point tree. A node holds a vantage point and the median distance of its
    fingerprints to it: those up to the median are inside, the others outside. A ball of the given
    radius around a query meets the inside only if its distance is at most median + radius, and the
    outside only if it is over median - radius (triangle inequality), so the other branch is pruned.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.vantage: list[np.uint64] = []
        self.median: list[int] = []
        self.children: list[tuple[int, int]] = []       # >= 0: a node, < 0: leaf -1 - child
        self.leaves: list[np.ndarray] = []              # positions in points
        self.root = self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, at: np.ndarray, leaf: int) -> int:
        if len(at) > leaf:
            vantage = points[at[len(at) // 2]]
            far = distance(points[at], vantage)
            median = int(np.median(far))
            inside = far <= median
            if inside.all():                            # more than half lie at the greatest distance
                median = int(far.max()) - 1
                inside = far <= median
            if inside.any() and not inside.all():
                node = len(self.vantage)
                self.vantage.append(vantage)
                self.median.append(median)
                self.children.append((0, 0))
                self.children[node] = (self._grow(points, at[inside], leaf), self._grow(points, at[~inside], leaf))
                return node
        self.leaves.append(at)
        return -len(self.leaves)

    def meet(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the positions of the queries whose ball meets it; radius 0 for homes."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at
                continue
            far = distance(queries[at], self.vantage[node])
            inside, outside = self.children[node]
            stack.append((inside, at[far <= self.median[node] + radius]))
            stack.append((outside, at[far > self.median[node] - radius]))


class Shard:
    """The fingerprints at home in one shard, and what the queries sent to it link."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.tree = Tree(points, LEAF)
        self.label = np.arange(len(points))             # smallest linked position: points are sorted

    def link(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Fold in all pairs of a query with a point; links of queries to a point of their group."""
        n = len(self.points)
        label = np.concatenate([self.label, np.arange(n, n + len(queries))])
        left, right, size = [], [], 0
        for leaf, at in self.tree.meet(queries, radius):
            home = self.tree.leaves[leaf]
            for k in range(0, len(at), 4096):
                q, p = np.nonzero(distance(queries[at[k:k + 4096], None], self.points[home]) <= radius)
                left.append(n + at[k + q])
                right.append(home[p])
                size += len(q)
                if size > FLUSH:
                    label, left, right, size = self._fold(label, left, right), [], [], 0
        label = self._fold(label, left, right)
        self.label = label[:n]
        near = np.nonzero(label[n:] < n)[0]
        return queries[near], self.points[label[n:][near]]

    @staticmethod
    def _fold(label: np.ndarray, left: list, right: list) -> np.ndarray:
        """Labels after all pairs: least label of a group, by hooking and pointer jumping."""
        if not left:
            return label
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for x in (label[a], label[b], a, b):
                np.minimum.at(new, x, low)
            while (jump := new[new] < new).any():
                new[jump] = new[new][jump]
            if (new == label).all():
                return label
            label = new

    def inner(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.nonzero(self.label < np.arange(len(self.label)))[0]
        return self.points[moved], self.points[self.label[moved]]


def near_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a > b, whose components are those of all pairs within the radius.

    A vantage-point tree over a bounded sample (at most SAMPLE fingerprints, those with the least
    hash) cuts the space into shards of about SHARD fingerprints. Every fingerprint lives in one
    shard and asks in each shard that its ball meets, so that no pair over a border is lost. In a
    shard a second tree prunes the same way and the leaves compare exactly. Of all pairs found in a
    shard only a star for each group is sent on, at most one link a row read.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    sample = min(n, SAMPLE, max(64, 32 * (n // SHARD)))
    points = np.sort(np.array([r[0] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()],
                              np.int64).view(np.uint64))
    top = spark.sparkContext.broadcast(Tree(points, max(2, len(points) * SHARD // max(n, 1))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = top.value
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for asks, reach in ((False, 0), (True, radius)):
                for leaf, at in tree.meet(fps.view(np.uint64), reach):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), leaf, np.int32)), pa.array(np.full(len(at), asks)), pa.array(fps[at])],
                        ["shard", "asks", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(found):
            a, b = (x.view(np.int64) for x in found)
            apart = a != b
            a, b = a[apart], b[apart]
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        now, homes, here = None, [], None               # shard, its fingerprints so far, the shard once complete
        for batch in batches:
            shard, asks, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.nonzero((shard[1:] != shard[:-1]) | (asks[1:] != asks[:-1]))[0] + 1
            for k, end in zip([0, *cuts], [*cuts, len(fps)]):
                if k == end:
                    continue
                if shard[k] != now:
                    if here:
                        yield sent(here.inner())
                    now, homes, here = shard[k], [], None
                if not asks[k]:
                    homes.append(fps[k:end].copy())
                elif homes:
                    here = here or Shard(np.sort(np.concatenate(homes).view(np.uint64)))
                    yield sent(here.link(fps[k:end].view(np.uint64), radius))
        if here:
            yield sent(here.inner())

    routed = (distinct.select("fp").mapInArrow(route, "shard int, asks boolean, fp long")
              .repartition(partitions(spark), "shard").sortWithinPartitions("shard", "asks"))
    return routed.mapInArrow(search, "a long, b long")


def rooted_fingerprints(marked: DataFrame, radius: int) -> DataFrame:
    """fp, first (its least doc_id) and root (null: no link) of every different fingerprint."""
    distinct = step(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    member = components(near_links(distinct, radius))
    return step(distinct.join(member, distinct["fp"] == member["node"], "left").select("fp", "first", "root"), "rooted")


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id: the group of every document whose fingerprint is linked, over any
    number of links of at most ``radius`` differing bits; the id is the group's least doc_id.

    Every row counts: repeated rows are exact copies of each other, empty and null texts share the
    fingerprint 0 and are linked like any other, a null doc_id is a member but never names a group
    (null if nothing else is in it), extra columns aren't read, an empty table gives no row.

    Equal fingerprints are folded first, with map-side combining, so a group of copies of any size
    is one point of the trees. The group goes back to the documents by an equi-join of two written
    tables on the fingerprint, whose hot values adaptive execution splits.
    """
    marked = step(fingerprints(docs, shingle, seed), "fingerprints")
    rooted = rooted_fingerprints(marked, radius)
    least = step(rooted.filter("root is not null").groupBy("root").agg(F.min("first").alias("least")), "named")
    named = step(rooted.join(least, "root", "left")
                 .select("fp", F.coalesce("least", "first").alias("component_id")), "members")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


@query()
def op6_simhash_near_dedup(spark, sf_dir):
    found = groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
