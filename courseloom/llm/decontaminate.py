"""Benchmark decontamination: short test items inside long documents."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseloom.llm.common import query, table

SHINGLE = 5
THRESHOLD = 0.8
SEED = 7
BLOCK_BYTES = 16 << 20      # text of items that one pass over the documents carries


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z), split at ASCII white space."""
    return (text or "").encode().lower().split()


def shingles(words: list[bytes], width: int) -> set[bytes]:
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


class Items:
    """Test items, partitioned by size, with a MinHash sketch each.

    The size of an item is its number of distinct shingles (an item of fewer than five words is one
    shingle of its own width; an item without words is left out). A document that contains the
    threshold t of an item of n shingles lacks at most n - ceil(t n) of them, so of the item's
    n - ceil(t n) + 1 shingles with the least hash it has at least one: with a sketch of this size,
    which grows with the item's partition, the candidates miss nothing. The partitions are powers of
    two; those whose least item needs more shingles than a document has are not looked at.
    """

    def __init__(self, rows: list[tuple], width: int, threshold: float):
        from xxhash import xxh64_intdigest

        self.ids, self.sets, self.needs = [], [], []
        parts: dict[tuple[int, int], dict[bytes, list[int]]] = {}
        self.least: dict[tuple[int, int], int] = {}
        for item, text in rows:
            words = words_of(text)
            if not words:
                continue
            own = min(width, len(words))
            found = shingles(words, own)
            need = math.ceil(threshold * len(found) - 1e-9)
            part = (own, len(found).bit_length())
            sketch = sorted(found, key=lambda s: (xxh64_intdigest(s, SEED), s))[:len(found) - need + 1]
            for s in sketch:
                parts.setdefault(part, defaultdict(list))[s].append(len(self.ids))
            self.least[part] = min(need, self.least.get(part, need))
            self.ids.append(item)
            self.sets.append(found)
            self.needs.append(need)
        self.by_width: dict[int, list[tuple[int, dict]]] = {}
        for (own, size), index in sorted(parts.items()):
            self.by_width.setdefault(own, []).append((self.least[own, size], dict(index)))

    def inside(self, text: str | None) -> list[tuple]:
        """(item, its shingles, those in the text) of every item contained to the threshold."""
        words, found = words_of(text), []
        for own, parts in self.by_width.items():
            have = shingles(words, own)
            candidates = set()
            for least, index in parts:
                if len(have) >= least:
                    for s in have & index.keys():
                        candidates.update(index[s])
            for k in candidates:
                shared = len(self.sets[k] & have)
                if shared >= self.needs[k]:
                    found.append((self.ids[k], len(self.sets[k]), shared))
        return sorted(found, key=lambda f: (f[0] is None, f[0] or 0, f[1:]))


def blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of about BLOCK_BYTES of text, each small enough to send to all tasks."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    numbered = items.select(item, text, F.pmod(F.xxhash64(text, item), F.lit(n)).alias("__block"))
    for k in range(n):
        yield [(r[0], r[1]) for r in numbered.filter(F.col("__block") == k).collect()]


def contained(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """Every pair of a document and an item of which it contains at least ``threshold`` of the
    shingles: doc_id, item_id, n_shingles, n_shared, containment.

    The items are the stated query set: they go to the tasks in blocks of bounded size, one pass
    over the documents for each block (one pass in all up to 16 MB of items). Documents are read
    whole and never shuffled, so no key, source or group can be hot. Candidates come from the
    size-partitioned sketches; the pairs are those whose exact sets of shingles agree.

    A row of ``docs`` that is repeated gives its pairs again, and so does a repeated item; null ids
    are passed on; null or empty texts contain nothing and empty items are contained nowhere; extra
    columns aren't read; without documents or items there is no row.
    """
    ids = [f"{name} {df.schema[name].dataType.simpleString()}" for name, df in (("doc_id", docs), ("item_id", items))]
    item_type = pa.int64() if items.schema["item_id"].dataType.simpleString() in ("bigint", "int") else pa.string()
    out = None
    for rows in blocks(items, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = Items(sent.value, width, threshold)
            for batch in batches:
                at, found = [], []
                for row, t in enumerate(batch.column(1)):
                    for f in held.inside(t.as_py()):
                        at.append(row)
                        found.append(f)
                columns = list(zip(*found)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], item_type),
                     pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                    ["doc_id", "item_id", "n_shingles", "n_shared"])

        part = docs.select("doc_id", "text").mapInArrow(find, ", ".join([*ids, "n_shingles long, n_shared long"]))
        out = part if out is None else out.union(part)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def clean(docs: DataFrame, items: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with their own columns, that contain no item."""
    at = docs.columns.index("text")
    out = docs
    for rows in blocks(items, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = Items(sent.value, width, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not held.inside(t.as_py()) for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out


SQL_CONTAINED = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_no, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT row_no, doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) >= 5),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM benchmark),
parts AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM items WHERE len(w) >= 5),
sizes AS (SELECT item_id, count(*) AS n FROM parts GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM grams JOIN parts USING (s) JOIN sizes USING (item_id)
GROUP BY row_no, doc_id, item_id, n HAVING count(*) >= ceil(0.8 * n - 1e-9)
"""


@query(SQL_CONTAINED)
def op7_benchmark_containment(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
