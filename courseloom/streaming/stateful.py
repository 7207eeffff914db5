"""State per key in Spark's state store: the listing index and the newest snapshot of each course.

A micro-batch reads and writes the state of the keys that it holds, and no other; changes go to
the store's change log, so what a batch writes follows the batch and not the state. Rows of one key
are combined before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, with change logs between snapshots."""
    names = {PROVIDER: ROCKSDB, CHANGELOG: "true"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ordered(values: tuple) -> tuple:
    """A key that sorts tuples as Spark sorts structs: NULL first."""
    return tuple((v is not None, v) for v in values)


def combined(rows: DataFrame, fold: Callable[[list[tuple]], list[tuple]], keys: int) -> DataFrame:
    """Rows of equal keys (the first columns) of an Arrow batch made fewer by ``fold``."""
    names = rows.columns

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[tuple]] = {}
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault(row[:keys], []).append(row[keys:])
            out = [(*key, *row) for key, found in groups.items() for row in fold(found)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), batch.schema.types)] if out else [c.slice(0, 0) for c in batch.columns]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(combine, rows.schema)


class Keyed(StatefulProcessor):
    """One value per key: ``start`` of an unseen one, ``step`` of a known one with its new rows."""

    def __init__(self, state: str, output: list[str]):
        self.schema, self.output = state, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("value", self.schema)

    def row(self, values: tuple) -> Row:
        return Row(*self.output)(*values)

    def close(self) -> None:
        pass


def fold_sightings(rows: list[tuple]) -> list[tuple]:
    """(code, first, last, attributes...) of a key: one row a code, attributes of its latest row."""
    found: dict[str, tuple] = {}
    for code, first, last, *own in rows:
        old = found.get(code)
        if old is None:
            found[code] = (code, first, last, *own)
        else:
            newest = max((last, *own), old[2:], key=ordered)
            found[code] = (code, min(first, old[1]), *newest)
    return list(found.values())


class IndexState(Keyed):
    """Codes with their first sighting, first and last sighting of the key, attributes of its latest row.

    Nothing of it depends on the order in which rows come: minima, maxima and a set. Of rows of one
    time the one with greater attributes is the latest.
    """

    def __init__(self, key: list[T.StructField], attributes: list[T.StructField], code: str):
        self.many = len(attributes)
        own = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in attributes)
        super().__init__(f"version bigint, first_seen bigint, last_seen bigint, codes array<string>, since array<bigint>{own}",
                         [*(f.name for f in key), code, "first_seen", "last_seen", *(f.name for f in attributes), "version"])

    def handleInputRows(self, key, rows, timerValues):
        old, at = self.value.get(), len(key)
        version, codes, latest, first = 0, {}, None, None
        if old:
            version, first, latest = old[0], old[1], (old[2], *old[5:])
            codes = dict(zip(old[3], old[4]))
        for code, seen_first, *seen_last in fold_sightings([tuple(r)[at:] for r in rows]):
            codes[code] = min(seen_first, codes.get(code, seen_first))
            first = seen_first if first is None else min(first, seen_first)
            latest = tuple(seen_last) if latest is None else max(latest, tuple(seen_last), key=ordered)
        # in order of sighting; a NULL code is none
        pairs = sorted((t, c) for c, t in codes.items() if c is not None)
        new = (version + 1, first, latest[0], [c for _, c in pairs], [t for t, _ in pairs], *latest[1:])
        self.value.update(new)
        yield self.row((*key, new[3], first, *latest, new[0]))


def fold_versions(rows: list[tuple]) -> list[tuple]:
    """(at, sha, date) of a key: one row a time, of unequal ones the greater."""
    found: dict[int, tuple] = {}
    for at, *content in rows:
        found[at] = max(tuple(content), found.get(at, tuple(content)), key=ordered)
    return [(at, *content) for at, content in found.items()]


class SnapshotState(Keyed):
    """Hash, date and time of a key's newest version and the time it was first seen.

    Versions of a batch are taken in order of their time. One that is not newer than the stored one is
    late: no change, but the first sighting takes the earliest time. Every version that is kept goes
    out as a row, with its kind where the text is another one.

    With ``age`` (milliseconds) a timer forgets a key whose newest version is older than that at the
    watermark; a row of kind 'evicted' says so, and a later snapshot of the key is new.
    """

    OUTPUT = ["version", "old_sha256", "new_sha256", "old_updated_at", "new_updated_at", "kind", "detected_us", "first_us"]

    def __init__(self, key: list[str], age: int | None):
        super().__init__("version bigint, sha string, date string, at bigint, first bigint", [*key, *self.OUTPUT])
        self.age = age

    def handleInputRows(self, key, rows, timerValues):
        size = len(key)
        version, sha, date, at, first = self.value.get() or (0, None, None, None, None)
        before, out = (at, first), []
        for now, *content in sorted(fold_versions([tuple(r)[size:size + 3] for r in rows]), key=lambda v: v[0]):
            first = now if first is None else min(first, now)
            if at is None or now > at:
                kind = "new" if at is None else None if content[0] == sha else "updated_at" if content[1] != date else "body_only"
                version = max(version + 1, now)         # rises past that of a forgotten state, too
                out.append((version, sha, content[0], date, content[1], kind, now))
                sha, date, at = *content, now
        if (at, first) == before:
            return
        if not out:                                     # only a late version, seen before all others
            version += 1
            out.append((version, sha, sha, date, date, None, at))
        self.value.update((version, sha, date, at, first))
        if self.age is not None and at != before[0]:
            if before[0] is not None:
                self.handle.deleteTimer(before[0] // 1000 + self.age)
            self.handle.registerTimer(at // 1000 + self.age)
        for row in out:
            yield self.row((*key, *row, first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        version, sha, date, at, first = self.value.get() or (None,) * 5
        if at is not None and at // 1000 + self.age <= expiredTimerInfo.getExpiryTimeInMs():
            self.value.clear()
            yield self.row((*key, version + 1, sha, None, date, None, "evicted", at, first))
