"""Streaming form of the snapshot state: listing index, change capture, daily trend.

The index and the newest snapshot of each course live in the state store; what a batch changes is
appended to a log by Spark's file sink, once each, however often a batch is repeated. The current
table is the newest row of each key in that log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from courseloom.operators.joins import KEY
from courseloom.operators.snapshots import LIST_COLUMNS, change_history
from courseloom.session import importable
from courseloom.streaming.stateful import IndexState, SnapshotState, combined, fold_sightings, fold_versions, state_store

SNAPSHOT = ("university_id string, year int, course_code string, body_sha256 string, updated_at string, "
            "fetched_at timestamp")
STATE = SNAPSHOT + ", first_seen timestamp"


def read_snapshots(spark: SparkSession, path: str, schema: str = SNAPSHOT, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def batch_changes(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(change rows, new state of the batch's keys and of those in ``state``) of one batch.

    Several versions of a key are taken in order of ``fetched_at``. Rows that repeat a key and time
    are one version (of unequal ones the greater hash and date). A version that is not newer than the
    stored one is late: it is no change and doesn't replace the state, but ``first_seen`` takes the
    earliest time ever seen. So the state doesn't depend on the order in which snapshots land.
    """
    seen = batch.groupBy(*KEY, "fetched_at").agg(F.max(F.struct("body_sha256", "updated_at")).alias("v"))
    seen = seen.select(*KEY, "v.body_sha256", "v.updated_at", "fetched_at")
    stored = state.select(*KEY, F.col("fetched_at").alias("_stored"))
    timely = seen.join(stored, KEY, "left").where("_stored IS NULL OR fetched_at > _stored").drop("_stored")
    known = state.select(*KEY, "body_sha256", "updated_at", "fetched_at", F.lit(True).alias("_old"))
    rows = known.join(timely.select(*KEY).distinct(), KEY, "left_semi").unionByName(timely.withColumn("_old", F.lit(False)))
    rows = rows.withColumn("_at", F.unix_micros("fetched_at"))
    log = change_history(rows, KEY, "_at", "body_sha256", "updated_at", chunk=3_600_000_000)
    fresh = timely.select(*KEY, F.unix_micros("fetched_at").alias("_at"), F.col("fetched_at").alias("detected_at"))
    log = log.join(fresh, [*KEY, "_at"]).drop("_at")
    last = seen.groupBy(*KEY).agg(F.max(F.struct("fetched_at", "body_sha256", "updated_at")).alias("n"), F.min("fetched_at").alias("f"))
    newer = F.col("n").isNotNull() & (F.col("fetched_at").isNull() | (F.col("n.fetched_at") > F.col("fetched_at")))
    new = state.join(last, KEY, "full").select(
        *KEY, *[F.when(newer, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("body_sha256", "updated_at", "fetched_at")],
        F.least("first_seen", "f").alias("first_seen"))
    return log, new


def newest(log: DataFrame, key: list[str]) -> DataFrame:
    """The row of greatest ``version`` of each key, by an aggregate that tasks combine first."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("_r")).select(*key, "_r.*")


def track_index(listed: DataFrame, log_path: str, checkpoint: str, key: list[str] = KEY, attributes: list[str] = LIST_COLUMNS,
                code: str = "kaiko_cd", seen: str = "seen_at") -> StreamingQuery:
    """Keep the listing index of a stream of listing rows: the streaming form of ``upsert_index``.

    Every batch appends a row for each key that it touches: key, codes in order of their first
    sighting, first_seen, last_seen, the attributes of the latest row, version. Files may land in any
    order and repeatedly, the index is the same.
    """
    spark = listed.sparkSession
    importable(spark)
    at = F.unix_micros(F.col(seen).cast("timestamp"))
    rows = listed.select(*key, F.col(code).cast("string").alias("_code"), at.alias("_first"), at.alias("_last"), *attributes)
    kind = listed.schema[seen].dataType
    processor = IndexState([listed.schema[k] for k in key], [listed.schema[a] for a in attributes], code)
    types = {**dict(listed.dtypes), code: "array<string>", "first_seen": "bigint", "last_seen": "bigint", "version": "bigint"}
    with state_store(spark):
        out = combined(rows, fold_sightings, len(key)).groupBy(*key).transformWithState(
            processor, ", ".join(f"`{n}` {types[n]}" for n in processor.output), "Append", "None")
        when = {c: F.timestamp_micros(c).cast(kind) for c in ("first_seen", "last_seen")}
        return appended(out.withColumns(when), log_path, checkpoint)


def current_index(spark: SparkSession, log_path: str, key: list[str] = KEY) -> DataFrame:
    return newest(spark.read.parquet(log_path), key).drop("version")


def appended(out: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    return (out.writeStream.format("parquet").outputMode("append").option("path", log_path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def track_changes(snapshots: DataFrame, log_path: str, checkpoint: str, key: list[str] = KEY, sha: str = "body_sha256",
                  updated: str = "updated_at", fetched: str = "fetched_at", age_days: int | None = None, late: str = "30 days") -> StreamingQuery:
    """Run all landed snapshots through the state and append every kept version to the log.

    A log row has the key, version, old and new hash and date, kind (NULL: same text), detected_at and
    first_seen; ``change_rows`` and ``current_state`` read it. Late and repeated snapshots are treated
    as by ``batch_changes``. With ``age_days``, a key without a newer snapshot is forgotten once the
    watermark, which follows the newest snapshot at a distance of ``late``, is so many days past its
    last one, so the state is bounded; rows that come later than the watermark are then dropped.
    """
    spark = snapshots.sparkSession
    importable(spark)
    if age_days is not None:
        snapshots = snapshots.withWatermark(fetched, late)
    at = F.unix_micros(F.col(fetched).cast("timestamp"))
    rows = snapshots.select(*key, at.alias("_at"), F.col(sha).alias("_sha"), F.col(updated).alias("_date"))
    schema = snapshots.schema
    out_schema = (", ".join(f"`{k}` {schema[k].dataType.simpleString()}" for k in key)
                  + ", version bigint, old_sha256 string, new_sha256 string, old_updated_at string, new_updated_at string, "
                    "kind string, detected_us bigint, first_us bigint")
    if age_days is None:
        rows = combined(rows, fold_versions, len(key))
    else:                                               # the watermark's column has to reach the state
        rows = snapshots.select(*key, at.alias("_at"), F.col(sha).alias("_sha"), F.col(updated).alias("_date"), F.col(fetched).alias("_time"))
    processor = SnapshotState(key, None if age_days is None else age_days * 86_400_000)
    with state_store(spark):
        out = rows.groupBy(*key).transformWithState(processor, out_schema, "Append", "None" if age_days is None else "EventTime")
        kind = schema[fetched].dataType
        out = out.select(*key, "version", "old_sha256", "new_sha256", "old_updated_at", "new_updated_at", "kind",
                         F.timestamp_micros("detected_us").cast(kind).alias("detected_at"),
                         F.timestamp_micros("first_us").cast(kind).alias("first_seen"))
        return appended(out, log_path, checkpoint)


def change_rows(log: DataFrame) -> DataFrame:
    """The changes in a log: versions whose text is new or another one."""
    return log.where("kind IN ('new', 'updated_at', 'body_only')").drop("version", "first_seen")


def current_state(log: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Hash, date and time of each known key's newest version, and its first sighting."""
    last = newest(log, key).where("kind IS DISTINCT FROM 'evicted'")
    return last.select(*key, F.col("new_sha256").alias("body_sha256"), F.col("new_updated_at").alias("updated_at"),
                       F.col("detected_at").alias("fetched_at"), "first_seen")


def change_trend(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Changes per day and kind, on a stream or a table; late rows up to ``late`` count."""
    return (log.withWatermark("detected_at", late).groupBy(F.window("detected_at", "1 day").alias("w"), "kind")
            .agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n"))
