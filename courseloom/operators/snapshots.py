"""State across snapshots: index upsert, change capture, staleness, page checks, ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom.operators.joins import KEY
from courseloom.operators.ordered import CHUNK, previous_value
from courseloom.session import written

LIST_COLUMNS = ["title", "term_slots", "instructors"]


def upsert_index(state: DataFrame, batch: DataFrame, key: list[str] = KEY, attributes: list[str] = LIST_COLUMNS,
                 code: str = "kaiko_cd", seen: str = "seen_at") -> DataFrame:
    """Merge listing rows into the index.

    New key: first and last seen are set. Known key: attributes and last seen are refreshed,
    the code is appended unless present. Within a batch the latest row of a key wins and all
    its codes are taken in order of sighting. A batch is reduced to one row per key before
    it meets the state.
    """
    codes = batch.groupBy(*key, code).agg(F.min(seen).alias("_first"), F.max(F.struct(seen, *attributes)).alias("_last"))
    b = codes.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_first", F.col(code).alias("c")))), lambda x: x["c"]).alias("_codes"),
        F.min("_first").alias("_from"), F.max("_last").alias("_row"))
    s = state.join(b, key, "full")
    none = F.array().cast("array<string>")
    out = {"kaiko_cd": F.array_union(F.coalesce("kaiko_cd", none), F.coalesce("_codes", none)),
           "first_seen": F.coalesce("first_seen", "_from"),
           "last_seen": F.coalesce(F.col(f"_row.{seen}"), F.col("last_seen"))}
    for a in attributes:
        out[a] = F.when(F.col("_row").isNotNull(), F.col(f"_row.{a}")).otherwise(F.col(a))
    return s.select(*key, *[c.alias(n) for n, c in out.items()])


def change_kind(old_sha: Column, new_sha: Column, old_date: Column, new_date: Column, known: Column) -> Column:
    """'new', 'updated_at', 'body_only', or NULL when the text is the same."""
    return (F.when(~known, "new").when(old_sha == new_sha, F.lit(None).cast("string"))
            .when(~old_date.eqNullSafe(new_date), "updated_at").otherwise("body_only"))


def changes(state: DataFrame, batch: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Change rows of a batch (one row per key) against the stored hashes."""
    old = state.select(*key, F.col("body_sha256").alias("old_sha256"), F.col("updated_at").alias("old_updated_at"), F.lit(True).alias("_known"))
    new = batch.select(*key, F.col("body_sha256").alias("new_sha256"), F.col("updated_at").alias("new_updated_at"),
                       F.col("fetched_at").alias("detected_at"))
    j = new.join(old, key, "left")
    kind = change_kind(F.col("old_sha256"), F.col("new_sha256"), F.col("old_updated_at"), F.col("new_updated_at"),
                       F.coalesce("_known", F.lit(False)))
    return j.withColumn("kind", kind).where("kind IS NOT NULL").drop("_known")


def change_history(versions: DataFrame, key: list[str], pos: str, sha: str, updated: str, chunk: int = CHUNK) -> DataFrame:
    """Change rows over all versions: each against the version before it.

    ``pos`` is a whole number that orders a key's versions. A key with very many versions is
    scanned in chunks of ``pos``.
    """
    v = versions.select(*key, pos, F.col(sha).alias("new_sha256"), F.col(updated).alias("new_updated_at"))
    v = previous_value(v, key, pos, F.struct("new_sha256", "new_updated_at"), "_old", chunk)
    kind = change_kind(F.col("_old.new_sha256"), F.col("new_sha256"), F.col("_old.new_updated_at"),
                       F.col("new_updated_at"), F.col("_old").isNotNull())
    return v.select(*key, pos, F.col("_old.new_sha256").alias("old_sha256"), "new_sha256",
                    F.col("_old.new_updated_at").alias("old_updated_at"), "new_updated_at",
                    kind.alias("kind")).where("kind IS NOT NULL")


def latest_sweeps(runs: DataFrame) -> DataFrame:
    """Start of the last successful sweep of each code in a run's scope 'name:code,code'."""
    ok = runs.where("job = 'sweep' AND status = 'ok'")
    after = F.when(F.col("scope").contains(":"), F.regexp_replace("scope", "^[^:]*:", "")).otherwise("")
    codes = ok.select("started_at", F.explode(F.split(after, ",")).alias("code"))
    return codes.where("code <> ''").groupBy("code").agg(F.max("started_at").alias("swept_at"))


def not_stale(index: DataFrame, latest: DataFrame, key: list[str] = KEY, codes: str = "kaiko_cd", seen: str = "last_seen") -> DataFrame:
    """Drop rows last seen before the oldest of their own codes' latest sweeps.

    A row whose codes were never swept, or that has no last sighting, stays.
    """
    # one row per code; written, so that its known size spares a shuffle on a few hot codes
    latest = written(latest, "sweeps")
    own = index.select(*key, F.explode(codes).alias("code")).join(latest, "code")
    least = own.groupBy(*key).agg(F.min("swept_at").alias("_least"))
    stale = F.coalesce(F.col(seen) < F.col("_least"), F.lit(False))
    return index.join(least, key, "left").where(~stale).drop("_least")


def page_violations(pages: DataFrame, rows: DataFrame, key: str = "kaiko_cd") -> DataFrame:
    """What is wrong with landed listing pages: (key, page_no, problem).

    ``pages``: key, page_no, lo, hi, total, is_error. ``rows``: key, page_no, course_code.
    The page before is met by an equi-join on its number, so a listing with very many pages
    is not one window. Codes are counted per page before anything is joined.
    """
    p = pages.select(key, "page_no", "lo", "hi", "total", "is_error")
    n = rows.groupBy(key, "page_no").agg(F.count("*").alias("n_rows"))
    prev = p.select(key, (F.col("page_no") + 1).alias("page_no"), F.col("hi").alias("_prev_hi"))
    first = p.where("page_no = 1").select(key, F.col("total").alias("_total"))
    last = p.groupBy(key).agg(F.max("page_no").alias("_last"))
    j = p.join(n, [key, "page_no"], "left").join(prev, [key, "page_no"], "left").join(first, key, "left").join(last, key, "left")
    got = F.coalesce("n_rows", F.lit(0))
    start = F.when(F.col("page_no") == 1, F.lit(0)).otherwise(F.col("_prev_hi"))
    check = [
        ("error page", F.col("is_error")),
        ("unreadable count", ~F.col("is_error") & F.col("total").isNull()),
        ("total changed", ~F.col("total").eqNullSafe(F.col("_total"))),
        ("gap before page", F.col("total").isNotNull() & (F.col("total") > 0) & (start.isNull() | (F.col("lo") != start + 1))),
        ("range reversed", F.col("hi") < F.col("lo")),
        ("past the total", F.col("hi") > F.col("total")),
        ("row count", F.col("total").isNotNull() & (F.col("total") > 0) & (got != F.col("hi") - F.col("lo") + 1)),
        ("ends early", (F.col("page_no") == F.col("_last")) & (F.col("hi") < F.col("total"))),
    ]
    problems = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in check]), lambda x: x.isNotNull())
    bad = j.select(key, "page_no", F.explode(problems).alias("problem"))
    again = (rows.groupBy(key, "course_code").agg(F.count("*").alias("_n"), F.max("page_no").alias("page_no"))
             .where("_n > 1").select(key, "page_no", F.lit("repeated code").alias("problem")).distinct())
    return bad.union(again)


def reconcile(pages: DataFrame, rows: DataFrame, key: str = "kaiko_cd") -> DataFrame:
    """Announced totals against distinct codes read; only the differing ones."""
    want = pages.groupBy(key).agg(F.max("total").alias("announced"))
    have = rows.select(key, "course_code").distinct().groupBy(key).agg(F.count("*").alias("n_read"))
    return (want.join(have, key, "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))
            .where("announced <> n_read"))


def ledger_row(df: DataFrame, job: str, scope: str, started: Column, status: str = "ok") -> DataFrame:
    """One run-ledger row from a job's result frame (fetched, changed, failed, bytes)."""
    return df.agg(F.count("*").cast("int").alias("n_target"), F.count_if("ok").cast("int").alias("n_fetched"),
                  F.count_if("changed").cast("int").alias("n_changed"), F.count_if(~F.col("ok")).cast("int").alias("n_error"),
                  F.sum("bytes").cast("bigint").alias("bytes")).select(
        F.lit(job).alias("job"), started.alias("started_at"), F.current_timestamp().alias("ended_at"), F.lit(scope).alias("scope"),
        "n_target", "n_fetched", "n_changed", "n_error", "bytes",
        F.when(F.col("n_error") > 0, "failed").otherwise(status).alias("status"))


class StaleError(RuntimeError):
    """Derived rows are older than the texts they were made from."""


def assert_fresh(raw: DataFrame, derived: DataFrame, key: list[str] = KEY) -> None:
    """Stop before a sink when a text is newer than what was derived from it."""
    from courseloom.operators.joins import mismatched

    n = mismatched(raw, derived, "body_sha256", "extracted_sha256", key).count()
    if n:
        raise StaleError(f"{n} texts differ from their derived rows; run the extraction first")
