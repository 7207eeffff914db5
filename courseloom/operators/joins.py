"""Keyed joins of the catalog: inner, missing, mismatch, guarded, nested, enriching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["university_id", "year", "course_code"]


def inner_all(first: DataFrame, *others: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Inner equi-join of tables on one key; all sides share the key's partitioning."""
    for other in others:
        first = first.join(other, key)
    return first


def missing(wanted: DataFrame, done: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Keys of ``wanted`` without a row in ``done``."""
    return wanted.join(done.select(*key), key, "left_anti")


def targets(wanted: DataFrame, done: DataFrame, key: list[str] = KEY, limit: int | None = None) -> DataFrame:
    """Missing keys in order; with a limit only so many, taken from the front by each task first."""
    rows = missing(wanted, done, key).orderBy(*key)
    return rows if limit is None else rows.limit(limit)


def mismatched(raw: DataFrame, derived: DataFrame, raw_hash: str, derived_hash: str, key: list[str] = KEY) -> DataFrame:
    """Rows whose derived hash differs from the raw one; a missing row counts as different."""
    d = derived.select(*key, F.col(derived_hash).alias("_derived"))
    return (raw.select(*key, F.col(raw_hash).alias("raw_hash")).join(d, key, "left")
            .where(~F.col("raw_hash").eqNullSafe(F.col("_derived")))
            .withColumnRenamed("_derived", "derived_hash"))


def guarded(left: DataFrame, lookup: DataFrame, key: list[str], left_hash: str, lookup_hash: str,
            value: str, out: str) -> DataFrame:
    """Left join that takes the value only where both hashes agree."""
    r = lookup.select(*key, F.col(lookup_hash).alias("_hash"), F.col(value).alias(out))
    on = [left[k] == r[k] for k in key] + [left[left_hash] == r["_hash"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond, "left").select(left["*"], r[out])


def nest(children: DataFrame, key: list[str], order: list[str], item: Column, out: str = "items") -> DataFrame:
    """One ordered child list per parent, as long as the parent has children.

    Only what the list shows is shuffled, and the list is one cell of its parent: for parents
    whose children don't belong in one cell there is ``nest_pages``.
    """
    packed = F.struct(*[F.col(o).alias(f"_{i}") for i, o in enumerate(order)], item.alias("v"))
    return (children.groupBy(*key).agg(F.array_sort(F.collect_list(packed)).alias("_all"))
            .select(*key, F.transform("_all", lambda x: x["v"]).alias(out)))


def nest_pages(children: DataFrame, key: list[str], order: list[str], item: Column, page: int, out: str = "items") -> DataFrame:
    """Child lists in pages of at most ``page`` sequence numbers, for output that is paged itself:
    one row per parent and page_no, never joined back as if it were one.

    The first order column is the child's sequence number, unique within its parent.
    """
    paged = children.withColumn("page_no", F.floor(F.col(order[0]) / F.lit(page)).cast("int"))
    return nest(paged, [*key, "page_no"], order, item, out)


def with_children(parents: DataFrame, nested: DataFrame, key: list[str], out: str, item_type: str) -> DataFrame:
    """Left join of a nested list; a parent without children gets an empty list."""
    empty = F.array().cast(f"array<{item_type}>")
    return parents.join(nested, key, "left").withColumn(out, F.coalesce(F.col(out), empty))


def override(df: DataFrame, side: DataFrame, key: list[str], columns: dict[str, str]) -> DataFrame:
    """Take the side's non-empty value over the current one (column -> side column)."""
    s = side.select(*key, *[F.nullif(F.col(b), F.lit("")).alias(f"_{a}") for a, b in columns.items()])
    df = df.join(s, key, "left")
    for a in columns:
        df = df.withColumn(a, F.coalesce(F.col(f"_{a}"), F.col(a)))
    return df.drop(*[f"_{a}" for a in columns])


def fill(df: DataFrame, side: DataFrame, key: list[str], value: str, also: dict[str, str] | None = None,
         side_value: str | None = None) -> DataFrame:
    """Set a value (and what goes with it) only where the current one is absent."""
    also = also or {}
    s = side.select(*key, F.col(side_value or value).alias("_value"),
                    *[F.col(b).alias(f"_{a}") for a, b in also.items()])
    df = df.join(s, key, "left")
    take = (F.coalesce(F.col(value), F.lit("")) == "") & F.col("_value").isNotNull()
    for a in also:
        df = df.withColumn(a, F.when(take, F.col(f"_{a}")).otherwise(F.col(a)))
    return (df.withColumn(value, F.when(take, F.col("_value")).otherwise(F.col(value)))
            .drop("_value", *[f"_{a}" for a in also]))


def append_absent(main: DataFrame, side: DataFrame, key: list[str]) -> DataFrame:
    """Side rows whose key the main table lacks are added; existing rows win."""
    new = side.join(main.select(*key), key, "left_anti")
    return main.unionByName(new, allowMissingColumns=True)


def chosen(df: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Only the rows on a code list, whatever other filters say."""
    return df.join(codes.select(key), key, "left_semi")


def import_codes(held: DataFrame, shared: DataFrame, catalog: DataFrame, key: str, mode: str = "add") -> DataFrame:
    """Code list after importing a shared one: 'replace', 'add' or 'ignore'; unknown codes stay out."""
    known = shared.select(key).distinct().join(catalog.select(key), key, "left_semi")
    if mode == "ignore":
        return held.select(key).distinct()
    return known if mode == "replace" else held.select(key).union(known).distinct()


def unknown_codes(shared: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    return shared.select(key).distinct().join(catalog.select(key), key, "left_anti")
