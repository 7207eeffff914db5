"""Search over the catalog: facet filters, keywords, timetable grid, conflicts, counts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.fields import term_group
from courseloom.functions.text import exploded
from courseloom.session import written

ALL_DAYS = V.WEEKDAYS
NO_CAMPUS = ["", "＿"]


@dataclass
class Facets:
    """What a user picked. An empty pick does not restrict."""

    equal: dict[str, str] = field(default_factory=dict)           # column -> value
    member: dict[str, object] = field(default_factory=dict)       # array column -> member
    any_of: dict[str, list] = field(default_factory=dict)         # column -> accepted values
    text: str = ""                                                # words, all needed
    slot: tuple[str, str] | None = None                           # weekday, period
    unplaced: bool = False
    with_application: bool = False

    def conditions(self, df: DataFrame) -> dict[str, Column]:
        out: dict[str, Column] = {}
        out.update({c: F.col(c) == v for c, v in self.equal.items()})
        out.update({c: F.array_contains(c, v) for c, v in self.member.items()})
        out.update({c: F.col(c).isin(list(v)) for c, v in self.any_of.items() if v})
        words = keyword_words(self.text)
        if words:
            out["text"] = all_words(F.col("search_text"), words)
        if self.slot:
            out["slot"] = in_slot(F.col("sl"), *self.slot)
        if self.unplaced:
            out["unplaced"] = ~is_placed(F.col("sl"))
        if self.with_application:
            out["application"] = F.coalesce(F.size("ap") > 0, F.lit(False))
        return out


def keyword_words(text: str) -> list[str]:
    """Query words in the form of the search text: NFKC, lower case, split on white space."""
    return unicodedata.normalize("NFKC", text).lower().split()


def all_words(search_text: Column, words: list[str]) -> Column:
    cond = F.lit(True)
    for w in words:
        cond = cond & search_text.contains(w)
    return cond


def in_slot(slots: Column, weekday: str, period: str) -> Column:
    return F.exists(slots, lambda s: (s["weekday"] == weekday) & (s["period"] == period))


def valid_slot(s: Column) -> Column:
    """On a weekday, in a one-digit period."""
    return s["weekday"].isin(ALL_DAYS) & F.regexp_like(s["period"], F.lit("^[1-9]$"))


def is_placed(slots: Column) -> Column:
    return F.coalesce(F.exists(slots, valid_slot), F.lit(False))


def search(df: DataFrame, facets: Facets) -> DataFrame:
    """Rows that meet every picked facet, in one filter."""
    for cond in facets.conditions(df).values():
        df = df.where(cond)
    return df


def ranked(df: DataFrame, column: str, order: list[str], code: str) -> DataFrame:
    """Fixed rank order of a column, unknown values after it by text, then by code."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    rank = F.coalesce(rank, F.lit(0))
    return df.orderBy(rank == 0, rank, F.when(rank == 0, F.col(column)), code)


def result_page(df: DataFrame, column: str, order: list[str], code: str, page: int = 0, size: int = 300) -> DataFrame:
    return ranked(df, column, order, code).offset(page * size).limit(size)


def facet_values(df: DataFrame, faculty: str, order: list[str], campus: str) -> DataFrame:
    """Distinct facet values with their place: faculties in rank order, campuses by text."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("value")), F.lit(0))
    fac = (df.select(F.col(faculty).alias("value")).where("value <> ''").distinct()
           .select(F.lit("faculty").alias("facet"), "value", F.when(rank > 0, rank).cast("int").alias("place")))
    cam = (df.select(F.col(campus).alias("value")).where(~F.col("value").isin(NO_CAMPUS)).distinct()
           .select(F.lit("campus").alias("facet"), "value", F.lit(None).cast("int").alias("place")))
    return fac.union(cam)


def term_map(df: DataFrame, term: str = "tm", slots: str = "sl") -> DataFrame:
    """Distinct terms of courses and of their slots, each with its group."""
    terms = exploded(df, [], F.array_union(F.transform(slots, lambda s: s["term"]), F.array(term)), "term")
    return terms.where("term <> ''").distinct().select("term", term_group("term").alias("term_group"))


def used_groups(df: DataFrame, group: str = "tg") -> DataFrame:
    """Term groups in use, in their fixed order, with the season each belongs to."""
    names = list(V.TERM_GROUPS)
    used = df.select(F.col(group).alias("term_group")).union(term_map(df).select("term_group")).distinct()
    season = F.when(F.col("term_group").isin(V.SPRING_GROUPS), "spring").when(F.col("term_group").isin(V.AUTUMN_GROUPS), "autumn")
    place = F.array_position(F.array(*map(F.lit, names)), F.col("term_group")).cast("int")
    return used.select("term_group", place.alias("place"), season.alias("season")).where("place > 0")


def slots_in_groups(df: DataFrame, groups: list[str], key: str, slots: str = "sl") -> DataFrame:
    """Slots whose own term is in a picked group (all when none is picked)."""
    rows = exploded(df, [key], F.col(slots), "s").select(key, "s.*").withColumn("term_group", term_group("term"))
    return rows.where(F.col("term_group").isin(groups)) if groups else rows


def cells(df: DataFrame, key: str, slots: str = "sl") -> DataFrame:
    """Distinct valid (weekday, period) cells of each course."""
    placed = F.filter(slots, valid_slot)
    cell = F.array_distinct(F.transform(placed, lambda s: F.struct(s["weekday"].alias("weekday"), s["period"].alias("period"))))
    return exploded(df, [key], cell, "s").select(key, "s.weekday", "s.period")


def grid_counts(placed: DataFrame, weekdays=ALL_DAYS) -> DataFrame:
    """Courses per weekday and period; ``placed`` has each course once per cell.

    Deduplicating inside the row makes the distinct count a plain count: one partial
    aggregate with at most periods x weekdays groups.
    """
    return placed.groupBy("period").pivot("weekday", list(weekdays)).agg(F.count(F.lit(1))).na.fill(0)


def full_grid(grid: DataFrame, least: int = 5) -> DataFrame:
    """At least the first five periods are rows of the grid."""
    spark = grid.sparkSession
    every = spark.range(1, least + 1).select(F.col("id").cast("string").alias("period"))
    return grid.join(every, "period", "full").na.fill(0)


def halves(group: Column) -> Column:
    """Half-seasons a term group takes up: a half-length group one, others both or all."""
    h = lambda s, n: F.struct(F.lit(s).alias("season"), F.lit(n).alias("half"))
    out = F.when(group == "前期", F.array(h("spring", 1), h("spring", 2))).when(
        group == "後期", F.array(h("autumn", 1), h("autumn", 2)))
    for name, (s, n) in V.HALVES.items():
        out = out.when(group == name, F.array(h(s, n)))
    return out.otherwise(F.array(*[h(s, n) for s in ("spring", "autumn") for n in (1, 2)]))


HALF_BITS = [(s, n) for s in ("spring", "autumn") for n in (1, 2)]


def half_mask(group: Column) -> Column:
    """``halves`` as one number, a bit for each of ``HALF_BITS``."""
    bit = {h: 1 << i for i, h in enumerate(HALF_BITS)}
    of = lambda season: bit[season, 1] | bit[season, 2]
    out = F.when(group == "前期", of("spring")).when(group == "後期", of("autumn"))
    for name, half in V.HALVES.items():
        out = out.when(group == name, bit[tuple(half)])
    return out.otherwise(of("spring") | of("autumn"))


def conflicts(rows: DataFrame, owner: list[str], code: str) -> DataFrame:
    """Cells where an owner has several courses in the same half-season.

    ``rows``: owner columns, code, weekday, period, term_group. Counts only (partial
    aggregates); join back on the cell to list its courses. A course is one row a cell and a cell
    one row, with its half-seasons as bits and counts: they are unfolded last.
    """
    cell = rows.groupBy(*owner, code, "weekday", "period").agg(F.bit_or(half_mask(F.col("term_group"))).alias("_m"))
    counts = [F.count_if(F.col("_m").bitwiseAND(F.lit(1 << i)) != 0).alias(f"_n{i}") for i in range(len(HALF_BITS))]
    each = F.array(*[F.struct(F.lit(s).alias("season"), F.lit(n).alias("half"), F.col(f"_n{i}").alias("n_courses"))
                     for i, (s, n) in enumerate(HALF_BITS)])
    return (cell.groupBy(*owner, "weekday", "period").agg(*counts).where(F.greatest(*[f"_n{i}" for i in range(len(HALF_BITS))]) >= 2)
            .select(*owner, "weekday", "period", F.inline(each)).where("n_courses >= 2"))


def conflict_rows(rows: DataFrame, found: DataFrame, owner: list[str], code: str) -> DataFrame:
    cell = rows.select(*owner, code, "weekday", "period", F.explode(halves(F.col("term_group"))).alias("h"))
    cell = cell.select(*owner, code, "weekday", "period", "h.season", "h.half").distinct()
    return cell.join(found, [*owner, "weekday", "period", "season", "half"])


def leave_one_out(df: DataFrame, picked: dict[str, Column], counted: list[str]) -> DataFrame:
    """(facet, value, n) of each counted column under all filters except its own, in one scan."""
    misses = sum((F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1) for c in picked.values()), F.lit(0))
    alone = lambda name: (F.when(F.coalesce(picked[name], F.lit(False)), 0).otherwise(1) if name in picked else F.lit(0))
    pairs = [F.when(F.col("_misses") == alone(n), F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value"))) for n in counted]
    rows = df.withColumn("_misses", misses).where("_misses <= 1").select(F.explode(F.array(*pairs)).alias("p"))
    return rows.where("p IS NOT NULL").select("p.*").groupBy("facet", "value").agg(F.count("*").alias("n"))


def credit_totals(rows: DataFrame, by: list[str], credits: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(credits).alias("credits"), F.count("*").alias("n_courses"))


def share_text(codes: DataFrame, owner: list[str], code: str) -> DataFrame:
    """Sorted distinct codes joined by dots: an owner's own short list as a link text."""
    return codes.groupBy(*owner).agg(F.array_join(F.array_sort(F.collect_set(code)), ".").alias("share"))


COUNTED_MEMBERS = 4_000_000     # list members that a task counts together, about


def _member_counts(least: int):
    # inner functions travel to the executors by value: they need not have this package
    enough = COUNTED_MEMBERS

    def counted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, groups, lists = (c.combine_chunks() for c in pa.Table.from_batches(batches).columns)
        owner, members = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
        places = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
        known = np.flatnonzero(pc.is_valid(members).to_numpy(zero_copy_only=False) & pc.is_valid(groups).to_numpy(zero_copy_only=False)[owner])
        owner, places = owner[known], places[known]
        members, groups = members.take(pa.array(known)).dictionary_encode(), groups.dictionary_encode()
        size = max(1, len(members.dictionary))
        pairs = groups.indices.fill_null(0).to_numpy()[owner].astype(np.int64) * size + members.indices.to_numpy()
        order = np.argsort(pairs)
        pairs = pairs[order]
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(pairs)])
        few = n < least
        rows = order[np.repeat(few, n)]
        spots = pa.StructArray.from_arrays([keys.take(pa.array(owner[rows])), pa.array(places[rows], pa.int32())], names=["_k", "_i"])
        spots = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(few, n, 0))], pa.int32()), spots)
        found = pairs[first]
        return pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(found // size)), members.dictionary.take(pa.array(found % size)),
                                           pa.array(n, pa.int64()), spots], names=["_g", "_m", "_n", "_spots"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += pc.sum(pc.list_value_length(batch.column(2))).as_py() or 0
            if n >= enough:
                yield counted(held)
                held, n = [], 0
        if held:
            yield counted(held)

    return rows


def rare_spots(df: DataFrame, key: str, group: str, items: str, least: int) -> DataFrame:
    """(_k, _i): the places in a key's list of the members that fewer than ``least`` rows of the group carry.

    A task counts the members of some millions of list places at once and hands on one row for each
    (group, member): its number and, only where that is below ``least``, the places. So a frequent
    member is a row a task, and only rare ones bring their keys.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.get(items, 0).alias("_m")).schema}
    counts = df.select(key, group, items).mapInArrow(
        _member_counts(least), f"_g {kind['_g']}, _m {kind['_m']}, _n bigint, _spots array<struct<_k: {kind['_k']}, _i: int>>")
    total = F.sum("_n").over(Window.partitionBy("_g", "_m"))
    return counts.withColumn("_total", total).where(F.col("_total") < least).select(F.inline("_spots"))


def prune_rare(df: DataFrame, key: str, group: str, items: str, least: int = V.DEPARTMENT_MIN_COUNT, keep: DataFrame | None = None) -> DataFrame:
    """Drop list members that few rows of the group carry; an emptied list becomes NULL.

    Only the places of rare members are rows and meet the lists by the key, so the work beyond one
    pass follows their number, and no list is taken apart and rebuilt. A NULL group or member is
    never kept. Where the members to ``keep`` (_g, _m) are known from elsewhere, nothing is counted
    and the exploded rows meet them on both columns.
    """
    if keep is None:
        drops = rare_spots(df, key, group, items, least).groupBy(F.col("_k").alias(key)).agg(F.collect_list("_i").alias("_drop"))
        places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1))
        left = F.array_except(places, F.coalesce("_drop", F.array().cast("array<int>")))
        left = F.filter(F.transform(left, lambda i: F.get(items, i)), lambda x: x.isNotNull())
        known = F.col(key).isNotNull() & F.col(group).isNotNull()
        pruned = df.join(drops, key, "left").withColumn(items, F.when(known, left)).drop("_drop")
        return pruned.withColumn(items, F.when(F.size(items) > 0, F.col(items)))
    rows = exploded(df, [key, F.col(group).alias("_g")], F.col(items), "_m", "_i")
    kept = (rows.join(keep, ["_g", "_m"], "left_semi").groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_kept")))
    return (df.join(kept, key, "left").withColumn(items, F.transform("_kept", lambda x: x["_m"])).drop("_kept"))


def rare_values(df: DataFrame, column: str, counted: Column, least: int = V.CATEGORY_MIN_COUNT) -> DataFrame:
    """Values that fewer than ``least`` of the counted rows have (partial aggregate)."""
    return (df.where(counted & F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
            .where(F.col("_n") < least).select(column))


def fold_values(df: DataFrame, rare: DataFrame, column: str, counted: Column, other: str = V.CATEGORY_OTHER) -> DataFrame:
    """Counted rows with a rare value take the 'other' name; NULL stays NULL."""
    df = df.join(rare.withColumn("_rare", F.lit(True)), column, "left")
    return df.withColumn(column, F.when(F.col("_rare") & counted, other).otherwise(F.col(column))).drop("_rare")


def fold_rare(df: DataFrame, category: str, counted: Column, least: int = V.CATEGORY_MIN_COUNT,
              other: str = V.CATEGORY_OTHER) -> DataFrame:
    """Rows of a category with few counted rows take the 'other' name.

    Hot categories are joined, not windowed, so none of them fills one task. The rare ones
    are written first: by their size the planner broadcasts them, and no row is shuffled.
    """
    rare = written(rare_values(df, category, counted, least), "rare")
    return fold_values(df, rare, category, counted, other)
