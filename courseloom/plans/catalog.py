"""Current catalog: structured courses with state, side sources, rooms and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions import fields as FL
from courseloom.functions.text import blank_null, search_key, strip, text_or_empty
from courseloom.operators import facets, joins, snapshots
from courseloom.plans.extraction import KEY, keywords_of

ROOM_COLUMNS = ["rm", "rmu", "kl", "ap", "apu", "su"]


def first_slot_term(slots: Column) -> Column:
    return F.get(F.filter(F.transform(slots, lambda s: s["term"]), lambda t: strip(F.coalesce(t, F.lit(""))) != ""), 0)


def course_term(term: Column, slots: Column) -> Column:
    """A course's term; an empty one is taken from its first slot that has one."""
    return F.coalesce(blank_null(strip(text_or_empty(term))), first_slot_term(slots), F.lit(""))


def current_rows(structured: DataFrame, index: DataFrame, runs: DataFrame, undergrad_only: bool = True) -> DataFrame:
    """Structured rows that are still listed. The run ledger is reduced to one row per code
    before it meets the index; index and courses are joined on the same key."""
    if undergrad_only:
        structured = structured.where("is_undergrad = 1")
    live = snapshots.not_stale(index.select(*KEY, "kaiko_cd", "last_seen"), snapshots.latest_sweeps(runs))
    return structured.join(live.select(*KEY), KEY)


def shape(rows: DataFrame) -> DataFrame:
    """Structured rows as catalog records."""
    e = lambda c: text_or_empty(c)
    tm = course_term(F.col("term"), F.col("sl"))
    raw_cat = e("category_raw")
    dp = FL.departments(e("faculty"), "faculty_raw")
    records = rows.withColumn("tm", tm).select(
        F.col("course_code").alias("c"), e("title").alias("t"),
        F.when(F.col("subtitle") != F.coalesce("title", F.lit("")), F.col("subtitle")).otherwise("").alias("s"),
        e("faculty").alias("f"), F.col("grades").alias("g"), e("target_grade").alias("grraw"),
        F.col("credits").alias("cr"), e("required").alias("rq"), "tm", FL.term_group("tm").alias("tg"),
        e("category").alias("cat"),
        F.when(FL.normalize_category(raw_cat) == e("category"), "").otherwise(raw_cat).alias("catr"),
        e("campus").alias("cp"), e("language").alias("ln"), FL.name_list("instructors").alias("i"), "sl",
        F.col("is_intensive").alias("iv"), F.col("is_online").alias("ol"),
        F.array("eval_exam", "eval_report", "eval_quiz", "eval_attend").alias("ev"),
        "gr", "gu", "gx", "gt", "ep", "pl", keywords_of(F.col("keywords")).alias("kw"), "d",
        e("numbering").alias("n"), F.when(F.size(dp) > 0, dp).alias("dp"))
    empty = {"ap": "map<string,string>"}
    return records.select("*", *[F.lit(None).cast(empty.get(c, "string")).alias(c) for c in ROOM_COLUMNS])


def merge_course_list(catalog: DataFrame, listed: DataFrame) -> DataFrame:
    """Rooms, classes and application marks of the code-keyed course list.

    ``listed``: c, room, klass, apply map, source_url. A room replaces the current one with
    its source; cohorts without a mark are left out.
    """
    marks = F.map_filter("apply", lambda k, v: v != "")
    side = listed.select("c", blank_null("room").alias("_room"), blank_null("klass").alias("_klass"),
                         F.when(F.size(marks) > 0, marks).alias("_ap"), F.col("source_url").alias("_url"))
    df = catalog.join(side, "c", "left")
    return (df.withColumn("rm", F.coalesce("_room", "rm"))
            .withColumn("rmu", F.when(F.col("_room").isNotNull(), F.col("_url")).otherwise(F.col("rmu")))
            .withColumn("kl", F.coalesce("_klass", "kl")).withColumn("ap", F.coalesce("_ap", "ap"))
            .withColumn("apu", F.when(F.col("_ap").isNotNull(), F.col("_url")).otherwise(F.col("apu")))
            .drop("_room", "_klass", "_ap", "_url"))


def merge_rooms(catalog: DataFrame, rooms: DataFrame) -> DataFrame:
    """Timetable rooms for courses that still have none. ``rooms``: c, room, source_url."""
    return joins.fill(catalog, rooms.select("c", "room", "source_url"), ["c"], "rm", {"rmu": "source_url"}, "room")


def with_search_text(catalog: DataFrame) -> DataFrame:
    """Precompute what keyword search reads, so that a query is a plain filter."""
    return catalog.withColumn("search_text", search_key("t", "s", F.array_join("i", " "), "kw", "c", "n"))


def build(structured: DataFrame, index: DataFrame, runs: DataFrame, side: DataFrame | None = None,
          listed: DataFrame | None = None, rooms: DataFrame | None = None, undergrad_only: bool = True) -> DataFrame:
    """The whole catalog. Side tables are small next to it; the planner broadcasts them when
    their size allows and otherwise joins on the code."""
    cat = shape(current_rows(structured, index, runs, undergrad_only))
    if side is not None:
        cat = joins.append_absent(cat, side, ["c"])
    if listed is not None:
        cat = merge_course_list(cat, listed)
    if rooms is not None:
        cat = merge_rooms(cat, rooms)
    return with_search_text(facets.prune_rare(cat, "c", "f", "dp"))


def meta(catalog: DataFrame, missing: DataFrame, year: int, undergrad_only: bool) -> DataFrame:
    """One-row document of the settings and facet values a client needs.

    Facet values, terms and groups are small dictionaries; the missing list and the catalog
    are only counted here and are written as their own tables.
    """
    f = facets.facet_values(catalog, "f", V.FACULTY_ORDER, "cp")
    values = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("facet") == name, F.struct(
        F.coalesce("place", F.lit(len(V.FACULTY_ORDER) + 1)).alias("p"), F.col("value").alias("v"))))), lambda x: x["v"])
    a = f.agg(values("faculty").alias("faculties"), values("campus").alias("campuses"))
    g = facets.used_groups(catalog).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term_group"))), lambda x: x["term_group"]).alias("term_groups"))
    m = facets.term_map(catalog).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "term_group")))).alias("term_group_map"))
    n = catalog.agg(F.count("*").alias("n"))
    u = missing.agg(F.count("*").alias("n_missing"))
    seasons = F.struct(F.array(*map(F.lit, V.SPRING_GROUPS)).alias("spring"), F.array(*map(F.lit, V.AUTUMN_GROUPS)).alias("autumn"))
    one = n.withColumn("_k", F.lit(1))
    for part in (u, a, g, m):                                          # each is one row
        one = one.join(part.withColumn("_k", F.lit(1)), "_k")
    one = one.drop("_k")
    return one.select(F.lit(year).alias("year"), F.lit(undergrad_only).alias("undergrad_only"),
                      F.current_timestamp().alias("generated_at"), "*", seasons.alias("seasons"),
                      F.lit(V.SHARDS).alias("detail_shards"), F.lit(V.CATEGORY_OTHER).alias("category_other"))


def export_rows(structured: DataFrame, raw: DataFrame, summary: DataFrame, undergrad_only: bool = True) -> DataFrame:
    """Flat export: slots as one text, the summary only if it was made from the current text."""
    cols = ["title", "subtitle", "faculty", "department", "title_suffix", "target_grade", "credits", "required", "term",
            "campus", "language", "instructors", "is_intensive", "is_online", "eval_exam", "eval_report", "eval_quiz",
            "eval_attend", "keywords", "numbering"]
    df = structured.where("is_undergrad = 1") if undergrad_only else structured
    slots = F.array_join(F.transform("sl", lambda s: F.concat(s["weekday"], s["period"])), " ")
    df = df.select(*KEY, *cols, blank_null(slots).alias("slots")).join(raw.select(*KEY, "body_sha256"), KEY, "left")
    out = joins.guarded(df, summary, KEY, "body_sha256", "source_sha256", "summary", "summary")
    return out.orderBy(F.asc_nulls_first("faculty"), "course_code").select("course_code", *cols, "slots", "summary")
