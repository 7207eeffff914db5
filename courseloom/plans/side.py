"""Side-source pages (timetable grid and course pages) to catalog records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions import fields as FL
from courseloom.functions import grading as G
from courseloom.functions.html import flat_text
from courseloom.functions.text import blank_null, collapse, exploded, first_group, pieces, strip, texts_of
from courseloom.plans.extraction import keywords_of


def _last(items: Column, test) -> Column:
    hit = F.filter(items, test)
    return F.get(hit, F.size(hit) - 1)


def _after(text, pattern: str) -> Column:
    """Pieces that follow each match of a pattern."""
    return F.slice(texts_of(pieces(text, pattern, 0)), 2, 1 << 30)


def _context(row: Column) -> Column:
    """What a grid row without a link says: dept, inst, room; NULL where it says nothing."""
    vals = F.transform(F.regexp_extract_all(row, F.lit(V.TABLE_CELL), F.lit(1)), flat_text)
    wide = F.size(vals) >= 2
    is_room = lambda v: F.regexp_like(v, F.lit(V.SIDE_ROOM))
    ending = F.regexp_replace(_last(vals, lambda v: is_room(v) | v.endswith("教室")), r"\s*教室\z", "")
    inside = F.regexp_replace(_last(F.slice(vals, F.lit(3), F.greatest(F.size(vals), F.lit(1))), lambda v: is_room(v) | v.contains("教室") | v.contains("講義室")),
                              r"\s*(教室|講義室)\z", "")
    return F.struct(F.when(wide, F.nullif(F.get(vals, 0), F.lit(""))).alias("dept"),
                    F.when(wide, F.nullif(F.get(vals, 1), F.lit(""))).alias("inst"),
                    F.when(wide, F.coalesce(ending, inside, F.lit(""))).otherwise(ending).alias("room"))


def grid_rows(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per link of a timetable grid: num, weekday, period, room, instructor, dept,
    title, term label. A link takes what the rows before it in its cell said."""
    blocks = exploded(pages, keys, _after(html, V.SIDE_OUTER_ROW), "b", "block")
    blocks = blocks.withColumn("period", F.regexp_extract("b", V.SIDE_PERIOD, 1)).where("period <> ''")
    cells = exploded(blocks, [*keys, "block", "period"], F.slice(_after("b", V.SIDE_DAYCELL), 1, 7), "cell", "day")
    rows = cells.withColumn("rows", F.regexp_extract_all("cell", F.lit(V.SIDE_ROW), F.lit(1)))
    rows = rows.withColumn("ctx", F.transform("rows", lambda r: F.when(F.regexp_extract(r, V.SIDE_LINK, 1) == "", _context(r))))
    links = exploded(rows, [*keys, "block", "period", "day", "ctx"], F.col("rows"), "row", "at")
    links = links.withColumn("num", F.regexp_extract("row", V.SIDE_LINK, 1)).where("num <> ''")
    before = F.slice("ctx", F.lit(1), F.col("at"))
    said = lambda name: F.coalesce(_last(F.transform(F.filter(before, lambda x: x.isNotNull()), lambda x: x[name]),
                                         lambda v: v.isNotNull()), F.lit(""))
    return links.select(
        *keys, "block", "day", "at", "num", F.get(F.array(*map(F.lit, V.WEEKDAYS)), F.col("day")).alias("weekday"), "period",
        said("room").alias("room"), said("inst").alias("instructor"), said("dept").alias("dept"),
        flat_text(F.regexp_extract("row", V.SIDE_LINK, 2)).alias("title"),
        flat_text(F.regexp_extract("row", V.SIDE_BOLD, 1)).alias("term_label"))


def grid_courses(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per course number over all views: distinct slots, first non-empty fields.

    A course has at most weekdays x periods different slots, so the set stays small.
    """
    first = lambda c: F.coalesce(F.min(F.when(F.col(c) != "", F.struct(*order, F.col(c).alias("v"))))["v"], F.lit("")).alias(c)
    seen = F.min(F.struct(*order, "dept", "title", "term_label")).alias("_s")
    return (rows.groupBy("num").agg(F.array_sort(F.collect_set(F.struct("weekday", "period"))).alias("slots"),
                                    first("room"), first("instructor"), seen)
            .select("num", "slots", "room", "instructor", "_s.dept", "_s.title", "_s.term_label"))


def _items(html: Column) -> Column:
    """Non-empty pieces between line breaks."""
    return F.filter(F.transform(F.split(html, r"(?i)<BR>", -1), flat_text), lambda x: x != "")


def course_pages(pages: DataFrame, html: str = "html", num: str = "num") -> DataFrame:
    """Fields of individual course pages; what is not there is NULL."""
    g = lambda p, i=1: F.regexp_extract(html, p, i)
    df = pages.withColumn("_left", _items(g(V.SIDE_LEFT))).withColumn("_right", _items(g(V.SIDE_RIGHT)))
    pick = lambda arr, test: F.get(F.filter(arr, test), 0)
    names = F.regexp_extract_all(html, F.lit(V.SIDE_SECTION), F.lit(1))
    blobs = F.transform(F.regexp_extract_all(html, F.lit(V.SIDE_SECTION), F.lit(2)), flat_text)
    df = df.withColumn("_sec", F.filter(F.arrays_zip(names.alias("k"), blobs.alias("v")), lambda s: s["v"] != ""))
    sec = lambda k: pick("_sec", lambda s: s["k"] == k)["v"]
    plan_rows = F.regexp_extract_all(g(V.SIDE_PLAN), F.lit(V.SIDE_ROW), F.lit(1))
    vals = F.transform(plan_rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(V.TABLE_CELL), F.lit(1)), flat_text))
    vals = F.filter(vals, lambda v: (F.size(v) > 0) & ~F.exists(v, lambda x: x.startswith("進度")))
    body = F.filter(F.transform(vals, lambda v: F.get(F.filter(F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1))), lambda x: F.length(x) > 1), 0)), lambda b: b.isNotNull())
    right = F.array_join("_right", " ")
    left = F.array_join("_left", " ")
    room_end = pick("_right", lambda x: x.endswith("教室") & ~x.startswith("伊都"))
    room_zone = pick("_right", lambda x: x.contains("ゾーン") & x.contains("教室"))
    zone = strip(F.replace(F.regexp_replace(room_zone, r"^.*ゾーン\s*", ""), F.lit("教室"), F.lit("")))
    term = blank_null(first_group(right, V.SIDE_TERM))
    days, periods = (F.regexp_extract_all(right, F.lit(V.SIDE_SLOT), F.lit(i)) for i in (1, 2))
    grade = pick("_left", lambda x: x.startswith("対象学年"))
    return df.select(
        F.concat(F.lit(V.SIDE_CODE_PREFIX), F.col(num)).alias("course_code"), F.col(num).alias("num"),
        blank_null(flat_text(g(V.SIDE_TITLE))).alias("title"), flat_text(g(V.SIDE_TITLE, 2)).alias("title_en"),
        blank_null(flat_text(g(V.SIDE_SUBTITLE))).alias("subtitle"),
        blank_null(flat_text(g(V.SIDE_INSTRUCTOR, 2))).alias("instructors"),
        pick("_left", lambda x: x.contains("コース") | x.contains("学科")).alias("course_name"),
        F.regexp_replace(pick("_left", lambda x: x.contains("単位数")), r"\s*\(単位数.*", "").alias("category"),
        pick("_left", lambda x: x.endswith("科目") & (x.contains("選択") | x.contains("必修"))).alias("required"),
        blank_null(strip(F.regexp_replace(grade, "^[^:]*:?", ""))).alias("target_grade"),
        FL.credits(first_group(left, V.SIDE_CREDIT)).alias("credits"),
        blank_null(first_group(right, V.SIDE_NUMBERING)).alias("numbering"), term.alias("term"),
        pick("_right", lambda x: F.regexp_like(x, F.lit("^[A-Z/]+科目"))).alias("language"),
        F.coalesce(F.regexp_replace(room_end, r"\s*教室\z", ""), blank_null(zone)).alias("room"),
        F.transform(F.arrays_zip(days.alias("d"), periods.alias("p")), lambda s: F.struct(
            F.coalesce(term, F.lit("")).alias("term"), s["d"].alias("weekday"), s["p"].alias("period"))).alias("slots"),
        blank_null(flat_text(g(V.SIDE_KEYWORDS))).alias("keywords"),
        F.transform(body, lambda b, i: F.struct((i + 1).cast("int").alias("no"), F.substring(b, 1, V.DETAIL_MAX).alias("theme"),
                                                F.lit(None).cast("string").alias("detail"))).alias("plan"),
        sec("授業の概要").alias("outline"), F.coalesce(sec("成績評価"), sec("成績評価方法")).alias("grading"))


def with_grid(courses: DataFrame, grid: DataFrame) -> DataFrame:
    """Slots and room of the grid win over those of the page; the department is the grid's."""
    g = grid.select("num", F.col("slots").alias("_slots"), F.col("room").alias("_room"), "dept")
    placed = F.transform("_slots", lambda s: F.struct(F.coalesce(F.col("term"), F.lit("")).alias("term"),
                                                      s["weekday"].alias("weekday"), s["period"].alias("period")))
    return (courses.join(g, "num", "left").withColumn("slots", F.when(F.size("_slots") > 0, placed).otherwise(F.col("slots")))
            .withColumn("room", F.coalesce(blank_null("_room"), F.col("room"))).drop("_slots", "_room"))


def records(courses: DataFrame, url: str | None = None) -> DataFrame:
    """Course pages as catalog records."""
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = collapse(F.regexp_replace(e("grading"), V.SIDE_RUBRIC, " "))
    df = G.with_grading(courses.withColumn("_g", text), "_g")
    flags = G.eval_flags("_g", "gr", "gu")
    df = df.withColumn("tm", F.replace(e("term"), F.lit("クォータ"), F.lit("学期")))
    sl = F.transform("slots", lambda s: F.struct(F.col("tm").alias("term"), s["weekday"].alias("weekday"), s["period"].alias("period")))
    return df.select(
        F.col("course_code").alias("c"), e("title").alias("t"), e("subtitle").alias("s"), F.lit(V.SIDE_FACULTY).alias("f"),
        FL.grades("target_grade", F.lit(V.SIDE_FACULTY)).alias("g"), e("target_grade").alias("grraw"), F.col("credits").alias("cr"),
        e("required").alias("rq"), "tm", FL.term_group("tm").alias("tg"), e("category").alias("cat"), F.lit("").alias("catr"),
        F.when((e("room") != "") | (e("course_name") != ""), V.SIDE_CAMPUS).otherwise("").alias("cp"), e("language").alias("ln"),
        F.filter(F.array(strip(e("instructors"))), lambda x: x != "").alias("i"), sl.alias("sl"),
        FL.flag("tm", V.INTENSIVE_WORDS).alias("iv"), F.lit(0).alias("ol"), F.array(*flags.values()).alias("ev"),
        "gr", "gu", "gx", "gt", F.when(F.size("gr") > 0, "").otherwise(F.col("_g")).alias("ep"), F.col("plan").alias("pl"),
        keywords_of(F.col("keywords")).alias("kw"), F.substring(collapse(e("outline")), 1, V.OUTLINE_MAX).alias("d"),
        e("numbering").alias("n"), (F.col(url) if url else F.lit("")).alias("su"), e("room").alias("rm"),
        F.when(e("dept") != "", F.array("dept")).alias("dp"))


def keep_if_empty(df: DataFrame, write) -> bool:
    """Write only a non-empty result, so that a source without rows keeps the old output."""
    if df.isEmpty():
        return False
    write(df)
    return True
