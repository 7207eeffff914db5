"""Timetable lines and cells to rooms, statistics and titles that no course has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions import names as N
from courseloom.operators import resolve as R
from courseloom.session import fixed_frame, written
from courseloom.sources import pages as P

# faculty -> (room pattern, are unmatched titles reported)
MARKER_FACULTIES = {"教育学部": ("bracket", True), "理学部": ("science", False), "法学部": ("law", True),
                    "工学部": ("paren", False), "芸術工学部": ("paren", False)}
CODE_FACULTY, GRID_FACULTY, SLASH_FACULTY = "農学部", "経済学部", "共創学部"
# the order in which sources are read: a later one replaces a course's room, an earlier one names a missing title
SOURCES = ["教育学部", "理学部", "農学部", "経済学部", "法学部", "工学部", "芸術工学部", "共創学部"]
ROOMLESS_FACULTY = "基幹教育科目"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def marker_matches(lines: DataFrame, courses: DataFrame) -> DataFrame:
    """Matches of all faculties that mark rooms in their lines; courses of others have no line here."""
    courses = courses.where(F.col("faculty").isin([*MARKER_FACULTIES]))
    found = [R.mentions(lines.where(F.col("faculty") == f), V.ROOM_PATTERNS[p]) for f, (p, _) in MARKER_FACULTIES.items()]
    return R.match_mentions(_union(found), courses)


def sessions(cells: DataFrame) -> DataFrame:
    """Sessions of the wide grid: first page spring, second autumn, repeated ones united.

    ``cells``: page, table_no, row_no, cells. ``row_id`` is the place of the first sighting.
    """
    grid = P.wide_grid(P.largest_table(cells, ["page"]), ["page", "table_no"])
    grid = grid.withColumn("term", F.when(F.col("page") == 1, "前期").otherwise("後期"))
    grid = grid.withColumn("instructor", F.btrim("instructor", F.lit("（）()")))
    grid = grid.withColumn("row_id", F.struct("page", "table_no", "row_no", F.col("period").cast("int").alias("period")))
    slot = F.struct("weekday", F.col("period").cast("string").alias("period"))
    out = P.merge_sessions(grid, ["term", "title", "room", "instructor"], slot, ["row_id"], ["grade"])
    first = grid.groupBy("term", "title", "room", "instructor").agg(F.min("row_id").alias("row_id"))
    out = out.join(first, ["term", "title", "room", "instructor"])
    basic = F.startswith("grade", F.lit("【基"))
    return out.select("row_id", "title", "term", "room", "slots",
                      F.filter(F.array("instructor"), lambda x: x != "").alias("instructors"),
                      F.when(F.startswith("grade", F.lit("【")), "").otherwise(F.col("grade")).alias("target_grade"),
                      F.when(basic, "専攻教育科目").otherwise("").alias("category"))


def grid_rooms(sessions: DataFrame, courses: DataFrame) -> DataFrame:
    """Grid sessions (title, term, room, slots, instructors) matched by name, slot, teacher."""
    from courseloom.functions.fields import season

    rows = sessions.select("row_id", N.match_key("title").alias("name"), season("term").alias("season"), "slots",
                           F.transform("instructors", R.grid_surname).alias("surnames"), N.clean_room("room").alias("room"))
    own = R.dictionary(courses.where(F.col("faculty") == GRID_FACULTY))
    return R.progressive(rows.where("room <> ''"), own)


def _rank(faculty) -> Column:
    return F.array_position(F.array(*map(F.lit, SOURCES)), faculty)


def build(lines: DataFrame, sessions: DataFrame, courses: DataFrame, urls: DataFrame | None = None,
          grid_file: str = "", code_scope: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """One room per course, statistics per faculty, titles and codes that no course has.

    ``lines``: faculty, file, file_ord, line_no, season, line. ``urls``: file, source_url, the page
    that offers a file; ``grid_file`` is the file of the sessions. ``rooms`` (c, room, faculty, file,
    source_url) is what the catalog merges. ``missing_by_faculty`` counts the missing rows.
    ``code_scope``: see ``resolve.unknown_code_rows``.
    """
    matched = written(marker_matches(lines, courses), "matched")
    code_lines = lines.where(F.col("faculty") == CODE_FACULTY)
    found = written(R.code_mentions(code_lines), "codes")
    by_code = R.code_rooms(found, courses)
    by_grid = grid_rooms(sessions, courses)
    # first wins inside a source, the later source wins between them
    own = R.first_by(matched.where("code IS NOT NULL"), ["faculty", "code"], R.READING, ["room", "file"])
    rooms = _union([
        own.select("faculty", "code", "room", "file"),
        R.first_by(by_code.where("verdict = 'ok'"), ["code"], R.READING, ["room", "file"]).withColumn("faculty", F.lit(CODE_FACULTY)),
        by_grid.where("outcome = 'one'").groupBy("code").agg(F.max_by("room", "row_id").alias("room"))
        .select(F.lit(GRID_FACULTY).alias("faculty"), "code", "room", F.lit(grid_file).alias("file"))])
    rooms = rooms.groupBy("code").agg(F.max(F.struct(_rank(F.col("faculty")).alias("rank"), "faculty", "room", "file")).alias("r"))
    rooms = rooms.select(F.col("code").alias("c"), "r.room", "r.faculty", "r.file")
    if urls is not None:
        pages = urls.groupBy("file").agg(F.min("source_url").alias("source_url"))
        rooms = rooms.join(pages, "file", "left").select("c", "room", "faculty", "file", "source_url")
    else:
        rooms = rooms.withColumn("source_url", F.col("file"))
    known = written(R.dictionary(courses.select("title").distinct()).select("name").distinct(), "known")
    slashes = R.slash_title_rows(lines.where(F.col("faculty") == SLASH_FACULTY))
    new_slashes = R.missing_rows(slashes, known, clean=F.col("title"))
    one = lambda df, faculty, hit, drop: df.agg(
        F.count("*").alias("detected"), F.count_distinct(F.when(hit, F.col("code"))).alias("resolved"),
        F.count_if(drop).alias("dropped_ambiguous")).withColumn("faculty", F.lit(faculty))
    no = F.lit(False)
    every = sessions.select("row_id").join(by_grid.select("row_id", "code", "outcome"), "row_id", "left")
    stats = _union([
        R.match_stats(matched),
        one(by_code, CODE_FACULTY, F.col("verdict") == "ok", F.col("verdict") == "disagree"),
        one(every, GRID_FACULTY, F.col("outcome") == "one", F.coalesce(F.col("outcome") == "several", no)),
        one(new_slashes.withColumn("code", F.lit("")), SLASH_FACULTY, no, no)])
    faculties = fixed_frame(lines.sparkSession, [(f,) for f in (*MARKER_FACULTIES, CODE_FACULTY, GRID_FACULTY, SLASH_FACULTY, ROOMLESS_FACULTY)], "faculty string")
    stats = faculties.join(stats, "faculty", "left").na.fill(0)
    reported = [f for f, (_, r) in MARKER_FACULTIES.items() if r]
    lost = matched.where(F.col("code").isNull() & ~F.col("ambiguous") & F.col("faculty").isin(reported))
    seen = _union([R.missing_rows(lost, known), new_slashes]).withColumn("file_ord", F.struct(_rank(F.col("faculty")).alias("rank"), "file_ord"))
    titles = R.sightings(seen, "name")
    codes = R.unknown_code_rows(found, courses, code_scope).select(
        F.lit("").alias("title"), "code", F.lit("").alias("room"), F.lit(CODE_FACULTY).alias("faculty"), "file", "season")
    missing = written(_union([titles.drop("name"), codes]), "missing")
    return {"rooms": rooms, "stats": stats, "missing": missing.orderBy("faculty", "title", "code"), "matched": matched,
            "missing_by_faculty": missing.groupBy("faculty").agg(F.count("*").alias("n"))}
