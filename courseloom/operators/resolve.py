"""From timetable lines to courses: rooms, ambiguous hits, unmatched titles.

"Exactly one candidate" is decided from the least and the greatest candidate code of a key
(equal: one; different: several), which are partial aggregates. No step lists the
candidates of a key or pairs every mention with every course of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions import names as N
from courseloom.functions.text import exploded, groups_of, has, matches_with_texts, nfkc, strip
from courseloom.operators.containment import contains_known, nearest_name, occurrences
from courseloom.operators.ordered import first_by, previous_value
from courseloom.session import written

ANY = "*"
VIEW = ["faculty", "season_key"]


def season_keys(season: Column) -> Column:
    """Page seasons a course fits: its own and the unknown one; all when it has none."""
    every = F.array(F.lit(ANY), F.lit("spring"), F.lit("autumn"))
    return F.when(season.isNull(), every).otherwise(F.array(F.lit(ANY), season))


def fits(course_season: Column, page_season: Column) -> Column:
    return course_season.isNull() | page_season.isNull() | (course_season == page_season)


def dictionary(courses: DataFrame) -> DataFrame:
    """(code, title, faculty, instructors, season, slots, name): one row per course."""
    return courses.withColumn("name", N.match_key("title"))


def by_view(courses: DataFrame) -> DataFrame:
    """The dictionary once per page season that the course fits."""
    return courses.withColumn("season_key", F.explode(season_keys(F.col("season"))))


def _span(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("code").alias(f"{prefix}_lo"), F.max("code").alias(f"{prefix}_hi"))


def page_seasons(lines: DataFrame, defaults: dict[str, str] = V.FILE_SEASON) -> DataFrame:
    """Add to each line the season its page's first two lines name, else the file's default.

    Only the head lines are aggregated, so a long file costs one row per page.
    """
    head = (lines.where("page_line <= 2").groupBy("file", "page")
            .agg(F.min(F.when(F.col("page_line") == 1, F.col("line"))).alias("_a"),
                 F.min(F.when(F.col("page_line") == 2, F.col("line"))).alias("_b")))
    head = head.select("file", "page", N.page_season(F.concat_ws(" ", "_a", "_b")).alias("_season"))
    fixed = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else F.create_map()
    default = fixed[F.col("file")] if defaults else F.lit(None).cast("string")
    return lines.join(head, ["file", "page"], "left").withColumn("season", F.coalesce("_season", default)).drop("_season")


def mentions(lines: DataFrame, pattern: str) -> DataFrame:
    """One row per room marker: the text since the previous marker and the previous line.

    ``lines``: faculty, file, file_ord (the order in which files are read), line_no (unique in
    the file), season, line. Rejected markers still end a segment.
    """
    full = lines.where(F.trim("line") != "")
    full = previous_value(full, ["faculty", "file"], "line_no", F.col("line"), "prev")
    zipped = matches_with_texts("line", "(?U)" + pattern, "room", "seg")
    rows = exploded(full, ["faculty", "file", "file_ord", "line_no", "season", "prev"], zipped, "m", "pos")
    rows = rows.select("faculty", "file", "file_ord", "line_no", "pos", "season", F.coalesce("season", F.lit(ANY)).alias("season_key"),
                       "m.seg", F.coalesce("prev", F.lit("")).alias("prev"), N.clean_room(F.col("m.room")).alias("room"))
    return rows.where(N.is_room("room"))


def _named(rows: DataFrame, text: str, spans: DataFrame, gram: int, tail_only: bool) -> DataFrame:
    """Best dictionary name inside each distinct (faculty, season, text): VIEW, text, name and its least and greatest code."""
    wanted = rows.select(*VIEW, F.col(text).alias("text")).where(F.length("text") >= gram).distinct()
    found = occurrences(wanted, [*VIEW, "text"], "text", spans, "name", (gram,))
    near = nearest_name(found.join(spans, [*VIEW, "name"]), [*VIEW, "text"], tail_only, also=SPAN)
    return near.select(*VIEW, "text", "name", *SPAN)


def _answered(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Add the answer of the least rank (rank, name, its least and greatest code), NULL where none of a mention's texts has one.

    ``asked``: MENTION and the answer. They are dealt by mention before they are gathered, so they are
    sorted once, and that order serves the join as well.
    """
    best = asked.repartition(*MENTION).groupBy(*MENTION).agg(F.min(F.struct("rank", "name", *SPAN)).alias("_b"))
    return rows.join(best, MENTION, "left").select("*", "_b.*").drop("_b")


def match_mentions(rows: DataFrame, courses: DataFrame, gram: int = V.MIN_NAME, tail_only: bool = False) -> DataFrame:
    """Add code (matched), ambiguous (several courses of that name), title (as read).

    The first that answers wins: a name inside the segment; a name at the end of the previous
    line; the title read from the segment, also without its first words; the teacher at the
    segment's end. Only mentions whose segment has no name go on to the others, and only theirs
    are read; the texts of those are one join: each mention asks with up to four, ranked, texts that
    are empty don't ask, and the least rank that is answered counts.
    """
    view = written(by_view(dictionary(courses)).select(*VIEW, "name", "code", "instructors"), "names")
    spans = written(_span(view, [*VIEW, "name"], "c"), "spans")
    rows = written(rows.withColumn("seg_key", N.match_key("seg")), "mentions")              # read several times below, as the others
    own = rows.select(*MENTION, *VIEW, F.lit(0).alias("rank"), F.col("seg_key").alias("text")).where("text <> ''")
    rows = written(_answered(rows.drop("seg_key"), own.join(_named(rows, "seg_key", spans, gram, tail_only), [*VIEW, "text"])), "by-segment")
    named = rows.where(F.col("name").isNotNull()).withColumn("title", F.lit("")).withColumn("by_teacher", F.lit(None).cast("string"))
    rest = rows.where(F.col("name").isNull()).drop("rank", "name", *SPAN)
    rest = rest.withColumn("prev_key", N.match_key("prev")).withColumn("title", N.guess_title("seg"))
    guesses = N.title_candidates(F.col("title"))
    for i, cand in enumerate(guesses):
        rest = rest.withColumn(f"_w{i}", cand)
    rest = written(rest.select("*", *[N.match_key(f"_w{i}").alias(f"_k{i}") for i in range(len(guesses))]), "unnamed")
    asks = [("prev", "prev_key"), *[("exact", f"_k{i}") for i in range(len(guesses))]]
    asked = rest.select(*MENTION, *VIEW, F.inline(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(kind).alias("kind"), F.col(c).alias("text"))
                                                          for i, (kind, c) in enumerate(asks, 1)]))).where("text <> ''")
    answers = _named(rest, "prev_key", spans, gram, True).withColumn("kind", F.lit("prev")).unionByName(
        spans.select(*VIEW, F.col("name").alias("text"), "name", *SPAN, F.lit("exact").alias("kind")))
    rest = _answered(rest, asked.join(answers, [*VIEW, "kind", "text"]))
    shown = F.when(F.col("rank").isNull(), F.col("title")).when(F.col("rank") == 1, "")
    for i in range(len(guesses)):
        shown = shown.when(F.col("rank") == i + 2, F.col(f"_w{i}"))
    rest = by_instructor(rest.withColumn("title", shown), view)
    rows = named.unionByName(rest.select(*named.columns))
    code = F.when(F.col("c_lo") == F.col("c_hi"), F.col("c_lo")).when(F.col("name").isNull(), F.col("by_teacher"))
    ambiguous = F.coalesce(F.col("c_lo") != F.col("c_hi"), F.lit(False))
    return rows.select("faculty", "file", "file_ord", "line_no", "pos", "season", "room", "seg", "title",
                       code.alias("code"), ambiguous.alias("ambiguous"))


MENTION = ["faculty", "file", "line_no", "pos"]
SPAN = ["c_lo", "c_hi"]


def _own_if_null(key: str) -> Column:
    """A key that no dictionary has, one for each mention, in place of NULL: rows without a key are
    then spread over all tasks of a left join instead of meeting in one."""
    return F.coalesce(F.col(key), F.concat(F.lit("\uffff"), F.col("file"), F.col("line_no").cast("string")))


def teacher_keys(instructor: Column) -> Column:
    """Keys under which a teacher is found: prefixes of 2-6 letters, a one-letter surname."""
    first = F.element_at(F.split(strip(instructor), r"(?U)\s+"), 1)
    prefixes = F.transform(F.sequence(F.lit(2), F.lit(6)), lambda n: F.substring(instructor, F.lit(1), n))
    whole = F.filter(prefixes, lambda p: F.length(p) >= 2)
    one = F.when(F.length(first) == 1, F.array(first)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(whole, one))


def by_instructor(rows: DataFrame, view: DataFrame) -> DataFrame:
    """Add by_teacher: the only seminar, else the only like-named course, of the teacher.

    ``view`` rows have the season key, name and instructors.
    """
    seminar = N.match_key(F.lit(V.SEMINAR_TITLE))
    taught = view.where(F.size("instructors") > 0).select(
        *VIEW, "code", "name", F.explode("instructors").alias("_who")).where(strip("_who") != "")
    taught = taught.select(*VIEW, "code", "name", F.explode(teacher_keys(F.col("_who"))).alias("fam"))
    seminars = _span(taught.where(F.col("name") == seminar), [*VIEW, "fam"], "s")
    alike = _span(taught.withColumn("head", F.substring("name", 1, 4)), [*VIEW, "fam", "head"], "h")
    rows = (rows.withColumn("_t", N.match_key("title"))
            .withColumn("fam", F.when(F.length("_t") >= 4, N.surname("seg"))).withColumn("head", F.substring("_t", 1, 4)))
    rows = rows.withColumn("fam", _own_if_null("fam"))
    rows = rows.join(seminars, [*VIEW, "fam"], "left").join(alike, [*VIEW, "fam", "head"], "left")
    is_seminar = F.col("_t").endswith(V.SEMINAR_ENDING) & F.col("s_lo").isNotNull()
    hit = (F.when(is_seminar, F.when(F.col("s_lo") == F.col("s_hi"), F.col("s_lo")))
           .otherwise(F.when(F.col("h_lo") == F.col("h_hi"), F.col("h_lo"))))
    return rows.withColumn("by_teacher", hit).drop("_t", "fam", "head", "s_lo", "s_hi", "h_lo", "h_hi")


READING = ["file_ord", "line_no", "pos"]


def rooms_found(matched: DataFrame) -> DataFrame:
    """First room of each matched course in reading order, files in the order they are read."""
    return first_by(matched.where("code IS NOT NULL"), ["code"], READING, ["room", "file"])


def match_stats(matched: DataFrame) -> DataFrame:
    """Per faculty: mentions detected, courses resolved, mentions dropped as ambiguous."""
    each = matched.groupBy("faculty", "code").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("dropped"))
    return each.groupBy("faculty").agg(F.sum("n").alias("detected"), F.count("code").alias("resolved"), F.sum("dropped").alias("dropped_ambiguous"))


def missing_rows(unmatched: DataFrame, known: DataFrame, name: str = "name", clean: Column | None = None) -> DataFrame:
    """Sightings of titles that no course has, cleaned and judged, with their comparison form."""
    rows = unmatched.withColumn("title", N.missing_title("title") if clean is None else clean)
    rows = rows.where(~N.is_missing_junk("title")) if clean is None else rows
    return unknown_rows(rows, known, name)


def missing_titles(unmatched: DataFrame, known: DataFrame, name: str = "name", clean: Column | None = None) -> DataFrame:
    """Titles that no course has: cleaned, judged, once per name; the first sighting stays.

    The season is blank when sightings disagree. ``unmatched``: title, room, faculty, season,
    file, file_ord, line_no, pos.
    """
    return sightings(missing_rows(unmatched, known, name, clean), "name")


def unknown_rows(rows: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose title no course has, with the title's comparison form as ``name``."""
    rows = rows.withColumn("name", N.match_key("title"))
    seen = contains_known(rows, "name", known, name).withColumnRenamed("title", "name")
    return rows.join(seen, "name", "left_anti")


def sightings(rows: DataFrame, key: str) -> DataFrame:
    """First sighting of each key; season kept only where all sightings agree."""
    s = F.coalesce("season", F.lit(""))
    first = F.min(F.struct(*READING, "title", "room", "faculty", "file"))
    agg = rows.groupBy(key).agg(first.alias("f"), F.min(s).alias("_lo"), F.max(s).alias("_hi"))
    return agg.select(key, "f.title", "f.room", "f.faculty", "f.file",
                      F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise("").alias("season"))


def slash_title_rows(lines: DataFrame) -> DataFrame:
    """Title candidates written before a slash, one row each, in reading order."""
    return exploded(lines, ["faculty", "file", "file_ord", "line_no", "season", F.lit("").alias("room")], N.slash_titles("line"), "title", "pos")


def code_mentions(lines: DataFrame) -> DataFrame:
    """Course codes in lines, each with the text up to the next code."""
    zipped = matches_with_texts("line", V.CODE_IN_LINE, "code", "tail", after=True)
    return exploded(lines, ["file", "file_ord", "line_no", "season"], zipped, "m", "pos").select(
        "file", "file_ord", "line_no", "season", "pos", "m.code", "m.tail")


def code_rooms(found: DataFrame, courses: DataFrame) -> DataFrame:
    """Rooms next to known codes, with verdict 'ok' or 'disagree' on the title check."""
    # a test of what is exploded isn't pushed below it, where the pattern would be matched again
    rows = exploded(found, ["file", "file_ord", "line_no", "season", "pos", "code"], F.array(groups_of("tail", V.CODE_ROOM, 2)), "_m")
    rows = rows.withColumn("head", F.get("_m", 0)).withColumn("room", F.get("_m", 1)).drop("_m").where("room <> ''")
    rows = rows.join(courses.select("code", "title"), "code").withColumn("head", nfkc("head")).withColumn("want", N.match_key("title"))
    same = (F.col("want") == "") | F.contains(N.match_key("head"), F.substring("want", 1, 5))
    ok = same | has(strip("head"), V.PERSON_NAME)
    return rows.select("file", "file_ord", "line_no", "pos", "code", N.clean_room("room").alias("room"),
                       F.when(ok, "ok").otherwise("disagree").alias("verdict"))


def unknown_code_rows(found: DataFrame, courses: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Codes in lines that no course has, at their first sighting.

    ``scope``: columns of both tables within which a code stands for one course, where the same
    code means another one elsewhere; a code is then unknown, and first sighted, in its scope.
    """
    new = found.join(courses.select(*scope, "code"), [*scope, "code"], "left_anti")
    s = F.coalesce("season", F.lit(""))
    agg = new.groupBy(*scope, "code").agg(F.min(F.struct(*READING, "file", s.alias("season"))).alias("f"))
    return agg.select(*scope, "code", "f.file", "f.season")


def progressive(rows: DataFrame, courses: DataFrame) -> DataFrame:
    """Resolve rows by name and season, then slot, then teacher; each filter falls back.

    ``rows``: row_id, name, season, slots array<struct<weekday,period>>, surnames array.
    ``courses``: code, name, season, slots, instructors. Adds code and outcome ('one',
    'several', 'none'). A filter that leaves nothing is not applied, per row.
    """
    view = courses.withColumn("season_key", F.explode(season_keys(F.col("season"))))
    view = view.withColumn("_text", F.array_join("instructors", ""))
    left = rows.withColumn("season_key", F.coalesce("season", F.lit(ANY)))
    left = left.withColumn("surnames", F.filter(F.col("surnames"), lambda x: x != ""))
    key = ["name", "season_key"]
    slot = view.withColumn("slot", F.explode(F.array_distinct("slots")))
    wanted_slot = left.select("row_id", *key, "surnames", F.explode(F.array_distinct("slots")).alias("slot"))

    # substrings of the teachers' text, only of the lengths asked for under the same name
    sizes = left.select(*key, F.explode("surnames").alias("s")).select(*key, F.length("s").alias("size")).distinct()

    def named_teachers(df: DataFrame, extra: list[str]) -> DataFrame:
        spread = df.select("code", *key, *extra, "_text").join(sizes, key).where(F.length("_text") >= F.col("size"))
        starts = F.sequence(F.lit(1), F.length("_text") - F.col("size") + 1)
        grams = F.array_distinct(F.transform(starts, lambda p: F.substring(F.col("_text"), p, F.col("size"))))
        return exploded(spread, ["code", *key, *extra], grams, "surname")

    a = _span(view, key, "a")
    b = _span(wanted_slot.join(_span(slot, [*key, "slot"], "x"), [*key, "slot"])
              .select("row_id", F.explode(F.array("x_lo", "x_hi")).alias("code")), ["row_id"], "b")
    c = _span(left.select("row_id", *key, F.explode("surnames").alias("surname"))
              .join(_span(named_teachers(view, []), [*key, "surname"], "x"), [*key, "surname"])
              .select("row_id", F.explode(F.array("x_lo", "x_hi")).alias("code")), ["row_id"], "c")
    d = _span(wanted_slot.withColumn("surname", F.explode("surnames"))
              .join(_span(named_teachers(slot, ["slot"]), [*key, "slot", "surname"], "x"), [*key, "slot", "surname"])
              .select("row_id", F.explode(F.array("x_lo", "x_hi")).alias("code")), ["row_id"], "d")
    out = left.join(a, key, "left").join(b, "row_id", "left").join(c, "row_id", "left").join(d, "row_id", "left")
    # the slot filter is tried only when the name alone is not enough, and so on
    several = lambda p: F.col(f"{p}_lo") != F.col(f"{p}_hi")
    by_slot = several("a") & F.col("b_lo").isNotNull()
    lo, hi = F.when(by_slot, F.col("b_lo")).otherwise(F.col("a_lo")), F.when(by_slot, F.col("b_hi")).otherwise(F.col("a_hi"))
    t_lo = F.when(by_slot, F.col("d_lo")).otherwise(F.col("c_lo"))
    t_hi = F.when(by_slot, F.col("d_hi")).otherwise(F.col("c_hi"))
    by_teacher = (lo != hi) & t_lo.isNotNull()
    out = out.withColumn("_lo", F.when(by_teacher, t_lo).otherwise(lo)).withColumn("_hi", F.when(by_teacher, t_hi).otherwise(hi))
    outcome = F.when(F.col("_lo").isNull(), "none").when(F.col("_lo") == F.col("_hi"), "one").otherwise("several")
    return out.select(*rows.columns, F.when(outcome == "one", F.col("_lo")).alias("code"), outcome.alias("outcome"))


def grid_surname(instructor: Column) -> Column:
    return F.regexp_replace(instructor, r"[\s　].*$", "")
