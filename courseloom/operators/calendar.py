"""Class days from terms, closed days, swapped days and per-faculty differences.

Calendar frames have a fixed, small size (one row per term, closure or swap), so their
joins are broadcast by the planner; only the join to courses touches large data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.session import fixed_frame, written

BASE = ""          # faculty key of the common calendar
WEEKDAY = ["月", "火", "水", "木", "金", "土", "日"]


def calendar_frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The fixed calendar as terms / closed / swap / extra frames."""
    day = lambda df, *cols: df.select(*[F.col(c).cast("date").alias(c) if c in cols else F.col(c) for c in df.columns])
    return {
        "terms": day(fixed_frame(spark, V.CALENDAR_TERMS, "year int, faculty string, term string, start string, end string"), "start", "end"),
        "closed": day(fixed_frame(spark, V.CALENDAR_CLOSED, "year int, faculty string, first string, last string, op string"), "first", "last"),
        "swap": day(fixed_frame(spark, V.CALENDAR_SWAP, "year int, faculty string, date string, weekday string, op string"), "date"),
        "extra": day(fixed_frame(spark, V.CALENDAR_EXTRA, "year int, faculty string, term string, date string"), "date"),
    }


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("faculty", F.coalesce("faculty", F.lit(BASE)))


def calendars(frames: dict[str, DataFrame]) -> DataFrame:
    """(year, faculty) of every calendar: the common one and each with a difference."""
    rows = [_keyed(f).select("year", "faculty") for f in frames.values()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.distinct()


def _own_and_base(keyed: DataFrame, cals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the common calendar given to every calendar, and each faculty's own rows."""
    base = keyed.where(F.col("faculty") == BASE).drop("faculty").join(cals, "year")
    return base, keyed.where(F.col("faculty") != BASE)


def effective_terms(frames: dict[str, DataFrame]) -> DataFrame:
    """Base terms with a faculty's own span where it has one, plus its own terms."""
    key = ["year", "faculty", "term"]
    base, own = _own_and_base(_keyed(frames["terms"]), calendars(frames))
    own = own.select(*key, F.col("start").alias("s"), F.col("end").alias("e"))
    return base.join(own, key, "full").select(*key, F.coalesce("s", "start").alias("start"), F.coalesce("e", "end").alias("end"))


def effective_closed(frames: dict[str, DataFrame]) -> DataFrame:
    key = ["year", "faculty", "date"]
    days = _keyed(frames["closed"]).select("year", "faculty", "op", F.explode(F.sequence("first", "last")).alias("date"))
    base, own = _own_and_base(days, calendars(frames))
    added = base.where("op = 'add'").select(*key).union(own.where("op = 'add'").select(*key))
    return added.distinct().join(own.where("op = 'remove'").select(*key), key, "left_anti")


def effective_swap(frames: dict[str, DataFrame]) -> DataFrame:
    key = ["year", "faculty", "date"]
    base, own = _own_and_base(_keyed(frames["swap"]), calendars(frames))
    base = base.where("op = 'add'").join(own.select(*key), key, "left_anti")
    return base.select(*key, "weekday").union(own.where("op = 'add'").select(*key, "weekday")).distinct()


def weekday_name(day: Column) -> Column:
    return F.get(F.array(*map(F.lit, WEEKDAY)), F.weekday(day))


def class_days(frames: dict[str, DataFrame]) -> DataFrame:
    """(year, faculty, term, date, weekday): a swap wins over a closed day; no Sundays."""
    key = ["year", "faculty", "date"]
    spans = effective_terms(frames).select("year", "faculty", "term", F.explode(F.sequence("start", "end")).alias("date"))
    extra = _keyed(frames["extra"]).select("year", "faculty", "term", "date")
    days = spans.union(extra).distinct()
    closed = effective_closed(frames).withColumn("_closed", F.lit(True))
    swap = effective_swap(frames).withColumnRenamed("weekday", "_swap")
    days = days.join(swap, key, "left").join(closed, key, "left")
    usual = F.when(F.col("_closed").isNull() & (F.weekday("date") < 6), weekday_name(F.col("date")))
    return (days.withColumn("weekday", F.coalesce("_swap", usual)).where("weekday IS NOT NULL")
            .select("year", "faculty", "term", "date", "weekday"))


def class_day_counts(days: DataFrame) -> DataFrame:
    return days.groupBy("year", "faculty", "term", "weekday").agg(F.count("*").alias("n_days"))


def weekly_series(days: DataFrame) -> DataFrame:
    """One row per calendar, term and weekday: first, until, missing weeks, swapped days.

    The arrays hold at most the days of one term.
    """
    regular = F.when(F.col("weekday") == weekday_name(F.col("date")), F.col("date"))
    swapped = F.when(F.col("weekday") != weekday_name(F.col("date")), F.col("date"))
    s = days.groupBy("year", "faculty", "term", "weekday").agg(
        F.min(regular).alias("first"), F.max(regular).alias("until"),
        F.array_sort(F.collect_set(regular)).alias("_days"), F.array_sort(F.collect_set(swapped)).alias("singles"))
    weeks = F.when(F.col("first").isNotNull(), F.sequence("first", "until", F.expr("interval 7 days")))
    return s.withColumn("excluded", F.coalesce(F.array_except(weeks, "_days"), F.array().cast("array<date>"))).drop("_days")


def event_series(slots: DataFrame, days: DataFrame, periods: DataFrame) -> DataFrame:
    """Weekly event of each placed slot: dates from its faculty's calendar, times by period.

    ``slots``: code, year, faculty, term (a calendar term), weekday, period.
    """
    days = written(days, "days")          # small for sure: its written size lets the joins broadcast it
    series = weekly_series(days)
    own = days.select("year", F.col("faculty").alias("_f")).distinct()
    s = slots.join(own, (slots["year"] == own["year"]) & (slots["faculty"] == own["_f"]), "left").drop(own["year"])
    s = s.withColumn("_cal", F.coalesce("_f", F.lit(BASE))).drop("_f")
    series = series.withColumnRenamed("faculty", "_cal")
    return s.join(series, ["year", "_cal", "term", "weekday"]).join(periods, "period").drop("_cal")


def period_frame(spark: SparkSession) -> DataFrame:
    return fixed_frame(spark, [(p, a, b) for p, (a, b) in V.PERIOD_TIMES.items()],
                       "period string, starts string, ends string")


def site_calendar(frames: dict[str, DataFrame], year: int, same: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """Calendar payload of a year, as tables.

    ``days``: the class days of every calendar (the common one is the faculty ""). ``checked``: the
    faculties whose own schedule was read, those that follow the common calendar (``differs`` is
    false) and those with differences and their note. Without a calendar for the year both are empty.
    """
    days = class_days(frames).where(F.col("year") == year)
    rows = days.groupBy("year", "faculty", "term", "weekday").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    own = calendars(frames).where(F.col("faculty") != BASE).join(notes, ["year", "faculty"], "full")
    said = own.select("year", "faculty", F.lit(True).alias("differs"), F.coalesce("note", F.lit("")).alias("note"))
    plain = same.select("year", "faculty", F.lit(False).alias("differs"), F.lit("").alias("note")).join(said, ["year", "faculty"], "left_anti")
    there = days.select("year").distinct()
    return {"days": rows, "checked": said.union(plain).where(F.col("year") == year).join(there, "year", "left_semi").distinct()}
