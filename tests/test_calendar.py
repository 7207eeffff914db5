"""Invariants of the fixed calendar, and made-up calendars against a day-by-day loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.operators import calendar as C

NAMES = "月火水木金土日"
ONE = dt.timedelta(days=1)


def between(first, last):
    while first <= last:
        yield first
        first += ONE


def by_loop(frames):
    """(year, faculty, term, date, weekday) of plain rows of the four frames, one day after the other."""
    out = set()
    calendars = {(r[0], r[1] or "") for rows in frames.values() for r in rows}
    for year, faculty in calendars:
        mine = [r for rows in [frames["closed"]] for r in rows if r[0] == year]
        closed = {d for _, f, a, b, op in mine if op == "add" and (f or "") in ("", faculty) for d in between(a, b)}
        closed -= {d for _, f, a, b, op in mine if op == "remove" and f and f == faculty for d in between(a, b)}
        swap = {}
        for wanted in (None, faculty):
            for _, f, d, w, op in (r for r in frames["swap"] if r[0] == year):
                if (f or "") == (wanted or "") and (wanted is None or faculty):
                    swap.pop(d, None) if op == "remove" else swap.__setitem__(d, w)
        spans = {t: (a, b) for y, f, t, a, b in frames["terms"] if y == year and not f}
        spans.update({t: (a, b) for y, f, t, a, b in frames["terms"] if y == year and f and f == faculty})
        for term in {*spans, *(t for y, f, t, _ in frames["extra"] if y == year and (f or "") == faculty)}:
            days = set(between(*spans[term])) if term in spans else set()
            days |= {d for y, f, t, d in frames["extra"] if (y, f or "", t) == (year, faculty, term)}
            for d in days:
                name = swap.get(d) or (NAMES[d.weekday()] if d not in closed and d.weekday() < 6 else None)
                if name:
                    out.add((year, faculty, term, d, name))
    return out


SCHEMAS = {"terms": "year int, faculty string, term string, start date, end date",
           "closed": "year int, faculty string, first date, last date, op string",
           "swap": "year int, faculty string, date date, weekday string, op string",
           "extra": "year int, faculty string, term string, date date"}


@pytest.mark.parametrize("seed", range(6))
def test_made_up_calendars(spark, seed):
    rng = random.Random(seed)
    start = dt.date(2030, 1, 1)
    day = lambda: start + dt.timedelta(days=rng.randrange(120))
    frames = {"terms": [(2030, None, t, a, a + dt.timedelta(days=rng.randrange(60))) for t in "PQ" for a in [day()]],
              "closed": [], "swap": [], "extra": []}
    frames["terms"] += [(2030, f, rng.choice("PQR"), a, a + dt.timedelta(days=30)) for f in rng.sample("FGH", rng.randint(0, 2)) for a in [day()]]
    for _ in range(rng.randint(0, 12)):
        a = day()
        f = rng.choice([None, None, "F", "G"])
        frames["closed"].append((2030, f, a, a + dt.timedelta(days=rng.randrange(4)), "add" if f is None else rng.choice(["add", "remove"])))
    for d in {day() for _ in range(8)}:
        frames["swap"].append((2030, None, d, rng.choice(NAMES), "add"))
        if rng.random() < 0.5:
            frames["swap"].append((2030, "F", d, rng.choice(NAMES), rng.choice(["add", "remove"])))
    frames["extra"] = [(2030, "F", "P", day())] if rng.random() < 0.5 else []
    got = C.class_days({k: spark.createDataFrame(rows, SCHEMAS[k]) for k, rows in frames.items()})
    assert {tuple(r) for r in got.select("year", "faculty", "term", "date", "weekday").collect()} == by_loop(frames)
    assert got.count() == got.distinct().count()


@pytest.fixture(scope="module")
def fixed(spark):
    frames = C.calendar_frames(spark)
    return {k: [tuple(r) for r in f.collect()] for k, f in frames.items()}, C.class_days(frames).collect()


def test_the_fixed_calendar_is_the_loop(fixed):
    rows, days = fixed
    assert {(r.year, r.faculty, r.term, r.date, r.weekday) for r in days} == by_loop(rows)


def test_weeks_of_the_common_calendar(fixed):
    """15 days of every weekday in a half-year, 8 in a quarter, none on a closed day."""
    rows, days = fixed
    quarters = {t for _, f, t, *_ in rows["terms"] if t.endswith("学期")}
    halves = {t for _, f, t, *_ in rows["terms"]} - quarters
    for term in quarters | halves:
        for name in NAMES[:5]:
            n = sum(r.faculty == "" and r.term == term and r.weekday == name for r in days)
            assert n == (8 if term in quarters else 15)
    swapped = {d: w for _, f, d, w, _ in rows["swap"] if f is None}
    closed = {d for _, f, a, b, _ in rows["closed"] if f is None for d in between(a, b)}
    for r in days:
        if r.faculty == "":
            assert r.date in swapped or r.date not in closed
            assert r.weekday == swapped.get(r.date, NAMES[r.date.weekday()])


def test_event_series(spark):
    """An event's dates are every seventh day from first to until, less the excluded, plus the single ones."""
    frames = C.calendar_frames(spark)
    days = C.class_days(frames)
    known = {(r.faculty, r.term, r.weekday): set() for r in days.collect()}
    for r in days.collect():
        known[r.faculty, r.term, r.weekday].add(r.date)
    faculties = ["理学部", "法学部", "農学部", "どこにもない学部"]
    slots = [(f"{f}{t}{w}", 2026, f, t, w, p) for f in faculties for t in ("前期", "冬学期") for w in NAMES[:5] for p in "16"]
    frame = spark.createDataFrame(slots, "code string, year int, faculty string, term string, weekday string, period string")
    got = C.event_series(frame, days, C.period_frame(spark)).collect()
    assert len(got) == len(slots)
    for e in got:
        mine = known.get((e.faculty, e.term, e.weekday)) or known["", e.term, e.weekday]
        weekly = {d for d in between(e.first, e.until) if (d - e.first).days % 7 == 0}
        assert weekly - set(e.excluded) | set(e.singles) == mine and set(e.excluded) <= weekly
        assert (e.starts, e.ends) == V.PERIOD_TIMES[e.period]


def test_site_calendar(spark, fixed):
    rows, _ = fixed
    frames = C.calendar_frames(spark)
    same = spark.createDataFrame(V.CALENDAR_SAME, "year int, faculty string")
    notes = spark.createDataFrame(V.CALENDAR_NOTES, "year int, faculty string, note string")
    site = C.site_calendar(frames, 2026, same, notes)
    checked = {r.faculty: (r.differs, r.note) for r in site["checked"].collect()}
    own = {r[1] for part in rows.values() for r in part if r[1]}
    assert {f for f, (differs, _) in checked.items() if differs} == own
    assert {f for f, (differs, _) in checked.items() if not differs} == {f for _, f in V.CALENDAR_SAME}
    assert {f: n for f, (d, n) in checked.items() if d} == {f: n for _, f, n in V.CALENDAR_NOTES}
    assert {r.faculty for r in site["days"].select("faculty").distinct().collect()} == own | {""}
    other = C.site_calendar(frames, 1999, same.withColumn("year", F.lit(1999)), notes)
    assert other["days"].isEmpty() and other["checked"].isEmpty()
