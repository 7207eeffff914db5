"""Listing checks, ordered scans on cut-up keys, streaming state against the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from courseloom.functions import html as H
from courseloom.operators import ordered as O
from courseloom.operators import snapshots as S
from courseloom.sources import pages as PG
from courseloom.streaming import snapshots as ST


HEADING = "<div id='top'><h2>講義一覧</h2>"


def listing(codes, first=1, total=None, shown=None):
    """A listing page as landed: heading, announced range, a row a code, alternating row classes."""
    last = first + (len(codes) if shown is None else shown) - 1
    rows = [f"<tr class=\"column_{'even' if k % 2 else 'odd'}\" id=r{k}><td>{first + k}</td><td> {code} </td><td><a href='#'>地形学 {code}</a></td>"
            f"<td>冬学期<br>火曜日 3</td><td>川 一郎</td><td>-</td></tr>" for k, code in enumerate(codes)]
    return f"{HEADING}<p>{first}-{last} 件表示 / <b>{total or last}</b> 件中</p><table>{''.join(rows)}</table></div>"


def problems(spark, *pages):
    df = spark.createDataFrame([("24", no, html) for no, html in enumerate(pages, 1)], "kaiko_cd string, page_no int, html string")
    seen = df.select("kaiko_cd", "page_no", H.is_error_page("html").alias("is_error"), H.hit_range("html").alias("range"))
    rows = PG.listing_rows(df, ["kaiko_cd", "page_no"])
    found = S.page_violations(seen.select("kaiko_cd", "page_no", "is_error", "range.*"), rows).collect()
    return {(r.page_no, r.problem) for r in found}, rows


def test_a_sound_sequence(spark):
    found, rows = problems(spark, listing(["k1", "k2", "k3"], total=5), listing(["k4", "k5"], 4, 5))
    assert not found
    assert [(r.course_code, r.title, r.instructors) for r in rows.orderBy("page_no", "row_no").collect()] == [
        (f"k{i}", f"地形学 k{i}", "川 一郎") for i in range(1, 6)]
    assert problems(spark, HEADING + "検索結果は見つかりません")[0] == set()


@pytest.mark.parametrize("pages, problem", [
    ([listing(["k1", "k2"], total=4), listing(["k4"], 4, 4)], (2, "gap before page")),
    ([listing(["k1", "k2"], total=4), listing(["k2", "k4"], 3, 4)], (2, "repeated code")),
    ([listing(["k1", "k2"], total=3, shown=3)], (1, "row count")),
    ([listing(["k1", "k2"], total=9)], (1, "ends early")),
    ([HEADING + "しばらくお待ちください"], (1, "unreadable count")),
    (["<html>short</html>"], (1, "error page")),
])
def test_faulty_sequences(spark, pages, problem):
    assert problem in problems(spark, *pages)[0]


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_chunked_scans(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(rnd.choice("xxxxy"), p, rnd.choice([None, None, "v%d" % p])) for p in range(60)]
    df = spark.createDataFrame(rows, "k string, p long, v string")
    df = O.running_count(df, ["k"], "p", F.col("v").isNotNull(), "n", chunk)
    df = O.fill_down(df, ["k"], "p", F.col("v"), "down", chunk=chunk)
    df = O.previous_value(df, ["k"], "p", F.col("v"), "prev", chunk)
    got = {(r.k, r.p): (r.n, r.down, r.prev) for r in df.collect()}
    want, last, n = {}, {}, {}
    for k, p, v in rows:
        prev = last.get(k)
        if v is not None:
            last[k], n[k] = v, n.get(k, 0) + 1
        want[k, p] = (n.get(k, 0), last.get(k), prev)
    assert got == want


def versions():
    t = lambda d, h=0: dt.datetime(2026, 4, d, h)
    return [[("a", "s1", "u1", t(1)), ("b", "s1", "u1", t(1))], [("a", "s2", "u1", t(2)), ("b", "s1", "u1", t(2)), ("c", "s9", None, t(2))],
            [("a", "s2", "u1", t(3)), ("a", "s3", "u2", t(3, 5)), ("a", "s1", "u2", t(3, 6)), ("c", "s8", None, t(3))]]


def frame(spark, rows):
    return spark.createDataFrame([("u", 2026, *r) for r in rows], ST.SNAPSHOT)


def run_all(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_and_batch_agree(spark, tmp_path):
    land, log = (str(tmp_path / x) for x in ("land", "log"))
    for rows in versions():
        frame(spark, rows).coalesce(1).write.mode("append").parquet(land)
    run_all(ST.track_changes(ST.read_snapshots(spark, land, files=1), log, str(tmp_path / "ckpt")))
    cols = ["course_code", "old_sha256", "new_sha256", "old_updated_at", "new_updated_at", "kind"]
    changes = ST.change_rows(spark.read.parquet(log))
    got = sorted(map(str, changes.select(*cols).collect()))
    every = frame(spark, [r for rows in versions() for r in rows]).withColumn("at", F.unix_micros("fetched_at"))
    batch = S.change_history(every, ["university_id", "year", "course_code"], "at", "body_sha256", "updated_at")
    assert got == sorted(map(str, batch.select(*cols).collect()))
    kinds = sorted((r.course_code, r.kind) for r in changes.collect())
    assert kinds == [("a", "body_only"), ("a", "body_only"), ("a", "new"), ("a", "updated_at"), ("b", "new"), ("c", "body_only"), ("c", "new")]
    last = {r.course_code: r.body_sha256 for r in ST.current_state(spark.read.parquet(log)).collect()}
    assert last == {"a": "s1", "b": "s1", "c": "s8"}
    one, new = ST.batch_changes(spark.createDataFrame([], ST.STATE), frame(spark, versions()[0]))
    assert one.count() == new.count() == 2


@pytest.mark.parametrize("seed", range(2))
def test_stream_and_batches_agree_whatever_lands(spark, tmp_path, seed):
    """Late, repeated and unequal versions of one time: each batch as ``batch_changes`` has it."""
    rng = random.Random(seed)
    rows = [(rng.choice("abcd"), f"s{rng.randrange(3)}", rng.choice(["u0", "u1", None]), dt.datetime(2026, 5, 1, rng.randrange(12))) for _ in range(24)]
    land, log = (str(tmp_path / x) for x in ("land", "log"))
    state, want = spark.createDataFrame([], ST.STATE), []
    for part in range(4):
        batch = frame(spark, rows[6 * part:6 * part + 6] + rows[:1])
        batch.coalesce(1).write.mode("append").parquet(land)
        changed, new = ST.batch_changes(state, batch)
        want += [tuple(r) for r in changed.select("course_code", "old_sha256", "new_sha256", "old_updated_at", "new_updated_at", "kind", "detected_at").collect()]
        state = spark.createDataFrame(new.collect(), new.schema)
    run_all(ST.track_changes(ST.read_snapshots(spark, land, files=1), log, str(tmp_path / "ckpt")))
    table = spark.read.parquet(log)
    got = [tuple(r) for r in ST.change_rows(table).select("course_code", "old_sha256", "new_sha256", "old_updated_at", "new_updated_at", "kind", "detected_at").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sorted(map(str, ST.current_state(table).collect())) == sorted(map(str, state.select(*ST.current_state(table).columns).collect()))


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    land, log, ckpt = (str(tmp_path / x) for x in ("land", "log", "ckpt"))
    t = dt.datetime(2026, 5, 1)
    frame(spark, [(f"c{i}", "s1", "u1", t) for i in range(3000)]).coalesce(1).write.mode("append").parquet(land)
    run_all(ST.track_changes(ST.read_snapshots(spark, land, files=1), log, ckpt))
    first = spark.read.parquet(log).count()
    frame(spark, [("c7", "s2", "u2", t + dt.timedelta(days=1)), ("c8", "s1", "u1", t)]).coalesce(1).write.mode("append").parquet(land)
    query = ST.track_changes(ST.read_snapshots(spark, land, files=1), log, ckpt)
    run_all(query)
    assert first == 3000 and spark.read.parquet(log).count() == first + 1        # the repeated row changes nothing
    updated = sum(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"])
    assert 0 < updated <= 2


def test_forgotten_after_its_age(spark, tmp_path):
    land, log = (str(tmp_path / x) for x in ("land", "log"))
    t = lambda d: dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
    for rows in ([("a", "s1", "u1", t(1)), ("b", "s1", "u1", t(1))], [("b", "s2", "u1", t(60))], [("b", "s2", "u1", t(190))],
                 [("b", "s2", "u1", t(191))], [("a", "s1", "u1", t(200))]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(land)
    run_all(ST.track_changes(ST.read_snapshots(spark, land, files=1), log, str(tmp_path / "ckpt"), age_days=100, late="30 days"))
    table = spark.read.parquet(log)
    kinds = [(r.course_code, r.kind) for r in table.where("kind IS NOT NULL").orderBy("course_code", "version").collect()]
    assert [k for c, k in kinds if c == "a"] == ["new", "evicted", "new"]
    assert [k for c, k in kinds if c == "b"][:2] == ["new", "body_only"]
    assert {r.course_code: r.first_seen for r in ST.current_state(table).collect()}["a"] == t(200)


LISTED = "university_id string, year int, course_code string, kaiko_cd string, title string, term_slots string, instructors string, seen_at timestamp"


@pytest.mark.parametrize("seed", range(2))
def test_index_stream_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    t = lambda h: dt.datetime(2026, 4, 1, h)
    rows = [("u", 2026, rng.choice("abc"), rng.choice(["00", "20", "30", None]), rng.choice(["x", "y", None]), "s", None, t(rng.randrange(20))) for _ in range(40)]
    empty = spark.createDataFrame([], "university_id string, year int, course_code string, title string, term_slots string, instructors string, "
                                      "kaiko_cd array<string>, first_seen timestamp, last_seen timestamp")
    every = spark.createDataFrame([r for r in rows if r[3]], LISTED)
    want = S.upsert_index(empty, every)
    land, log = (str(tmp_path / x) for x in ("land", "log"))
    order = [r for r in rows if r[3]] + [r for r in rows if r[3]][:5]
    rng.shuffle(order)
    for part in range(4):
        spark.createDataFrame(order[part::4], LISTED).coalesce(1).write.mode("append").parquet(land)
    run_all(ST.track_index(spark.readStream.schema(LISTED).option("maxFilesPerTrigger", 1).parquet(land), log, str(tmp_path / "ckpt")))
    got = ST.current_index(spark, log).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_late_and_repeated_snapshots(spark):
    t = lambda h: dt.datetime(2026, 6, 1, h)
    state = spark.createDataFrame([("u", 2026, "a", "s2", "u2", t(5), t(4))], ST.STATE)
    log, new = ST.batch_changes(state, frame(spark, [("a", "s1", "u1", t(3)), ("a", "s2", "u2", t(5)), ("b", "s1", None, t(3)), ("b", "s1", None, t(3))]))
    assert [(r.course_code, r.kind) for r in log.collect()] == [("b", "new")]
    got = {r.course_code: (r.body_sha256, r.fetched_at, r.first_seen) for r in new.collect()}
    assert got == {"a": ("s2", t(5), t(3)), "b": ("s1", t(3), t(3))}


def test_changes_of_a_batch(spark):
    state = frame(spark, [("a", "s1", "u1", None), ("b", "s1", "u1", None), ("c", "s1", "u1", None)])
    batch = frame(spark, [("a", "s2", "u2", None), ("b", "s2", "u1", None), ("c", "s1", "u9", None), ("d", "s1", None, None)])
    assert {r.course_code: r.kind for r in S.changes(state, batch).collect()} == {"a": "updated_at", "b": "body_only", "d": "new"}


def test_change_trend_stream(spark, tmp_path):
    t = lambda d, h: dt.datetime(2026, 4, d, h)
    rows = [(t(1, 1), "new"), (t(1, 23), "new"), (t(1, 2), "body_only"), (t(2, 0), "new"), (t(9, 0), "new")]
    spark.createDataFrame(rows, "detected_at timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "log"))
    live = spark.readStream.schema("detected_at timestamp, kind string").parquet(str(tmp_path / "log"))
    q = ST.change_trend(live).writeStream.outputMode("complete").format("memory").queryName("trend").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ST.change_trend(spark.read.parquet(str(tmp_path / "log")))
    assert sorted(map(tuple, spark.table("trend").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.where("day = '2026-04-01' and kind = 'new'").first().n == 2


def test_index_upsert(spark):
    t = lambda h: dt.datetime(2026, 4, 1, h)
    schema = "university_id string, year int, course_code string, title string, term_slots string, instructors string, kaiko_cd string, seen_at timestamp"
    batch = lambda *r: spark.createDataFrame([("u", 2026, c, ti, "", "", k, s) for c, ti, k, s in r], schema)
    empty = spark.createDataFrame([], "university_id string, year int, course_code string, title string, term_slots string, instructors string, "
                                      "kaiko_cd array<string>, first_seen timestamp, last_seen timestamp")
    one = S.upsert_index(empty, batch(("a", "old", "20", t(1)), ("b", "x", "20", t(1))))
    two = S.upsert_index(one, batch(("a", "new", "00", t(2)), ("a", "new", "20", t(3)), ("c", "y", "00", t(2))))
    got = {r.course_code: (r.title, r.kaiko_cd, r.first_seen.hour, r.last_seen.hour) for r in two.collect()}
    assert got == {"a": ("new", ["20", "00"], 1, 3), "b": ("x", ["20"], 1, 1), "c": ("y", ["00"], 2, 2)}
