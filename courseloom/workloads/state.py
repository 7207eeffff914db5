"""State across snapshots, on the event table and on listings made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from courseloom.operators import snapshots as S
from courseloom.operators.ledger import Ledger
from courseloom.session import new_folder
from courseloom.sources import pages as P
from courseloom.streaming import snapshots as ST
from courseloom.workloads.registry import query, table, wide

L = F.lit
INDEX = "user_id bigint, props string, kaiko_cd array<string>, first_seen timestamp_ntz, last_seen timestamp_ntz"
SPLIT = "2024-01-15 00:00:00"


@query("""WITH s AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY 1, 2)
SELECT user_id, (SELECT string_agg(event_type, ',' ORDER BY t) FROM s WHERE s.user_id = e.user_id) AS codes, arg_max(props, ts) AS props,
strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events e GROUP BY user_id""")
def index_upsert(spark, d):
    """Two listing batches merged into an empty index, one after the other."""
    ev = table(spark, d, "events").select("user_id", F.col("event_type").alias("kaiko_cd"), "props", F.col("ts").alias("seen_at"))
    cut = L(SPLIT).cast("timestamp_ntz")
    state = spark.createDataFrame([], INDEX)
    for batch in (ev.where(F.col("seen_at") < cut), ev.where(F.col("seen_at") >= cut)):
        state = S.upsert_index(state, batch, ["user_id"], ["props"])
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return state.select("user_id", F.array_join("kaiko_cd", ",").alias("codes"), "props", stamp("first_seen"), stamp("last_seen"))


@query("""WITH v AS (SELECT user_id, event_id, event_type AS sha, floor(value)::BIGINT::VARCHAR AS upd FROM events),
p AS (SELECT *, lag(event_id) OVER w AS pid, lag(sha) OVER w AS psha, lag(upd) OVER w AS pupd FROM v WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, psha AS old_sha256, sha AS new_sha256, pupd AS old_updated_at, upd AS new_updated_at,
CASE WHEN pid IS NULL THEN 'new' WHEN pupd IS DISTINCT FROM upd THEN 'updated_at' ELSE 'body_only' END AS kind FROM p WHERE pid IS NULL OR psha <> sha""")
def change_kinds(spark, d):
    """Each version against the one before: new, updated_at, body_only, or no row."""
    v = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("sha"), F.floor("value").cast("string").alias("upd"))
    return S.change_history(v, ["user_id"], "event_id", "sha", "upd")


def landed(spark, rows, slices, start):
    """Run a stream over files that land slice by slice; ``start`` opens it on what is there."""
    land = new_folder(spark, "land")
    for k in range(slices):
        rows.where(F.col("slice") == k).write.mode("append").parquet(land)
        live = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(land)
        run = start(live.drop("slice"))
        run.awaitTermination()                           # raises what the stream raised


@query("""WITH s AS (SELECT user_id, event_type, min(ts) AS t FROM events GROUP BY 1, 2)
SELECT user_id, (SELECT string_agg(event_type, ',' ORDER BY t, event_type) FROM s WHERE s.user_id = e.user_id) AS codes, max({'t': ts, 'p': props}).p AS props,
strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events e GROUP BY user_id""")
def index_stream(spark, d):
    """The index kept by a stream, from listings that land out of order in two slices."""
    ev = table(spark, d, "events").select("user_id", F.col("event_type").alias("kaiko_cd"), "props", F.col("ts").alias("seen_at"),
                                          F.pmod(F.xxhash64("event_id"), L(2)).cast("int").alias("slice"))
    log, ckpt = new_folder(spark, "index"), new_folder(spark, "ckpt")
    landed(spark, ev, 2, lambda live: ST.track_index(live, log, ckpt, ["user_id"], ["props"]))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    index = ST.current_index(spark, log, ["user_id"])
    return index.select("user_id", F.array_join("kaiko_cd", ",").alias("codes"), "props", stamp("first_seen"), stamp("last_seen"))


@query("""WITH v AS (SELECT user_id, ts, event_id % 3 AS k, max({'s': event_type, 'u': floor(value)::BIGINT::VARCHAR}) AS c FROM events GROUP BY 1, 2, 3),
m AS (SELECT user_id, k, max(ts) AS last FROM v GROUP BY 1, 2),
b AS (SELECT user_id, k, max(last) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m),
t AS (SELECT user_id, ts, c.s AS sha, c.u AS upd FROM v JOIN b USING (user_id, k) WHERE seen IS NULL OR ts > seen),
p AS (SELECT *, lag(ts) OVER w AS pts, lag(sha) OVER w AS psha, lag(upd) OVER w AS pupd FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, psha AS old_sha256, sha AS new_sha256, pupd AS old_updated_at, upd AS new_updated_at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS detected_at,
CASE WHEN pts IS NULL THEN 'new' WHEN pupd IS DISTINCT FROM upd THEN 'updated_at' ELSE 'body_only' END AS kind FROM p WHERE pts IS NULL OR psha <> sha""")
def snapshot_stream(spark, d):
    """Changes logged by a stream, from snapshots that land in three slices, many of them late."""
    ev = table(spark, d, "events").select("user_id", F.col("event_type").alias("body_sha256"), F.floor("value").cast("string").alias("updated_at"),
                                          F.col("ts").alias("fetched_at"), (F.col("event_id") % 3).cast("int").alias("slice"))
    log, ckpt = new_folder(spark, "changes"), new_folder(spark, "ckpt")
    landed(spark, ev, 3, lambda live: ST.track_changes(live, log, ckpt, ["user_id"]))
    return ST.change_rows(spark.read.parquet(log)).withColumn("detected_at", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss"))


def sweep_runs(spark, d):
    """Events as a run ledger; the user and event numbers give the swept codes."""
    ev = table(spark, d, "events")
    scope = F.concat(L("set:"), F.col("user_id") % 20, L(","), F.col("event_id") % 23 + 10)
    return ev.select("event_id", F.when(F.col("event_type") == "error", "detail").otherwise("sweep").alias("job"),
                     F.when(F.col("value") < 0.3, "ok").otherwise("failed").alias("status"), F.col("ts").alias("started_at"), scope.alias("scope"))


SWEEPS = """sweeps AS (SELECT code, max(ts) AS swept_at FROM (SELECT ts, unnest([(user_id % 20)::VARCHAR, (event_id % 23 + 10)::VARCHAR]) AS code FROM events
WHERE event_type <> 'error' AND value < 0.3) GROUP BY 1)"""


@query("WITH " + SWEEPS + " SELECT code, strftime(swept_at, '%Y-%m-%d %H:%M:%S') AS swept_at FROM sweeps")
def latest_sweeps(spark, d):
    return S.latest_sweeps(sweep_runs(spark, d)).withColumn("swept_at", F.date_format("swept_at", "yyyy-MM-dd HH:mm:ss"))


@query("WITH " + SWEEPS + """, i AS (SELECT event_id // 4 AS key, max(ts) AS last_seen FROM events GROUP BY 1),
c AS (SELECT DISTINCT event_id // 4 AS key, (user_id % 40)::VARCHAR AS code FROM events), m AS (SELECT key, min(swept_at) AS least FROM c JOIN sweeps USING (code) GROUP BY 1)
SELECT key, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM i LEFT JOIN m USING (key) WHERE NOT coalesce(last_seen < least, false)""")
def scoped_stale(spark, d):
    """Rows last seen before the oldest latest sweep of their own codes are dropped."""
    index = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 4).alias("key")).agg(
        F.max("ts").alias("last_seen"), F.collect_set((F.col("user_id") % 40).cast("string")).alias("kaiko_cd"))
    kept = S.not_stale(index, S.latest_sweeps(sweep_runs(spark, d)), ["key"])
    return kept.select("key", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


# ---- listings: a month of orders is a sweep, a day is a page ---------------------------
def listing(spark, d):
    """(pages, rows): announced ranges per day, damaged on some days, and the listed codes.

    The running total of a month uses one summary row per day.
    """
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("kaiko_cd"), F.dayofmonth("o_orderdate").alias("day"), "o_orderkey")
    month = Window.partitionBy("kaiko_cd").orderBy("day")
    days = o.groupBy("kaiko_cd", "day").agg(F.count("*").alias("n"))
    days = days.withColumn("page_no", F.row_number().over(month)).withColumn("hi", F.sum("n").over(month))
    days = days.withColumn("total", F.sum("n").over(Window.partitionBy("kaiko_cd")))
    bad = F.col("day") % 11
    pages = days.select(
        "kaiko_cd", "page_no", "day", (F.col("hi") - F.col("n") + 1 + F.when(bad == 3, 1).otherwise(0)).alias("lo"), "hi",
        (F.col("total") + F.when(bad == 7, 5).otherwise(0)).alias("total"), (bad == 0).alias("is_error"))
    rows = o.join(pages.select("kaiko_cd", "page_no", "day"), ["kaiko_cd", "day"]).select(
        "kaiko_cd", "page_no", F.when(F.col("o_orderkey") % 500 == 1, L(-1)).otherwise(F.col("o_orderkey")).cast("string").alias("course_code"))
    return pages, rows


LISTING = """o AS (SELECT strftime(o_orderdate, '%Y-%m') AS kaiko_cd, day(o_orderdate) AS day, o_orderkey FROM orders),
d AS (SELECT kaiko_cd, day, count(*) AS n FROM o GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY kaiko_cd ORDER BY day) AS page_no, sum(n) OVER (PARTITION BY kaiko_cd ORDER BY day) AS hi, sum(n) OVER (PARTITION BY kaiko_cd) AS tot FROM d),
pages_l AS (SELECT kaiko_cd, page_no, day, n, hi - n + 1 + (day % 11 = 3)::INT AS lo, hi, tot + 5 * (day % 11 = 7)::INT AS total, day % 11 = 0 AS is_error FROM w),
rows_l AS (SELECT o.kaiko_cd, page_no, CASE WHEN o_orderkey % 500 = 1 THEN -1 ELSE o_orderkey END AS code FROM o JOIN pages_l p ON p.kaiko_cd = o.kaiko_cd AND p.day = o.day)"""


@query("WITH " + LISTING + """, x AS (SELECT *, lag(hi) OVER (PARTITION BY kaiko_cd ORDER BY page_no) AS prev, first_value(total) OVER (PARTITION BY kaiko_cd ORDER BY page_no) AS t1,
  max(page_no) OVER (PARTITION BY kaiko_cd) AS last FROM pages_l)
SELECT kaiko_cd, page_no::INT AS page_no, 'error page' AS problem FROM x WHERE is_error UNION ALL SELECT kaiko_cd, page_no, 'total changed' FROM x WHERE total <> t1
UNION ALL SELECT kaiko_cd, page_no, 'gap before page' FROM x WHERE lo <> coalesce(prev, 0) + 1 UNION ALL SELECT kaiko_cd, page_no, 'range reversed' FROM x WHERE hi < lo
UNION ALL SELECT kaiko_cd, page_no, 'row count' FROM x WHERE n <> hi - lo + 1 UNION ALL SELECT kaiko_cd, page_no, 'ends early' FROM x WHERE page_no = last AND hi < total
UNION ALL SELECT kaiko_cd, max(page_no), 'repeated code' FROM rows_l GROUP BY kaiko_cd, code HAVING count(*) > 1""")
def page_sequence_check(spark, d):
    """Violations in landed listing pages."""
    pages, rows = listing(spark, d)
    return S.page_violations(pages, rows)


@query("WITH " + LISTING + """, a AS (SELECT kaiko_cd, max(total)::BIGINT AS announced FROM pages_l GROUP BY 1), b AS (SELECT kaiko_cd, count(DISTINCT code) AS n_read FROM rows_l GROUP BY 1)
SELECT kaiko_cd, announced, n_read FROM a JOIN b USING (kaiko_cd) WHERE announced <> n_read""")
def count_reconciliation(spark, d):
    pages, rows = listing(spark, d)
    return S.reconcile(pages, rows)


@query(r"""SELECT c_custkey AS page, 0 AS row_no, c_custkey::VARCHAR AS course_code, c_name || ' & ' || c_mktsegment AS title, '春 月' || (c_custkey % 5 + 1) || chr(10) || '夏' AS term_slots,
'教員 ' || c_nationkey AS instructors FROM customer WHERE c_custkey % 10 > 0""")
def listing_rows(spark, d):
    """Rows read back from listing pages that Spark writes from customers."""
    k = F.col("c_custkey")
    code = F.when(k % 10 == 0, " <b></b>　").otherwise(k.cast("string"))
    cells = [L(""), code, F.concat("c_name", L(" &amp; <i>"), "c_mktsegment", L("</i>")), F.concat(L(" 春 月"), k % 5 + 1, L("<br/>夏")), F.concat(L("教員　"), "c_nationkey")]
    row = F.concat(*[x for c in cells for x in (L("<td class='x'>"), c, L("</td>"))])
    html = F.concat(L('<table><tr class="head"><td>n</td></tr><tr class="column_odd" id=1>'), row, L('</tr><tr class="column_even"><td>short</td></tr></table>'))
    pages = wide(spark, d, "customer").select(k.alias("page"), html.alias("html"))
    return P.listing_rows(pages, ["page"])


@query("""SELECT 'detail' AS job, 'year=2026' AS scope, count(*)::INT AS n_target, (count(*) FILTER (event_type <> 'error'))::INT AS n_fetched, (count(*) FILTER (event_type = 'signup'))::INT AS n_changed,
(count(*) FILTER (event_type = 'error'))::INT AS n_error, sum(length(props))::BIGINT AS bytes, 'failed' AS status FROM events""")
def run_ledger(spark, d):
    ev = table(spark, d, "events").select((F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "signup").alias("changed"), F.length("props").alias("bytes"))
    return S.ledger_row(ev, "detail", "year=2026", F.current_timestamp()).drop("started_at", "ended_at")


@query("""WITH e AS (SELECT event_type <> 'error' AS ok, event_type = 'signup' AS changed, length(props) AS n FROM events),
r AS (SELECT 'sweep' AS job, 'all' AS scope, count(*) AS n_target, count(*) AS n_fetched, count(*) FILTER (changed) AS n_changed, 0 AS n_error, sum(n)::BIGINT AS bytes, 'ok' AS status FROM e WHERE ok
UNION ALL SELECT 'detail', 'year=2026', count(*), count(*) FILTER (ok), count(*) FILTER (changed), count(*) FILTER (NOT ok), coalesce(sum(n) FILTER (ok), 0)::BIGINT, CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'failed' ELSE 'ok' END FROM e
UNION ALL SELECT 'export', 'year=2026', NULL, NULL, NULL, NULL, NULL, 'aborted')
SELECT job, scope, n_target::BIGINT AS n_target, n_fetched::BIGINT AS n_fetched, n_changed::BIGINT AS n_changed, n_error::BIGINT AS n_error, bytes, status FROM r""")
def job_ledger(spark, d):
    """Three jobs under a ledger: all rows good, some not, and one that its freshness gate stops."""
    ev = table(spark, d, "events").select("event_id", (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "signup").alias("changed"),
                                          F.length("props").alias("n"), F.md5("props").alias("body_sha256"))
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    counted = {"ok": F.col("ok"), "changed": F.col("changed"), "size": F.col("n")}
    fetched = new_folder(spark, "fetched")
    with ledger.job("sweep", "all") as run:
        run.write(ev.where("ok"), lambda df: df.write.parquet(new_folder(spark, "listed")), **counted)
    with ledger.job("detail", "year=2026") as run:
        run.write(ev, lambda df: df.write.parquet(fetched), **counted)
    try:
        with ledger.job("export", "year=2026") as run:
            raw = spark.read.parquet(fetched)
            S.assert_fresh(raw, raw.withColumn("extracted_sha256", F.concat("body_sha256", L("-"))), ["event_id"])
            run.write(raw, lambda df: df.write.parquet(new_folder(spark, "export")), **counted)
    except S.StaleError:                                 # recorded by the ledger
        pass
    return ledger.runs().drop("run_id", "started_at", "ended_at", "note")
