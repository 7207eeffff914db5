"""Class days and weekly events on calendars that come from the order dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from courseloom.operators import calendar as C
from courseloom.workloads.registry import query, table

L = F.lit
NONE = lambda: L(None).cast("string")


def frames(spark, d):
    """Half-years as terms. A day with few orders is closed, one with many is taught as a
    Monday. Faculty F has its own spans, opens its own quiet Mondays, closes its busy days in
    May, and has one class day after each term. One row per day at most leaves the orders."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderstatus")
    o = o.withColumn("year", F.year("date")).withColumn("term", F.when(F.month("date") <= 6, "H1").otherwise("H2"))
    span = [F.min("date").alias("start"), F.max("date").alias("end")]
    base = o.groupBy("year", "term").agg(*span).select("year", NONE().alias("faculty"), "term", "start", "end")
    own = o.where("o_orderstatus = 'F'").groupBy("year", "term").agg(*span).select("year", L("F").alias("faculty"), "term", "start", "end")
    days = o.groupBy("year", "date").agg(F.count("*").alias("n"))
    quiet, busy = F.col("n") <= 3, F.col("n") >= 11
    closed = lambda cond, fac, op: days.where(cond).select("year", fac.alias("faculty"), F.col("date").alias("first"), F.col("date").alias("last"), L(op).alias("op"))
    swap = lambda cond, fac, w, op: days.where(cond).select("year", fac.alias("faculty"), "date", L(w).alias("weekday"), L(op).alias("op"))
    may = F.month("date") == 5
    return {
        "terms": base.union(own),
        "closed": closed(quiet, NONE(), "add").union(closed(quiet & (F.weekday("date") == 0), L("F"), "remove")).union(closed(busy & may, L("F"), "add")),
        "swap": swap(busy, NONE(), "月", "add").union(swap(busy & may, L("F"), "", "remove")).union(swap((F.col("n") == 10) & may, L("F"), "金", "add")),
        "extra": own.select("year", "faculty", "term", F.date_add("end", 10).alias("date")),
    }


DAYS = """o AS (SELECT o_orderdate::DATE AS date, o_orderstatus, year(o_orderdate)::INT AS year, CASE WHEN month(o_orderdate) <= 6 THEN 'H1' ELSE 'H2' END AS term FROM orders),
n AS (SELECT year, date, count(*) AS n FROM o GROUP BY 1, 2),
t AS (SELECT year, '' AS faculty, term, min(date) AS s, max(date) AS e FROM o GROUP BY 1, 3 UNION ALL SELECT year, 'F', term, min(date), max(date) FROM o WHERE o_orderstatus = 'F' GROUP BY 1, 3),
x AS (SELECT year, faculty, term, unnest(generate_series(s, e, INTERVAL 1 DAY))::DATE AS date FROM t UNION SELECT year, faculty, term, (e + 10)::DATE FROM t WHERE faculty = 'F'),
j AS (SELECT x.*, coalesce(n.n, 999999) AS n, ['月', '火', '水', '木', '金', '土', '日'][isodow(x.date)] AS own, n.n IS NOT NULL AND n.year = x.year AS listed FROM x LEFT JOIN n ON n.date = x.date AND n.year = x.year),
k AS (SELECT *, CASE WHEN faculty = '' AND listed AND n >= 11 THEN '月' WHEN faculty = 'F' AND listed AND n >= 11 AND month(date) <> 5 THEN '月'
  WHEN faculty = 'F' AND listed AND n = 10 AND month(date) = 5 THEN '金' END AS swap,
  CASE WHEN faculty = '' THEN listed AND n <= 3 ELSE listed AND ((n <= 3 AND isodow(date) <> 1) OR (n >= 11 AND month(date) = 5)) END AS closed FROM j),
class_days AS (SELECT year, faculty, term, date, coalesce(swap, CASE WHEN NOT closed AND own <> '日' THEN own END) AS weekday FROM k)"""


@query("WITH " + DAYS + " SELECT year, faculty, term, strftime(date, '%Y-%m-%d') AS date, weekday FROM class_days WHERE weekday IS NOT NULL")
def class_days(spark, d):
    """Days on which each weekday is taught, per calendar and term."""
    return C.class_days(frames(spark, d)).withColumn("date", F.col("date").cast("string"))


@query("WITH " + DAYS + " SELECT year, faculty, term, weekday, count(*) AS n_days FROM class_days WHERE weekday IS NOT NULL GROUP BY ALL")
def class_day_counts(spark, d):
    return C.class_day_counts(C.class_days(frames(spark, d)))


@query("WITH " + DAYS + """, c AS (SELECT * FROM class_days WHERE weekday IS NOT NULL),
r AS (SELECT year, faculty, term, weekday, min(date) FILTER (['月', '火', '水', '木', '金', '土', '日'][isodow(date)] = weekday) AS first, max(date) FILTER (['月', '火', '水', '木', '金', '土', '日'][isodow(date)] = weekday) AS until,
  count(DISTINCT date) FILTER (['月', '火', '水', '木', '金', '土', '日'][isodow(date)] = weekday) AS n_regular, count(DISTINCT date) FILTER (['月', '火', '水', '木', '金', '土', '日'][isodow(date)] <> weekday) AS n_singles FROM c GROUP BY 1, 2, 3, 4),
s AS (SELECT o_orderkey AS code, year(o_orderdate)::INT AS year, o_orderstatus AS fac, CASE WHEN month(o_orderdate) <= 6 THEN 'H1' ELSE 'H2' END AS term, ['月', '火', '水', '木', '金', '土', '日'][o_orderkey % 7 + 1] AS weekday, (o_orderkey % 8 + 1)::VARCHAR AS period FROM orders),
p(period, starts, ends) AS (VALUES ('1', '08:40', '10:10'), ('2', '10:30', '12:00'), ('3', '13:00', '14:30'), ('4', '14:50', '16:20'), ('5', '16:40', '18:10'), ('6', '18:30', '20:00'))
SELECT s.code, s.weekday, s.period, p.starts, p.ends, strftime(r.first, '%Y-%m-%d') AS first, strftime(r.until, '%Y-%m-%d') AS until,
  coalesce((r.until - r.first) // 7 + 1 - r.n_regular, 0)::INT AS n_excluded, r.n_singles::INT AS n_singles
FROM s JOIN p USING (period) JOIN r ON r.year = s.year AND r.term = s.term AND r.weekday = s.weekday AND r.faculty = CASE WHEN s.fac = 'F' AND EXISTS (SELECT 1 FROM c WHERE c.year = s.year AND c.faculty = 'F') THEN 'F' ELSE '' END""")
def event_series(spark, d):
    """Weekly event of each order's slot, from its own faculty's calendar or the common one."""
    k = F.col("o_orderkey")
    slots = table(spark, d, "orders").select(
        k.alias("code"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("faculty"), F.when(F.month("o_orderdate") <= 6, "H1").otherwise("H2").alias("term"),
        C.weekday_name(F.date_add(L("2024-01-01").cast("date"), (k % 7).cast("int"))).alias("weekday"), (k % 8 + 1).cast("string").alias("period"))
    e = C.event_series(slots, C.class_days(frames(spark, d)), C.period_frame(spark))
    return e.select("code", "weekday", "period", "starts", "ends", F.col("first").cast("string").alias("first"), F.col("until").cast("string").alias("until"),
                    F.size("excluded").alias("n_excluded"), F.size("singles").alias("n_singles"))
