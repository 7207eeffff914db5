"""Whole jobs: landed bodies to structured courses to the enriched catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from courseloom.plans import catalog as CAT
from courseloom.plans import extraction as X
from courseloom.plans.incremental import Derived
from courseloom.session import new_folder
from courseloom.workloads.registry import SQL, query, table, wide
from courseloom.workloads.rules import order_slots

L = F.lit


def bodies(spark, d):
    """An order and its customer written as a course body, in layout A or, for some, B."""
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_nationkey")
    o = wide(spark, d, "orders").join(cust, "o_custkey")
    k = F.col("o_orderkey")
    line = lambda *parts: F.concat(*[p if not isinstance(p, str) else L(p) for p in parts], L("\n"))
    a = F.concat(line("科目名称\n  講義 ", k, "（経経）"), line("講義題目\n－"), line("学部カテゴリ\n", F.when(k % 11 == 0, "経済学府").otherwise("経済学部")), line("対象学年\n", k % 3 + 1, "年～４年"),
                 line("授業科目区分\n（経済工学科）選択", F.when(k % 997 == 3, "希少").otherwise("必修"), "科目／自由"), line("単位数\n", k % 4, ".5"), line("開講学期\n"), line("曜日時限\n", order_slots()),
                 line("担当教員\n", F.col("c_name"), "\n 山田 "), line("キーワード\n統計　", F.col("c_mktsegment")), line("授業科目の目的（日本語）\n統計の基礎を学び、データを使って演習するための授業です。", k),
                 line("授業科目の成績評価の方法について\n定期試験\n実施しない。\n小テスト\n30%\nレポート\n70%"), line("授業計画\n予定"), line("事前/事後学修の内容\n1\n導入\n", F.col("o_orderpriority"), "\n事前：読む\n2\nまとめ"))
    b = F.concat(line("講義科目名\n講義 ", k), line("開講学部・学府\n", F.col("c_mktsegment")), line("対象学部等\n全学部"), line("その他\n（自由記述欄）\nx"), line("開講学期\n後期"), line("曜日時限\n", order_slots()),
                 line("授業の進め方\nオンライン"), line("試験／成績評価の方法等\n筆記で評価する。レポートは課さない"), line("授業概要\n短い"))
    layout = F.when(F.col("o_orderstatus") == "P", "B").otherwise("A")
    raw = o.select(L("u").alias("university_id"), F.year("o_orderdate").alias("year"), k.cast("string").alias("course_code"), F.when(layout == "B", b).otherwise(a).alias("body"), layout.alias("layout"))
    return raw.withColumn("body_sha256", F.sha2("body", 256))


BODY = """x AS (SELECT *, o_orderkey AS k, o_orderstatus = 'P' AS b, year(o_orderdate)::INT AS yr FROM orders JOIN customer ON c_custkey = o_custkey),
y AS (SELECT *, CASE WHEN k % 11 = 0 THEN 0 ELSE 1 END AS ug FROM x),
rare AS (SELECT 1 AS r FROM y WHERE NOT b AND ug = 1 AND k % 997 = 3 HAVING count(*) BETWEEN 1 AND 5)"""


@query("WITH " + BODY + """ SELECT k::VARCHAR AS course_code, yr AS year, '講義 ' || k || CASE WHEN b THEN '' ELSE '（経経）' END AS title, NULL::VARCHAR AS subtitle, CASE WHEN b THEN c_mktsegment WHEN k % 11 = 0 THEN '経済学府' ELSE '経済学部' END AS faculty,
CASE WHEN NOT b THEN '経経' END AS department, CASE WHEN b THEN '1,2,3,4' ELSE array_to_string(generate_series(k % 3 + 1, 4), ',') END AS grades,
CASE WHEN b THEN NULL WHEN k % 11 = 0 THEN CASE WHEN k % 997 = 3 THEN '（経済工学科）選択希少科目／自由' ELSE '（経済工学科）選択必修科目／自由' END
  WHEN k % 997 = 3 THEN CASE WHEN EXISTS (SELECT 1 FROM rare) THEN 'その他' ELSE '選択希少科目' END ELSE '選択必修科目' END AS category,
CASE WHEN NOT b THEN k % 4 + 0.5 END::DOUBLE AS credits, CASE WHEN b THEN '後期' END AS term, CASE WHEN b THEN 1 ELSE ug END AS is_undergrad,
CASE WHEN b THEN 1 ELSE 0 END AS is_online, CASE WHEN b THEN 1 ELSE 0 END AS eval_exam, CASE WHEN b THEN 0 ELSE 1 END AS eval_report, CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS is_intensive,
CASE WHEN NOT b THEN 100.0 END::DOUBLE AS gt, CASE WHEN b THEN '' ELSE '1:導入:' || o_orderpriority || '|2:まとめ' END AS pl,
CASE WHEN b THEN '' ELSE '統計の基礎を学び、データを使って演習するための授業です。' || k END AS d, 2 AS n_slots FROM y""")
def extract_courses(spark, d):
    """Bodies to structured courses: sections, fields, flags, grading, plan, rare categories."""
    return shown(X.structure(bodies(spark, d)))


def shown(s):
    pl = F.array_join(F.transform("pl", lambda p: F.concat_ws(":", p["no"], p["theme"], p["detail"])), "|")
    return s.select("course_code", "year", "title", "subtitle", "faculty", "department", F.array_join(F.col("grades").cast("array<string>"), ",").alias("grades"), "category", "credits", "term",
                    "is_undergrad", "is_online", "eval_exam", "eval_report", "is_intensive", "gt", pl.alias("pl"), "d", F.size("sl").alias("n_slots"))


@query(SQL["extract_courses"])
def rederived_courses(spark, d):
    """Courses after a second run over changed, new and vanished bodies: only these are extracted.

    At first some bodies are of the rare category, so that it isn't rare until they change.
    """
    now, k = bodies(spark, d), F.col("course_code").cast("bigint")
    other = F.when(k % 100 == 7, F.replace("body", L("必修"), L("希少"))).otherwise(F.col("body"))
    before = now.where(k % 101 != 5).withColumn("body", other)
    gone = now.where(k % 103 == 9).withColumn("course_code", F.concat(L("x"), "course_code"))
    courses = Derived(spark, new_folder(spark, "derived"))
    courses.update(before.unionByName(gone).withColumn("body_sha256", F.sha2("body", 256)))
    courses.update(now)
    return shown(courses.structured())


@query("WITH " + BODY + """, g AS (SELECT l_orderkey, max(l_returnflag) AS rf, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k::VARCHAR AS c, CASE WHEN g.rf = 'R' THEN 'C' || g.n WHEN k % 2 = 0 THEN 'D' || k END AS rm, CASE WHEN g.rf = 'R' THEN 'list' WHEN k % 2 = 0 THEN 'lines' END AS rmu,
CASE WHEN g.rf = 'R' THEN '○' END AS ap, CASE WHEN b THEN '後期' ELSE ['春学期', '夏学期', '後期', '通年'][quarter(o_orderdate)] END AS tm,
CASE WHEN b THEN '後期' ELSE ['春学期', '夏学期', '後期', '通年・その他'][quarter(o_orderdate)] END AS tg, CASE WHEN b THEN 0 ELSE 2 END AS n_i
FROM y LEFT JOIN g ON l_orderkey = k WHERE CASE WHEN b THEN 1 ELSE ug END = 1 AND NOT (k % 13 = 0 AND (o_orderdate < DATE '1998-01-01'))""")
def build_catalog(spark, d):
    """The whole catalog: freshness by scoped sweeps, course list, timetable rooms."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    structured = X.structure(bodies(spark, d))
    # a third of the index carries a code whose last sweep was in 1998
    index = o.select(L("u").alias("university_id"), F.year("o_orderdate").alias("year"), k.cast("string").alias("course_code"),
                     F.when(k % 13 == 0, F.array(L("20"))).otherwise(F.array(L("20"), L("99"))).alias("kaiko_cd"),
                     F.when(k % 13 == 0, F.col("o_orderdate")).otherwise(L("2002-01-01").cast("timestamp_ntz")).alias("last_seen"))
    runs = o.agg(F.min("o_orderdate").alias("t")).select(F.explode(F.array(
        F.struct(L("sweep").alias("job"), L("ok").alias("status"), L("all:20,10").alias("scope"), L("1998-01-01").cast("timestamp_ntz").alias("started_at")),
        F.struct(L("sweep").alias("job"), L("failed").alias("status"), L("all:20").alias("scope"), L("2003-01-01").cast("timestamp_ntz").alias("started_at")),
        F.struct(L("sweep").alias("job"), L("ok").alias("status"), L("all:20").alias("scope"), F.col("t").alias("started_at")))).alias("r")).select("r.*")
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("c")).agg(F.max("l_returnflag").alias("rf"), F.count("*").alias("n"))
    listed = g.select("c", F.when(F.col("rf") == "R", F.concat(L("C"), "n")).otherwise("").alias("room"), L("").alias("klass"),
                      F.create_map(L("2026"), F.when(F.col("rf") == "R", "○").otherwise("")).alias("apply"), L("list").alias("source_url"))
    rooms = o.where(k % 2 == 0).select(k.cast("string").alias("c"), F.concat(L("D"), k).alias("room"), L("lines").alias("source_url"))
    cat = CAT.build(structured, index, runs, listed=listed, rooms=rooms)
    return cat.select("c", "rm", "rmu", F.col("ap")["2026"].alias("ap"), "tm", "tg", F.size("i").alias("n_i"))
