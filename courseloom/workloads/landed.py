"""Landed files, side sources, half-year grids and lists of missing titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions import names as N
from courseloom.operators import joins as J
from courseloom.operators import resolve as R
from courseloom.plans import rooms as RM
from courseloom.plans import side as SD
from courseloom.session import new_folder
from courseloom.sources import pages as PG
from courseloom.workloads.outputs import rooms_job
from courseloom.workloads.registry import SQL, query, table

L = F.lit


def files(spark, rows):
    """A folder with a file for each ``name``, holding its ``value``."""
    path = new_folder(spark, "landed")
    rows.repartition("name").write.partitionBy("name").text(path)
    return path


def file_name():
    return F.regexp_extract("path", "name=([^/]*)/", 1)


@query("""WITH t AS (SELECT n_nationkey::VARCHAR AS page, n_nationkey % 3 AS k, '科目名称' || chr(10) || n_name || ' & 統計' || chr(10) || '更新日付' || chr(10) || '2026-03-' || lpad((n_nationkey % 28 + 1)::VARCHAR, 2, '0') || ' 10:00:00' AS a FROM nation),
b AS (SELECT page, CASE k WHEN 0 THEN a WHEN 1 THEN '授業科目名' || chr(10) || 'C' ELSE '' END AS body, CASE k WHEN 0 THEN 'A' WHEN 1 THEN 'C' END AS layout,
CASE k WHEN 0 THEN '2026-03-' || lpad((page::INT % 28 + 1)::VARCHAR, 2, '0') || ' 10:00:00' END AS updated_at FROM t)
SELECT page, body, layout, updated_at, sha256(body) AS body_sha256 FROM b""")
def landed_pages(spark, d):
    """Page files read as binary, their text cut to the body, its date and hash."""
    k = F.col("n_nationkey")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    a = F.concat(L("<html><script>x</script><p>before</p><div>科目名称</div>"), "n_name", L(" &amp; 統計<br>更新日付<br> 2026-03-"), day, L(" 10:00:00<p>合理的配慮について</p>after"))
    html = F.when(k % 3 == 0, a).when(k % 3 == 1, "<div>授業科目名</div><p>C</p><a>PAGE TOP</a>").otherwise("<p>another page</p>")
    path = files(spark, table(spark, d, "nation").select(html.alias("value"), k.alias("name")))
    pages = PG.read_pages(spark, path, pattern="*.txt").withColumn("page", file_name())
    return PG.raw_texts(pages, ["page"]).select("page", F.coalesce("body", L("")).alias("body"), "layout", "updated_at", F.sha2(F.coalesce("body", L("")), 256).alias("body_sha256"))


@query("SELECT n_nationkey::VARCHAR AS name, (octet_length(encode('%PDF-1.4 ' || n_name)) + 1)::BIGINT AS n FROM nation WHERE n_nationkey % 2 = 0")
def magic_files(spark, d):
    """Files whose content starts as a PDF does."""
    head = F.when(F.col("n_nationkey") % 2 == 0, "%PDF-1.4 ").otherwise(" %PDF ")
    path = files(spark, table(spark, d, "nation").select(F.concat(head, "n_name").alias("value"), F.col("n_nationkey").alias("name")))
    found = PG.only_magic(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path))
    return found.select(file_name().alias("name"), F.col("length").alias("n"))


@query("SELECT 'there' AS file, count(*) AS n_rows, 0 AS n_problems FROM supplier UNION ALL SELECT 'missing', 0, 1")
def side_files(spark, d):
    """A side file that is there, and one that is missing: no rows and a quality row."""
    path = new_folder(spark, "side")
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.json(path)
    out = None
    for name, place in (("there", path), ("missing", path + "-none")):
        rows, problems = PG.optional(spark, place, "s_suppkey bigint, s_name string", "suppliers", "land them")
        one = rows.agg(F.count("*").alias("n_rows")).join(problems.agg(F.count("*").cast("int").alias("n_problems"))).select(L(name).alias("file"), "n_rows", "n_problems")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT p_partkey::VARCHAR AS num, CASE WHEN p_size % 3 = 0 THEN (CASE WHEN p_size % 2 = 0 THEN '秋学期' ELSE '' END) || '火' || p_size % 6 || ' ' || (CASE WHEN p_size % 2 = 0 THEN '秋学期' ELSE '' END) || '木1' ELSE '月1' END AS slots,
CASE WHEN p_size % 3 = 0 AND p_size % 5 > 0 THEN 'A' || p_size WHEN p_size % 2 = 0 THEN 'B1' END AS room, CASE WHEN p_size % 3 < 2 THEN p_brand END AS dept FROM part""")
def side_grid(spark, d):
    """Slots and room of the grid win over those of the page; an empty one doesn't."""
    p, s = table(spark, d, "part"), F.col("p_size")
    kind = "array<struct<term:string,weekday:string,period:string>>"
    pages = p.select(F.col("p_partkey").cast("string").alias("num"), F.when(s % 2 == 0, "秋学期").alias("term"), F.when(s % 2 == 0, "B1").alias("room"),
                     F.array(F.struct(L("").alias("term"), L("月").alias("weekday"), L("1").alias("period"))).cast(kind).alias("slots"))
    two = F.array(F.struct(L("火").alias("weekday"), (s % 6).cast("string").alias("period")), F.struct(L("木").alias("weekday"), L("1").alias("period")))
    grid = p.where(s % 3 < 2).select(F.col("p_partkey").cast("string").alias("num"), F.when(s % 3 == 0, two).otherwise(F.array().cast("array<struct<weekday:string,period:string>>")).alias("slots"),
                                     F.when((s % 3 == 0) & (s % 5 > 0), F.concat(L("A"), s)).otherwise("").alias("room"), F.col("p_brand").alias("dept"))
    got = SD.with_grid(pages, grid)
    return got.select("num", F.array_join(F.transform("slots", lambda x: F.concat(x["term"], x["weekday"], x["period"])), " ").alias("slots"), "room", "dept")


@query("""WITH s AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN '前期' ELSE '後期' END AS term, c_mktsegment AS title, 'D-' || (c_nationkey + 100) AS room, ['月', '火', '水', '木', '金'][c_custkey % 5 + 1] || (c_custkey % 3 + 1) AS slot FROM customer)
SELECT term, title, room, string_agg(DISTINCT slot, ' ' ORDER BY slot) AS slots, '林' AS instructors, '2年' AS target_grade, '' AS category FROM s GROUP BY 1, 2, 3""")
def half_year_grid(spark, d):
    """Sessions of a wide grid whose first page is spring and whose second is autumn."""
    k = F.col("c_custkey")
    four = F.array(L("2年"), F.col("c_mktsegment"), F.concat(L("D-"), F.col("c_nationkey") + 100), L("（林）"))
    blank = lambda n: F.array_repeat(L(""), n)
    day = F.concat(F.element_at(F.array(*map(L, "月火水木金")), (k % 5 + 1).cast("int")), L("曜"))
    cells = F.concat(F.array(day, L("x")), blank((k % 3 * 5).cast("int")), four, blank((20 - k % 3 * 5).cast("int")))
    rows = table(spark, d, "customer").select((k % 2 + 1).cast("int").alias("page"), L(0).alias("table_no"), k.cast("int").alias("row_no"), cells.alias("cells"))
    small = table(spark, d, "region").select(L(1).alias("page"), L(1).alias("table_no"), F.col("r_regionkey").cast("int").alias("row_no"), F.array(L("月"), L("small")).alias("cells"))
    got = RM.sessions(rows.union(small))
    slots = F.array_join(F.array_sort(F.transform("slots", lambda s: F.concat(s["weekday"], s["period"]))), " ")
    return got.select("term", "title", "room", slots.alias("slots"), F.array_join("instructors", ",").alias("instructors"), "target_grade", "category")


@query("SELECT '法学部' AS faculty, count(*) AS n FROM (" + SQL["missing_titles"] + ") UNION ALL SELECT '" + RM.CODE_FACULTY + "', count(*) FROM (" + SQL["unknown_codes"] + ")")
def missing_by_faculty(spark, d):
    """How many titles and codes of each faculty's lines no course has."""
    return rooms_job(spark, d)[1]["missing_by_faculty"]


@query("SELECT '法学部' AS faculty, title, '' AS code FROM (" + SQL["missing_titles"] + ") UNION ALL SELECT '" + RM.CODE_FACULTY + "', '', code FROM (" + SQL["unknown_codes"] + ")")
def missing_list(spark, d):
    """Missing titles and codes, by faculty, title and code."""
    return rooms_job(spark, d)[1]["missing"].select("faculty", "title", F.coalesce("code", L("")).alias("code"))


@query("""WITH h AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'replace' AS mode, o_orderkey AS code FROM s UNION ALL SELECT 'ignore', o_orderkey FROM h UNION ALL SELECT 'add', o_orderkey FROM (SELECT * FROM h UNION SELECT * FROM s)""")
def shared_modes(spark, d):
    """A shared list replaces the held one, is ignored, or adds to it; unknown codes stay out."""
    o = table(spark, d, "orders")
    held = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("code"))
    shared = o.where("o_orderpriority = '1-URGENT'").select(F.explode(F.array(F.col("o_orderkey"), -F.col("o_orderkey") - 1, F.col("o_orderkey"))).alias("code"))
    every, out = o.select(F.col("o_orderkey").alias("code")), None
    for mode in ("replace", "ignore", "add"):
        one = J.import_codes(held, shared, every, "code", mode).select(L(mode).alias("mode"), "code")
        out = one if out is None else out.union(one)
    return out


@query("""WITH c AS (SELECT p_partkey::VARCHAR AS code, p_brand AS f, CASE WHEN p_partkey % 4 = 0 THEN 's' ELSE 'o' END AS kind, ['山田', '西', '高橋'][p_partkey % 3 + 1] AS fam FROM part),
s AS (SELECT f, fam, min(code) AS lo, max(code) AS hi FROM c WHERE kind = 's' GROUP BY 1, 2), o AS (SELECT f, fam, min(code) AS lo, max(code) AS hi FROM c WHERE kind = 'o' GROUP BY 1, 2),
r AS (SELECT o_orderkey AS line_no, p_brand AS f, ['山田', '西', '高橋', '誰か'][o_orderkey % 4 + 1] AS fam, o_orderkey % 3 AS k FROM orders JOIN part ON p_partkey = o_custkey)
SELECT line_no, CASE WHEN k = 0 AND s.lo IS NOT NULL THEN CASE WHEN s.lo = s.hi THEN s.lo END WHEN k = 1 AND o.lo = o.hi THEN o.lo END AS code
FROM r LEFT JOIN s ON s.f = r.f AND s.fam = r.fam LEFT JOIN o ON o.f = r.f AND o.fam = r.fam""")
def teacher_seminars(spark, d):
    """The only seminar of a line's teacher, else the only course with a like name."""
    pick = lambda items, at: F.element_at(F.array(*map(L, items)), (at % len(items) + 1).cast("int"))
    k = F.col("p_partkey")
    view = table(spark, d, "part").select(
        F.col("p_brand").alias("faculty"), L(R.ANY).alias("season_key"), k.cast("string").alias("code"),
        F.when(k % 4 == 0, N.match_key(L(V.SEMINAR_TITLE))).otherwise(F.concat(L("経営管理論"), k)).alias("name"), F.array(F.concat(pick(["山田", "西", "高橋"], k), L(" 太郎"))).alias("instructors"))
    o = F.col("o_orderkey")
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("o_custkey"), F.col("p_brand").alias("faculty"))
    title = F.when(o % 3 == 0, "経済学演習").when(o % 3 == 1, "経営管理の基礎").otherwise("別の科目名")
    rows = table(spark, d, "orders").join(brands, "o_custkey").select(
        "faculty", L(R.ANY).alias("season_key"), title.alias("title"), F.concat(title, L(" "), pick(["山田", "西", "高橋", "誰か"], o)).alias("seg"), L("f").alias("file"), o.alias("line_no"))
    return R.by_instructor(rows, view).select("line_no", F.col("by_teacher").alias("code"))
