"""Queries that write a sink and read it back, and jobs whose parts meet."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions import plan as PL
from courseloom.operators import calendar as C
from courseloom.operators import resolve as R
from courseloom.operators.snapshots import StaleError
from courseloom.plans import catalog as CAT
from courseloom.plans import publish as PB
from courseloom.plans import rooms as RM
from courseloom.session import run_folder, written
from courseloom.sources import pages as PG
from courseloom.sources import sinks as SK
from courseloom.workloads import resolution as RS
from courseloom.workloads import schedule as SC
from courseloom.workloads.registry import query, table
from courseloom.workloads.search import order_catalog

L = F.lit


def fresh(spark, name):
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT o_orderkey::VARCHAR AS code, CASE WHEN o_orderkey % 3 = 0 THEN '''=' ELSE '' END || o_orderpriority AS label, o_totalprice::VARCHAR AS price FROM orders""")
def csv_read_back(spark, d):
    """Orders written as CSV, some with cells that look like formulas, and read again."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("code"), F.concat(F.when(k % 3 == 0, "=").otherwise(""), "o_orderpriority").alias("label"),
                                            F.col("o_totalprice").cast("string").alias("price"))
    path = fresh(spark, "csv")
    SK.write_csv(rows, path)
    back = spark.read.option("header", True).csv(path)
    return back.toDF("code", "label", "price")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def json_read_back(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    path = fresh(spark, "json")
    SK.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("""WITH s AS (SELECT doc_id, lang, (list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT),
lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) % 64)::INT AS shard FROM documents)
SELECT doc_id::VARCHAR AS c, shard, lang AS rq FROM s WHERE lang <> 'en'""")
def shards_read_back(spark, d):
    """Details in their shards; documents whose details are all default are in none."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("c"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("rq"))
    _, details = SK.split_details(rows)
    path = fresh(spark, "shards")
    SK.write_shards(details, path)
    back = spark.read.schema("c string, detail string, shard int").json(path)
    return back.select("c", "shard", F.get_json_object("detail", "$.rq").alias("rq"))


@query("""SELECT year(o_orderdate)::INT AS year, count(*) AS n, min(o_orderkey) AS first FROM orders WHERE NOT (year(o_orderdate) = 1995 AND o_orderkey % 2 = 0) GROUP BY 1""")
def rebuilt_year(spark, d):
    """All years written, then one of them again with half of its rows; the others stay."""
    rows = table(spark, d, "orders").select(L("u").alias("university_id"), F.year("o_orderdate").alias("year"), "o_orderkey")
    path = fresh(spark, "years")
    SK.write_year(rows, path)
    SK.write_year(rows.where("year = 1995 AND o_orderkey % 2 <> 0"), path)
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996""")
def keyed_slice(spark, d):
    """One key's year of a partitioned table."""
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("university_id"), F.year("o_orderdate").alias("year"), "o_orderkey")
    path = fresh(spark, "slices")
    SK.write_year(rows, path)
    return PG.table_slice(spark, path, "1-URGENT", 1996).select("o_orderkey")


@query("""SELECT p_partkey, greatest(p_size % 9, 0)::INT AS n, least(greatest(p_size % 9, 0), 5)::INT AS shown, CASE WHEN p_size % 9 > 0 THEN '第1回 ' || p_brand END AS first FROM part""")
def plan_head(spark, d):
    """The first five rows of a plan."""
    n = F.col("p_size") % 9
    rows = F.transform(F.when(n > 0, F.sequence(L(1), n)).otherwise(F.array().cast("array<int>")),
                       lambda i: F.struct(i.alias("no"), F.concat(L("第"), i, L("回 "), F.col("p_brand")).alias("theme")))
    p = table(spark, d, "part").select("p_partkey", rows.alias("pl"))
    head = PL.plan_head(F.col("pl"))
    return p.select("p_partkey", F.size("pl").alias("n"), F.size(head).alias("shown"), F.get(head, 0)["theme"].alias("first"))


ROOM_FORMS = {"bracket": ("【B{}】", "B{}"), "science": ("W1-C-{}", "W1-C-{}"), "law": ("C{}", "C{}"), "paren": ("（シス情{}）", "シス情{}")}


@query("WITH n AS (SELECT o_orderkey AS k, (o_orderkey % 800 + 100)::VARCHAR AS no FROM orders) " + " UNION ALL ".join(
    f"SELECT '{name}' AS family, k AS line_no, '{room.split('{}')[0]}' || no AS room FROM n" for name, (_, room) in ROOM_FORMS.items()))
def room_families(spark, d):
    """Rooms in each of the forms in which timetables mark them; blank and non-room markers are left out."""
    k = F.col("o_orderkey")
    out = None
    for name, (mark, _) in ROOM_FORMS.items():
        before, after = mark.split("{}")
        line = F.concat(L("科目 "), L(before), k % 800 + 100, L(after), L(" 教員"), L("【基幹教育】") if name == "bracket" else L(""))
        lines = table(spark, d, "orders").select(L("f").alias("faculty"), L(name).alias("file"), L(0).alias("file_ord"), k.alias("line_no"),
                                                 L(None).cast("string").alias("season"), line.alias("line"))
        found = R.mentions(lines, V.ROOM_PATTERNS[name]).select(L(name).alias("family"), "line_no", "room")
        out = found if out is None else out.union(found)
    return out


def rooms_job(spark, d):
    """Lines of three files of one faculty, code lines of another, no grid."""
    codes, known = RS.code_lines(spark, d)
    lines = RS.room_lines(spark, d).unionByName(codes.withColumn("faculty", L(RM.CODE_FACULTY)).select(
        "faculty", "file", "file_ord", "line_no", "season", "line"))
    more = known.select("code", "title", "line_no", L(RM.CODE_FACULTY).alias("faculty"), F.array().cast("array<string>").alias("instructors"),
                        L(None).cast("string").alias("season"), F.array().cast("array<struct<weekday:string,period:string>>").alias("slots"))
    courses = RS.courses(spark, d).drop("short").unionByName(more, allowMissingColumns=True)
    none = spark.createDataFrame([], "row_id int, title string, term string, room string, slots array<struct<weekday:string,period:string>>, instructors array<string>")
    urls = table(spark, d, "orders").select(F.col("o_orderstatus").alias("file"), F.concat(L("page/"), "o_orderstatus").alias("source_url")).distinct()
    return courses, RM.build(lines, none, courses, urls, code_scope=RS.OWN_CODES)


@query("WITH " + RS.MATCHED + """, r AS (SELECT code, arg_min(room, file || lpad(line_no::VARCHAR, 12, '0')) AS room, 'page/' || arg_min(file, file || lpad(line_no::VARCHAR, 12, '0')) AS url FROM matched WHERE code IS NOT NULL GROUP BY 1)
SELECT p_partkey::VARCHAR AS c, room AS rm, url AS rmu FROM part LEFT JOIN r ON r.code = p_partkey::VARCHAR
UNION ALL SELECT '2' || lpad(o_orderkey::VARCHAR, 7, '0'), CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 800 + 100)::VARCHAR END, CASE WHEN o_orderkey % 5 <> 0 THEN 'page/' || o_orderstatus END
FROM orders JOIN part ON p_partkey = o_custkey WHERE o_orderstatus <> 'P'""")
def rooms_in_catalog(spark, d):
    """Rooms of several files and sources merged into the catalog, one row a course as before."""
    courses, out = rooms_job(spark, d)
    empty = courses.select(F.col("code").alias("c"), L(None).cast("string").alias("rm"), L(None).cast("string").alias("rmu"))
    return CAT.merge_rooms(empty, out["rooms"])


def site_calendar(spark, d):
    same = spark.createDataFrame([(1995, "G"), (1995, "F"), (1970, "H")], "year int, faculty string")
    notes = spark.createDataFrame([(1995, "F", "own spans"), (1970, "H", "no calendar")], "year int, faculty string, note string")
    return C.site_calendar(SC.frames(spark, d), 1995, same, notes)


@query("WITH " + SC.DAYS + """ SELECT 'days' AS part, year, faculty, term, weekday, count(DISTINCT date)::INT AS n, strftime(min(date), '%Y-%m-%d') AS first, NULL::BOOLEAN AS differs, NULL AS note
FROM class_days WHERE weekday IS NOT NULL AND year = 1995 GROUP BY ALL
UNION ALL SELECT 'checked', year, f, NULL, NULL, NULL, NULL, f = 'F', CASE f WHEN 'F' THEN 'own spans' ELSE '' END FROM (SELECT DISTINCT year FROM class_days WHERE year = 1995), (SELECT unnest(['F', 'G']) AS f)
UNION ALL SELECT 'periods', 1995, NULL, NULL, p, NULL, t, NULL, NULL FROM (SELECT unnest(['""" + "', '".join(V.PERIOD_TIMES) + """']) AS p, unnest(['""" + "', '".join(a for a, _ in V.PERIOD_TIMES.values()) + """']) AS t)""")
def calendar_payload(spark, d):
    """Class days of each calendar of a year, the checked faculties, and when periods begin."""
    site = site_calendar(spark, d)
    none = lambda t: L(None).cast(t)
    days = site["days"].select(L("days").alias("part"), "year", "faculty", "term", "weekday", F.size("dates").alias("n"), F.get("dates", 0).cast("string").alias("first"),
                               none("boolean").alias("differs"), none("string").alias("note"))
    checked = site["checked"].select(L("checked"), "year", "faculty", none("string"), none("string"), none("int"), none("string"), "differs", "note")
    times = C.period_frame(spark).select(L("periods"), L(1995), none("string"), none("string"), "period", none("int"), "starts", none("boolean"), none("string"))
    return days.union(checked).union(times)


@query("""WITH s AS (SELECT unnest([1, 2, 3]) AS step), k AS (SELECT step, o_orderkey AS c FROM s, orders WHERE CASE WHEN step < 3 THEN o_orderkey % 2 = 0 ELSE o_orderkey % 3 = 0 END)
SELECT step, 'courses' AS part, count(*) AS n, sum(c)::BIGINT AS total FROM k GROUP BY 1 UNION ALL SELECT step, 'details', count(*), sum(c)::BIGINT FROM k WHERE c % 5 <> 0 GROUP BY 1
UNION ALL SELECT step, 'missing', count(*), sum(p_partkey)::BIGINT FROM s, part WHERE p_size < 9 GROUP BY 1
UNION ALL SELECT step, 'meta', (SELECT count(*) FROM k WHERE k.step = s.step), (SELECT count(*) FROM part WHERE p_size < 9) FROM s""")
def site_publication(spark, d):
    """What readers see after a publication, after one that a stale text stops, and after one without
    any missing title."""
    site = PB.Publication(spark, fresh(spark, "site"))
    k = F.col("c").cast("bigint")
    records = order_catalog(spark, d).withColumn("c", F.col("c").cast("string")).withColumn("d", F.when(k % 5 != 0, F.concat(L("about "), "f")).otherwise(""))
    records = written(records, "records")                # every gate and every part of a publication reads them
    raw = records.select("c", F.md5("c").alias("body_sha256"))
    derived = raw.select("c", F.col("body_sha256").alias("extracted_sha256"))
    stale = derived.withColumn("extracted_sha256", F.when(k % 100 == 1, "old").otherwise(F.col("extracted_sha256")))
    missing = table(spark, d, "part").where("p_size < 9").select("p_partkey", F.col("p_name").alias("title"))
    year = site_calendar(spark, d)

    def publish(catalog, structured, titles):
        PB.publish_site(site, catalog, raw, structured, titles, year, 1995, "https://example.org/{code}", key=["c"])

    def seen(step):
        doc = spark.read.schema("n bigint, n_missing bigint").json(site.folder("meta")).select(L("meta").alias("part"), F.col("n"), F.col("n_missing").alias("total"))
        parts = [spark.read.schema(f"{c} string").json(site.folder(p)).agg(F.count("*").alias("n"), F.sum(F.col(c).cast("bigint")).alias("total")).select(L(p).alias("part"), "n", "total")
                 for p, c in (("courses", "c"), ("details", "c"), ("missing", "p_partkey"))]
        return reduce(DataFrame.union, parts, doc).select(L(step).alias("step"), "part", "n", "total")

    publish(records.where(k % 2 == 0), derived, missing)
    out = seen(1)
    try:
        publish(records, stale, missing)
    except StaleError:
        out = out.union(seen(2))
    publish(records.where(k % 3 == 0), derived, missing.where("false"))
    return out.union(seen(3))
