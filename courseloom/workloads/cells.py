"""Cell tables, wide grids and side-source pages, made by Spark from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courseloom.operators import metrics as M
from courseloom.plans import side as SD
from courseloom.sources import pages as P
from courseloom.workloads.registry import query, table, wide

L = F.lit
WANT = ["code", "price", "status", "mark"]


def cell_rows(spark, d):
    """A table per customer: order rows under headers whose columns stand in another order by
    customer; every fifth customer has no header, every third a second one halfway."""
    k = F.col("o_custkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("code"),
                                         F.floor("o_totalprice").cast("string").alias("price"), F.col("o_orderstatus").alias("status"))
    plain = F.array(F.concat(L(" "), "code", L("\n")), F.col("price"), F.col("status"))
    turned = F.array("status", "code", "price")
    second = (k % 3 == 0) & (F.col("o_orderkey") >= 7000)
    body = o.select("o_custkey", (F.col("o_orderkey") * 2 + 1).alias("row_no"), F.when((k % 2 == 0) != second, plain).otherwise(turned).alias("cells"))
    head = lambda flip: F.when((k % 2 == 0) != L(flip), F.array(L("code "), L("price"), L("status"))).otherwise(F.array(L("status"), L("code"), L("price")))
    cust = o.select("o_custkey").distinct()
    first = cust.where(k % 5 > 0).select("o_custkey", L(-1).cast("bigint").alias("row_no"), head(False).alias("cells"))
    again = cust.where((k % 5 > 0) & (k % 3 == 0)).select("o_custkey", L(14000).cast("bigint").alias("row_no"), head(True).alias("cells"))
    return body.union(first).union(again)


@query("""SELECT o_custkey, o_orderkey * 2 + 1 AS row_no, o_orderkey::VARCHAR AS code, floor(o_totalprice)::BIGINT::VARCHAR AS price, o_orderstatus AS status, '' AS mark FROM orders WHERE o_custkey % 5 > 0""")
def header_mapped_cells(spark, d):
    """Cells read by the names of the header above them."""
    return P.header_rows(cell_rows(spark, d), ["o_custkey"], wanted=WANT, needed=["code", "price"])


@query("""WITH o AS (SELECT o_orderkey // 50 AS page, o_orderkey AS k, '2' || lpad(o_orderkey::VARCHAR, 7, '0') AS full_code, 'T' || o_orderkey AS title,
  left(o_orderpriority, 1) AS room, o_orderstatus AS term FROM orders),
l AS (SELECT page, full_code, full_code || ' ' || CASE WHEN k % 8 = 4 THEN 'other' ELSE title END || ' ; ' || term || ' ' || room AS line FROM o),
f AS (SELECT o.k, min(l.full_code) AS code FROM o JOIN l ON l.page = o.page AND contains(l.line, o.title) AND contains(l.line, o.room) AND contains(l.line, o.term)
  WHERE o.k % 4 = 0 GROUP BY o.k HAVING min(l.full_code) = max(l.full_code))
SELECT page, full_code AS code, title, room, term FROM o WHERE k % 4 > 0 UNION ALL SELECT page, f.code, title, room, term FROM o JOIN f USING (k)""")
def recover_codes(spark, d):
    """Rows that lost their code take it from the page's text, when one line fits."""
    k = F.col("o_orderkey")
    o = wide(spark, d, "orders").select(F.floor(k / 50).alias("page"), k, F.concat(L("2"), F.lpad(k.cast("string"), 7, "0")).alias("full"),
                                         F.concat(L("T"), k).alias("title"), F.substring("o_orderpriority", 1, 1).alias("room"), F.col("o_orderstatus").alias("term"))
    rows = o.select("page", F.when(k % 4 == 0, "").otherwise(F.col("full")).alias("code"), "title", "room", "term")
    lines = o.select("page", F.concat("full", L(" "), F.when(k % 8 == 4, "other").otherwise(F.col("title")), L(" ; "), "term", L(" "), "room").alias("line"))
    return P.recover_codes(rows, lines, ["page"], "code", "title", "room", "term")


@query("""WITH r AS (SELECT c_nationkey AS page, c_custkey AS row_no, ['月', '火', '水'][c_custkey // 400 % 3 + 1] AS own, c_mktsegment, c_custkey, c_custkey % 100 = 0 AS starts FROM customer),
b AS (SELECT *, last_value(CASE WHEN starts THEN own END IGNORE NULLS) OVER (PARTITION BY page ORDER BY row_no) AS weekday FROM r),
p AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS period FROM b WHERE weekday IS NOT NULL)
SELECT page, row_no, weekday, period::INT AS period, (c_custkey % 4 + 1) || '年' AS grade, c_mktsegment || ' ' || period AS title, 'D-' || c_custkey AS room, '教員' AS instructor
FROM p WHERE (c_custkey + period) % 3 > 0""")
def wide_grid_unpivot(spark, d):
    """26-column rows to one row per weekday and period, the weekday carried down."""
    k = F.col("c_custkey")
    day = F.element_at(F.array(L("月曜"), L("火曜"), L("水曜")), (F.floor(k / 400) % 3 + 1).cast("int"))
    group = lambda p: [F.concat(k % 4 + 1, L("年")), F.when((k + p) % 3 > 0, F.concat("c_mktsegment", L("\n"), L(f" {p}"))).otherwise(" "),
                       F.concat(L("D-"), k), L("教員 "), L(None).cast("string")]
    cells = [F.when(k % 100 == 0, day).otherwise(""), L("x")] + [c for p in range(1, 6) for c in group(p)]
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("page"), k.alias("row_no"), F.array(*cells[:26]).alias("cells"))
    return P.wide_grid(rows, ["page"])


@query("""WITH n AS (SELECT l_suppkey, l_linenumber AS t, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, t) AS rn FROM n)
SELECT l.l_suppkey, l.l_linenumber AS table_no, count(*) AS n_rows, sum(l_orderkey)::BIGINT AS keys FROM lineitem l JOIN b ON b.l_suppkey = l.l_suppkey AND b.t = l.l_linenumber AND rn = 1 GROUP BY 1, 2""")
def largest_table(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("table_no"), "l_orderkey")
    return P.largest_table(li, ["l_suppkey"]).groupBy("l_suppkey", "table_no").agg(F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("keys"))


@query("""WITH e AS (SELECT l_suppkey, l_returnflag, l_linenumber AS slot, min(l_orderkey) AS o FROM lineitem GROUP BY 1, 2, 3)
SELECT l_suppkey, l_returnflag, string_agg(slot, ',' ORDER BY o, slot) AS slots, min(o) AS l_orderkey FROM e GROUP BY 1, 2""")
def merge_composite(spark, d):
    """Rows with the same composite key become one: distinct slots in order of sighting."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey", "l_linenumber")
    m = P.merge_sessions(li, ["l_suppkey", "l_returnflag"], F.col("l_linenumber"), ["l_orderkey"], [])
    return m.join(li.groupBy("l_suppkey", "l_returnflag").agg(F.min("l_orderkey").alias("l_orderkey")), ["l_suppkey", "l_returnflag"]).select(
        "l_suppkey", "l_returnflag", F.array_join(F.col("slots").cast("array<string>"), ",").alias("slots"), "l_orderkey")


def marked(spark, d):
    """Order lines as course-list rows: code, cohort, mark cell, room."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").agg(F.min("l_suppkey").alias("s"))
    cell = F.when(F.col("l_returnflag") == "A", "〇").when(F.col("l_returnflag") == "R", "※").otherwise("－")
    return li.select("l_orderkey", "l_linenumber", F.col("l_linestatus").alias("cohort"), cell.alias("cell"), "s",
                     F.when(F.col("l_linenumber") % 2 == 0, F.concat(L("D"), "s")).otherwise("").alias("room"))


MARKED = """marked AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus AS cohort, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2, 3, 4),
united AS (SELECT l_orderkey, cohort, CASE WHEN bool_or(l_returnflag = 'A') THEN '○' ELSE '' END || CASE WHEN bool_or(l_returnflag = 'R') THEN '※' ELSE '' END AS m FROM marked GROUP BY 1, 2)"""


@query("WITH " + MARKED + """, r AS (SELECT l_orderkey, min({'n': l_linenumber, 's': s, 'v': 'D' || s}).v AS room FROM marked WHERE l_linenumber % 2 = 0 GROUP BY 1)
SELECT u.l_orderkey, coalesce(max(r.room), '') AS room, max(m) FILTER (cohort = 'F') AS f_marks, max(m) FILTER (cohort = 'O') AS o_marks FROM united u LEFT JOIN r USING (l_orderkey) GROUP BY 1""")
def consolidate_marks(spark, d):
    """First non-empty room of a code, marks united per cohort."""
    c = P.consolidate(marked(spark, d), "l_orderkey", ["l_linenumber", "s"], {"room": "room"}, "cohort", F.col("cell"))
    return c.select("l_orderkey", "room", F.col("apply")["F"].alias("f_marks"), F.col("apply")["O"].alias("o_marks"))


@query("WITH " + MARKED + """ SELECT 'mark ' || mark AS what, count(*) AS n FROM (SELECT unnest(string_split(m, '')) AS mark FROM united) WHERE mark <> '' GROUP BY 1
UNION ALL SELECT 'in both', count(*) FILTER (n > 1) FROM (SELECT l_orderkey, count(*) AS n, max(length(m)) AS x FROM united GROUP BY 1) WHERE x > 0
UNION ALL SELECT 'differing', count(*) FROM (SELECT l_orderkey FROM united GROUP BY 1 HAVING count(*) > 1 AND max(length(m)) > 0 AND min(m) <> max(m))""")
def mark_totals(spark, d):
    c = P.consolidate(marked(spark, d), "l_orderkey", ["l_linenumber", "s"], {"room": "room"}, "cohort", F.col("cell"))
    rows = c.select("l_orderkey", F.explode("apply").alias("cohort", "marks"))
    letters, differ = M.mark_totals(rows, "l_orderkey", "cohort", "marks")
    two = differ.select(F.expr("stack(2, 'in both', in_both, 'differing', differing) AS (what, n)"))
    return letters.select(F.concat(L("mark "), "mark").alias("what"), "n").union(two)


@query("""SELECT ['月', '火', '水', '木', '金', '土', '日'][isodow(l_shipdate)] AS weekday, count(*) AS n FROM lineitem GROUP BY 1""")
def weekday_histogram(spark, d):
    from courseloom.operators.calendar import weekday_name

    return table(spark, d, "lineitem").groupBy(weekday_name(F.col("l_shipdate")).alias("weekday")).agg(F.count("*").alias("n"))


# ---- side-source pages ----------------------------------------------------------------
def grid_pages(spark, d):
    """A timetable page per customer with two courses in nested cells."""
    k = F.col("c_custkey")
    ctx = lambda dept, room: F.concat(L("<TR><TD rowspan=2>"), dept, L("</TD><TD>先生 "), "c_nationkey", L("</TD><TD>"), room, L("</TD></TR>"))
    link = lambda num, title: F.concat(L('<TR><TD colspan=2><b>秋学期</b><br><A HREF="x?num='), num, L('&each=1">'), title, L("</A></TD></TR>"))
    cell = lambda inner: F.concat(L("<TD BGCOLOR='#FFFFDD'><TABLE>"), inner, L("</TABLE></TD>"))
    room = F.when(k % 2 == 0, F.concat(L("A"), k % 90 + 100, L(" 教室"))).otherwise("")
    a = F.concat(ctx(F.col("c_mktsegment"), room), link(k * 2, F.concat(L("概論 "), "c_name")))
    b = F.concat(ctx(L("哲学"), L("E205")), link(k * 2 + 1, L("演習")), ctx(L(""), L("講義室")), link(k * 2, L("again")))
    row = lambda p, *cells: F.concat(L('<TR VALIGN="top"><TH valign="middle"> '), p, L("</TH>"), *[cell(c) for c in cells])
    return wide(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey").select(k.alias("page"), F.concat(
        L("<TABLE>"), row(k % 5 + 1, L(""), a), row(L("6"), b), L("</TABLE>")).alias("html"))


@query("""SELECT c_custkey AS page, (c_custkey * 2)::VARCHAR AS num, '火' AS weekday, (c_custkey % 5 + 1)::VARCHAR AS period, CASE WHEN c_custkey % 2 = 0 THEN 'A' || (c_custkey % 90 + 100) ELSE '' END AS room,
'先生 ' || c_nationkey AS instructor, c_mktsegment AS dept, '概論 ' || c_name AS title, '秋学期' AS term_label FROM customer
UNION ALL SELECT c_custkey, (c_custkey * 2 + 1)::VARCHAR, '月', '6', 'E205', '先生 ' || c_nationkey, '哲学', '演習', '秋学期' FROM customer
UNION ALL SELECT c_custkey, (c_custkey * 2)::VARCHAR, '月', '6', '', '先生 ' || c_nationkey, '哲学', 'again', '秋学期' FROM customer""")
def grid_scan(spark, d):
    """Links of a nested timetable grid with what the rows before them say."""
    return SD.grid_rows(grid_pages(spark, d), ["page"]).drop("block", "day", "at")


@query("""SELECT (c_custkey * 2)::VARCHAR AS num, '月6 火' || (c_custkey % 5 + 1) AS slots, CASE WHEN c_custkey % 2 = 0 THEN 'A' || (c_custkey % 90 + 100) ELSE '' END AS room, c_mktsegment AS dept, '概論 ' || c_name AS title FROM customer
UNION ALL SELECT (c_custkey * 2 + 1)::VARCHAR, '月6', 'E205', '哲学', '演習' FROM customer""")
def grid_courses(spark, d):
    """One row per course over all its grid cells."""
    g = SD.grid_courses(SD.grid_rows(grid_pages(spark, d), ["page"]), ["page", "block", "day", "at"])
    slots = F.array_join(F.transform("slots", lambda s: F.concat(s["weekday"], s["period"])), " ")
    return g.select("num", slots.alias("slots"), "room", "dept", "title")


def course_page_html(spark, d):
    k = F.col("o_orderkey")
    left = F.concat(L("<TD bgcolor='#EEFFBB'><SMALL>人文学科 文学コース<BR>専攻科目(単位数 "), k % 3 + 1, L(")<BR>選択必修科目<BR>対象学年: "), k % 3 + 2, L("年生以上</SMALL>"))
    right = F.concat(L("<TD align=\"right\" bgcolor='#EEFFBB'><SMALL>科目ナンバリングコード: LET-HUM"), k % 4 + 1, L("131J<br>2026 秋クォータ<br>毎週 月曜 "), k % 5 + 1,
                     L("限<br>伊都ゾーン 1号館 B"), k % 80 + 100, L("教室<br>J科目 (日本語)</SMALL>"))
    plan = F.concat(L("<B>授業計画</B><P><TABLE><TR><TD>n</TD><TD>進度・内容</TD></TR><TR><TD>1</TD><TD>導入 "), "o_orderpriority", L("</TD></TR><TR><TD>2</TD><TD>-</TD></TR><TR><TD>3</TD><TD>x</TD><TD>まとめ</TD></TR></TABLE>"))
    sections = F.concat(L('<DIV><TABLE><TR><TD align="center">授業の概要</TD><TD>概要 '), "o_orderstatus", L('</TD></TR><TR><TD align="center" x>成績評価</TD><TD>U_A-1 [x] 観点→成績評価方法↓ レポートで評価</TD></TR></TABLE></DIV>'))
    html = F.concat(L("<BIG><B>文学講義 "), k, L("</B></BIG><BR>\nLecture<BR>"), L("<TABLE bgcolor='#FFEEDD'><TR><TD align=\"right\">担当</TD> <TD>山田&nbsp;花子</TD></TR></TABLE>"), left, L("</TD>"), right,
                    L("</TD><B>キーワード</B> : 文学, 近代<BR>"), plan, sections)
    return wide(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").select(k.cast("string").alias("num"), html.alias("html"))


@query("""SELECT 'LIT' || o_orderkey AS c, '文学講義 ' || o_orderkey AS t, '文学部' AS f, CASE o_orderkey % 3 + 2 WHEN 2 THEN '2,3,4' WHEN 3 THEN '3,4' ELSE '4' END AS g, (o_orderkey % 3 + 1)::DOUBLE AS cr, '選択必修科目' AS rq,
'秋学期' AS tm, '専攻科目' AS cat, 'J科目 (日本語)' AS ln, '秋学期 月 ' || (o_orderkey % 5 + 1) AS sl, 'LET-HUM' || (o_orderkey % 4 + 1) || '131J' AS n, '1号館 B' || (o_orderkey % 80 + 100) AS rm, '文学, 近代' AS kw,
'概要 ' || o_orderstatus AS d, '導入 ' || o_orderpriority || '|まとめ' AS pl, 'レポートで評価' AS ep, 1 AS report FROM orders""")
def side_course_pages(spark, d):
    """Individual course pages of the side source as catalog records."""
    courses = SD.course_pages(course_page_html(spark, d)).withColumn("dept", L(""))
    r = SD.records(courses)
    sl = F.array_join(F.transform("sl", lambda s: F.concat_ws(" ", s["term"], s["weekday"], s["period"])), ",")
    return r.select("c", "t", "f", F.array_join(F.col("g").cast("array<string>"), ",").alias("g"), "cr", "rq", "tm", "cat", "ln", sl.alias("sl"), "n", "rm", "kw", "d",
                    F.array_join(F.transform("pl", lambda p: p["theme"]), "|").alias("pl"), "ep", F.get("ev", 1).alias("report"))
