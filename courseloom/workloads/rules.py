"""Field rules on texts that Spark writes from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from courseloom.functions import fields as FL
from courseloom.functions import grading as G
from courseloom.functions.text import exploded
from courseloom.operators.facets import fold_rare as fold
from courseloom.workloads.registry import query, table, wide

L = F.lit


@query(r"""WITH c AS (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN '=' WHEN 1 THEN ' @' WHEN 2 THEN chr(9) ELSE '' END
  || CASE WHEN c_acctbal < 0 THEN '-low' ELSE c_name END AS cell FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(cell, '^([\t\r\n]|\s*[=+\-@])') THEN '''' || cell ELSE cell END AS cell FROM c""")
def csv_guard(spark, d):
    lead = F.element_at(F.array(L("="), L(" @"), L("\t"), L(""), L("")), (F.col("c_nationkey") % 5 + 1).cast("int"))
    text = F.concat(lead, F.when(F.col("c_acctbal") < 0, "-low").otherwise(F.col("c_name")))
    return table(spark, d, "customer").select("c_custkey", FL.csv_cell(text).alias("cell"))


@query("""WITH c AS (SELECT *, c_custkey % 6 + 1 AS a, c_custkey // 6 % 6 + 1 AS b, CASE WHEN c_mktsegment = 'MACHINERY' THEN 6 ELSE 4 END AS cap FROM customer)
SELECT c_custkey, array_to_string(CASE c_nationkey % 6 WHEN 0 THEN [a] WHEN 1 THEN generate_series(a, CASE WHEN a > 4 THEN 6 ELSE cap END)
  WHEN 2 THEN [a] WHEN 3 THEN generate_series(least(a, b), greatest(a, b)) WHEN 4 THEN generate_series(1, cap)
  ELSE CASE WHEN a = b THEN [a] ELSE [least(a, b), greatest(a, b)] END END, ',') AS grades FROM c""")
def grades_of(spark, d):
    c = table(spark, d, "customer").withColumn("a", F.col("c_custkey") % 6 + 1).withColumn("b", F.floor(F.col("c_custkey") / 6) % 6 + 1)
    wide = F.translate(F.col("a").cast("string"), "123456", "１２３４５６")
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    n = F.col("c_nationkey") % 6
    text = (F.when(n == 0, F.concat("a", L("年生"))).when(n == 1, F.concat(wide, L("年生以上")))
            .when(n == 2, F.concat(L("2023年以前入学者 "), "a", L("年"))).when(n == 3, F.concat(L("学部"), lo, L("年（The year）～学部"), hi, L("年")))
            .when(n == 4, "全学年").otherwise(F.concat("a", L(","), "b", L("年"))))
    faculty = F.when(F.col("c_mktsegment") == "MACHINERY", "医学部医学科").otherwise("工学部")
    return c.select("c_custkey", F.array_join(FL.grades(text, faculty), ",").alias("grades"))


def order_slots():
    """Slot lines of an order: its own weekday and period, and a second or unplaced line."""
    day = F.element_at(F.array(*[L(x) for x in "月火水木金土日"]), F.weekday("o_orderdate") + 1)
    period = F.translate((F.col("o_orderkey") % 7 + 1).cast("string"), "1234567", "１２３４５６７")
    term = F.element_at(F.array(L("春学期"), L("夏学期"), L("後期"), L("通年")), F.quarter("o_orderdate"))
    second = F.when(F.col("o_orderpriority") == "5-LOW", "集中講義　夏").otherwise(F.concat(term, L("  水  "), F.month("o_orderdate") % 5 + 1))
    return F.concat(term, L(" "), day, L("曜日 "), period, L("時限\n\n"), second)


ORDER_SLOTS = """order_slots AS (
SELECT o_orderkey, 1 AS seq, ['春学期', '夏学期', '後期', '通年'][quarter(o_orderdate)] AS term, ['月', '火', '水', '木', '金', '土', '日'][isodow(o_orderdate)] AS weekday,
  (o_orderkey % 7 + 1)::VARCHAR AS period FROM orders
UNION ALL SELECT o_orderkey, 2, CASE WHEN o_orderpriority = '5-LOW' THEN '集中講義' ELSE ['春学期', '夏学期', '後期', '通年'][quarter(o_orderdate)] END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'その他' ELSE '水' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'その他' ELSE (month(o_orderdate) % 5 + 1)::VARCHAR END FROM orders)"""


@query("WITH " + ORDER_SLOTS + " SELECT o_orderkey, seq, term, weekday, period FROM order_slots")
def parse_slots(spark, d):
    rows = exploded(wide(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderpriority"), ["o_orderkey"], FL.slots(order_slots()), "s", "i")
    return rows.select("o_orderkey", (F.col("i") + 1).alias("seq"), "s.term", "s.weekday", "s.period")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 WHEN c_nationkey % 4 = 0 THEN 0
  WHEN c_nationkey % 4 = 1 THEN CASE WHEN c_custkey % 9 >= 5 THEN 0 ELSE 1 END WHEN c_mktsegment <> 'BUILDING' THEN 1 END AS is_undergrad FROM customer""")
def undergrad_flag(spark, d):
    """Three-valued: 1, 0, or NULL where nothing tells."""
    n = F.col("c_nationkey") % 4
    faculty = F.when(F.col("c_mktsegment") == "MACHINERY", "理学府").when(F.col("c_mktsegment") == "BUILDING", "").otherwise("理学部")
    grade = F.when(n == 0, "修士1年").otherwise("")
    number = F.when(n == 1, F.concat(L("KED-LCB"), F.col("c_custkey") % 9, L("124W"))).otherwise("none")
    return table(spark, d, "customer").select("c_custkey", FL.undergraduate(faculty, L(""), L(None).cast("string"), grade, number).alias("is_undergrad"))


PART_CATEGORY = """part_category AS (SELECT p_partkey, p_type, p_size, p_brand, CASE p_size % 6
  WHEN 0 THEN '専攻教育科目' WHEN 1 THEN '専攻教育科目' WHEN 2 THEN 'コース科目' || p_type
  WHEN 3 THEN CASE WHEN p_brand = 'Brand#1' THEN '選択必修科目' ELSE '（経済工学科）選択必修科目／自由' END WHEN 4 THEN 'サイバーセキュリティ科目' ELSE p_type || ' Core ' || p_brand END AS category FROM part)"""


@query("WITH " + PART_CATEGORY.replace("'コース科目' || p_type", "'コース科目'") + " SELECT p_partkey, category FROM part_category")
def normalize_category(spark, d):
    """Aliases, Latin endings cut off, alternatives of split faculties, merge table."""
    return part_categories(spark, d).select("p_partkey", "category")


def part_categories(spark, d):
    n = F.col("p_size") % 6
    raw = (F.when(n == 0, F.concat(L("専攻教育科目 "), "p_type")).when(n == 1, "専門教育科目").when(n == 2, F.concat(L("コース科目（"), "p_type", L("）")))
           .when(n == 3, "（経済工学科）選択必修科目／自由").when(n == 4, "Cybersecurity").otherwise(F.concat("p_type", L("  Core "), "p_brand")))
    faculty = F.when(F.col("p_brand") == "Brand#1", "経済学部").otherwise("工学部")
    return table(spark, d, "part").withColumn("category", FL.merge_category(FL.normalize_category(raw), faculty))


@query("WITH " + PART_CATEGORY.replace("'コース科目' || p_type", "'コース科目'") + """, r AS (SELECT category FROM part_category WHERE p_size > 25 GROUP BY 1 HAVING count(*) < 6)
SELECT p_partkey, CASE WHEN p_size > 25 AND category IN (SELECT category FROM r) THEN 'その他' ELSE category END AS category FROM part_category""")
def fold_rare(spark, d):
    """Categories with few counted rows take one common name."""
    return fold(part_categories(spark, d), "category", F.col("p_size") > 25).select("p_partkey", "category")


@query("""SELECT p_partkey, ['経経', '', 'Intro', ''][p_size % 4 + 1] AS suffix, CASE WHEN p_size % 4 = 0 THEN '経経' ELSE '' END AS department,
CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size + 0.5 END::DOUBLE AS credits FROM part""")
def title_fields(spark, d):
    end = F.element_at(F.array(L("（経経）"), L("(山下先生)"), L("（Intro） "), L("")), F.col("p_size") % 4 + 1)
    title = F.concat("p_name", end)
    credits = F.when(F.col("p_size") % 5 == 0, "未定").otherwise(F.concat(L("計 "), "p_size", L(".5単位")))
    return table(spark, d, "part").select("p_partkey", FL.title_suffix(title).alias("suffix"), FL.department(title).alias("department"), FL.credits(credits).alias("credits"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '電気情報工学科|' || CASE WHEN p_type = 'SMALL' THEN '機械電気コース' ELSE '土木コース' END
  WHEN 1 THEN '臨床薬学科' ELSE '' END AS departments FROM part""")
def departments_of(spark, d):
    n = F.col("p_size") % 3
    raw = (F.when(n == 0, F.concat(L("電気情報工学科（EC） / "), F.when(F.col("p_type") == "SMALL", "機械電気コース").otherwise("土木コース"), L(" 電気情報工学科")))
           .when(n == 1, "薬学部臨床薬学科 各コース").otherwise(F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", F.array_join(FL.departments(L("工学部"), raw), "|").alias("departments"))


TERMS = ["前", "春学期", "夏学期", "後期集中", "秋期", "冬学期", "通年", "??"]


@query("""SELECT o_orderkey, ['前期', '春学期', '夏学期', '後期', '秋学期', '冬学期', '通年・その他', '通年・その他'][o_orderkey % 8 + 1] AS term_group,
['spring', 'spring', 'spring', 'autumn', 'autumn', 'autumn', NULL, NULL][o_orderkey % 8 + 1] AS season, CASE WHEN month(o_orderdate) BETWEEN 4 AND 8 THEN 'spring' ELSE 'autumn' END AS shown FROM orders""")
def term_groups(spark, d):
    term = F.element_at(F.array(*map(L, TERMS)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", FL.term_group(term).alias("term_group"), FL.season(term).alias("season"),
                                            FL.current_season(F.col("o_orderdate")).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%HIGH%' THEN 1 ELSE 0 END AS is_online, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_intensive FROM orders""")
def text_flags(spark, d):
    from courseloom import values as V

    blob = F.concat_ws(" ", F.when(F.col("o_orderpriority") == "2-HIGH", "遠隔授業 Zoom"), F.when(F.col("o_orderstatus") == "F", "夏期集中").otherwise("夏期"))
    return table(spark, d, "orders").select("o_orderkey", FL.flag(blob, V.ONLINE_WORDS).alias("is_online"), FL.flag(blob, V.INTENSIVE_WORDS).alias("is_intensive"))


def grading_texts(spark, d):
    """A grading text per order; the priority picks its form, the key its weights."""
    o = wide(spark, d, "orders", "o_orderkey", "o_orderpriority").withColumn("a", ((F.col("o_orderkey") % 9 + 1) * 10).cast("int")).withColumn("b", 100 - F.col("a"))
    p = F.substring("o_orderpriority", 1, 1)
    text = (F.when(p == "1", F.concat(L("定期試験\n期末試験 "), "a", L("%\nレポート\n"), "b", L("%")))
            .when(p == "2", F.concat(L("小テスト\n復習課題（"), "a", L("%×2回）\n出席\n総授業回数の"), "b", L("%以上の出席が必要")))
            .when(p == "3", F.concat(L("レポート\n"), "a", L("\n発表\n"), "b", L("\n定期試験\n実施しない。")))
            .when(p == "4", F.concat(L("授業への貢献度\n合わせて"), "a", L("％\nレポート\n合わせて"), "a", L("％\n発表\n"), "b", L("％")))
            .otherwise(F.concat(L("注意\n\n作品\n"), "a", L("%か"), "b", L("%\nその他\nなし"))))
    return G.with_grading(o.select("o_orderkey", text.alias("raw")), "raw")


WEIGHTS = """w AS (SELECT o_orderkey, left(o_orderpriority, 1) AS p, ((o_orderkey % 9 + 1) * 10)::INT AS a, (100 - (o_orderkey % 9 + 1) * 10)::INT AS b FROM orders),
weights AS (
SELECT o_orderkey, 0 AS seq, '定期試験' AS method, a::DOUBLE AS pct, '期末試験' AS note, NULL::INT AS mark FROM w WHERE p = '1'
UNION ALL SELECT o_orderkey, 1, 'レポート', b, '', NULL FROM w WHERE p = '1'
UNION ALL SELECT o_orderkey, 0, '小テスト', 2 * a, '復習課題（' || a || '%×2回', NULL FROM w WHERE p = '2'
UNION ALL SELECT o_orderkey, 1, '出席', NULL, '総授業回数の' || b || '%以上の出席が必要', 1 FROM w WHERE p = '2'
UNION ALL SELECT o_orderkey, 0, 'レポート', a, '', NULL FROM w WHERE p = '3'
UNION ALL SELECT o_orderkey, 1, '発表', b, '', NULL FROM w WHERE p = '3'
UNION ALL SELECT o_orderkey, 0, 'レポート', a, '合わせて', NULL FROM w WHERE p = '4'
UNION ALL SELECT o_orderkey, 1, '発表', b, '', NULL FROM w WHERE p = '4'
UNION ALL SELECT o_orderkey, 2, '授業への貢献度', NULL, '合わせて', 2 FROM w WHERE p = '4'
UNION ALL SELECT o_orderkey, 0, '作品', NULL, a || '%か' || b || '%', NULL FROM w WHERE p = '5')"""


@query("WITH " + WEIGHTS + " SELECT * FROM weights")
def weight_rows(spark, d):
    rows = exploded(grading_texts(spark, d), ["o_orderkey"], F.col("gr"), "r", "seq")
    return rows.select("o_orderkey", "seq", "r.method", "r.pct", "r.note", "r.mark")


@query("""SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '2' THEN (o_orderkey % 9 + 1) * 20 WHEN '5' THEN NULL ELSE 100 END::DOUBLE AS total,
CASE left(o_orderpriority, 1) WHEN '3' THEN '定期試験' WHEN '5' THEN 'その他' ELSE '' END AS unused, CASE left(o_orderpriority, 1) WHEN '5' THEN '注意' ELSE '' END AS extra FROM orders""")
def weight_total(spark, d):
    return grading_texts(spark, d).select("o_orderkey", F.col("gt").alias("total"), F.array_join("gu", ",").alias("unused"), F.array_join("gx", ",").alias("extra"))


@query("""SELECT o_orderkey, (left(o_orderpriority, 1) = '1')::INT AS eval_exam, (left(o_orderpriority, 1) <> '2')::INT AS eval_report,
(left(o_orderpriority, 1) = '2')::INT AS eval_quiz, (left(o_orderpriority, 1) IN ('2', '4'))::INT AS eval_attend FROM orders""")
def eval_flags(spark, d):
    g = grading_texts(spark, d)
    return g.select("o_orderkey", *[c.alias(n) for n, c in G.eval_flags("raw", "gr", "gu").items()])


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS eval_exam, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS eval_report,
CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS eval_quiz FROM orders""")
def free_text_flags(spark, d):
    """Evaluation words in prose, clause by clause, without the negated clauses."""
    text = (F.when(F.col("o_orderstatus") == "F", "期末試験は実施しない。確認テストで評価する。レポートなし")
            .when(F.col("o_orderstatus") == "O", "筆記とレポート；小テストは行わない").otherwise("試験のみ"))
    none = F.array().cast(G.ROWS), F.array().cast("array<string>")
    o = table(spark, d, "orders").select("o_orderkey", text.alias("raw"), none[0].alias("gr"), none[1].alias("gu"))
    flags = G.eval_flags("raw", "gr", "gu")
    return o.select("o_orderkey", *[flags[n].alias(n) for n in ("eval_exam", "eval_report", "eval_quiz")])


@query("""SELECT doc_id, (list_reduce(list_transform(string_split(doc_id || lang || source, ''), lambda x: unicode(x)::BIGINT),
lambda h, x: (xor(h, x) * 16777619) & 4294967295, 2166136261::BIGINT) % 64)::INT AS shard FROM documents""")
def shard_of(spark, d):
    return table(spark, d, "documents").select("doc_id", FL.shard_of(F.concat("doc_id", "lang", "source")).alias("shard"))


@query("""SELECT doc_id, replace(replace(replace('{"id":' || doc_id || ',"t":"' || '<b>' || lang || '&' || source || '</b>"}', '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e') AS json FROM documents""")
def embeddable_payload(spark, d):
    t = F.concat(L("<b>"), "lang", L("&"), "source", L("</b>"))
    return table(spark, d, "documents").select("doc_id", FL.embeddable(F.to_json(F.struct(F.col("doc_id").alias("id"), t.alias("t")))).alias("json"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '○' WHEN 'O' THEN '○●※' ELSE '' END AS marks FROM orders""")
def marks_of(spark, d):
    cell = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "〇").otherwise("◯")).when(F.col("o_orderstatus") == "O", "※ ● ○").otherwise("－")
    return table(spark, d, "orders").select("o_orderkey", FL.marks(cell).alias("marks"))
