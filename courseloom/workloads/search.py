"""Search over an order catalog and a document catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseloom.functions import fields as FL
from courseloom.functions.text import exploded, search_key
from courseloom.operators import facets as FC
from courseloom.operators import joins as J
from courseloom.operators.paging import RankedPages
from courseloom.operators.textindex import TextIndex
from courseloom.session import new_folder
from courseloom.workloads.registry import query, table, wide
from courseloom.workloads.rules import ORDER_SLOTS, order_slots

L = F.lit


def order_catalog(spark, d):
    """Orders with their customers as catalog records: c, f, cat, cp, g, tm, tg, cr, sl, ap."""
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("f"))
    o = wide(spark, d, "orders").join(cust, "o_custkey").withColumn("sl", FL.slots(order_slots()))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("c"), "f", F.col("o_orderpriority").alias("cat"), F.when(k % 7 == 0, "＿").otherwise(F.col("o_orderstatus")).alias("cp"),
        F.sequence(L(1), (k % 4 + 1).cast("int")).alias("g"), F.get("sl", 0)["term"].alias("tm"), FL.term_group(F.get("sl", 0)["term"]).alias("tg"),
        (k % 5 / 2).alias("cr"), "sl", F.when(F.col("o_orderstatus") == "P", F.create_map(L("2026"), L("○"))).alias("ap"), "o_custkey")


ORDERS = """oc AS (SELECT o_orderkey AS c, c_mktsegment AS f, o_orderpriority AS cat, CASE WHEN o_orderkey % 7 = 0 THEN '＿' ELSE o_orderstatus END AS cp, o_orderkey % 4 + 1 AS gmax,
['春学期', '夏学期', '後期', '通年'][quarter(o_orderdate)] AS tm, ['春学期', '夏学期', '後期', '通年・その他'][quarter(o_orderdate)] AS tg, (o_orderkey % 5) / 2 AS cr, o_orderstatus, o_custkey
FROM orders JOIN customer ON c_custkey = o_custkey)"""


@query("WITH " + ORDERS + " SELECT c, f, cat, tg FROM oc WHERE f = 'MACHINERY' AND cp = 'O' AND gmax >= 3 AND tg IN ('春学期', '後期')")
def facet_filter(spark, d):
    """Facets combine with AND, term groups among themselves with OR, empty picks do nothing."""
    picked = FC.Facets(equal={"f": "MACHINERY", "cp": "O"}, member={"g": 3}, any_of={"tg": ["春学期", "後期"], "cat": []})
    return FC.search(order_catalog(spark, d), picked).select("c", "f", "cat", "tg")


def document_search(spark, d):
    docs = wide(spark, d, "documents", "doc_id", "text", "source")
    return docs.select("doc_id", search_key("text", "source").alias("search_text"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'the')")
def keyword_and(spark, d):
    """Every word of the query must occur; width and case do not matter."""
    return FC.search(document_search(spark, d), FC.Facets(text="Ｌｉｃｅｎｓｅ　THE")).select("doc_id")


ASKED = {"license": "Ｌｉｃｅｎｓｅ　THE", "rare": "license agreement", "one letter": "z", "two letters": "qu 99", "none": "no such wordzzz"}


@query("WITH q AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {[*FC.keyword_words(t)]})" for n, t in ASKED.items()) + """) AS v(asked, words))
SELECT asked, doc_id FROM q, documents WHERE len(list_filter(words, lambda w: NOT contains(lower(text) || ' ' || lower(source), w))) = 0""")
def keyword_index(spark, d):
    """Keyword queries, also of one and two letters, by an index of the folded texts built once."""
    index = TextIndex(spark, new_folder(spark, "texts"), "doc_id").build(document_search(spark, d))
    return reduce(DataFrame.union, [index.search(text).select(L(name).alias("asked"), "doc_id") for name, text in ASKED.items()])


@query("WITH " + ORDER_SLOTS + " SELECT DISTINCT o_orderkey AS c FROM order_slots WHERE weekday = '水' AND period = '2'")
def slot_filter(spark, d):
    return FC.search(order_catalog(spark, d), FC.Facets(slot=("水", "2"))).select("c")


@query("WITH " + ORDER_SLOTS + """ SELECT o_orderkey AS c, term, weekday, period, CASE term WHEN '通年' THEN '通年・その他' WHEN '集中講義' THEN '通年・その他' ELSE term END AS term_group
FROM order_slots WHERE term IN ('春学期', '後期')""")
def slot_terms(spark, d):
    """Each slot is kept by its own term's group."""
    return FC.slots_in_groups(order_catalog(spark, d), ["春学期", "後期"], "c")


@query("""SELECT l_orderkey AS c FROM lineitem GROUP BY 1 HAVING NOT bool_or(l_linenumber < 3)""")
def unplaced(spark, d):
    """Rows without a slot on a weekday in a one-digit period."""
    day = F.when(F.col("l_linenumber") < 3, "月").otherwise("その他")
    sl = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("c")).agg(F.collect_set(F.struct(
        L("前期").alias("term"), day.alias("weekday"), F.when(F.col("l_linenumber") < 3, "1").otherwise("10").alias("period"))).alias("sl"))
    return FC.search(sl, FC.Facets(unplaced=True)).select("c")


@query("WITH " + ORDERS + " SELECT c FROM oc WHERE o_orderstatus = 'P' AND f = 'FURNITURE'")
def with_application(spark, d):
    return FC.search(order_catalog(spark, d), FC.Facets(equal={"f": "FURNITURE"}, with_application=True)).select("c")


@query("WITH " + ORDERS + " SELECT c, f FROM oc WHERE c IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def chosen_codes(spark, d):
    codes = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("c"))
    return J.chosen(order_catalog(spark, d), codes, "c").select("c", "f")


@query("WITH " + ORDERS + """ SELECT 'faculty' AS facet, f AS value, CASE f WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 END::INT AS place FROM oc GROUP BY 2
UNION ALL SELECT 'campus', cp, NULL FROM oc WHERE cp NOT IN ('', '＿') GROUP BY 2""")
def facet_values(spark, d):
    return FC.facet_values(order_catalog(spark, d), "f", ["MACHINERY", "BUILDING", "NONE"], "cp")


@query("WITH " + ORDER_SLOTS + """ SELECT DISTINCT term, CASE term WHEN '通年' THEN '通年・その他' WHEN '集中講義' THEN '通年・その他' ELSE term END AS term_group FROM order_slots""")
def term_map(spark, d):
    return FC.term_map(order_catalog(spark, d))


@query("""SELECT DISTINCT ['春学期', '夏学期', '後期', '通年・その他'][quarter(o_orderdate)] AS term_group, [2, 3, 4, 7][quarter(o_orderdate)]::INT AS place,
['spring', 'spring', 'autumn', NULL][quarter(o_orderdate)] AS season FROM orders""")
def used_groups(spark, d):
    return FC.used_groups(order_catalog(spark, d))


@query("WITH " + ORDERS + """ SELECT c, f FROM oc ORDER BY CASE f WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, CASE WHEN f NOT IN ('MACHINERY', 'BUILDING') THEN f END, c LIMIT 300 OFFSET 300""")
def result_page(spark, d):
    """Second result page of 300 rows in rank order."""
    return FC.result_page(order_catalog(spark, d).select("c", "f"), "f", ["MACHINERY", "BUILDING"], "c", page=1)


@query("WITH " + ORDERS + """, r AS (SELECT c, f, row_number() OVER (ORDER BY CASE f WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END, CASE WHEN f NOT IN ('MACHINERY', 'BUILDING') THEN f END, c) - 1 AS n FROM oc)
SELECT n // 300 AS page, n % 300 AS place, c, f FROM r WHERE n // 300 IN (0, 1, 2, 4)""")
def seek_pages(spark, d):
    """The first pages, one after the other by the last row seen, and a later one by its number."""
    pages = RankedPages(spark, new_folder(spark, "ranked")).build(order_catalog(spark, d).select("c", "f"), "f", ["MACHINERY", "BUILDING"], "c")
    last, out = None, None
    for number in (0, 1, 2, 4):
        page = pages.page(number) if number == 4 else pages.after(last)
        rows = page.collect()                           # a page is 300 rows
        last = rows[-1]["_place"] if rows else last
        one = spark.createDataFrame([(number, k, r["c"], r["f"]) for k, r in enumerate(rows)], "page bigint, place bigint, c bigint, f string")
        out = one if out is None else out.union(one)
    return out


@query("WITH " + ORDER_SLOTS + """, p AS (SELECT DISTINCT o_orderkey, weekday, period FROM order_slots WHERE weekday <> 'その他')
SELECT period, """ + ", ".join(f"count(*) FILTER (weekday = '{w}') AS \"{w}\"" for w in "月火水木金土日") + " FROM p GROUP BY period")
def slot_grid(spark, d):
    """Courses per weekday and period."""
    return FC.full_grid(FC.grid_counts(FC.cells(order_catalog(spark, d), "c")))


@query("WITH " + ORDER_SLOTS + """, h AS (SELECT DISTINCT o_custkey, s.o_orderkey, weekday, period, unnest(CASE term WHEN '春学期' THEN ['spring1'] WHEN '夏学期' THEN ['spring2']
  WHEN '後期' THEN ['autumn1', 'autumn2'] ELSE ['spring1', 'spring2', 'autumn1', 'autumn2'] END) AS half FROM order_slots s JOIN orders o USING (o_orderkey) WHERE weekday <> 'その他')
SELECT o_custkey, weekday, period, left(half, -1) AS season, right(half, 1)::INT AS half, count(*) AS n_courses FROM h GROUP BY ALL HAVING count(*) >= 2""")
def slot_conflicts(spark, d):
    """Cells in which an owner's orders overlap, half-season by half-season."""
    cat = exploded(order_catalog(spark, d), ["o_custkey", "c"], F.filter("sl", FC.valid_slot), "s")
    rows = cat.select("o_custkey", "c", "s.weekday", "s.period", FL.term_group("s.term").alias("term_group"))
    return FC.conflicts(rows, ["o_custkey"], "c")


@query("WITH " + ORDERS + """ SELECT 'cat' AS facet, cat AS value, count(*) AS n FROM oc WHERE f = 'MACHINERY' AND cp = 'O' GROUP BY cat
UNION ALL SELECT 'f', f, count(*) FROM oc WHERE cat = '2-HIGH' AND cp = 'O' GROUP BY f
UNION ALL SELECT 'tg', tg, count(*) FROM oc WHERE f = 'MACHINERY' AND cat = '2-HIGH' AND cp = 'O' GROUP BY tg""")
def leave_one_out_facet(spark, d):
    """Counts of each facet under all filters but its own, in one scan."""
    picked = {"f": F.col("f") == "MACHINERY", "cat": F.col("cat") == "2-HIGH", "cp": F.col("cp") == "O"}
    return FC.leave_one_out(order_catalog(spark, d), picked, ["cat", "f", "tg"])


@query("WITH " + ORDERS + """ SELECT f, CASE tg WHEN '後期' THEN 'autumn' WHEN '通年・その他' THEN NULL ELSE 'spring' END AS season, sum(cr) AS credits, count(*) AS n_courses FROM oc GROUP BY 1, 2""")
def credit_totals(spark, d):
    cat = order_catalog(spark, d).withColumn("season", FL.season("tm"))
    return FC.credit_totals(cat, ["f", "season"], "cr")


@query("""SELECT o_custkey, string_agg(o_orderkey, '.' ORDER BY o_orderkey::VARCHAR) AS share FROM orders GROUP BY 1""")
def share_text(spark, d):
    """Codes of a list joined to a link text, one per owner."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("code"))
    return FC.share_text(o, ["o_custkey"], "code")


@query(r"""WITH w AS (SELECT doc_id, lang, regexp_split_to_array(text, '[ \n]') AS ws FROM documents),
e AS (SELECT doc_id, lang, unnest(ws) AS m, generate_subscripts(ws, 1) AS i FROM w),
u AS (SELECT doc_id, lang, m, min(i) AS i FROM e GROUP BY 1, 2, 3), k AS (SELECT lang, m FROM u GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT d.doc_id, string_agg(k.m, ' ' ORDER BY i) AS words FROM documents d LEFT JOIN u ON u.doc_id = d.doc_id LEFT JOIN k ON k.lang = u.lang AND k.m = u.m GROUP BY 1""")
def prune_rare_pairs(spark, d):
    """List members that fewer than 5 rows of the group carry are dropped; the lists are whole texts."""
    words = F.split(F.replace("text", L("\n"), L(" ")), " ")             # one letter is split without a pattern
    docs = wide(spark, d, "documents", "doc_id", "lang", "text").select("doc_id", "lang", F.array_distinct(words).alias("words"))
    return FC.prune_rare(docs, "doc_id", "lang", "words").select("doc_id", F.array_join("words", " ").alias("words"))


CATALOG = r"""dc AS (SELECT d.doc_id, d.lang, d.source, l.quality, CASE WHEN regexp_matches(lower(d.text), 'licen[sc]e') THEN 1 ELSE 0 END AS licensed
FROM documents d LEFT JOIN labels l USING (doc_id)),
rare AS (SELECT source FROM dc WHERE quality = 1 GROUP BY 1 HAVING count(*) < 16),
folded AS (SELECT lang, CASE WHEN quality = 1 AND source IN (SELECT source FROM rare) THEN 'その他' ELSE source END AS source, quality, licensed FROM dc)"""


@query("WITH " + CATALOG + """ SELECT lang, source, count(*) AS n, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 0) AS n_bad,
count(*) FILTER (quality IS NULL) AS n_unknown, sum(licensed)::BIGINT AS n_licensed FROM folded GROUP BY 1, 2""")
def document_catalog(spark, d):
    """Flagship: documents with their labels, rare sources folded, facet counts per language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", FL.flag(F.lower("text"), "licen[sc]e").alias("licensed"))
    docs = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    folded = FC.fold_rare(docs, "source", F.coalesce(F.col("quality") == 1, L(False)), least=16)
    return folded.groupBy("lang", "source").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("n_good"), F.count_if(F.col("quality") == 0).alias("n_bad"),
        F.count_if(F.col("quality").isNull()).alias("n_unknown"), F.sum("licensed").alias("n_licensed"))


@query("WITH " + ORDERS + """ SELECT c, CASE WHEN cr > 0 THEN 1 ELSE 0 END + CASE WHEN cat <> '5-LOW' THEN 1 ELSE 0 END AS n_stored,
CASE WHEN cat <> '5-LOW' THEN cat END AS rq FROM oc WHERE cr > 0 OR cat <> '5-LOW'""")
def default_elision(spark, d):
    """Detail values equal to their default are not stored; a record without any is left out."""
    from courseloom.sources.sinks import split_details

    cat = order_catalog(spark, d).select(
        "c", "f", F.when(F.col("cat") == "5-LOW", "").otherwise(F.col("cat")).alias("rq"), F.when(F.col("cr") > 0, F.col("cr")).alias("gt"),
        F.array(L(0), L(0)).alias("ev"), F.array().cast("array<string>").alias("gu"), L("").alias("d"))
    _, det = split_details(cat)
    return det.select("c", F.size(F.json_object_keys("detail")).alias("n_stored"), F.get_json_object("detail", "$.rq").alias("rq"))
