"""Joins, aggregates and report figures."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from courseloom.operators import joins as J
from courseloom.operators import metrics as M
from courseloom.session import new_folder
from courseloom.sources import buckets as B
from courseloom.workloads.registry import query, table, wide

L = F.lit


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS sha FROM orders WHERE o_orderkey % 5 > 0), s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'old' ELSE o_orderstatus END AS sha FROM orders WHERE o_orderkey % 3 > 0)
SELECT 'all three' AS part, count(*) AS n, sum(k)::BIGINT AS total FROM orders JOIN r ON k = o_orderkey JOIN s USING (k) UNION ALL SELECT 'missing', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey NOT IN (SELECT k FROM r)
UNION ALL SELECT 'stale', count(*), sum(r.k)::BIGINT FROM r LEFT JOIN s ON s.k = r.k WHERE s.sha IS DISTINCT FROM r.sha""")
def stored_joins(spark, d):
    """Index, raw and structured rows stored in buckets of the key: joined, missing and stale ones."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    index = o.select(k.alias("course_code"))
    raw = o.where(k % 5 > 0).select(k.alias("course_code"), F.col("o_orderstatus").alias("body_sha256"))
    structured = o.where(k % 3 > 0).select(k.alias("course_code"), F.when(k % 7 == 0, "old").otherwise(F.col("o_orderstatus")).alias("extracted_sha256"))
    mark, key = uuid.uuid4().hex, ["course_code"]
    index, raw, structured = (B.store(df, f"{name}_{mark}", new_folder(spark, name), key, 16) for name, df in (("listed", index), ("raw", raw), ("structured", structured)))
    parts = {"all three": index.join(raw, key).join(structured, key), "missing": J.missing(index, raw, key),
             "stale": J.mismatched(raw, structured, "body_sha256", "extracted_sha256", key)}
    one = [df.agg(F.count("*").alias("n"), F.sum("course_code").alias("total")).select(L(name).alias("part"), "n", "total") for name, df in parts.items()]
    return one[0].union(one[1]).union(one[2])


@query("""SELECT o.o_orderkey, o.o_orderstatus, q.quantity, q.n_lines, r.n_returned FROM orders o
JOIN (SELECT l_orderkey, sum(l_quantity) AS quantity, count(*) AS n_lines FROM lineitem GROUP BY 1) q ON q.l_orderkey = o.o_orderkey
JOIN (SELECT l_orderkey, count(*) AS n_returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r ON r.l_orderkey = o.o_orderkey""")
def three_way_join(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    quantity = li.groupBy("o_orderkey").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n_lines"))
    returned = li.where("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.count("*").alias("n_returned"))
    return J.inner_all(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), quantity, returned, key=["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderkey")
def missing_work(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.missing(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"]).orderBy("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderkey LIMIT 40")
def limited_targets(spark, d):
    """The first 40 targets in order: a run that is asked for so many."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.targets(table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"], 40)


@query("""WITH s AS (SELECT l_orderkey, max(l_linestatus) AS h FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus AS raw_hash, s.h AS derived_hash FROM orders LEFT JOIN s ON l_orderkey = o_orderkey WHERE o_orderstatus IS DISTINCT FROM s.h""")
def freshness_mismatch(spark, d):
    derived = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("h"))
    return J.mismatched(table(spark, d, "orders"), derived, "o_orderstatus", "h", ["o_orderkey"])


@query("""SELECT d.doc_id, d.n_chars, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.quality = d.n_chars % 2""")
def guarded_lookup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", (F.col("n_chars") % 2).alias("h"))
    return J.guarded(docs, table(spark, d, "labels"), ["doc_id"], "h", "quality", "toxic", "toxic").select("doc_id", "n_chars", "toxic")


LINES = """lines AS (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS code, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1, 2)"""


def order_lines(spark, d):
    """Line numbers of each order, once each: the children that are nested."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min(F.concat("l_returnflag", "l_linestatus")).alias("code"), F.sum("l_quantity").cast("bigint").alias("quantity"))


@query("WITH " + LINES + " SELECT o_orderkey, coalesce(string_agg(code, ' ' ORDER BY l_linenumber), '') AS slots FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY 1")
def child_concat(spark, d):
    nested = J.nest(order_lines(spark, d), ["l_orderkey"], ["l_linenumber"], F.col("code")).withColumnRenamed("l_orderkey", "o_orderkey")
    rows = J.with_children(table(spark, d, "orders").select("o_orderkey"), nested, ["o_orderkey"], "items", "string")
    return rows.select("o_orderkey", F.array_join("items", " ").alias("slots"))


@query("WITH " + LINES + """ SELECT l_orderkey, count(*)::INT AS n_items, string_agg(l_linenumber || ':' || code || ':' || quantity, ',' ORDER BY l_linenumber) AS items
FROM lines GROUP BY 1""")
def nest_children(spark, d):
    item = F.concat_ws(":", "l_linenumber", "code", "quantity")
    n = J.nest(order_lines(spark, d), ["l_orderkey"], ["l_linenumber"], item)
    return n.select("l_orderkey", F.size("items").alias("n_items"), F.array_join("items", ",").alias("items"))


@query("""SELECT 'orders' AS key, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents
UNION ALL SELECT 'quality=1', count(*) FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 UNION ALL SELECT 'quality=0', count(*) FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0
UNION ALL SELECT 'quality unknown', count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL""")
def table_totals(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return M.totals({n: table(spark, d, n) for n in ("orders", "lineitem", "documents")}, (docs, "quality"))


@query("""WITH c AS (SELECT unnest(CASE WHEN o_orderstatus = left(o_orderpriority, 1) THEN [o_orderstatus] ELSE [o_orderstatus, left(o_orderpriority, 1)] END) AS code FROM orders)
SELECT code, CASE code WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN '1' THEN 'urgent' WHEN '5' THEN 'low' END AS label, count(*) AS n,
CASE code WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN '1' THEN 4 WHEN '5' THEN 5 END::INT AS place FROM c WHERE code IN ('F', 'O', '1', '5') GROUP BY 1""")
def list_member_counts(spark, d):
    o = table(spark, d, "orders").select(F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("codes"))
    return M.member_counts(o, "codes", {"F": "finished", "O": "open", "9": "never", "1": "urgent", "5": "low"})


@query("""SELECT coalesce(quality::VARCHAR, '(unknown)') AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def group_counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return M.group_counts(docs.withColumn("quality", F.col("quality").cast("string")), "quality")


@query("""SELECT 'quality' AS flag, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1) / greatest(count(*), 1) * 100 AS percent FROM labels
UNION ALL SELECT 'toxic', count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 1) / greatest(count(*), 1) * 100 FROM labels""")
def flag_rates(spark, d):
    return M.flag_rates(table(spark, d, "labels"), ["quality", "toxic"])


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def month_histogram(spark, d):
    return M.month_histogram(table(spark, d, "orders"), "o_orderdate")


def change_log(spark, d):
    """Events as a change log: signups stand for new keys."""
    kind = F.when(F.col("event_type") == "signup", "new").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(F.col("ts").alias("detected_at"), kind.alias("kind"))


SINCE = "2024-01-10 12:00:00"


@query(f"""SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'signup' THEN 'new' ELSE event_type END AS kind, count(*) AS n
FROM events WHERE ts >= TIMESTAMP '{SINCE}' GROUP BY 1, 2""")
def change_counts(spark, d):
    return M.change_counts(change_log(spark, d), L(SINCE).cast("timestamp_ntz")).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT count(*) AS n_updates FROM events WHERE ts >= TIMESTAMP '{SINCE}' AND event_type <> 'signup'")
def updates_total(spark, d):
    return M.updates_total(change_log(spark, d), L(SINCE).cast("timestamp_ntz"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'signup' THEN 'new' ELSE event_type END AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def change_trend(spark, d):
    """The streaming query over daily windows, run on the table."""
    from courseloom.streaming.snapshots import change_trend as trend

    log = change_log(spark, d).withColumn("detected_at", F.col("detected_at").cast("timestamp"))
    return trend(log).withColumn("day", F.col("day").cast("string"))


@query("""SELECT event_id AS run_id, event_type AS job, CASE WHEN user_id % 3 = 0 THEN 'failed' WHEN user_id % 3 = 1 THEN 'ok' ELSE 'interrupted or running' END AS status,
strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at, CASE WHEN user_id % 10 = 0 THEN '-' ELSE (user_id % 10)::VARCHAR END AS n_target, coalesce(CASE WHEN user_id % 4 > 0 THEN (user_id % 4)::VARCHAR END, '-') AS n_fetched,
(user_id % 2)::VARCHAR AS n_changed, CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id % 5 END AS n_error,
CASE WHEN floor(value) > 0 THEN floor(value)::BIGINT || '.00 GB' ELSE '-' END AS size, CASE WHEN event_type = 'error' THEN '-' ELSE event_type END AS note FROM events""")
def run_list(spark, d):
    u = F.col("user_id")
    runs = table(spark, d, "events").select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("job"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.when(u % 3 == 1, F.col("ts")).alias("ended_at"), F.when(u % 3 == 0, "failed").alias("status"), (u % 10).alias("n_target"), (u % 4).alias("n_fetched"),
        (u % 2).alias("n_changed"), F.when(u % 5 > 0, u % 5).alias("n_error"), (F.floor("value") * 1000000000).alias("bytes"),
        F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("note"))
    return M.run_list(runs)


@query("SELECT count(*) FILTER (coalesce(quality::VARCHAR, '') <> '') AS n_with, count(*) AS n_all FROM documents LEFT JOIN labels USING (doc_id)")
def coverage(spark, d):
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return M.coverage(docs.withColumn("quality", F.col("quality").cast("string")), "quality")


@query("""WITH x AS (SELECT o_orderkey AS k, nullif(o_orderstatus, 'P') AS layout, CASE WHEN o_orderkey % 7 > 0 THEN strftime(o_orderdate, '%Y-%m') END AS month,
nullif(o_orderpriority, '5-LOW') AS f, [1, 0, NULL][o_orderkey % 3 + 1] AS ug FROM orders)
SELECT 'totals' AS section, 'index' AS key, count(*)::DOUBLE AS value FROM customer UNION ALL SELECT 'totals', 'raw', count(*) FROM x UNION ALL SELECT 'totals', 'structured', count(*) FROM x
UNION ALL SELECT 'totals', 'summary', count(*) FROM part UNION ALL SELECT 'totals', 'is_undergrad=1', count(*) FILTER (ug = 1) FROM x UNION ALL SELECT 'totals', 'is_undergrad=0', count(*) FILTER (ug = 0) FROM x
UNION ALL SELECT 'totals', 'is_undergrad unknown', count(*) FILTER (ug IS NULL) FROM x
UNION ALL SELECT 'term codes', code, count(*) FROM (SELECT unnest(CASE WHEN c_custkey % 5 = 0 THEN ['20'] ELSE ['20', '00'] END) AS code FROM customer) GROUP BY 2
UNION ALL SELECT 'layouts', coalesce(layout, '(unknown)'), count(*) FROM x GROUP BY 2 UNION ALL SELECT 'updated', month, count(*) FROM x WHERE month IS NOT NULL GROUP BY 2
UNION ALL SELECT 'faculties', coalesce(f, '(unknown)'), count(*) FROM x WHERE ug = 1 GROUP BY 2
UNION ALL SELECT 'evaluation', 'eval_exam', count(*) FILTER (k % 2 = 1) / count(*) * 100 FROM x WHERE ug = 1 UNION ALL SELECT 'evaluation', 'eval_report', count(*) FILTER (k % 5 = 0) / count(*) * 100 FROM x WHERE ug = 1
UNION ALL SELECT 'evaluation', 'eval_quiz', 0 UNION ALL SELECT 'evaluation', 'eval_attend', 100""")
def metrics_report(spark, d):
    """The whole report over an index of customers and courses made from orders."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    index = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.array(L("20"), L("20"))).otherwise(F.array(L("20"), L("00"), L("no code"))).alias("kaiko_cd"))
    raw = o.select(F.nullif("o_orderstatus", L("P")).alias("layout"), F.when(k % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("updated_at"))
    structured = o.select(F.nullif("o_orderpriority", L("5-LOW")).alias("faculty"), F.when(k % 3 == 0, 1).when(k % 3 == 1, 0).alias("is_undergrad"),
                          (k % 2).alias("eval_exam"), (k % 5 == 0).cast("int").alias("eval_report"), L(0).alias("eval_quiz"), L(1).alias("eval_attend"))
    return M.report(index, raw, structured, table(spark, d, "part"))


@query("""SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority NULLS FIRST, o_orderkey""")
def export_order(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice").orderBy(F.asc_nulls_first("o_orderpriority"), "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY sha256('1:' || o_orderkey), o_orderkey LIMIT 12")
def spot_check(spark, d):
    """A seeded sample of 12 rows."""
    return M.sample_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 12, 1)


# ---- enrichment -----------------------------------------------------------------------
@query("""WITH s AS (SELECT l_orderkey, CASE WHEN max(l_returnflag) = 'N' THEN '' ELSE max(l_returnflag) END AS room FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(nullif(s.room, ''), o_orderstatus) AS room FROM orders LEFT JOIN s ON l_orderkey = o_orderkey""")
def override_enrich(spark, d):
    """A non-empty side value replaces the current one."""
    m = F.max("l_returnflag")
    side = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(m == "N", "").otherwise(m).alias("side_room"))
    main = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("room"))
    return J.override(main, side, ["o_orderkey"], {"room": "side_room"})


@query("""SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE n_name END AS room, CASE WHEN c_acctbal < 0 THEN 'nation' END AS source
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def fill_enrich(spark, d):
    """A side value is taken only where none is there."""
    main = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"),
                                              F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("room"), L(None).cast("string").alias("source"))
    side = table(spark, d, "nation").select("n_nationkey", "n_name", L("nation").alias("url"))
    return J.fill(main, side, ["n_nationkey"], "room", {"source": "url"}, "n_name").drop("n_nationkey")


@query("""SELECT o_custkey AS c, 'order' AS src, NULL AS segment FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
UNION ALL SELECT c_custkey, 'list', c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def append_absent(spark, d):
    main = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c")).distinct().withColumn("src", L("order"))
    side = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), L("list").alias("src"), F.col("c_mktsegment").alias("segment"))
    return J.append_absent(main, side, ["c"])


@query("""WITH p AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'), h AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT 'known' AS list, o_orderkey AS code FROM (SELECT o_orderkey FROM p UNION SELECT o_orderkey FROM h)""")
def shared_import(spark, d):
    """Held codes plus the known ones of a shared list; codes no order has stay out."""
    o = table(spark, d, "orders")
    held = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("code"))
    shared = o.where("o_orderpriority = '1-URGENT'").select(F.explode(F.array(F.col("o_orderkey"), -F.col("o_orderkey") - 1)).alias("code"))
    known = J.import_codes(held, shared, o.select(F.col("o_orderkey").alias("code")), "code", "add")
    return known.select(L("known").alias("list"), "code")


@query("SELECT -o_orderkey - 1 AS code FROM orders WHERE o_orderpriority = '1-URGENT'")
def shared_unknown(spark, d):
    o = table(spark, d, "orders")
    shared = o.where("o_orderpriority = '1-URGENT'").select(F.explode(F.array(F.col("o_orderkey"), -F.col("o_orderkey") - 1)).alias("code"))
    return J.unknown_codes(shared, o.select(F.col("o_orderkey").alias("code")), "code")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> o_orderpriority THEN o_orderstatus ELSE '' END AS s,
CASE WHEN o_orderkey % 3 = 0 THEN '専門教育科目' ELSE '' END AS catr, ['春学期', '夏学期', '後期', '通年'][quarter(o_orderdate)] AS tm FROM orders""")
def redundant_values(spark, d):
    """A subtitle equal to the title, and a raw category that only repeats the final one, are
    blanked; an empty term is taken from the first slot."""
    from courseloom.functions import fields as FL
    from courseloom.plans.catalog import shape
    from courseloom.workloads.rules import order_slots

    k, raw = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, "専門教育科目").otherwise("専攻教育科目 Major")
    o = wide(spark, d, "orders").withColumn("sl", FL.slots(order_slots()))
    term = F.when(k % 2 == 0, "").otherwise(F.concat(F.get("sl", 0)["term"], L(" ")))
    texts = ["faculty", "faculty_raw", "target_grade", "required", "campus", "language", "instructors", "keywords", "numbering", "gr", "gu", "gx", "gt", "ep", "pl", "d"]
    zeros = ["is_intensive", "is_online", "eval_exam", "eval_report", "eval_quiz", "eval_attend"]
    rows = o.select(k.alias("course_code"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("subtitle"), "sl", term.alias("term"),
                    FL.merge_category(FL.normalize_category(raw), L("")).alias("category"), raw.alias("category_raw"), L(2.0).alias("credits"), F.array(L(1)).alias("grades"),
                    *[L(None).cast("string").alias(c) for c in texts], *[L(0).alias(c) for c in zeros])
    return shape(rows).select(F.col("c").alias("o_orderkey"), "s", "catr", "tm")
