"""Bodies to structured tables to catalog, sinks and report."""

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.operators import facets as FC
from courseloom.operators import snapshots as SN
from courseloom.plans import catalog as CAT
from courseloom.plans import extraction as X
from courseloom.sources import pages as PG
from courseloom.sources import sinks as SK

FIELDS = {"title": "地域調査法", "faculty_cat": "経済学部", "faculty": "学部3年", "target_grade": "3年～4年",
          "category": "（経済工学科）基礎演習科目／（経済・経営学科）応用科目", "credits": "1", "term": "夏学期", "slots": "夏学期 金曜日 ４時限",
          "outline": "町を歩いて資料を集め、地図と統計にまとめる方法を身につける。毎回、班ごとに記録を書く。",
          "grading": "レポート\n60%\n小テスト\n40%\n定期試験\n実施しない。\n出席\nなし。"}
OUTLINES = {"A": "授業科目の目的（日本語）", "B": "授業概要", "C": "授業概要"}


def body_of(layout="A", **changed):
    """A course page's text in one of the three layouts, label lines from the fixed values."""
    at, lines = list(V.LAYOUT_LABELS).index(layout), []
    for name, value in {**FIELDS, **changed}.items():
        label = OUTLINES[layout] if name == "outline" else V.FIELD_LABELS[name][at]
        lines += [label, value] if label else []
    return "\n".join(lines) + "\n"


BODY = body_of()
KEY = ["university_id", "year", "course_code"]


def raw(spark, *rows):
    df = spark.createDataFrame([("u", y, c, b, "A") for c, b, y in rows], "university_id string, year int, course_code string, body string, layout string")
    return df.withColumn("body_sha256", F.sha2("body", 256)).withColumn("updated_at", F.lit("2027-01-02 00:00"))


def index(spark, *codes, year=2027):
    return spark.createDataFrame([("u", year, c, ["10"], None) for c in codes],
                                 "university_id string, year int, course_code string, kaiko_cd array<string>, last_seen timestamp")


def no_runs(spark):
    return spark.createDataFrame([], "job string, status string, scope string, started_at timestamp")


def test_structured_row(spark):
    r = X.structure_rows(raw(spark, ("x", BODY, 2027))).first()
    assert r.category == "基礎演習科目" and "経済・経営学科" in r.category_raw
    assert [tuple(s) for s in r.sl] == [("夏学期", "金", "4")] and r.grades == [3, 4]
    assert [r.eval_exam, r.eval_report, r.eval_quiz, r.eval_attend] == [0, 1, 1, 0]
    assert (r.credits, r.is_undergrad, r.term_group, r.faculty, r.faculty_raw) == (1.0, 1, "夏学期", "経済学部", "学部3年")
    assert r.gt == 100.0 and r.gu == ["定期試験", "出席"] and r.d.startswith("町を歩いて")
    assert r.subtitle is None and r.plan is None and r.pl == []


@pytest.mark.parametrize("layout", list(V.LAYOUT_LABELS))
def test_all_layouts(spark, layout):
    df = raw(spark, ("x", body_of(layout, title="海の地形", term="冬学期", slots="冬学期 水曜日 １時限"), 2027)).withColumn("layout", F.lit(layout))
    r = X.structure_rows(df).first()
    assert (r.title, r.term_group, r.credits, r.target_grade) == ("海の地形", "冬学期", 1.0, "3年～4年")
    assert [tuple(s) for s in r.sl] == [("冬学期", "水", "1")] and r.d.startswith("町を歩いて")
    assert r.faculty == ("学部3年" if layout == "C" else "経済学部")


def test_layouts_with_two_line_labels(spark):
    two = [x for x in V.LAYOUT_LABELS["B"] if "\n" in x]
    body = "講義科目名\n古文書\n" + "".join(f"{x}\nよみ{i}\n" for i, x in enumerate(two)) + "授業科目名\nほか\n講義科目名\nあとの題"
    df = raw(spark, ("x", body, 2027)).withColumn("layout", F.lit("B"))
    r = X.structure_rows(df).first()
    assert r.title == "古文書"
    assert X.structure_rows(df.withColumn("layout", F.lit(None).cast("string"))).first().title is None


def test_rare_categories_fold(spark):
    rows = [(f"a{i}", BODY, 2027) for i in range(6)] + [(f"b{i}", body_of(category="珍しい科目"), 2027) for i in range(5)]
    got = {r.category: r["count"] for r in X.structure(raw(spark, *rows)).groupBy("category").count().collect()}
    assert got == {"基礎演習科目": 6, "その他": 5}


def test_rebuild_replaces_only_its_year(spark, tmp_path):
    path = str(tmp_path / "slots")
    for year in (2026, 2027, 2027):
        SK.write_year(X.slot_rows(X.structure_rows(raw(spark, ("x", BODY, year)))), path)
    assert spark.read.parquet(path).count() == 2
    assert PG.table_slice(spark, path, "u", 2026).count() == 1


def test_freshness_gate(spark):
    r = raw(spark, ("x", BODY, 2027))
    s = X.structure_rows(r)
    SN.assert_fresh(r, s)
    with pytest.raises(RuntimeError):
        SN.assert_fresh(r.withColumn("body_sha256", F.lit("new")), s)
    with pytest.raises(RuntimeError):
        SN.assert_fresh(raw(spark, ("x", BODY, 2027), ("y", BODY, 2027)), s)


def test_export(spark, tmp_path):
    r = raw(spark, ("T1", BODY, 2027), ("T2", body_of(title="=2*3"), 2027))
    s = X.structure_rows(r)
    sha = r.where("course_code = 'T2'").first().body_sha256
    summary = spark.createDataFrame([("u", 2027, "T1", "古い", "old"), ("u", 2027, "T2", "新しい", sha)],
                                    "university_id string, year int, course_code string, summary string, source_sha256 string")
    rows = CAT.export_rows(s, r, summary)
    got = {x.course_code: (x.slots, x.summary) for x in rows.collect()}
    assert got == {"T1": ("金4", None), "T2": ("金4", "新しい")}
    SK.write_csv(rows, str(tmp_path / "csv"))
    lines = [x for f in glob.glob(str(tmp_path / "csv" / "*.csv")) for x in csv.reader(open(f, encoding="utf-8-sig"))]
    assert ["T2", "'=2*3"] == next(x for x in lines if x[0] == "T2")[:2]
    SK.write_json(rows, str(tmp_path / "json"))
    js = [json.loads(x) for f in glob.glob(str(tmp_path / "json" / "*.json")) for x in open(f)]
    assert {x["course_code"]: x["title"] for x in js}["T2"] == "=2*3" and "summary" in js[0]
    SK.write_csv(rows.where("false"), str(tmp_path / "none"))
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(str(tmp_path / "none" / "*.csv")))
    assert text.startswith("﻿") and "course_code" in text and text.count("\n") == 1


def test_end_to_end(spark, tmp_path):
    attack = "</script ><b onclick='x & y'>&lt;"
    r = raw(spark, ("TEST001", body_of(title="地域調査法" + attack), 2027),
            ("X" + attack, body_of(term="後期", slots="後期 月曜日 ４時限"), 2027))
    cat = CAT.build(X.structure(r), index(spark, "TEST001", "X" + attack), no_runs(spark), undergrad_only=False).cache()
    meta = CAT.meta(cat, spark.createDataFrame([], "title string"), 2027, False).first()
    assert (meta.year, meta.undergrad_only, meta.n, meta.detail_shards) == (2027, False, 2, 64)
    assert meta.term_groups == ["夏学期", "後期"] and meta.faculties == ["経済学部"] and meta.campuses == []
    lists, det = SK.split_details(cat)
    assert not set(V.DETAIL_COLUMNS) & set(lists.columns)
    texts = [x.json for x in SK.payload(lists).collect()]
    assert not any("<" in t or ">" in t or "&" in t for t in texts)
    assert any(attack in json.loads(t)["t"] for t in texts)
    SK.write_shards(det, str(tmp_path / "details"))
    got = {x.c: (x.shard, json.loads(x.detail)) for x in spark.read.json(str(tmp_path / "details")).collect()}
    shard, detail = got["TEST001"]
    assert detail["grraw"] == "3年～4年" and 0 <= shard < 64 and "pl" not in detail and "rq" not in detail
    SK.write_document(lists, CAT.meta(cat, spark.createDataFrame([], "title string"), 2027, False), str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc" / "courses")).count() == 2


def test_scoped_staleness(spark):
    runs = spark.createDataFrame([
        (1, "sweep", "ok", "all:20", "2026-09-23 10:00:00"), (2, "sweep", "ok", "full:00,91", "2026-09-14 10:00:00"),
        (3, "sweep", "failed", "full:00", "2026-12-01 10:00:00"), (4, "detail", "ok", "x:00", "2026-12-01 10:00:00"),
        (5, "sweep", "ok", "no codes", "2026-12-01 10:00:00")],
        "run_id int, job string, status string, scope string, started_at string").withColumn("started_at", F.col("started_at").cast("timestamp"))
    idx = spark.createDataFrame([("a", ["00"], "2026-09-14 10:01:00"), ("b", ["20"], "2026-09-14 10:01:00"), ("c", ["20", "00"], "2026-09-14 10:01:00"),
                                 ("d", ["99"], "2020-01-01 00:00:00"), ("e", ["20"], None)], "k string, kaiko_cd array<string>, last_seen string")
    idx = idx.withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    kept = SN.not_stale(idx, SN.latest_sweeps(runs), ["k"])
    assert sorted(r.k for r in kept.collect()) == ["a", "c", "d", "e"]


def test_enrichment(spark):
    cat = CAT.build(X.structure_rows(raw(spark, *[(c, BODY, 2027) for c in "abc"])), index(spark, *"abc"), no_runs(spark),
                    listed=spark.createDataFrame([("a", "E101", "全学年", {"2026": "○", "2025": ""}, "list"), ("b", "", "", {"2026": ""}, "list")],
                                                 "c string, room string, klass string, apply map<string,string>, source_url string"),
                    rooms=spark.createDataFrame([("a", "D1", "pdf"), ("b", "D2", "pdf")], "c string, room string, source_url string"))
    got = {r.c: (r.rm, r.rmu, r.kl, r.ap, r.apu) for r in cat.collect()}
    assert got == {"a": ("E101", "list", "全学年", {"2026": "○"}, "list"), "b": ("D2", "pdf", None, None, None), "c": (None, None, None, None, None)}
    found = FC.search(cat, FC.Facets(text="地域　ＡＢ")).count(), FC.search(cat, FC.Facets(text="地域")).count()
    assert found == (0, 3)


def test_conflicts_between_half_seasons(spark):
    rows = spark.createDataFrame([("o", "1", "月", "2", "秋学期"), ("o", "2", "月", "2", "冬学期"), ("o", "3", "水", "2", "後期"),
                                  ("o", "4", "水", "2", "後期"), ("o", "5", "水", "2", "後期"), ("o", "5", "水", "2", "後期")],
                                 "owner string, c string, weekday string, period string, term_group string")
    got = FC.conflicts(rows, ["owner"], "c")
    assert {(r.weekday, r.half, r.n_courses) for r in got.collect()} == {("水", 1, 3), ("水", 2, 3)}
    assert FC.conflict_rows(rows, got, ["owner"], "c").select("c").distinct().count() == 3


def test_conflicts_unfold_half_seasons_last(spark):
    rows = spark.createDataFrame([("o", "1", "月", "2", None), ("o", "1", "月", "2", "春学期"), ("o", None, "月", "2", "夏学期"), (None, "2", "火", "1", "前期"), (None, "3", "火", "1", "夏学期")],
                                 "owner string, c string, weekday string, period string, term_group string")
    got = FC.conflicts(rows, ["owner"], "c")
    assert sorted((r.owner or "", r.season, r.half, r.n_courses) for r in got.collect()) == [("", "spring", 2, 2), ("o", "spring", 2, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")         # printed from the last step to the first


def test_optional_side_file(spark, tmp_path):
    df, problems = PG.optional(spark, str(tmp_path / "none.json"), "c string, room string", "rooms", "run it")
    assert df.isEmpty() and df.columns == ["c", "room"] and problems.first().problem == "missing: rooms"
    (tmp_path / "some.json").write_text('{"c":"1","room":"A"}\n')
    df, problems = PG.optional(spark, str(tmp_path / "some.json"), "c string, room string", "rooms")
    assert df.first().room == "A" and problems.isEmpty()


def test_course_list_cells(spark):
    head = V.CELL_COLUMNS
    row = lambda code, title, mark, room="2404", term="後期", note="": [code, "【総合】", title, term, "水", "4", "全学年", "伊都（センター）", room, mark, "大 太郎", note]
    cells = [("f", 1, 0, 0, ["x"]), ("f", 1, 0, 1, head), ("f", 1, 0, 2, row("26533362", "韓国語Ⅲ", "", note="※5/27は4限")),
             ("f", 1, 0, 3, row("", "教育学特論", "○", "1402", "前期")), ("f", 1, 0, 4, row("", "存在しない科目", "○")), ("f", 1, 0, 5, ["26000000"])]
    df = spark.createDataFrame(cells, "file string, page int, table_no int, row_no int, cells array<string>")
    lines = spark.createDataFrame([("f", 1, x) for x in (
        "26532071 【高年次】 社会包摂とデザインＢ 夏学期 火 1 その他 遠隔/512", "26532073 【高年次】 教育学特論 前期 火 1 伊都 1402 ○ 竹 尚夫",
        "26532080 【健スポ】 身体運動科学実習ⅡA 春学期 火 1")], "file string, page int, line string")
    rows = PG.header_rows(df, ["file", "page", "table_no"])
    full = PG.recover_codes(rows, lines, ["file", "page"], "講義コード", "科目名", "教室", "学期")
    got = {r["講義コード"]: r["事前申請"] for r in full.collect()}
    assert got == {"26533362": "", "26532073": "○", "26000000": ""}


def test_shift_jis_pages(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("<p>文学部　講義</p>".encode("cp932") + b"\xff")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "c.pdf").write_bytes(b"<html>")
    assert PG.read_pages(spark, str(tmp_path), "Shift_JIS").first().html.startswith("<p>文学部　講義</p>")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path))
    assert [r.path[-5:] for r in PG.only_magic(files).collect()] == ["b.pdf"]


def test_tasks_of_a_spread_table_do_not_grow(spark, monkeypatch):
    from courseloom import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    rows = spark.range(0, 3000, 1, 2)
    assert session.spread(rows).rdd.getNumPartitions() == 30 and session.spread(rows).count() == 3000
    assert session.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
