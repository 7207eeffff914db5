"""Whole plans on small fixtures: rooms, report, side pages, landed pages."""

from pyspark.sql import functions as F

from courseloom.operators import metrics as M
from courseloom.plans import catalog as CAT
from courseloom.plans import rooms as RM
from courseloom.plans import side as SD
from courseloom.sources import pages as PG
from tests.test_resolve import COURSE, LINE


def test_rooms(spark):
    courses = spark.createDataFrame([
        ("26111111", "民法演習", "法学部", ["津田 一"], None, []), ("26222222", "教育哲学概論", "教育学部", [], None, []),
        ("26342323", "土壌物理学", "農学部", [], None, []), ("26444444", "経済学演習", "経済学部", ["林 上"], None, [("月", "2")]),
        ("26444445", "経済学演習", "経済学部", ["森 下"], None, [("火", "2")])], COURSE)
    line = lambda f, file, n, s, x: (f, file, 0, n, s, x)
    lines = spark.createDataFrame([
        line("法学部", "law.pdf", 1, None, "◆民法演習 津田 D108"), line("法学部", "law.pdf", 2, None, "備考 一 二 三 四 五 六 七 八 九 十 十一"),
        line("法学部", "law.pdf", 3, "spring", "◆外交史演習 中島 演習室5"), line("教育学部", "edu.pdf", 1, None, "教育哲学概論【A104】田中 基幹【基幹教育】"),
        line("農学部", "agr.pdf", 1, "autumn", "26342323 土壌物理学 岩田 229 26999999 水理学"), line("共創学部", "k.pdf", 1, "autumn", "○共創基礎演習/Basic 月曜日/Mon")],
        LINE)
    sessions = spark.createDataFrame([
        (1, "経済学演習", "前期", "D-103", [("月", "2")], ["林"]), (2, "経済学演習", "前期", "D-104", [("水", "2")], []), (3, "経済学演習", "前期", "", [("月", "2")], [])],
        "row_id int, title string, term string, room string, slots array<struct<weekday:string,period:string>>, instructors array<string>")
    out = RM.build(lines, sessions, courses)
    assert {r.c: r.room for r in out["rooms"].collect()} == {
        "26111111": "D108", "26222222": "A104", "26342323": "229", "26444444": "D-103"}
    assert {r.faculty: (r.detected, r.resolved, r.dropped_ambiguous) for r in out["stats"].collect()} == {
        "法学部": (2, 1, 0), "教育学部": (1, 1, 0), "農学部": (1, 1, 0), "経済学部": (3, 1, 1), "共創学部": (1, 0, 0),
        "理学部": (0, 0, 0), "工学部": (0, 0, 0), "芸術工学部": (0, 0, 0), "基幹教育科目": (0, 0, 0)}
    assert [(r.faculty, r.title, r.code, r.season) for r in out["missing"].collect()] == [
        ("共創学部", "共創基礎演習", None, "autumn"), ("法学部", "外交史演習", None, "spring"), ("農学部", "", "26999999", "autumn")]


def test_rooms_of_several_files_and_sources(spark):
    courses = spark.createDataFrame([
        ("26000001", "教育方法論", "教育学部", [], None, []), ("26000002", "農業経済学", "経済学部", [], None, [("月", "1")]),
        ("26000003", "民法演習", "法学部", [], None, [])], COURSE)
    lines = spark.createDataFrame([
        # the full-year file is read first although its name sorts after that of the half-year
        ("教育学部", "edu-2030-a.pdf", 1, 1, "spring", "教育方法論【B205】山 基幹"), ("教育学部", "edu-2030.pdf", 0, 9, None, "教育方法論【A104】山 基幹"),
        ("農学部", "agr.pdf", 0, 1, None, "26000002 農業経済学 川 一 229"),
        ("教育学部", "edu-2030.pdf", 0, 10, None, "備考 一 二 三 四 五 六 七 八 九 十 十一"),
        ("教育学部", "edu-2030.pdf", 0, 11, "spring", "地域未来演習【A105】山 基幹"), ("法学部", "law.pdf", 0, 1, "autumn", "◆地域未来演習 中島 演習室5"),
        ("共創学部", "k.pdf", 0, 1, "autumn", "○地域未来演習/Basic 月曜日/Mon")], LINE)
    sessions = spark.createDataFrame([(1, "農業経済学", "前期", "D-108", [("月", "1")], [])],
                                     "row_id int, title string, term string, room string, slots array<struct<weekday:string,period:string>>, instructors array<string>")
    urls = spark.createDataFrame([("edu-2030.pdf", "page/edu"), ("econ.pdf", "page/econ"), ("econ.pdf", "page/econ")], "file string, source_url string")
    out = RM.build(lines, sessions, courses, urls, "econ.pdf")
    rooms = out["rooms"].collect()
    assert sorted((r.c, r.room, r.source_url) for r in rooms) == [("26000001", "A104", "page/edu"), ("26000002", "D-108", "page/econ")]
    assert [(r.title, r.faculty, r.season) for r in out["missing"].collect()] == [("地域未来演習", "教育学部", "")]
    assert [(r.faculty, r.n) for r in out["missing_by_faculty"].collect()] == [("教育学部", 1)]
    catalog = courses.select(F.col("code").alias("c"), F.lit(None).cast("string").alias("rm"), F.lit(None).cast("string").alias("rmu"))
    merged = CAT.merge_rooms(catalog, out["rooms"]).collect()
    assert sorted((r.c, r.rm, r.rmu) for r in merged) == [("26000001", "A104", "page/edu"), ("26000002", "D-108", "page/econ"), ("26000003", None, None)]


def test_report(spark):
    index = spark.createDataFrame([("a", ["20", "00"]), ("b", ["20"])], "course_code string, kaiko_cd array<string>")
    raw = spark.createDataFrame([("a", "A", "2026-03-01 10:00"), ("b", None, None)], "course_code string, layout string, updated_at string")
    cols = "course_code string, faculty string, is_undergrad int, eval_exam int, eval_report int, eval_quiz int, eval_attend int"
    st = spark.createDataFrame([("a", None, 1, 1, 0, 0, 0), ("b", "理学部", 1, 1, 1, 0, 0), ("c", "x", None, 0, 0, 0, 0)], cols)
    got = {(r.section, r.key): r.value for r in M.report(index, raw, st, index.limit(0)).collect()}
    assert got["totals", "index"] == 2 and got["totals", "summary"] == 0 and got["totals", "is_undergrad unknown"] == 1
    assert got["term codes", "20"] == 2 and got["term codes", "00"] == 1 and ("term codes", "23") not in got
    assert got["faculties", "(unknown)"] == 1 and got["layouts", "(unknown)"] == 1 and got["updated", "2026-03"] == 1
    assert got["evaluation", "eval_exam"] == 100 and got["evaluation", "eval_report"] == 50


def test_side_pages_with_grid(spark):
    course = spark.createDataFrame([("7", "秋学期", "B1", [("秋学期", "月", "1")]), ("8", None, None, [("", "月", "1")])],
                                   "num string, term string, room string, slots array<struct<term:string,weekday:string,period:string>>")
    grid = spark.createDataFrame([("7", [("火", "3"), ("火", "4")], "A9", "哲学"), ("9", [], "", "")],
                                 "num string, slots array<struct<weekday:string,period:string>>, room string, dept string")
    got = {r.num: ([tuple(s) for s in r.slots], r.room, r.dept) for r in SD.with_grid(course, grid).collect()}
    assert got["7"] == ([("秋学期", "火", "3"), ("秋学期", "火", "4")], "A9", "哲学")
    assert got["8"] == ([("", "月", "1")], None, None)


def test_empty_source_keeps_output(spark):
    kept = []
    assert SD.keep_if_empty(spark.range(0), kept.append) is False and kept == []
    assert SD.keep_if_empty(spark.range(1), kept.append) is True and len(kept) == 1


def test_landed_pages_to_bodies(spark):
    pages = spark.createDataFrame([("a", "<p>前書き</p><div>科目名称</div>統計<br>更新日付<br> 2026-03-01 10:00:00<p>合理的配慮について</p>x"), ("b", "<p>none</p>")], "k string, html string")
    raw = PG.raw_texts(pages, ["k"])
    got = {r.k: r for r in raw.collect()}
    assert got["a"].body == "科目名称\n統計\n更新日付\n2026-03-01 10:00:00" and got["a"].layout == "A" and got["a"].updated_at == "2026-03-01 10:00:00"
    assert [r.k for r in PG.quality_failures(raw, ["k"]).collect()] == ["b"]
    assert raw.where(F.sha2("body", 256) != F.col("body_sha256")).isEmpty()


def test_grid_sessions(spark):
    def row(day, *cells):
        out = [day, "x"] + [""] * 24
        for p, four in cells:
            out[2 + 5 * (p - 1):6 + 5 * (p - 1)] = four
        return out

    one = ["2年", "経済学 演習", "D-103", "（林）"]
    cells = spark.createDataFrame([
        (1, 0, 0, ["small"]), (1, 1, 0, row("", (1, ["1年", "before any day", "", ""]))), (1, 1, 1, row("月曜", (2, one))),
        (1, 1, 2, row("", (3, one), (1, ["【基】", "入門", "", ""]))), (2, 0, 0, row("火", (2, one)))],
        "page int, table_no int, row_no int, cells array<string>")
    got = {(r.term, r.title): r for r in RM.sessions(cells).collect()}
    assert set(got) == {("前期", "経済学 演習"), ("前期", "入門"), ("後期", "経済学 演習")}
    r = got["前期", "経済学 演習"]
    assert [tuple(s) for s in r.slots] == [("月", "2"), ("月", "3")] and r.instructors == ["林"] and r.target_grade == "2年"
    r = got["前期", "入門"]
    assert (r.category, r.target_grade, r.instructors, [tuple(s) for s in r.slots]) == ("専攻教育科目", "", [], [("月", "1")])


def test_extraction_has_no_method_too_long_to_be_compiled(spark):
    from courseloom.plans.extraction import structure_rows

    raw = spark.range(5).selectExpr("'u' AS university_id", "2026 AS year", "string(id) AS course_code", "'科目名称\\nx' AS body", "'A' AS layout", "'' AS body_sha256")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")        # a plain session's
    try:
        stages = structure_rows(raw.coalesce(1))._jdf.queryExecution().debug().codegenToSeq()
        longest = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    assert longest and max(longest) < 8000
