import random

import pytest
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions import names as N
from courseloom.operators import containment as CT
from courseloom.operators import resolve as R

COURSE = ("code string, title string, faculty string, instructors array<string>, season string, "
          "slots array<struct<weekday:string,period:string>>")
LINE = "faculty string, file string, file_ord int, line_no long, season string, line string"


def courses(spark, *rows):
    return spark.createDataFrame([(c, t, f, list(i), s, list(sl)) for c, t, f, i, s, sl in rows], COURSE)


def lines(spark, *rows, faculty="法学部"):
    return spark.createDataFrame([(faculty, "f.pdf", 0, i, s, x) for i, (s, x) in enumerate(rows)], LINE)


def law(spark, dictionary, *rows):
    found = R.match_mentions(R.mentions(lines(spark, *rows), V.ROOM_PATTERNS["law"]), dictionary)
    return {(r.line_no, r.pos): r for r in found.collect()}


@pytest.mark.parametrize("tail_only", [False, True])
def test_containment_against_brute_force(spark, tail_only):
    rnd = random.Random(7)
    word = lambda lo, hi: "".join(rnd.choice("abc政治") for _ in range(rnd.randint(lo, hi)))
    segs, names = sorted({word(0, 40) for _ in range(300)}), sorted({word(2, 7) for _ in range(80)})

    def best(seg):
        out, end = None, -1
        for n in names:
            at = seg.rfind(n)
            if len(n) < 4 or at < 0 or (tail_only and at + len(n) < len(seg) - 12):
                continue
            if at + len(n) > end or (at + len(n) == end and len(n) > len(out)):
                out, end = n, at + len(n)
        return out

    s = spark.createDataFrame([(x,) for x in segs], "seg string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {r.seg: r.name for r in CT.nearest_name(CT.occurrences(s, ["seg"], "seg", n, "name", (4,)), ["seg"], tail_only).collect()}
    assert got == {x: best(x) for x in segs if best(x)}


def test_known_names(spark):
    key = lambda rows: spark.createDataFrame([(x,) for x in rows], "t string").select(N.match_key("t").alias("t"))
    known = key(["学術英語・テーマベース", "Education and Politics Ⅰ", "デザイン学Ａ入門"])
    titles = ["学術英語・テーマベース", "Education and politic", "ローマ法Ⅰ", "ザイン学Ａ", "デザイ"]
    got = {r.title for r in CT.contains_known(key(titles), "t", known, "t").collect()}
    want = {r.t for r in key([titles[0], titles[1], titles[3]]).collect()}
    assert got == want
    politics = key(["政治学史Ⅰ"])
    assert CT.contains_known(key(["政治学"]), "t", politics, "t").isEmpty()


def test_name_next_to_the_room(spark):
    d = courses(spark, ("1", "情報構造論", "法学部", [], None, []), ("2", "機械学習", "法学部", [], None, []),
                ("3", "英語", "法学部", [], None, []), ("4", "比較政治学Ⅱ", "法学部", [], None, []), ("5", "政治学Ⅱ", "法学部", [], None, []))
    got = law(spark, d, (None, "情報構造論 稲永 俊介 W1 機械学習 畑埜 晃平 B112"), (None, "備考 一 二 三 四 五 六 七 八 九 十"), (None, "専門英語（分野） B113"),
              (None, "●比較政治学Ⅱ 出水 C112 政治学Ⅱ 出 D101"), (None, "   "), (None, "A104"))
    assert got[0, 0].code == "2" and got[2, 0].code is None
    assert (got[3, 0].code, got[3, 1].code) == ("4", "5")
    assert got[5, 0].code == "5"                # nothing before the room: the line before is searched at its end


def test_pages_only_match_their_season(spark):
    d = courses(spark, ("A", "民法演習", "法学部", [], "autumn", []))
    assert law(spark, d, ("spring", "◆民法演習 津田 D108 ３・４"))[0, 0].code is None
    r = law(spark, d, ("autumn", "◆民法演習 津田 D108 ３・４"))[0, 0]
    assert (r.code, r.room) == ("A", "D108")
    d = courses(spark, ("A", "国際政治学Ⅰ", "法学部", [], "autumn", []), ("B", "政治学Ⅰ", "法学部", [], "spring", []))
    got = law(spark, d, ("autumn", "●租税法 山田 E104 ３・４ ●国際政治学Ⅰ 椛島洋美 D106 ３・４"))
    assert (got[0, 0].code, got[0, 1].code, got[0, 1].room) == (None, "A", "D106")


def test_seminars_by_teacher(spark):
    d = courses(spark, ("S1", "演習Ⅰ", "法学部", ["上田 竹志"], None, []), ("S2", "演習Ⅰ", "法学部", ["西 英昭"], None, []),
                ("S3", "演習Ⅰ", "法学部", ["西村 友海"], None, []), ("L1", "民事訴訟法Ⅰ", "法学部", ["上田 竹志"], "spring", []))
    got = law(spark, d, (None, "◆民事訴訟法演習 上田 B112"), (None, "◆中国法演習 西 B113"), (None, "◆外交史演習 中島 B114"))
    assert [got[i, 0].code for i in range(3)] == ["S1", "S2", None]
    assert got[2, 0].title == "外交史演習"


def test_ambiguous_and_missing(spark):
    d = courses(spark, ("1", "民法演習", "法学部", [], None, []), ("2", "民法演習", "法学部", [], None, []),
                ("3", "学術英語・テーマベース", "基幹教育科目", [], None, []))
    found = R.match_mentions(R.mentions(lines(
        spark, (None, "◆民法演習 津田 D108"), (None, "備考 一 二 三 四 五 六 七 八 九 十"), ("spring", "◆外交史演習 中島 演習室5"), ("autumn", "外交史演習 中島 演習室6"),
        (None, "学術英語・テーマベース 林 A101"), (None, "補講枠の題目 林 A102")), V.ROOM_PATTERNS["law"]), d)
    stats = R.match_stats(found).first()
    assert (stats.detected, stats.resolved, stats.dropped_ambiguous) == (5, 0, 1)
    lost = found.where("code IS NULL AND NOT ambiguous")
    got = R.missing_titles(lost, R.dictionary(d).select("name")).collect()
    assert [(r.title, r.room, r.season) for r in got if "外交" in r.title] == [("外交史演習", "演習室5", "")]
    assert not [r for r in got if "英語" in r.title]


def test_codes_in_lines(spark):
    d = courses(spark, ("26342323", "土壌物理学", "農学部", [], None, []))
    ln = lines(spark, (None, "3 26342323 土壌物理学 岩田 幸良 229 田村 和彦 228 26342204 水理学Ⅰ"),
               (None, "3 26342323 まったく別の科目名 岩田 幸良 229"), (None, "26342323 岩田 幸良 230"), faculty="農学部")
    found = R.code_mentions(ln)
    got = {r.line_no: (r.room, r.verdict) for r in R.code_rooms(found, d).collect()}
    assert got == {0: ("229", "ok"), 1: ("229", "disagree"), 2: ("230", "ok")}
    assert [r.code for r in R.unknown_code_rows(found, d).collect()] == ["26342204"]


def test_only_mentions_whose_segment_has_no_name_are_read_further(spark, monkeypatch):
    steps, write = {}, R.written
    monkeypatch.setattr(R, "written", lambda df, name: steps.setdefault(name, write(df, name)))
    d = courses(spark, ("1", "情報構造論", "法学部", ["上田 竹志"], None, []), ("2", "機械学習", "法学部", [], "spring", []), ("3", "機械学習", "法学部", [], "spring", []))
    got = law(spark, d, (None, "情報構造学 上田 D102"), ("spring", "●情報構造論 上田 B112"), ("autumn", "機械学習 林 D101"), ("spring", "機械学習 林 C112"), (None, "機械学習"), (None, "E103"))
    assert {k: (r.code, r.ambiguous, r.title) for k, r in got.items()} == {
        (0, 0): ("1", False, "情報構造学"), (1, 0): ("1", False, ""), (2, 0): ("1", False, ""), (3, 0): (None, True, ""), (5, 0): (None, True, "")}
    assert steps["mentions"].count() == 5 and sorted(r.line_no for r in steps["unnamed"].collect()) == [0, 2, 5]


def test_mentions_with_the_same_place_or_none(spark):
    """Lines that come twice share their answer; a line of no file has none by name."""
    d = courses(spark, ("1", "情報構造論", "法学部", [], None, []), ("2", "機械学習", "法学部", [], None, []))
    twice = lines(spark, (None, "機械学習"), (None, "B112"), (None, "情報構造論 C112"))
    found = R.match_mentions(R.mentions(twice.union(twice).union(twice.withColumn("file", F.lit(None).cast("string"))), V.ROOM_PATTERNS["law"]), d)
    got = sorted((str(r.file), r.line_no, r.code) for r in found.collect())
    assert got == [("None", 1, None), ("None", 2, None), *[("f.pdf", 1, "2")] * 2, *[("f.pdf", 2, "1")] * 2]


def test_courses_of_faculties_without_such_lines_are_left_out(spark, monkeypatch):
    from courseloom.plans import rooms as RM

    asked = []
    monkeypatch.setattr(R, "match_mentions", lambda rows, courses: asked.append(courses) or rows)
    RM.marker_matches(lines(spark, (None, "情報構造論 B112")), courses(spark, ("1", "情報構造論", "法学部", [], None, []), ("2", "土壌物理学", "農学部", [], None, [])))
    assert [r.code for r in asked[0].collect()] == ["1"]


def test_a_tail_is_matched_once(spark, capsys):
    R.code_rooms(R.code_mentions(lines(spark, (None, "26342323 土壌物理学 229"), faculty="農学部")), courses(spark, ("26342323", "土壌物理学", "農学部", [], None, []))).explain("extended")
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count("号館") == 1


def test_a_line_is_matched_once(spark, capsys):
    ln = lines(spark, (None, "x 26342323 a 26342204 b"), (None, "none"), (None, ""), (None, "26342205"), (None, None))
    found = R.code_mentions(ln)
    assert sorted((r.line_no, r.pos, r.code, r.tail) for r in found.collect()) == [(0, 0, "26342323", " a "), (0, 1, "26342204", " b"), (3, 0, "26342205", "")]
    found.explain()
    assert capsys.readouterr().out.split("== Physical Plan ==")[1].count(V.CODE_IN_LINE) == 1


def test_left_out_letters_are_those_of_the_classes(spark):
    every = [chr(n) for n in (*range(1, 0xD800), *range(0xE000, 0x10000))]
    df = spark.createDataFrame([("".join(every[i:i + 64]),) for i in range(0, len(every), 64)], "t string")
    assert not df.where(F.translate("t", N.UNCOMPARED, "") != F.regexp_replace("t", f"(?U)[{V.NAME_SYMBOLS}{V.NAME_PUNCT}]+", "")).count()


def test_progressive_against_brute_force(spark):
    rnd = random.Random(3)
    slot = lambda: (rnd.choice("月火"), rnd.choice("12"))
    people = ["上田 竹志", "西 英昭", "西村 友海", "林 上"]
    cs = [(f"c{i:02d}", "演習", "経済学部", rnd.sample(people, rnd.randint(0, 2)), rnd.choice([None, "spring", "autumn"]),
           [slot() for _ in range(rnd.randint(0, 2))]) for i in range(9)] + [("z", "数学一", "経済学部", ["林 上"], None, [("月", "1")])]
    rs = [(i, rnd.choice(["演習", "演習", "数学一", "無い"]), rnd.choice([None, "spring", "autumn"]), [slot() for _ in range(rnd.randint(0, 2))],
           rnd.choice([[], [""], ["西"], ["上田"], ["高橋"], ["西村", "林"]])) for i in range(60)]

    def want(name, season, slots, fams):
        c = [x for x in cs if x[1] == name and (season is None or x[4] is None or x[4] == season)]
        if len(c) > 1:
            c = [x for x in c if set(slots) & set(x[5])] or c
        fams = [f for f in fams if f]
        if len(c) > 1 and fams:
            c = [x for x in c if any(f in "".join(x[3]) for f in fams)] or c
        return c[0][0] if len(c) == 1 else None, "one" if len(c) == 1 else "several" if c else "none"

    rows = spark.createDataFrame(rs, "row_id int, name string, season string, slots array<struct<weekday:string,period:string>>, surnames array<string>")
    got = {r.row_id: (r.code, r.outcome) for r in R.progressive(rows, R.dictionary(courses(spark, *cs))).collect()}
    assert got == {i: want(*x) for i, *x in rs}
    assert {o for _, o in got.values()} == {"one", "several", "none"}


def test_page_seasons(spark):
    df = spark.createDataFrame([
        ("x.pdf", 1, 1, "令和８年度授業時間割 前期"), ("x.pdf", 1, 2, "凡例"), ("x.pdf", 1, 3, "◇：前年度後期開始越年科目"),
        ("x.pdf", 2, 1, "時間 1 2 3"), ("design-a.pdf", 1, 1, "時間 1 2")], "file string, page int, page_line int, line string")
    got = {(r.file, r.page): r.season for r in R.page_seasons(df).collect()}
    assert got == {("x.pdf", 1): "spring", ("x.pdf", 2): None, ("design-a.pdf", 1): "autumn"}


def test_courses_of_one_small_file_go_to_all_cores(spark):
    from courseloom.workloads.resolution import courses

    found = courses(spark, "/root/testdata/sf0.01")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
