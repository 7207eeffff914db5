import pytest
from pyspark.sql import functions as F

from courseloom.functions import grading as G
from courseloom.functions import plan as P
from courseloom.functions.text import text_or_empty


@pytest.fixture(scope="module")
def graded(spark):
    cases = {
        "attendance": "定期試験\nFinal exam 80%\n授業への貢献度\n20%\n出席\n80% attendance is expected",
        "least": "出席\nStudents must attend at least 60% of the classes.",
        "chars": "レポート\n期末レポート（1500字以上）を課す（50%）",
        "times": "小テスト\n復習課題を2回課す（25%×2回）。",
        "bare": "レポート\n60\n発表\n10\n授業への貢献度\n30",
        "zero": "定期試験\n100\n授業への貢献度\n0",
        "unused": "定期試験\nなし。\nレポート\n100%",
        "shared": "定期試験\n学期末試験と小テストと併せて60%\n小テスト\n学期末試験と小テストと併せて60%\n"
                  "レポート\nレポート、授業への貢献度を合わせて40%\n授業への貢献度\nレポート、授業への貢献度を合わせて40%",
        "no_note": "レポート\n50%\n発表\n50%",
        "free": "期末試験は実施しない。確認テストとレポートで評価する。",
        "extra": "注意事項\n\n 発表 \n発表：15％\nその他\nA 10% B 20%\n",
        "order": "レポート\n課題 70%\n定期試験\n30%",
        "cond_line": "出席\n総授業回数の\n80%以上の出席が必要。\n小テスト\n２０％",
        "none": None,
        "mix": "定期試験\n実施しない。\n小テスト\n30%\nレポート\n70%\n出席\nなし。",
    }
    df = spark.createDataFrame(list(cases.items()), "k string, raw string")
    df = G.with_grading(df, "raw")
    df = df.select("*", *[c.alias(n) for n, c in G.eval_flags("raw", "gr", "gu").items()])
    return {r.k: r for r in df.collect()}


def rows(r):
    return [tuple(x) for x in r.gr]


def test_conditions_are_not_weights(graded):
    r = graded["attendance"]
    assert rows(r) == [("定期試験", 80.0, "Final exam", None), ("授業への貢献度", 20.0, "", None),
                       ("出席", None, "80% attendance is expected", 1)]
    assert r.gt == 100.0
    assert rows(graded["least"])[0][1::2] == (None, 1)
    assert rows(graded["chars"])[0][1] == 50.0
    assert rows(graded["cond_line"])[0] == ("小テスト", 20.0, "", None)
    assert rows(graded["cond_line"])[1][1::2] == (None, 1)


def test_products_and_bare_numbers(graded):
    method, pct, note, mark = rows(graded["times"])[0]
    assert (pct, mark) == (50.0, None) and "25%" in note
    assert [x[1] for x in rows(graded["bare"])] == [60.0, 10.0, 30.0] and graded["bare"].gt == 100.0


def test_unused_extra_and_order(graded):
    assert graded["unused"].gu == ["定期試験"] and graded["unused"].gt == 100.0
    assert graded["extra"].gx == ["注意事項"]
    assert rows(graded["extra"]) == [("発表", 15.0, "", None), ("その他", None, "A 10% B 20%", None)]
    assert graded["extra"].gt is None
    assert [x[0] for x in rows(graded["order"])] == ["定期試験", "レポート"]
    assert rows(graded["none"]) == [] and graded["none"].gt is None


def test_shared_weights_count_once(graded):
    r = graded["shared"]
    assert r.gt == 100.0
    assert [x[0] for x in rows(r) if x[3] == 2] == ["小テスト", "授業への貢献度"]
    assert graded["no_note"].gt == 100.0


def test_flags(graded):
    f = lambda k: [graded[k][c] for c in ("eval_exam", "eval_report", "eval_quiz", "eval_attend")]
    assert f("mix") == [0, 1, 1, 0]
    assert f("free") == [0, 1, 1, 0]
    assert f("zero") == [1, 0, 0, 0]
    assert f("none") == [0, 0, 0, 0]


@pytest.fixture(scope="module")
def planned(spark):
    cases = [
        ("wrapped", "1\nオリエンテーション\n第1章 教師像を探る\nワーク「思い出の中の教師像」\n事前：考えをまとめる\n事後：第1章を読む\n"
                    "2\n導入期\n第2章 教師をめざす\n事前：第2章を読む", None),
        ("double", "1\n１\nガイダンス\n内容A\n2\n２\n第2回\n内容B", None),
        ("prose", None, "授業計画は予定であり、変更することがあります。"),
        ("from2", "2\nx\n3\ny", None),
        ("falls", "1\nx\n3\ny\n2\nz", None),
        ("last_empty", "1\nx\n2\n", None),
        ("second", "1\na", "１\nfirst\nfirst part\n2\nsecond"),
        ("tie", "1\na\n2\nb", "1\nc\n2\nd"),
    ]
    df = spark.createDataFrame(cases, "k string, a string, b string")
    return {r.k: [tuple(x) for x in r.pl] for r in P.with_plan(df, ["a", "b"]).collect()}


def test_plan_rows(planned):
    assert planned["wrapped"] == [(1, "オリエンテーション", "第1章 教師像を探る ワーク「思い出の中の教師像」"),
                                  (2, "導入期", "第2章 教師をめざす")]
    assert planned["double"] == [(1, "ガイダンス", "内容A"), (2, "第2回", "内容B")]
    assert planned["prose"] == planned["from2"] == planned["falls"] == []
    assert planned["last_empty"] == [(1, "x", None)]
    assert planned["second"] == [(1, "first", None), (2, "second", None)]
    assert planned["tie"] == [(1, "a", None), (2, "b", None)]


def test_outline(one):
    pick = lambda a, b: P.outline([text_or_empty(a), text_or_empty(b)])
    assert one(pick, "short", "long  enough\ntext, twenty letters") == "long enough text, twenty letters"
    assert one(pick, "x" * 1300, "") == "x" * 1200 + "…"
    assert one(pick, None, "short") == ""
