"""Containment against brute force, with characters beyond the basic plane and short names."""

import random

import pytest

from courseloom.operators import containment
from courseloom.operators.containment import contains_known, nearest_name, occurrences
from courseloom.operators.joins import nest, nest_pages, with_children
from courseloom.operators.ordered import fill_down, previous_value, running_count
from courseloom.sources.pages import beginnings, optional, recover_codes
from pyspark.sql import functions as F

LETTERS = "ab\n😀𠮷野é"


def all_places(text, name):
    return [i for i in range(len(text) - len(name) + 1) if text[i:i + len(name)] == name]


@pytest.fixture(params=["automaton", "joins"])
def way(request, monkeypatch):
    """Both forms: a dictionary that is sent to all tasks, and one that is too large for that."""
    if request.param == "joins":
        monkeypatch.setattr(containment, "LETTERS", -1)
    monkeypatch.setattr(containment, "SENT_ROWS", 100)


@pytest.mark.parametrize("grams", [(1,), (2,), (1, 2, 4)])
def test_every_occurrence(spark, way, grams):
    rng = random.Random(3)
    texts = [(i, "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(90, None), (91, "")]
    names = sorted({"".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 6))) for _ in range(60)}) + ["", None]
    got = occurrences(spark.createDataFrame(texts, "k int, t string"), ["k"], "t",
                      spark.createDataFrame([(n,) for n in names], "name string"), "name", grams)
    want = {(k, n, i, i + len(n), len(t)) for k, t in texts if t for n in names if n and len(n) >= grams[0] for i in all_places(t, n)}
    assert len(want) > 100 and {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_names_after_emoji_and_short_names(spark, way):
    texts = spark.createDataFrame([(1, "😀 😀 hello world"), (2, "𠮷野 hello")], "k int, t string")
    names = spark.createDataFrame([("hello",), ("hello world",), ("野",)], "name string")
    found = occurrences(texts, ["k"], "t", names, "name", (1, 4))
    assert {(r["k"], r["name"]) for r in found.collect()} == {(1, "hello"), (1, "hello world"), (2, "hello"), (2, "野")}
    assert {(r["k"], r["name"], r["stop"]) for r in nearest_name(found, ["k"]).collect()} == {(1, "hello world", 15), (2, "hello", 8)}
    known = contains_known(spark.createDataFrame([("😀 hel",), ("x",), ("a",)], "t string"), "t",
                           spark.createDataFrame([("a",), ("y😀 hello",)], "n string"), "n", 4)
    assert {r["title"] for r in known.collect()} == {"😀 hel", "a"}


def test_no_names_and_no_texts(spark, way):
    texts, none = spark.createDataFrame([("k", "some text")], "k string, t string"), spark.createDataFrame([], "name string")
    assert occurrences(texts, ["k"], "t", none, "name").collect() == []
    assert occurrences(texts.where("false"), ["k"], "t", texts, "t").collect() == []


def test_a_small_dictionary_shuffles_no_text(spark):
    texts = spark.createDataFrame([(i, f"text {i} with names") for i in range(50)], "k int, t string")
    found = occurrences(texts, ["k"], "t", spark.createDataFrame([("names",), ("text",)], "name string"), "name")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 100


def test_a_parent_of_many_children_is_one_row(spark):
    children = spark.range(5000).select(F.lit(1).alias("p"), F.col("id").alias("no"))
    lists = nest(children, ["p"], ["no"], F.col("no"))
    rows = with_children(spark.createDataFrame([(1,), (2,)], "p int"), lists, ["p"], "items", "bigint").collect()
    assert {r["p"]: len(r["items"]) for r in rows} == {1: 5000, 2: 0}
    assert next(r["items"] for r in rows if r["p"] == 1) == list(range(5000))
    assert {r["page_no"]: len(r["items"]) for r in nest_pages(children, ["p"], ["no"], F.col("no"), 2048).collect()} == {0: 2048, 1: 2048, 2: 904}


@pytest.mark.parametrize("chunk", [2, 1000])
def test_null_keys_keep_their_rows(spark, chunk):
    rows = [(None, 0, "a"), (None, 1, None), (None, 5, None), ("x", 0, None), ("x", 3, "b"), ("x", 4, None), ("y", None, "c")]
    df = spark.createDataFrame(rows, "k string, p int, v string")
    got = {(r["k"], r["p"]): r["o"] for r in fill_down(df, ["k"], "p", F.col("v"), "o", chunk=chunk).collect()}
    assert got == {(None, 0): "a", (None, 1): "a", (None, 5): "a", ("x", 0): None, ("x", 3): "b", ("x", 4): "b", ("y", None): "c"}
    assert previous_value(df, ["k"], "p", F.col("v"), "o", chunk=chunk).count() == len(rows)
    n = {(r["k"], r["p"]): r["n"] for r in running_count(df, ["k"], "p", F.col("v").isNotNull(), "n", chunk=chunk).collect()}
    assert n[None, 5] == 1 and n["x", 4] == 1 and len(n) == len(rows)


def test_only_a_missing_file_is_missing(spark, tmp_path):
    data, warn = optional(spark, f"{tmp_path}/none.json", "a int", "side file", "get it")
    assert data.count() == 0 and warn.count() == 1
    (tmp_path / "there.json").write_text('{"a": 1}\n')
    data, warn = optional(spark, f"{tmp_path}/there.json", "a int", "side file")
    assert data.first()["a"] == 1 and warn.count() == 0
    with pytest.raises(Exception):
        optional(spark, "nostore://host/x.json", "a int", "side file")[0].count()


def test_codes_are_recovered_for_repeated_rows(spark):
    lines = spark.createDataFrame([("p", "26051101 数学 A12 前期"), ("p", "26051102 英語会話 B3 前期"), ("p", "26051103 英語会話 B4 前期")], "page string, line string")
    rows = spark.createDataFrame([("p", "", "数学", "A12", "前期"), ("p", "", "数学", "A12", "前期"), ("p", "", "英語会話", "", "前期"),
                                  ("p", "", "英語会話", "B4", "前期")], "page string, code string, title string, room string, term string")
    got = recover_codes(rows, lines, ["page"], "code", "title", "room", "term").collect()
    assert sorted((r["code"], r["room"]) for r in got) in ([("26051101", "A12"), ("26051101", "A12"), ("26051103", "B4")],)


def test_a_line_sends_on_only_what_titles_of_its_page_begin_with(spark):
    lines = spark.createDataFrame([(p, f"2605110{p} " + "".join(chr(0x4E00 + i) for i in range(300)), f"2605110{p}") for p in range(3)], "page int, line string, _code string")
    wanted = spark.createDataFrame([(0, "\u4e05\u4e06"), (0, "\u4e10" + "x" * 7), (1, "absent")], "page int, _head string")
    got = beginnings(lines, wanted, ["page"]).collect()
    assert (0, "\u4e05\u4e06") in {(r["page"], r["_head"]) for r in got}
    assert len(got) < 12                                # of some 900 pieces; a page without a lost title has none
    assert not any(r["page"] == 2 for r in got)
