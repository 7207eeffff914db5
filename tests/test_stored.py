"""Catalogs stored in rank order or in buckets of their key."""

import random

import pytest

from courseloom.operators import joins as J
from courseloom.operators.paging import RankedPages
from courseloom.sources import buckets as B


@pytest.fixture(scope="module")
def ranked(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = [(f"c{i:04d}", rng.choice(["文", "理", "x", "y", "z", "", None])) for i in range(700)]
    order = ["理", "文"]
    key = lambda r: (r[1] not in order, order.index(r[1]) if r[1] in order else 0, "" if r[1] in order else r[1] or "", r[0])
    df = spark.createDataFrame(rows, "c string, f string").repartition(4)
    return sorted(rows, key=key), RankedPages(spark, str(tmp_path_factory.mktemp("ranked"))).build(df, "f", order, "c", files=9)


@pytest.mark.parametrize("size", [1, 7, 64, 300, 1000])
def test_pages_by_number(ranked, size):
    want, pages = ranked
    for number in (0, 1, 2, len(want) // size, len(want) // size + 1):
        got = [(r["c"], r["f"]) for r in pages.page(number, size).collect()]
        assert got == want[number * size:(number + 1) * size]


@pytest.mark.parametrize("size", [150, 300])
def test_pages_after_the_last_row(ranked, size):
    want, pages = ranked
    last, got = None, []
    while rows := pages.after(last, size).collect():
        got += [(r["c"], r["f"]) for r in rows]
        last = rows[-1]["_place"]
    assert got == want


def test_a_far_page_opens_no_more_files(ranked):
    want, pages = ranked
    last = next(r["_place"] for r in pages.page(0, 1000).collect() if r["c"] == want[599][0])
    opened = [len(pages.page(n, 50).inputFiles()) for n in (0, 5, 12)] + [len(pages.after(last, 50).inputFiles())]
    assert max(opened) <= 3 and [r["c"] for r in pages.after(last, 50).collect()] == [c for c, _ in want[600:650]]


def test_empty_catalog(spark, tmp_path):
    pages = RankedPages(spark, str(tmp_path)).build(spark.createDataFrame([], "c string, f string"), "f", ["x"], "c")
    assert pages.page(0).collect() == [] and pages.after(None).collect() == []


def test_joins_of_stored_tables_move_no_row(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(500).selectExpr("'u' AS university_id", "2026 AS year", "string(id) AS course_code", "string(id % 7) AS body_sha256")
        raw = B.store(df, "t_raw", str(tmp_path / "raw"), buckets=4)
        made = B.store(df.where("course_code % 3 > 0").withColumnRenamed("body_sha256", "extracted_sha256"), "t_structured", str(tmp_path / "structured"), buckets=4)
        index = B.store(df.select(*J.KEY), "t_index", str(tmp_path / "index"), buckets=4)
        for joined, n in ((J.mismatched(raw, made, "body_sha256", "extracted_sha256"), 167), (J.missing(index, made), 167),
                          (index.join(raw, J.KEY).join(made, J.KEY), 333)):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and joined.count() == n
        again = B.store(df.limit(3), "t_raw", str(tmp_path / "raw"), buckets=4)
        assert again.count() == 3 and len(list((tmp_path / "raw").glob("*.parquet"))) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("t_raw", "t_structured", "t_index"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
