import random
from collections import Counter

import pytest

from courseloom.operators import facets as FC


def lists(n):
    rng = random.Random(5)
    out = [(i, rng.choice(["a", "b", None]), [rng.choice(["x", "y", "z", None, "", f"é{rng.randrange(60)}", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([0, 1, 3, 12]))])
           for i in range(n)]
    return [*out, (n, "a", None), (n + 1, "c", ["x"] * 4), (n + 2, "d", ["x", "q", "x", "q", "x", "q", "x", "x"]), (None, "a", ["x", "y"])]


def pruned(rows, least):
    n = Counter((g, m) for _, g, ms in rows for m in ms or [])
    keep = lambda g, ms: [m for m in ms or [] if g is not None and m is not None and n[g, m] >= least]
    return {(k, tuple(keep(g, ms)) or None) if k is not None else (None, None) for k, g, ms in rows}


@pytest.mark.parametrize("together", [1, 100, 4_000_000])
def test_rare_members_leave(spark, monkeypatch, together):
    monkeypatch.setattr(FC, "COUNTED_MEMBERS", together)
    rows = lists(400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        df = FC.prune_rare(spark.createDataFrame(rows, "k int, g string, ms array<string>").repartition(3), "k", "g", "ms", 5)
        got = df.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert df.columns == ["k", "g", "ms"] and len(got) == len(rows)
    assert {(r["k"], tuple(r["ms"]) if r["ms"] is not None else None) for r in got} == pruned(rows, 5)


def test_only_rare_places_are_rows(spark):
    df = spark.createDataFrame([(i, "a", ["often", f"own{i}"]) for i in range(50)], "k int, g string, ms array<string>")
    assert sorted(tuple(r) for r in FC.rare_spots(df, "k", "g", "ms", 5).collect()) == [(i, 1) for i in range(50)]


def test_no_rows(spark):
    assert FC.prune_rare(spark.createDataFrame([], "k int, g string, ms array<string>"), "k", "g", "ms").collect() == []
