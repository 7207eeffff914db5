import random
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from courseloom.llm.lines import half, repeated_lines, without_repeats


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows):
    """(doc_id, pos, distance, earlier_doc_id, earlier_pos) with ids that are unique and not null."""
    lines = [(i, p, x.strip(" \t\r")) for i, t in sorted(rows) for p, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    first = {}
    for i, p, x in lines:
        first.setdefault(x, (i, p))
    found = [(i, p, 0, *first[x]) for i, p, x in lines if first[x] != (i, p)]
    order = sorted(first, key=first.get)
    for n, x in enumerate(order):
        near = [y for y in order[:n] if abs(len(x) - len(y)) < 2 and edit_distance(x, y) == 1]
        if near:
            found.append((*first[x], 1, *first[near[0]]))
    return Counter(found)


def edited(rng, line):
    k = rng.randrange(len(line) + 1)
    c = rng.choice("aé日😀 x")
    return rng.choice([line[:k] + line[k + 1:], line[:k] + c + line[k:], line[:k] + c + line[k + 1:]])


@pytest.fixture
def rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé日😀") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(rng.choice([1, 4, 6, 8, 30, 90]))) for _ in range(60)]
    base += ["x" * n for n in (15, 16, 17, 18, 31, 32, 33, 48, 49)] + ["", " \t", "\r", "a", "b", "ab", "é", "日本", "aé日", "total: 12345"]
    for n in (2, 3, 4, 5, 6, 8, 9, 12, 13, 16, 17, 32, 33, 48, 49, 64, 65, 80, 81):
        base.append("".join(rng.choice("abcdefgh") for _ in range(n)))
    out = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line = edited(rng, line)
            lines.append(rng.choice(["", " ", "\t"]) + line + rng.choice(["", "\r", " "]))
        out.append((i, "\n".join(lines)))
    return out


def test_repeated_lines(rows, docs):
    got = Counter((r["doc_id"], r["pos"], r["distance"], r["earlier_doc_id"], r["earlier_pos"])
                  for r in repeated_lines(docs(rows + [(500, None), (501, "")])).collect())
    want = brute(rows)
    assert sum(r[2] for r in want) > 40 and got == want


def test_without_repeats(rows, docs):
    df = docs(rows + [(500, None), (501, ""), (502, "only\n\nonly")]).withColumn("n_chars", F.lit(-1).cast("long"))
    out = without_repeats(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    gone = {(i, p) for i, p, *_ in brute(rows)}
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    for i, t in rows:
        text = "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert got[i][0] == text and got[i][1] == (len(text) if text != t else -1)
    assert got[500] == (None, -1) and got[501] == ("", -1) and got[502] == ("only\n", 5)


def test_ties_nulls_and_repeated_rows(docs):
    df = docs([(None, "shared line one\nz"), (4, "shared line one"), (4, "shared line one"), (4, "other\nshared line one"), (2, "z\nz")])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in without_repeats(df).collect())
    first = [t for d, i, t in got if i == 4]
    assert got[0] == (False, 2, "z") and got[-1] == (True, 0, "")
    assert sorted(first) in (["other", "shared line one", "shared line one"], ["", "", "other\nshared line one"])


def test_long_lines_and_nothing(docs):
    line = "".join(random.Random(1).choice(string.ascii_lowercase + " ") for _ in range(300_000))
    df = docs([(1, line), (2, line[:150_000] + "#" + line[150_000:]), (3, line[1:]), (4, "\n".join(f"{k} line of many" for k in range(30000)))])
    got = {(r["doc_id"], r["pos"], r["earlier_doc_id"]) for r in repeated_lines(df.filter("doc_id < 4")).collect()}
    assert got == {(2, 0, 1), (3, 0, 1)}
    assert without_repeats(df.filter("doc_id = 4").union(df.filter("doc_id = 4").withColumn("doc_id", F.lit(9).cast("long")))).filter(
        "text = ''").count() == 1
    assert repeated_lines(docs([])).collect() == [] and without_repeats(docs([])).collect() == []


def test_short_lines_are_near_too(docs):
    rows = [(1, "total: 12345"), (2, "total: 12346\nyes"), (3, "a\nyet\nyes!"), (4, "b\nc1")]
    got = {(r["doc_id"], r["pos"], r["distance"], r["earlier_doc_id"], r["earlier_pos"]) for r in repeated_lines(docs(rows)).collect()}
    assert got == set(brute(rows)) and (2, 0, 1, 1, 0) in got and (4, 0, 1, 3, 0) in got


def test_halves_of_neighbouring_lengths_meet(spark):
    n = F.col("id").cast("int")
    rows = spark.range(1, 2000).select(n.alias("n"), half(n).alias("now"), half(n - 1).alias("before"), half(n + 1).alias("next")).collect()
    for r in rows:
        assert 2 * r["now"] <= r["n"] - 1 and r["now"] <= r["next"] <= r["now"] + 8


def test_plan_is_native(spark, docs):
    plan = without_repeats(docs([(1, "a\na")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
