import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courseloom.llm import decontaminate
from courseloom.llm.decontaminate import clean, contained

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def grams(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(docs, items):
    found = []
    for i, text in docs:
        for j, item in items:
            n = min(5, len((item or "").split()))
            have = grams(item, n) if n else set()
            shared = len(have & grams(text, n)) if n else 0
            if have and shared >= math.ceil(0.8 * len(have) - 1e-9):
                found.append((i, j, len(have), shared))
    return Counter(found)


@pytest.fixture
def case(spark, docs):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([5, 6, 9, 30, 60, 130]))) for i in range(40)]
    items += [(100, "two words"), (101, ""), (102, None), (103, items[0][1]), (None, "q r s t u v"), (104, "x y x y x y x y x y"), (104, "x y x y x y x y x y")]
    rows = []
    for i in range(60):
        words = text(rng.choice([0, 3, 80, 3000])).split()
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1] or ""
            part = part.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words).upper()))
    rows += [(70, None), (None, items[1][1]), (71, items[2][1]), (71, items[2][1]), (72, "y x y x y x")]
    return rows, items, docs(rows), spark.createDataFrame(items, ITEMS).withColumn("fp", F.lit(1))


@pytest.mark.parametrize("block", [64, 16 << 20])
def test_contained(monkeypatch, case, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block * 60)
    rows, items, docs, bench = case
    want = brute(rows, items)
    assert len(want) > 30
    got = contained(docs, bench).collect()
    assert Counter((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in got) == want
    assert all(r["containment"] == r["n_shared"] / r["n_shingles"] for r in got)
    kept = clean(docs, bench)
    hit = {i for i, _, _, _ in want}
    assert kept.schema == docs.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, _ in rows if i not in hit)


def test_nothing(spark, docs, case):
    rows, items, df, bench = case
    assert contained(df, bench.limit(0)).collect() == [] and clean(df, bench.limit(0)).count() == len(rows)
    assert contained(docs([]), bench).collect() == [] and clean(docs([]), bench).collect() == []
