import random

import pytest

from courseloom.functions.text import search_key
from courseloom.operators.textindex import TextIndex
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rng = random.Random(4)
    letters = "abcé日😀 x"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 5, 30, 200])))) for i in range(300)] + [(900, None), (901, "ＡＢ Ｃ")]
    df = spark.createDataFrame(texts, "k int, t string").select("k", search_key("t").alias("search_text"))
    folded = {r["k"]: r["search_text"] for r in df.collect() if r["search_text"]}
    return folded, TextIndex(spark, str(tmp_path_factory.mktemp("index")), "k", "int").build(df, partitions=5)


@pytest.mark.parametrize("text", ["a", "日", "ab", "é日", "abc", "ＡＢ c", "abcx", "a b c", "😀日 cé", "aaaa bbbb", "日é x", "", "  ", "nothere", "a nothere", "xx", "xxx", "ab ca bc aé"])
def test_words_of_any_length(indexed, text):
    folded, index = indexed
    words = text.replace("ＡＢ", "ab").split()
    assert sorted(r["k"] for r in index.search(text).collect()) == sorted(k for k, t in folded.items() if all(w in t for w in words))


def test_only_lists_of_rare_grams_are_read(indexed):
    _, index = indexed
    n = {r["gram"]: r["n"] for r in index.grams().collect()}
    word = max((g for g in n if len(g) == 3), key=n.get) + min((g for g in n if len(g) == 3), key=lambda g: (n[g], g))
    plan = index.hits([word])._jdf.queryExecution().optimizedPlan().toString()
    asked = min((word[i:i + 3] for i in range(4)), key=lambda g: (n.get(g, 0), g))
    assert f"= {asked})" in plan
    assert index.postings().groupBy("gram").agg(F.count("*").alias("n")).exceptAll(index.grams()).isEmpty()


def test_empty_table(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), "k", "int").build(spark.createDataFrame([], "k int, search_text string"))
    assert index.search("any word").collect() == [] and index.search("a").collect() == []


def test_common_gram_has_a_row_a_group(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"common {i}") for i in range(640)] + [(900, "a\0\0"), (901, "")], "k int, search_text string").coalesce(1)
    index = TextIndex(spark, str(tmp_path), "k", "int").build(texts, partitions=3)
    assert spark.read.parquet(f"{tmp_path}/postings").where("gram = 'mmo'").count() <= 11
    assert index.grams().where("gram = 'mmo'").first()["n"] == 640
    assert {r["k"] for r in index.search("COMMON 63").collect()} == {i for i in range(640) if "63" in str(i)}
    assert [r["k"] for r in index.search("a\0\0").collect()] == [900] and index.search("").count() == 641


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_grams_of_any_block(indexed, monkeypatch, block):
    import numpy as np
    import pyarrow as pa

    from courseloom.operators import textindex

    folded, _ = indexed
    monkeypatch.setattr(textindex, "BLOCK", block)
    keys = list(folded)
    batch = pa.RecordBatch.from_arrays([pa.array([folded[k] for k in keys]), pa.array(np.arange(len(keys)) % 7), pa.array((np.arange(len(keys)) // 7).astype(np.int32))],
                                       names=["search_text", "group", "place"])
    got = {}
    for out in textindex._gram_masks()(iter([batch])):
        for gram, group, mask in zip(*[c.to_pylist() for c in out.columns]):
            got[gram, group] = got.get((gram, group), 0) | mask
    want = {}
    for i, k in enumerate(keys):
        t = folded[k]
        for gram in {t[j:j + 3] for j in range(len(t) - 2)} or {t}:
            want[gram, i % 7] = want.get((gram, i % 7), 0) | 1 << i // 7
    assert got == {at: mask - (1 << 64) if mask >> 63 else mask for at, mask in want.items()}
