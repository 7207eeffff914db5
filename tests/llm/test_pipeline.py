"""The pipeline's stages, one after the other, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from courseloom.llm import quality
from courseloom.llm.quality import Judge, char_counts, plain_words
from courseloom.llm.tokens import PACKED_BY, vocabulary
from tests.llm.test_decontaminate import brute as contained_by_hand
from tests.llm.test_lines import brute as repeats_by_hand
from tests.llm.test_near import brute as similar_by_hand
from tests.llm.test_packing import best_fit
from tests.llm.test_quality import prose, slow_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows = random.Random(12), []
    items = [(k, " ".join(f"q{rng.randrange(500)}" for _ in range(rng.randint(8, 30)))) for k in range(12)]
    pool = [prose(rng, 12) for _ in range(8)]
    for i in range(260):
        lang = rng.choice(["en", "fr"])
        text = "\n".join([prose(rng, rng.randint(8, 60)) for _ in range(rng.randint(1, 5))] + rng.sample(pool, rng.choice([0, 0, 1, 2])))
        kind = rng.random()
        if kind < 0.1:
            text = text.replace(" ", "%%% ")
        elif kind < 0.25 and rows:
            text = rng.choice(rows)[1]
            text = text if rng.random() < 0.5 else text[:-1] + "!"
        elif kind < 0.35:
            text += "\n" + prose(rng, 10) + " " + rng.choice(items)[1] + " " + prose(rng, 10)
        elif kind < 0.4:
            text = prose(rng, 5)
        rows.append((i, text, lang, "s", len(text)))
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def quality_by_hand(rows):
    chars, words = {}, {}
    for _, text, lang, *_ in rows:
        for name in (lang, quality.ALL):
            chars[name] = chars.get(name, 0) + np.array(char_counts(text.encode()))
            words.setdefault(name, Counter()).update(plain_words(text.encode()))
    known = {}
    for name, counts in words.items():
        every = sum(counts.values())
        known[name] = (chars[name], {b"": every, **{w: n for w, n in sorted(counts.items()) if n >= quality.COMMON_SHARE * every}})
    judge, kept = Judge(known), []
    for row in rows:
        n = slow_counts(row[1])
        if n[0] >= 20 and 100 * n[4] <= 30 * n[0] and not judge.distances(row[2], row[1].encode())[2]:
            kept.append(row)
    return kept


def lines_by_hand(rows):
    gone = {(i, p) for i, p, *_ in repeats_by_hand([(r[0], r[1]) for r in rows])}
    out = []
    for i, text, lang, source, n in rows:
        left = "\n".join(x for p, x in enumerate(text.split("\n")) if (i, p) not in gone)
        out.append((i, left, lang, source, len(left) if left != text else n))
    return out


def near_by_hand(rows):
    kept = set(similar_by_hand([(r[0], r[1]) for r in rows]))
    return [r for r in rows if r[0] in kept]


def test_stages(spark, corpus):
    folder, rows, items = corpus
    steps = [quality_by_hand, lines_by_hand, near_by_hand,
             lambda rows: [r for r in rows if not contained_by_hand([(r[0], r[1])], items)]]
    docs, want = spark.read.parquet(f"{folder}/documents.parquet"), rows
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES, steps):
        before, want = len(want), by_hand(want)
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert sorted(tuple(r) for r in got) == sorted(want), name
        assert len(want) < before or name == "line dedup"
        docs = spark.createDataFrame(got, docs.schema)
    packed = corpus_pipeline.run(spark, folder).collect()
    own = Tokenizer.from_file(vocabulary(PACKED_BY))
    lengths = {r[0]: len(own.encode(r[1], add_special_tokens=False).ids) + 1 for r in want}
    assert {r["doc_id"]: r["length"] for r in packed} == lengths and max(lengths.values()) <= 4096
    assert len({r["sequence_id"] for r in packed}) == sum(best_fit(lengths.values(), 4096).values())


def test_the_stages_are_as_asked():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]


def test_empty_tables(spark, corpus, tmp_path):
    folder, _, _ = corpus
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
