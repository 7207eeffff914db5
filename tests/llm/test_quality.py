import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from courseloom.llm import quality
from courseloom.llm.quality import Frequent, base_counts, char_counts, distance, judge, kept_rows, limit, references


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(covered))


@pytest.mark.parametrize("seed", range(40))
def test_base_counts(seed):
    rng = random.Random(seed)
    parts = ["a", "b", "é", "日本", "😀|", " ", " ", " ", "\n", "\n", "\t", "\x0b", "\x85", "\x1c", "#$", "a a b a a b a a b a ", "\r\n"]
    text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 3, 30, 400])))
    text += text[:rng.choice([0, 50, 500])]
    assert base_counts(text.encode()) == slow_counts(text)


def test_very_long_text():
    text = " ".join(str(i % 5000) for i in range(40000))
    assert base_counts(text.encode())[4] == 40000
    text = " ".join(map(str, range(300000)))
    assert base_counts(text.encode())[4] == 0


def test_distance():
    assert distance(np.array([1.0, 1]), np.array([2.0, 2])) == 0
    assert distance(np.array([1.0, 0]), np.array([0.0, 3])) == pytest.approx(1)
    p, q = np.array([3.0, 1, 0, 4]), np.array([1.0, 5, 2, 0])
    a, b = p / p.sum(), q / q.sum()
    kl = lambda x, y: sum(i * math.log2(i / j) for i, j in zip(x, y) if i)
    assert distance(p, q) == pytest.approx(math.sqrt(kl(a, (a + b) / 2) / 2 + kl(b, (a + b) / 2) / 2))
    assert limit(0.2, 11, 100) > limit(0.2, 11, 1000) > 0.2


def test_char_counts_are_of_code_points():
    text = "aZ9 \n.,\"'#\x01éß日本😀"
    assert char_counts(text.encode()) == [1, 1, 1, 2, 2, 2, 1, 1, 2, 2, 1]


def test_frequent_loses_no_common_word(monkeypatch):
    monkeypatch.setattr(Frequent, "KEPT", 50)
    rng, words, found = random.Random(1), [], Frequent()
    for _ in range(300):
        part = [rng.choice([b"the", b"of", b"w%d" % rng.randrange(5000)]) for _ in range(30)]
        words += part
        found.add(part)
    common = {w for w, n in Counter(words).items() if n >= 0.05 * len(words)}
    assert common == {b"the", b"of"} <= set(found.candidates(0.05)) and len(found.counts) < 200


def prose(rng, n, common=("the", "of", "and", "to", "in")):
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghiklmnoprst") for _ in range(rng.randint(3, 9)))
                    for _ in range(n)) + "."


def test_judge(spark, docs):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.choice([30, 120, 400]))) for i in range(200)]
    rows += [(1000 + i, " | ".join(prose(rng, 1, ("x",)) for _ in range(60))) for i in range(4)]
    rows += [(2000 + i, prose(rng, 200).replace(" ", "%%% ")) for i in range(4)]
    rows += [(3000, "too short"), (3001, None), (None, ""), (3002, rows[0][1]), (3002, rows[0][1]), (3003, "again and again we say it here " * 30)]
    df = docs(rows).withColumn("lang", F.when(F.col("doc_id") == 5, None).when(F.col("doc_id") == 6, "xx").otherwise("en"))
    got = judge(df).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    for r in got:
        n = slow_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        junk = r["doc_id"] is None or r["doc_id"] >= 1000 and r["doc_id"] != 3002
        assert r["kept"] == (not junk), r
    kept = kept_rows(df)
    assert kept.schema == df.schema
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])
    assert judge(df.filter("doc_id < -1")).collect() == [] and kept_rows(df.filter("doc_id < -1")).collect() == []


def test_references_count_everything(spark, docs):
    rng = random.Random(9)
    rows = [(i, prose(rng, 50)) for i in range(60)]
    df = docs(rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("en"))
    known = references(df)
    assert set(known) == {"en", "fr", quality.ALL}
    for name in ("en", "fr"):
        texts = [t for i, t in rows if (i % 3 == 0) == (name == "fr")]
        words = Counter(w for t in texts for w in quality.plain_words(t.encode()))
        every = sum(words.values())
        assert known[name][1] == {b"": every, **{w: n for w, n in words.items() if n >= quality.COMMON_SHARE * every}}
        assert known[name][0].tolist() == np.sum([char_counts(t.encode()) for t in texts], axis=0).tolist()


def test_rare_and_null_languages_are_not_judged_by_the_others(spark, docs):
    rng, foreign = random.Random(4), ("der", "und", "die", "das", "ist")
    rows = [(i, prose(rng, 60)) for i in range(300)]
    rows += [(1000 + i, prose(rng, 60, foreign).upper()) for i in range(24)] + [(2000, prose(rng, 300, foreign).upper())]
    rows += [(3000 + i, prose(rng, 300, foreign).upper()) for i in range(8)] + [(4000, prose(rng, 300).replace(" ", "%%% "))]
    name = F.when(F.col("doc_id") < 1000, "en").when(F.col("doc_id") < 2000, "de").when(F.col("doc_id") < 3000, "xx").when(F.col("doc_id") < 4000, None)
    df = docs(rows).withColumn("lang", name.otherwise("en"))
    big = df.union(docs([(5000 + i, prose(rng, 6000)) for i in range(280)]).withColumn("lang", F.lit("en")))    # "de" is under 0.1 % of it
    for table in (df, big):
        got = {r["doc_id"]: r for r in judge(table).filter("doc_id < 5000").collect()}
        assert {i for i, r in got.items() if not r["kept"]} == {4000}
        assert all((r["word_distance"] is None) == (2000 <= i < 4000) for i, r in got.items())
