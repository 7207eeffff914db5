import random
import re
import zlib
from collections import Counter

import pytest

from courseloom.llm import spelling
from courseloom.llm.spelling import forms, near_words, one_edit_pairs, variants


def one_apart(a, b):
    """Whether exactly one inserted, deleted or replaced code point lies between two texts."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def some_words(seed, many=250, letters="abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(many)}
    stems = ["".join(rng.choice(letters) for _ in range(n)) for n in (40, 200)]
    for stem in stems:                              # long words, near each other at any place
        for _ in range(15):
            k = rng.randrange(len(stem))
            words |= {stem[:k] + stem[k + 1:], stem[:k] + "z" + stem[k:], stem[:k] + "z" + stem[k + 1:]}
    return sorted(words)


def brute_pairs(words):
    return {(a, b) for a in words for b in words if one_apart(a, b)}


@pytest.mark.parametrize("block", [(4096, 1 << 16), (70, 1 << 16), (4096, 300)])
def test_index_finds_all_pairs(monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block[0])
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", block[1])
    words = some_words(1)
    random.Random(2).shuffle(words)
    got = [(words[i], words[j]) for a, b in one_edit_pairs(words) for i, j in zip(a, b)]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(words)


def test_index_of_odd_lists():
    assert [x for x in one_edit_pairs(["aaaaaa"]) if len(x[0])] == []
    assert [len(a) for a, _ in one_edit_pairs(["", "ab"])] in ([], [0], [0, 0], [0, 0, 0])


@pytest.mark.parametrize("group, shard", [(2048, 1024), (3, 20), (1, 5)])
def test_near_words_over_shards(spark, monkeypatch, group, shard):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "GROUP", group)
    words = [w for w in some_words(4) if len(w) > 1]
    vocab = spark.createDataFrame([(w, 5 + k % 7) for k, w in enumerate(words)], "word string, n long")
    got = [tuple(r) for r in near_words(vocab).collect()]
    n = {w: 5 + k % 7 for k, w in enumerate(words)}
    assert len(got) == len(set(got)) and set(got) == {(a, b, n[b]) for a, b in brute_pairs(words)}


def by_hand(n, more=5):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= more * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def test_forms_and_roots(spark):
    n = {"color": 4000, "colour": 100, "colours": 20, "coloury": 20, "xcolours": 4, "xxcolours": 0, "apples": 30, "applet": 30, "applen": 6,
         "lonely": 7, "étalon": 50, "etalon": 10, "ételon": 10}
    n |= {"q" * k: 5 ** (12 - k) for k in range(3, 12)}                 # a chain of eight forms
    vocab = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {tuple(r) for r in forms(vocab).collect()} == by_hand(n)
    assert forms(spark.createDataFrame([], "word string, n long")).collect() == []


def slow_counts(rows, altered):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if altered and i is not None:
                mark = zlib.crc32(f"{i}:{run}".encode())
                if mark % altered == 0:
                    at = mark % len(run)
                    run = run[:at] + run[at + 1:]
            found[run] += 1
    return {w: k for w, k in found.items() if len(w) >= 6 and k >= 5}


@pytest.mark.parametrize("altered", [None, 3, 1])
def test_variants_of_texts(docs, altered):
    rng = random.Random(8)
    words = ["Garden", "gardens", "GARDENER", "Éclairs", "éclairs", "ÿacht×es", "naïveté", "short", "warden", "market7place", "markets"]
    rows = [(k, rng.choice([" ", ", ", "\n", "日本"]).join(rng.choices(words, k=40))) for k in range(40)]
    rows += [(1, rows[1][1]), (None, "garden " * 9), (None, None), (77, ""), (78, "a" * 3000 + " " + "A" * 3000 + (" " + "a" * 2999) * 5 + (" " + "a" * 3000) * 30)]
    got = [tuple(r) for r in variants(docs(rows), altered).collect()]
    want = by_hand(slow_counts(rows, altered))
    assert len(got) == len(want) and set(got) == want
    assert len(want) > 5


def test_no_words(docs):
    for rows in ([], [(1, None), (2, ""), (3, "few words only here")]):
        assert variants(docs(rows), 199).collect() == []
