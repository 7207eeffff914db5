import random

import numpy as np
import pytest

import corpus_pipeline
from courseloom.llm import near
from courseloom.llm.near import bands, representatives, shingles, similar


def sets_by_hand(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute(rows):
    """The ids that stay: groups of all pairs with a Jaccard similarity of 0.8 or more."""
    sets, root = [sets_by_hand(t) for _, t in rows], list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    return sorted(min(r[0] for k, r in enumerate(rows) if find(k) == g) for g in {find(k) for k in range(len(rows))})


def near_rows(seed=1, n=150):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 6, 64, 246, 600]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 3])):                       # copies with edits, over and under the similarity
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, len(words) // 45, len(words) // 30])):
                copy[rng.randrange(len(copy))] = "edited"
            rows.append((len(rows), " ".join(copy).upper()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small", [1, 32])
def test_all_near_copies_are_found(docs, monkeypatch, small):
    monkeypatch.setattr(near, "SMALL", small)
    rows = near_rows()
    base = " ".join(f"v{k}" for k in range(200)).split()
    rows += [(10000 + k, " ".join([*base[:k], "x", *base[k + 1:]])) for k in range(0, 200, 4)]
    df = docs(rows)
    got = representatives(df)
    assert got.dtypes == df.dtypes and sorted(r["doc_id"] for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("cell", [(256, 200_000), (16, 200_000), (256, 3000)])
def test_pairs_among_texts_with_a_common_beginning(docs, monkeypatch, cell):
    """Similar pairs in buckets that texts of other groups fill: none of the pairs is lost."""
    monkeypatch.setattr(near, "CELL", cell[0])
    monkeypatch.setattr(near, "CELL_SHINGLES", cell[1])
    rng = random.Random(3)
    common = [f"w{k}" for k in range(160)]
    rows = []
    for i in range(200):
        own = [f"u{i}x{k}" for k in range(rng.choice([36, 40, 60]))]
        rows.append((2 * i, " ".join(common + own)))
        rows.append((2 * i + 1, " ".join(common + own[:-17] + [f"v{i}x{k}" for k in range(17)])))
    rng.shuffle(rows)
    alone = brute(rows)
    assert 150 < len(alone) < 300
    assert sorted(r["doc_id"] for r in representatives(docs(rows)).collect()) == alone


def test_cell_links_are_all_pairs():
    rng = np.random.default_rng(5)
    for both in (False, True):
        sets = [np.unique(rng.choice(40, rng.integers(20, 40), replace=False).astype(np.uint64)) for _ in range(60)]
        node, root, side = np.arange(60) + 100, rng.integers(0, 50, 60), rng.random(60) < 0.5
        a, b = near.cell_links(node, root, side, both, sets)
        group = {k: k for k in node.tolist()}

        def find(k):
            while group[k] != k:
                k = group[k]
            return k

        want = dict(group)
        for x, y in zip(a.tolist(), b.tolist()):
            group[find(x)] = find(y)
        got = sorted(sorted(k for k in group if find(k) == g) for g in {find(k) for k in group})
        group = want
        for i in range(60):
            for j in range(i):
                if similar(sets[i], sets[j]) and root[i] != root[j] and (not both or side[i] != side[j]):
                    group[find(100 + i)] = find(100 + j)
        assert got == sorted(sorted(k for k in group if find(k) == g) for g in {find(k) for k in group})


def test_the_stage_drops_a_near_copy_with_other_fingerprint(spark, docs):
    from courseloom.llm.simhash import fingerprint
    words = [f"c{k}" for k in range(64)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:30], "edited", *words[31:]]))]
    assert (fingerprint(rows[0][1]) ^ fingerprint(rows[1][1])).bit_count() > 2 and brute(rows) == [1]
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near dedup"](spark, docs(rows), "").collect()] == [1]


def test_ties_nulls_and_empty(docs):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (5, "other words are in this one"), (3, "A B C D E"), (None, "lonely text of a null"),
            (None, "lonely text of a null"), (None, "a b c d e"), (None, None), (7, ""), (7, None)]
    found = sorted(((r["doc_id"] or -1), r["text"] or "") for r in representatives(docs(rows)).collect())
    assert found == [(-1, "lonely text of a null"), (3, "A B C D E"), (5, "other words are in this one"), (7, "")]
    assert representatives(docs([])).collect() == []


def test_bands_meet_by_similarity():
    a = shingles(" ".join(f"w{k}" for k in range(20000)))
    b = np.unique(np.concatenate([a[:9000], shingles("x " * 20)]))
    assert len(bands(a)) == near.BANDS and bands(a[:0]) == [] and set(bands(a[:-9])) & set(bands(a))
    assert similar(a, a[:-9]) and not similar(a, b)


def test_fingerprints_link_without_any_band(spark, monkeypatch):
    rng, rows = random.Random(8), []
    while len(rows) < 40:
        words = [f"w{rng.randrange(4000)}" for _ in range(900)]
        copy = list(words)
        copy[rng.randrange(900)] = "edited"
        one, two = " ".join(words), " ".join(copy)
        if (near.fingerprint(shingles(one)) ^ near.fingerprint(shingles(two))).bit_count() <= 2:
            rows += [(len(rows), one), (len(rows) + 1, two)]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(near, "candidates", lambda met, sets: none)     # the bands' own candidates
    monkeypatch.setattr(near, "unresolved", lambda met, sets, member: none)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in representatives(docs).collect()) == brute(rows) == list(range(0, 40, 2))
