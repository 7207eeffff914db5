import random

import numpy as np
import pytest

from courseloom.llm import multiprobe
from courseloom.llm.multiprobe import Hashing, best_of, choose, perturbations, search, visits

FIELDS = "vec_id long, embedding array<double>, id string, v string, rank string, score string"
EVERY_20TH = "id % 20 = 0"


@pytest.fixture
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, "clash", "clash", "clash", "clash") for i, v in rows], FIELDS).repartition(3)

    return make


def brute(rows, nearest=20, asks=lambda i: i % 20 == 0):
    """All lists by comparing each query with every row."""
    rows = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in rows]
    length = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    rows = sorted({(i, tuple(v)) for i, v in rows if len(v) == length})
    out = []
    for i, q in rows:
        if asks(i):
            found = sorted((-float((np.array(q) * np.array(c)).sum()), j) for j, c in rows if j != i)
            out += [(i, k + 1, j, -less) for k, (less, j) in enumerate(sorted(set(found))[:nearest])]
    return out


def tuples(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def clustered(seed, many=400, length=12, groups=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, length))
    return (centres[rng.integers(0, groups, many)] + 0.3 * rng.normal(size=(many, length))) * rng.uniform(0.5, 2, (many, 1))


@pytest.mark.parametrize("block, flush", [(512, 1 << 18), (7, 100), (20, 3000)])
def test_all_neighbours_when_everything_is_probed(table, monkeypatch, block, flush):
    monkeypatch.setattr(multiprobe, "BLOCK", block)
    monkeypatch.setattr(multiprobe, "FLUSH", flush)
    monkeypatch.setattr(multiprobe, "HASHES", [1])
    monkeypatch.setattr(multiprobe, "WIDTHS", [50.0])
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(1))]
    rows += [(500 + k, rows[3][1]) for k in range(60)]                  # equal vectors: ties by id
    rows += [(1000, None), (1020, []), (1040, [0.0] * 12), (1060, [1.0] * 11 + [None]), (1080, [float("nan")] * 12), (None, [1.0] * 12),
             (1100, [1.0, 2.0]), (40, rows[40][1]), (60, rows[61][1])]  # a repeated row, an id with two vectors
    assert [r[:3] for r in tuples(search(table(rows), EVERY_20TH))] == sorted(r[:3] for r in brute(rows))
    assert np.allclose([r[3] for r in tuples(search(table(rows), EVERY_20TH))], [r[3] for r in sorted(brute(rows))], rtol=1e-14)


def test_queries_that_find_too_few_see_all_rows(table, monkeypatch):
    """Buckets of next to no width hold no neighbour, so every list comes from the scan in blocks."""
    monkeypatch.setattr(multiprobe, "HASHES", [7])
    monkeypatch.setattr(multiprobe, "WIDTHS", [1e-6])
    monkeypatch.setattr(multiprobe, "BLOCK", 50)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(2, 150))]
    assert [r[:3] for r in tuples(search(table(rows), EVERY_20TH))] == sorted(r[:3] for r in brute(rows))


@pytest.mark.parametrize("many", [0, 1, 2, 15, 20, 21])
def test_fewer_candidates_than_asked(table, many):
    rows = [(20 * i, v.tolist()) for i, v in enumerate(clustered(3, many))]
    got = tuples(search(table(rows), EVERY_20TH))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(brute(rows))] and len(got) == many * min(20, max(0, many - 1))


def test_no_query(table):
    df = search(table([(1, [1.0, 2.0]), (2, [0.5, 1.0])]), EVERY_20TH)
    assert df.collect() == [] and df.columns == ["query_id", "rank", "vec_id", "score"]


def test_many_equal_vectors(table, monkeypatch):
    monkeypatch.setattr(multiprobe, "HASHES", [1])
    monkeypatch.setattr(multiprobe, "WIDTHS", [50.0])
    rows = [(i, [1.0, 0.5, 0.25]) for i in range(300)] + [(1000 + i, v.tolist()) for i, v in enumerate(clustered(4, 100, 3))]
    assert [r[:3] for r in tuples(search(table(rows), EVERY_20TH))] == sorted(r[:3] for r in brute(rows))


def test_recall_of_clusters(table):
    """Parameters as in production; rows in clusters, so that few of them need to be compared."""
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(5, 4000, 24, 60))]
    got = {}
    for q, _, i, s in tuples(search(table(rows), EVERY_20TH)):
        got.setdefault(q, []).append((i, s))
    data = np.array([v for _, v in rows])
    hits = 0
    for q, found in got.items():
        scores = data @ data[q]
        scores[q] = -np.inf
        hits += len({i for i, _ in found} & set(np.argsort(-scores)[:20].tolist()))
        assert len(found) == 20 and np.allclose([s for _, s in found], data[[i for i, _ in found]] @ data[q])
    assert len(got) == 200 and hits >= 0.92 * 20 * 200


def test_success_order():
    places = np.array([[[3.1, -2.45, 0.9]]])
    moves, order = visits(places, 27)
    assert sorted(order[0, 0].tolist()) == list(range(27)) and len({tuple(m) for m in moves}) == 27
    part = [0.1, 0.55, 0.9]
    cost = [sum(p * p if m == -1 else (1 - p) ** 2 if m == 1 else 0 for m, p in zip(move, part)) for move in moves[order[0, 0]]]
    assert np.all(np.diff(cost) >= -1e-12) and cost[0] == 0 and cost[1] == pytest.approx(0.01)
    assert len(perturbations(2)) == 9


def test_buckets_of_equal_slots_only():
    rng = random.Random(6)
    held = Hashing(1.0, np.zeros((3, 4, 2)), np.zeros((3, 4)), 1.0, 1)
    slots = np.array([[[rng.randint(-3, 3) for _ in range(4)] for _ in range(3)] for _ in range(500)])
    numbers = held.buckets(slots)
    seen = {}
    for row, own in zip(slots, numbers):
        for t in range(3):
            assert seen.setdefault(own[t], (t, *row[t])) == (t, *row[t])


def test_mapping_turns_products_into_distances():
    rng = np.random.default_rng(7)
    rows, q = rng.normal(size=(50, 6)), rng.normal(size=(1, 6))
    top = (rows * rows).sum(axis=1).max()
    held = Hashing(top, np.eye(7)[None], np.zeros((1, 7)), 1.0, 1)
    away = ((held.rows(rows)[:, 0] - held.queries(q)[0, 0]) ** 2).sum(axis=1)
    assert np.argsort(away).tolist() == np.argsort(-(rows @ q[0])).tolist()


def test_best_of_keeps_ties():
    c = np.array([[1.0, 0], [1, 0], [0, 1], [1, 0], [0.5, 0]])
    a, b, score = best_of(np.array([[2.0, 0], [0, 3.0]]), c, 2)
    assert {(int(x), int(y)) for x, y in zip(a, b)} >= {(0, 0), (0, 1), (0, 3), (1, 2)} and score[0] == 2.0


def test_fit_reaches_its_recall():
    data = clustered(8, 3000, 16, 40)
    queries = data[:40]
    scores = queries @ data.T
    near = np.argsort(-scores, axis=1)[:, 1:21]
    held = choose((data * data).sum(axis=1).max(), queries, data[100:400], data[near.ravel()], np.repeat(np.arange(40), 20), 10 ** 9, 20.0)
    own, asked = held.buckets(np.floor(held.rows(data))), held.probed(queries)
    hit = [(own[near[k]][:, :, None] == asked[k][None]).any(axis=(1, 2)).mean() for k in range(40)]
    met = np.mean([(own[:, :, None] == asked[k][None]).any(axis=(1, 2)).mean() for k in range(40)])
    assert np.mean(hit) >= 0.94 and met < 0.6
