from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from courseloom.llm import whitening
from courseloom.llm.whitening import count_below, principal, tridiagonal, whitened

FIELDS = "vec_id long, embedding array<double>, n string, component string, whitened string"


@pytest.fixture
def table(spark):
    def make(rows, fields=FIELDS):
        return spark.createDataFrame([(i, v, "clash", "clash", "clash") for i, v in rows], fields).repartition(3)

    return make


def by_hand(vectors):
    """Exact covariance of whole-number vectors, and numpy's eigenvectors."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    mean = [Fraction(s, n) for s in sums]
    cov = np.array([[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    centred = np.array([[float(c - m) for c, m in zip(r, mean)] for r in x])
    return deviation, centred, values[::-1], vectors[:, ::-1].T, np.trace(cov)


@pytest.mark.parametrize("matrix", [np.eye(5) * 3, np.diag([1.0, 1, 2, 2, 2, 0, 0]), np.ones((6, 6)), np.zeros((3, 3)), np.array([[2.0]]),
                                    np.array([[2.0, 1], [1, 2]]), np.diag([1.0, -1]), np.diag(np.arange(12.0)),
                                    np.kron(np.eye(4), [[2.0, 1], [1, 2]]), 1e12 * (np.ones((9, 9)) + np.eye(9)), -np.eye(3)])
def test_principal(matrix):
    many = min(8, len(matrix))
    values, vectors = principal(matrix, many)
    size = max(1.0, np.abs(matrix).max())
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:many]).max() < 1e-13 * size * len(matrix)
    assert np.abs(matrix @ vectors.T - vectors.T * values).max() < 1e-12 * size
    assert np.abs(vectors @ vectors.T - np.eye(many)).max() < 1e-12


def test_tridiagonal_and_sturm_counts():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a = a + a.T
    diagonal, off, _ = tridiagonal(a)
    values = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)), values, atol=1e-12)
    at = np.concatenate([values - 1e-9, values + 1e-9, [-1e9, 1e9]])
    assert count_below(diagonal, off, at).tolist() == [int((values < x).sum()) for x in at]


@pytest.mark.parametrize("few", [True, False])
def test_whitened_against_exact_covariance(table, monkeypatch, few):
    if few:                                 # products too large for doubles
        monkeypatch.setattr(whitening, "EXACT", 0)
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(300, 12)) * np.arange(1, 13)).tolist()
    rows = [(i, v) for i, v in enumerate(data)]
    rows += [(7, data[7]), (None, data[8])]                             # repeated rows and null ids count
    kept = [v for _, v in rows]
    rows += [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [1.0] * 11 + [float("nan")]), (904, [float("inf")] * 12),
             (905, [1.0, 2.0]), (906, [1e300] * 12)]
    deviation, centred, values, vectors, trace = by_hand(kept)
    got = whitened(table(rows)).collect()
    assert len(got) == 8 * len(kept) and {r["n"] for r in got} == {len(kept)}
    assert all(r["identity_error"] < 1e-9 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for k in range(8):
        want = centred @ vectors[k] / np.sqrt(values[k])
        mine = [by_id[i if i < 300 else 7 if i == 300 else None][k + 1][0]["whitened"] for i in range(302)]
        sign = np.sign(np.dot(mine, want))
        assert np.abs(np.array(mine) - sign * want).max() < 1e-9
        assert {r["explained"] for r in got if r["component"] == k + 1} == {by_id[0][k + 1][0]["explained"]}
        assert abs(by_id[0][k + 1][0]["explained"] / (values[k] / trace) - 1) < 1e-10
    assert [by_id[i][1][0]["deviation"] for i in range(300)] == [Decimal(d) for d in deviation[:300]]
    assert len(by_id[7][1]) == 2


def test_large_entries_stay_exact(table):
    rows = [(0, [2.0 ** 49, 3.0]), (1, [-(2.0 ** 49), 4.0]), (2, [0.5, 0.125])]
    deviation, _, _, _, _ = by_hand([v for _, v in rows])
    got = {r["vec_id"]: r for r in whitened(table(rows)).filter("component = 1").collect()}
    assert [int(got[i]["deviation"]) for i in range(3)] == deviation


def test_fewer_vectors_than_components_and_equal_ones(table):
    got = whitened(table([(1, [1.0, 2.0, 3.0, 4.0]), (2, [2.0, 2.0, 3.0, 4.0]), (3, [1.0, 3.0, 3.0, 4.0])])).orderBy("vec_id", "component").collect()
    assert len(got) == 12 and [r["whitened"] is None for r in got] == [False, False, True, True] * 3
    assert [r["explained"] > 0 for r in got[:4]] == [True, True, False, False]
    same = whitened(table([(i, [1.5, 2.0]) for i in range(5)])).collect()
    assert len(same) == 10 and {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in same} == {(None, None, None, 0)}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])]])
def test_nothing_to_whiten(table, rows):
    df = whitened(table(rows))
    assert df.collect() == []
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_result_does_not_depend_on_the_dealing(spark, table):
    rng = np.random.default_rng(6)
    df = table([(i, v) for i, v in enumerate(rng.normal(size=(200, 9)).tolist())]).withColumn("embedding", F.col("embedding").cast("array<float>"))
    key = lambda df: sorted((r["vec_id"], r["component"], r["whitened"], r["explained"]) for r in df.collect())
    assert key(whitened(df)) == key(whitened(df.repartition(7)))


def test_a_row_projects_alike_in_any_batch():
    from courseloom.llm.whitening import Whitening

    rng = np.random.default_rng(8)
    x = rng.integers(90_000, 110_000, (400, 65))
    held = Whitening(400, 65, [int(s) for s in x.sum(axis=0)], np.arange(9, 1, -1.0), rng.normal(size=(8, 65)), 100.0)
    whole = held.project(x)
    for size in (1, 2, 3, 7, 30, 129):
        assert np.array_equal(whole, np.concatenate([held.project(x[i:i + size]) for i in range(0, 400, size)]))
