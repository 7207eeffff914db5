"""Whitened embeddings: exact distributed covariance, leading components by tridiagonal methods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseloom.llm.common import query, table
from courseloom.llm.vectors import common_length, finite, matrix

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000        # an entry c becomes the whole number floor(SCALE * c) + SHIFT
LARGEST = 2.0 ** 50                 # entries of at least this magnitude count as not finite
CLUSTER = 1e-3                      # eigenvalues closer than this share of the greatest are one cluster
SEED = 42
EXACT = 2.0 ** 53                   # whole numbers below this are exact in a double


def whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors).astype(np.int64) + SHIFT


def tridiagonal(matrix_: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal and off-diagonal of a tridiagonal matrix similar to a symmetric one, and
    the unit reflectors, the k-th of which acts on the entries from k + 1."""
    a = matrix_.copy()
    n = len(a)
    off, mirrors = np.zeros(max(n - 1, 0)), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        off[k] = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= off[k]
        size = np.linalg.norm(v)
        if size:
            v /= size
            p = a[k + 1:, k + 1:] @ v
            p -= (v @ p) * v
            a[k + 1:, k + 1:] -= 2 * (np.outer(v, p) + np.outer(p, v))
        mirrors.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off, mirrors


def count_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each of some numbers."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    below, q = np.zeros(len(at), int), np.ones(len(at))
    for d, e in zip(diagonal, np.concatenate([[0.0], off])):
        with np.errstate(over="ignore"):                # an infinite pivot stands for a huge one
            q = d - at - e * e / q
        q = np.where(np.abs(q) < least, -least, q)      # a zero pivot counts as below, and can be divided by
        below += q < 0
    return below


def leading(diagonal: np.ndarray, off: np.ndarray, many: int) -> np.ndarray:
    """The greatest eigenvalues, falling, by bisection on the Sturm count."""
    n = len(diagonal)
    reach = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low, high = np.full(many, (diagonal - reach).min()), np.full(many, (diagonal + reach).max())
    order = n - 1 - np.arange(many)                     # of the eigenvalues in rising order
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return high
        above = count_below(diagonal, off, middle) <= order
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x with (T - shift) x = right, by elimination with row exchanges; zero pivots become ``least``."""
    n = len(diagonal)
    main, upper, second, x = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    for k in range(n - 1):
        below, own, above = off[k], main[k + 1], upper[k + 1]
        if abs(below) > abs(main[k]):
            m = main[k] / below
            main[k], upper[k], second[k], main[k + 1], upper[k + 1] = below, own, above, upper[k] - m * own, -m * above
            x[k], x[k + 1] = x[k + 1], x[k] - m * x[k + 1]
        else:
            m = below / (main[k] or least)
            main[k + 1] = own - m * upper[k]
            x[k + 1] -= m * x[k]
    for k in range(n - 1, -1, -1):
        later = x[k] - (upper[k] * x[k + 1] if k + 1 < n else 0) - (second[k] * x[k + 2] if k + 2 < n else 0)
        pivot = main[k] if abs(main[k]) > least else least
        x[k] = later / pivot
        if abs(x[k]) > 1e100:                           # only the direction counts
            x = [y / 1e100 for y in x]
    return np.array(x)


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of a tridiagonal matrix, one a row, by inverse iteration; those of a cluster
    of eigenvalues are made orthogonal to each other at every step."""
    n, random = len(diagonal), np.random.default_rng(SEED)
    size = max(np.abs(diagonal).max(), np.abs(off).max(initial=0)) or 1.0
    least = np.finfo(float).eps * size
    found, first = np.zeros((len(values), n)), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * size:
            first = k
        x = random.standard_normal(n)
        for _ in range(6):
            x = solved(diagonal, off, value, x / np.linalg.norm(x), least)
            x /= np.abs(x).max()
            for _ in range(2):
                for other in found[first:k]:
                    x -= (x @ other) * other
        found[k] = x / np.linalg.norm(x)
    return found


def principal(covariance: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors, one a
    row; the entry of greatest magnitude (the first of equals) is positive."""
    diagonal, off, mirrors = tridiagonal(covariance)
    values = leading(diagonal, off, many)
    vectors = eigenvectors(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        vectors[:, k + 1:] -= 2 * np.outer(vectors[:, k + 1:] @ mirrors[k], mirrors[k])
    top = np.abs(vectors).argmax(axis=1)
    return values, vectors * np.sign(vectors[np.arange(many), top])[:, None]


@dataclass
class Whitening:
    """What a fit knows: rows, length, exact sums of the whole-number vectors, eigenvalues, their
    unit vectors (one a row) and the trace of the covariance."""

    n: int
    length: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def base(self) -> np.ndarray:
        """The means, rounded to whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def rest(self) -> np.ndarray:
        """n times what the base leaves of the means, exact."""
        return np.array([s - self.n * int(b) for s, b in zip(self.sums, self.base())], np.int64)

    def known(self) -> np.ndarray:
        """Which eigenvalues are above what rounding leaves of a zero."""
        return self.values > self.length * np.finfo(float).eps * max(self.trace, 0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of whole-number vectors; NaN where the eigenvalue is zero. The entries
        are added in their order: a matrix product may add a row's in another with the batch's size."""
        scale = np.where(self.known(), np.sqrt(np.where(self.known(), self.values, 1)), np.nan)
        centred, out = (x - self.base()) - self.rest() / self.n, np.zeros((len(x), len(self.values)))
        for entry, part in zip(centred.T, self.vectors.T):
            out += entry[:, None] * part
        return out / scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum)^2, exact."""
        y, rest = x - self.base(), self.rest()
        most = self.n * float(np.abs(y).max(initial=0)) + float(np.abs(rest).max(initial=0))
        if most * most * self.length < 2.0 ** 62:
            y = self.n * y - rest
            return (y * y).sum(axis=1).tolist()
        y = self.n * y.astype(object) - rest
        return (y * y).sum(axis=1).tolist()


def remaining(rows: DataFrame, vector_id: str, vector: str) -> DataFrame:
    """vec_id and v, the vector in doubles, of the rows that count."""
    v = F.col(vector).cast("array<double>")
    return rows.select(F.col(vector_id).alias("vec_id"), v.alias("v")).filter(finite(F.col("v"), LARGEST))


def _summed(rows: DataFrame, entries) -> dict[tuple, int]:
    """Exact sums of whole numbers over all rows: ``entries`` yields (keys, Python numbers) for a
    task's batches, at most length^2 of them a task; they are added up in decimals."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j, numbers = entries(batches)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                          pa.array([str(x) for x in numbers])], ["i", "j", "x"])

    found = rows.select("v").mapInArrow(emit, "i int, j int, x string")
    return {(r["i"], r["j"]): int(r["x"]) for r in
            found.groupBy("i", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of vectors v (all of one length): two passes, sums and products of centred
    vectors, each in whole numbers, so that the result doesn't depend on how the rows are dealt out.

    Vectors are centred by their rounded means before they are multiplied; what rounding leaves is
    taken off exactly. The products of a batch are exact in doubles while they stay below 2^53, larger
    ones are multiplied as whole numbers of any size. Driver and task hold length^2 numbers.
    """
    length = common_length(rows, "v")
    rows = rows.filter(F.size("v") == length)

    def sums(batches):
        total, n = np.zeros(length, object), 0
        for batch in batches:
            x = whole(matrix(batch.column(0), length))
            total += x.astype(object).sum(axis=0) if np.abs(x).max(initial=0) > 1 << 40 else x.sum(axis=0).astype(object)
            n += len(x)
        return [*range(length), -1], [0] * (length + 1), [*total, n]

    got = _summed(rows, sums) if length else {}
    n = got.pop((-1, 0), 0)
    many = min(components, length)
    held = Whitening(n, length, [got[k, 0] for k in range(length)] if n else [], np.zeros(many), np.zeros((many, length)), 0.0)
    if not n:
        return held
    base = held.base()
    upper = np.triu_indices(length)

    def products(batches):
        total = np.zeros((length, length), object)
        for batch in batches:
            y = whole(matrix(batch.column(0), length)) - base
            if float(np.abs(y).max(initial=0)) ** 2 * max(len(y), 1) < EXACT:
                total += (y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
            else:
                total += y.T.astype(object) @ y.astype(object)
        return *upper, total[upper]

    got, rest = _summed(rows, products), held.rest().tolist()
    covariance = np.zeros((length, length))
    for (i, j), x in got.items():
        covariance[i, j] = covariance[j, i] = (n * x - rest[i] * rest[j]) / (n * n)     # of whole numbers: rounded once
    held.values, held.vectors = principal(covariance, many)
    held.trace = float(np.trace(covariance))
    return held


def identity_error(rows: DataFrame, held: Whitening) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over the
    components whose eigenvalue isn't zero, by a pass for the means and one for centred products."""
    known = np.nonzero(held.known())[0] if held.n else np.zeros(0, int)
    if not len(known):
        return None
    many = len(known)

    def averaged(entries) -> np.ndarray:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum(entries(held.project(whole(matrix(b.column(0), held.length)))[:, known]) for b in batches)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "x"])

        found = rows.filter(F.size("v") == held.length).select("v").mapInArrow(emit, "i long, x double")
        return np.array([r[1] for r in found.groupBy("i").agg(F.sum("x")).orderBy("i").collect()]) / held.n

    mean = averaged(lambda w: w.sum(axis=0))
    moments = averaged(lambda w: (w - mean).T @ (w - mean)).reshape(many, many)
    return float(np.abs(moments - np.eye(many)).max())


def whitened(rows: DataFrame, components: int = COMPONENTS, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every vector on the leading principal components of all vectors, scaled to variance 1:
    vec_id, component (from 1, by falling eigenvalue), n (vectors), deviation (decimal: sum over
    dimensions of (n * x - S)^2), whitened, explained (share of the variance), identity_error.

    Null vectors, empty ones, those with a null, non-finite or enormous entry (2^50 and more, whose
    whole number doesn't fit) and those of another length than most vectors (of two equally frequent
    lengths, the greater) are dropped. Repeated rows all count and all return; null ids return as
    null. Where an eigenvalue is zero (fewer vectors than components, equal vectors) whitened is null
    and explained 0, or null if all vectors are equal. Vectors shorter than ``components`` have a
    component for each entry. Extra columns aren't read, and an empty table gives no row.

    The matrix is length^2 numbers on the driver, found by aggregation; its components are sent to
    all tasks, and the projection shuffles nothing.
    """
    rows = remaining(rows, vector_id, vector)
    held = fit(rows, components)
    error = identity_error(rows, held)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(matrix(batch.column(1), held.length))
            w = held.project(x).astype(object)
            w[w != w] = None
            exact = [str(d) for d in held.deviations(x)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact), pa.array(w.tolist(), pa.list_(pa.float64()))],
                                             ["vec_id", "deviation", "w"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    placed = (rows.filter(F.size("v") == held.length).mapInArrow(place, f"vec_id {id_type}, deviation string, w array<double>")
              .select("vec_id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), F.posexplode("w").alias("at", "whitened")))
    share = (np.where(held.known(), held.values, 0.0) / held.trace).tolist() if held.trace > 0 else [None] * len(held.values)
    shares = F.array(*(F.lit(x).cast("double") for x in share)) if share else F.array().cast("array<double>")
    return placed.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(held.n).cast("long").alias("n"), "deviation", "whitened",
                         F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


@query()
def op13_embedding_whitening(spark, sf_dir):
    found = whitened(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
