"""Toxicity by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseloom.llm.common import query, step, table

SAMPLE = 20_000             # labelled documents the model is fitted on, at most: those with the least hash of doc_id
WORDS = 3_000               # words and beginnings of words of the model
LEAST_DOCS = 5              # documents of the sample a word must be in
LEXICON_SHARE = 0.8         # a word is of the lexicon if this share of its documents is toxic
GRADES = 3                  # clean, mild, severe
TOXIC_OVER = 0.15           # p_toxic from which a document is called toxic; by held-out labels, see the README
RIDGE = 1e-3
ROUNDS = 400
EDGES = ".,;:!?\"'()-#*$%&|<>"
STEMS = (5, 7)              # a longer word also counts as its beginning of so many letters


def words_of(text: str | None) -> list[str]:
    """Words in lower case, without marks around them."""
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


def terms_of(words: list[str]) -> Iterator[tuple[str, int]]:
    """What the model may weigh, with counts: words, and beginnings of words (``stem~``)."""
    for w, n in Counter(words).items():
        yield w, n
        for k in STEMS:
            if len(w) > k:
                yield w[:k] + "~", n


@dataclass
class Model:
    """P(grade <= k) = sigmoid(cut[k] - weights * features): one weight for each word, shared by all
    thresholds, and increasing cuts. Features are log(1 + count)."""

    place: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts: dict[int, int] = {}
        for term, n in terms_of(words):
            if (k := self.place.get(term)) is not None:
                counts[k] = counts.get(k, 0) + n
        at = np.array(sorted(counts), np.int64)
        return at, np.log1p(np.array([counts[k] for k in at.tolist()], float))

    def over(self, words: list[str]) -> np.ndarray:
        """P(grade > k) for every threshold k."""
        at, x = self.features(words)
        return sigmoid(self.weights[at] @ x - self.cuts)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int,
        rounds: int = ROUNDS, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts by maximum likelihood with a ridge, over sparse (row, column, value) entries.
    The cuts are the first one and positive steps, so they stay in order. Adam over full batches."""
    n, steps = len(grades), GRADES - 1
    share = np.array([(grades <= k).mean() for k in range(steps)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(width), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        weights, cuts = theta[:width], _cuts(theta[width:])
        score = np.bincount(rows, weights[columns] * values, n)
        below = np.column_stack([np.zeros(n), *(sigmoid(c - score) for c in cuts), np.ones(n)])
        p = np.maximum(below[np.arange(n), grades + 1] - below[np.arange(n), grades], 1e-9)
        slope = below * (1 - below)
        by_score = (slope[np.arange(n), grades + 1] - slope[np.arange(n), grades]) / p
        by_cut = np.array([((grades == k) * slope[:, k + 1] / p).sum() - ((grades == k + 1) * slope[:, k + 1] / p).sum()
                           for k in range(steps)])
        g = np.concatenate([np.bincount(columns, by_score[rows] * values, width) / n + ridge * weights,
                            -_cut_gradient(by_cut, theta[width:]) / n])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return theta[:width], _cuts(theta[width:])


def _cuts(raw: np.ndarray) -> np.ndarray:
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def _cut_gradient(by_cut: np.ndarray, raw: np.ndarray) -> np.ndarray:
    after = np.cumsum(by_cut[::-1])[::-1]
    return np.concatenate([after[:1], after[1:] * np.exp(raw[1:])])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the model on a bounded sample of the labelled documents.

    Labels say toxic or not; the grade of a toxic document is severe if its share of words of the
    lexicon is over the median of toxic documents, else mild, and the lexicon is the sample's words
    (and beginnings of words) most of whose documents are toxic. Of documents that share an id the one
    of greatest text counts; null ids and labels don't. The sample's ids (at most ``sample``) are sent to the scan of
    the documents; word counts are aggregated on the cluster. The driver gets WORDS words and the
    sample's sparse features. Without toxic or without clean documents nothing is ever toxic.
    """
    spark = docs.sparkSession
    chosen = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most `sample` ids, and one row each: of rows that share an id the greatest text
    texts = step(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
                 .agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")), "sample")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = list({term for term, _ in terms_of(words_of(text.as_py()))})
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([int(toxic)] * len(words), pa.int64())],
                                                 ["word", "toxic"])

    total = texts.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    n, bad = total[0], total[1] or 0
    share = bad / max(n, 1)
    counts = (texts.select("toxic", "text").mapInArrow(spread, "word string, toxic long")
              .groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).filter(F.col("n") >= LEAST_DOCS))
    gap = F.abs(F.col("bad") - F.lit(share) * F.col("n")) / F.sqrt("n")         # how unlike a word of chance it is
    words = counts.orderBy(gap.desc(), "word").limit(WORDS).collect() if 0 < bad < n else []
    place = {r["word"]: k for k, r in enumerate(words)}
    lexicon = frozenset(r["word"] for r in words if r["bad"] >= LEXICON_SHARE * r["n"])
    model = Model(place, np.zeros(len(words)), np.full(GRADES - 1, 40.0))
    if not words:
        return model

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x, rate = [], [], []
            for text in batch.column(1):
                mine = words_of(text.as_py())
                a, v = model.features(mine)
                at.append(a.tolist())
                x.append(v.tolist())
                rate.append(sum(n for term, n in terms_of(mine) if term in lexicon) / max(1, len(mine)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(at, pa.list_(pa.int64())),
                                              pa.array(x, pa.list_(pa.float64())), pa.array(rate, pa.float64())], ["toxic", "at", "x", "rate"])

    # in order, so that the sums of a fit don't depend on the order in which tasks end
    got = (texts.orderBy("doc_id").select(F.col("toxic").cast("long"), "text")
           .mapInArrow(encode, "toxic long, at array<long>, x array<double>, rate double").toArrow())
    toxic, rate = got["toxic"].to_numpy(), got["rate"].to_numpy()
    grades = np.where(toxic == 0, 0, np.where(rate > np.median(rate[toxic > 0]), 2, 1))
    sizes = [len(a) for a in got["at"].to_pylist()]
    rows = np.repeat(np.arange(len(grades)), sizes)
    columns = np.array([k for a in got["at"].to_pylist() for k in a], np.int64)
    values = np.array([v for a in got["x"].to_pylist() for v in a], float)
    weights, cuts = fit(rows, columns, values, grades, len(words))
    return Model(place, weights, cuts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs``: doc_id, severity (the expected grade, 0 to GRADES - 1), p_toxic, grade
    (the likeliest) and toxic (p_toxic over TOXIC_OVER).

    A null or empty text has the severity of a text without known words; repeated rows and null ids
    are scored like any other, extra columns aren't read, an empty table gives no row. The model is
    WORDS weights, sent to all tasks; nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            over = np.array([held.over(words_of(t.as_py())) for t in batch.column(1)]).reshape(-1, GRADES - 1)
            each = -np.diff(np.column_stack([np.ones(len(over)), over, np.zeros(len(over))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(over.sum(axis=1)), pa.array(over[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32)),
                 pa.array(over[:, 0] > TOXIC_OVER)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {id_type}, severity double, p_toxic double, grade int, toxic boolean")


@query()
def op8_ordinal_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
