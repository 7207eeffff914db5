from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from courseloom.llm import tokens
from courseloom.llm.tokens import COUNTED_BY, encoded_lengths, length_histogram, quantile, rank_encoder, truncated, vocabulary


def by_hand(lengths):
    """(length, n_docs, docs_up_to, docs_from, tokens, tokens_from, truncated_total, share_up_to) of every length."""
    n = Counter(lengths)
    return [(x, n[x], sum(k <= x for k in lengths), sum(k >= x for k in lengths), sum(lengths), sum(k for k in lengths if k >= x),
             sum(min(k, x) for k in lengths), sum(k <= x for k in lengths) / len(lengths)) for x in sorted(n)]


TEXTS = [None, "", "", "one two three", "one two three", "é 日本語 😀" * 30, "word " * 5000, "a\n\nb", " ", "x" * 3000] + [f"text {k} " * (k % 9) for k in range(60)]


@pytest.mark.parametrize("block", [64, 3])
def test_histogram_of_texts(docs, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    path = vocabulary(COUNTED_BY)
    encode = rank_encoder(path, public_tokenizers.PATTERN).encode_ordinary
    assert isinstance(rank_encoder(path, public_tokenizers.PATTERN), tiktoken.Encoding)
    lengths = [len(encode(t)) if t else 0 for t in TEXTS]
    rows = docs(list(enumerate(TEXTS)))                                 # with a column of its own named length
    histogram = length_histogram(encoded_lengths(rows, path, public_tokenizers.PATTERN))
    got = [tuple(r) for r in histogram.orderBy("length").collect()]
    assert got == by_hand(lengths)
    for q in (0.0, 0.1, 0.5, 0.9, 0.999, 1.0):
        assert quantile(histogram, q).first()["length"] == next(x for x in sorted(lengths) if sum(k <= x for k in lengths) / len(lengths) >= q)
    for limit in (0, 1, 7, 100, 4096, 10 ** 9):                         # also between the lengths that occur
        assert truncated(histogram, limit).first()["tokens"] == sum(min(k, limit) for k in lengths)


def test_lengths_alone(spark):
    lengths = [None, 0, 5, 5, 70, 10 ** 12, 64, 63, 128]
    histogram = length_histogram(spark.createDataFrame([(x,) for x in lengths], "length long"))
    assert [tuple(r) for r in histogram.orderBy("length").collect()] == by_hand([x or 0 for x in lengths])


def test_empty_table(docs):
    histogram = length_histogram(encoded_lengths(docs([]), vocabulary(COUNTED_BY), public_tokenizers.PATTERN))
    assert histogram.collect() == [] and quantile(histogram, 0.5).first()["length"] is None and truncated(histogram, 10).first()["tokens"] == 0
