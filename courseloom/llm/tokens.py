"""Token ids of whole texts, and the exact histogram of encoded lengths."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courseloom.llm.common import query, step, table

PACKED_BY = "word_bpe_49k.json"
COUNTED_BY = "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    """Place of an installed vocabulary file; a path of one's own goes straight to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a word-level BPE vocabulary, as little-endian unsigned 32-bit numbers.

    The vocabulary splits a text into words first and never merges across them, so the ids of a
    text are the ids of its words. Words are looked up in a bounded table; those not yet in it are
    encoded together in one call, whose ids are cut again after each end of a word. Texts with
    characters whose case or normal form needs context take the tokenizer's own way.
    """

    WORDS_KEPT = 300_000        # size of the word table; it is emptied when full

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        vocab = self.own.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for word, i in vocab.items() if word.endswith("</w>")]] = True
        self.special = tuple(t.content for t in self.own.get_added_tokens_decoder().values())
        plain = [chr(i) for i in (9, 10, 13, *range(32, 127), *range(0xA0, 0x180)) if i != 0x130]
        kinds = {k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k) for k in "LN"}
        blank = "".join(re.escape(c) for c in plain if c.isspace())
        self.plain = re.compile(f"[{''.join(map(re.escape, plain))}]*").fullmatch
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|"
                                f"[^{blank}{kinds['L']}{kinds['N']}]+").findall
        self.known: dict[str, bytes] = {}

    def _slow(self, text: str) -> bytes:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 2000):
            part = words[k:k + 2000]
            ids = np.array(self.own.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = [0, *(4 * (np.nonzero(self.ends[ids])[0] + 1)).tolist()]
            if len(cuts) == len(part) + 1 and cuts[-1] == 4 * len(ids):
                data = ids.tobytes()
                self.known.update(zip(part, map(data.__getitem__, map(slice, cuts, cuts[1:]))))
            else:
                self.known.update((w, self._slow(w)) for w in part)

    def encode(self, text: str) -> bytes:
        if not self.plain(text) or any(s in text for s in self.special):
            return self._slow(text)
        words = self.split(text.lower())
        if len(self.known) > self.WORDS_KEPT:
            self.known.clear()
        if fresh := set(words).difference(self.known):
            self._learn(list(fresh))
        return b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Length in tokens of every whole text (null: empty), one column ``length``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(path, pattern).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t)) if (t := v.as_py()) else 0 for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["length"])

    return docs.select(F.col(text)).mapInArrow(count, "length long")


BLOCK = 64


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Exact histogram of ``length`` with prefix and suffix sums.

    One row per length that occurs. Read as a context limit L = length it answers: ``n_docs`` of
    this length, ``docs_up_to`` and ``docs_from`` (at most, at least L tokens), ``tokens`` in all,
    ``tokens_from`` (in documents of at least L), ``truncated_total`` (tokens left when every
    document is cut at L) and ``share_up_to`` (the quantile: the least L whose share is at least q
    is the q-quantile). Null lengths count as 0. An empty input has no row.

    The documents are aggregated first, with map-side combining, so the sums run over distinct
    lengths only. They run in two levels, inside blocks of BLOCK lengths and over the block
    totals, so that no task holds all lengths however long the longest document is.
    """
    counts = step(lengths.groupBy(F.coalesce("length", F.lit(0)).alias("length"))
                  .agg(F.count("*").alias("n_docs"))
                  .withColumn("block", F.floor(F.col("length") / BLOCK)), "lengths")
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("length") * F.col("n_docs")).alias("t"))
              .select("block", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("d0"),
                      F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t0")))
    whole = counts.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("length") * F.col("n_docs")).alias("tokens"))
    sums = (counts.withColumn("d1", F.sum("n_docs").over(inside))
            .withColumn("t1", F.sum(F.col("length") * F.col("n_docs")).over(inside))
            .join(blocks, "block").join(F.broadcast(whole))           # one row, whatever the input
            .withColumn("docs_up_to", F.col("d0") + F.col("d1")).withColumn("t_up_to", F.col("t0") + F.col("t1")))
    tokens_from = F.col("tokens") - F.col("t_up_to") + F.col("length") * F.col("n_docs")
    return sums.select(
        "length", "n_docs", "docs_up_to", (F.col("docs") - F.col("docs_up_to") + F.col("n_docs")).alias("docs_from"),
        "tokens", tokens_from.alias("tokens_from"),
        (F.col("t_up_to") + F.col("length") * (F.col("docs") - F.col("docs_up_to"))).alias("truncated_total"),
        (F.col("docs_up_to") / F.col("docs")).alias("share_up_to"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The q-quantile of the lengths: the least length with at least this share up to it."""
    return histogram.filter(F.col("share_up_to") >= q).agg(F.min("length").alias("length"))


def truncated(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at ``limit``, which needn't be a length that occurs."""
    kept = F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")
    return histogram.agg(F.coalesce(F.sum(kept), F.lit(0)).alias("tokens"))


@query()
def op5_token_length_histogram(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents", "text")
    return length_histogram(encoded_lengths(docs, vocabulary(COUNTED_BY), public_tokenizers.PATTERN))
