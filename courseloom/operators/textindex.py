"""Keyword search by an inverted index of three-letter grams.

A text has a word if it has all of the word's grams and, checked on the text itself, the word. Texts
are numbered as they are stored, folded, once; GROUP neighbours are a group. The index is a table of
(gram, group, mask) rows, a bit of the mask for each text of the group, so a common gram has a row a
group instead of one a text. It is dealt out by gram and sorted: a query reads the list of each
word's rarest gram, which stands in one file. Groups lie in buckets, and only buckets with hits are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courseloom.operators.facets import all_words, keyword_words

GRAM = 3
LISTS = 3                   # posting lists that a query intersects before it looks at texts
BUCKETS = 32
GROUP = 64                  # texts in a group, a bit each
POSTINGS = "gram string, group bigint, mask bigint"
BLOCK = 1 << 20             # letters that a task looks at together, about


def bucket(group: str) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(BUCKETS)).cast("int")


def _gram_masks():
    # inner functions travel to the executors by value: they need not have this package
    gram, block, limit = GRAM, BLOCK, 1 << 62

    def row_batch(grams: pa.Array, groups: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([grams, pa.array(groups, pa.int64()), pa.array(masks.view(np.int64), pa.int64())], names=["gram", "group", "mask"])

    def strings(codes: np.ndarray) -> pa.Array:
        """Rows of code points as strings; by their bytes, since numpy's own strings lose a NUL at the end."""
        flat = codes.astype("<u4").ravel()
        data = flat.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        n_bytes = (1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)).reshape(codes.shape).sum(axis=1)
        offsets = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(n_bytes, out=offsets[1:])
        return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(data))

    def masked(texts: list[str], groups: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each gram of each group; the letters in use are numbered, so that a text and its gram are one number."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.array([len(t) for t in texts])
        used = np.zeros(0x110000, bool)
        used[codes] = True
        letters = np.flatnonzero(used)
        a = len(letters)
        if len(texts) > 1 and len(texts) * a ** gram >= limit:
            half = len(texts) // 2
            yield from masked(texts[:half], groups[:half], bits[:half])
            yield from masked(texts[half:], groups[half:], bits[half:])
            return
        number = np.zeros(0x110000, np.int64)
        number[letters] = np.arange(a)
        numbers, n = number[codes], len(codes) - gram + 1
        spots = np.repeat(np.arange(len(texts)), lengths)[:n]
        for k in range(gram):
            spots = spots * a + numbers[k:n + k]
        inside = np.ones(len(codes), bool)              # a gram ends in its own text
        for k in range(1, gram):
            inside[np.cumsum(lengths) - k] = False
        spots = np.sort(spots[inside[:n]])               # np.unique hashes, which takes longer
        spots = spots[np.r_[True, spots[1:] != spots[:-1]]]
        text, spot = np.divmod(spots, a ** gram)
        own, group = np.unique(groups[text], return_inverse=True)
        order = np.argsort(group * a ** gram + spot, kind="stable")
        group, spot, bit = group[order], spot[order], bits[text[order]]
        first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (spot[1:] != spot[:-1])])
        masks, group, spot = np.bitwise_or.reduceat(bit, first), group[first], spot[first]
        points = letters[np.stack([spot // a ** k % a for k in reversed(range(gram))], axis=1)]
        yield row_batch(strings(points), own[group], masks)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch["search_text"].cast(pa.binary()).to_pylist()]
            groups = batch["group"].to_numpy()
            bits = np.uint64(1) << batch["place"].to_numpy().astype(np.uint64)
            short = np.array([len(t) < gram for t in texts], bool)
            if short.any():                             # a shorter text is its own gram
                yield row_batch(pa.array([texts[i] for i in np.flatnonzero(short)], pa.string()), groups[short], bits[short])
            kept = np.flatnonzero(~short)
            cuts = np.cumsum([len(texts[i]) for i in kept]) // block
            for part in np.split(kept, np.flatnonzero(cuts[1:] != cuts[:-1]) + 1) if len(kept) else []:
                yield from masked([texts[i] for i in part], groups[part], bits[part])

    return rows


class TextIndex:
    """An index of ``search_text`` by one key column of type ``kind``, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str = "bigint") -> None:
        self.spark, self.path, self.key, self.kind = spark, path, key, kind

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def build(self, texts: DataFrame, partitions: int | None = None) -> "TextIndex":
        """Write texts, posting lists and the grams' numbers of texts; ``texts`` has the key, unique, and
        ``search_text`` as ``facets.with_search_text`` folds it. NULL and empty texts have no word."""
        # numbered before they are filtered: a filter below would fold every text a second time
        kept = texts.select(self.key, "search_text").withColumn("_id", F.monotonically_increasing_id()).where("search_text <> ''")
        kept = kept.select(self.key, "search_text", F.floor(F.col("_id") / GROUP).alias("group"), (F.col("_id") % GROUP).cast("int").alias("place"))
        kept.withColumn("bucket", bucket("group")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/texts")
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # read from its file: the numbers hold from there on
        found = self.texts().select("search_text", "group", "place").mapInArrow(_gram_masks(), POSTINGS)
        lists = found.repartition(n, "gram").groupBy("gram", "group").agg(F.bit_or("mask").alias("mask"))
        lists.sortWithinPartitions("gram", "group").write.mode("overwrite").parquet(f"{self.path}/postings")
        counts = self.lists().groupBy("gram").agg(F.sum(F.bit_count("mask")).alias("n"))
        counts.repartitionByRange(max(1, n // 4), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/grams")
        return self

    def texts(self) -> DataFrame:
        return self._read("texts", f"`{self.key}` {self.kind}, search_text string, group bigint, place int, bucket int")

    def lists(self) -> DataFrame:
        return self._read("postings", POSTINGS)

    def postings(self) -> DataFrame:
        """(key, gram), a row for each different gram of a text."""
        rows = self.texts().select(self.key, "group", "place").join(self.lists(), "group")
        return rows.where(F.getbit("mask", "place") == 1).select(self.key, "gram")

    def grams(self) -> DataFrame:
        return self._read("grams", "gram string, n bigint")

    def _found(self, words: list[str]) -> DataFrame | None:
        """(group, mask) of the texts that may have all words; None if that is all texts.

        Of each word of GRAM letters or more the rarest gram counts, of these the LISTS rarest lists are
        met by the group. A shorter word is in every gram that holds it, and these lists are united; that
        is asked only where no longer word narrows the search.
        """
        long = [w for w in words if len(w) >= GRAM]
        if long:
            wanted = {w: {w[i:i + GRAM] for i in range(len(w) - GRAM + 1)} for w in long}
            every = sorted(set().union(*wanted.values()))
            n = {r["gram"]: r["n"] for r in self.grams().where(F.col("gram").isin(every)).collect()}    # a query's own grams
            rarest = {min(own, key=lambda g: (n.get(g, 0), g)) for own in wanted.values()}
            lists = [self.lists().where(F.col("gram") == g).select("group", "mask") for g in sorted(rarest, key=lambda g: (n.get(g, 0), g))[:LISTS]]
        elif words:
            # grams hold what stands inside a text; a text shorter than a gram is one itself
            lists = [self.lists().where(F.contains("gram", F.lit(w))).groupBy("group").agg(F.bit_or("mask").alias("mask")) for w in words[:LISTS]]
        else:
            return None
        found = lists[0]
        for more in lists[1:]:
            both = found.join(more.withColumnRenamed("mask", "_more"), "group")
            found = both.select("group", F.col("mask").bitwiseAND(F.col("_more")).alias("mask")).where("mask <> 0")
        return found

    def _marked(self, found: DataFrame) -> DataFrame:
        """The stored texts whose bit is set."""
        return self.texts().join(found.withColumn("bucket", bucket("group")), ["bucket", "group"]).where(F.getbit("mask", "place") == 1)

    def hits(self, words: list[str]) -> DataFrame | None:
        """Keys that may have all words, without a look at the texts; None if that is all keys."""
        found = self._found(words)
        return None if found is None else self._marked(found).select(self.key)

    def search(self, text: str) -> DataFrame:
        """Rows (key, search_text) with every word of the query, compared as ``facets`` folds them."""
        words = list(dict.fromkeys(keyword_words(text)))
        found = self._found(words)
        texts = self.texts() if found is None else self._marked(found).where(all_words(F.col("search_text"), words))
        return texts.select(self.key, "search_text")
