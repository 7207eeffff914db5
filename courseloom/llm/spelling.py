"""Spelling variants of a corpus's words: words one edit apart, found by a bit-sliced position index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom.llm.common import drop_step, partitions, query, step, table

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LETTERS = 6           # of a word
LEAST_COUNT = 5             # occurrences of a word in the corpus
MORE = 5                    # a form is at least so many times as frequent as the word
ALTERED = 199               # one of so many runs, by checksum, loses a letter before it is counted

SHARD = 1024                # words a shard is meant to hold
GROUP = 2048                # a group of more words is split
PARTS = 3                   # places for the edit that a word is keyed by
BLOCK_WORDS, BLOCK_LETTERS = 4096, 1 << 16      # words and letters of an index, at most (but a longer word)
ASKED_BITS = 1 << 22        # bits of a set that are worked on at a time


def runs(docs: DataFrame, altered: int | None = None) -> DataFrame:
    """``word``: every run of letters of whole texts, A-Z in lower case, that can be a word.

    With ``altered``, a run whose CRC-32 of "doc_id:run" is divisible by it loses the letter at that
    number modulo its length; runs of documents without an id stay as they are. Null texts have none.
    """
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{LEAST_LETTERS},}})"), F.lit(1))).alias("run"))
    plain = F.octet_length("run") == F.length("run")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = found.select("doc_id", F.when(plain, F.lower("run")).otherwise(F.translate("run", upper, upper.lower())).alias("run"))
    if not altered:
        return found.select(F.col("run").alias("word"))
    mark = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (F.col("mark") % F.length("run")).cast("int")
    less = F.concat(F.left("run", at), F.substring("run", at + 2, F.length("run")))
    return found.select("run", mark.alias("mark")).select(F.when(F.col("mark") % altered == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words that are long and frequent enough, counted with map-side combining."""
    return (words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= least_count))


class PositionIndex:
    """For each (position, letter) the set of the vocabulary's words that have this letter there, a
    bit a word; and a set for each length. A query goes through the sets letter by letter:

        exact      words equal to the query so far
        replaced   words with one other letter so far
        longer     words with one letter more so far: they are looked up one position further on
        shorter    words with one letter less so far: looked up one position before

    so that one operation on a machine word moves 64 words of the vocabulary on.
    """

    def __init__(self, words: list[np.ndarray]):
        sizes = np.array([len(w) for w in words])
        self.width = (len(words) + 63) // 64
        at = np.concatenate([np.arange(n) for n in sizes])
        self.spots, rows = np.unique(at << 21 | np.concatenate(words), return_inverse=True)
        member = np.repeat(np.arange(len(words)), sizes)
        self.bits = np.zeros((len(self.spots) + 1, self.width), np.uint64)      # the last one is empty
        np.bitwise_or.at(self.bits, (rows, member >> 6), np.uint64(1) << (member & 63).astype(np.uint64))
        self.lengths = {}
        for n in np.unique(sizes):
            which = np.zeros(self.width * 64, np.uint8)
            which[:len(words)] = sizes == n
            self.lengths[int(n)] = np.packbits(which, bitorder="little").view("<u8")

    def having(self, letters: np.ndarray, position: int) -> np.ndarray:
        """The words with these letters at the position, a row a letter."""
        spot = position << 21 | letters
        at = np.minimum(np.searchsorted(self.spots, spot), len(self.spots) - 1)
        return self.bits[np.where((self.spots[at] == spot) & (position >= 0), at, len(self.spots))]

    def one_edit(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the queries (a row of letters each, all of one length) and of the words that are
        exactly one replaced, more or missing letter apart."""
        many, length = queries.shape
        none = np.zeros(self.width, np.uint64)
        if not any(length + k in self.lengths for k in (-1, 0, 1)):
            return np.zeros(0, int), np.zeros(0, int)
        exact = np.full((many, self.width), ~np.uint64(0))
        replaced, longer, shorter = (np.zeros((many, self.width), np.uint64) for _ in range(3))
        for k in range(length):
            letters = queries[:, k]
            here = self.having(letters, k)
            longer = (longer | exact) & self.having(letters, k + 1)
            shorter = shorter & self.having(letters, k - 1) | exact
            replaced = replaced & here | exact & ~here
            exact &= here
        found = (replaced & self.lengths.get(length, none) | (longer | exact) & self.lengths.get(length + 1, none)
                 | shorter & self.lengths.get(length - 1, none))
        return np.nonzero(np.unpackbits(found.astype("<u8").view(np.uint8), axis=1, bitorder="little"))


def one_edit_pairs(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (a, b) of all different words exactly one edit apart, in both orders: the words in blocks
    by length, each an index that all words of neighbouring lengths are looked up in."""
    codes = [np.frombuffer(w.encode("utf-32-le"), "<u4").astype(np.int64) for w in words]
    sizes = np.array([len(c) for c in codes])
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        letters = np.cumsum(sizes[order[start:start + BLOCK_WORDS]])
        held = order[start:start + max(1, int(np.searchsorted(letters, BLOCK_LETTERS, "right")))]
        start += len(held)
        if not sizes[held].any():
            continue                                    # the empty word, which no word of two letters is near
        index = PositionIndex([codes[k] for k in held])
        for n in range(max(1, sizes[held[0]] - 1), sizes[held[-1]] + 2):
            asked = np.nonzero(sizes == n)[0]
            batch = max(1, min(ASKED_BITS // (64 * index.width), BLOCK_LETTERS * 8 // n))
            for k in range(0, len(asked), batch):
                some = asked[k:k + batch]
                a, b = index.one_edit(np.stack([codes[w] for w in some]))
                yield some[a], held[b]


def _keys(parts_of: Column, a: Column, b: Column, base: Column) -> Column:
    """Keys of a word by what is left and right of a place for the edit; the place between a and b
    letters from the ends of a word of ``base`` letters is cut into parts, one key each."""
    gap = base - a - b

    def key(j: Column) -> Column:
        left = a + F.floor(j * gap / parts_of).cast("int")
        right = b + gap - F.floor((j + 1) * gap / parts_of).cast("int")
        return F.struct(base.alias("base"), left.alias("a"), right.alias("b"),
                        F.xxhash64(base, left, right, F.left("word", left), F.right("word", right)).alias("key"))

    return F.transform(F.sequence(F.lit(0), parts_of - 1), key)


def keyed(vocab: DataFrame, group: int) -> DataFrame:
    """word, n, key: words one edit apart have a key in common.

    The edit lies in one of PARTS places of the shorter word (or of both); what is left and right of it
    is the same in both words, and is the key. A word is keyed as the shorter and as the longer one.
    A group of more than ``group`` words with one key is keyed again by parts of its place, and so on
    down to a place of one letter, where the alphabet bounds the group.
    """
    size = F.length("word")
    whole = F.flatten(F.transform(F.array(size, size - 1), lambda base: _keys(
        F.least(F.lit(PARTS), F.greatest(base, F.lit(1))), F.lit(0), F.lit(0), base)))
    now = vocab.select("word", "n", F.explode(whole).alias("k")).select("word", "n", "k.*")
    done = None
    while True:
        splits = now.filter(F.col("base") - F.col("a") - F.col("b") > 1)
        large = step(splits.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > group).select("key"), "large")
        some = not large.isEmpty()
        kept = now.join(large, "key", "left_anti") if some else now
        done = kept if done is None else done.unionByName(kept)
        if not some:
            return done.select("word", "n", "key")
        gap = F.col("base") - F.col("a") - F.col("b")
        parts = _keys(F.least(F.lit(PARTS), gap), F.col("a"), F.col("b"), F.col("base"))
        now = step(now.join(large, "key", "left_semi").select("word", "n", F.explode(parts).alias("k")).select("word", "n", "k.*"), "split")


def near_words(vocab: DataFrame) -> DataFrame:
    """word, near, near_n: every word with each word that is exactly one inserted, deleted or replaced
    code point apart; both orders, once each.

    ``vocab`` has each word once, with n. Whole groups of words with equal keys are dealt to shards of
    about SHARD words by the key's hash, so a word is compared with a few shards of the vocabulary, not
    with all of it. In a shard the position index finds the pairs.
    """
    spark = vocab.sparkSession
    shards = max(1, vocab.count() * 2 * PARTS // SHARD)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(rows)
            keys = held["key"].to_numpy()
            _, group, members = np.unique(keys, return_inverse=True, return_counts=True)
            found = held.filter(pa.array(members[group] > 1))
            counts = dict(zip(found["word"].to_pylist(), found["n"].to_numpy()))
            words, n = pa.array(counts, pa.string()), np.fromiter(counts.values(), np.int64, len(counts))
            for a, b in one_edit_pairs(list(counts)):
                yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), words.take(pa.array(b)), pa.array(n[b])], ["word", "near", "near_n"])

        now, rows = None, []
        for batch in batches:
            shard = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.nonzero(shard[1:] != shard[:-1])[0] + 1
            for k, end in zip([0, *cuts], [*cuts, len(shard)]):
                if k < end:
                    if rows and shard[k] != now:
                        yield from pairs(rows)
                        rows = []
                    now = shard[k]
                    rows.append(batch.slice(k, end - k))
        if rows:
            yield from pairs(rows)

    dealt = (keyed(vocab, GROUP).select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "word", "n")
             .repartition(partitions(spark), "shard").sortWithinPartitions("shard"))
    return dealt.mapInArrow(compare, "word string, near string, near_n long").distinct()


def forms(vocab: DataFrame, more: int = MORE) -> DataFrame:
    """Every word of ``vocab`` (word, n): form, root, n, n_near, form_n.

    The form is the near word of greatest n (of equals, the least by code points), if it is at least
    ``more`` times as frequent, else null. The root is where the forms end, the word itself if it has
    none; forms only rise in n, so they never go round. A word without near words has n_near 0; an
    empty vocabulary gives no row.

    Roots are found by doubling: in each round every word learns the root of its root, so a chain of
    k forms takes log2(k) rounds of an equi-join of written tables.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    around = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = -F.col("best.n") >= more * F.col("n")
    found = step(vocab.join(around, "word", "left").select(
        "word", F.when(known, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(known, -F.col("best.n")).alias("form_n")), "forms")
    links = step(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = step(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_step(links)
        links = after.select("word", "root")
        if after.filter("moved").isEmpty():
            break
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, altered: int | None = None) -> DataFrame:
    """Spelling variants of the words of whole texts, as ``forms`` gives them.

    Words are runs of letters of at least LEAST_LETTERS code points that occur at least LEAST_COUNT
    times. Null and empty texts have no words, repeated rows count as often as they stand, a null
    doc_id counts like any other, extra columns aren't read, and an empty table gives no row. A run of
    any length is one word.
    """
    return forms(step(vocabulary(runs(docs.select("doc_id", "text"), altered)), "words"))


@query()
def op11_spelling_variants(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents", "doc_id", "text"), ALTERED)
