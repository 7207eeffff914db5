"""Which dictionary names occur in which texts, without pairing all texts with all names.

A dictionary of up to LETTERS letters in all is one automaton (Aho-Corasick: a trie with links from
each node to the longest other beginning that its letters end with), sent to all tasks: each text is
read once where it lies, and nothing is shuffled.

A larger dictionary is met by equi-joins. Step 1 meets the hash of each position's n-gram with the
distinct (hash, name length) pairs of the dictionary, however many names share the n-gram. Step 2
reads the surviving positions' full substrings and meets them with the names themselves. No step
pairs a text with a name it does not contain, and a hot n-gram costs one row per position and
distinct length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courseloom import values as V
from courseloom.functions.text import exploded
from courseloom.session import importable, written

LETTERS = 400_000           # of a dictionary that is sent to all tasks, at most
SENT_ROWS = 50_000          # occurrences that a task gathers before it passes them on


ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def pieces(text: Column, gram: int) -> Column:
    """The n-grams at all code points of a text, in order.

    A look-ahead match counts UTF-16 units, which are code points unless the text has
    characters beyond the basic plane; such a text is cut into its code points first.
    """
    plain = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{gram}}}))"), F.lit(1))
    cut = F.get(F.transform(F.array(F.split(text, "")), lambda cs: F.when(F.size(cs) >= gram, F.transform(
        F.sequence(F.lit(1), F.size(cs) - gram + 1), lambda p: F.array_join(F.slice(cs, p, gram), "")))), 0)
    found = F.when(F.regexp_like(text, F.lit(ASTRAL)), cut).otherwise(plain)
    return F.coalesce(found, F.array().cast("array<string>"))


def _grams(text: Column, gram: int) -> Column:
    """(head, start) of the n-grams at all code points of a text."""
    return F.transform(pieces(text, gram), lambda g, i: F.struct(F.xxhash64(F.lit(gram), g).alias("head"), i.alias("start")))


def occurrences(texts: DataFrame, keys: list[str], text: str, names: DataFrame, name: str,
                grams: tuple[int, ...] = (V.MIN_NAME,)) -> DataFrame:
    """(keys, name, start, stop, n) of every occurrence; positions count code points from 0.

    Names shorter than the least of ``grams`` are not searched, so that is the shortest name asked
    for; the others only serve the joins, where a name is searched by the longest one that it fills.
    Names are taken once each; their letters are counted before they are sent anywhere.
    """
    grams = tuple(sorted(grams))
    words = written(names.select(F.col(name).alias("name")).where(F.length(name) >= grams[0]).distinct(), "names")
    bodies = texts.select(*keys, F.col(text).alias("_text")).where(F.length("_text") >= grams[0])
    letters = words.agg(F.sum(F.length("name"))).first()[0] or 0
    if letters <= LETTERS:
        return _scanned(bodies, keys, [r["name"] for r in words.collect()])
    return _joined(bodies, keys, words, grams)


def _scanned(bodies: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Occurrences by one pass of each text through the automaton of all names."""
    importable(bodies.sparkSession)
    sent = bodies.sparkSession.sparkContext.broadcast(names)
    fields = [*bodies.select(*keys).schema.fields, T.StructField("name", T.StringType()),
              *(T.StructField(c, T.IntegerType()) for c in ("start", "stop", "n"))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in sent.value:
            automaton.add_word(word, word)
        if not len(automaton):
            return
        automaton.make_automaton()

        def passed(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            ends = [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *ends], [f.name for f in fields])

        for batch in batches:
            rows, found = [], []
            for row, value in enumerate(batch.columns[-1]):
                body = value.as_py()
                for last, word in automaton.iter(body):
                    found.append((word, last + 1 - len(word), last + 1, len(body)))
                    rows.append(row)
                    if len(rows) >= SENT_ROWS:
                        yield passed(batch, rows, found)
                        rows, found = [], []
            if rows:
                yield passed(batch, rows, found)

    return bodies.select(*keys, "_text").mapInArrow(scan, T.StructType(fields))


def _joined(bodies: DataFrame, keys: list[str], words: DataFrame, grams: tuple[int, ...]) -> DataFrame:
    """Occurrences by equi-joins of positions with the dictionary."""
    words = words.withColumn("size", F.length("name"))
    mine = F.lit(grams[0])
    for g in grams[1:]:
        mine = F.when(F.col("size") >= g, g).otherwise(mine)
    heads = words.withColumn("g", mine).select(F.xxhash64("g", F.expr("substring(name, 1, g)")).alias("head"), "size").distinct()

    spots = exploded(bodies, keys, F.concat(*[_grams(F.col("_text"), g) for g in grams]), "_s")
    hits = spots.select(*keys, "_s.head", "_s.start").join(heads, "head").select(*keys, "start", "size").distinct()
    full = (bodies.join(hits, keys)
            .select(*keys, "start", "size", F.length("_text").alias("n"),
                    F.substring(F.col("_text"), F.col("start") + 1, F.col("size")).alias("name")))
    return full.join(words, ["name", "size"]).select(
        *keys, "name", "start", (F.col("start") + F.col("size")).alias("stop"), "n")


def nearest_name(found: DataFrame, keys: list[str], tail_only: bool = False, window: int = V.TAIL_WINDOW, also: list[str] = []) -> DataFrame:
    """The name ending last in each text; of names with the same end, the longest. ``also``: columns of the name."""
    if tail_only:
        found = found.where(F.col("stop") >= F.col("n") - window)
    best = F.max(F.struct("stop", (F.col("stop") - F.col("start")).alias("size"), "name", *also))
    return found.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in ("name", "stop", *also)])


def contains_known(titles: DataFrame, title: str, known: DataFrame, name: str,
                   part_min: int = V.PARTIAL_MIN) -> DataFrame:
    """Distinct titles that are known: equal to a known name, or long enough and inside one.

    A cut-off title (known name starts with it) is also inside that name, and the length
    needed for it is larger, so containment covers it.
    """
    t = titles.select(F.col(title).alias("title")).distinct()
    k = known.select(F.col(name).alias("known")).distinct()
    inside = occurrences(k, ["known"], "known", t, "title", (part_min,)).select(F.col("name").alias("title"))
    equal = t.join(k, t["title"] == k["known"], "left_semi")
    return inside.union(equal).distinct()
