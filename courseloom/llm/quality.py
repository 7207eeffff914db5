"""Quality rules: divergence of a document's histograms from those of its language."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courseloom.llm.common import query, step, table

MIN_WORDS = 20              # base rule: fewer words fail
MAX_REPEAT_PCT = 30         # base rule: more words than this in repeated windows fail
WINDOW = 8                  # words of a window

COMMON_SHARE = 0.004        # a language's common words hold at least this share of its words each
REFERENCE_WORDS = 1000      # languages with fewer words than this in the whole corpus aren't judged by a reference
GUARD_CHARS = 100           # shorter documents aren't judged by their characters
GUARD_WORDS = 40            # nor those with fewer words by their words
MAX_CHAR_DISTANCE = 0.28    # Jensen-Shannon distance, base 2: 0 same, 1 disjoint
MAX_WORD_DISTANCE = 0.20
SLACK = 2.0                 # times the divergence that a sample of the document's size has by chance

# classes of characters, by their UTF-8 lead byte; continuation bytes don't count
CLASSES = ("lower", "upper", "digit", "blank", "stop", "quote", "symbol", "control", "two", "three", "four")
STOPS, QUOTES = b".,;:!?", b"\"'()-"


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 0xC0:
        return 8 + (byte >= 0xE0) + (byte >= 0xF0)
    for k, member in enumerate((c.islower(), c.isupper(), c.isdigit(), byte in b" \t\n\r\x0b\x0c", byte in STOPS,
                                byte in QUOTES, 32 < byte < 127)):
        if member:
            return k
    return 7


CLASS_TABLE = bytes(_class_of(b) if not 0x80 <= b < 0xC0 else 0 for b in range(256))
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
EDGES = STOPS + QUOTES


def char_counts(data: bytes) -> list[int]:
    classes = data.translate(CLASS_TABLE, CONTINUATION)
    return [classes.count(k) for k in range(len(CLASSES))]


def plain_words(data: bytes) -> list[bytes]:
    """Words in lower case (A-Z) without the stops and quotes around them."""
    return [w.strip(EDGES) for w in data.lower().split()]


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text in UTF-8."""
    words = data.split()
    chars = sum(map(len, words)) - len(data) + len(data.translate(None, CONTINUATION))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    repeated = 0
    if len(words) > WINDOW:
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words])
        windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
        twice = _occurs_twice(windows)
        if twice.any():
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, np.nonzero(twice)[0], 1)
            np.add.at(covered, np.nonzero(twice)[0] + WINDOW, -1)
            repeated = int((np.cumsum(covered[:-1]) > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def _occurs_twice(windows: np.ndarray) -> np.ndarray:
    """Which windows are equal to another one: numbered by halves, doubling the length, exactly."""
    ids = windows[:, 0]
    n, width = len(windows) + WINDOW - 1, 1
    ids = np.concatenate([ids, windows[-1, 1:]])
    while width < WINDOW:
        pair = ids[:n - 2 * width + 1] * (int(ids.max()) + 1) + ids[width:n - width + 1]
        ids = np.unique(pair, return_inverse=True)[1]
        width *= 2
    return np.bincount(ids)[ids] > 1


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: the root of the divergence in bits."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return math.sqrt(max(0.0, parts.sum() / 2))


def limit(most: float, bins: int, n: int, of: float = math.inf) -> float:
    """The distance allowed to a document of n characters or words: a sample of n from the
    reference itself has a divergence of (bins - 1) / (8 n ln 2) bits on average, and a reference
    that is a sample of only ``of`` adds its own share."""
    return math.sqrt(most * most + SLACK * (bins - 1) / (8 * math.log(2)) * (1 / n + 1 / of))


class Frequent:
    """Words that may hold at least a share of the words added, in bounded memory: counters, from
    all of which the least is taken away when there are too many. A count is low by ``lost`` at
    most, so every word of that share is among the candidates."""

    KEPT = 1 << 14

    def __init__(self):
        self.counts: Counter = Counter()
        self.lost = self.total = 0

    def add(self, words: list[bytes]) -> None:
        self.counts.update(words)
        self.total += len(words)
        if len(self.counts) > 2 * self.KEPT:
            cut = sorted(self.counts.values(), reverse=True)[self.KEPT]
            self.lost += cut
            self.counts = Counter({w: n - cut for w, n in self.counts.items() if n > cut})

    def candidates(self, share: float) -> list[bytes]:
        return [w for w, n in self.counts.items() if n + self.lost >= share * self.total]


ALL = "*"


def references(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, tuple[np.ndarray, dict[bytes, int]]]:
    """Histograms of every language of the corpus: characters by class, and its common words.

    All documents count, in two passes. A word that holds a share of a language's words holds it in
    some task's part at least, so the first pass needs only each task's own candidates, at most
    1 / COMMON_SHARE for a language; the second counts these exactly. Both are aggregated with
    map-side combining. A language has a reference if it has REFERENCE_WORDS words, however large
    the rest of the corpus is, and a null or empty one never has. What reaches the driver is
    at most 1 / COMMON_SHARE words of each such language from each task, and it keeps as many of
    each language; ALL is what the languages make together, by which no document is judged.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Frequent] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if data := (t.as_py() or "").encode():
                    found.setdefault(name or "", Frequent()).add(plain_words(data))
        rows = [(name, w.decode(), f.total if k == 0 else 0)
                for name, f in found.items() for k, w in enumerate([b"", *f.candidates(COMMON_SHARE)])]
        yield _batch(rows, ["lang", "word", "n"], [pa.string(), pa.string(), pa.int64()])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[Counter, np.ndarray]] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = name if name in known.value else ALL
                if (data := (t.as_py() or "").encode()) and name in known.value:
                    words, chars = seen.setdefault(name, (Counter(), np.zeros(len(CLASSES), np.int64)))
                    mine = plain_words(data)
                    words.update(filter(known.value[name].__contains__, mine))
                    words[b""] += len(mine)
                    chars += char_counts(data)
        rows = [(name, "w", w.decode(), n) for name, (words, _) in seen.items() for w, n in words.items()]
        rows += [(name, "c", str(k), int(n)) for name, (_, chars) in seen.items() for k, n in enumerate(chars)]
        yield _batch(rows, ["lang", "kind", "item", "n"], [pa.string()] * 3 + [pa.int64()])

    texts = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    spark = docs.sparkSession
    seen = step(texts.mapInArrow(first, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "candidates")
    large = seen.filter((F.col("word") == "") & (F.col("lang") != "") & (F.col("n") >= REFERENCE_WORDS)).select("lang")
    words: dict[str, set[bytes]] = {ALL: set()}
    for row in seen.join(F.broadcast(large), "lang").collect():
        words.setdefault(row["lang"], set()).add(row["word"].encode())
    words[ALL] = set().union(*words.values())
    known = spark.sparkContext.broadcast(words)
    counted = (texts.mapInArrow(second, "lang string, kind string, item string, n long")
               .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).collect())
    chars = {name: np.zeros(len(CLASSES)) for name in words}
    found: dict[str, Counter] = {name: Counter() for name in words}
    for row in counted:
        for name in {row["lang"], ALL}:
            if row["kind"] == "c":
                chars[name][int(row["item"])] += row["n"]
            else:
                found[name][row["item"].encode()] += row["n"]
    out = {}
    for name, counts in found.items():
        every = counts.pop(b"", 0)
        out[name] = (chars[name], {b"": every, **{w: n for w, n in sorted(counts.items()) if n >= COMMON_SHARE * every}})
    return out


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


class Judge:
    """Distances of a text from the references of its language."""

    def __init__(self, known: dict[str, tuple[np.ndarray, dict[bytes, int]]]):
        self.known = {}
        for name, (chars, words) in known.items():
            common = [w for w in words if w]
            counts = np.array([words[w] for w in common] + [words[b""] - sum(words[w] for w in common)], float)
            self.known[name] = (np.asarray(chars, float), {w: k for k, w in enumerate(common)}, counts)

    def distances(self, lang: str | None, data: bytes) -> tuple[float | None, float | None, bool]:
        """By characters and by words, null where the document is too short or its language has no
        reference, and whether one is over its limit."""
        if lang == ALL or lang not in self.known:
            return None, None, False
        chars, place, words = self.known[lang]
        mine, counts = plain_words(data), char_counts(data)
        by_char = by_word = None
        far = False
        if (n := sum(counts)) >= GUARD_CHARS:
            by_char = distance(np.array(counts, float), chars)
            far = by_char > limit(MAX_CHAR_DISTANCE, len(counts), n, chars.sum())
        if len(mine) >= GUARD_WORDS:
            hits = [k for w in mine if (k := place.get(w)) is not None]
            histogram = np.bincount(np.array(hits, np.int64), minlength=len(words)).astype(float)
            histogram[-1] = len(mine) - len(hits)
            by_word = distance(histogram, words)
            far = far or by_word > limit(MAX_WORD_DISTANCE, len(words), len(mine), words.sum())
        return by_char, by_word, far


def judge(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with its counts and verdict: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    A document is kept if it passes the base rules and neither its character classes nor its common
    words are further from its language's than the limits (Jensen-Shannon distance), which are
    wider the shorter it is. A document too short for a histogram isn't judged by it, nor is one whose
    language is null or has too few words for a reference: the distance is null and doesn't count. Repeated
    rows are judged each; a null or empty text has no words and fails; extra columns aren't read;
    an empty table gives no row.
    """
    scores = _scored(docs, docs.select("doc_id", lang, text).columns, lang, text)
    return scores.select("doc_id", *MEASURES)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept")


def kept_rows(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. Nothing is shuffled."""
    known = references(docs, lang, text)
    names = docs.columns
    at_lang, at_text = names.index(lang), names.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Judge(known)
        for batch in batches:
            kept = [_measures(of, a, t.as_py())[-1] for a, t in zip(batch.column(at_lang).to_pylist(), batch.column(at_text))]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _measures(of: Judge, lang: str | None, text: str | None) -> tuple:
    data = (text or "").encode()
    counts = base_counts(data)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PCT * counts[0]
    by_char, by_word, far = of.distances(lang, data)
    return *counts, failed, by_char, by_word, not failed and not far


def _scored(docs: DataFrame, names: list[str], lang: str, text: str) -> DataFrame:
    known = references(docs, lang, text)
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Judge(known)
        for batch in batches:
            rows = [_measures(of, a, t.as_py()) for a, t in zip(batch.column(1).to_pylist(), batch.column(2))]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))],
                                             ["doc_id", *MEASURES])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*names).mapInArrow(
        score, f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
               "base_failed boolean, char_distance double, word_distance double, kept boolean")


@query()
def op3_distribution_divergence(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
