"""Line dedup over a whole corpus, with an edit bound, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom.llm.common import query, step, table

EDITS = 1                   # the edit bound, in code points; the halves and the check are made for one
AROUND = " \t\r"            # white space around a line, which isn't compared


def split_lines(text: Column | str) -> Column:
    return F.split(text, "\n")


def lines_of(docs: DataFrame) -> DataFrame:
    """The lines that aren't blank: doc_id, the 128-bit digest (d1, d2) of the document's row, pos,
    line, and the 128-bit digest (h1, h2) of the line."""
    found = docs.select("doc_id", *row_digest(), F.posexplode(split_lines("text")).alias("pos", "line"))
    found = found.withColumn("line", F.btrim("line", F.lit(AROUND))).filter("line <> ''")
    return found.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def row_digest() -> tuple[Column, Column]:
    return F.xxhash64("doc_id", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("d2")


def place() -> Column:
    """Where a line stands: by doc_id (null last), then the row, then the line's number."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "d1", "d2", "pos")


def half(n: Column) -> Column:
    """Length of the half that is compared as a whole: at most half of n - 1, and the same for most
    neighbouring lengths; in finer steps for short lines, so that they don't all share one half."""
    return (F.when(n > 16, F.floor((n - 1) / 16) * 8).when(n > 4, F.floor((n - 1) / 4) * 2)
            .when(n > 2, F.lit(1)).otherwise(F.lit(0)).cast("int"))


def halves(line: Column) -> Column:
    """Keys of a line's intact halves. One edit leaves the beginning or the end of this length as it
    is; a line whose length begins a new step takes part with the step before, too."""
    n = F.length(line)

    def both(h: Column) -> list[Column]:
        return [F.struct(F.xxhash64(F.lit("b"), h, F.left(line, h)).alias("half"), h.alias("h"), F.lit(True).alias("front")),
                F.struct(F.xxhash64(F.lit("e"), h, F.right(line, h)).alias("half"), h.alias("h"), F.lit(False).alias("front"))]

    now, before = both(half(n)), both(half(n - 1))
    return F.when(half(n) == half(n - 1), F.array(*now)).otherwise(F.array(*now, *before))


def common_front(a: Column, b: Column) -> Column:
    """Length of the common beginning of two texts, by halving steps: linear for each step, where
    the built-in distance is quadratic on long lines."""
    n = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.floor(F.log2(n)).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, F.lit(0), lambda at, by: F.when(
        (at + by <= n) & (F.left(a, at + by) == F.left(b, at + by)), at + by).otherwise(at))


def within_one(a: Column, b: Column, front: Column) -> Column:
    """Whether one edit makes one text the other, given the length of their common beginning: what
    follows the edited code point must be equal."""
    m, n = F.length(a) - front, F.length(b) - front
    return (F.abs(m - n) <= 1) & F.when(m == n, F.right(a, m - 1) == F.right(b, n - 1)).when(
        m > n, F.right(a, m - 1) == F.right(b, n)).otherwise(F.right(a, m) == F.right(b, n - 1))


def letters_of(text: Column) -> Column:
    """A 40-bit hash of each code point, so that sums of millions of them don't overflow."""
    return F.transform(F.split(text, ""), lambda c: F.shiftrightunsigned(F.xxhash64(c), 24))


def near_pairs(lines: DataFrame, marks: DataFrame, firsts: DataFrame) -> DataFrame:
    """For every line with an earlier one within the edit bound, pairs (later, earlier) of such
    first occurrences, the earliest one among them.

    1. Halves: a line can only have a neighbour if it shares one of its halves with another line.
       That costs two keys a line, and drops all but a few lines.
    2. Letters: the edit lies outside the shared half. What is left of the other half after deleting
       up to EDITS code points is first keyed without order, by the half, the length left and the sum
       of the letters' hashes: a line has as many keys as it has different letters, and only keys
       that two lines have go on.
    3. Deletion neighbourhood: the variants behind those keys, with order. Lines that agree once the
       code point at one place is deleted are all within one edit of each other, and a whole line is
       within one of each line that has it as a variant. So a variant that many lines share (a
       template with a number in it) needs its earliest lines only, found by aggregation: never are
       all pairs of a group made.
    4. The edit distance of each remaining pair is verified on the lines.
    """
    line_id = ["h1", "h2"]
    keyed = marks.select(*line_id, F.explode("halves").alias("k")).select(*line_id, "k.half", "k.h", "k.front")
    common = step(keyed.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high"))
                  .filter("low <> high").select("half"), "halves")
    asked = step(keyed.join(common, "half", "left_semi").distinct(), "asked")
    homes = firsts.join(asked.select(*line_id).distinct(), line_id, "left_semi").select(*line_id, "first", "first.*")
    texts = step(lines.select("d1", "d2", "pos", "line").join(homes, ["d1", "d2", "pos"]).select(*line_id, "first", "line")
                 .dropDuplicates(line_id), "texts")

    rest = F.length("line") - F.col("h")
    other = F.when(F.col("front"), F.right("line", rest)).otherwise(F.left("line", rest)).alias("other")
    spelled = (asked.join(texts, line_id).select(*line_id, "half", "h", "front", rest.alias("m"), letters_of(other).alias("letters"))
               .select(*line_id, "half", "h", "front", "m", F.aggregate("letters", F.lit(0).cast("long"), lambda a, w: a + w).alias("total"),
                       F.array_distinct("letters").alias("letters")))
    nothing = F.array(F.struct(F.col("m").alias("left"), F.col("total").alias("sum"), F.lit(None).cast("long").alias("letter")))
    one = F.transform("letters", lambda w: F.struct((F.col("m") - EDITS).alias("left"), (F.col("total") - w).alias("sum"), w.alias("letter")))
    bags = step(spelled.select(*line_id, "half", "h", "front", F.explode(F.concat(nothing, one)).alias("v"))
                .select(F.xxhash64("half", "v.left", "v.sum").alias("bag"), *line_id, "half", "h", "front", "v.letter"), "bags")
    met = step(bags.groupBy("bag").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low <> high").select("bag"), "met")
    live = bags.join(met, "bag", "left_semi")

    members = step(variants(live.join(texts, line_id).select("half", "letter", "first", other)), "variants")
    first_whole = F.min(F.when(F.col("p") == 0, F.col("first")))
    first_cut = F.min(F.when(F.col("p") > 0, F.col("first")))
    alike = step(members.groupBy("k1", "k2", "p").agg(F.min("first").alias("earlier")).filter("p > 0"), "alike")
    inside = step(members.groupBy("k1", "k2").agg(first_whole.alias("whole"), first_cut.alias("cut"))
                  .filter("whole is not null and cut is not null"), "inside")
    replaced = members.join(alike, ["k1", "k2", "p"]).select(F.col("first").alias("later"), "earlier")
    inserted = members.join(inside, ["k1", "k2"]).select(
        F.col("first").alias("later"), F.when(F.col("p") == 0, F.col("cut")).otherwise(F.col("whole")).alias("earlier"))
    pairs = replaced.union(inserted).filter("earlier < later").distinct()
    text = texts.select("first", "line")
    a, b = F.col("line"), F.col("earlier_line")
    return (pairs.join(text.toDF("later", "line"), "later").join(text.toDF("earlier", "earlier_line"), "earlier")
            .filter(F.get(F.transform(F.array(common_front(a, b)), lambda front: within_one(a, b, front)), 0))   # found once
            .select("later", "earlier"))


GRID = 512                  # a variant is hashed in a window of less than twice this; the rest is hashed once a line


def variants(rows: DataFrame) -> DataFrame:
    """Variants of ``other``: with one ``letter`` deleted at each place p where it stands, or, where
    letter is null, the whole (p = 0): k1 and k2 (a 128-bit key), p, first.

    A key is made of the hashes of what lies before and after a window around p, whose borders are
    at multiples of GRID from either end, and of the window without p. So a long line costs its
    length for each window, not for each place. The whole takes part with every window that a line
    one longer may have.
    """
    m, s, t, p = F.col("m"), F.col("at.s"), F.col("at.t"), F.col("p")
    grid = lambda n: F.floor(n / GRID).cast("int") * GRID
    places = m + F.col("letter").isNull().cast("int")       # the whole is looked at from a line one longer
    borders = F.sequence(F.lit(0), m, F.lit(GRID))
    # places at which a border moves: every GRID of them from the front, and from the back
    turns = F.filter(F.concat(F.sequence(F.lit(1), F.greatest(places, F.lit(1)), F.lit(GRID)), F.transform(
        F.sequence(F.lit(0), F.floor(places / GRID).cast("int")), lambda j: places - j * GRID + 1)), lambda k: (k >= 1) & (k <= places))
    windows = F.array_distinct(F.transform(turns, lambda k: F.struct(grid(k - 1).alias("s"), grid(places - k).alias("t"))))
    cut = F.filter(F.transform(letters_of(F.col("w")), lambda c, i: F.when(
        (c == F.col("letter")) & (grid(s + i) == s) & (grid(m - s - i - 1) == t), s + i + 1)), lambda k: k.isNotNull())
    spots = (rows.withColumn("m", F.length("other")).filter("m > 0 or letter is null")
             .withColumn("before", F.transform(borders, lambda k: F.xxhash64(F.left("other", k))))
             .withColumn("after", F.transform(borders, lambda k: F.xxhash64(F.right("other", k))))
             .select("half", "letter", "first", "m", "other", "before", "after", F.explode(windows).alias("at"))
             .select("half", "letter", "first", "m", "at", F.get("before", F.floor(s / GRID).cast("int")).alias("x"),
                     F.get("after", F.floor(t / GRID).cast("int")).alias("y"), F.substring("other", s + 1, m - s - t).alias("w"))
             .select("half", "first", "m", "at", "x", "y", "w",
                     F.explode(F.when(F.col("letter").isNull(), F.array(F.lit(0))).otherwise(cut)).alias("p")))
    w = F.when(p == 0, F.col("w")).otherwise(F.concat(F.left("w", p - s - 1), F.right("w", F.length("w") - p + s)))
    parts = ["half", m - (p > 0).cast("int"), s, t, "x", "y", w]
    return spots.select(F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2"), "p", "first")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Every line that repeats an earlier one, equal or within the edit bound: doc_id, d1, d2, pos
    (from 0), distance, earlier_doc_id, earlier_pos.

    The earliest line stays: one goes if there is an earlier line within the bound, be that line
    kept or not; the one given is the earliest of those at the least distance. Lines of any length are
    compared, without white space around them, so all lines of one letter are within the bound of each
    other. Blank lines and lines of null or empty texts are never repeated. Rows that repeat doc_id and text are one
    document. Documents without an id come last. Extra columns aren't read, and an empty table gives
    no row.

    One pass over the texts writes each line's digest and half keys, and all but the last check works
    on these. Equal lines are folded by their digest, with map-side combining, so a line that a third
    of all documents have is one line; its occurrences find the first by an equi-join of written
    tables, which adaptive execution splits. Texts are shuffled once, and only the lines that share a
    half with another one are compared.
    """
    lines = lines_of(docs)
    marks = step(lines.select("doc_id", "d1", "d2", "pos", "h1", "h2", halves(F.col("line")).alias("halves")), "marks")
    firsts = step(marks.groupBy("h1", "h2").agg(F.min(place()).alias("first"), F.count("*").alias("n")), "firsts")
    again = firsts.filter("n > 1").select("h1", "h2", "first")
    equal = (marks.select("h1", "h2", place().alias("place")).join(again, ["h1", "h2"]).filter("place <> first")
             .select("place", F.lit(0).alias("distance"), F.col("first").alias("earlier")))
    near = (near_pairs(lines, marks, firsts.select("h1", "h2", "first")).groupBy(F.col("later").alias("place"))
            .agg(F.min("earlier").alias("earlier")).select("place", F.lit(EDITS).alias("distance"), "earlier"))
    return equal.union(near).select("place.doc_id", "place.d1", "place.d2", "place.pos", "distance",
                                    F.col("earlier.doc_id").alias("earlier_doc_id"), F.col("earlier.pos").alias("earlier_pos"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their own columns, and texts without the lines that repeat an
    earlier one; a text that has none of these is as it was, a null stays null. A document all of
    whose lines are repeated has the empty text. If the table has n_chars, it follows the text."""
    gone = step(repeated_lines(docs).distinct().groupBy("d1", "d2").agg(F.collect_list("pos").alias("__gone")), "gone")
    d1, d2 = row_digest()
    marked = docs.withColumns({"__d1": d1, "__d2": d2})
    joined = marked.join(gone.withColumnsRenamed({"d1": "__d1", "d2": "__d2"}), ["__d1", "__d2"], "left")
    # the outer transform binds the split text once, so it isn't split again for every line
    kept = F.transform(F.array(split_lines("text")), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.get(kept, 0))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


SQL_LINES = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, trim(unnest(l), ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
firsts AS (
  SELECT line, min({'d': doc_id, 'p': pos}) AS f, length(line) AS n FROM lines WHERE line <> '' GROUP BY line),
cuts AS (
  SELECT line, f, n, p, hash(substr(line, 1, p - 1) || substr(line, p + 1)) AS h
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM firsts)),
pairs AS (
  SELECT b.f AS later, a.f AS earlier FROM cuts a JOIN cuts b ON a.h = b.h AND a.p = b.p AND a.n = b.n
  WHERE a.f < b.f AND a.line <> b.line
    AND substr(a.line, 1, a.p - 1) || substr(a.line, a.p + 1) = substr(b.line, 1, b.p - 1) || substr(b.line, b.p + 1)
  UNION
  SELECT greatest(a.f, b.f), least(a.f, b.f) FROM cuts a JOIN firsts b ON a.h = hash(b.line)
  WHERE a.n = b.n + 1 AND substr(a.line, 1, a.p - 1) || substr(a.line, a.p + 1) = b.line)
SELECT doc_id, pos AS line_no, 0 AS distance, f.d AS earlier_doc_id, f.p AS earlier_line_no
FROM lines JOIN firsts USING (line) WHERE {'d': doc_id, 'p': pos} <> f
UNION ALL
SELECT later.d, later.p, 1, min(earlier).d, min(earlier).p FROM pairs GROUP BY later
"""


@query(SQL_LINES)
def op9_deletion_neighbourhood(spark, sf_dir):
    found = repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.col("pos").alias("line_no"), "distance", "earlier_doc_id",
                        F.col("earlier_pos").alias("earlier_line_no"))
