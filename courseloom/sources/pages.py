"""Landed pages and tables inside them: listings, cells, grids, lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.html import cell_text, cut_body, html_to_text, updated_at_of
from courseloom.functions.text import collapse, exploded
from courseloom.operators.ordered import fill_down


HEAD = 8                    # letters of a title that a line is looked up by, at most
HINTS = 1024                # numbers that the beginnings of a page's titles are told apart by


def read_pages(spark: SparkSession, path: str, charset: str = "UTF-8", pattern: str = "*.html") -> DataFrame:
    """Landed page files as (path, modified, html). Bytes that the charset lacks are replaced."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", F.col("modificationTime").alias("fetched_at"), F.col("length").alias("bytes"),
                      F.decode("content", charset).alias("html"))


def only_magic(files: DataFrame, magic: str = "%PDF") -> DataFrame:
    """Binary files whose content starts with the magic bytes."""
    return files.where(F.startswith("content", F.lit(magic).cast("binary")))


def raw_texts(pages: DataFrame, keys: list[str], html: str = "html", markers=V.LAYOUT_MARKERS) -> DataFrame:
    """Pages to (keys, body, layout, updated_at, body_sha256); narrow, no shuffle."""
    extra = [c for c in ("fetched_at",) if c in pages.columns]
    t = pages.select(*keys, *extra, html_to_text(html).alias("_text"))
    t = t.select(*keys, *extra, cut_body("_text", markers).alias("_b")).select(*keys, *extra, "_b.body", "_b.layout")
    return t.withColumn("updated_at", updated_at_of("body")).withColumn("body_sha256", F.sha2("body", 256))


def quality_failures(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Pages whose body could not be cut out."""
    return raw.where("layout IS NULL").select(*keys, F.lit("no known layout").alias("problem"))


def listing_rows(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Rows of listing pages: code, title, slots text, instructors; no code, no row."""
    rows = exploded(pages, keys, F.regexp_extract_all(html, F.lit(V.LIST_ROW), F.lit(1)), "tr", "row_no")
    cells = rows.select(*keys, "row_no", F.regexp_extract_all("tr", F.lit(V.TABLE_CELL), F.lit(1)).alias("td")).where("size(td) >= 5")
    names = ["course_code", "title", "term_slots", "instructors"]
    out = cells.select(*keys, "row_no", *[cell_text(F.get("td", i + 1)).alias(n) for i, n in enumerate(names)])
    return out.where("course_code <> ''")


def header_rows(rows: DataFrame, key: list[str], row_no: str = "row_no", cells: str = "cells",
                wanted=V.CELL_COLUMNS, needed=V.CELL_HEADER) -> DataFrame:
    """Rows under a header, cells found by the header's names.

    A header row holds all needed names; rows before the first header of a table are left
    out, and each header is valid up to the next one. Tables of any length are filled down
    in chunks.
    """
    clean = rows.withColumn("_c", F.transform(cells, lambda x: collapse(F.coalesce(x, F.lit("")))))
    is_header = F.lit(True)
    for n in needed:
        is_header = is_header & F.array_contains("_c", n)
    filled = fill_down(clean.withColumn("_is", is_header), key, row_no, F.when(F.col("_is"), F.col("_c")), "_header")
    body = filled.where(~F.col("_is") & F.col("_header").isNotNull())
    # the last column of a repeated name counts
    at = lambda n: F.size("_header") - F.array_position(F.reverse("_header"), n)
    pick = lambda n: F.when(F.array_contains("_header", n), F.coalesce(F.get("_c", at(n).cast("int")), F.lit("")))
    return body.select(*key, row_no, *[F.coalesce(pick(n), F.lit("")).alias(n) for n in wanted])


def beginnings(lines: DataFrame, wanted: DataFrame, page: list[str]) -> DataFrame:
    """(page, line, _code, _head): the pieces of each line that a title of its page may begin with.

    ``wanted`` has the first letters of a title as ``_head``. Each page says which lengths and which
    of HINTS numbers its heads have, so a line sends on few pieces that no title begins with.
    """
    number = lambda head: F.pmod(F.xxhash64(head), F.lit(HINTS)).cast("int")
    hints = wanted.groupBy(*page).agg(F.collect_set(F.length("_head")).alias("_sizes"), F.collect_set(number(F.col("_head"))).alias("_numbers"))
    heads = F.regexp_extract_all("line", F.lit(f"(?s)(?=(.{{1,{HEAD}}}))"), F.lit(1))
    heads = F.flatten(F.transform("_sizes", lambda n: F.transform(heads, lambda h: F.left(h, n))))
    heads = F.filter(F.array_distinct(heads), lambda h: F.array_contains("_numbers", number(h)))
    return exploded(lines.join(hints, page), [*page, "line", "_code"], heads, "_head")


def recover_codes(rows: DataFrame, lines: DataFrame, page: list[str], code: str, title: str, room: str, term: str) -> DataFrame:
    """Rows without a code take it from the page's text, when exactly one line fits.

    A line fits when it starts with a code and holds the row's title, room and term (blank
    ones are not asked for). Rows that stay without a code are left out. Lines meet rows on
    the page and on the title's first letters, so that a long page is not paired with itself.
    """
    ok = F.regexp_like(F.col(code), F.lit(V.CELL_CODE))
    good = rows.where(ok)
    lost = rows.where(~ok).where(F.col(title) != "")
    asked = [*page, title, room, term]                  # what a line is compared with; rows alike in it share their answer
    coded = lines.select(*page, "line", F.regexp_extract("line", "(?U)" + V.LINE_CODE, 1).alias("_code")).where("_code <> ''")
    wanted = lost.select(*asked).distinct().withColumn("_head", F.left(title, F.lit(HEAD)))
    spots = beginnings(coded, wanted, page)
    fits = F.contains("line", F.col(title)) & F.contains("line", F.col(room)) & F.contains("line", F.col(term))
    found = (wanted.join(spots, [*page, "_head"]).where(fits).groupBy(*asked)
             .agg(F.min("_code").alias("_lo"), F.max("_code").alias("_hi")).where("_lo = _hi"))
    back = lost.join(found, asked).withColumn(code, F.col("_lo")).select(*rows.columns)
    return good.unionByName(back)


def wide_grid(rows: DataFrame, key: list[str], row_no: str = "row_no", cells: str = "cells") -> DataFrame:
    """26-column rows to one row per used (weekday, period): grade, title, room, instructor."""
    cell = lambda i: collapse(F.regexp_replace(F.coalesce(F.get(cells, i), F.lit("")), "\n", ""))
    first = F.substring(cell(0), 1, 1)
    rows = fill_down(rows, key, row_no, F.when(first.isin(V.WEEKDAYS), first), "weekday").where("weekday IS NOT NULL")
    at = lambda p, k: cell(V.GRID_OFFSET + V.GRID_STRIDE * (p - 1) + k)
    names = ["grade", "title", "room", "instructor"]
    per = F.array(*[F.struct(F.lit(p).alias("period"), *[at(p, k).alias(n) for k, n in enumerate(names)])
                    for p in range(1, V.GRID_PERIODS + 1)])
    return exploded(rows, [*key, row_no, "weekday"], per, "g").select(*key, row_no, "weekday", "g.*").where("title <> ''")


def largest_table(rows: DataFrame, page: list[str], table: str = "table_no") -> DataFrame:
    """Rows of each page's table with the most rows; the earlier one on a tie."""
    size = rows.groupBy(*page, table).agg(F.count("*").alias("_n"))
    best = size.groupBy(*page).agg(F.max(F.struct("_n", (-F.col(table)).alias("_t"))).alias("_b"))
    return rows.join(best.select(*page, (-F.col("_b._t")).alias(table)), [*page, table], "left_semi")


def merge_sessions(rows: DataFrame, key: list[str], slot: Column, order: list[str], others: list[str]) -> DataFrame:
    """One row per composite key: distinct slots in order of sighting, the first row's other fields.

    Slots are reduced to one row each before they are gathered, so a key's list is as long
    as its number of different slots.
    """
    each = rows.withColumn("_slot", slot).groupBy(*key, "_slot").agg(F.min(F.struct(*order, *others)).alias("_f"))
    return each.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*[F.col(f"_f.{o}") for o in order]).alias("o"), F.col("_slot").alias("s")))), lambda x: x["s"]).alias("slots"),
        F.min("_f").alias("_m")).select(*key, "slots", *[F.col(f"_m.{o}").alias(o) for o in others])


def consolidate(rows: DataFrame, key: str, order: list[str], fields: dict[str, str], cohort: str, marks: Column) -> DataFrame:
    """One row per code: first non-empty value of each field, marks united per cohort.

    A cohort in which the code has no mark keeps an empty entry. Marks are a bounded set,
    so cohorts are united with boolean aggregates instead of lists.
    """
    from courseloom.functions.fields import marks as unify

    pick = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(*order, F.col(c).alias("v"))))
    cell = rows.withColumn("_m", unify(marks))
    per = cell.groupBy(key, cohort).agg(*[F.max(F.col("_m").contains(m)).alias(f"_h{i}") for i, m in enumerate(V.MARK_ORDER)],
                                        *[pick(c).alias(f"_f{i}") for i, c in enumerate(fields.values())])
    united = F.concat(*[F.when(F.col(f"_h{i}"), m).otherwise("") for i, m in enumerate(V.MARK_ORDER)])
    marked = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(cohort).alias("k"), united.alias("v")))))
    return per.groupBy(key).agg(*[F.coalesce(F.min(f"_f{i}")["v"], F.lit("")).alias(n) for i, n in enumerate(fields)], marked.alias("apply"))


def optional(spark: SparkSession, path: str, schema: str, what: str, how: str = "") -> tuple[DataFrame, DataFrame]:
    """A side file and a quality row: a missing file gives an empty table and a warning."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema(schema).json(path)
        there = True
    except AnalysisException as e:                      # any other fault of the store is the caller's to see
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        there = False
    if there:
        return found, spark.createDataFrame([], "problem string, path string, hint string")
    return (spark.createDataFrame([], schema),
            spark.createDataFrame([(f"missing: {what}", path, how)], "problem string, path string, hint string"))


def table_slice(spark: SparkSession, path: str, university: str, year: int) -> DataFrame:
    """One university's year of a partitioned table (partition pruning)."""
    return spark.read.parquet(path).where((F.col("university_id") == university) & (F.col("year") == year))
