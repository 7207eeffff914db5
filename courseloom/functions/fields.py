"""Rules that read one field of a course from its raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.text import (CUT, blank_null, col, collapse, drop, first_group, half_digits, has,
                                       lines_of, lookup, number, strip, text_or_empty)


def title_suffix(title: Column | str) -> Column:
    """Short bracketed ending of a title, unless it names a teacher or a class."""
    found = first_group(strip(title), V.TITLE_SUFFIX)
    return F.when(has(found, V.NOT_DEPARTMENT), "").otherwise(found)


def department(title: Column | str, codes=V.DEPARTMENT_CODES) -> Column:
    suffix = title_suffix(title)
    return F.when(suffix.isin(list(codes)), suffix).otherwise("")


def credits(raw: Column | str) -> Column:
    return number(blank_null(first_group(raw, V.FIRST_NUMBER)))       # a failed cast costs an exception


def slots(raw: Column | str) -> Column:
    """Array of struct(term, weekday, period), one for each non-blank line, in reading order.

    A line that is no 'term weekday period' keeps its first word and is unplaced.
    """
    parts = lambda line: F.split(F.regexp_replace(line, "(?U)" + V.SLOT_LINE, f"$1{CUT}$2{CUT}$3"), CUT)

    def slot(p):
        placed = F.size(p) == 3
        return F.struct(
            F.when(placed, F.get(p, 0)).otherwise(F.substring_index(F.get(p, 0), " ", 1)).alias("term"),
            F.when(placed, F.get(p, 1)).otherwise(V.NO_SLOT).alias("weekday"),
            F.when(placed, F.translate(F.get(p, 2), "１２３４５６７８９", "123456789")).otherwise(V.NO_SLOT).alias("period"))

    return F.transform(F.transform(F.transform(lines_of(raw), collapse), parts), slot)


def normalize_category(raw: Column | str) -> Column:
    """Alias, or the Japanese part before the first Latin text, without trailing marks."""
    v = collapse(text_or_empty(raw))
    before_latin = first_group(v, "(?s)^(.*?)" + V.LATIN_START)
    kept = F.when(has(before_latin, V.HAS_JAPANESE), before_latin).otherwise(v)
    plain = F.substring(strip(drop(kept, V.TRAILING_PUNCT)), 1, V.CATEGORY_MAX)
    return F.when(v == "", "").otherwise(F.coalesce(lookup(V.CATEGORY_ALIASES, v), plain))


def merge_category(category: Column | str, faculty: Column | str) -> Column:
    """First alternative for split faculties, then the merge table (which may empty it)."""
    cat = col(category)
    first = strip(F.substring_index(F.substring_index(cat, "／", 1), "/", 1))
    first = strip(drop(first, V.LEAD_BRACKET))
    first = F.when(first.startswith("GProE"), strip(F.substring(first, 6, V.CATEGORY_MAX))).otherwise(first)
    cat = F.when(text_or_empty(faculty).isin(V.CATEGORY_SPLIT_FACULTIES), first).otherwise(cat)
    return F.coalesce(lookup(V.CATEGORY_MERGES, cat), cat)


def term_group(term: Column | str) -> Column:
    table = {t: g for g, terms in V.TERM_GROUPS.items() for t in terms}
    return F.coalesce(lookup(table, strip(text_or_empty(term))), F.lit(V.OTHER_TERM_GROUP))


def season(term: Column | str) -> Column:
    """'spring' / 'autumn', NULL for terms that span both."""
    group = term_group(term)
    return F.when(group.isin(V.SPRING_GROUPS), "spring").when(group.isin(V.AUTUMN_GROUPS), "autumn")


def season_of_code(code: Column | str) -> Column:
    return lookup({k: v[1] for k, v in V.TERM_CODES.items()}, code)


def current_season(day: Column) -> Column:
    return F.when(F.month(day).between(4, 8), "spring").otherwise("autumn")


def top_grade(faculty: Column | str) -> Column:
    six = F.lit(False)
    for name in V.SIX_YEAR_FACULTIES:
        six = six | text_or_empty(faculty).contains(name)
    return F.when(six, 6).otherwise(4)


def grades(target: Column | str, faculty: Column | str) -> Column:
    """Grades a course is for, as a sorted int array; what cannot be read means all."""
    cap = top_grade(faculty)
    s = drop(half_digits(text_or_empty(target)), V.ENROLL_YEAR, " ")
    everyone = F.sequence(F.lit(1), cap)
    least = blank_null(first_group(s, V.GRADE_OR_MORE)).try_cast("int")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit("([1-6])"), F.lit(1)).cast("array<int>")))
    filled = F.when((F.size(found) > 1) & has(s, V.GRADE_RANGE),
                    F.sequence(F.array_min(found), F.array_max(found))).otherwise(found)
    return (F.when(strip(s).isin(V.ALL_GRADES), everyone)
            .when(least.isNotNull(), F.sequence(least, F.when(least > 4, 6).otherwise(cap)))
            .when(F.size(found) == 0, everyone).otherwise(filled))


def any_of(c: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def numbering_level(numbering: Column | str) -> Column:
    return half_digits(blank_null(first_group(numbering, V.NUMBERING_LEVEL))).try_cast("int")


def undergraduate(faculty, faculty_cat, category, target, numbering) -> Column:
    """1 undergraduate, 0 graduate, NULL when nothing tells."""
    blob = F.concat(*[x for c in (faculty, faculty_cat, category) for x in (text_or_empty(c), F.lit(" "))])
    level = numbering_level(numbering)
    return (F.when(any_of(blob, V.GRADUATE_MARKERS), 0)
            .when(has(target, V.GRADUATE_GRADE), 0)
            .when(level >= 5, 0).when(level.isNotNull(), 1)
            .when(strip(blob) != "", 1))


def flag(text: Column | str, pattern: str) -> Column:
    return F.when(has(text, pattern), 1).otherwise(0)


def departments(faculty: Column | str, raw: Column | str) -> Column:
    """Names of departments and courses written in the raw target, in order, once each."""
    faculty = text_or_empty(faculty)
    names = F.regexp_extract_all(text_or_empty(raw), F.lit(V.DEPARTMENT_NAMES), F.lit(0))
    names = F.transform(names, lambda t: drop(drop(t, "[－-]", "ー"), "^.*?学部"))
    return F.array_distinct(F.filter(
        names, lambda t: (t != "") & ~faculty.endswith(t) & (t != "各コース")))


def name_list(raw: Column | str) -> Column:
    """Newline text as an array without blank items."""
    return F.filter(F.split(text_or_empty(raw), "\n"), lambda x: strip(x) != "")


def shorten(c: Column | str, limit: int, mark: str = "") -> Column:
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def csv_cell(c: Column | str) -> Column:
    """Guard a text cell that a spreadsheet would run as a formula."""
    c = col(c)
    return F.when(F.regexp_like(c, F.lit(r"(?U)^([\t\r\n]|\s*[=+\-@])")), F.concat(F.lit("'"), c)).otherwise(c)


def shard_of(code: Column | str, shards: int = V.SHARDS) -> Column:
    """32-bit FNV-1a over code points, modulo the number of shards."""
    step = lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(V.FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    chars = F.filter(F.split(col(code), ""), lambda ch: ch != "")
    return F.pmod(F.aggregate(chars, F.lit(V.FNV_OFFSET).cast("bigint"), step), F.lit(shards)).cast("int")


def marks(cell: Column | str) -> Column:
    """Marks present in a cell, in the fixed order, glyph variants unified."""
    unified = F.translate(text_or_empty(cell), "".join(V.MARK_GLYPHS), "".join(V.MARK_GLYPHS.values()))
    return F.concat(*[F.when(unified.contains(m), m).otherwise("") for m in V.MARK_ORDER])


def embeddable(json_text: Column | str) -> Column:
    """JSON text that is safe inside a script element."""
    t = col(json_text)
    for ch, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        t = F.replace(t, F.lit(ch), F.lit(code))
    return t
