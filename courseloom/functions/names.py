"""Names, rooms and titles read out of timetable lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.text import WHITE_SPACE, col, drop, first_group, has, nfkc, strip, text_or_empty

# each letter of the two classes; a pattern's white space goes without the separators \x1c to \x1f
UNCOMPARED = (V.NAME_SYMBOLS[1:-1] + V.NAME_PUNCT[1:-1]).replace(r"\s", "".join(sorted({*WHITE_SPACE} - {*"\x1c\x1d\x1e\x1f"}))).replace("\\", "")


def match_key(c: Column | str) -> Column:
    """Form in which names are compared: NFKC, lower case, no notes, symbols or spaces."""
    t = F.lower(nfkc(text_or_empty(c)))
    key = F.translate(drop(t, V.NAME_NOTES), UNCOMPARED, "")      # several times faster than a pattern
    return F.coalesce(key, F.lit(""))        # never NULL: a join on it needs no test below


def clean_room(c: Column | str) -> Column:
    t = F.regexp_replace(drop(c, r"\s+"), r"^[,、]+|[,、]+\z", "")
    return drop(t, V.CAMPUS_PREFIX)


def is_room(room: Column | str) -> Column:
    return (col(room) != "") & ~has(room, V.NOT_ROOM)


def _chain(c: Column, steps) -> Column:
    for pattern, by in steps:
        c = strip(drop(c, pattern, by))
    return c


def guess_title(segment: Column | str) -> Column:
    """The part of a segment that looks like a title."""
    t = strip(drop(segment, V.TITLE_CLEANUP[0][0]))
    t = drop(t, V.TITLE_CLEANUP[1][0])
    t = drop(strip(t), V.TITLE_CLEANUP[2][0])
    t = strip(drop(t, V.TITLE_CLEANUP[3][0]))
    return drop(drop(t, V.TITLE_CLEANUP[4][0]), V.TITLE_CLEANUP[5][0])


def title_candidates(title: Column) -> list[Column]:
    """The title, then the same without its first and its first two words."""
    words = F.split(title, " ")
    less = lambda n: F.array_join(F.slice(words, F.lit(n + 1), F.size(words)), " ")
    # with too few words the split keeps its last word
    tail = lambda n: F.when(F.size(words) > n, less(n)).otherwise(F.element_at(words, -1))
    return [title, tail(1), tail(2)]


def missing_title(title: Column | str) -> Column:
    return _chain(col(title), V.MISSING_CLEANUP)


def is_missing_junk(title: Column | str) -> Column:
    lo, hi = V.MISSING_TITLE_LEN
    return ~F.length(col(title)).between(lo, hi) | F.regexp_like(col(title), F.lit(V.MISSING_JUNK))


def surname(segment: Column | str) -> Column:
    """Family name of the teacher a segment ends with; NULL when there is none."""
    fam = F.regexp_replace(first_group(strip(segment), V.TRAILING_NAME), V.SURNAME_END, "")
    return F.when((fam != "") & ~F.regexp_like(fam, F.lit("[0-9０-９A-Za-z]")), fam)


def slash_titles(line: Column | str) -> Column:
    """Titles written before a slash, cleaned, junk left out; array in reading order."""
    found = F.regexp_extract_all(col(line), F.lit("(?U)" + V.SLASH_TITLE), F.lit(1))
    cleaned = F.transform(found, lambda t: F.regexp_replace(
        F.regexp_replace(t, V.SLASH_MARKS, ""), V.SLASH_LATIN_HEAD, ""))
    return F.filter(cleaned, lambda t: ~F.regexp_like(t, F.lit(V.SLASH_JUNK)))


def page_season(head: Column | str) -> Column:
    """Season named by a page's first two lines, NULL when none or both are."""
    spring, autumn = has(head, V.PAGE_SPRING), has(head, V.PAGE_AUTUMN)
    return F.when(spring & ~autumn, "spring").when(autumn & ~spring, "autumn")
