"""Column helpers for text: Unicode-aware trims, line tidying, regex with values.

Java's ``\\s``/``\\d`` are ASCII by default; ``(?U)`` makes them follow Unicode, so that
U+3000 and full-width digits behave as in the source texts.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode white space
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
FULL_DIGITS, HALF_DIGITS = "０１２３４５６７８９", "0123456789"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """No white space at the ends. A trim by characters only looks at the ends."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def collapse(c: Column | str) -> Column:
    """One space for each run of white space, none at the ends."""
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def tidy_lines(c: Column | str) -> Column:
    """The text's non-blank lines, each stripped, joined by a line feed."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\R|[\x1c-\x1e]", "\n")
    return strip(F.regexp_replace(t, r"(?U)\s*\n\s*", "\n"))


def lines_of(c: Column | str) -> Column:
    """Non-blank stripped lines as an array (empty for empty text)."""
    return F.filter(F.split(tidy_lines(c), "\n"), lambda x: x != "")


def half_digits(c: Column | str) -> Column:
    return F.translate(col(c), FULL_DIGITS, HALF_DIGITS)


def blank_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def has(c: Column | str, pattern: str) -> Column:
    """Does the pattern occur (Unicode classes)?"""
    return F.regexp_like(text_or_empty(c), F.lit("(?U)" + pattern))


def drop(c: Column | str, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(col(c), "(?U)" + pattern, by)


def first_group(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text_or_empty(c), "(?U)" + pattern, group)


def number(c: Column | str) -> Column:
    return half_digits(c).try_cast("double")


def lookup(table: dict[str, str], c: Column | str) -> Column:
    """Value of a small fixed dictionary, NULL when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[col(c)]


CUT = "\uffff"         # a noncharacter: never part of a text


def pieces(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Text, match, text, match, ..., text as one array, found in a single pass.

    Matches are set between noncharacters and the text is split on those: the pattern is
    then compiled once per task, while a split on the pattern would compile it for each row.
    """
    marked = F.regexp_replace(F.replace(col(c), F.lit(CUT), F.lit("\ufffd")), pattern, f"{CUT}${group}{CUT}")
    return F.split(marked, CUT, -1)


def groups_of(c: Column | str, pattern: str, n: int) -> Column:
    """The first ``n`` groups, found in a single pass, of a pattern that matches once at most; an empty array where it doesn't."""
    by = "".join(f"{CUT}${i + 1}" for i in range(n)) + CUT
    return F.slice(F.split(F.regexp_replace(F.replace(col(c), F.lit(CUT), F.lit("\ufffd")), "(?U)" + pattern, by), CUT, -1), 2, n)


def texts_of(parts: Column) -> Column:
    return F.filter(parts, lambda x, i: i % 2 == 0)


def matches_of(parts: Column) -> Column:
    return F.filter(parts, lambda x, i: i % 2 == 1)


def between_matches(c: Column | str, pattern: str, group: int = 1) -> tuple[Column, Column]:
    """(texts, matches): ``texts[i]`` stands before ``matches[i]``; one more text than matches."""
    return texts_of(pieces(c, pattern, group)), F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def matches_with_texts(c: Column | str, pattern: str, match: str, text: str, after: bool = False) -> Column:
    """Array of struct(match, text): each match and the text since the one before it (``after``: up to
    the next), found in a single pass."""
    return let(pieces(c, pattern), lambda parts: F.arrays_zip(
        matches_of(parts).alias(match), F.slice(texts_of(parts), 2 if after else 1, F.size(matches_of(parts))).alias(text)))


def exploded(df: DataFrame, keep: list, array: Column, item: str, pos: str | None = None) -> DataFrame:
    """One row per element of an array that the same plan computes.

    An inner explode lets the optimizer test the array's size below every projection, which
    computes the array a second time. The outer form with a filter on the position does not.
    """
    at = pos or "_at"
    rows = df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())
    return rows if pos else rows.drop("_at")


def _nfkc_udf():
    # an inner function travels to the executors by value: they need not have this package
    def normalise(values: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(values)).as_py() is not False:
            return values
        coded = values.dictionary_encode()
        plain = [unicodedata.normalize("NFKC", v) for v in coded.dictionary.to_pylist()]
        return pa.array(plain, pa.string()).take(coded.indices)

    return F.arrow_udf(normalise, StringType())


_normalise = _nfkc_udf()


# letters that NFKC leaves alone wherever they stand: ASCII, Latin-1 letters, ideographs, kana and marks, without combining ones
PLAIN_LETTERS = r"\x00-\x7F\u00C0-\u00FF\u25A0-\u25FF\u3001-\u3012\u3041-\u3096\u30A1-\u30FA\u30FC\u4E00-\u9FFF"


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC over Arrow batches (Spark has no built-in).

    Texts of plain letters stay in the JVM. ASCII batches pass as they are; otherwise each distinct
    value is normalised once.
    """
    plain = F.regexp_like(col(c), F.lit(rf"\A[{PLAIN_LETTERS}]*+\z"))
    return F.coalesce(_normalise(F.when(~plain, col(c))), col(c))       # what isn't sent comes back NULL: one test serves


def search_key(*parts: Column | str) -> Column:
    """Normalised text that keyword search runs on: NFKC, lower case."""
    return F.lower(nfkc(F.concat_ws(" ", *[col(p) for p in parts])))
