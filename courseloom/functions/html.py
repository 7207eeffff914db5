"""HTML to text, entity decoding, and cutting the body out of a page."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.text import col, lookup, pieces, strip

# ---- Fixed values: what is removed and what ends a line -------------------------------
SCRIPT, STYLE, COMMENT = r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->"
LINE_BREAK, BLOCK_END, TAG = r"(?i)<br\s*/?>", r"(?i)</(td|tr|div|p|table|h[1-6]|li)>", r"<[^>]+>"
COMMON_ENTITIES = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "copy;", "middot;", "hellip;", "ndash;",
                   "mdash;", "apos;", "times;"]

# references to 128-159 mean Windows-1252 characters
WINDOWS_1252 = {str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}

# a number, or what can be a name; whether it is one, or begins with one, is looked up
ENTITY = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{1,31};?)"
_BARE = {k: v for k, v in html5.items() if not k.endswith(";")}         # names that need no semicolon
_BARE_SIZES = sorted({len(k) for k in _BARE}, reverse=True)


def _character(code: Column) -> Column:
    """Code point to text; numbers that name no character become U+FFFD, controls and noncharacters are left out."""
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    win = F.coalesce(lookup(WINDOWS_1252, code.cast("string")), F.lit(""))
    utf = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    no_text = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
               | (code.bitwiseAND(0xFFFE) == 0xFFFE))
    return F.when(code.between(0x80, 0x9F), win).when(~valid, "�").when(no_text, "").otherwise(utf)


def _entity_text(name: Column, known: list[str] | None = None) -> Column:
    if known is not None:
        return F.coalesce(lookup({k: html5[k] for k in known}, name), F.concat(F.lit("&"), name))
    digits = F.regexp_extract(name, r"^#[xX]?([0-9a-fA-F]+)", 1)
    hexadecimal = F.ltrim(digits, F.lit("0"))           # a number too long would stop the job
    code = F.when(F.lower(name).startswith("#x"), F.conv(F.when(F.length(hexadecimal) <= 8, hexadecimal), 16, 10)).otherwise(digits)
    table = lambda names: F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    bare = table(_BARE)
    # the longest name that the text begins with; without any it stays as it is
    begins = [F.concat(bare[F.left(name, F.lit(n))], F.substring(name, n + 1, 40)) for n in _BARE_SIZES]
    named = F.coalesce(table({k: html5[k] for k in COMMON_ENTITIES})[name], table(html5)[name], *begins, F.concat(F.lit("&"), name))
    return F.when(name.startswith("#"), _character(F.coalesce(code.try_cast("bigint"), F.lit(0)))).otherwise(named)


def unescape(c: Column | str, known: list[str] | None = None) -> Column:
    """Replace character references in one pass; text without ``&`` is left as it is.

    ``known``: the only references that the text's writer makes, such as ``amp;``. Others, and one
    that was cut off before its semicolon, are text then.
    """
    c = col(c)
    decoded = F.transform(pieces(c, ENTITY), lambda x, i: F.when(i % 2 == 0, x).otherwise(_entity_text(x, known)))
    return F.when(c.contains("&"), F.array_join(decoded, "")).otherwise(c)


def strip_markup(c: Column | str) -> Column:
    """Tags out, line breaks in; entities still encoded. Scripts go before tags."""
    t = col(c)
    for pattern, by in ((SCRIPT, ""), (STYLE, ""), (COMMENT, ""), (LINE_BREAK, "\n"),
                        (BLOCK_END, "\n"), (TAG, "")):
        t = F.regexp_replace(t, pattern, by)
    return t


def html_to_text(c: Column | str, known: list[str] | None = None) -> Column:
    t = F.replace(unescape(strip_markup(c), known), F.lit("　"), F.lit(" "))
    t = F.regexp_replace(t, r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def cell_text(c: Column | str) -> Column:
    """Text of an HTML fragment; ``<br>`` makes a new line."""
    t = F.regexp_replace(F.regexp_replace(col(c), LINE_BREAK, "\n"), TAG, "")
    return strip(F.replace(unescape(t), F.lit("　"), F.lit(" ")))


def flat_text(c: Column | str) -> Column:
    """Text of an HTML fragment on one line."""
    t = F.replace(unescape(F.regexp_replace(col(c), TAG, "")), F.lit("　"), F.lit(" "))
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def first_marker(text: Column | str, markers=V.LAYOUT_MARKERS) -> Column:
    """The start marker that comes first: struct(pos, layout, ending), NULL if none occurs."""
    text = col(text)
    found = F.array(*[F.struct(F.instr(text, start).alias("pos"), F.lit(layout).alias("layout"),
                               F.lit(end).alias("ending")) for layout, start, end in markers])
    return F.array_min(F.filter(found, lambda m: m["pos"] > 0))


def cut_at(text: Column | str, marker: Column) -> Column:
    """Text from the marker to its ending (or to the end); empty without a marker."""
    text = col(text)
    pos = marker["pos"]
    stop = F.call_function("locate", marker["ending"], text, pos + 1)
    body = F.when(stop > pos, F.substring(text, pos, stop - pos)).otherwise(F.substring(text, pos, F.length(text)))
    return F.when(marker.isNull(), F.lit("")).otherwise(strip(body))


def cut_body(text: Column | str, markers=V.LAYOUT_MARKERS) -> Column:
    """struct(body, layout). A page with no marker has an empty body and a NULL layout."""
    marker = first_marker(text, markers)
    return F.struct(cut_at(text, marker).alias("body"), marker["layout"].alias("layout"))


def updated_at_of(body: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(body), V.UPDATED_AT, 1), F.lit(""))


def is_error_page(html: Column | str) -> Column:
    """Marker text, or a short page without the listing heading."""
    html = col(html)
    return html.contains(V.ERROR_PAGE) | (
        (F.length(html) < V.LIST_MIN_LENGTH) & ~html.contains(V.LIST_HEADING))


def hit_range(html: Column | str) -> Column:
    """struct(lo, hi, total) announced by a listing page; NULL when it cannot be read."""
    plain = F.regexp_replace(F.regexp_replace(col(html), SCRIPT, ""), TAG, " ")
    plain = F.regexp_replace(plain, r"(?U)\s+", " ")
    packed = F.replace(plain, F.lit(" "), F.lit(""))
    part = [F.regexp_extract(packed, V.HIT_RANGE, i).try_cast("int") for i in (1, 2, 3)]
    shown = F.struct(part[0].alias("lo"), part[1].alias("hi"), part[2].alias("total"))
    zero = F.struct(*[F.lit(0).alias(n) for n in ("lo", "hi", "total")])
    return F.when(part[2].isNotNull(), shown).when(F.regexp_like(plain, F.lit(V.ZERO_HITS)), zero)


def page_url(template: Column | str, code: Column | str) -> Column:
    """Put a percent-encoded code into a URL template that holds ``{code}``."""
    encoded = F.replace(F.url_encode(col(code)), F.lit("+"), F.lit("%20"))
    return F.replace(col(template), F.lit("{code}"), encoded)
