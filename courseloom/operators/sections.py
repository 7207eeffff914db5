"""Sections of a semi-structured text: label lines and the text under each.

A body is one row, so the work stays inside the row (split and match on one pattern) and
needs neither an exploded line table nor a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.text import col, exploded, let, matches_of, pieces, strip, texts_of

SECTIONS = "struct<labels:array<string>,texts:array<string>>"


def _one_line(label: str) -> str:
    return label.replace("\n", "")


def label_line(labels) -> str:
    """Pattern of a line that equals a label; longer labels are tried first."""
    names = sorted({_one_line(x) for x in labels}, key=len, reverse=True)
    return "(?md)^(" + "|".join(map(re.escape, names)) + ")$"


def sections(body: Column | str, labels=V.LAYOUT_LABELS["A"], empty=V.EMPTY_MARKERS) -> Column:
    """struct(labels, texts) in reading order; text before the first label is left out.

    Labels that span two lines are joined first. An empty marker counts as empty text.
    """
    text = F.regexp_replace(F.coalesce(col(body), F.lit("")), r"(?U)[\s&&[^\n]]*\n[\s&&[^\n]]*", "\n")
    text = strip(text)
    for two_lines in (x for x in labels if "\n" in x):
        text = F.replace(text, F.lit(two_lines), F.lit(_one_line(two_lines)))
    def read(parts):
        texts = F.slice(texts_of(parts), F.lit(2), F.size(parts))
        texts = F.transform(F.transform(texts, strip), lambda t: F.when(t.isin(empty), "").otherwise(t))
        return F.struct(matches_of(parts).alias("labels"), texts.alias("texts"))

    return let(pieces(text, label_line(labels)), read)


def sections_by_layout(body: Column | str, layout: Column | str, layouts=V.LAYOUT_LABELS, default="A") -> Column:
    """Sections under the label set of the row's layout."""
    layout = F.coalesce(col(layout), F.lit(default))
    out = None
    for name, labels in layouts.items():
        if name != default:
            out = (F if out is None else out).when(layout == name, sections(body, labels))
    fallback = sections(body, layouts[default])
    return fallback if out is None else out.otherwise(fallback)


def section_text(secs: Column | str, label: str | Column | None) -> Column:
    """Text of the first section with the label, empty when there is none."""
    if label is None:
        return F.lit("")
    secs = col(secs)
    at = F.array_position(secs["labels"], label if isinstance(label, Column) else F.lit(_one_line(label)))
    return F.coalesce(F.get(secs["texts"], (at - 1).cast("int")), F.lit(""))


def label_texts(secs: Column | str, layout: Column | str, by_layout: dict[str, list[str | None]],
                other: list[str | None]) -> Column:
    """Array of the texts under the labels that the row's layout lists (``other``: any other layout), empty
    for ``None`` and for labels that the body lacks. One short loop: a lookup a column makes a method too
    long for the JVM to compile."""
    names = lambda labels: F.array(*[F.lit(_one_line(lb) if lb else None).cast("string") for lb in labels])
    wanted = None
    for name, labels in by_layout.items():
        wanted = (F if wanted is None else wanted).when(col(layout) == name, names(labels))
    return F.transform(wanted.otherwise(names(other)), lambda label: section_text(secs, label))


def layout_text(secs: Column | str, layout: Column | str, by_layout: dict[str, str | None]) -> Column:
    """Text of the label that the row's layout uses for one column, empty where it has none."""
    return F.get(label_texts(secs, layout, {name: [lb] for name, lb in by_layout.items()}, [None]), 0)


def section_rows(df: DataFrame, keys: list[str], secs: str = "secs") -> DataFrame:
    """Long table (keys, seq, label, text); the first section of a label wins."""
    zipped = F.arrays_zip(F.col(f"{secs}.labels").alias("label"), F.col(f"{secs}.texts").alias("text"))
    rows = exploded(df, [*keys, F.col(f"{secs}.labels").alias("_l")], zipped, "s", "seq")
    first = F.array_position("_l", F.col("s.label")) == F.col("seq") + 1
    return rows.where(first).select(*keys, (F.col("seq") + 1).alias("seq"), "s.label", "s.text")
