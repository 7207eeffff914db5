"""Session plans: numbered blocks of a text as (no, theme, detail) rows, in-row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.fields import shorten
from courseloom.functions.text import collapse, half_digits, has, matches_of, pieces, strip, texts_of, tidy_lines

NUMBER_LINE = r"(?md)^([0-9０-９]{1,2})$"
NUMBER_BEFORE_NUMBER = r"(?md)^[0-9０-９]{1,2}\n(?=[0-9０-９]{1,2}$)"
PLAN_ROWS = "array<struct<no:int,theme:string,detail:string>>"


def number_lines(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(NUMBER_LINE), F.lit(1)))


def _rows(blocks: Column) -> Column:
    """(no, theme, detail) of each block: first line, and the rest without its closing study
    lines unless it only repeats the theme. Each pass names what the next one reads."""

    def lines(b):
        return F.struct(b["no"].alias("no"), F.split(b["text"], "\n").alias("lines"))

    def keep(b):
        last = F.array_max(F.transform(b["lines"], lambda x, i: F.when((i == 0) | ~has(x, V.STUDY_LINE), i).otherwise(0)))
        return F.struct(b["no"].alias("no"), F.get(b["lines"], 0).alias("theme"),
                        strip(F.array_join(F.slice(b["lines"], F.lit(2), last), " ")).alias("rest"))

    def cut(b):
        said = (b["rest"] == "") | F.startswith(b["rest"], b["theme"]) | F.startswith(b["theme"], b["rest"])
        return F.struct(b["no"].alias("no"), F.substring(b["theme"], 1, V.THEME_MAX).alias("theme"),
                        F.when(~said, F.substring(b["rest"], 1, V.DETAIL_MAX)).alias("detail"))

    for step in (lines, keep, cut):
        blocks = F.transform(blocks, step)
    return blocks


def with_plan(df, candidates: list[Column | str], out: str = "pl"):
    """Add the plan rows read from the candidate column with the most number lines.

    Numbers must start at 1 and strictly rise; otherwise the text is no plan and the array
    is empty. A number directly followed by another number is the first of two number
    columns, and the later one counts.
    """
    tidy = [f"_{out}{i}" for i in range(len(candidates))]
    for t, c in zip(tidy, candidates):
        df = df.withColumn(t, tidy_lines(c))
    # most number lines, the earlier candidate on a tie
    for i, t in enumerate(tidy):
        df = df.withColumn(f"_n{i}", F.struct(number_lines(F.col(t)).alias("n"), F.lit(-i).alias("rank")))
    best = F.greatest(*[f"_n{i}" for i in range(len(tidy))]) if len(tidy) > 1 else F.col("_n0")
    df = df.withColumn("_best", best)
    text = F.element_at(F.array(*tidy), 1 - F.col("_best.rank"))
    df = df.withColumn("_text", F.when(F.col("_best.n") >= 2, F.regexp_replace(text, NUMBER_BEFORE_NUMBER, "")).otherwise(""))
    parts = F.col("_parts")
    df = df.withColumn("_parts", pieces("_text", NUMBER_LINE))
    df = (df.withColumn("_nos", F.transform(matches_of(parts), lambda n: half_digits(n).try_cast("int")))
          .withColumn("_texts", F.transform(F.slice(texts_of(parts), F.lit(2), F.size(parts)),
                                            lambda t: F.btrim(t, F.lit("\n")))))
    rises = (F.get("_nos", 0) == 1) & (F.array_sort(F.array_distinct("_nos")) == F.col("_nos"))
    blocks = F.filter(F.arrays_zip(F.col("_nos").alias("no"), F.col("_texts").alias("text")), lambda b: b["text"] != "")
    rows = _rows(blocks)
    empty = F.array().cast(PLAN_ROWS)
    return df.withColumn(out, F.when(rises, rows).otherwise(empty).cast(PLAN_ROWS)).drop(
        *tidy, "_text", "_parts", "_nos", "_texts", "_best", *[f"_n{i}" for i in range(len(tidy))])


def outline(picks: list[Column]) -> Column:
    """First text that is long enough, on one line, shortened with a mark."""
    long_enough = [F.when(F.length(strip(p)) >= V.OUTLINE_MIN, strip(p)) for p in picks]
    return shorten(collapse(F.coalesce(*long_enough, F.lit(""))), V.OUTLINE_MAX, "…")


def first_non_empty(picks: list[Column]) -> Column:
    return F.coalesce(*[F.nullif(strip(p), F.lit("")) for p in picks], F.lit(""))


def plan_head(rows: Column, n: int = 5) -> Column:
    """The first rows of a plan, which are shown at once; the rest is read on demand."""
    return F.slice(rows, 1, n)
