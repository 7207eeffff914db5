"""Grading text: method runs, weights, notes, totals, evaluation flags.

All in-row array work: one text holds one course's grading, so no shuffle is needed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.text import (between_matches, col, drop, first_group, has, let, matches_of, number,
                                       pieces, strip, text_or_empty, texts_of, tidy_lines)

METHOD_LINE = "(?md)^(" + "|".join(map(re.escape, V.METHODS)) + ")$"
ROWS = "array<struct<method:string,pct:double,note:string,mark:int>>"


def trim_marks(c: Column | str) -> Column:
    return strip(drop(text_or_empty(c), f"^{V.TRIM_CHARS}|{V.TRIM_CHARS}\\z"))


_PLAIN_UNUSED = sorted({re.sub(f"^{V.TRIM_CHARS}|{V.TRIM_CHARS}$", "", p) for p in V.UNUSED_PHRASES} | {""})


def is_unused(desc: Column) -> Column:
    return desc.isin(V.UNUSED_PHRASES) | trim_marks(desc).isin(_PLAIN_UNUSED)


def is_condition(desc: Column) -> Column:
    """Is the text's only percentage a requirement instead of a weight?"""
    around, _ = between_matches(desc, "(?U)" + V.PERCENT)
    before, after = F.get(around, 0), F.get(around, 1)
    sentence = F.concat(F.regexp_extract(before, r"[^。\n]*\z", 0), first_group(desc, V.PERCENT, 0),
                        F.regexp_extract(after, r"^[^。]*", 0))
    return (has(after, V.CONDITION_AFTER) | has(before, "(?i)" + V.CONDITION_BEFORE)
            | has(sentence, "(?i)" + V.CONDITION_SENTENCE))


def _count(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def note_without_percent(desc: Column) -> Column:
    """The note with its percentage taken out, or whole where taking it out would break it."""
    out = trim_marks(drop(desc, V.PERCENT))
    broken = ((_count(out, "（") != _count(out, "）")) | (_count(out, "(") != _count(out, ")"))
              | has(out, V.DANGLING_TIMES))
    return F.when(out == "", "").when(broken, trim_marks(desc)).otherwise(out)


def weights(runs: Column) -> Column:
    """struct(method, pct, note, mark) of each method's description.

    Three passes over the array: what a pass names, the next reads without working it out again.
    """

    def read(r):
        desc = r["desc"]
        found = F.regexp_extract_all(desc, F.lit("(?U)" + V.PERCENT), F.lit(1))
        return F.struct(r["method"].alias("method"), desc.alias("desc"), found.alias("found"),
                        first_group(desc, V.PERCENT_TIMES, 2).alias("times"), first_group(desc, V.BARE_NUMBER).alias("bare"))

    def judge(r):
        n = F.size(r["found"])
        kind = (F.when(r["times"] != "", "times")
                .when(n == 1, F.when(is_condition(r["desc"]), "condition").otherwise("weight"))
                .when((n == 0) & (r["bare"] != ""), "bare").otherwise("text"))
        return F.struct(*[r[c].alias(c) for c in ("method", "desc", "found", "times", "bare")], kind.alias("kind"))

    def note(r):
        text = (F.when(r["kind"] == "weight", note_without_percent(r["desc"])).when(r["kind"] == "bare", "")
                .otherwise(trim_marks(r["desc"])))
        pct = (F.when(r["kind"] == "times", number(first_group(r["desc"], V.PERCENT_TIMES)) * number(r["times"]))
               .when(r["kind"] == "weight", number(F.get(r["found"], 0))).when(r["kind"] == "bare", number(r["bare"])))
        return F.struct(r["method"].alias("method"), pct.alias("pct"), text.alias("note"),
                        F.when(r["kind"] == "condition", V.MARK_CONDITION).cast("int").alias("mark"))

    def plain(r):
        said = (r["note"] == r["method"]) | r["note"].isin(V.UNUSED_PHRASES)
        return F.struct(r["method"].alias("method"), r["pct"].alias("pct"),
                        F.when(said, "").otherwise(r["note"]).alias("note"), r["mark"].alias("mark"))

    for step in (read, judge, note, plain):
        runs = F.transform(runs, step)
    return runs


def method_runs(raw: Column | str) -> Column:
    """struct(extra array, runs array<struct<method, desc>>) of a grading text."""
    edge = lambda t: F.btrim(t, F.lit("\n"))

    def read(parts):
        descs = F.transform(F.slice(texts_of(parts), F.lit(2), F.size(parts)), edge)
        runs = F.arrays_zip(matches_of(parts).alias("method"), descs.alias("desc"))
        extra = F.filter(F.split(F.get(parts, 0), "\n"), lambda x: x != "")
        return F.struct(extra.alias("extra"), runs.alias("runs"))

    return let(pieces(tidy_lines(raw), METHOD_LINE), read)


def _by_method(rows: Column) -> Column:
    """Display order: method rank, then reading order."""
    rank = lambda r: F.array_position(F.array(*map(F.lit, V.METHODS)), r["method"])
    keyed = F.transform(rows, lambda r, i: F.struct(rank(r).alias("k"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda x: x["r"])


def share_once(rows: Column) -> Column:
    """Rows repeating an earlier row's percentage and note count once: the rest get a mark."""
    same = lambda r, p: (p["pct"] == r["pct"]) & (p["note"] == r["note"]) & p["mark"].isNull()

    def mark(r, i):
        earlier = F.exists(F.slice(rows, F.lit(1), i), lambda p: same(r, p))
        repeat = r["pct"].isNotNull() & (r["note"] != "") & r["mark"].isNull() & F.coalesce(earlier, F.lit(False))
        return F.struct(r["method"].alias("method"), F.when(~repeat, r["pct"]).alias("pct"), r["note"].alias("note"),
                        F.when(repeat, V.MARK_SHARED).otherwise(r["mark"]).alias("mark"))

    return F.transform(rows, mark)


def used_rows(runs: Column) -> Column:
    """Weight rows before the shared-weight rule, in display order."""
    used = F.filter(runs, lambda r: ~is_unused(r["desc"]))
    return _by_method(weights(used))


def unused_methods(runs: Column) -> Column:
    return F.transform(F.filter(runs, lambda r: is_unused(r["desc"])), lambda r: r["method"])


def with_grading(df, raw: Column | str, prefix: str = ""):
    """Add rows, unused, extra and total of a grading column: ``gr gu gx gt``.

    Staged columns, so that each expression is evaluated once.
    """
    runs, rows = prefix + "_runs", prefix + "_rows"
    return (df.withColumn(runs, method_runs(raw))
            .withColumn(rows, used_rows(F.col(runs)["runs"]))
            .withColumn(prefix + "gr", share_once(F.col(rows)).cast(ROWS))
            .withColumn(prefix + "gu", unused_methods(F.col(runs)["runs"]))
            .withColumn(prefix + "gx", F.col(runs)["extra"])
            .withColumn(prefix + "gt", total_weight(F.col(prefix + "gr")))
            .drop(runs, rows))


def total_weight(rows: Column | str) -> Column:
    """Sum of the scored rows, NULL if there is none or one of them has no percentage."""
    scored = F.filter(col(rows), lambda r: r["mark"].isNull())
    total = F.aggregate(scored, F.lit(0.0), lambda a, r: a + r["pct"])
    return F.when(F.size(scored) > 0, F.bround(total, 1))


def eval_flags(raw: Column | str, rows: Column | str, unused: Column | str) -> dict[str, Column]:
    """1/0 per evaluation kind, from the parsed rows or, failing that, from free text."""
    rows, unused = col(rows), col(unused)
    active = F.array_join(F.transform(
        F.filter(rows, lambda r: F.coalesce(r["pct"] != 0, F.lit(True))), lambda r: r["method"]), "\n")
    clauses = F.filter(F.split(text_or_empty(raw), "[。；;\n]"), lambda x: ~has(x, V.NEGATION_WORDS))
    text = F.when((F.size(rows) > 0) | (F.size(unused) > 0), active).otherwise(F.array_join(clauses, "\n"))
    return {name: F.when(has(drop(text, V.QUIZ_WORDS) if name == "eval_exam" else text, words), 1).otherwise(0)
            for name, words in V.EVAL_WORDS.items()}
