"""Catalog report: totals, histograms, rates, changes, run list."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions.text import exploded


def metric(df: DataFrame, section: str, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))


def totals(tables: dict[str, DataFrame], three_valued: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Row count of each table, and of a three-valued flag's 1, 0 and NULL rows."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("key"), "n")
        out = row if out is None else out.union(row)
    if three_valued:
        df, flag = three_valued
        one = df.agg(F.count_if(F.col(flag) == 1).alias("a"), F.count_if(F.col(flag) == 0).alias("b"), F.count_if(F.col(flag).isNull()).alias("c"))
        out = out.union(one.select(F.expr(f"stack(3, '{flag}=1', a, '{flag}=0', b, '{flag} unknown', c) AS (key, n)")))
    return out


def member_counts(df: DataFrame, codes: str, order: dict[str, str]) -> DataFrame:
    """Rows per list member, in dictionary order; members without rows are not shown."""
    names = list(order)
    table = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    n = (df.select(F.explode(F.array_distinct(codes)).alias("code")).groupBy("code").agg(F.count("*").alias("n")))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("code")).cast("int")
    return n.select("code", table[F.col("code")].alias("label"), "n", place.alias("place")).where("place > 0")


UNKNOWN = "(unknown)"


def group_counts(df: DataFrame, column: str, unknown: str = UNKNOWN) -> DataFrame:
    return (df.groupBy(F.coalesce(F.col(column), F.lit(unknown)).alias(column)).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), column))


def flag_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """Count and percentage of each 0/1 flag in one pass."""
    agg = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c) == 1).alias(c) for c in flags])
    pairs = ", ".join(f"'{c}', {c}" for c in flags)
    rows = agg.select("_n", F.expr(f"stack({len(flags)}, {pairs}) AS (flag, n)"))
    return rows.select("flag", "n", (F.col("n") / F.greatest(F.col("_n"), F.lit(1)) * 100).alias("percent"))


def month_histogram(df: DataFrame, column: str) -> DataFrame:
    return (df.where(F.col(column).isNotNull()).groupBy(F.substring(F.col(column).cast("string"), 1, 7).alias("month"))
            .agg(F.count("*").alias("n")))


def change_counts(log: DataFrame, since: Column) -> DataFrame:
    """Changes by day and kind since a moment."""
    return (log.where(F.col("detected_at") >= since).groupBy(F.to_date("detected_at").alias("day"), "kind")
            .agg(F.count("*").alias("n")))


def updates_total(log: DataFrame, since: Column) -> DataFrame:
    return log.where(F.col("detected_at") >= since).agg(F.count_if(F.col("kind") != "new").alias("n_updates"))


def run_list(runs: DataFrame) -> DataFrame:
    """Runs in order, with the state of runs that never recorded one and dashes for blanks."""
    state = F.coalesce("status", F.when(F.col("ended_at").isNotNull(), "ok").otherwise("interrupted or running"))
    dash = lambda c, zero: F.coalesce((F.nullif(F.col(c), F.lit(0)) if zero else F.col(c)).cast("string"), F.lit("-"))
    size = F.coalesce(F.when(F.col("bytes") > 0, F.format_string("%.2f GB", F.col("bytes") / F.lit(1e9))), F.lit("-"))
    return runs.select("run_id", "job", state.alias("status"), "started_at", dash("n_target", True).alias("n_target"),
                       dash("n_fetched", True).alias("n_fetched"), dash("n_changed", False).alias("n_changed"),
                       F.coalesce("n_error", F.lit(0)).alias("n_error"), size.alias("size"),
                       F.coalesce(F.nullif("note", F.lit("")), F.lit("-")).alias("note")).orderBy("run_id")


def mark_totals(courses: DataFrame, key: str, cohort: str, marks: str) -> tuple[DataFrame, DataFrame]:
    """How often each mark occurs, and how many codes are marked differently by cohort."""
    letters = exploded(courses, [], F.filter(F.split(marks, ""), lambda x: x != ""), "mark")
    both = courses.groupBy(key).agg(F.count("*").alias("n"), F.min(marks).alias("lo"), F.max(marks).alias("hi"),
                                    F.max(F.length(marks)).alias("any")).where("any > 0")
    differ = both.agg(F.count_if(F.col("n") > 1).alias("in_both"),
                      F.count_if((F.col("n") > 1) & (F.col("lo") != F.col("hi"))).alias("differing"))
    return letters.groupBy("mark").agg(F.count("*").alias("n")), differ


def coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(F.col(column), F.lit("")) != "").alias("n_with"), F.count("*").alias("n_all"))


def sample_rows(df: DataFrame, key: str, n: int = 12, seed: int = 1) -> DataFrame:
    """A seeded sample of n rows for spot checks: those with the least hash of seed and key, so it
    doesn't depend on how the rows are dealt out."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), key).limit(n)


@dataclass
class Counted:
    """Groups of a section: a column, what is summed in each of its groups (rows, if nothing is given),
    and the name of the group without a value (groups without a name are left out)."""

    by: Column
    value: Column | None = None
    unknown: str | None = None


def figures(df: DataFrame, sections: dict[str, Counted], whole: list[tuple[str, str, Column]]) -> DataFrame:
    """(section, key, value) of a table in one pass: counts by the columns of ``sections`` and the
    figures (section, key, aggregate) over all rows, as grouping sets of one aggregation.

    Groups whose value is 0 are left out. Tasks combine the groups before anything is shuffled, so
    what is shuffled are the groups, however often a value occurs.
    """
    names = [f"_g{i}" for i in range(len(sections))]
    marked = df.withColumns({n: c.by.cast("string") for n, c in zip(names, sections.values())})
    sums = [(F.sum(c.value) if c.value is not None else F.count(F.lit(1))).cast("double").alias(f"_v{i}") for i, c in enumerate(sections.values())]
    wholes = [agg.cast("double").alias(f"_w{i}") for i, (_, _, agg) in enumerate(whole)]
    sets = [[n] for n in names] + [[]]
    agg = (marked.groupingSets([[F.col(n) for n in s] for s in sets], *names).agg(F.grouping_id().alias("_id"), *sums, *wholes) if names
           else marked.agg(F.lit(0).alias("_id"), *wholes))
    every = 2 ** len(names) - 1
    row = lambda section, key, value: F.struct(F.lit(section).alias("section"), key.alias("key"), value.alias("value"))
    rows = [F.when((F.col("_id") == every - 2 ** (len(names) - 1 - i)) & (F.col(f"_v{i}") > 0) & (key := F.coalesce(names[i], F.lit(c.unknown).cast("string"))).isNotNull(),
                   row(section, key, F.col(f"_v{i}"))) for i, (section, c) in enumerate(sections.items())]
    rows += [F.when(F.col("_id") == every, row(section, F.lit(key), F.col(f"_w{i}"))) for i, (section, key, _) in enumerate(whole)]
    return agg.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def report(index: DataFrame, raw: DataFrame, structured: DataFrame, summary: DataFrame) -> DataFrame:
    """All figures as one (section, key, value) table; each of the four tables is read once."""
    one, none = F.lit(1), F.lit(0)
    # a listing counts once for each of its codes, and the empty code stands for the listing itself
    codes = F.array_union(F.array(F.lit("")), F.array_distinct(F.coalesce("kaiko_cd", F.array().cast("array<string>"))))
    listed = index.select(F.explode(codes).alias("code"))
    known = F.when(F.col("code").isin(list(V.TERM_CODES)), F.col("code"))
    flag, ug = F.col("is_undergrad"), F.coalesce(F.col("is_undergrad") == 1, F.lit(False))
    flags = ["eval_exam", "eval_report", "eval_quiz", "eval_attend"]
    share = lambda c: F.count_if(ug & (F.col(c) == 1)) / F.greatest(F.count_if(ug), F.lit(1)) * 100
    parts = [
        figures(listed, {"term codes": Counted(known)}, [("totals", "index", F.count_if(F.col("code") == ""))]),
        figures(raw, {"layouts": Counted(F.col("layout"), unknown=UNKNOWN), "updated": Counted(F.substring(F.col("updated_at").cast("string"), 1, 7))},
                [("totals", "raw", F.count(one))]),
        figures(structured, {"faculties": Counted(F.col("faculty"), F.when(ug, one).otherwise(none), UNKNOWN)},
                [("totals", "structured", F.count(one)), ("totals", "is_undergrad=1", F.count_if(flag == 1)), ("totals", "is_undergrad=0", F.count_if(flag == 0)),
                 ("totals", "is_undergrad unknown", F.count_if(flag.isNull())), *[("evaluation", c, share(c)) for c in flags]]),
        figures(summary, {}, [("totals", "summary", F.count(one))]),
    ]
    return reduce(DataFrame.union, parts)
