"""Landed pages to structured courses. Every step works inside the row: no shuffle until
the rare categories are folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courseloom import values as V
from courseloom.functions import fields as FL
from courseloom.functions import grading as G
from courseloom.functions import plan as P
from courseloom.functions.text import blank_null, collapse, exploded
from courseloom.operators.facets import fold_values, rare_values
from courseloom.operators.sections import label_texts, sections_by_layout
from courseloom.session import written

KEY = ["university_id", "year", "course_code"]
STRUCTURED = [
    "university_id", "year", "course_code", "numbering", "title", "subtitle", "faculty", "faculty_raw",
    "department", "title_suffix", "target_grade", "grades", "category", "category_raw", "term_group",
    "credits", "required", "term", "language", "campus", "instructors", "is_undergrad", "is_intensive",
    "is_online", "eval_exam", "eval_report", "eval_quiz", "eval_attend", "eval_other", "prereq",
    "keywords", "goals", "plan", "extracted_sha256"]
NESTED = ["sl", "gr", "gu", "gx", "gt", "ep", "pl", "d"]


# the texts read from a body, in the order of their array: a label for each layout, or one for all of them
READ = {**V.FIELD_LABELS, **{f"{part}{i}": (label,) * len(V.LAYOUT_LABELS) for part, labels in (
    ("outline", V.OUTLINE_LABELS), ("grading", V.GRADING_LABELS), ("plan", V.PLAN_LABELS)) for i, label in enumerate(labels)}}


def field_texts(raw: DataFrame) -> DataFrame:
    """Raw rows with the text of each field, in the order of ``READ``, as one array ``x``; a field is read
    from the label of the row's layout. One array is cheaper to hand on than a column a field."""
    df = raw.withColumn("layout", F.coalesce("layout", F.lit("A"))).withColumn("_secs", sections_by_layout("body", "layout"))
    labels = {name: [at[i] for at in READ.values()] for i, name in enumerate(V.LAYOUT_LABELS)}
    other = [None if name in V.FIELD_LABELS else at[0] for name, at in READ.items()]
    return df.withColumn("x", label_texts("_secs", "layout", labels, other)).drop("_secs", "body")


def field(name: str) -> Column:
    return F.get("x", list(READ).index(name))


def structure_rows(raw: DataFrame) -> DataFrame:
    """Structured courses with their nested slots, grading rows, plan and outline.

    ``raw``: key, body, layout, body_sha256. The evaluation flags read the layout's own
    grading label; the shown rows read the first non-empty of all grading labels.
    """
    df = field_texts(raw)
    x = field
    df = df.withColumn("x_shown", P.first_non_empty([x(f"grading{i}") for i in range(len(V.GRADING_LABELS))]))
    # the two texts are nearly always the same: the second is parsed only where it differs
    same = x("grading") == F.col("x_shown")
    df = df.withColumn("x_own", F.when(~same, x("grading")).otherwise(""))
    df = G.with_grading(G.with_grading(df, "x_shown"), "x_own", "e_")
    df = df.withColumn("e_gr", F.when(same, F.col("gr")).otherwise(F.col("e_gr")))
    df = df.withColumn("e_gu", F.when(same, F.col("gu")).otherwise(F.col("e_gu")))
    df = P.with_plan(df, [x(f"plan{i}") for i in range(len(V.PLAN_LABELS))], "pl")
    faculty = F.coalesce(blank_null(x("faculty_cat")), blank_null(x("faculty")))
    flags = G.eval_flags(x("grading"), "e_gr", "e_gu")
    blob = F.concat_ws(" ", x("term"), x("slots"), x("remote"), x("method"), x("category"))
    columns = {
        "numbering": blank_null(x("numbering")), "title": blank_null(x("title")), "subtitle": blank_null(x("subtitle")),
        "faculty": faculty, "faculty_raw": blank_null(x("faculty")),
        "department": blank_null(FL.department(x("title"))), "title_suffix": blank_null(FL.title_suffix(x("title"))),
        "target_grade": blank_null(x("target_grade")), "grades": FL.grades(x("target_grade"), faculty),
        "category": blank_null(FL.merge_category(FL.normalize_category(x("category")), faculty)),
        "category_raw": blank_null(x("category")), "term_group": FL.term_group(x("term")), "credits": FL.credits(x("credits")),
        "required": blank_null(x("required")), "term": blank_null(x("term")), "language": blank_null(x("language")),
        "campus": blank_null(x("campus")), "instructors": blank_null(x("instructors")),
        "is_undergrad": FL.undergraduate(x("faculty"), x("faculty_cat"), x("category"), x("target_grade"), x("numbering")),
        "is_intensive": FL.flag(blob, V.INTENSIVE_WORDS), "is_online": FL.flag(blob, V.ONLINE_WORDS), **flags,
        "eval_other": blank_null(F.substring(x("grading"), 1, V.EVAL_OTHER_MAX)), "prereq": blank_null(x("prereq")),
        "keywords": blank_null(x("keywords")), "goals": blank_null(x("goals")), "plan": blank_null(x("plan1")),
        "extracted_sha256": F.col("body_sha256"),
        "sl": FL.slots(x("slots")), "gr": F.col("gr"), "gu": F.col("gu"), "gx": F.col("gx"), "gt": F.col("gt"),
        "ep": F.when(F.size("gr") > 0, "").otherwise(F.col("x_shown")), "pl": F.col("pl"),
        "d": P.outline([x(f"outline{i}") for i in range(len(V.OUTLINE_LABELS))]),
    }
    return df.select(*KEY, *[c.alias(n) for n, c in columns.items()]).select(*STRUCTURED, *NESTED)


def structure(raw: DataFrame) -> DataFrame:
    """Structured courses with rare categories folded.

    The rows are written once; the category counts read one column of them, and the short
    list of rare categories is written too, so that its known size decides the join.
    """
    rows = written(structure_rows(raw), "structured")
    undergrad = F.coalesce(F.col("is_undergrad") == 1, F.lit(False))
    rare = written(rare_values(rows, "category", undergrad), "rare")
    return fold_values(rows, rare, "category", undergrad).select(*STRUCTURED, *NESTED)


def slot_rows(structured: DataFrame) -> DataFrame:
    """One row per slot, numbered from 1."""
    return exploded(structured, KEY, F.col("sl"), "s", "seq").select(
        *KEY, "s.term", "s.weekday", "s.period", (F.col("seq") + 1).alias("seq"))


def weight_rows(structured: DataFrame) -> DataFrame:
    return exploded(structured, KEY, F.col("gr"), "r", "seq").select(*KEY, "seq", "r.*")


def plan_rows(structured: DataFrame) -> DataFrame:
    return exploded(structured, KEY, F.col("pl"), "r").select(*KEY, "r.*")


def keywords_of(col: Column) -> Column:
    return F.substring(collapse(F.coalesce(col, F.lit(""))), 1, V.KEYWORDS_MAX)
