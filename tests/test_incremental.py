"""Incremental re-derivation with a small stand-in for the extraction, whose plan is costly to compile;
the query ``rederived_courses`` runs the real one against SQL."""

import random

import pytest
from pyspark.sql import functions as F

from courseloom.operators.facets import fold_rare
from courseloom.plans import incremental
from courseloom.plans.extraction import KEY
from courseloom.plans.incremental import COUNTED, Derived, undergrad

RAW = "university_id string, year int, course_code string, body string"
FIELDS = ["title", "faculty", "category"]


def extracted(raw):
    parts = F.split("body", "/")
    fields = [F.nullif(parts[i], F.lit("")).alias(n) for i, n in enumerate(FIELDS)]
    return raw.select(*KEY, *fields, parts[1].alias("faculty_raw"), F.when(parts[1].endswith("部"), 1).otherwise(0).alias("is_undergrad"),
                      F.col("body_sha256").alias("extracted_sha256"))


@pytest.fixture(autouse=True)
def small_extraction(monkeypatch):
    monkeypatch.setattr(incremental, "structure_rows", extracted)
    monkeypatch.setattr(incremental, "STRUCTURED", [*KEY, *FIELDS, "faculty_raw", "is_undergrad", "extracted_sha256"])
    monkeypatch.setattr(incremental, "NESTED", [])


def raw(spark, courses):
    rows = [("u", 2026, code, f"講義{code}/{faculty}/{category}") for code, (faculty, category) in courses.items()]
    return spark.createDataFrame(rows, RAW).withColumn("body_sha256", F.sha2("body", 256)).repartition(2)


def lines(df):
    return sorted(str(r) for r in df.collect())


def test_updates_equal_full_runs(spark, tmp_path):
    rng = random.Random(5)
    choice = lambda: (rng.choice(["経済学部", "文学部", "理学府"]), rng.choice(["必修", "選択", "希少", "専攻", ""]))
    now = {f"c{i}": choice() for i in range(60)}
    derived = Derived(spark, str(tmp_path / "courses"))
    derived.update(raw(spark, now))
    for step in range(3):
        if step == 2:
            derived.compact()
        before = dict(now)
        for code in rng.sample(sorted(now), 4):
            del now[code]
        for code in rng.sample(sorted(now), 6):
            now[code] = choice()
        now |= {f"n{step}{i}": choice() for i in range(5)} | {code: choice() for code in rng.sample(sorted(before), 2)}
        derived.update(raw(spark, now))
        full = extracted(raw(spark, now))
        assert lines(derived.rows()) == lines(full)
        for part, counted in COUNTED.items():
            found = counted(full)
            assert lines(derived.counts(part).select(*found.columns, "n")) == lines(found.groupBy(*found.columns).agg(F.count("*").alias("n")))
        last = derived.commits().orderBy(F.desc("v")).first()
        changed = [c for c in now if before.get(c) != now[c]]
        assert (last["n_extracted"], last["n_gone"]) == (len(changed), len([c for c in before if c not in now]))
        assert lines(derived.structured()) == lines(fold_rare(full, "category", undergrad()).select(*incremental.STRUCTURED))


def test_nothing_changed_and_unfinished_runs(spark, tmp_path):
    now = {f"c{i}": ("経済学部", "必修") for i in range(8)}
    derived = Derived(spark, str(tmp_path / "courses"))
    derived.update(raw(spark, now))
    want = lines(derived.rows())
    derived.update(raw(spark, now))
    assert lines(derived.rows()) == want and derived.commits().orderBy(F.desc("v")).first()["n_extracted"] == 0
    # a run that died before its commit left rows behind: they don't count, and the next run replaces them
    derived._write(derived.rows().withColumn("title", F.lit("broken")), "rows", 2)
    derived._write(derived.rows(*KEY).withColumn("gone", F.lit(True)), "keys", 2)
    assert lines(derived.rows()) == want
    derived.update(raw(spark, now | {"c9": ("文学部", "選択")}))
    assert len(lines(derived.rows())) == 9 and derived.rows("title").where("title = 'broken'").count() == 0


def test_members_are_pruned_by_stored_counts(spark, tmp_path):
    derived = Derived(spark, str(tmp_path / "courses"))
    derived.update(raw(spark, {"a": ("経済学部", "必修")}))
    derived._write(spark.createDataFrame([("経済学部", "経営", 9), ("経済学部", "経工", 2)], "f string, member string, n bigint"), "members", 0)
    records = spark.createDataFrame([("a", "経済学部", ["経工", "経営"]), ("b", "経済学部", ["経工"]), ("c", "文学部", ["経営"])], "c string, f string, dp array<string>")
    assert {r["c"]: r["dp"] for r in derived.pruned(records).collect()} == {"a": ["経営"], "b": None, "c": None}
