import pytest

from courseloom.operators.snapshots import StaleError
from courseloom.plans.publish import Part, Publication


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v int")


def shown(site, part):
    return sorted(r["v"] for r in site.spark.read.schema("v int").json(site.folder(part)).collect())


def test_readers_see_whole_versions_only(spark, tmp_path):
    site = Publication(spark, str(tmp_path))
    assert site.current() == (0, {})
    assert site.publish({"a": Part(rows(spark, 1, 2)), "b": Part(rows(spark, 7), guarded=True)}) == []
    assert (shown(site, "a"), shown(site, "b")) == ([1, 2], [7])

    def broken(df, folder):
        assert shown(site, "a") == [1, 2]                               # staged, but not yet seen
        raise OSError("no space")

    with pytest.raises(OSError):
        site.publish({"a": Part(rows(spark, 3)), "b": Part(rows(spark, 8), broken)})
    assert (site.current()[0], shown(site, "a"), shown(site, "b")) == (1, [1, 2], [7])
    assert site.publish({"a": Part(rows(spark)), "b": Part(rows(spark), guarded=True)}) == ["b"]
    assert (site.current()[0], shown(site, "a"), shown(site, "b")) == (2, [], [7])
    assert site.publish({"a": Part(rows(spark, 5)), "b": Part(rows(spark, 9), guarded=True)}) == []
    assert (shown(site, "a"), shown(site, "b")) == ([5], [9])


def test_gates_before_and_after_staging(spark, tmp_path):
    site, asked = Publication(spark, str(tmp_path)), []

    def gate():
        asked.append(1)
        if len(asked) == 4:
            raise StaleError("a text landed meanwhile")

    site.publish({"a": Part(rows(spark, 1))}, [gate])
    with pytest.raises(StaleError):
        site.publish({"a": Part(rows(spark, 2))}, [gate])
    assert len(asked) == 4 and shown(site, "a") == [1]
    site.publish({"a": Part(rows(spark, 3))}, [gate])
    assert shown(site, "a") == [3] and site.current()[0] == 2


def test_first_publication_without_rows(spark, tmp_path):
    site = Publication(spark, str(tmp_path))
    site.publish({"a": Part(rows(spark), guarded=True)})
    assert shown(site, "a") == []


def test_site_publication_reads_its_catalog_from_one_written_step(spark, monkeypatch):
    from courseloom.workloads import outputs

    given = []
    monkeypatch.setattr(outputs.PB, "publish_site", lambda site, catalog, raw, structured, *_, **__: given.extend([catalog, raw, structured]) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        outputs.site_publication(spark, "/root/testdata/sf0.001")
    assert len(given) == 3
    for frame in given:                                  # not the tables that the catalog is joined and parsed from
        assert frame.inputFiles() and not any("orders.parquet" in f or "customer.parquet" in f for f in frame.inputFiles())
