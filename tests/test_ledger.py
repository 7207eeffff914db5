import pytest
from pyspark.sql import functions as F

from courseloom.operators.ledger import Ledger

ROWS = "k int, ok boolean, changed boolean, n int"


def last(ledger):
    return {r["job"]: r for r in ledger.runs().collect()}


@pytest.fixture
def ledger(spark, tmp_path):
    return Ledger(spark, str(tmp_path / "runs"))


def counted():
    return {"ok": F.col("ok"), "changed": F.col("changed"), "size": F.col("n")}


def test_counts_of_the_write(spark, ledger, tmp_path):
    df = spark.createDataFrame([(1, True, True, 5), (2, True, False, 7), (3, False, True, 100), (4, None, None, None), (5, True, None, None)], ROWS).repartition(3)
    with ledger.job("detail", "year=2026") as run:
        assert last(ledger)["detail"]["status"] == "running"
        run.write(df, lambda out: out.write.parquet(str(tmp_path / "out")), **counted())
    r = last(ledger)["detail"]
    assert [r[c] for c in ("n_target", "n_fetched", "n_changed", "n_error", "bytes", "status", "scope")] == [5, 3, 1, 2, 12, "failed", "year=2026"]
    assert r["ended_at"] >= r["started_at"] and r["note"].endswith("s") and spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_several_writes_and_empty_ones(spark, ledger, tmp_path):
    df = spark.createDataFrame([(1, True, True, 5)], ROWS)
    with ledger.job("sweep", "all") as run:
        run.write(df, lambda out: out.write.parquet(str(tmp_path / "a")), **counted())
        run.write(df.where("false"), lambda out: out.write.parquet(str(tmp_path / "b")), **counted())
        run.write(df, lambda out: out.write.parquet(str(tmp_path / "c")), ok=F.lit(True))
    r = last(ledger)["sweep"]
    assert [r[c] for c in ("n_target", "n_fetched", "n_changed", "n_error", "bytes", "status")] == [2, 2, 1, 0, 5, "ok"]
    with ledger.job("nothing", ""):
        pass
    assert [last(ledger)["nothing"][c] for c in ("n_target", "status")] == [0, "ok"]


def test_exceptions_abort_and_go_on(spark, ledger, tmp_path):
    df = spark.createDataFrame([(1, True, True, 5)], ROWS)
    with pytest.raises(Exception, match="broken row"):
        with ledger.job("detail", "year=2026") as run:
            run.write(df.withColumn("x", F.raise_error(F.lit("broken row"))), lambda out: out.write.parquet(str(tmp_path / "x")), **counted())
    with pytest.raises(KeyboardInterrupt):
        with ledger.job("export", "") as run:
            run.write(df, lambda out: out.write.parquet(str(tmp_path / "y")), **counted())
            raise KeyboardInterrupt
    got = last(ledger)
    assert [(got[j]["status"], got[j]["n_target"]) for j in ("detail", "export")] == [("aborted", None)] * 2
    assert len(ledger.runs().collect()) == 2
