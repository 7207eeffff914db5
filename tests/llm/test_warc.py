import gzip
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courseloom.llm import warc
from courseloom.llm.warc import LoserTree, archive, order, parse_records, url_key

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


@pytest.mark.parametrize("seed", range(30))
def test_loser_tree(seed):
    rng = random.Random(seed)
    runs = [sorted((rng.randrange(20), k) for _ in range(rng.choice([0, 1, 5, 60]))) for k in range(rng.choice([0, 1, 2, 3, 7, 16]))]
    got = list(LoserTree([iter(r) for r in runs], lambda row: row[0]))
    assert got == sorted((x for r in runs for x in r))        # equal keys in the order of the runs


def test_url_key():
    assert url_key("https://user@Blog.Example.com:80/A/b?c=D#e") == "com:80,example,blog)/a/b?c=d"
    assert url_key("http://a.b") == "b,a)/" and url_key("") == ")/" and url_key("http://[") == "http://["


def test_records_are_cut_by_length():
    body = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nx"
    one = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    assert [(at, data) for _, at, a, b in parse_records(one * 3) for data in [(one * 3)[a:b]]] == [(k * len(one), body) for k in range(3)]
    with pytest.raises(ValueError):
        list(parse_records(b"x\r\n\r\n"))


def expected(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        again = len(data) >= 100 and bool(same) and i != min(same)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return out


@pytest.fixture
def rows():
    rng = random.Random(8)
    big = [f"<p>{'é' * rng.randint(30, 90)} {k} WARC/1.1\r\n\r\n\r\n\r\n</p>" * 3 for k in range(12)]
    rows = [(i, f"http://{rng.choice('abc')}.example/{rng.randrange(9)}", rng.choice(big)) for i in rng.sample(range(1000), 150)]
    rows += [(2000, None, None), (2001, "http://x\r\nInjected: y", "short"), (2002, "", "short"), (None, "http://n", big[0]), (None, "http://n", "z" * 300),
             (2003, "http://a.example/0", "y" * 99), (2004, "http://a.example/0", "y" * 99), (2005, "u", "y" * 100), (2006, "u", "y" * 100),
             (2005, "u", "y" * 100), (2007, "http://long", "日本" * 200000)]
    return rows


@pytest.mark.parametrize("spool", [64, 32 << 20])
def test_archive(spark, rows, tmp_path, monkeypatch, spool):
    monkeypatch.setattr(warc, "SPOOL_BYTES", spool)
    monkeypatch.setattr(warc, "FILE_RECORDS", 20)
    df = spark.createDataFrame(rows, PAGES).withColumn("file", F.lit("clash")).withColumn("first", F.lit(1)).repartition(4)
    path = f"{tmp_path}/warc"
    got = [tuple(r) for r in archive(df, path).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r[:2]) + (str(r[2:]),)
    assert sorted([(r[2], r[4], r[3], r[5], r[6]) for r in got], key=key) == sorted(expected(rows), key=key)
    assert got == sorted(got, key=order)                      # the parts, one after the other, are the global order
    files = {p.name: gzip.decompress(p.read_bytes()) for p in Path(path).glob("*.gz")}
    assert len(files) > 4
    by_id = {i: h for i, _, h in rows}
    for r in got:
        record = files[r[7]][r[8]:r[8] + r[9]]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        payload = record[:-4].split(b"\r\n\r\n", 2)[2]
        assert payload == (b"" if r[5] == "revisit" else (by_id[r[2]] or "").encode() if r[2] is not None else payload)
    assert sum(map(len, files.values())) == sum(r[9] for r in got)


def test_nothing(spark):
    assert archive(spark.createDataFrame([], PAGES)).collect() == []
