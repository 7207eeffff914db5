"""Queries against their SQL on small tables that the given ones have no rows like."""

import html
import re
from html.entities import html5

import pytest

import __spark_entry__ as entry
from tests.oracle import rows_of

duckdb = pytest.importorskip("duckdb")

PAGES = ["<p>The a &amp b &amp</p>\n<p>c &copy; d &quot;e&quot; &amp;amp; &lt; &#65; &copy</p>", "Of x&ampUn &amp;copy; &middot;&nbsp", "And &amp;&amp &copy&copy; y&middot z &middot; w", None]


def same(spark, folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    df, want = entry.queries()[name](spark, str(folder)), con.execute(entry.oracle_sql()[name])
    return rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", ["html_to_text", "page_layout_cut", "page_text_hash"])
def test_references_that_the_writer_does_not_make_are_text(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert same(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["unknown_codes", "missing_by_faculty"])
def test_codes_of_orders_that_read_alike(spark, tmp_path, name):
    keys = [(1, "F"), (2, "P"), (3, "O"), (5000001, "F"), (5000002, "P"), (5000003, "P"), (10000010, "O"), (10000011, "P"), (10000012, "P")]
    spark.createDataFrame([(k, k % 3, s, 1.0, "1-URGENT") for k, s in keys], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").selectExpr(
        "*", "timestamp'1995-05-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"name {k}", "b", f"TYPE {k}", 4, 1.0) for k in range(3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(
        f"{tmp_path}/part.parquet")
    assert same(spark, tmp_path, name)


def test_every_reference_of_a_page_is_decoded(spark, tmp_path):
    """Against the steps in plain Python, and against the SQL."""
    numbers = [0, 1, 8, 9, 11, 13, 27, 65, 127, 128, 129, 159, 160, 0x3042, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 2 ** 40, 2 ** 80]
    pages = [*PAGES[:-1], "<p>a&nbsp;</p>&emsp; b &lt;i&gt; &notit; &copyx &AMPx &hellip;&#12288;c&#10;&#10;&#10;&#10;d</p>", "a &bogus; &#; & &#x; &日; &a b&Tab;&NewLine;&NewLine; &NewLine;c",
             " ".join(f"|&#{n};|&#x{n:x};|&#X{n:X}|&#{n}" for n in numbers), " ".join(f"|&{x}|&{x[:-1]}" for x in html5), "plain \u3000 text", "", "&amp;amp;"]

    def text_of(t):
        for pattern, by in ((r"(?is)<script.*?</script>", ""), (r"(?is)<style.*?</style>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<br\s*/?>", "\n"),
                            (r"(?i)</(td|tr|div|p|table|h[1-6]|li)>", "\n"), (r"<[^>]+>", "")):
            t = re.sub(pattern, by, t)
        t = "\n".join(x.strip() for x in html.unescape(t).replace("\u3000", " ").split("\n"))
        return re.sub(r"\n{3,}", "\n\n", t).strip()

    spark.createDataFrame([*enumerate(pages), (99, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in entry.queries()["html_to_text"](spark, str(tmp_path)).collect()}
    assert got == {**{i: text_of(x) for i, x in enumerate(pages)}, 99: None}
    assert same(spark, tmp_path, "html_to_text")


def test_one_column_by_the_label_of_each_layout(spark, tmp_path):
    texts = ["x\nAll rights reserved.\none\n two \nIetzte.\nthree\nAll rights reserved.\nfour\nLe treque.\nfive", "All rights reserved.", "Ietzte.\n\n", "none", "", None]
    rows = [(i * 10 + k, lang, text) for i, lang in enumerate(["en", "de", "fr", "es", "it", None]) for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert same(spark, tmp_path, "layout_projection")
