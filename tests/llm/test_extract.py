import random
import re
from html import escape

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courseloom.llm.extract import alike, extract, keys_of, lines_of, main_text, place_of, shared

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("seed", range(60))
def test_shared_is_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    make = lambda: [x for x in (rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randrange(40)))]
    a, b = make(), make()
    single = lambda s: [x for k, x in enumerate(s) if not k or s[k - 1] != x]
    got = [a[p] for p in shared(a, b)]
    assert single(got) == single(got) and lcs(single(a), single(b)) == len([p for p in shared(a, b) if not p or a[p - 1] != a[p] or p - 1 not in shared(a, b)])
    rest = iter(single(b))
    starts = [a[p] for p in shared(a, b) if not p or a[p - 1] != a[p]]
    assert all(x in rest for x in starts)


def test_very_long_pages_align():
    a = list(range(20000))
    b = a[:7000] + [-1] * 3 + a[7500:] + [5] * 10
    assert shared(a, b) == [x for x in a if x < 7000 or x >= 7500]


def text_of(html):
    return main_text(lines_of(html), set())


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar x">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a?x=1>2">Menu</a></li></ul></nav><div class='top ad'>Buy</div>
    <script>var t="</p>"; if (a<b) {}</script><!-- note <p>hidden</p> -->
    <article><header><h1>The   head&amp;line</h1></header><p>One <b>two<br>three<p>Caf&eacute; &lt;b&gt; a&nbsp;b &am &amp c
    <div class="ad">Ad</div><aside>Side</aside><form><p>Form <button>Go</button></form><ul><li>item</ul>
    <section class="comments"><article>Me too</article></section></article>
    <footer>&copy; x</footer><p>after</body></html>"""
    assert text_of(page) == "The head&line\nOne two three\nCafé <b> a b &am & c\nitem"


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>open <i>end", "open end"), ("a < b <3 <p>c", "a < b <3\nc"), ("<article><p>x<script>y", "x"),
    ("<main><p>m</main><p>n", "m"), ("<article></article><p>only", "only"), ("<p>a<!-- b", "a"), ('<div class=sidebar><p>s</div><p>t', "t"),
    ("<article class=comment><p>c</article><p>t", "t"), ("</div></p>x</article>", "x"), ("<p title='a>b'>q</p >r", "q\nr"),
    ('<p>Before</p><svg width="1"/><p>After <math/>text</p>', "Before\nAfter text"), ("<p>a<svg><text>x</text></svg>b", "a b"), ("<p>a<script/>x</script>b", "a b"),
    ("<form id=f><nav>menu</nav><div><p>The body lies in a form</p><p>all of it</p></div></form>", "The body lies in a form\nall of it"),
    ("<p>A long text of the page itself</p><form><p>Your name</p></form>", "A long text of the page itself"),
    ('<article><p>x</p><p class="advert">buy</p><p class="lead">y</p></article>', "x\ny"),
])
def test_odd_pages(html, text):
    assert text_of(html) == text


def test_long_page_takes_linear_time():
    for part in ('<a "', "<a b='", "<p><", "<!--", "<div>", "</div>", "&amp", '<a b="c" ' * 3):
        lines_of(part * 60000)


def test_places():
    assert place_of("HTTP://A.Example/b/c?d#e") == ("a.example", "/b/c?d") and place_of(None) == ("", "")
    assert place_of("http://[x/") == ("", "http://[x/") and alike("/a/bc", "/a/bd") == 4


def template(host, k, body, article=False):
    menu = "".join(f"<li>{w}</li>" for w in ["home", "news", f"m{k}"][: 2 + k % 2])
    inner = f"<article>{body}</article>" if article else f"<div id=c>{body}</div>"
    return f"<body><nav><ul>{menu}</ul></nav><p>Welcome to {host}</p>{inner}<p>All rights reserved by {host}</p><div class=ad>ad {k}</div>"


@pytest.fixture
def case():
    rng, rows, want = random.Random(3), [], []
    for k in range(120):
        host = rng.choice(["hot.example"] * 3 + ["b.example", "c.example"])
        lines = [f"line {rng.random()} & more {k} {j}" for j in range(rng.randint(1, 6))]
        body = "".join(f"<p>{escape(x)}</p>" for x in lines)
        rows.append((k, f"http://{host}/{rng.choice('ab')}/{k}", template(host, k, body, k % 4 == 0)))
        want.append("\n".join(lines))
    rows += [(500, "http://alone.example/", "<p>Welcome to alone</p><article><p>x</p></article>"), (501, None, None), (None, "http://b.example/z", ""),
             (502, "http://c.example/same", template("c.example", 7, "<p>twin</p>")), (502, "http://c.example/same", template("c.example", 7, "<p>twin</p>"))]
    return rows, want + ["x", "", "", "twin", "twin"]


@pytest.mark.parametrize("parts", ["1", "8", "60"])
def test_extract(spark, case, parts):
    rows, want = case
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, PAGES).withColumn("shared", F.lit(1)).withColumn("k1", F.lit(2)).repartition(4)
        got = extract(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r["page_id"], r["text"]) for r in got], key=key) == sorted([(i, w) for (i, _, _), w in zip(rows, want)], key=key)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert extract(spark.createDataFrame([], PAGES)).collect() == []


def test_slots_of_asides_are_shared_by_place():
    a, b = (lines_of(template("h", k, f"<p>{k}</p>")) for k in (1, 2))
    gone = shared(keys_of(a), keys_of(b))
    assert [x.text for p, x in enumerate(a) if p not in gone] == ["1"]


def test_registered_pages_keep_their_article(spark):
    import os
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    from html import unescape

    from courseloom.llm.extract import op2_url_differencing

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op2_url_differencing(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r["page_id"]])[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def with_article(host, k, body):
    return (f"<body><nav>n{k}</nav><article><h1>Head {k}</h1><p>Share this on {host}</p>{body}<div><span>More of {host}</span></div></article>"
            f"<p>By {host}</p>")


def test_template_lines_leave_the_declared_article(spark):
    bodies = [f"<p>own words {k} of this page</p><p>and more {k}</p>" for k in range(30)]
    bodies[7] += "<p>own words 8 of this page</p>"                  # quotes its neighbour
    rows = [(k, f"http://h.example/p/{k:02}", with_article("h", k, b)) for k, b in enumerate(bodies)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert got == {k: f"Head {k}\nown words {k} of this page\nand more {k}" + "\nown words 8 of this page" * (k == 7) for k in range(30)}


def test_a_sentence_that_a_few_pages_share_stays(spark):
    """Neighbours at a host's ends and inside it, which have an ordinary sentence of the article, too."""
    bodies = [f"<p>own words {k} of this page</p><p>and more {k}</p>" for k in range(30)]
    for k in (0, 1, 11, 12, 13, 28, 29):
        bodies[k] += "<p>a sentence by chance</p>"
    rows = [(k, f"http://h.example/p/{k:02}", with_article("h", k, b)) for k, b in enumerate(bodies)]
    rows += [(40 + k, f"http://two.example/{k}", f"<article><p>page {k}</p><p>said on both</p></article>") for k in range(2)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert got == {**{k: f"Head {k}\nown words {k} of this page\nand more {k}" + "\na sentence by chance" * ("chance" in bodies[k]) for k in range(30)},
                   40: "page 0\nsaid on both", 41: "page 1\nsaid on both"}


def test_versions_of_an_article_stay_whole():
    body = [f"<p>paragraph {j} of one article</p>" for j in range(10)]
    a, b = (lines_of("<article>" + "".join(body[:4] + [f"<p>edited {k}</p>"] + body[4:]) + "</article>") for k in (1, 2))
    assert len(main_text(a, set(shared(keys_of(a), keys_of(b)))).split("\n")) == 11


@pytest.mark.parametrize("parts", ["1", "8"])
def test_copies_of_a_page_get_one_text(spark, parts):
    page = lambda k: f"<div><p>Welcome all</p><p>body {k}</p><p>Imprint</p></div>"
    rows = [(k, f"http://h.example/a/{k:02}", page(5 if 4 <= k < 12 else k)) for k in range(20)]
    rows += [(50, "http://h.example/z/9", page(5)), (51, "http://only.example/1", page(1)), (52, "http://only.example/2", page(1))]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = {k: f"body {5 if 4 <= k < 12 or k == 50 else k}" for k, *_ in rows[:21]}
    assert got == {**want, 51: "Welcome all\nbody 1\nImprint", 52: "Welcome all\nbody 1\nImprint"}
