"""Main text of HTML pages by differencing each page with its nearest by URL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courseloom.llm.common import partitions, query, step, table

# elements whose content isn't text of the page
HIDDEN = "script|style|noscript|template|title|textarea|select|svg|math|iframe|object|canvas|audio|video"
# (what is never closed goes on to the end, so no piece is searched twice)
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:svg|math)\b[^>]*/>|<({HIDDEN})\b[^>]*>.*?(?:</\1\s*>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

HOLDERS = frozenset("div section article main nav header footer aside form ul ol dl table menu dialog details fieldset figure button".split())
BLOCKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre hr figcaption address "
                             "summary legend body html head center".split())
# elements, and words of their class, id or role, that hold no main text
ASIDES = frozenset("nav footer aside menu dialog button fieldset".split())
FORM_SHARE = 0.5            # a form with more of a page's text is its frame, not an aside
HINTS = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
                  "header footer sidebar cookie cookies consent notice notices popup modal newsletter subscribe share social related "
                  "recommended login search pagination pager copyright complementary contentinfo comment comments reply replies "
                  "discussion disqus".split())
TALK = frozenset("comment comments reply replies discussion disqus".split())

PARTS = frozenset("ad ads advert advertisement adverts sponsor sponsored promo promotion cookie cookies newsletter".split())   # of a paragraph, too

VERSION = 0.75              # an article that shares more of its characters is a version of the partner's
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5 # a line leaves an article if so many different pages of the host, and over this share of them, have it


@dataclass
class Line:
    """A block of text: the path of the elements around it, whether these say that it isn't main
    text, and whether it is in the declared article."""

    slot: str
    aside: bool
    article: bool
    text: str


def lines_of(html: str | None) -> list[Line]:
    """The blocks of a page that have text, in page order."""
    out: list[Line] = []
    stack: list[tuple[str, str, bool, bool, bool, bool]] = []       # name, path, aside, article, talk, form
    now, said, parts, at, html = "body", False, [], 0, html or ""
    formed: list[int] = []                              # lines that only a form says are none of the main text

    def close() -> None:
        if parts and (text := " ".join("".join(parts).split())):
            _, path, aside, article, _, form = stack[-1] if stack else ("", "", False, False, False, False)
            if form and not (aside or said):
                formed.append(len(out))
            out.append(Line(f"{path}>{now}", aside or said or form, article, text))
        parts.clear()

    for token in TOKEN.finditer(html):
        if token.start() > at:
            parts.append(unescape(html[at:token.start()]))
        at = token.end()
        name = token[3]
        if not name:
            parts.append("" if token[0].startswith("<!--") else " ")
            continue
        name = name.lower()
        if name not in BLOCKS:
            if name == "br":
                parts.append(" ")
            continue
        close()
        now, said = name, False
        if name not in HOLDERS:
            said = not token[2] and bool(hints_of(token[4]) & PARTS)
            continue
        if token[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            now = "body"
            continue
        _, path, aside, article, talk, form = stack[-1] if stack else ("", "", False, False, False, False)
        hints = hints_of(token[4])
        if name == "main" or name == "article" and not (talk or hints & TALK):
            aside, article, form = False, True, False
        else:
            talk = talk or name in ("nav", "aside", "footer") or bool(hints & TALK)
            aside = aside or name in ASIDES or bool(hints - {"header"}) or (name == "header" or "header" in hints) and not article
            form = form or name == "form"
        stack.append((name, f"{path}>{name}{'.' + '.'.join(sorted(hints)) if hints else ''}", aside, article, talk, form))
    if at < len(html):
        parts.append(unescape(html[at:]))
    close()
    if formed and sum(len(out[k].text) for k in formed) > FORM_SHARE * sum(len(x.text) for x in out):
        for k in formed:
            out[k].aside = False
    return out


def hints_of(attributes: str | None) -> set[str]:
    """Words of an element's class, id and role that say what it holds."""
    return {w for m in ATTRIBUTE.finditer(attributes or "") for w in re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())} & HINTS


def keys_of(lines: list[Line]) -> list[int]:
    """What lines are compared by: their slot and text; where the elements already say that it
    isn't main text the slot alone, as such slots are filled anew on every page of a template. Keys of
    lines of a declared article are odd."""
    from xxhash import xxh64_intdigest

    return [(xxh64_intdigest(x.slot if x.aside else f"{x.slot}\n{x.text}") >> 1 << 1 | (x.article and not x.aside)) - (1 << 63) for x in lines]


def shared(mine: list[int], other: list[int]) -> list[int]:
    """Positions in ``mine`` of a longest common subsequence with ``other``; a run of one slot
    counts as one line, so a menu of six is shared with a menu of four. Bit-parallel: a row of the
    table is one long number, and lines that the other page lacks never enter it."""
    a, b = _runs(mine), _runs(other)
    common = {k for k, _ in a} & {k for k, _ in b}
    a, b = [x for x in a if x[0] in common], [x for x in b if x[0] in common]
    low = 0
    while low < min(len(a), len(b)) and a[low][0] == b[low][0]:
        low += 1
    found = [at for _, at in a[:low]]
    a, b = a[low:], b[low:]
    where: dict[int, int] = {}
    for j, (k, _) in enumerate(b):
        where[k] = where.get(k, 0) | 1 << j
    row, rows, mask = (1 << len(b)) - 1, [], (1 << len(b)) - 1
    for k, _ in a:
        hit = row & where.get(k, 0)
        row = ((row + hit) | (row - hit)) & mask
        rows.append(row)
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                found.append(a[i][1])
                j -= 1
    return sorted(p for at in found for p in at)


def _runs(keys: list[int]) -> list[tuple[int, list[int]]]:
    out: list[tuple[int, list[int]]] = []
    for p, k in enumerate(keys):
        if out and out[-1][0] == k:
            out[-1][1].append(p)
        else:
            out.append((k, [p]))
    return out


def main_text(lines: list[Line], deleted: set[int], quoted: set[int] | frozenset[int] = frozenset()) -> str:
    """What is left when the lines shared with the partner are gone.

    Inside the declared article as outside of it, but there guards keep main text: a line that only
    the partner has and not the page on the other side, or not most pages of the host, (``quoted``) is
    a quotation, and where shared lines hold more than VERSION of the article's characters the partner is another version
    of the same article, which says nothing of its lines. Then the exact check: nothing that the
    elements call an aside stays (a slot that the partner lacks), and of a page with a declared
    article nothing but the article.
    """
    own = [(p, x) for p, x in enumerate(lines) if x.article and not x.aside]
    if not own:
        return "\n".join(x.text for p, x in enumerate(lines) if not x.aside and p not in deleted)
    left = [x for p, x in own if p not in deleted or p in quoted]
    if sum(len(x.text) for x in left) < (1 - VERSION) * sum(len(x.text) for _, x in own):
        left = [x for _, x in own]
    return "\n".join(x.text for x in left)


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path with query of a URL; one that can't be read is all path."""
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def alike(a: str, b: str) -> int:
    """Length of the common beginning of two paths."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


PAGE = [("k1", pa.int64()), ("k2", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("keys", pa.list_(pa.int64()))]
PAGE_SQL = "k1 long, k2 long, host string, path string, keys array<long>"
EDGE = [*PAGE, ("near_path", pa.string()), ("near_keys", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_()),
        ("part", pa.int32()), ("near", pa.int32()), ("shared", pa.list_(pa.int32()))]
EDGE_SQL = PAGE_SQL + ", near_path string, near_keys array<long>, first boolean, last boolean, part int, near int, shared array<int>"
FOUND_SQL = "k1 long, k2 long, host string, keys array<long>, near int, shared array<int>"
MERGED_SQL = "g1 long, g2 long, host string, doubt array<struct<p:int,key:bigint>>, shared array<int>"


def _pick(path: str, keys: list[int], *others: tuple[str, list[int]] | None) -> tuple[int, list[int]]:
    """How near the nearest of the neighbours is, and the lines shared with it, as 2 * position, and
    1 more if another neighbour lacks the line; -1 without a neighbour of other lines."""
    found = sorted((o for o in others if o and o[0] is not None and o[1] != keys), key=lambda o: -alike(path, o[0]))
    if not found:
        return -1, []
    on_all = set(keys).intersection(*(o[1] for o in found[1:]))
    return alike(path, found[0][0]), [2 * p + (keys[p] not in on_all) for p in shared(keys, found[0][1])]


def _merged(found: list[tuple[int, list[int]]]) -> list[int]:
    """Of what the first and the last place of a page found, that of the nearer neighbour; what the
    other's neighbour lacks is marked too."""
    (_, best), *rest = sorted((f for f in found if f[0] >= 0), reverse=True) or [(-1, [])]
    return [x | any(x >> 1 not in {y >> 1 for y in other} for _, other in rest) for x in best]


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of host and path: the neighbours of a row are the two rows around it, if they
    are of the same host. The rows at either end of the part are passed on with what is known."""
    part = TaskContext.get().partitionId()

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(len(PAGE))))

    def of(row, host):
        return (row[3], row[4]) if row and row[2] == host else None

    out: list[tuple] = []
    before, now = None, None
    for after in rows():
        if now:
            next_to = of(after, now[2])
            out.append((*now, *(next_to or (None, None)), True, False, part, None, None) if before is None else
                       (*now, None, None, False, False, part, *_pick(now[3], now[4], of(before, now[2]), next_to)))
        before, now = now, after
        if len(out) >= 1000:
            yield _table(out)
            out = []
    if now:
        near = of(before, now[2])
        out.append((*now, *(near or (None, None)), before is None, True, part, None, None))
    yield _table(out)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(EDGE)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, EDGE)], [n for n, _ in EDGE])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        found = [_pick(r["path"], r["keys"], (r["near_path"], r["near_keys"]),
                       (r["lag_path"], r["lag_keys"]) if r["first"] and r["lag_host"] == r["host"] else None,
                       (r["lead_path"], r["lead_keys"]) if r["last"] and r["lead_host"] == r["host"] else None) for r in rows]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "host", "keys")), pa.array([f[0] for f in found], pa.int32()),
                                          pa.array([f[1] for f in found], pa.list_(pa.int32()))], ["k1", "k2", "host", "keys", "near", "shared"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_merged([(x["near"], x["shared"]) for x in f]) for f in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.int32()))], ["g1", "g2", "host", "doubt", "shared"])


def _spared(merged: DataFrame, folded: DataFrame) -> DataFrame:
    """g1, g2, shared: lines of an article that the partner has, but not most pages of the host, are
    marked as quotations. Pages are counted for such lines alone: what a few pages share by chance."""
    doubts = step(merged.select("g1", "g2", "host", F.explode("doubt").alias("d")).select("g1", "g2", "host", "d.p", "d.key"), "doubts")
    if doubts.isEmpty():
        return merged.select("g1", "g2", "shared")
    asked = step(doubts.select("host", "key").distinct(), "asked")
    once = folded.filter("place = 0")                   # a page has a row for its first path, and one for its last
    pages = once.groupBy("host").agg(F.count("*").alias("pages"))
    having = (once.select("host", F.explode(F.array_distinct("keys")).alias("key")).join(asked, ["host", "key"], "left_semi")
              .groupBy("host", "key").agg(F.count("*").alias("n")))
    template = having.join(pages, "host").filter((F.col("n") >= TEMPLATE_PAGES) & (F.col("n") > TEMPLATE_SHARE * F.col("pages"))).select("host", "key")
    kept = doubts.join(template, ["host", "key"], "left_anti").groupBy("g1", "g2").agg(F.collect_set("p").alias("kept"))
    mark = F.transform("shared", lambda x: F.when((x % 2 == 0) & F.array_contains(F.coalesce("kept", F.array().cast("array<int>")), F.shiftright(x, 1)), x + 1).otherwise(x))
    return merged.join(kept, ["g1", "g2"], "left").select("g1", "g2", mark.alias("shared"))


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    1. Each page becomes its lines' keys, a few numbers a line (thin: html isn't carried along).
    2. Pages of a host with the very same keys are folded to one, at the first and at the last of
       their paths. These thin rows are range-partitioned and sorted by host and path, so the nearest
       pages by path are the rows next to each other, however many pages a host has. Each is aligned
       with the nearer of its neighbours by a longest common subsequence of keys. The two rows at the
       borders of each part find their neighbour over the border in a table of two rows a part. A line
       of a declared article only counts as shared if most different pages of the host have it, three
       at least.
    3. The positions of shared lines go to all copies by an equi-join on a 128-bit digest of host and
       keys, back to the pages by one on a digest of the row, and are deleted; see ``main_text``.

    A form with over half of a page's text is no aside; a paragraph whose class calls it an advert is.
    A null html is empty and gives the empty text. A null or odd url makes a page of the host "".
    Repeated rows are one page to the pairing and are returned each. Extra columns aren't read, an
    empty table gives no row, texts of any length are read whole.
    """
    spark = pages.sparkSession
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("k1"),
                         F.xxhash64(F.lit(1), "html", "page_id", "url").alias("k2"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([keys_of(lines_of(h.as_py())) for h in batch.column("html")], pa.list_(pa.int64()))
            places = [place_of(u) for u in batch.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1"), batch.column("k2"), pa.array([p[0] for p in places], pa.string()),
                 pa.array([p[1] for p in places], pa.string()), keys], [n for n, _ in PAGE])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(lines_of(h.as_py()), {x >> 1 for x in s.as_py() or ()}, {x >> 1 for x in s.as_py() or () if x & 1})
                     for h, s in zip(batch.column("html"), batch.column("shared"))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array(np.array([len(t) for t in texts], np.int64))],
                                             ["page_id", "url", "text", "n_chars"])

    order = ["host", "path", "k1", "k2"]
    thin = step(keyed.mapInArrow(read, PAGE_SQL)
                .withColumns({"g1": F.xxhash64("host", "keys"), "g2": F.xxhash64(F.lit(1), "keys", "host")}), "lines")
    folded = (thin.groupBy("g1", "g2").agg(F.first("host").alias("host"), F.min("path").alias("low"), F.max("path").alias("high"),
                                           F.first("keys").alias("keys"))
              .select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), "host", F.posexplode(F.array_distinct(F.array("low", "high"))).alias("place", "path"), "keys"))
    folded = step(folded, "folded")
    aligned = step(folded.drop("place").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
                   .mapInArrow(_adjacent, EDGE_SQL), "aligned")
    over = Window.orderBy("part", F.col("last").cast("int"))
    borders = aligned.filter("shared is null")
    for side, shift in (("lag", F.lag), ("lead", F.lead)):
        for name in ("host", "path", "keys"):
            borders = borders.withColumn(f"{side}_{name}", shift(name).over(over))
    at = lambda x: F.shiftright(x, 1)
    doubt = F.transform(F.filter("shared", lambda x: (x % 2 == 0) & (F.get("keys", at(x)) % 2 != 0)),
                        lambda x: F.struct(at(x).alias("p"), F.get("keys", at(x)).alias("key")))
    found = (aligned.filter("shared is not null").select("k1", "k2", "host", "keys", "near", "shared").union(borders.mapInArrow(_borders, FOUND_SQL))
             .filter("near >= 0").select("k1", "k2", "host", doubt.alias("doubt"), F.struct("near", "shared").alias("found"))
             .groupBy("k1", "k2").agg(F.first("host").alias("host"), F.flatten(F.collect_list("doubt")).alias("doubt"), F.collect_list("found").alias("found")))
    merged = step(found.mapInArrow(_merge, MERGED_SQL).filter("size(shared) > 0"), "merged")
    merged = _spared(merged, folded)
    gone = step(thin.select("k1", "k2", "g1", "g2").distinct().join(merged, ["g1", "g2"]).select("k1", "k2", "shared"), "gone")
    types = [f"{n} {pages.schema[n].dataType.simpleString()}" for n in ("page_id", "url")]
    return (keyed.join(gone, ["k1", "k2"], "left").select("page_id", "url", "html", "shared")
            .mapInArrow(finish, ", ".join([*types, "text string, n_chars long"])))


@query()
def op2_url_differencing(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
