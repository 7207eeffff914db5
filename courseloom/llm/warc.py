"""WARC archives of pages, and the merge of their capture index into one global order."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterator
from pickle import dumps, loads
from tempfile import SpooledTemporaryFile
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courseloom.llm.common import new_path, partitions, query, step, table

LEAST_BYTES = 100           # smaller payloads are never revisits
FILE_RECORDS = 2000         # records of an archive file at most
RUN_ROWS = 1024             # index rows of a run that are read at once
SPOOL_BYTES = 32 << 20      # index rows a merging task keeps in memory; beyond, in a scratch file of its own
URN = "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payloads(pages: DataFrame) -> DataFrame:
    """Pages with payload_digest, payload_bytes, record_type and refers_to, the page it revisits.

    Of equal payloads of at least LEAST_BYTES the smallest page_id is the response. Rows that
    repeat this id are responses too; a null id revisits, if there is any id to revisit. Only
    payloads that occur more than once are joined, as a written table of (digest, page_id), so
    adaptive execution may broadcast it, or split a digest that a third of all pages have.
    """
    html = F.coalesce("html", F.lit(""))
    held = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("payload_digest"),
                        F.octet_length(html).cast("long").alias("payload_bytes"))
    first = step(held.filter(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest")
                 .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
                 .select("payload_digest", "first"), "repeated")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return held.join(first, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def captured_at(page_id: str) -> Column:
    """A capture time for pages that have none: a second of one year, from the id."""
    second = F.lit(1767225600) + F.pmod(F.xxhash64(page_id), F.lit(31536000))
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(second), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(held: DataFrame, path: str) -> None:
    """Write a WARC/1.1 record per row of ``payloads``, as gzipped archive files under ``path``.

    A record is one line of Spark's text writer, and the two line breaks that end a record are its
    line separator. A response carries the HTTP header and the payload, a revisit the HTTP header
    alone and what it refers to.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("html")).otherwise(""))
    refers = F.when(F.col("record_type") == "revisit",
                    F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{URN}"), text("refers_to"), F.lit(">\r\n"))).otherwise("")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit(f"\r\nWARC-Record-ID: <{URN}"), text("page_id"),
        F.lit(">\r\nWARC-Date: "), captured_at("page_id"), F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\n"), refers, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)
    (held.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, int]]:
    """(header, start, start of the block, end of the block) of an archive's records, by their
    Content-Length: what a payload contains is never taken for a record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        header = dict(line.split(": ", 1) for line in lines[1:])
        body, stop = end + 4, end + 4 + int(header["Content-Length"])
        yield header, at, body, stop
        at = stop + 4


def url_key(url: str) -> str:
    """Sort key of a URL: the host's labels from the right, then path and query, in lower case."""
    try:
        parts = urlsplit(url)
    except ValueError:
        return url.lower()
    labels = parts.netloc.rpartition("@")[2].lower().split(".")
    return f"{','.join(reversed(labels))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


FIELDS = [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()),
          ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
          ("offset", pa.int64()), ("length", pa.int64())]
FIELDS_SQL = ("url_key string, captured string, page_id long, payload_digest string, payload_bytes long, record_type string, "
              "refers_to long, file string, offset long, length long")


def _page(value: str) -> int | None:
    number = value.removeprefix(f"<{URN}").removesuffix(">")
    return None if number == "null" else int(number)


def capture(header: dict[str, str], block: bytes, file: str, offset: int, length: int) -> tuple:
    """The index row of a record, from the record alone; a response's digest is made anew."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = header["WARC-Payload-Digest"].removeprefix("sha256:")
    if header["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"record at byte {offset} of {file} is damaged")
    refers = header.get("WARC-Refers-To")
    return (url_key(header["WARC-Target-URI"]), header["WARC-Date"], _page(header["WARC-Record-ID"]), digest, size,
            header["WARC-Type"], _page(refers) if refers else None, file, offset, length)


def order(row: tuple) -> tuple:
    """Order of captures: URL key, time, then page (null last) and place."""
    return row[0], row[1], row[2] is None, row[2] or 0, row[7], row[8]


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The index of all archives under ``path``: each file's captures, sorted, are one run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data, file = gzip.decompress(content.as_py()), name.rsplit("/", 1)[1]
                rows = [capture(h, data[body:end], file, at, end + 4 - at) for h, at, body, end in parse_records(data)]
                rows.sort(key=order)
                for k in range(0, len(rows), 10000):
                    yield _rows(rows[k:k + 10000])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, FIELDS_SQL)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], [n for n, _ in FIELDS])


class LoserTree:
    """Merge of k sorted streams: a tournament whose inner nodes keep the loser of their match, so
    the next row takes one match per level, against the losers on the winner's way up only. Equal
    rows come in the order of the streams."""

    def __init__(self, streams: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.streams, self.key, self.k = streams, key, len(streams)
        self.heads: list[tuple | None] = [next(s, None) for s in streams]
        self.keys = [key(h) if h else None for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _replay(self, player: int) -> None:
        node = (player + self.k) // 2
        while node:
            if self.losers[node] < 0:                   # still waiting for its other player
                self.losers[node] = player
                return
            if self._before(self.losers[node], player):
                self.losers[node], player = player, self.losers[node]
            node //= 2
        self.losers[0] = player

    def __iter__(self) -> Iterator[tuple]:
        while self.k and (row := self.heads[w := self.losers[0]]) is not None:
            yield row
            self.heads[w] = next(self.streams[w], None)
            self.keys[w] = self.key(self.heads[w]) if self.heads[w] else None
            self._replay(w)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge a range's runs, which come one after the other, each sorted. They are spooled in
    pieces, in memory as far as SPOOL_BYTES and then in a scratch file of this task; the merge
    holds one piece of every run."""
    with SpooledTemporaryFile(SPOOL_BYTES) as spool:
        runs: dict[str, list[tuple[int, int]]] = {}

        def put(run: str, rows: list[tuple]) -> None:
            data = dumps(rows)
            runs.setdefault(run, []).append((spool.tell(), len(data)))
            spool.write(data)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[7] != held[0][7] or len(held) == RUN_ROWS):
                    put(held[0][7], held)
                    held = []
                held.append(row)
        if held:
            put(held[0][7], held)

        def stream(pieces: list[tuple[int, int]]) -> Iterator[tuple]:
            for at, size in pieces:
                spool.seek(at)
                yield from loads(spool.read(size))

        out = []
        for row in LoserTree([stream(p) for p in runs.values()], order):
            out.append(row)
            if len(out) == 10000:
                yield _rows(out)
                out = []
        yield _rows(out)


def merge_index(runs: DataFrame) -> DataFrame:
    """All captures in one order, by URL key, time and page: the parts of the result are ranges of
    the key, in order, and each is the merge of its runs. The ranges are cut on the whole key, so a
    host or URL that a third of all captures have is cut like any other. (Spark sorts a range's rows
    by run only to hand the runs over one after the other.)"""
    n = partitions(runs.sparkSession)
    ranged = runs.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_last(), "file", "offset")
    return (ranged.sortWithinPartitions("file", "url_key", "captured", F.col("page_id").asc_nulls_last(), "offset")
            .mapInArrow(merged, FIELDS_SQL))


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as WARC archives, read them back, and return the merged index of captures:
    url_key, captured, page_id, payload_digest, payload_bytes, record_type, refers_to, file, offset,
    length; the place is in the unpacked file.

    Everything but the order comes from the archives. ``path`` must not exist; without one it is a
    folder of its own in the shared folder. A null html is an empty payload, a null url the empty
    URL, repeated rows are captures of their own, extra columns aren't read, no page gives no row.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(payloads(pages), path)
    return merge_index(step(read_runs(spark, path), "runs"))


@query()
def op4_index_merge(spark, sf_dir):
    return archive(table(spark, sf_dir, "pages", "page_id", "url", "html"))
