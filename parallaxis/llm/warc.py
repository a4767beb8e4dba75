"""WARC archives with identical-payload revisits, and a capture index merged from sorted runs.

Writing: every page becomes one record. Payloads of at least ``REVISIT_BYTES`` bytes that are equal are stored once,
by the smallest page_id; the others are ``revisit`` records that refer to it and keep only the HTTP header, whose
Content-Length is that of the full payload. Digests alone meet to find out which; texts are shuffled once, by page,
into files of about ``FILE_BYTES`` bytes before compression. Each record is a gzip member, so that it can be read from
its offset. Spark's own text writer makes the files, in any store that it reaches: a member of less than 16 MiB ends
in a zero byte, which serves as the line separator. Longer records are several members.

Reading: each archive is inflated as a stream and parsed by Content-Length, never by searching for separators.

Index: the captures of each archive, sorted by (URL key, timestamp, page), are a run. Key ranges are dealt to
tasks and a loser tree merges the runs that reach into a range, so (key_range, place) is the global order and a URL's
captures are its history. Ranges are cut on the whole sort key and the record's place, so a URL that a third of all
captures share is dealt to many tasks. A range's runs are held in columns; the merge decodes ``BUFFER`` keys of each.

Edge cases: a null html is an empty payload; a null url is empty; rows that repeat the smallest page_id of a payload
are all responses; a null page_id is written as the empty text and is only referred to if no other row has the payload;
line ends and blanks in URLs are percent-encoded; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxis.llm import storage

REVISIT_BYTES = 100
#: Bytes of payloads in a file on average, records in it at most, and bytes before compression of one gzip member.
FILE_BYTES, FILE_RECORDS, MEMBER_BYTES = 64_000_000, 100_000, 8_000_000
#: Digests that are broadcast at most, because each has more than this share of all pages.
HOT_DIGESTS = 100_000
CRLF = "\r\n"
#: Capture times when the table has none: this instant plus page_id seconds.
EPOCH = 1_704_067_200
#: The order of the index, and captures that one key range of it holds on average at most.
ORDER, RANGE_ROWS = ("url_key", "captured", "page_id"), 250_000
#: Keys of a run that the merge decodes at a time.
BUFFER = 512
RECORD = "file string, byte_offset long, page_id long, record_type string, refers_to long, url string, captured long, payload_bytes long, payload_digest string, payload_intact boolean"


def _uri(url: Column) -> Column:
    return F.regexp_replace(F.replace(F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("\t"), F.lit("%09")), " ", "%20")


def _revisits(rows: DataFrame, revisit_bytes: int) -> DataFrame:
    """(own, digest, origin) of the pages whose payload another page stores; no payload is touched."""
    slim = rows.filter(F.col("n") >= revisit_bytes).select("own", "page_id", "digest")
    origins = slim.groupBy("digest").agg(F.min("page_id").alias("origin"), F.count(F.lit(1)).alias("copies"))
    origins = storage.materialize(origins.filter("copies > 1 and origin is not null"), "origins")
    often = F.col("copies") > (origins.agg(F.sum("copies")).first()[0] or 0) // HOT_DIGESTS
    hot, rare = F.broadcast(origins.filter(often).drop("copies")), origins.filter(~often).drop("copies")
    met = slim.join(hot, "digest").unionByName(slim.join(hot, "digest", "left_anti").join(rare, "digest"))
    return met.filter(~F.col("origin").eqNullSafe(F.col("page_id"))).select("own", "digest", "origin").distinct()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as gzip members, without the zero byte that ends the last one."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out = []
            for record in batch.column(0).slice(at, 256):
                whole = memoryview(record.as_buffer())
                parts = [gzip.compress(whole[k : k + MEMBER_BYTES], 6, mtime=0) for k in range(0, len(whole), MEMBER_BYTES)]
                out.append(b"".join(parts)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write(pages: DataFrame, path: str, captured: Column | None = None, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes ``pages(page_id, url, html)`` as gzip WARC files under ``path``; ``captured`` is a time in seconds."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("own"), _uri(F.coalesce("url", F.lit(""))).alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n"),
        F.sha2(html.cast("binary"), 256).alias("digest"), (captured if captured is not None else F.lit(EPOCH) + F.coalesce("page_id", F.lit(0))).cast("long").alias("captured"),
    )
    size = pages.agg(F.sum(F.octet_length("html").cast("long") + 1000)).first()[0] or 0
    # as many partitions as the join makes at least, so that it takes these as they are; none of them is merged with another
    files = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    marks = _revisits(rows, revisit_bytes)
    rows = rows.repartition(files, "own", "digest")
    rows = rows.join(marks, ["own", "digest"], "left")
    rows = rows.withColumn("revisit", F.col("origin").isNotNull())
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", urn(F.col("origin"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.octet_length(block)).cast("string")),
        F.lit(CRLF), http, block, F.lit(CRLF + CRLF),
    )
    members = rows.select(record.cast("binary").alias("record")).mapInArrow(_members, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\x00").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class _Inflated:
    """Reads exact numbers of bytes from gzip or plain content without inflating all of it."""

    STEP = 65_536

    def __init__(self, content: bytes):
        self.content, self.at, self.buffer = memoryview(content), 0, b""
        self.plain = content[:2] != b"\x1f\x8b"
        #: the inflater of the member that begins at ``member``
        self.inflate, self.member = None, 0

    def _more(self) -> bool:
        """Adds what the next step of the content gives to the buffer; False at its end."""
        if self.at >= len(self.content):
            return False
        piece = self.content[self.at : self.at + self.STEP]
        if self.plain:
            self.buffer += piece
            self.at += len(piece)
            return True
        if self.inflate is None:
            self.inflate, self.member = zlib.decompressobj(31), self.at
        self.buffer += self.inflate.decompress(piece)
        self.at += len(piece) - len(self.inflate.unused_data)
        if self.inflate.eof:
            self.inflate = None
        return True

    def place(self) -> int:
        """Where to begin in order to read what comes next: its own place, or that of its gzip member."""
        if self.plain:
            return self.at - len(self.buffer)
        return self.at if not self.buffer and self.inflate is None else self.member

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def head(self) -> bytes:
        while b"\r\n\r\n" not in self.buffer and self._more():
            pass
        out, _, self.buffer = self.buffer.partition(b"\r\n\r\n")
        return out


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split(CRLF)[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def _page(urn: str) -> int | None:
    return int(urn[10:-1]) if len(urn) > 11 else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from calendar import timegm
    from time import strptime

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            source, offset, rows = _Inflated(content.as_py()), 0, []
            name = path.rsplit("/", 1)[-1]
            while head := source.head():
                h = _headers(head)
                size = int(h["content-length"])
                body = source.read(size)
                http, _, payload = body.partition(b"\r\n\r\n")
                own = hashlib.sha256(payload).hexdigest()
                digest = h["warc-payload-digest"].removeprefix("sha256:")
                revisit = h["warc-type"] == "revisit"
                n = int(_headers(http)["content-length"])
                rows.append((name, offset, _page(h["warc-record-id"]), h["warc-type"], _page(h["warc-refers-to"]) if revisit else None, h["warc-target-uri"], timegm(strptime(h["warc-date"], "%Y-%m-%dT%H:%M:%SZ")), n, digest if revisit else own, revisit or (own == digest and n == len(payload))))
                source.read(4)
                offset = source.place()
                if len(rows) == 20_000:
                    yield _captures(rows)
                    rows = []
            yield _captures(rows)


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], names=_NAMES)


_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in RECORD.split(", ")]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, digests and lengths of responses taken from their payloads."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse, RECORD)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then port, path and query, in lower case and without fragment."""
    parts = urlsplit(re.sub(r"[\[\]]", "_", url.lower()))
    host, _, port = parts.netloc.rpartition("@")[2].partition(":")
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{':' + port if port else ''}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("url_key", pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()))


class LoserTree:
    """Merges sorted sequences: each node keeps the loser of its match, the champion is replayed up one path at a time."""

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.heads = [run[0] if len(run) else None for run in runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.tree[node] == -1:  # still being built: wait here for the opponent
                self.tree[node] = winner
                return
            if self._wins(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in run) of all entries in order."""
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield w, self.at[w]
            self.at[w] += 1
            self.heads[w] = self.runs[w][self.at[w]] if self.at[w] < len(self.runs[w]) else None
            self._play(w)


class _Run:
    """The keys of a run that lies in columns, decoded ``BUFFER`` at a time as the merge gets to them."""

    def __init__(self, rows: pa.Table):
        self.rows, self.start, self.keys = rows, 0, []

    def __len__(self) -> int:
        return self.rows.num_rows

    def __getitem__(self, k: int) -> tuple:
        if not self.start <= k < self.start + len(self.keys):
            part = self.rows.slice(k, BUFFER)
            self.start, self.keys = k, list(zip(part["url_key"].to_pylist(), part["captured"].to_pylist(), [(p is not None, p or 0) for p in part["page_id"].to_pylist()]))
        return self.keys[k - self.start]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by run and, within a run, by key: the runs of one key range."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    rows = pa.Table.from_batches(table).combine_chunks()
    files = rows["file"].combine_chunks().dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], files[1:] != files[:-1], [True]])).tolist()
    merged = LoserTree([_Run(rows.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])])
    key_range, place = TaskContext.get().partitionId(), 0
    order = (cuts[r] + i for r, i in merged)
    while part := list(itertools.islice(order, 20_000)):
        out = rows.take(pa.array(part, pa.int64()))
        out = out.append_column("key_range", pa.array([key_range] * len(part), pa.int64())).append_column("place", pa.array(range(place, place + len(part)), pa.int64()))
        place += len(part)
        yield from out.to_batches()


def runs(records: DataFrame) -> DataFrame:
    """The captures of every archive as a locally sorted run, stored in the shared folder."""
    keyed = records.mapInArrow(_keyed, RECORD + ", url_key string")
    return storage.materialize(keyed.sortWithinPartitions("file", *ORDER), "capture-runs")


def merged_index(sorted_runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in the global order of ORDER, which is that of (key_range, place), merged from sorted runs."""
    ranges = -(-sorted_runs.count() // range_rows)
    least = int(sorted_runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sorted_runs.repartitionByRange(max(ranges, least), *ORDER, "file", "byte_offset").sortWithinPartitions("file", *ORDER)
    return dealt.mapInArrow(_merge, RECORD + ", url_key string, key_range long, place long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of ``pages`` to the shared folder and returns their merged index, read back."""
    spark = pages.sparkSession
    path = storage.scratch(spark, "warc")
    write(pages, path)
    return merged_index(runs(read(spark, path)))
