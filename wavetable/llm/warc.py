"""WARC archives and their capture index by an external merge.

Writing: pages become WARC/1.1 records, each a gzip member of its own, so that a reader may seek to any of them. Tasks
put consecutive records together in archives of ARCHIVE_BYTES (a longer record has an archive to itself), each with a
warcinfo record first, and Spark's text sink writes one file for each archive; its line end is a zero byte, which is
padding to gzip. Of equal payloads the page with the smallest id is a response, the others are revisits that name it.
Reading: archives are read as binary files and inflated member by member.

Index: each archive gives a run of captures, sorted by URL key and timestamp in the task that reads it. Captures are
dealt out by ranges of (URL key, timestamp, page) of about RANGE_ROWS, so that no key and no host is tied to one task and
a task's share stays the same size however many captures there are; each task has the slices of all runs in its range,
and a loser tree merges these k sorted slices. The result, in the order of its partitions, is the globally ordered
capture history of every URL.

The capture time of a page is not in the input: it is EPOCH plus page_id seconds, or EPOCH without an id; ids of SPAN or
more, and negative ones, count modulo SPAN, so that every year has four digits and times sort as text.

Defined cases: a null html is an empty payload; a null url has an empty key; payloads below min_bytes are always
responses; equal payloads under one id (repeated rows) are responses each, as are equal payloads none of which has an
id; a row without an id is a revisit of the row with the smallest id, if its payload has one; every record has its own
record id; ties in the order of the index go by page, then by archive; columns besides page_id, url and html are not
looked at, whatever their names; an empty table gives no archive.
"""

from __future__ import annotations

import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavetable.llm.util import materialize, scratch_path, small_batches

EPOCH = 1_600_000_000
#: Seconds from EPOCH to the end of the year 9999.
SPAN = 253_402_300_800 - EPOCH
#: Bytes of an archive, compressed, which one task holds.
ARCHIVE_BYTES = 16 << 20
#: Captures of a range of the index, which one task holds (about 500 bytes each).
RANGE_ROWS = 200_000
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CAPTURE = "page_id bigint, url string, url_key string, ts string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, archive string, offset bigint, length bigint"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: each five hexadecimal digits are four base-32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captures(pages: DataFrame, min_bytes: int = 0, key: str = "page_id") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to and first_url (of the page referred to) of each page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), "url", "html", F.octet_length(payload).cast("bigint").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    again = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(named).alias("first"), F.count("*").alias("n"))
    again = materialize(again.filter("n > 1 and first is not null").select("payload_digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "repeated-payloads")
    is_again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(again, "payload_digest", "left").withColumn("record_type", F.when(is_again, "revisit").otherwise("response"))
    return rows.withColumn("refers_to", F.when(is_again, F.col("first"))).drop("first")


def _record() -> Column:
    """The record without its id line: header lines, an empty line, the HTTP head and payload of a response, the record end."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    day = lambda at: F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(at, F.lit(0)), F.lit(SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    flat = lambda url: F.translate(F.coalesce(F.col(url), F.lit("")), "\r\n", "  ")
    known = lambda name, c: F.coalesce(line(name, F.col(c).cast("string")), F.lit(""))
    first = F.col("record_type") == "response"
    body = F.when(first, F.concat(F.lit(HTTP), F.coalesce(F.col("html"), F.lit("")))).otherwise("")
    return F.concat(
        line("WARC-Type", F.col("record_type")), line("WARC-Date", day(F.col("page_id"))), line("WARC-Target-URI", flat("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), known("X-Page-ID", "page_id"), known("X-Payload-Length", "payload_bytes"),
        F.when(first, "").otherwise(F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To-Target-URI", flat("first_url")), line("WARC-Refers-To-Date", day(F.col("refers_to"))), known("X-Refers-To-Page", "refers_to"),
        )),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body, F.lit("\r\n\r\n"),
    )


def _member(rest: bytes) -> bytes:
    """A gzip member with the record whose lines after the first two are rest."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\nWARC-Record-ID: <urn:uuid:%s>\r\n" % str(uuid.uuid4()).encode() + rest) + packer.flush()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, archive_bytes: int | None = None) -> None:
    """Write pages as WARC files under path."""
    small_batches(pages.sparkSession)
    most = archive_bytes or ARCHIVE_BYTES
    about = b"software: wavetable\r\nformat: WARC File Format 1.1\r\n"
    info = b"WARC-Type: warcinfo\r\nWARC-Date: 2020-09-13T12:26:40Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(about) + about + END

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for record in batch.column(0):
                member = _member(record.as_py())
                if members and size + len(member) > most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["archive"])
                    members = []
                if not members:
                    members = [_member(info)]
                    size = len(members[0])
                members.append(member)
                size += len(member)
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], ["archive"])

    archives = captures(pages, min_bytes).select(_record().cast("binary").alias("record")).mapInArrow(run, "archive binary")
    archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def url_key(url: str) -> str:
    """Host labels from the last to the first, then path and query: captures of a site and of a path lie together."""
    try:
        parts = urlsplit(url.lower())
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")


HEADER = re.compile(rb"([^:\r\n]+): ([^\r\n]*)\r\n")
STEP = 1 << 16


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (without the HTTP head) of a record."""
    top = member.index(END) + 4
    fields = {k.decode(): v.decode("utf-8", "replace") for k, v in HEADER.findall(member, 0, top - 2)}
    end = top + int(fields["Content-Length"])
    if member[end:] != END:
        raise ValueError(f"no record end at {end}")
    body = member[top:end]
    return fields, body[body.index(END) + 4 :] if body and fields["Content-Type"].startswith("application/http") else body


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(header fields, payload, offset, length) of each gzip member of an archive; zero bytes after the last are padding."""
    view, at = memoryview(content), 0
    while at < len(view) and view[at]:
        inflate, parts, end = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if end >= len(view):
                raise ValueError(f"the member at {at} has no end")
            parts.append(inflate.decompress(view[end : end + STEP]))
            end += STEP
        end = min(end, len(view)) - len(inflate.unused_data)
        yield *read_record(b"".join(parts)), at, end - at
        at = end


def _runs(path: str, spark: SparkSession) -> DataFrame:
    """The captures of each archive, sorted by URL key, timestamp and page: one run for each."""
    names = [f.strip().split(" ")[0] for f in CAPTURE.split(",")]
    types = [{"bigint": pa.int64(), "string": pa.string()}[f.strip().split(" ")[1]] for f in CAPTURE.split(",")]
    number = lambda fields, name: int(fields[name]) if name in fields else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, raw in zip(*batch.columns):
                rows = []
                for fields, payload, offset, length in read_records(raw.as_py()):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response" and (size != len(payload) or digest != b32encode(sha1(payload).digest()).decode()):
                        raise ValueError(f"the record at {offset} of {archive} does not hold what its header says")
                    url, ts = fields["WARC-Target-URI"], re.sub(r"\D", "", fields["WARC-Date"])
                    rows.append((number(fields, "X-Page-ID"), url, url_key(url), ts, fields["WARC-Type"], number(fields, "X-Refers-To-Page"), digest, size, archive.as_py(), offset, length))
                rows.sort(key=lambda r: (r[2], r[3], r[0] is None, r[0] or 0))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return files.mapInArrow(run, CAPTURE)


class LoserTree:
    """K-way merge of sorted lists: each inner node keeps the loser of its game, the winner goes up."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for i in range(len(runs)):
            self._replay(i, building=True)

    def _less(self, a: int, b: int) -> bool:
        """Run a comes before run b; an exhausted run comes after all."""
        if self.at[a] == len(self.runs[a]):
            return False
        return self.at[b] == len(self.runs[b]) or (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + self.k) // 2
        while node:
            if self.losers[node] < 0 and building:
                self.losers[node] = winner
                return
            if self._less(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs:
            best = self.losers[0]
            if self.at[best] == len(self.runs[best]):
                return
            yield self.runs[best][self.at[best]]
            self.at[best] += 1
            self._replay(best)


def merge_index(runs: DataFrame) -> DataFrame:
    """The captures of all runs in global order of (url_key, ts, page_id)."""
    small_batches(runs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list] = {}
        held = []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("url_key", "ts", "page_id", "archive", "offset")))
            for i, (url, ts, page, archive, offset) in enumerate(keys):
                slices.setdefault(archive, []).append((url, ts, page is None, page or 0, offset, len(held), i))
            held.append(batch)
        for own in slices.values():  # a fetch may bring the parts of a run in any order
            if any(a > b for a, b in zip(own, own[1:])):
                own.sort()
        if held:
            first = [0]
            for b in held:
                first.append(first[-1] + b.num_rows)
            order = [first[b] + i for *_, b, i in LoserTree([slices[a] for a in sorted(slices)])]
            yield from pa.Table.from_batches(held).take(pa.array(order)).combine_chunks().to_batches()

    n, tasks = runs.count(), int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(-(-n // RANGE_ROWS), min(tasks, -(-n // 10_000)), 1)
    return runs.repartitionByRange(ranges, "url_key", "ts", F.col("page_id").asc_nulls_last(), "archive", "offset").mapInArrow(run, CAPTURE)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The merged index of the archives under path."""
    return merge_index(materialize(_runs(path, spark), "runs"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back, return their merged index."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, min_bytes)
    return read_index(pages.sparkSession, path)
