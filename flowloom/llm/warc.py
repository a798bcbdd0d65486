"""WARC archives written and read as a table of chunks.

A payload becomes one record, or, above ``segment_bytes``, a first record and ``continuation`` records, each a row of
(record, segment number, bytes). No row is longer than a segment and its header, so reading never holds a whole
record: a running digest is carried over the segments instead. A segment also ends inside any record separator that a
payload may hold, so a reader can split archives at separators, in parallel and without a scan from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
SEPARATOR = END + VERSION
SEGMENT_BYTES = 1 << 20
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
FLUSH_BYTES = 8 << 20

RECORD_FIELDS = "record_id string, type string, page_id long, url string, refers_to long, segment long, " \
    "total_bytes long, payload_digest string, block binary"
_DIGESTED = "record_id string, payload_bytes long, payload_digest string"


def archive_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest, record type and the response a revisit refers to.

    NULL html is an empty payload. Of equal payloads of at least ``revisit_bytes``, rows with the smallest page_id are
    responses and the others revisit it; rows without a page_id are responses. The duplicate search moves only digests;
    groups of equal payloads are reduced before the exchange, and the rows that look their group up carry a salt, so
    one group may hold any share of the rows.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    keyed = rows.where((F.col("payload_bytes") >= revisit_bytes) & F.col("page_id").isNotNull()).select(
        "page_id", "payload_bytes", "payload_digest")
    salt = F.pmod(F.xxhash64("page_id"), F.lit(16)).alias("salt")
    first = keyed.groupBy("payload_digest", "payload_bytes").agg(
        F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    revisits = keyed.select("*", salt).join(first, ["payload_digest", "payload_bytes", "salt"]).where(
        "page_id > refers_to").select(
            F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to").distinct()
    found = rows.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")),
                      "left")
    return found.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").withColumns({
        "record_type": F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        "serial": F.monotonically_increasing_id()})


def _cuts(payload: bytes, segment_bytes: int) -> Iterator[tuple[int, int]]:
    """Where segments begin and end; an empty payload has one empty segment.

    Neither a segment nor the blank line before it with its first bytes makes a separator: a segment that would ends
    after the ``W`` of the separator's version line.
    """
    version, line = VERSION.strip().encode(), VERSION[-2:].encode()
    mark = END.encode() + version
    start, found = 0, payload.find(mark)
    while True:
        end = min(start + segment_bytes, len(payload))
        while 0 <= found < start:
            found = payload.find(mark, found + 1)
        if payload.startswith(version, start):
            end = start + 1
        elif payload.startswith(line + version, start):
            end = start + 3
        elif 0 <= found and found + len(mark) <= end + len(version):
            end = min(end, found + len(END) + 1)
        yield start, end
        start = end
        if start >= len(payload):
            return


def _encode(segment_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(i) for i in range(len(names))]
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(names, columns, strict=True)}
                for record in _record(row, segment_bytes):
                    out.append(record)
                    held += len(record)
                    if held >= FLUSH_BYTES:
                        yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                        out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
    return write


def _record(row: dict, segment_bytes: int) -> Iterator[bytes]:
    """The record of one page in WARC form, without the blank lines that end it: one value for each segment."""
    page = "" if row["page_id"] is None else str(row["page_id"])
    name = f"urn:flowloom:{page}:{row['serial']}"
    shared = f"WARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:{row['payload_digest']}\r\nX-Page-Id: {page}\r\n"
    if row["url"] is not None:
        shared += f"WARC-Target-URI: {' '.join(row['url'].splitlines())}\r\n"
    if row["refers_to"] is not None:
        head = (f"{VERSION}WARC-Type: revisit\r\nWARC-Record-ID: <{name}>\r\n{shared}WARC-Profile: {PROFILE}\r\n"
                f"X-Refers-To-Page: {row['refers_to']}\r\nX-Payload-Length: {row['payload_bytes']}\r\n")
        yield f"{head}Content-Length: 0{END}".encode()
        return
    payload = row["payload"]
    cuts = list(_cuts(payload, segment_bytes))
    for number, (start, end) in enumerate(cuts, 1):
        head = f"{VERSION}WARC-Type: {'response' if number == 1 else 'continuation'}\r\n"
        head += f"WARC-Record-ID: <{name}{'' if number == 1 else f':{number}'}>\r\n{shared}"
        if len(cuts) > 1:
            head += f"WARC-Segment-Number: {number}\r\nWARC-Segment-Origin-ID: <{name}>\r\n"
            if number == len(cuts):
                head += f"WARC-Segment-Total-Length: {len(payload)}\r\n"
        yield f"{head}Content-Length: {end - start}{END}".encode() + payload[start:end]


def write_archives(records: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, compression: str = "gzip") -> None:
    """Write the records as WARC files below ``path``; a task writes a file, which Spark commits once it is whole."""
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to", "serial"]
    rows = records.select(*columns).mapInArrow(_encode(segment_bytes), "record binary")
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option(
        "compression", compression).text(path)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives below ``path``: a row (record, segment number, bytes) for each segment."""
    raw = spark.read.option("lineSep", SEPARATOR).text(path)
    parts = raw.select(F.substring_index("value", END, 1).alias("head"), F.col("value").cast("binary").alias("value"))
    length = _field("Content-Length").cast("int")
    return parts.select(
        F.regexp_replace(F.coalesce(_field("WARC-Segment-Origin-ID"), _field("WARC-Record-ID")), "[<>]", "").alias(
            "record_id"),
        _field("WARC-Type").alias("type"), _field("X-Page-Id").cast("long").alias("page_id"),
        _field("WARC-Target-URI").alias("url"), _field("X-Refers-To-Page").cast("long").alias("refers_to"),
        _field("WARC-Segment-Number").cast("long").alias("segment"),
        F.coalesce(_field("WARC-Segment-Total-Length"), _field("X-Payload-Length")).cast("long").alias("total_bytes"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        F.col("value").substr(F.octet_length("head") + 5, length).alias("block"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of each record, from its segments in order; holds one digest state."""
    current, state, length = None, hashlib.sha256(), 0
    done: list[tuple] = []
    for batch in batches:
        for name, block in zip(batch.column(0), batch.column(1), strict=True):
            if name.as_py() != current:
                if current is not None:
                    done.append((current, length, state.hexdigest()))
                current, state, length = name.as_py(), hashlib.sha256(), 0
            view = block.as_buffer()
            state.update(view)
            length += view.size
        if len(done) > 1000:
            yield _digested(done)
            done = []
    if current is not None:
        done.append((current, length, state.hexdigest()))
    if done:
        yield _digested(done)


def _digested(rows: list[tuple]) -> pa.RecordBatch:
    names, lengths, digests = zip(*rows, strict=True)
    return pa.record_batch([pa.array(names, pa.string()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())],
                           ["record_id", "payload_bytes", "payload_digest"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, url, length and digest of the payload as read, type, the page a revisit names.

    ``intact`` tells whether the payload read has the digest that its header declares. Revisits have no payload and
    report what their header declares. Only records of several segments are brought together, in segment order.
    """
    chunks = read_chunks(spark, path)
    whole = chunks.where(F.col("segment").isNull())
    is_revisit = F.col("type") == "revisit"
    single = whole.select(
        "page_id", "url", F.when(is_revisit, F.col("total_bytes")).otherwise(F.octet_length("block")).cast("long").alias(
            "payload_bytes"),
        F.when(is_revisit, F.col("payload_digest")).otherwise(F.sha2("block", 256)).alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to", F.col("payload_digest").alias("declared"))
    parts = chunks.where(F.col("segment").isNotNull())
    joined = parts.select("record_id", "block", "segment").repartition("record_id").sortWithinPartitions(
        "record_id", "segment").select("record_id", "block").mapInArrow(_digest, _DIGESTED)
    heads = parts.where("type = 'response'").select(
        F.col("record_id").alias("_id"), "page_id", "url", F.col("type").alias("record_type"), "refers_to",
        F.col("payload_digest").alias("declared"))
    several = joined.join(heads, F.col("record_id") == F.col("_id")).select(*single.columns)
    return single.union(several).withColumn("intact", F.col("payload_digest") == F.col("declared")).drop("declared")
