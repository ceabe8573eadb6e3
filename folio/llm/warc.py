"""WARC archives: records written by Spark's text sink, read back and reassembled from their segments.

Writing. Payload digests pick, for each group of equal payloads, the row that is stored whole (``response``); the rest
become ``revisit`` records that refer to it. A stored payload is framed as a chunked HTTP response. Blocks over
``segment_bytes`` are cut into a first record and continuation records. Every record is one row of the text sink, whose
line separator is the record trailer, so each part file is a gzip stream of records; it is one gzip member, where others
write a member a record. A revisit names the page it refers to in a header of its own, WARC-Refers-To-Page.

Reading. Each archive is inflated and parsed as a stream. Whole records are decoded where they are read. Segments are
grouped by their origin record's id, ordered by number, checked against the total length, then decoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import small_batches

TRAILER = b"\r\n\r\n"
#: Any fixed name space will do; record ids are made from it, so a rerun over the same partitions writes the same ids.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
READ_SCHEMA = (
    "record_id string, record_type string, page_id long, uri string, payload_digest string, refers_to long, "
    "origin string, segment long, total long, length long, block binary"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunk_framed(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing: hexadecimal size, line end, data, line end; a chunk of size zero ends it."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def chunk_unframed(data: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are skipped, a broken frame raises ValueError."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size line without an end")
        size = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk shorter than its size")
        out.append(data[at : at + size])
        at += size + 2


def header_lines(fields: list[tuple[str, str]]) -> bytes:
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record_uuid(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '/'.join(map(str, parts)))}>"


def clean_uri(url: str | None) -> str:
    """A header field is one line: line ends of a URL are escaped."""
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int, chunk_bytes: int, date: str, row: int | str = "") -> Iterator[bytes]:
    """The records of one page, each without its trailer; ``row`` tells apart rows that are equal otherwise."""
    uri, own = clean_uri(url), "" if page_id is None else str(page_id)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    origin = record_uuid(own, digest, uri, row)
    shared = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", own)]
    if refers_to is not None:
        yield header_lines([
            ("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *shared,
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", str(refers_to)),
            ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(head))),
        ]) + head
        return
    block = head + chunk_framed(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield header_lines([("WARC-Type", "response"), ("WARC-Record-ID", origin), *shared, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]) + block
        return
    count = -(-len(block) // segment_bytes)
    for k in range(count):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_uuid(own, digest, uri, row, k + 1)), ("WARC-Segment-Origin-ID", origin)] if k else [("WARC-Type", "response"), ("WARC-Record-ID", origin)]
        fields += [*shared, ("WARC-Segment-Number", str(k + 1))]
        if k + 1 == count:
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield header_lines([*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(part)))]) + part


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest (binary SHA-1) and, for revisits, refers_to.

    Only digests and ids are grouped, with partial counts before the shuffle; the pages themselves are dealt once, by
    page, and only if the list of revisits is too large to broadcast.
    """
    hashed = pages.select("page_id", "url", F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b"")).alias("payload"))
    hashed = hashed.withColumn("digest", F.unhex(F.sha1("payload")))
    long_enough = F.octet_length("payload") >= least_bytes
    groups = hashed.filter(long_enough).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    repeated = groups.filter("n > 1").select("digest", "refers_to")
    revisits = (
        hashed.filter(long_enough).select("page_id", "digest").join(repeated, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
        .select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "refers_to")
    )
    return hashed.join(revisits, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left").drop("of_page", "of_digest")


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 65_536, chunk_bytes: int = 8_192, least_bytes: int = 0, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of ``pages`` under ``path``, one a part file, of not many more than ``file_bytes`` before compression.

    No record's block is over ``segment_bytes``, so a number of records bounds a file, and a reader may hold one whole.

    A null html is an empty payload. Of rows with equal payloads all those with the largest page_id are stored, so rows
    repeated whole are too, each with record ids of its own; a null page_id counts below every other. An empty table writes no record,
    a page of any length is cut into segments, and columns beside page_id, url and html are ignored.
    """

    small_batches(pages.sparkSession)
    records_per_file = max(1, file_bytes // (segment_bytes + 1_024))

    @F.pandas_udf("array<binary>")
    def records(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ids, urls, payloads, digests, refers, numbers in batches:
            yield pd.Series([
                list(page_records(None if pd.isna(i) else int(i), u, p, base64.b32encode(d).decode(), None if pd.isna(r) else int(r), segment_bytes, chunk_bytes, date, n))
                for i, u, p, d, r, n in zip(ids, urls, payloads, digests, refers, numbers)
            ])

    # a number of each row's own, so that equal rows have records of their own; what it is does not matter
    rows = with_references(pages, least_bytes).withColumn("row", F.monotonically_increasing_id())
    # ids as text: pandas would hold a column of integers with nulls as floats, which lose digits
    made = rows.select(F.explode(records(F.col("page_id").cast("string"), "url", "payload", "digest", F.col("refers_to").cast("string"), "row")).alias("record"))
    made.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", TRAILER.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of a plain or gzip archive, gzip members one after another."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    inflate = zlib.decompressobj(31)
    while at < len(view) or inflate.unconsumed_tail:
        feed = inflate.unconsumed_tail or view[at : at + step]
        if not inflate.unconsumed_tail:
            at += step
        yield inflate.decompress(feed, step)
        while inflate.eof and (inflate.unused_data or at < len(view)):
            feed = inflate.unused_data
            if not feed:
                feed = bytes(view[at : at + step])
                at += step
            inflate = zlib.decompressobj(31)
            yield inflate.decompress(feed)
    yield inflate.flush()


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record; an archive that ends inside a record raises ValueError."""
    buffer, start = bytearray(), 0

    def more() -> bool:
        nonlocal buffer, start
        if start > 1 << 20:
            del buffer[:start]
            start = 0
        piece = next(pieces, None)
        if piece is None:
            return False
        buffer += piece
        return True

    while True:
        while (end := buffer.find(TRAILER, start)) < 0:
            if not more():
                if bytes(buffer[start:]).strip():
                    raise ValueError("archive ends inside a record's header")
                return
        head = bytes(buffer[start:end]).decode().lstrip("\r\n").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"not a record: {head[0][:60]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(fields["content-length"])
        start = end + 4
        while len(buffer) - start < size + 4 and more():
            pass
        if len(buffer) - start < size:
            raise ValueError("archive ends inside a record's block")
        yield fields, bytes(buffer[start : start + size])
        start += size + 4


def payload_of(block: bytes) -> bytes:
    """The decoded payload of an HTTP response block."""
    head, _, body = block.partition(TRAILER)
    return chunk_unframed(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, undecoded."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                out, held = [], 0
                for f, block in parsed(inflated(content)):
                    number = lambda k: int(f[k]) if f.get(k) else None
                    out.append((
                        f["warc-record-id"], f["warc-type"], number("warc-page-id"), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:"),
                        number("warc-refers-to-page"), f.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"),
                        number("warc-payload-length"), block,
                    ))
                    held += len(block)
                    if held > 4 << 20:
                        yield pd.DataFrame(out, columns=names).astype({k: "Int64" for k in ("page_id", "refers_to", "segment", "total", "length")})
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names).astype({k: "Int64" for k in ("page_id", "refers_to", "segment", "total", "length")})

    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(rows, READ_SCHEMA)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: record_id, record_type, page_id, uri, payload_digest, refers_to, payload (null for revisits), payload_bytes.

    A segment missing, given twice with other bytes, or a total that does not add up makes ``intact`` false, as does a
    payload whose digest is not the declared one; its payload is then null, and the other records are read all the same.
    A record is one row, so one task holds its segments and its payload at once: its size is bounded by memory alone.
    """

    @F.pandas_udf("struct<payload: binary, digest: string, good: boolean>")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for parts in batches:
            out = []
            for blocks in parts:
                try:
                    # joined in one go, so the work is in proportion to the payload
                    payload = None if blocks is None else payload_of(b"".join(map(bytes, blocks)))
                    out.append((payload, None if payload is None else payload_digest(payload), payload is not None))
                except ValueError:
                    out.append((None, None, False))
            yield pd.DataFrame(out, columns=["payload", "digest", "good"])

    names = ["record_id", "record_type", "page_id", "uri", "payload_digest", "refers_to", "length"]
    whole = records.filter("segment is null").select(*names, "block")
    parts = records.filter("segment is not null").withColumn("of", F.coalesce("origin", "record_id"))
    # a group is one record's segments, cut from one payload that was one row
    grouped = parts.groupBy("of").agg(
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"), F.max("total").alias("total"),
        *(F.min_by(c, "segment").alias(c) for c in names),
    )
    in_order = F.expr("transform(parts, x -> x.segment) = sequence(1L, cast(size(parts) as bigint))")
    adds_up = F.expr("aggregate(parts, 0L, (n, x) -> n + octet_length(x.block))") == F.col("total")
    joined = grouped.select(*names, F.when(in_order & adds_up, F.transform("parts", lambda x: x["block"])).alias("blocks"))
    single = whole.filter("record_type = 'response'").select(*names, F.when(F.col("block").isNotNull(), F.array("block")).alias("blocks"))
    stored = single.unionByName(joined).withColumn("d", decoded("blocks"))
    stored = stored.withColumn("intact", F.col("d.good") & (F.col("d.digest") == F.col("payload_digest")))
    shown = [*names[:6], F.col("d.payload").alias("payload"), F.octet_length("d.payload").cast("long").alias("payload_bytes"), "intact"]
    again = whole.filter("record_type = 'revisit'").select(*names[:6], F.lit(None).cast("binary").alias("payload"), F.col("length").alias("payload_bytes"), F.lit(True).alias("intact"))
    return stored.select(*shown).unionByName(again)
