"""Web captures as WARC archives, and their assembly from request, response and metadata records.

Writing: every page becomes three records (request, response or revisit, metadata) that name each other
through WARC-Concurrent-To.  Of pages with equal payloads of at least ``min_revisit_bytes`` the one with
the largest id is stored; the others become revisit records that carry the payload's digest alone.

Reading: the archives are parsed by content length, and the records of a capture are joined through the
concurrent-to identifiers into one nested row.

Defined results: a null payload counts as empty; a null url leaves the target out; a null id can't be the
largest, so such a page is a response unless another page of equal payload has an id; rows that repeat the
stored page are responses too; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and line ends of the WARC format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS_PER_FILE = 30_000
_RECORD = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("concurrent_to", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("http_header", T.StringType()), T.StructField("payload", T.BinaryType()),
    T.StructField("computed_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
])


def _header(kind: str, record_id: Column, uri: Column, content_type: str, block: Column, *more: Column) -> Column:
    """Header and block of a record without the two line ends that close it."""
    return F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}"),
        F.when(uri.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(CRLF))).otherwise(""),
        *more,
        F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF), block,
    )


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _uuid(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), key))
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_revisit_bytes: int = 1000,
) -> None:
    """Write gzip-compressed archives below ``path``, one file or more per task.

    The payload crosses the network once, in the join with the stored page of its digest; AQE splits the
    partition of a digest that many pages share.  Record ids only have to agree inside one capture, whose
    records come from one row, so a task that is run again writes a consistent file.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    base = pages.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order_id"),
        F.regexp_replace(F.col(url_col), r"[\r\n]", "%0A").alias("uri"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("n"), F.sha1(payload).alias("digest"),
    )
    stored = (
        base.filter(F.col("n") >= min_revisit_bytes).groupBy(F.col("digest").alias("stored_digest"))
        .agg(F.max("order_id").alias("stored_id"), F.count("*").alias("copies"))
        .filter("copies > 1")
    )
    known = base.join(stored, F.col("digest") == F.col("stored_digest"), "left")
    revisit = F.col("stored_id").isNotNull() & ~F.col("order_id").eqNullSafe(F.col("stored_id"))
    key = F.concat_ws(":", F.monotonically_increasing_id().cast("string"), "id", "digest")
    known = known.withColumns({"key": key, "revisit": revisit})
    uri, capture = F.col("uri"), _uuid("capture", F.col("key"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF)
    )
    digest = _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    to = _field("WARC-Concurrent-To", F.concat(F.lit("<"), capture, F.lit(">")))
    host = F.coalesce(F.regexp_extract(uri, r"^[a-z]+://([^/?#]*)", 1), F.lit(""))
    target = F.coalesce(F.regexp_extract(uri, r"^[a-z]+://[^/?#]*([^#]*)", 1), F.lit(""))
    request = _header(
        "request", _uuid("request", F.col("key")), uri, "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF + CRLF)),
        to,
    )
    response = F.when(
        F.col("revisit"),
        _header("revisit", capture, uri, "application/http; msgtype=response", http, digest, F.lit(f"WARC-Profile: {PROFILE}{CRLF}")),
    ).otherwise(_header("response", capture, uri, "application/http; msgtype=response", F.concat(http, F.col("payload")), digest))
    metadata = _header(
        "metadata", _uuid("metadata", F.col("key")), uri, "application/warc-fields",
        F.concat(F.lit("page-id: "), F.coalesce("id", F.lit("")), F.lit(CRLF)), to,
    )
    records = known.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse_records(data: bytes) -> Iterator[tuple]:
    """Records of an uncompressed archive, cut by their content lengths."""
    import hashlib

    at, end = 0, len(data)
    while at < end:
        cut = data.index(b"\r\n\r\n", at)
        lines = data[at:cut].decode().split(CRLF)
        if lines[0] != VERSION:
            raise ValueError(f"no record starts at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        n = int(head["Content-Length"])
        block = data[cut + 4:cut + 4 + n]
        if len(block) != n:
            raise ValueError(f"the record at byte {at} is cut short")
        at = cut + 4 + n + 4
        kind, fields, http, payload = head["WARC-Type"], {}, None, None
        if kind == "metadata":
            fields = dict(line.split(": ", 1) for line in block.decode().split(CRLF) if line)
        else:
            top, _, payload = block.partition(b"\r\n\r\n")
            http = top.decode()
        stored = kind == "response"
        yield (
            kind, head["WARC-Record-ID"].strip("<>"), head.get("WARC-Concurrent-To", "").strip("<>") or None, head.get("WARC-Target-URI"),
            head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, fields, http, payload if stored else None,
            hashlib.sha1(payload).hexdigest() if stored else None, len(payload) if stored else None,
        )


def read_records(spark: SparkSession, path: str, batch_bytes: int = 8_000_000) -> DataFrame:
    """One row per record of the archives below ``path``; one file at a time is held in memory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for row in parse_records(zlib.decompress(content, wbits=31)):
                    rows.append(row)
                    size += 500 + (row[-1] or 0)
                    if size >= batch_bytes:
                        yield pd.DataFrame(rows, columns=_RECORD.names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=_RECORD.names)

    return files.mapInPandas(parse, _RECORD)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, response or revisit, and metadata records.

    The three joins run on record ids, which no two captures share.  A revisit takes the stored capture
    of its digest, and with it the length of the payload.
    """
    main = records.filter(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), "record_type", "target_uri", "payload_digest", "computed_digest", "payload_bytes",
        F.struct("http_header", "payload").alias("response"),
    )
    request = records.filter("record_type = 'request'").select(
        F.col("concurrent_to").alias("request_of"), F.struct("record_id", "http_header").alias("request")
    )
    metadata = records.filter("record_type = 'metadata'").select(
        F.col("concurrent_to").alias("metadata_of"), F.struct("record_id", "fields").alias("metadata")
    )
    return (
        main.join(request, F.col("capture_id") == F.col("request_of"), "left")
        .join(metadata, F.col("capture_id") == F.col("metadata_of"), "left")
        .drop("request_of", "metadata_of")
    )


def capture_summary(captures: DataFrame) -> DataFrame:
    """Per capture the page id, payload length and digest, record type and, for a revisit, the page it refers to."""
    page_id = F.expr("try_cast(metadata.fields['page-id'] as bigint)")
    rows = captures.select(
        page_id.alias("page_id"), F.coalesce("computed_digest", "payload_digest").alias("payload_digest"), "record_type", "payload_bytes",
    )
    stored = (
        rows.filter("record_type = 'response'").groupBy(F.col("payload_digest").alias("stored_digest"))
        .agg(F.max("page_id").alias("stored_page"), F.first("payload_bytes").alias("stored_bytes"))
    )
    responses = rows.filter("record_type = 'response'").select("*", F.lit(None).cast("long").alias("refers_to"))
    revisits = (
        rows.filter("record_type = 'revisit'").join(stored, F.col("payload_digest") == F.col("stored_digest"))
        .select("page_id", "payload_digest", "record_type", F.col("stored_bytes").alias("payload_bytes"), F.col("stored_page").alias("refers_to"))
    )
    return responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
