"""WARC archives: write pages as transactions, read archives, assemble captures.

A page becomes three records: request, response (or revisit) and metadata; request and
metadata name the response in WARC-Concurrent-To. Records are UTF-8 text, so Spark's own
text writer, with the record separator as line separator, makes the archives and commits
them task by task; files hold a bounded number of records and are gzipped.

Reading takes whole files (never larger than a writer's bound) and cuts them by
Content-Length, so a payload may hold anything, record headers too. `captures` brings the
records together again by the response id they share, wherever they lie, in one pass over
the archives, and gives one nested row per capture. `resolve` follows the record ids that
revisits name.

Among records with equal payloads of at least `REVISIT_BYTES` bytes the one with the
largest page_id is the response, the others are revisits that carry its digest, its
record id in WARC-Refers-To and the HTTP header with the full length, but no payload.

Record ids come from the place of a row in `pages`, so a table whose rows change places
between two reads (an unsorted shuffle, say) is to be written first. Of several requests
or metadata records of one capture that with the largest id counts; records that name no
response of the archives are left out; a revisit whose response is not there refers to null.

Nulls: a null html is an empty payload, a null url leaves out the target URI, a null
page_id is smaller than any other and stays null. Repeated rows each become a
transaction; of equal rows with the largest page_id all are responses. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, small, small_batches, table

# Ship these functions with their tasks, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REVISIT_BYTES = 1000
PAGES_PER_FILE = 1000
# Fixed values of the format: version line, line end, record separator, revisit profile.
VERSION = "WARC/1.1"
CRLF = "\r\n"
SEPARATOR = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

RECORD = (
    "record_id string, type string, concurrent_to string, target_uri string, refers_to string, "
    "digest string, http_length bigint, payload binary, fields map<string,string>"
)
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "type", "concurrent_to", "target_uri", "refers_to", "digest")]
    + [("http_length", pa.int64()), ("payload", pa.binary()), ("fields", pa.map_(pa.string(), pa.string()))]
)
BATCH_BYTES = 4 << 20


def _transactions(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """Pages with digest, length, whether they revisit, and the row they refer to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    page = pages.select(
        "page_id",
        # A url is one header line.
        F.regexp_replace("url", "[\r\n]+", "%0A").alias("url"),
        html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    same = (
        page.filter(F.col("bytes") >= revisit_bytes)
        .groupBy(F.col("digest").alias("d"))
        .agg(F.max(F.struct("page_id", "row")).alias("k"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("d", F.col("k.page_id").alias("keeper"), F.col("k.row").alias("keeper_row"))
    )
    told = page.join(same, F.col("digest") == F.col("d"), "left")
    revisits = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return told.withColumn("revisits", revisits)


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write request, response or revisit, and metadata of every page under `folder`."""
    text = lambda c: c.cast("string")
    name = lambda kind, row: F.concat(F.lit("<urn:tx:"), F.md5(F.concat_ws("|", F.lit(kind), text(F.col(row)))), F.lit(">"))

    def record(kind, block, id_, *headers):  # noqa: ANN001, ANN202 - columns
        lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), id_)]
        lines += [F.lit(f"WARC-Date: {DATE}"), *headers]
        lines.append(F.concat(F.lit("Content-Length: "), text(F.octet_length(block))))
        return F.concat(F.concat_ws(CRLF, *lines), F.lit(SEPARATOR), block)

    def header(key, value):  # noqa: ANN001, ANN202 - null (left out) if the value is null
        return F.concat(F.lit(f"{key}: "), value)

    tx = _transactions(pages, revisit_bytes)
    own = name("response", "row")
    uri = header("WARC-Target-URI", F.col("url"))
    with_ = header("WARC-Concurrent-To", own)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        text(F.col("bytes")),
        F.lit(SEPARATOR),
    )
    main = record(
        F.when(F.col("revisits"), "revisit").otherwise("response"),
        F.when(F.col("revisits"), http).otherwise(F.concat(http, "html")),
        own,
        uri,
        F.lit("Content-Type: application/http; msgtype=response"),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(F.col("revisits"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(F.col("revisits"), header("WARC-Refers-To", name("response", "keeper_row"))),
    )
    ask = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{SEPARATOR}"))
    request = record(F.lit("request"), ask, name("request", "row"), uri, with_)
    about = F.coalesce(header("page-id", text(F.col("page_id"))), F.lit(""))
    meta = record(
        F.lit("metadata"), about, name("metadata", "row"), uri, F.lit("Content-Type: application/warc-fields"), with_
    )
    (
        tx.select(F.explode(F.array(request, main, meta)).alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * PAGES_PER_FILE)
        .text(folder)
    )


def parse(data: bytes) -> Iterator[dict]:
    """Records of one archive, cut by Content-Length."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, end = 0, len(data)
    while at < end:
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        begin = head_end + 4
        stop = begin + int(head["content-length"])
        block, kind = data[begin:stop], head["warc-type"]
        out = {
            "record_id": head["warc-record-id"], "type": kind, "concurrent_to": head.get("warc-concurrent-to"),
            "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"),
            "digest": (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            "http_length": None, "payload": None, "fields": None,
        }
        if kind in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = re.search(rb"(?im)^content-length: *(\d+)", http)
            out["http_length"] = int(length[1]) if length else None
            out["payload"] = payload if kind == "response" else None
        elif kind == "metadata":
            pairs = (x.partition(": ") for x in block.decode("utf-8").split(CRLF) if x)
            out["fields"] = [(k, v) for k, _, v in pairs]
        yield out
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no separator after the record at byte {at}")
        at = stop + 4


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for content in batch.column("content"):
            for record in parse(content.as_py()):
                rows.append(record)
                held += len(record["payload"] or b"") + 500
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives under `folder`."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(_parse_files, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit, with its request and metadata.

    The payload digest and length of a response are computed from its payload. The three
    records meet by the id of the response, which is the own id of one and the concurrent-to
    of the others. Only the columns that a caller uses move.
    """
    kind = F.col("type")
    is_main = kind.isin("response", "revisit")
    full = kind == "response"
    rows = records.select(
        "*",
        F.when(is_main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("_capture"),
        F.when(full, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.col("digest").alias("told_digest"),
    ).filter(F.col("_capture").isNotNull())
    parts = {
        "request": (kind == "request", ["record_id", "target_uri"]),
        "response": (
            is_main,
            ["record_id", "type", "target_uri", "refers_to", "payload", "payload_digest", "payload_bytes", "told_digest"],
        ),
        "metadata": (kind == "metadata", ["record_id", "fields"]),
    }
    met = rows.groupBy("_capture").agg(
        *[
            F.max_by(column, F.when(which, F.col("record_id"))).alias(f"{part}_{column}")
            for part, (which, columns) in parts.items()
            for column in columns
        ]
    )
    nested = {
        part: F.struct(*[F.col(f"{part}_{column}").alias(column) for column in columns]) for part, (_, columns) in parts.items()
    }
    absent = lambda part: F.when(F.col(f"{part}_record_id").isNotNull(), nested[part]).alias(part)
    return met.filter(F.col("response_record_id").isNotNull()).select(
        F.col("_capture").alias("capture_id"), absent("request"), nested["response"].alias("response"), absent("metadata")
    )


def resolve(rows: DataFrame, value: str, into: str) -> DataFrame:
    """Add as `into` the `value` of the capture whose id `refers_to` names. `rows`: a written table with capture_id.

    The ids that are named come down to one row each before anything moves, so that a response
    with any number of revisits is one row of the join.
    """
    named = rows.filter(F.col("refers_to").isNotNull()).select(F.col("refers_to").alias("_named")).distinct()
    found = rows.join(named, F.col("capture_id") == F.col("_named"), "left_semi")
    found = small(table(found.select(F.col("capture_id").alias("_named"), F.col(value).alias(into)), "named"))
    return rows.join(found, F.col("refers_to") == F.col("_named"), "left").drop("_named")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write `pages` to archives, read them back, one row per page (see the contract of op5)."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder)
    page = captures(read_records(spark, folder)).select(
        "capture_id",
        F.col("response.refers_to").alias("refers_to"),
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("request.target_uri").alias("url"),
    )
    told = resolve(table(page, "captures"), "page_id", "_page")
    return told.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("_page").alias("refers_to"), "url"
    )
