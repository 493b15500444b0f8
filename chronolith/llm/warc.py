"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records: the request, the response (or a revisit
of an earlier response with an equal payload) and metadata; request and
metadata name the response's record id as concurrent to them.  Archives are
written by Spark's text writer: a record is a value, the blank lines behind it
the separator.  Reading parses whole archive files in tasks; assembly joins the
three records by id into one nested row per capture.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import joined_hot, shared_dir, stored, table, tidied

#: Records in one archive file at most, so that a task reads a bounded file.
RECORDS_PER_FILE = 1500
#: Bytes that one batch of archive files may hold when it goes to Python.
BATCH_BYTES = 32 << 20
#: Payloads of this many bytes and more may be archived as revisits.
LEAST_BYTES = 0
#: The digits of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"

RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, "
    "target_uri string, date string, declared_digest string, payload_digest string, "
    "payload_bytes long, fields map<string,string>, payload binary"
)


def base32_sha1(text: Column) -> Column:
    """Upper-case base 32 of the SHA-1 of a string's UTF-8 bytes."""
    hexed = F.sha1(text.cast("binary"))
    # 60 bits at a time: 15 hexadecimal digits are 12 of base 32
    digits = [
        F.lpad(F.conv(F.substring(hexed, at, n), 16, 32), n * 4 // 5, "0")
        for at, n in ((1, 15), (16, 15), (31, 10))
    ]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def urn(*parts: Column) -> Column:
    """A record id derived from what identifies the record."""
    text = [F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]
    h = F.md5(F.concat_ws("\x1f", *text).cast("binary"))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record's text without the two line ends behind it; null headers are left out."""
    lines = [F.lit("WARC/1.1")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.concat(F.lit(f"{name}: "), value))
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(EOL, *lines, length), F.lit(EOL * 2), block)


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Add each page's digest, size and the response that a revisit refers to.

    Of equal payloads of at least ``least_bytes`` that with the smallest id is
    the response; a row without an id only where no row of the payload has one, and of
    rows with equal ids one.  ``_row`` tells rows apart.  The minimum is taken before and
    after the shuffle; the join back is one that Spark splits where a payload is very common.
    """
    pages = pages.withColumns(
        {"_digest": base32_sha1(F.col("_html")), "_bytes": F.octet_length("_html").cast("long")}
    )
    here = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_url", "_row")
    first = (
        pages.where(F.col("_bytes") >= least_bytes)
        .groupBy("_digest")
        .agg(F.min(here).alias("_first"))
        .withColumnRenamed("_digest", "_key")
    )
    key = F.when(F.col("_bytes") >= least_bytes, F.col("_digest"))
    return (
        pages.join(first, key == F.col("_key"), "left")
        .withColumn("_revisit", F.col("_key").isNotNull() & (F.col("_first._row") != F.col("_row")))
    )


def write_captures(
    pages: DataFrame,
    path: str,
    date: str = "2024-01-01T00:00:00Z",
    least_bytes: int = LEAST_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write the archives of ``pages`` below ``path``, gzip-compressed.

    A null page is an empty payload; a null URL is written as empty; line ends
    in URLs are dropped, as a header can't hold them.  Every row is a capture, whether
    it repeats another or not.  A page with a null id is a capture without an
    id.  An empty table writes an empty archive.
    """
    rows = pages.select(
        F.col(id_col).alias("_id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("_url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("_html"),
        # the place in the scan, which is the same whenever it is read
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = planned(rows, least_bytes)
    own = urn(F.col("_id"), F.col("_url"), F.col("_digest"), F.col("_row"))
    first = urn(F.col("_first._id"), F.col("_first._url"), F.col("_digest"), F.col("_first._row"))
    uri = ("WARC-Target-URI", F.col("_url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
        F.col("_bytes").cast("string"),
        F.lit(EOL * 2),
    )
    kind = [("WARC-Record-ID", own), ("WARC-Date", date), uri, digest]
    response = record(
        [("WARC-Type", "response"), *kind, ("Content-Type", "application/http; msgtype=response")],
        F.concat(http, F.col("_html")),
    )
    revisit = record(
        [
            ("WARC-Type", "revisit"),
            *kind,
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", first),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        http,
    )
    path_part = F.regexp_replace(F.col("_url"), r"^[a-zA-Z]+://[^/]*", "")
    request = record(
        [
            ("WARC-Type", "request"),
            ("WARC-Record-ID", urn(F.lit("request"), own)),
            ("WARC-Date", date),
            uri,
            ("WARC-Concurrent-To", own),
            ("Content-Type", "application/http; msgtype=request"),
        ],
        F.concat(F.lit("GET "), path_part, F.lit(f" HTTP/1.1{EOL}Accept: text/html{EOL * 2}")),
    )
    metadata = record(
        [
            ("WARC-Type", "metadata"),
            ("WARC-Record-ID", urn(F.lit("metadata"), own)),
            ("WARC-Date", date),
            uri,
            ("WARC-Concurrent-To", own),
            ("Content-Type", "application/warc-fields"),
        ],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(EOL)),
    )
    main = F.when(F.col("_revisit"), revisit).otherwise(response)
    (
        rows.select(F.explode(F.array(request, main, metadata)).alias("value"))
        .write.option("lineSep", EOL * 2)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


_HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def fields_of(head: bytes) -> dict[str, str]:
    return {
        k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip()
        for k, v in _HEADER.findall(head)
    }


def parse(data: bytes, keep_payload: bool) -> Iterator[dict]:
    """The records of one archive file, in order."""
    at, end = 0, len(data)
    while at < end:
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        line = data.index(b"\r\n", at)
        head = fields_of(data[line + 2 : stop + 2])
        begin = stop + 4
        block = data[begin : begin + int(head["content-length"])]
        at = begin + len(block)
        if len(block) < int(head["content-length"]):
            raise ValueError(f"the record at byte {begin} ends early")
        kind, payload, own = head.get("warc-type", ""), block, {}
        if "application/http" in head.get("content-type", ""):
            http, _, payload = block.partition(b"\r\n\r\n")
            start, _, rest = http.partition(b"\r\n")
            own = fields_of(rest + b"\r\n") | {"": start.decode("utf-8", "replace")}
        elif head.get("content-type") == "application/warc-fields":
            own = fields_of(block)
        yield {
            "record_id": head.get("warc-record-id"),
            "record_type": kind,
            "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"),
            "target_uri": head.get("warc-target-uri"),
            "date": head.get("warc-date"),
            "declared_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            "payload_bytes": len(payload),
            "fields": own,
            "payload": payload if keep_payload else None,
        }


def read_records(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Every record of the archives below ``path``: ``RECORD`` columns.

    Without ``keep_payload`` payloads are measured and digested where they are
    parsed and do not leave the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in re.sub(r"map<.*?>", "map", RECORD).split(", ")]
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = gzip.decompress(content) if name.endswith(".gz") else bytes(content)
                rows = []
                for row in parse(data, keep_payload):
                    rows.append(row)
                    if len(rows) >= 500:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(tidied(run), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture, joined through the concurrent-to ids.

    Returns ``record_id``, ``record_type``, ``target_uri``, ``date``,
    ``payload_digest``, ``payload_bytes``, ``payload``, ``refers_to`` and the structs
    ``request`` and ``metadata`` (record_id, fields), null where a capture lacks
    one.  A record that occurs twice counts once; request and metadata records
    without their response are left out.  A revisit has the digest and size of
    the response that it refers to, or its own declared digest where that
    response isn't among the records.
    """
    main = records.where(F.col("record_type").isin("response", "revisit")).dropDuplicates(["record_id"])

    def side(kind: str) -> DataFrame:
        return (
            records.where(F.col("record_type") == kind)
            .where("concurrent_to is not null")
            .dropDuplicates(["concurrent_to"])
            .select(
                F.col("concurrent_to").alias("record_id"),
                F.struct("record_id", "fields").alias(kind),
            )
        )

    whole = main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")
    asked = main.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    target = main.where("record_type = 'response'").join(asked, "record_id", "left_semi").select(
        F.col("record_id").alias("_target"),
        F.struct("payload_digest", "payload_bytes").alias("_original"),
    )
    whole = joined_hot(whole, stored(target), "refers_to", "_target")
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        "record_id",
        "record_type",
        "target_uri",
        "date",
        F.when(revisit, F.coalesce("_original.payload_digest", "declared_digest"))
        .otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        F.when(revisit, F.col("_original.payload_bytes"))
        .otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"),
        "payload",
        "refers_to",
        "request",
        "metadata",
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_captures(table(spark, sf_dir, "pages"), path)
    # several joins read the records: the archives are parsed once
    captures = assemble(stored(read_records(spark, path, keep_payload=False)))
    kind = table(spark, sf_dir, "pages").schema["page_id"].dataType
    captures = captures.select(
        F.try_element_at("metadata.fields", F.lit("page-id")).try_cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "record_id",
        "refers_to",
        "target_uri",
    )
    captures = stored(captures)
    asked = captures.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    named = captures.where("record_type = 'response'").join(asked, "record_id", "left_semi")
    named = stored(named.select(F.col("record_id").alias("_target"), F.col("page_id").alias("_page")))
    return joined_hot(captures, named, "refers_to", "_target").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("_page").alias("refers_to"), "target_uri"
    )


ORACLE_SQL = """
with p as (
  select page_id, url, coalesce(html, '') html from pages
), d as (
  select page_id, url, octet_length(encode(html)) n, sha1(html) h,
         min(page_id) over (partition by html) first_id,
         row_number() over (partition by html order by page_id nulls last, url) nth
  from p
)
select page_id, n::bigint payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 5 * (i // 4)::int + 1, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31) + 1)::int, 1)
    for i in range(32)], '') payload_digest,
  case when nth = 1 then 'response' else 'revisit' end record_type,
  case when nth > 1 then first_id end refers_to,
  url target_uri
from d
"""
