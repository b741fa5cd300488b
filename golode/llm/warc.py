"""WARC archives: writing, reading, and assembly of transactions.

A capture is three records: a request, a response (or a revisit of an equal payload) and metadata.
Request and metadata name the response in WARC-Concurrent-To; assembly joins the three through it
and emits one nested row per capture. Records are text (headers are ASCII, payloads UTF-8), so
Spark's own text writer makes the archives, with the blank lines that end a record as its
separator: any store that Spark can write to will do, and a lost task is written again. A file has
RECORDS_PER_FILE records of payloads of up to LARGE bytes at most, or one capture of a larger one,
so it is bounded in bytes; what is written is one gzip member a file, and files of many members
(one for each record, as archives mostly come) are read as well. Reading goes by Content-Length.

Of captures with equal payloads of at least ``revisit_from`` bytes the one with the smallest
page id is the response and the others are revisits that refer to it. Digests that a large share of
all captures have are joined by broadcast, so their bodies stay where they are.

Defined results: null html is an empty payload, null url an empty target; an empty table writes no
records and reads as none; rows that repeat a page id are captures each (the first of them in the table's order is
the response if their payloads are equal); other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from golode.llm.common import heavy_join, scratch, staged, table

RECORDS_PER_FILE = 3000
#: Bytes of a payload that shares a file with others.
LARGE = 256 << 10
#: Bytes of an archive that are inflated at a time.
CHUNK = 64 << 10
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
    "payload_digest string, payload_bytes long, page_id long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four of base 32, eight times."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def captures(pages: DataFrame, revisit_from: int = 0, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """page_id, url, html, digest, bytes, record_id, refers_to (null for responses)."""
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
        F.monotonically_increasing_id().alias("nth"),
    )
    base = base.withColumns({"bytes": F.octet_length("html").cast("long"), "digest": base32_sha1(F.col("html").cast("binary"))})
    name = F.concat(F.lit("urn:uuid:"), F.md5(F.concat_ws("/", F.lit("response"), "page_id", "nth").cast("binary")))
    firsts = base.groupBy("digest").agg(F.min(F.struct("page_id", "nth")).alias("first"), F.count(F.lit(1)).alias("times"))
    firsts = firsts.select("digest", "times", F.col("first.page_id").alias("f_page"), F.col("first.nth").alias("f_nth"))
    found = heavy_join(base, firsts, "digest", "times", pages.count())
    again = (F.col("bytes") >= revisit_from) & (F.col("f_nth") != F.col("nth"))
    first_name = F.concat(F.lit("urn:uuid:"), F.md5(F.concat_ws("/", F.lit("response"), "f_page", "f_nth").cast("binary")))
    return found.select("page_id", "url", "html", "digest", "bytes", name.alias("record_id"), F.when(again, first_name).alias("refers_to"))


def _record(kind, record_id, block, headers) -> Column:
    """A record without the blank lines that end it."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">")), F.lit(f"WARC-Date: {DATE}")]
    lines += [*headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def records(found: DataFrame) -> DataFrame:
    """value: three records per capture."""
    target = F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", ""))
    to = F.concat(F.lit("WARC-Concurrent-To: <"), F.col("record_id"), F.lit(">"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    refers = F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: <"), F.col("refers_to"), F.lit(">")))
    profile = F.when(
        F.col("refers_to").isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    )
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(head, F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(F.lit("")))
    own = lambda kind: F.concat(F.lit("urn:uuid:"), F.md5(F.concat(F.lit(kind), F.col("record_id")).cast("binary")))
    path = F.concat(F.lit("GET "), F.regexp_replace("url", "[\\s]", "%20"), F.lit(" HTTP/1.1" + END))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    kind = F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    http = F.lit("Content-Type: application/http")
    return found.select(
        F.explode(
            F.array(
                _record(F.lit("request"), own("request"), path, [target, to, http]),
                _record(kind, F.col("record_id"), block, [target, digest, refers, profile, http]),
                _record(F.lit("metadata"), own("metadata"), fields, [target, to, F.lit("Content-Type: application/warc-fields")]),
            )
        ).alias("value")
    )


def write(pages: DataFrame, path: str, revisit_from: int = 0, html_col: str = "html") -> None:
    found = captures(pages, revisit_from, html_col=html_col)
    longest = pages.agg(F.max(F.octet_length(html_col))).first()[0] or 0

    def put(rows: DataFrame, most: int) -> None:
        records(rows).write.mode("append").option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", most).text(path)

    put(found.where(F.col("bytes") <= LARGE), RECORDS_PER_FILE)
    if longest > LARGE:
        put(found.where(F.col("bytes") > LARGE), 3)


def inflated(data: bytes) -> bytes:
    """What the gzip members of a file hold, one after another; up to where one is broken."""
    out, at = [], 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while not member.eof and at < len(data):
                part = data[at : at + CHUNK]
                out.append(member.decompress(part))
                at += len(part) - len(member.unused_data)
        except zlib.error:
            break
    return b"".join(out)


def _named(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def parse(data: bytes, with_payload: bool):
    """Rows of RECORDS from a file's bytes. What is no record up to its end is left out."""
    at, end = 0, END.encode()
    while (at := data.find(b"WARC/", at)) >= 0:
        head = data.find(end, at)
        if head < 0:
            return
        named = _named(data[at:head])
        try:
            size = int(named["content-length"])
        except (KeyError, ValueError):
            at = head + len(end)
            continue
        start = head + len(end)
        block = data[start : start + size]
        if len(block) < size:
            return
        kind, page, digest, length, payload = named.get("warc-type"), None, None, None, None
        if kind in ("response", "revisit"):
            http = block.find(end)
            http_named = _named(block[: max(http, 0)])
            payload = block[http + len(end) :] if http >= 0 else block
            if kind == "response":
                digest, length = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
            else:
                digest = named.get("warc-payload-digest", "").removeprefix("sha1:") or None
                length = int(http_named["content-length"]) if http_named.get("content-length", "").isdigit() else None
        elif kind == "metadata":
            field = _named(b"\r\n" + block).get("page-id", "")
            page = int(field) if field.lstrip("-").isdigit() else None
        bare = lambda k: named[k].strip("<>") if k in named else None
        yield (
            bare("warc-record-id"), kind, bare("warc-concurrent-to"), bare("warc-refers-to"), named.get("warc-target-uri"),
            digest, length, page, payload if with_payload else None,
        )
        at = start + size + len(end)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below a path."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = {"payload_bytes": pa.int64(), "page_id": pa.int64(), "payload": pa.binary()}

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                data = inflated(data) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for row in parse(data, with_payload):
                    rows.append(row)
                    size += len(row[-1] or b"") + 300
                    if size > 16_000_000:
                        yield _batch(rows, names, types)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names, types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def _batch(rows, names, types):
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names)


def assemble(found: DataFrame) -> DataFrame:
    """capture_id, request, response, metadata: nested records, joined through concurrent-to."""
    nested = F.struct(*[F.col(x.split()[0]) for x in RECORDS.split(", ")])
    answer = found.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), nested.alias("response"))
    about = lambda kind: found.where(F.col("record_type") == kind).select(
        F.col("concurrent_to").alias("capture_id"), nested.dropFields("payload").alias(kind)
    )
    return answer.join(about("request"), "capture_id", "left").join(about("metadata"), "capture_id", "left")


def op9(spark, sf_dir):
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    whole = assemble(staged(read(spark, path, with_payload=False), "records"))
    rows = whole.select(
        "capture_id",
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("named"),
    )
    rows = staged(rows, "captures")
    # Many revisits may name one response.
    pages = rows.select(F.col("capture_id").alias("named"), F.col("page_id").alias("refers_to"))
    named = rows.where("named is not null").groupBy("named").agg(F.count(F.lit(1)).alias("times")).join(pages, "named", "left")
    referred = heavy_join(rows.where("named is not null"), named, "named", "times", rows.count())
    plain = rows.where("named is null").withColumn("refers_to", F.lit(None).cast("long"))
    keep = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(keep).unionByName(referred.select(keep))


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes,
       translate(""" + " || ".join(
    f"to_base(CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT), 32, 4)" for i in range(8)
) + f""", '{_HEX32}', '{_BASE32}') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
