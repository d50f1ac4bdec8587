"""WARC records in a content-addressed archive.

Two tables make the archive.  ``payloads`` holds the bytes of every payload once, under
its SHA-256; ``records`` holds each record's header text and HTTP header exactly as
written, its digest and its payload's length.  Joining them on the digest gives back
every record byte for byte.  Of the records with equal payloads of at least
``MIN_SHARED_BYTES`` bytes the one with the largest page id is the ``response``, the
others are ``revisit`` records that name it; smaller payloads are stored once as well,
but their records are all responses.

A null html is an empty payload, a null url an empty target.  Rows that repeat a page id
with equal payloads are responses of their own if the id is the largest.  A null page id
is smaller than any other.  An empty table gives an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.session import stored

MIN_SHARED_BYTES = 1000
_CRLF = "\r\n"
_HTTP = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    records: DataFrame
    """``page_id, head, http, address, length``"""
    payloads: DataFrame
    """``address, bytes``"""


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(_CRLF))


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _record_id(page_id: Column, digest: Column) -> Column:
    """A stable id of 128 bits in the form of a UUID."""
    h = F.md5(F.concat_ws("/", _text(page_id), digest).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _heads(pages: DataFrame) -> DataFrame:
    """One row for each record: ids, digests and headers, no payload."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        "page_id",
        F.regexp_replace(_text(F.col("url")), r"[\r\n]", "").alias("target"),
        F.octet_length(body).cast("long").alias("length"),
        F.sha1(body).alias("sha1"),
        F.sha2(body, 256).alias("address"),
    )
    first = (
        rows.filter(F.col("length") >= MIN_SHARED_BYTES)
        .groupBy(F.col("address").alias("shared"))
        .agg(F.max("page_id").alias("origin"))
    )
    rows = rows.join(first, F.col("address") == F.col("shared"), "left").drop("shared")
    # only pages with an id can refer to, or be, another
    revisit = F.col("origin").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("origin"))
    digest = F.concat(F.lit("sha1:"), F.col("sha1"))
    http = F.concat(F.lit(_HTTP), F.col("length").cast("string"), F.lit(_CRLF * 2))
    content = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("length"))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("sha1"))),
        _line("WARC-Date", DATE),
        _line("WARC-Target-URI", F.col("target")),
        _line("WARC-Payload-Digest", digest),
        _line("X-Page-ID", _text(F.col("page_id"))),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Refers-To", _record_id(F.col("origin"), F.col("sha1"))),
                _line("X-Refers-To-Page-ID", _text(F.col("origin"))),
                _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ),
        ).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", content.cast("string")),
        F.lit(_CRLF),
    )
    return rows.select("page_id", head.alias("head"), http.alias("http"), "address", "length")


def write_archive(pages: DataFrame) -> Archive:
    """Write both tables below the shared folder and return them as read back."""
    records = stored(_heads(pages), "warc-records")
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    bodies = pages.select(body.alias("bytes")).withColumn("address", F.sha2("bytes", 256))
    # equal addresses of unequal bytes would mean a broken digest: a second digest and the
    # length have to agree, so that one copy only of the bytes is shuffled
    proof = F.concat(F.md5("bytes"), F.lit("/"), F.octet_length("bytes").cast("string"))
    once = bodies.withColumn("proof", proof).groupBy("address")
    once = once.agg(F.first("bytes").alias("bytes"), F.min("proof").alias("least"), F.max("proof").alias("most"))
    same = F.assert_true(F.col("least") == F.col("most"), "two payloads share a SHA-256")
    once = once.select("address", F.when(same.isNull(), F.col("bytes")).alias("bytes"))
    return Archive(records, stored(once, "warc-payloads", "zstd"))


def read_records(archive: Archive) -> DataFrame:
    """``page_id, record, payload``: full WARC records, rebuilt by joining the two tables.

    A revisit holds its HTTP header only, its payload comes from the shared bytes.  A
    payload whose bytes do not have its address fails the read.
    """
    bytes_of = archive.payloads.withColumnRenamed("address", "at")
    met = archive.records.join(bytes_of, F.col("address") == F.col("at"))
    sound = F.assert_true(F.sha2("bytes", 256) == F.col("address"), "a payload does not match its digest")
    payload = F.when(sound.isNull(), F.col("bytes"))
    is_revisit = F.regexp_extract("head", r"(?md)^WARC-Type: (\S+)", 1) == "revisit"
    end = F.lit(_CRLF * 2).cast("binary")
    parts = [F.col("head").cast("binary"), F.col("http").cast("binary")]
    record = F.when(is_revisit, F.concat(*parts, end)).otherwise(F.concat(*parts, F.col("bytes"), end))
    return met.select("page_id", record.alias("record"), payload.alias("payload"), "head")


def parsed(records: DataFrame) -> DataFrame:
    """Type, digest, reference and payload out of the bytes of ``read_records``.

    A record is its header up to the first empty line, as many bytes as its Content-Length
    says, and an empty line; the block is the HTTP header and the body.  A record of another
    form, or an HTTP header that states another length, fails the read.  A revisit has no
    body, its payload is the joined one.
    """
    end = _CRLF * 2

    def field(name: str, text: str = "head") -> Column:
        return F.regexp_extract(text, rf"(?md)^{name}: ([^\r\n]*)", 1)

    def page(name: str) -> Column:
        return F.expr(f"try_cast(nullif(regexp_extract(head, '(?md)^{name}: ([^\\r\\n]*)', 1), '') AS BIGINT)")

    def upto(data: str) -> Column:
        return F.substring_index(F.col(data).cast("string"), end, 1)

    def rest(data: str, before: str) -> Column:
        return F.substr(F.col(data), F.octet_length(before) + len(end) + 1)

    cut = records.select("record", F.col("payload").alias("shared"), upto("record").alias("head"))
    cut = cut.withColumn("content", rest("record", "head"))
    cut = cut.withColumn("n", field("Content-Length").try_cast("int"))
    cut = cut.withColumn("block", F.substr(F.col("content"), F.lit(1), F.col("n")))
    cut = cut.withColumn("tail", F.substr(F.col("content"), F.col("n") + 1)).drop("content")
    cut = cut.withColumn("http", upto("block")).withColumn("body", rest("block", "http"))
    again = field("WARC-Type") == "revisit"
    cut = cut.withColumn("payload", F.when(again, F.col("shared")).otherwise(F.col("body")))
    whole = (
        F.col("head").startswith(f"WARC/1.1{_CRLF}")
        & F.col("http").startswith(f"HTTP/1.1 200 OK{_CRLF}")
        & (F.col("tail") == F.lit(end).cast("binary"))
        & (field("Content-Length", "http").try_cast("bigint") == F.octet_length("payload"))
        & (~again | (F.octet_length("body") == 0))
    )
    sound = F.assert_true(F.coalesce(whole, F.lit(False)), "a record's parts do not have the stated lengths")
    return cut.select(
        page("X-Page-ID").alias("page_id"),
        F.when(sound.isNull(), F.octet_length("payload")).cast("long").alias("payload_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
        F.sha1("payload").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        page("X-Refers-To-Page-ID").alias("refers_to"),
    )


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archive, read it back and describe every record."""
    rows = parsed(read_records(write_archive(pages)))
    sound = F.assert_true(F.col("stated_digest") == F.col("payload_digest"), "a header states another digest")
    return rows.select(
        "page_id",
        "payload_bytes",
        F.when(sound.isNull(), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
