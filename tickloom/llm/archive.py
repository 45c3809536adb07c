"""Content-addressed web archive.

Every page becomes one WARC record. An archive is a folder with two tables:
``payloads`` holds each distinct payload once under its SHA-256, ``headers`` holds
the exact header bytes of every record with the digest of its payload. Records are
put together again by a join on the digest. A digest is trusted only after length
and MD5 of all payloads under it agree, and again on reading, when it is computed
anew from the stored bytes.

Among equal payloads of at least ``least_bytes`` the record with the smallest page
id carries the payload (``response``), the others refer to it (``revisit``).

Defined cases: null html is an empty payload; null ids sort last and leave out their
header line; repeated rows are records of their own, the first read being the
response; line breaks in an URL are percent-encoded, a null URL has no line; an empty
table gives an empty archive; other columns are not archived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import stored
from tickloom.session import scratch_path

#: Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
BLANK = CRLF + CRLF


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive are."""

    path: str

    def headers(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("record long, digest string, header binary").parquet(f"{self.path}/headers")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("digest string, payload binary, n_bytes long, n_records long").parquet(
            f"{self.path}/payloads"
        )


def write_archive(
    pages: DataFrame,
    path: str | None = None,
    least_bytes: int = 100,
    date: str = "2024-01-01T00:00:00Z",
) -> Archive:
    """Archive ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archive")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    size = F.octet_length(payload).cast("long")
    landed = stored(
        pages.select(
            F.monotonically_increasing_id().alias("record"), "page_id", "url", F.sha2(payload, 256).alias("digest"), size.alias("n_bytes")
        ),
        "page-digests",
    )
    # Copies are merged before they move; each task sends a payload once.
    content = pages.select(payload.alias("payload"), F.sha2(payload, 256).alias("digest"), size.alias("size"), F.md5(payload).alias("second"))
    same = (F.min("size") == F.max("size")) & (F.min("second") == F.max("second"))
    (
        content.groupBy("digest")
        .agg(F.min("payload").alias("payload"), F.min("size").alias("n_bytes"), F.count(F.lit(1)).alias("n_records"), same.alias("same"))
        .select(
            "digest", "payload",
            F.when(F.col("same"), F.col("n_bytes")).otherwise(F.raise_error(F.lit("one digest, different payloads"))).alias("n_bytes"),
            "n_records",
        )
        .write.option("compression", "zstd").parquet(f"{path}/payloads")
    )
    first = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record")
    firsts = stored(
        landed.groupBy("digest").agg(F.min(first).alias("first"))
        .select("digest", F.col("first.page_id").cast("string").alias("first_id"), F.col("first.record").alias("first_record")),
        "first-records",
    )
    archive = Archive(path)
    revisit = (F.col("n_bytes") >= least_bytes) & (F.col("record") != F.col("first_record"))
    (
        landed.join(firsts, "digest")
        .select("record", "digest", _header(revisit, date).cast("binary").alias("header"))
        .write.parquet(f"{path}/headers")
    )
    return archive


def _uri(record: Column) -> Column:
    digits = F.md5(F.concat(F.lit("record "), record.cast("string")).cast("binary"))
    parts = [F.substring(digits, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _header(revisit: Column, date: str) -> Column:
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(VERSION + CRLF),
        F.when(revisit, F.lit(f"WARC-Type: revisit{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        _line("WARC-Record-ID", _uri(F.col("record"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        F.when(revisit, F.concat(
            _line("WARC-Refers-To", _uri(F.col("first_record"))),
            _line("X-Refers-To-Page", F.col("first_id")),
            _line("WARC-Profile", F.lit(REVISIT_PROFILE)),
        )).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string")), F.lit(BLANK)),
    )


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """record, bytes (the whole WARC record), payload (also of revisits), payload_digest (computed from the stored bytes)."""
    payloads = archive.payloads(spark).select("digest", "payload", F.sha2("payload", 256).alias("payload_digest"))
    end = F.lit(BLANK).cast("binary")
    body = F.when(_has_payload(F.col("header")), F.col("payload")).otherwise(F.lit(b""))
    wrong = F.raise_error(F.concat(F.lit("payload does not have the digest "), F.col("digest")))
    return (
        archive.headers(spark).join(payloads, "digest")
        .select(
            "record", F.concat("header", body, end).alias("bytes"), "payload",
            F.when(F.col("payload_digest") == F.col("digest"), F.col("digest")).otherwise(wrong).alias("payload_digest"),
        )
    )


def _has_payload(header: Column) -> Column:
    return ~header.cast("string").contains(f"{CRLF}WARC-Type: revisit{CRLF}")


def parse_records(records: DataFrame, id_type: str = "long") -> DataFrame:
    """Fields of each record, from its bytes; lengths and digests are those of the full payload. ``id_type`` is the pages' id type."""
    text = F.col("bytes").cast("string")
    head = F.substring_index(text, BLANK, 1)

    def field(name: str) -> Column:
        value = F.regexp_extract(F.concat(head, F.lit(CRLF)), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(value != "", value)

    start = F.octet_length(head) + len(BLANK)
    own = F.expr(f"substring(bytes, head_bytes + {len(BLANK)} + 1, octet_length(bytes) - head_bytes - {2 * len(BLANK)})")
    parsed = records.withColumns({"head_bytes": start - len(BLANK)}).withColumns({
        "type": field("WARC-Type"), "page_id": field("X-Page-ID").cast(id_type), "refers_to": field("X-Refers-To-Page").cast(id_type),
        "url": field("WARC-Target-URI"), "digest": F.substring_index(field("WARC-Payload-Digest"), ":", -1),
        "length": field("Content-Length").cast("long"), "own": own,
    })
    whole = F.when(F.col("type") == "response", F.col("own")).otherwise(F.col("payload"))
    ok = (F.octet_length("own") == F.col("length")) & (F.col("digest") == F.col("payload_digest"))
    return parsed.select(
        "page_id", "url", F.col("type").alias("record_type"), "refers_to", whole.alias("payload"),
        F.octet_length(whole).cast("long").alias("payload_bytes"),
        F.when(ok, F.col("digest")).otherwise(F.raise_error(F.lit("record and header disagree"))).alias("payload_digest"),
    )
