"""A content-addressed web archive: payload bytes once per strong digest, record headers apart.

``write_archive`` makes two tables. ``payloads`` holds the bytes of each distinct payload under its
SHA-256 and length. ``records`` holds one row per record: the exact header block (WARC headers and
HTTP headers as they stand in front of the payload) and the key of its payload. ``read_archive`` joins
them back and recomputes every payload's SHA-256, so altered bytes raise an error.

Among records with equal payloads the one with the largest id is a ``response``, the others are
``revisit`` records that refer to it. Payloads are shuffled by digest after a task's copies have become one;
only narrow rows are shuffled by a digest that many records share, and those joins can be split by
adaptive execution.

Defined cases: a null payload is empty; a null uri leaves the target header out, line breaks in a uri
are percent-encoded; rows that repeat both id and payload are the same record, so if it is the
largest all of them are responses; rows without id are revisits if a record with an id has their payload, else responses.
Further columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.plans.stage import stage

_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are 20 bits, so four base-32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-record:"), F.coalesce(record_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(
    pages: DataFrame, record_id: str = "page_id", uri: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> tuple[DataFrame, DataFrame]:
    """Write the archive's two tables to the shared folder; returns (records, payloads) read from there."""
    rid = F.col(record_id).cast("long")
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    source = pages.select(rid.alias("record_id"), F.col(uri).alias("uri"), body.alias("payload"))
    keyed = source.withColumns({"sha256": F.unhex(F.sha2("payload", 256)), "n": F.octet_length("payload").cast("long")})
    # Copies meet within a task first, so a payload is shuffled once per task that holds it, and by this step alone.
    distinct = stage(keyed.groupBy("sha256", "n").agg(F.max("record_id").alias("owner"), F.first("payload").alias("payload")), "warc-payloads")
    owners = distinct.select(F.col("sha256").alias("o_sha256"), F.col("n").alias("o_n"), "owner")
    payloads = distinct.select("sha256", "n", "payload")
    narrow = keyed.select("record_id", "uri", "sha256", "n", base32_sha1(F.col("payload")).alias("sha1"))
    joined = narrow.join(owners, (F.col("sha256") == F.col("o_sha256")) & (F.col("n") == F.col("o_n")))
    is_response = F.col("record_id").eqNullSafe(F.col("owner"))
    safe_uri = F.replace(F.replace(F.col("uri"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}"),
        _line("Content-Length", F.col("n").cast("string")),
        F.lit(_CRLF),
    )
    block = F.octet_length(http) + F.when(is_response, F.col("n")).otherwise(0)
    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _line("WARC-Type", F.when(is_response, "response").otherwise("revisit")),
        _line("WARC-Record-ID", _urn(F.col("record_id"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", safe_uri), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(is_response, "").otherwise(
            F.concat(F.lit(f"WARC-Profile: {_PROFILE}{_CRLF}"), _line("WARC-Refers-To", _urn(F.col("owner"))))
        ),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"),
        _line("Content-Length", block.cast("string")),
        F.lit(_CRLF),
        http,
    )
    records = stage(joined.select(header.cast("binary").alias("header"), "sha256"), "warc-records")
    return records, payloads


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row per record: fields parsed from its header, the full payload (also of revisits), and ``record``, its exact bytes."""
    intact = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    checked = payloads.select(
        F.col("sha256").alias("p_sha256"),
        F.when(intact, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest"))).alias("payload"),
    )
    text = F.col("header").cast("string")

    def field(name: str, pattern: str) -> Column:
        found = F.regexp_extract(text, f"(?md)^{name}: {pattern}\r$", 1)
        return F.when(found != "", found)

    kind = field("WARC-Type", "(\\w+)")
    joined = records.join(checked, F.col("sha256") == F.col("p_sha256"))
    parsed = joined.select(
        field("WARC-Record-ID", "<urn:x-record:(-?\\d+)>").cast("long").alias("record_id"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("uri"),
        kind.alias("record_type"),
        field("WARC-Refers-To", "<urn:x-record:(-?\\d+)>").cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:(\\w+)").alias("stated_digest"),
        "header",
        "payload",
    )
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return parsed.withColumn("record", F.concat("header", body, F.lit(b"\r\n\r\n")))


def export_warc(archive: DataFrame, folder: str) -> None:
    """Write the records as WARC files: Spark's text sink with the record end as its line end keeps every byte."""
    bytes_ = F.concat("header", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    archive.select(bytes_.cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").text(folder)
