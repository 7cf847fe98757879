"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart, records rebuilt by a join."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import Scratch, lookup

CRLF = "\r\n"
#: Fixed values of the WARC 1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as 32 base32 characters: each 5 hex digits (20 bits) are 4 of them."""
    sha = F.sha1(data)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(sha, 5 * k + 1, 5), 16, 32), 4, "0"), DIGITS, BASE32) for k in range(8)))


def records_of(scratch: Scratch, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """A record per page: sha256, record_type, header (the exact bytes before the payload, as text) and payload.

    Of the records with equal payloads of at least ``min_revisit_bytes`` bytes, those with the largest page_id are
    responses and the others revisit it; a null page_id counts as smallest. A null html is an empty payload. Line
    ends in a url are percent-encoded; a null url is empty. Rows that repeat the largest page_id are all responses, and
    their payload is stored once. A payload of any length is one value of its row. An empty table gives no records;
    other columns are not looked at.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), body.alias("payload"))
    p = p.withColumns({"sha256": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    many = p.select("sha256", "page_id").groupBy("sha256").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    many = scratch.save(many.where("n > 1").select("sha256", "top", F.lit(True).alias("repeated")), "repeated")
    p = lookup(p, many, ["sha256"], "left").withColumn("revisit", F.col("top").isNotNull() & (F.col("bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("top")))
    uri = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"), line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    length = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uri(F.col("top"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
        http,
    )
    return p.select("sha256", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.coalesce("repeated", F.lit(False)).alias("repeated"), header.alias("header"), "payload")


def write_archive(records: DataFrame, path: str) -> None:
    """Write ``headers`` and ``payloads`` below ``path``. A payload that several responses hold is stored once."""
    records.select("sha256", "record_type", "header").write.mode("overwrite").parquet(f"{path}/headers")
    held = records.where("record_type = 'response'").select("sha256", "payload", "repeated")
    once = held.where("not repeated").select("sha256", "payload").unionByName(held.where("repeated").groupBy("sha256").agg(F.first("payload").alias("payload")))
    once.write.mode("overwrite").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rebuild the records: header, payload (null for revisits, which have none in their block), content (the page's
    bytes, for revisits those of the stored copy), and the fields that the header's bytes state.

    Content whose SHA-256 is not its key, a record of either type without any, or a header whose digest or lengths
    disagree with the bytes raises an error.
    """
    h = spark.read.parquet(f"{path}/headers")
    p = spark.read.parquet(f"{path}/payloads")
    d = h.join(p.withColumnRenamed("payload", "content"), "sha256", "left")
    field = lambda name, kind=r"([^\r\n]*)": F.regexp_extract("header", rf"\r\n{name}: {kind}\r\n", 1)
    head_end = F.instr(F.col("header"), CRLF + CRLF)
    http = F.expr(f"substring(header, instr(header, '{CRLF}{CRLF}') + 4)")
    d = d.withColumns({
        "record_type": field("WARC-Type"),
        "page_id": F.expr("try_cast(regexp_extract(header, 'WARC-Record-ID: <urn:page:([^>]*)>', 1) as bigint)"),
        "refers_to": F.expr("try_cast(regexp_extract(header, 'WARC-Refers-To: <urn:page:([^>]*)>', 1) as bigint)"),
        "payload_digest": field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})"),
        "payload_bytes": F.regexp_extract(http, r"\r\nContent-Length: (\d+)\r\n", 1).cast("long"),
        "block_bytes": F.regexp_extract(F.expr("substring(header, 1, instr(header, '\r\n\r\n') + 1)"), r"\r\nContent-Length: (\d+)\r\n", 1).cast("long"),
        "http_bytes": F.octet_length(http).cast("long"),
    })
    in_block = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    sound = (
        (head_end > 0)
        & (F.sha2("content", 256) == F.col("sha256"))
        & (base32_sha1(F.col("content")) == F.col("payload_digest"))
        & (F.octet_length("content") == F.col("payload_bytes"))
        & (F.col("block_bytes") == F.col("http_bytes") + in_block)
    )
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("archive record is damaged: "), F.col("header"))))
    d = d.withColumn("payload", F.when(F.col("record_type") == "response", F.col("content"))).withColumn("record_type", checked)
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "header", "payload", "content")


def archive_pages(scratch: Scratch, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archive of ``pages`` (page_id, url, html) in the shared folder and read it back, a row per page.

    Nulls, repeated rows, long payloads and empty tables: see ``records_of``.
    """
    write_archive(records_of(scratch, pages, min_revisit_bytes), scratch.path("archive"))
    return read_archive(pages.sparkSession, scratch.path("archive"))


def export_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records (header, payload) as plain WARC files: the record end is the row separator of Spark's text writer."""
    value = F.concat(F.col("header").cast("binary"), F.coalesce(F.col("payload"), F.lit("").cast("binary"))).cast("string")
    records.select(value.alias("value")).write.mode("overwrite").option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Read WARC files of at most 2 GB each: a row per record with header (through its HTTP header) and payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data, at = data.as_py(), 0
                heads, bodies = [], []
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    length = next(int(x[15:]) for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    http = data.index(b"\r\n\r\n", end) + 4
                    heads.append(data[at:http].decode("utf-8", "replace"))
                    bodies.append(data[http : end + length])
                    at = end + length + 4
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.string()), pa.array(bodies, pa.binary())], ["header", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "header string, payload binary")
