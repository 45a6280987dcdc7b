"""Content-addressed web archive.

An archive is two tables: ``payloads`` holds each payload's bytes once under
its SHA-256, which is checked whenever the bytes are read; ``records`` holds
the exact header of each WARC record and the digest of its payload.  A join on
the digest gives the records back as they were.

Of records with equal payloads of at least ``min_revisit`` bytes the one with
the largest id is a response and the others are revisits that refer to it;
smaller payloads always make responses.

Defined results: a null payload is an empty one; rows that repeat the largest
id of a payload are all responses; a null id is below any other, and its
record id ends in ``null``; CR and LF in an address become spaces; an empty
table gives an empty archive; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointspark.llm.common import save

MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _header(record_id, kind, url, sha1, refers_to, length):
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda value: F.concat(F.lit("<urn:page:"), F.coalesce(value.cast("string"), F.lit("null")), F.lit(">"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(record_id)),
        line("WARC-Target-URI", F.translate(F.coalesce(url, F.lit("")), CRLF, "  ")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(refers_to)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(length).cast("string")),
        F.lit(CRLF),
    )


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    *,
    min_revisit: int = MIN_REVISIT,
) -> None:
    """Write ``path/payloads`` and ``path/records`` as Parquet."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    items = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest")
    )
    # Partial aggregation keeps one copy of a payload in each map task, so a hot payload is never gathered.
    items.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    narrow = items.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("length"))
    large = F.col("length") >= min_revisit
    # A written table, so that both sides of the join come from exchanges and a hot digest's pages are split.
    chosen = save(narrow.where(large).groupBy("digest").agg(F.max("id").alias("chosen")), "warc-chosen")
    joined = narrow.where(large).join(chosen, "digest", "left").unionByName(narrow.where(~large), allowMissingColumns=True)
    kind = F.when((F.col("length") < min_revisit) | F.col("id").eqNullSafe(F.col("chosen")), F.lit("response")).otherwise(F.lit("revisit"))
    joined.select(
        _header(F.col("id"), kind, F.col("url"), F.col("sha1"), F.col("chosen"), F.col("length")).alias("header"), "digest"
    ).write.option("compression", "zstd").parquet(f"{path}/records")


def read_archive(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row for each record, with what its header says and its payload; ids are of the type given.

    Columns: page_id, url, record_type, refers_to, header, payload,
    payload_bytes, payload_digest (SHA-1 of the payload read).  Fails where the
    bytes don't have the digest that they are stored under.
    """
    stored = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    checked = stored.select(
        F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest"))
        .otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
        .alias("digest"),
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
    )
    records = spark.read.schema("header string, digest string").parquet(f"{path}/records")
    field = lambda name, value: F.regexp_extract("header", f"(?m)^{name}: {value}\r?$", 1)
    return records.join(checked, "digest").select(
        field("WARC-Record-ID", "<urn:page:(.*)>").try_cast(id_type).alias("page_id"),
        field("WARC-Target-URI", "(.*)").alias("url"),
        field("WARC-Type", "(.*)").alias("record_type"),
        F.nullif(field("WARC-Refers-To", "<urn:page:(.*)>"), F.lit("")).try_cast(id_type).alias("refers_to"),
        "header",
        "payload",
        "payload_bytes",
        "payload_digest",
    )


def original_records(archive: DataFrame) -> DataFrame:
    """(page_id, record): header, block and record end as bytes; a revisit has an empty block."""
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return archive.select("page_id", F.concat(F.col("header").cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record"))
