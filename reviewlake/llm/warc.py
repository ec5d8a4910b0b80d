"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256 digest. Record headers are
stored exactly as written, apart from them, with the digest. Reading verifies
the stored bytes against their digests and puts the original records together
again by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.registry import query, table
from reviewlake.scale import HEAVY_KEYS, lookup, work_folder

VERSION = "WARC/1.1"
# The record type for a payload that is stored with another record.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2024-01-01T00:00:00Z"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EOL = "\r\n"
# Records of one payload that are joined with one copy of it.
RECORDS_PER_COPY = 256


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of bytes in base32 without prefix: 20 bits make four of its 32 digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def _payload(html: Column) -> Column:
    return F.coalesce(F.encode(html, "UTF-8"), F.to_binary(F.lit(""), F.lit("hex")))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line; none for a null value. Line ends in a value are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(_EOL)), F.lit(""))


def write_archive(pages: DataFrame, folder: str) -> None:
    """Write ``folder/payloads`` and ``folder/records`` for ``pages (page_id, url, html)``.

    Of records with equal payloads the one with the largest page_id is the
    response, the others are revisits of it; rows that repeat the response's
    page_id and payload are responses too. A null html is an empty payload, a
    null url gives no target line, null page ids count as smallest.
    """
    captured = pages.select("page_id", "url", _payload(F.col("html")).alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    # Partial aggregation leaves one row per payload and task, however often it occurs.
    stored = captured.groupBy("digest").agg(
        F.max("page_id").alias("response"), F.count("*").alias("records"), F.first("payload").alias("payload")
    )
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    spark = pages.sparkSession
    owners = spark.read.parquet(f"{folder}/payloads").select("digest", "response", "records")
    facts = captured.select(
        "page_id", "url", "digest", F.octet_length("payload").alias("size"), base32_sha1(F.col("payload")).alias("sha1")
    )
    first = F.col("page_id").eqNullSafe(F.col("response"))
    header = F.concat(
        F.lit(VERSION + _EOL),
        _line("WARC-Type", F.when(first, "response").otherwise("revisit")),
        _line("WARC-Record-ID", _name(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Date", F.lit(CAPTURED)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Profile", F.when(~first, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(~first, _name(F.col("response")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.col("size").cast("string")),
        F.lit(_EOL),
    )
    owned = lookup(facts, owners, ["digest"], "records", "page_id", how="inner")
    records = owned.select("page_id", F.encode(header, "UTF-8").alias("header"), "digest")
    records.write.option("compression", "zstd").parquet(f"{folder}/records")


def verified_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``digest, payload``; bytes that do not match their digest fail."""
    payloads = spark.read.parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), "digest"))
    payload = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary"))
    return payloads.select("digest", payload.alias("payload"))


def _rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, header, record``: headers joined with their payloads.

    A payload of many records is dealt out in as many copies as keep a copy's records
    few; the number is looked up for the most frequent payloads, and is one for others.
    """
    records = spark.read.parquet(f"{folder}/records")
    frequent = records.groupBy("digest").agg(F.count("*").alias("records"))
    frequent = frequent.orderBy(F.desc("records"), "digest").limit(HEAVY_KEYS)
    copies = F.broadcast(frequent.select("digest", F.ceil(F.col("records") / RECORDS_PER_COPY).alias("copies")))
    one = F.coalesce("copies", F.lit(1))
    dealt = records.join(copies, "digest", "left").withColumn("copy", F.pmod(F.xxhash64("header"), one))
    stored = verified_payloads(spark, folder).join(copies, "digest", "left")
    stored = stored.select("digest", "payload", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)).alias("copy"))
    tail = F.encode(F.lit(_EOL * 2), "UTF-8")
    whole = dealt.join(stored, ["digest", "copy"])
    return whole.select("page_id", "header", F.concat("header", "payload", tail).alias("record"))


def restore_records(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, record``: the bytes of every record with its payload, as captured."""
    return _rebuilt(spark, folder).select("page_id", "record")


def header_field(header: Column, name: str) -> Column:
    """The value of a header line, null without one."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """What the rebuilt records say: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    The payload is cut out of the record between its header and its end marks; it has
    to have the length and digest of the header. Repeated rows stay; an empty archive
    has no rows.
    """
    refers = F.regexp_extract(header_field(F.col("header"), "WARC-Refers-To"), r"^<urn:x-page:(-?\d+)>$", 1)
    begin, marks = F.octet_length("header"), len(_EOL * 2)
    payload = F.substring("record", begin + 1, F.octet_length("record") - begin - marks)
    facts = _rebuilt(spark, folder).select(
        "page_id",
        "header",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )
    agrees = (header_field(F.col("header"), "Content-Length").cast("long") == F.col("payload_bytes")) & (
        header_field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest")
    )
    wrong = F.raise_error(F.concat(F.lit("header and payload differ in record "), F.col("page_id").cast("string")))
    kind = F.when(agrees, header_field(F.col("header"), "WARC-Type")).otherwise(wrong.cast("string"))
    return facts.select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        kind.alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )


@query(
    """
    WITH digests AS (
        SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h,
               max(page_id) OVER (PARTITION BY coalesce(html, '')) AS newest
        FROM pages
    ), parts AS (
        SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 1 + 5 * i::INT, 5))::BIGINT) AS v FROM digests
    )
    SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
           list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((v[1 + (j // 4)] >> (15 - 5 * (j % 4))::BIGINT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> newest THEN newest END AS refers_to
    FROM parts
    """
)
def op4_warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    archive = work_folder(spark)
    write_archive(table(spark, folder, "pages"), archive)
    return read_archive(spark, archive)
