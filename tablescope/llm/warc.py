"""A content-addressed WARC archive.

``write_archive`` makes one WARC record per row. Payload bytes are stored once
per content address (SHA-256) in ``payloads/``; the records' exact header bytes
are kept in ``headers/`` with the address of their payload. ``read_records``
parses the headers again and joins them to facts recomputed from the stored
payloads (an address that does not match its bytes raises an error), and
``reconstruct`` joins header and payload back into the bytes of every record.

Of records with equal payloads of at least ``min_revisit`` bytes the one with
the largest id is the response and the others revisit it. Joins on the digest,
of which one may belong to a third of all rows, broadcast the at most ``HOT``
most frequent digests and shuffle the rest.

Edge cases: a null payload is empty; a null id sorts before all others; of rows
repeated with the same id and payload one is the response, the others revisit
it; line ends inside an URL are percent-encoded in the header; an empty table
gives an empty archive; other columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import join_hot, prepare, written

MIN_REVISIT = 1000
WARC_DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_revisit: int = MIN_REVISIT, date: str = WARC_DATE) -> None:
    """Write ``headers/`` and ``payloads/`` under ``path``."""
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    source = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                          payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    # written without the payload, so that the row numbers are fixed for all later reads
    rows = written(source.select("id", "url", "address", F.monotonically_increasing_id().alias("rid"),
                                 F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("bytes")), "warc-rows")
    groups = rows.groupBy("address").agg(F.count("*").alias("n"), F.max(F.struct("id", "rid")).alias("top"))
    groups = written(groups.select("address", "n", F.col("top.id").alias("top_id"), F.col("top.rid").alias("top_rid")),
                     "warc-groups")
    # equal payloads meet in the map tasks first, so a frequent one is sent once a task
    source.select("address", "payload").dropDuplicates(["address"]).select(
        "address", F.length("payload").cast("long").alias("bytes"), "payload").write.parquet(f"{path}/payloads")
    many = groups.where("n > 1").select("address", "top_id", "top_rid")
    known = join_hot(rows, many, "address", "left")
    revisit = (F.col("bytes") >= min_revisit) & F.col("top_rid").isNotNull() & (F.col("top_rid") != F.col("rid"))
    name = lambda i, r: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), r.cast("string"), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name(F.col("id"), F.col("rid"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            _line("WARC-Refers-To", name(F.col("top_id"), F.col("top_rid"))))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"))
    known.select("rid", "address", F.encode(header, "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def _field(name: str) -> Column:
    return F.regexp_extract(F.decode("header", "UTF-8"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The parsed headers: rid, address, id, url, record_type, refers_to, digest, content_length."""
    headers = spark.read.parquet(f"{path}/headers")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return headers.select(
        "rid", "address", number(_field("WARC-Record-ID")).alias("id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"), number(_field("WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("digest"),
        _field("Content-Length").cast("long").alias("content_length"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The headers joined to length and digest recomputed from the stored payloads, one row per record."""
    prepare(spark)
    stored = spark.read.parquet(f"{path}/payloads")
    facts = stored.select("address", F.length("payload").cast("long").alias("payload_bytes"),
                          F.when(F.sha2("payload", 256) == F.col("address"), F.sha1("payload"))
                          .otherwise(F.raise_error(F.lit("a stored payload does not match its address"))).alias("payload_digest"))
    return join_hot(read_headers(spark, path), written(facts, "warc-facts"), "address", "inner")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(rid, record): the bytes of every record, header, payload and the two line ends that close it."""
    prepare(spark)
    headers = spark.read.parquet(f"{path}/headers")
    revisit = _field("WARC-Type") == "revisit"
    end = F.lit(b"\r\n\r\n")
    empty = headers.where(revisit).select("rid", F.concat("header", end).alias("record"))
    full = join_hot(headers.where(~revisit), spark.read.parquet(f"{path}/payloads"), "address", "inner")
    return full.select("rid", F.concat("header", "payload", end).alias("record")).unionByName(empty)
