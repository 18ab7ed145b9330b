"""Content-addressed web archive: payloads once by digest, record headers apart, records by joins.

All on DataFrame functions; payload bytes stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import only

END = "\r\n"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal SHA-1, without padding (160 bits are 32 digits).

    Ten hexadecimal digits are eight base32 digits; conv counts to base 32 with 0-9A-V.
    """
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """One header line; nothing for NULL. Line ends inside the value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END)), F.lit(""))


def write_archive(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC/1.1 record per row of `pages` under `path`, in two tables.

    payloads: sha256, n_bytes, payload; every distinct payload once.
    headers: sha256, head (exact bytes of the WARC header and the HTTP header), tail.

    Among records with equal payloads of at least `min_bytes` bytes the one with the
    smallest page id (ties: the first row) is a response and the others are revisits
    that refer to it; all smaller ones are responses. Payloads are equal when SHA-256
    and length agree. NULL html is an empty payload, a NULL url leaves out its header,
    NULL page ids come after all others and are written as an empty id.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = only(pages, page_id=F.col(page).cast("long"), url=F.col(url), html=F.col(html))
    # Digests first: what is compared and joined below are some hundred bytes a page.
    (
        rows.select(
            "page_id",
            "url",
            F.monotonically_increasing_id().alias("row"),
            F.sha2(payload, 256).alias("sha256"),
            F.sha1(payload).alias("sha1"),
            F.octet_length(payload).cast("long").alias("n_bytes"),
        ).write.parquet(f"{path}/digests")
    )
    digests = spark.read.parquet(f"{path}/digests")
    order = F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("id"), F.col("row").alias("row"))
    # Partial aggregation bounds a payload shared by any number of pages to one row a task.
    firsts = digests.groupBy("sha256", "n_bytes").agg(
        F.min(order).alias("first"), F.min_by("url", order).alias("first_url")
    )
    records = digests.join(firsts, ["sha256", "n_bytes"])
    first = F.col("first.row") == F.col("row")
    response = first | (F.col("n_bytes") < min_bytes)
    target = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(END + END),
    )
    block = F.octet_length("http") + F.when(F.col("response"), F.col("n_bytes")).otherwise(0)
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(F.col("response"), F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", target(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _line("WARC-Profile", F.when(~F.col("response"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(~F.col("response"), target(F.col("first.id")))),
        _line("WARC-Refers-To-Target-URI", F.when(~F.col("response"), F.col("first_url"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")),
        F.lit(END),
        F.col("http"),
    )
    records = records.select("*", response.alias("response"), http.alias("http"))
    (
        records.select("sha256", "n_bytes", F.encode(head, "UTF-8").alias("head"), F.lit(END + END).cast("binary").alias("tail"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/headers")
    )
    # A payload goes from its first row alone: found by page id and digest, so copies never move.
    chosen = firsts.select(F.col("first.id").alias("own"), F.col("sha256").alias("address"))
    sources = rows.select("page_id", F.sha2(payload, 256).alias("sha256"), payload.alias("payload")).join(
        chosen, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("sha256") == F.col("address")), "left_semi"
    )
    # Only where a first page id stands in several rows of equal payload are there several sources of one.
    if digests.groupBy("page_id", "sha256").count().where("count > 1").limit(1).count():
        sources = sources.dropDuplicates(["sha256"])
    (
        sources.select("sha256", F.octet_length("payload").cast("long").alias("n_bytes"), "payload")
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: every header field that the operator wrote, and the payload's place.

    Columns page_id, record_type, refers_to (page id or NULL), url, payload_digest (base32
    SHA-1 as in the header), sha256, n_bytes, head, tail.
    """
    # The record's own header ends at the first empty line; (?d) leaves \n as the only line end a pattern sees.
    text = F.substring_index(F.decode("head", "UTF-8"), END + END, 1)
    line = lambda name: rf"(?dm)^{name}: ([^\r\n]*)\r?$"
    field = lambda name: F.when(text.rlike(line(name)), F.regexp_extract(text, line(name), 1))
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    return spark.read.parquet(f"{path}/headers").select(
        number(field("WARC-Record-ID")).alias("page_id"),
        field("WARC-Type").alias("record_type"),
        number(F.coalesce(field("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        "sha256",
        "n_bytes",
        "head",
        "tail",
    )


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Every payload, stored once, with both digests computed anew where it lies; a stored payload that does not match its address fails the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    intact = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("n_bytes"))
    return stored.select(
        F.when(intact, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))).alias("sha256"),
        "payload",
        base32(F.sha1("payload")).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """Every record byte for byte: page_id, record (header, payload of responses, two line ends)."""
    found = read_archive(spark, path).join(verified_payloads(spark, path).drop("payload_digest"), "sha256", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return found.select("page_id", "record_type", F.concat("head", body, "tail").alias("record"))


def round_trip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write the archive, read it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest come from the payload that the record's header leads to; the
    digest in the header must be the same, otherwise the job fails.
    """
    write_archive(pages, path, min_bytes=min_bytes)
    spark = pages.sparkSession
    heads = read_archive(spark, path).drop("head", "tail", "n_bytes", "url").withColumnRenamed("payload_digest", "stated")
    found = heads.join(verified_payloads(spark, path).drop("payload"), "sha256", "left")
    same = F.col("stated").eqNullSafe(F.col("payload_digest"))
    return found.select(
        "page_id",
        "payload_bytes",
        F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("header and payload differ"))).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
