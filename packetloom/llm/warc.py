"""Content-addressed WARC archive.

An archive is a folder of two Parquet tables: `payloads` (sha256, payload) holds each distinct payload once;
`records` holds the exact header block of every record, and the digest of its block (null where it has none). The original bytes of
a record are header block + block + CRLF CRLF, put together by a join on the digest. Digests are SHA-256,
recomputed from the stored bytes when an archive is read; a payload that does not match fails the read, as does one that is missing.
What is read comes from reconstructed records: lengths and digests from their bytes, types and references from their headers, and a revisit finds
the record that it refers to by that record's id. `read_warc` takes ordinary .warc files apart into records, `add_records` stores those unchanged.

A record's id is made from its page_id and payload, so repeated rows of a page with one payload are one record, written as often as they come.

Defined cases: a null html is an empty payload; a null url gives the target `about:blank`; of repeated rows of a
page all are responses when they hold the smallest page_id of their payload (they are alike); a null page_id
sorts before all others. A very long html is one value in one row, of 2 GB at most. Empty tables make an empty archive. Further columns are not
read.

Payloads are shuffled twice, once when an archive is written and once when its records are put together. Each shuffle's files are removed as soon as
its job is done, so that disk holds one of them at a time, whenever the driver's garbage collector may run.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, shared_dir

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
RECORD = "page_id long, header binary, sha256 string"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes within remove their shuffle files when they end, not when the driver's garbage collector finds them unused."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def base32_sha1(payload: Column) -> Column:
    """Bare base32 SHA-1: eight pieces of 20 bits, four letters each."""
    digits = F.sha1(payload)
    pieces = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*pieces), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(page_id: Column, sha256: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), sha256))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _header(date: str) -> Column:
    """Header block of a record, up to and with the empty line."""
    revisit = F.col("record_type") == "revisit"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("sha256"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit("about:blank"))),
        F.when(revisit, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisit, line("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("sha256")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per page. Of equal payloads of min_bytes or more the smallest page_id is the response, others revisit it."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    facts = pages.select(
        "page_id", "url", F.sha2(payload, 256).alias("sha256"), base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("payload_bytes")
    )
    first = (
        facts.groupBy("sha256")
        .agg(F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id")).alias("first"))
        .select(F.col("sha256").alias("__sha256"), F.col("first.page_id").alias("__first"))
    )
    joined = facts.join(first, F.col("sha256") == F.col("__sha256"))
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("__first"))
    records = joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn(
        "refers_to", F.when(revisit, F.col("__first"))
    )
    block = F.when(F.col("record_type") == "response", F.col("sha256"))
    headers = records.select("page_id", F.encode(_header(date), "UTF-8").alias("header"), block.alias("sha256"))
    # Payloads move once: the bytes are joined to the first page of each digest, where equal rows of it are merged.
    key = F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))
    keys = first.select(F.coalesce(F.col("__first"), F.lit(-(1 << 63))).alias("__of"), "__sha256")
    stored = pages.select(key.alias("__key"), payload.alias("payload")).join(keys, (F.col("__key") == F.col("__of")) & (F.sha2("payload", 256) == F.col("__sha256")))
    unique = stored.dropDuplicates(["__of", "__sha256"]).select(F.col("__sha256").alias("sha256"), "payload")
    with _shuffles_freed(pages.sparkSession):
        headers.write.parquet(f"{path}/records")
        unique.write.option("compression", "zstd").parquet(f"{path}/payloads")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads with verified digests: (sha256, payload)."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256")))
    return stored.select(F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(wrong.cast("string")).alias("sha256"), "payload")


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).parquet(f"{path}/records")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The bytes of every record as written: (page_id, header_bytes, record)."""
    stored = payloads(spark, path).select(F.col("sha256").alias("__sha256"), "payload")
    joined = records(spark, path).join(stored, F.col("sha256") == F.col("__sha256"), "left")
    missing = F.raise_error(F.concat(F.lit("no payload for the digest "), F.col("sha256"))).cast("binary")
    block = F.when(F.col("sha256").isNull(), F.lit(b"")).when(F.col("payload").isNull(), missing).otherwise(F.col("payload"))
    return joined.select("page_id", F.octet_length("header").alias("header_bytes"), F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")).alias("record"))


def _field(header: Column, name: str) -> Column:
    """Value of a header line; null without one."""
    return F.nullif(F.regexp_extract(header, rf"\r\n{name}:[ \t]*([^\r]*)", 1), F.lit(""))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of every record: page_id, payload_bytes, payload_digest, record_type and refers_to (the response's page_id)."""
    whole = reconstruct(spark, path)
    header = F.decode(F.substring(F.col("record"), F.lit(1), F.col("header_bytes")), "UTF-8")
    length = F.octet_length("record") - F.col("header_bytes") - 4
    block = F.substring(F.col("record"), F.col("header_bytes") + 1, length)
    parsed = whole.select(
        "page_id",
        _field(header, "WARC-Record-ID").alias("id"),
        _field(header, "WARC-Type").alias("kind"),
        _field(header, "WARC-Refers-To").alias("of"),
        _field(header, "WARC-Payload-Digest").alias("said"),
        (_field(header, "Content-Length").cast("long") == length).alias("whole"),
        length.cast("long").alias("bytes"),
        base32_sha1(block).alias("digest"),
    )
    with _shuffles_freed(spark):
        parsed = cut(parsed, "warc_read")
    first = parsed.where(F.col("kind") == "response").groupBy(F.col("id").alias("first_id")).agg(F.first("page_id").alias("first_page"), F.first("bytes").alias("first_bytes"), F.first("digest").alias("first_digest"))
    with _shuffles_freed(spark):
        first = cut(first, "warc_first")  # so that the join can split a record that very many refer to
    revisit = F.col("kind") == "revisit"
    joined = parsed.join(first, F.col("of") == F.col("first_id"), "left")
    digest = F.when(revisit, F.col("first_digest")).otherwise(F.col("digest"))
    wrong = F.raise_error(F.concat(F.lit("a record does not match its header: "), F.col("id"))).cast("string")
    right = F.col("whole") & (F.col("said") == F.concat(F.lit("sha1:"), digest))
    return joined.select(
        "page_id",
        F.when(revisit, F.col("first_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(right, digest).otherwise(wrong).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, F.col("first_page")).alias("refers_to"),
    )


def new_archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"


# --- ordinary WARC files ---------------------------------------------------------------------------------

_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)", re.I)


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header block, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        found = _LENGTH.search(data, at, end + 2) if end >= 0 else None
        if not data.startswith(b"WARC/", at) or not found:
            raise ValueError(f"no WARC record at byte {at}")
        start = end + 4
        stop = start + int(found[1])
        if stop > len(data) or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield data[at:start], data[start:stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (file, at, header, payload) of .warc files, one file at a time in a task."""

    def parts(batches):
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for k, (header, body) in enumerate(split_records(data)):
                    yield pa.RecordBatch.from_pydict({"file": [name], "at": [k], "header": [header], "payload": [body]}, schema=out)

    import pyarrow as pa

    out = pa.schema([("file", pa.string()), ("at", pa.int64()), ("header", pa.binary()), ("payload", pa.binary())])
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("at", T.LongType()), T.StructField("header", T.BinaryType()), T.StructField("payload", T.BinaryType())])
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parts, schema)


def add_records(rows: DataFrame, path: str) -> None:
    """Store records (page_id, header, payload) unchanged: headers apart, each payload once."""
    keyed = rows.withColumn("sha256", F.sha2(F.coalesce(F.col("payload"), F.lit(b"")), 256))
    unique = keyed.select("sha256", F.coalesce(F.col("payload"), F.lit(b"")).alias("payload")).dropDuplicates(["sha256"])
    with _shuffles_freed(rows.sparkSession):
        keyed.select("page_id", "header", "sha256").write.parquet(f"{path}/records")
        unique.write.parquet(f"{path}/payloads")
