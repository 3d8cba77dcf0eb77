"""WARC archive with content addressing, in DataFrame expressions only.

Two tables: `headers` keeps the exact header block of every record, `payloads`
every distinct payload once under its SHA-256, in buckets of it, so that the
join which gives back the original records byte for byte moves headers only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import forget, new_folder, written

# Fixed value: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload that a bucket is meant to hold, and the least number of buckets.
BUCKET_BYTES, BUCKETS = 1 << 27, 8
#: Copies of a record that are numbered by one array.
PIECE = 1 << 12
#: Fixed capture date: records depend on the rows alone, so a rewritten archive is the same.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary as 32 characters: eight groups of five hex digits give four characters each."""
    alphabet, starts = F.lit(BASE32), F.array(*[F.lit(i) for i in range(1, 37, 5)])

    def letters(bits: Column) -> Column:
        return F.concat(*[F.substring(alphabet, F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    def encoded(digest: Column) -> Column:
        numbers = F.transform(starts, lambda i: F.conv(F.substring(digest, i, F.lit(5)), 16, 10).cast("int"))
        return F.concat_ws("", F.transform(numbers, letters))

    # a lambda binds its value once: the payload is hashed once, each group of digits converted once
    return F.get(F.transform(F.array(F.sha1(payload)), encoded), F.lit(0))


def _records(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    named = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    known = F.concat_ws(" ", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("page_id", "url")])
    return named.withColumns({"sha256": F.unhex(F.sha2("payload", 256)), "row_key": known})


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Write one record per row under `path`; payloads of `min_bytes` bytes or more are stored once.

    Of the records of one payload that with the largest page_id is the response
    and keeps the bytes; the others are revisits that refer to it. Smaller
    payloads are all responses, their bytes are still stored once. A null page
    id is less than any other; of rows with one page_id and payload, that with
    the largest url responds, and of fully equal rows one. A null html is an
    empty payload. Extra columns are not archived. An empty table gives an
    empty archive. Digests are verified: two payloads of one SHA-256 must agree
    in SHA-1 and length, else the write fails.
    """
    records = _records(pages, page_id, url, html)
    slim = records.select("page_id", "url", "row_key", "sha256", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("digest"))
    # Equal records are counted, then one winner per payload is found from one row per (payload, task) at most.
    each = slim.groupBy("page_id", "url", "row_key", "sha256", "bytes", "digest").agg(F.count(F.lit(1)).alias("n"))
    best = slim.groupBy("sha256").agg(
        F.max(F.struct("page_id", "url", "row_key")).alias("best"), F.max("bytes").alias("bytes"),
        F.min("bytes").alias("bytes_low"), F.max("bytes").alias("bytes_high"), F.min("digest").alias("digest_low"), F.max("digest").alias("digest_high"))
    clash = (F.col("bytes_low") != F.col("bytes_high")) | (F.col("digest_low") != F.col("digest_high"))
    # Written, as it is read twice; and so that a payload with very many records is split in the join by size.
    best = written(best.select(
        F.when(clash, F.raise_error(F.lit("two payloads share a SHA-256")).cast("binary")).otherwise(F.col("sha256")).alias("_sha"),
        F.col("best.page_id").alias("_answer"), F.col("best.row_key").alias("_key"), F.col("bytes").alias("_size")), "warc-winners")
    joined = each.join(best, F.col("sha256") == F.col("_sha")).select(
        "page_id", "url", "sha256", "bytes", "digest", F.col("_answer").alias("answer"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(PIECE).cast("long"))).alias("piece"), "n", (F.col("row_key") == F.col("_key")).alias("is_best"))
    joined = joined.withColumn("copy", F.explode(F.sequence(F.col("piece"), F.least(F.col("piece") + PIECE - 1, F.col("n")))))
    keeps = F.col("is_best") & (F.col("copy") == 1)
    typed = joined.withColumns({"keeps": keeps, "type": F.when(keeps | (F.col("bytes") < min_bytes), "response").otherwise("revisit")})
    typed.select(_header().alias("header"), "sha256", "keeps").write.parquet(f"{path}/headers")
    # Equal payloads are one row per task before they move; they move once, straight to their buckets.
    total = best.agg(F.sum("_size")).first()[0] or 0
    spread = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(BUCKETS, -(-total // BUCKET_BYTES))
    buckets = min([k for k in range(1, spread + 1) if spread % k == 0 and k >= wanted], default=spread)
    name = _table_name(path)
    records.select("sha256", "payload").dropDuplicates(["sha256"]).write.bucketBy(buckets, "sha256").format("parquet").option("path", f"{path}/payloads").saveAsTable(name)
    pages.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/layout")
    forget(best)


def _table_name(path: str) -> str:
    return "warc_payloads_" + hashlib.md5(path.encode()).hexdigest()


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The payload table; its buckets are made known to a session that has not written it. Without `layout` it is read as plain files."""
    layout = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layout")
    if not layout.getFileSystem(spark._jsc.hadoopConfiguration()).exists(layout):
        return spark.read.schema("sha256 binary, payload binary").parquet(f"{path}/payloads")
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        buckets = spark.read.schema("buckets int").json(f"{path}/layout").first()["buckets"]
        spark.sql(f"CREATE TABLE {name} (sha256 BINARY, payload BINARY) USING parquet CLUSTERED BY (sha256) INTO {buckets} BUCKETS LOCATION '{path}/payloads'")
    return spark.table(name)


def _uuid(*parts: Column) -> Column:
    """A record id that depends on the record alone."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header() -> Column:
    """Exact header block of a record, its HTTP header included, up to where the payload begins."""
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    # line breaks and percent signs cannot stand in a header line as they are
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("url"), "%", "%25"), "\r", "%0D"), "\n", "%0A")
    body = F.octet_length(http) + F.when(F.col("type") == "response", F.col("bytes")).otherwise(0)
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.col("type")),
             F.concat(F.lit("WARC-Record-ID: "), _uuid(F.lit("record"), F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))),
             F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), target),
             F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
             F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
             F.when(F.col("type") == "revisit", F.lit(f"WARC-Profile: {REVISIT}")),
             F.when(F.col("type") == "revisit", F.concat(F.lit("X-Refers-To-Page-ID: "), F.col("answer").cast("string"))),
             F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), body.cast("string"))]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), http).cast("binary")  # concat_ws leaves out nulls


def _field(header: Column, name: str) -> Column:
    """A field of a header block; null where the block does not have it, empty where it is empty."""
    return F.when(header.contains(f"{CRLF}{name}: "), F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1))


def _fields(block: Column) -> dict[str, Column]:
    """Typed fields of the bytes of a header block."""
    header = F.decode(block, "UTF-8")
    url = F.regexp_replace(F.regexp_replace(F.regexp_replace(_field(header, "WARC-Target-URI"), "%0D", "\r"), "%0A", "\n"), "%25", "%")
    return {"page_id": _field(header, "X-Page-ID").cast("long"), "record_type": _field(header, "WARC-Type"),
            "payload_digest": F.regexp_replace(_field(header, "WARC-Payload-Digest"), "^sha1:", ""),
            "refers_to": _field(header, "X-Refers-To-Page-ID").cast("long"), "url": url}


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The header table with its fields parsed from the stored bytes; `keeps` marks the one record of a payload that it was stored for."""
    return spark.read.schema("header binary, sha256 binary, keeps boolean").parquet(f"{path}/headers").select("header", "sha256", "keeps", *[c.alias(n) for n, c in _fields(F.col("header")).items()])


def _record(body: Column) -> Column:
    return F.concat(F.col("header"), body, F.lit((CRLF + CRLF).encode()))


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Every record byte for byte (`record`), joined from header and payload; revisits carry no payload bytes in theirs.

    `payload` is the full content, for revisits that of the record they refer to.
    """
    full = headers(spark, path).join(payloads(spark, path), "sha256")
    return full.withColumn("record", _record(F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, from the reconstructed records.

    The record that keeps a payload is put together from header and payload,
    and all is taken from its bytes: the header block, the HTTP header, and
    behind these the payload, whose lengths, SHA-1 and SHA-256 must be those stated,
    else the read fails. That join moves headers to the payloads' buckets, one
    for each. The other records (revisits, and small payloads' further
    responses) are their headers, and take length and digest of the payload
    from the record that keeps it: small rows, of which a payload may have any number.
    """
    stored = headers(spark, path).select("header", "sha256", "keeps")
    kept = stored.filter("keeps").select("header", "sha256").join(payloads(spark, path), "sha256", "left").withColumn("record", _record(F.col("payload")))
    text = F.decode("record", "ISO-8859-1")  # a character a byte, so that places are byte places
    kept = kept.withColumn("past", F.locate(CRLF + CRLF, text) + 4)
    kept = kept.withColumn("at", F.call_function("locate", F.lit(CRLF + CRLF), text, F.col("past")) + 4)
    block, http = F.substring(F.col("record"), F.lit(1), F.col("past") - 1), F.substring(F.col("record"), F.col("past"), F.col("at") - F.col("past"))
    block_text, http_text = F.decode(block, "UTF-8"), F.decode(http, "UTF-8")
    length = _field(block_text, "Content-Length").cast("long") - F.octet_length(http)
    kept = kept.select("sha256", "record", *[c.alias(n) for n, c in _fields(block).items()], length.alias("payload_bytes"),
                       F.substring(F.col("record"), F.col("at"), F.octet_length("record") - F.col("at") + 1 - 4).alias("body"), _field(http_text, "Content-Length").cast("long").alias("stated"),
                       (F.octet_length("record") - F.col("at") + 1 - 4).alias("there"))
    wrong = F.when(F.col("body").isNull() | (base32_sha1(F.col("body")) != F.col("payload_digest")) | (F.col("payload_bytes") != F.col("there")) | (F.col("stated") != F.col("there")),
                   F.raise_error(F.lit("a record's payload is missing or differs from its digest")).cast("string"))
    wrong = F.when(F.unhex(F.sha2("body", 256)) != F.col("sha256"), F.raise_error(F.lit("a payload does not match its SHA-256")).cast("string")).otherwise(wrong)
    result = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kept = kept.withColumn("payload_digest", F.coalesce(wrong, F.col("payload_digest"))).select("sha256", *result)
    kept = written(kept, "warc-index")  # read twice, and without payloads
    rest = headers(spark, path).filter("NOT keeps")
    of = kept.select(F.col("sha256").alias("_sha"), F.col("payload_bytes"), F.col("payload_digest").alias("_read"))
    joined = rest.join(of, F.col("sha256") == F.col("_sha"), "left")
    agreed = F.when(F.col("_read") == F.col("payload_digest"), F.col("_read")).otherwise(F.raise_error(F.lit("a record's payload is missing or differs from its digest")))
    return kept.select(*result).unionByName(joined.withColumn("payload_digest", agreed).select(*result))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write `pages` as an archive in the shared folder and read it back."""
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archive(pages, path, min_bytes=min_bytes)
    return read_index(spark, path)
