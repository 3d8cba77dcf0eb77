import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from veilgauge.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [(1, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (3, "http://c/\r\n%", None), (4, None, ""), (5, "http://d/", "x" * 200_000), (None, "http://e/", "<p>é</p>"),
        (2, "http://b/", "<p>é</p>"), (2, "http://z/", "<p>é</p>"), (6, "http://f/", "line\r\n\r\nWARC/1.1\r\n"), (7, "", "empty url"), (8, "http://g/é%0A", "\r\n\r\n")]


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def archive(spark, rows, tmp_path, **more):
    path = f"{tmp_path}/archive"
    warc.write_archive(spark.createDataFrame(rows, PAGES), path, **more)
    return path


def test_index_of_a_read_archive(spark, tmp_path):
    path = archive(spark, ROWS, tmp_path)
    got = warc.read_index(spark, path).collect()
    want = []
    for i, u, h in ROWS:
        want.append((i is not None, i, u, len((h or "").encode()), b32(h)))
    assert sorted(((r.page_id is not None, r.page_id, r.url, r.payload_bytes, r.payload_digest) for r in got), key=str) == sorted(want, key=str)
    for digest in {r.payload_digest for r in got}:
        own = [r for r in got if r.payload_digest == digest]
        answer = [r for r in own if r.record_type == "response"]
        assert len(answer) == 1 and answer[0].refers_to is None
        top = max(r.page_id for r in own if r.page_id is not None)
        assert answer[0].page_id == top and all(r.refers_to == top for r in own if r.record_type == "revisit")
    assert [r.url for r in got if r.page_id == 2 and r.record_type == "response"] == ["http://z/"]
    assert spark.read.parquet(f"{path}/payloads").count() == len({r.payload_digest for r in got})


def test_records_come_back_byte_for_byte(spark, tmp_path):
    path = archive(spark, ROWS, tmp_path)
    for r in warc.restore(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = rest[:int(fields["Content-Length"])]
        assert rest[len(body):] == b"\r\n\r\n" and fields["WARC-Type"] == r.record_type
        http, _, payload = body.partition(b"\r\n\r\n")
        assert payload == (bytes(r.payload) if r.record_type == "response" else b"")
        assert f"Content-Length: {len(r.payload)}".encode() in http
        assert base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() == fields["WARC-Payload-Digest"].removeprefix("sha1:")


def test_small_payloads_are_all_responses(spark, tmp_path):
    got = warc.read_index(spark, archive(spark, ROWS, tmp_path, min_bytes=20)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_a_changed_payload_fails_the_read(spark, tmp_path):
    path = archive(spark, ROWS, tmp_path)
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{tmp_path}/changed/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/changed/headers")
    with pytest.raises(Exception, match="does not match"):
        warc.read_index(spark, f"{tmp_path}/changed").collect()


def test_missing_payload_fails_the_read(spark, tmp_path):
    path = archive(spark, ROWS, tmp_path)
    spark.read.parquet(f"{path}/payloads").limit(1).write.parquet(f"{tmp_path}/part/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/part/headers")
    with pytest.raises(Exception, match="missing or differs"):
        warc.read_index(spark, f"{tmp_path}/part").collect()


def test_no_pages_and_extra_columns(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc.archive_pages(empty).count() == 0
    more = spark.createDataFrame(ROWS, PAGES).withColumn("payload", F.lit(1)).withColumn("sha256", F.lit(2)).withColumn("n", F.lit(3))
    assert warc.archive_pages(more).count() == len(ROWS)


def test_a_payload_is_hashed_once(spark):
    df = spark.createDataFrame([(r[2] or "",) for r in ROWS], "html string").select("html", warc.base32_sha1(F.col("html").cast("binary")).alias("digest"))
    assert df._jdf.queryExecution().analyzed().toString().count("sha1(") == 1
    assert all(r.digest == b32(r.html) for r in df.collect())
