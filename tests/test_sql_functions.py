"""SQL names and table functions."""

from veilgauge.functions.sql import register


def test_scalar_functions(spark):
    register(spark)
    r = spark.sql("SELECT cipher_len(40, 16, 16, 12) AS n, pair_key('b', 'a') AS k, mosca_gap(10, 3, 12) AS g, strength_grade(112) AS s, nist_level(192) AS l").first()
    assert tuple(r) == (76, "a|b", 1.0, "minimum", 3)


def test_table_functions(spark):
    from tests.test_capture import chain, header, v2_sa

    register(spark)
    first, body = chain([(33, v2_sa())])
    spark.createDataFrame([(header(body, first),)], "payload binary").createOrReplaceTempView("datagrams")
    assert [r.name for r in spark.sql("SELECT t.name FROM datagrams, LATERAL ike_transforms(payload) t").collect()] == [
        "ENCR_AES_GCM_16", "PRF_HMAC_SHA2_512", "Curve25519", "ML-KEM-768"]
    rows = spark.sql("SELECT * FROM hex_rows(cast('0123456789abcdefZ' AS binary))").collect()
    assert [(r.offset, r.ascii) for r in rows] == [(0, "0123456789abcdef"), (16, "Z")]
