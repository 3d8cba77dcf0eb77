"""SQL names for the library's expressions, inlined by Catalyst, and two table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# name(args) -> type, body
FUNCTIONS = {
    "cipher_len(inner_len BIGINT, block INT, iv INT, icv INT) RETURNS BIGINT":
        "cast(iv + ceil((inner_len + 2) / greatest(block, 4)) * greatest(block, 4) + icv AS BIGINT)",
    "pair_key(a STRING, b STRING) RETURNS STRING": "array_join(array_sort(array(a, b)), '|')",
    "mosca_gap(secrecy DOUBLE, migration DOUBLE, crqc DOUBLE) RETURNS DOUBLE": "(secrecy + migration) - crqc",
    "strength_grade(bits INT) RETURNS STRING":
        "CASE WHEN bits >= 192 THEN 'excellent' WHEN bits >= 128 THEN 'adequate' WHEN bits >= 112 THEN 'minimum'"
        " WHEN bits >= 80 THEN 'deprecated' ELSE 'broken' END",
    "nist_level(bits INT) RETURNS INT": "CASE WHEN bits >= 256 THEN 5 WHEN bits >= 192 THEN 3 WHEN bits >= 128 THEN 1 ELSE 0 END",
}


class HexRows:
    """LATERAL hex_rows(payload): offset, hex and ASCII of each 16 bytes."""

    def eval(self, data: bytes):
        data = bytes(data or b"")
        for at in range(0, len(data), 16):
            piece = data[at:at + 16]
            yield at, piece.hex(" "), "".join(chr(c) if 32 <= c < 127 else "." for c in piece)


class IkeTransforms:
    """LATERAL ike_transforms(payload): transforms of every proposal of one IKE datagram."""

    def eval(self, data: bytes):
        from types import SimpleNamespace

        from ..sources.ike import parse

        row = parse(SimpleNamespace(capture="", frame=0, ts_us=0, src="", dst="", sport=500, dport=500, payload=data, truncated=False))
        for p in (row or {"proposals": []})["proposals"]:
            for t in p["transforms"]:
                yield p["number"], t["type_id"], t["type_name"], t["value_id"], t["name"], t["key_length"]


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("hex_rows", udtf(HexRows, returnType="offset int, hex string, ascii string"))
    spark.udtf.register("ike_transforms", udtf(
        IkeTransforms, returnType="number int, type_id int, type_name string, value_id int, name string, key_length int"))
