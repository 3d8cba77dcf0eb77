"""UDP payloads to IKE messages: a mapInPandas job over the IKE candidates of a packet table.

The payload chain has variable structure, so it is walked per datagram by a
small cursor; Spark filters, partitions and projects around it. A malformed
datagram yields a row with parse_errors, never an exception.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import registries as R
from ..operators.packets import on_port

TRANSFORM = "struct<type_id:int,type_name:string,value_id:int,name:string,key_length:int>"
SCHEMA = (
    "capture string, frame bigint, ts_us bigint, src string, dst string, sport int, dport int, version string, exchange string,"
    " initiator_spi string, responder_spi string, message_id bigint, is_initiator boolean, is_response boolean, encrypted boolean,"
    f" proposals array<struct<number:int,protocol_id:int,protocol:string,spi:string,transforms:array<{TRANSFORM}>>>,"
    " ke_group int, notifies array<string>, vendor_ids array<string>, lifetime_seconds bigint, auth_method string, natt boolean,"
    " fragment struct<num:int,total:int>, ke_digest string, nonce_digest string, nonce_len int, parse_errors array<string>")

# fixed values: notify types named in results
NOTIFY = {
    1: "UNSUPPORTED_CRITICAL_PAYLOAD", 4: "INVALID_IKE_SPI", 5: "INVALID_MAJOR_VERSION", 7: "INVALID_SYNTAX", 9: "INVALID_MESSAGE_ID",
    11: "INVALID_SPI", 14: "NO_PROPOSAL_CHOSEN", 17: "INVALID_KE_PAYLOAD", 24: "AUTHENTICATION_FAILED", 34: "SINGLE_PAIR_REQUIRED",
    35: "NO_ADDITIONAL_SAS", 36: "INTERNAL_ADDRESS_FAILURE", 37: "FAILED_CP_REQUIRED", 38: "TS_UNACCEPTABLE", 39: "INVALID_SELECTORS",
    16384: "INITIAL_CONTACT", 16388: "NAT_DETECTION_SOURCE_IP", 16389: "NAT_DETECTION_DESTINATION_IP", 16390: "COOKIE",
    16391: "USE_TRANSPORT_MODE", 16393: "REKEY_SA", 16404: "MULTIPLE_AUTH_SUPPORTED", 16430: "IKEV2_FRAGMENTATION_SUPPORTED",
    16431: "SIGNATURE_HASH_ALGORITHMS", 16435: "USE_PPK", 16438: "INTERMEDIATE_EXCHANGE_SUPPORTED",
}
NAMES = {1: R.ENCR, 2: R.PRF, 3: R.INTEG, 5: R.ESN}


class Cut(Exception):
    """A length field points outside its container."""


def num(b: bytes, at: int, n: int) -> int:
    if at + n > len(b):
        raise Cut(f"needs {n} bytes at {at}, has {len(b)}")
    return int.from_bytes(b[at:at + n], "big")


def attributes(b: bytes) -> dict[int, int]:
    """TV and TLV attributes by type; for a repeated type the first counts."""
    out: dict[int, int] = {}
    while len(b) >= 4:
        kind, value, used = num(b, 0, 2), num(b, 2, 2), 4
        if not kind & 0x8000:  # long form: the second field is a length
            if 4 + value > len(b):
                break
            value, used = int.from_bytes(b[4:4 + value], "big"), 4 + value
        out.setdefault(kind & 0x7FFF, value)
        b = b[used:]
    return out


def group_name(gid: int) -> str:
    return R.DH[gid][0] if gid in R.DH else f"GROUP_{gid}"


def transform(type_id: int, value: int, name: str, key_length=None) -> dict:
    return {"type_id": type_id, "type_name": R.TRANSFORM_TYPES.get(type_id, f"TYPE_{type_id}"), "value_id": value, "name": name,
            "key_length": key_length}


def substructures(b: bytes, what: str, errors: list[str], stated: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(more flag, body) of a run of structures headed by flag, reserved, 16-bit length; at most the stated number."""
    for _ in itertools.repeat(None) if stated is None else range(stated):  # lengths are at least 8, so any run ends
        if len(b) < 8:
            if b:
                errors.append(f"{what}: {len(b)} bytes left over")
            return
        size = num(b, 2, 2)
        if size < 8 or size > len(b):
            errors.append(f"{what}: bad length {size}")
            return
        yield b[0], b[:size]
        b = b[size:]


def v2_transform(b: bytes) -> dict:
    type_id, value = b[4], num(b, 6, 2)
    if type_id in R.KE_TYPES:
        name = group_name(value)
    else:
        name = NAMES.get(type_id, {}).get(value, f"TYPE{type_id}_ID{value}")
    return transform(type_id, value, name, attributes(b[8:]).get(R.KEY_LENGTH_ATTR))


def v1_suite(b: bytes, row: dict) -> list[dict]:
    """An IKEv1 transform carries a whole suite as attributes."""
    a = attributes(b)
    hashed = R.V1_HASH.get(a.get(2), f"HASH_{a.get(2)}")
    row["auth_method"] = R.V1_AUTH.get(a.get(3), f"AUTH_{a.get(3)}")
    if a.get(11) == 1 and 12 in a:
        row["lifetime_seconds"] = a[12]
    if 4 in a:
        row["ke_group"] = a[4]
    return [
        transform(1, a.get(1, 0), R.V1_ENCR.get(a.get(1), f"ENCR_{a.get(1)}"), a.get(14)),
        transform(2, a.get(2, 0), f"PRF_HMAC_{hashed}"), transform(3, a.get(2, 0), f"AUTH_HMAC_{hashed}"),
        transform(4, a.get(4, 0), group_name(a.get(4, 0)))]


def proposals(b: bytes, v2: bool, row: dict) -> list[dict]:
    out = []
    for more, p in substructures(b if v2 else b[8:], "proposal", row["parse_errors"]):
        spi_end = 8 + p[6]
        parts: list[dict] = []
        for _, t in substructures(p[spi_end:], "transform", row["parse_errors"] if v2 else [], p[7]):
            parts += [v2_transform(t)] if v2 else v1_suite(t[8:], row)
        out.append({"number": p[4], "protocol_id": p[5], "protocol": R.PROTOCOLS.get(p[5], f"PROTO_{p[5]}"), "spi": p[8:spi_end].hex(),
                    "transforms": parts})
        if v2 and more == 0:
            break
    return out


def vendor(b: bytes) -> str:
    hexed = b.hex()
    for prefix, name in R.VENDOR_IDS.items():
        if hexed.startswith(prefix):
            return name
    if 3 <= len(b) <= 40 and all(32 <= c < 127 for c in b):
        return b.decode("ascii").strip()
    return "unknown:" + hexed[:16]


def add(items: list, value) -> None:
    if value not in items:
        items.append(value)


def keep_ke(row: dict, public: bytes) -> None:
    if public and row["ke_digest"] is None:
        row["ke_digest"] = hashlib.sha256(public).hexdigest()


def keep_nonce(row: dict, nonce: bytes) -> None:
    if row["nonce_len"] is None:
        row["nonce_len"] = len(nonce)
        row["nonce_digest"] = hashlib.sha256(nonce).hexdigest() if nonce else None


def on_notify(row: dict, b: bytes) -> None:
    kind = num(b, 2, 2)
    add(row["notifies"], NOTIFY.get(kind, f"NOTIFY_{kind}"))
    row["natt"] = row["natt"] or kind in (16388, 16389)


def on_v2_ke(row: dict, b: bytes) -> None:
    if len(b) >= 4:
        row["ke_group"] = num(b, 0, 2)
        keep_ke(row, b[4:])


# payload type -> what it adds to the row
V2_HANDLERS = {
    33: lambda row, b: row["proposals"].extend(proposals(b, True, row)),
    34: on_v2_ke,
    40: keep_nonce,
    41: lambda row, b: on_notify(row, b) if len(b) >= 4 else None,
    43: lambda row, b: add(row["vendor_ids"], vendor(b)),
}
V1_HANDLERS = {
    1: lambda row, b: row["proposals"].extend(proposals(b, False, row)),
    4: keep_ke,
    10: keep_nonce,
    13: lambda row, b: add(row["vendor_ids"], vendor(b)),
}
SK, SKF = 46, 53


def walk(body: bytes, kind: int, v2: bool, row: dict) -> None:
    """Follow the payload chain; encrypted IKEv2 payloads end it."""
    handlers = V2_HANDLERS if v2 else V1_HANDLERS
    while kind != 0 and len(body) >= 4:  # every payload takes 4 bytes or more
        size = num(body, 2, 2)
        if size < 4 or size > len(body):
            row["parse_errors"].append(f"payload {R.PAYLOADS_V2.get(kind, kind) if v2 else kind}: bad length {size}")
            return
        inner = body[4:size]
        if v2 and kind in (SK, SKF):
            row["encrypted"] = True
            if kind == SKF and len(inner) >= 4:
                row["fragment"] = {"num": num(inner, 0, 2), "total": num(inner, 2, 2)}
            return
        if kind in handlers:
            handlers[kind](row, inner)
        kind, body = body[0], body[size:]


def parse(p) -> dict | None:
    """One datagram to a row, None when it is not IKE."""
    data = bytes(p.payload or b"")
    natt = 4500 in (p.sport, p.dport)
    if natt:
        if data[:4] != b"\0\0\0\0":
            return None
        data = data[4:]
    if len(data) < 28:
        return None
    version, exchange, flags, size = data[17], data[18], data[19], num(data, 24, 4)
    v2 = version == 0x20
    known = R.EXCHANGES_V2 if v2 else R.EXCHANGES_V1
    if version not in (0x10, 0x20) or not 28 <= size <= 0x40000 or not any(data[:8]) or (v2 and exchange not in known):
        return None
    answered = any(data[8:16])
    row = {
        "capture": p.capture, "frame": p.frame, "ts_us": p.ts_us, "src": p.src, "dst": p.dst, "sport": p.sport, "dport": p.dport,
        "version": "IKEv2" if v2 else "IKEv1", "exchange": known.get(exchange, f"EXCHANGE_{exchange}"),
        "initiator_spi": data[:8].hex(), "responder_spi": data[8:16].hex(), "message_id": num(data, 20, 4),
        "is_initiator": bool(flags & 0x08) if v2 else not answered, "is_response": bool(flags & 0x20) if v2 else answered,
        "encrypted": not v2 and bool(flags & 0x01), "proposals": [], "ke_group": None, "notifies": [], "vendor_ids": [],
        "lifetime_seconds": None, "auth_method": None, "natt": natt, "fragment": None, "ke_digest": None, "nonce_digest": None,
        "nonce_len": None, "parse_errors": ["snaplen-truncated frame"] if p.truncated else []}
    if row["encrypted"]:
        return row
    try:
        walk(data[28:min(size, len(data))], data[16], v2, row)
    except (Cut, IndexError) as e:
        row["parse_errors"].append(f"payload walk ended: {e}")
    return row


def decode_ike(packets: DataFrame) -> DataFrame:
    """IKE messages of a packet table; only UDP 500/4500 rows reach Python."""

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for r in (parse(p) for p in batch.itertuples(index=False)) if r is not None]
            if rows:
                out = pd.DataFrame(rows)
                for c in ("ke_group", "lifetime_seconds", "nonce_len"):
                    out[c] = out[c].astype("Int64")
                yield out

    candidates = packets.where((F.col("protocol") == 17) & (on_port(500) | on_port(4500))).select(
        "capture", "frame", "ts_us", "src", "dst", F.col("sport").cast("int"), F.col("dport").cast("int"), "payload", "truncated")
    return candidates.mapInPandas(job, SCHEMA)
