"""Capture files, header decoding and handshake decoding from bytes."""

import random
import struct

from veilgauge.operators.packets import classify, decode_headers
from veilgauge.sources.capture_lake import list_captures, read_captures
from veilgauge.sources.ike import decode_ike


def ip4(proto, body, src=b"\x0a\0\0\1", dst=b"\x0a\0\0\2", frag=0x4000):
    return b"\x45\0" + struct.pack("!HHHBBH", 20 + len(body), 0, frag, 64, proto, 0) + src + dst + body


def udp(sport, dport, body):
    return struct.pack("!HHHH", sport, dport, 8 + len(body), 0) + body


def ether(payload, tags=0, kind=b"\x08\0"):
    return b"\2" * 12 + b"\x81\0\0\x64" * tags + kind + payload


def ip6(next_header, body, ext=b""):
    return b"\x60\0\0\0" + struct.pack("!HBB", len(ext + body), next_header, 64) + bytes.fromhex("20010db8000000000000000000000001") + b"\0" * 15 + b"\1" + ext + body


def classic(frames, magic=b"\xd4\xc3\xb2\xa1", link=1):
    order = "<" if magic[0] in (0xD4, 0x4D) else ">"
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 100 + i, 500, len(f), len(f)) + f
    return out


def blocks(frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9) + b"\0\0\0\0")
    for i, f in enumerate(frames):
        t = (100 + i) * 10 ** 9 + 500_000
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def test_capture_files(spark, tmp_path):
    frames = [ether(ip4(50, b"\0\0\x10\1\0\0\0\1" + b"\xab" * 40)), ether(ip4(17, udp(4500, 4500, b"\xff")))]
    (tmp_path / "a.pcap").write_bytes(classic(frames))
    (tmp_path / "b.pcap").write_bytes(classic(frames, b"\xa1\xb2\x3c\x4d"))
    (tmp_path / "c.pcapng").write_bytes(blocks(frames))
    (tmp_path / "cut.pcap").write_bytes(classic(frames)[:-5])
    (tmp_path / "lie.pcap").write_bytes(classic([frames[0]]) + struct.pack("<IIII", 1, 1, 9_999_999, 9) + b"x" * 50)
    (tmp_path / "notes.txt").write_text("no capture")
    got = {}
    (tmp_path / "junk.pcap").write_bytes(b"no capture at all")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.pcap").write_bytes(classic(frames[:1]))
    rows = read_captures(spark, str(tmp_path)).collect()
    assert {r.capture: r.frame for r in rows if r.read_error} == {"cut.pcap": 2, "lie.pcap": 2, "junk.pcap": 1}
    for r in rows:
        if r.read_error:
            continue
        got.setdefault(r.capture, []).append((r.frame, r.ts_us, bytes(r.frame_bytes)))
    assert got["a.pcap"] == [(1, 100_000_500, frames[0]), (2, 101_000_500, frames[1])]
    assert [t for _f, t, _b in got["b.pcap"]] == [100_000_000, 101_000_000]
    assert got["c.pcapng"] == got["a.pcap"]
    assert len(got["cut.pcap"]) == 1 and len(got["lie.pcap"]) == 1
    assert len(got["sub/a.pcap"]) == 1  # the same name in another folder is another capture
    assert [r.name for r in list_captures(spark, str(tmp_path)).collect()] == ["a.pcap", "b.pcap", "c.pcapng", "cut.pcap", "junk.pcap", "lie.pcap", "sub/a.pcap"]


def decoded(spark, frames, link=1):
    df = spark.createDataFrame([("c", i, i, link, f) for i, f in enumerate(frames)], "capture string, frame bigint, ts_us bigint, linktype int, frame_bytes binary")
    return {r.frame: r for r in decode_headers(df).collect()}


def test_headers(spark):
    hop = struct.pack("!BB6x", 60, 0) + struct.pack("!BB6x", 17, 0)
    frames = [
        ether(ip4(17, udp(500, 501, b"abc") + b"pad"), tags=2), ether(ip4(50, b"x" * 12, frag=0x2001)),
        ether(ip6(0, udp(4500, 4500, b"\xff"), ext=hop), kind=b"\x86\xdd"), ether(b"\0" * 30, kind=b"\x08\x06"), b"short"]
    got = decoded(spark, frames)
    assert sorted(got) == [0, 2]
    assert (got[0].sport, got[0].dport, bytes(got[0].payload), got[0].src) == (500, 501, b"abc", "10.0.0.1")
    assert (got[2].src, got[2].dst, got[2].protocol, bytes(got[2].payload), got[2].ip_version) == ("2001:db8::1", "::1", 17, b"\xff", 6)
    assert [len(decoded(spark, [ether(ip4(50, b"y" * 16), tags=n)])) for n in (1, 3, 5)] == [1, 1, 1]
    assert decoded(spark, [ip4(50, b"y" * 16)], link=101)[0].protocol == 50
    assert decoded(spark, [b"\0" * 14 + b"\x08\0" + ip4(50, b"y" * 16)], link=113)[0].protocol == 50


# --- handshakes -------------------------------------------------------------------
def header(payload, first, version=0x20, exchange=34, flags=8, rspi=b"\0" * 8):
    return b"\1" * 8 + rspi + bytes([first, version, exchange, flags]) + b"\0" * 4 + struct.pack("!I", 28 + len(payload)) + payload


def item(kind, body):
    return kind, body


def chain(items):
    out = b""
    for i, (_k, body) in enumerate(items):
        nxt = items[i + 1][0] if i + 1 < len(items) else 0
        out += struct.pack("!BBH", nxt, 0, 4 + len(body)) + body
    return items[0][0], out


def v2_sa():
    t = [(1, 20, b"\x80\x0e\x01\x00"), (2, 7, b""), (4, 31, b""), (6, 36, b"")]
    body = b"".join(struct.pack("!BBHBBH", 0 if i == 3 else 3, 0, 8 + len(a), k, 0, v) + a for i, (k, v, a) in enumerate(t))
    return struct.pack("!BBHBBBB", 0, 0, 8 + len(body), 1, 1, 0, len(t)) + body


def v1_sa():
    attrs = b"".join(struct.pack("!HH", 0x8000 | k, v) for k, v in ((1, 5), (2, 2), (3, 1), (4, 2), (11, 1))) + struct.pack("!HHI", 12, 4, 90000)
    tr = struct.pack("!BBHBBH", 0, 0, 8 + len(attrs), 1, 1, 0) + attrs
    return struct.pack("!II", 1, 1) + struct.pack("!BBHBBBB", 0, 0, 8 + len(tr), 1, 1, 0, 1) + tr


def ike_rows(spark, payloads, port=500):
    df = spark.createDataFrame([("c", i, i, "a", "b", 17, port, port, p, False) for i, p in enumerate(payloads)],
                               "capture string, frame bigint, ts_us bigint, src string, dst string, protocol int, sport int, dport int, payload binary, truncated boolean")
    return {r.frame: r for r in decode_ike(df).collect()}, {r.frame: r.pkt_class for r in classify(df).collect()}


def test_ike_v2_and_v1(spark):
    first, body = chain([(33, v2_sa()), (34, struct.pack("!HH", 31, 0) + b"P" * 32), (40, b"N" * 16), (41, struct.pack("!BBH", 0, 0, 16430)), (43, b"strange box")])
    f1, b1 = chain([(1, v1_sa()), (13, bytes.fromhex("12f5f28c457168a9702d9fe274cc0100"))])
    skf = chain([(53, struct.pack("!HH", 2, 5) + b"secret")])
    got, classes = ike_rows(spark, [header(body, first), header(b1, f1, 0x10, 4, 0), header(skf[1], 53, exchange=35), header(b"zz", 1, 0x10, 2, 1)])
    a = got[0]
    assert [(t.type_name, t.name, t.key_length) for t in a.proposals[0].transforms] == [
        ("ENCR", "ENCR_AES_GCM_16", 256), ("PRF", "PRF_HMAC_SHA2_512", None), ("DH", "Curve25519", None), ("ADDKE1", "ML-KEM-768", None)]
    assert (a.ke_group, a.nonce_len, a.notifies, a.vendor_ids, a.parse_errors) == (31, 16, ["IKEV2_FRAGMENTATION_SUPPORTED"], ["strange box"], [])
    b = got[1]
    assert (b.version, b.exchange, b.auth_method, b.lifetime_seconds, b.ke_group, b.vendor_ids) == ("IKEv1", "Aggressive Mode", "PRE_SHARED_KEY", 90000, 2, ["Cisco Unity"])
    assert [t.name for t in b.proposals[0].transforms] == ["3DES_CBC", "PRF_HMAC_SHA1", "AUTH_HMAC_SHA1", "1024-bit MODP"]
    assert (got[2].encrypted, got[2].fragment.num, got[2].fragment.total) == (True, 2, 5)
    assert got[3].encrypted and got[3].parse_errors == []
    assert set(classes.values()) == {"ike"}


def test_ports_and_rejects(spark):
    first, body = chain([(33, v2_sa())])
    good = header(body, first)
    got, classes = ike_rows(spark, [b"\0\0\0\0" + good, good, b"\xff", b"\0\0\x10\1" + b"\0" * 8], port=4500)
    assert sorted(got) == [0] and got[0].natt
    assert classes == {0: "ike", 1: "esp_natt", 2: "keepalive", 3: "esp_natt"}
    bad = [header(body, first, 0x30), header(body, first, exchange=99), b"\0" * 8 + good[8:], good[:20]]
    got, classes = ike_rows(spark, bad)
    assert got == {} and set(classes.values()) == {"other"}


def test_mutated_bytes_never_fail(spark):
    r = random.Random(11)
    first, body = chain([(33, v2_sa()), (34, struct.pack("!HH", 31, 0) + b"P" * 32), (40, b"N" * 16)])
    f1, b1 = chain([(1, v1_sa())])
    seeds = [header(body, first), header(b1, f1, 0x10, 2, 0)]
    out = []
    for _ in range(3000):
        m = bytearray(r.choice(seeds))
        for _ in range(r.randint(1, 6)):
            m[r.randrange(len(m))] = r.randrange(256)
        out.append(bytes(m[:r.randint(1, len(m))]))
    got, _ = ike_rows(spark, out)
    assert len(got) > 100


def test_extension_headers_beyond_the_walk_are_kept(spark):
    def chain(n, last):
        return b"".join(bytes([0 if i < n - 1 else last, 0]) + b"\0" * 6 for i in range(n))

    frames = {1: ip6(0, b"\0\0\x10\1\0\0\0\1", chain(8, 50)), 2: ip6(0, b"x" * 8, chain(12, 50)), 3: ip6(44, b"\x32\0\0\0\0\0\0\1rest"), 4: ip6(0, b"", b"\x32\xff" + b"\0" * 6), 5: ip6(60, b"abc")}
    df = spark.createDataFrame([("c", i, i, 101, bytearray(f)) for i, f in frames.items()], "capture string, frame bigint, ts_us bigint, linktype int, frame_bytes binary")
    got = {r.frame: (r.protocol, bytes(r.payload)) for r in decode_headers(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 50, 2: 0, 3: 44, 4: 0, 5: 60}
    assert got[1][1] == b"\0\0\x10\1\0\0\0\1" and got[3][1] == b"\x32\0\0\0\0\0\0\1rest" and got[5][1] == b"abc"
