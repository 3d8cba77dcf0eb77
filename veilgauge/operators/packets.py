"""Frames to packets, and packets to classes. Native expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import registries as R
from ..functions.bytes import byte_entropy, hex_at, ipv4, ipv6, uint
from .scan import frame_chunk, ordered

# link types of the capture header
ETHERNET, NULL_LINK, RAW, LINUX_SLL = 1, 0, 101, 113
VLAN_TAGS = ("8100", "88A8", "9100")
MAX_EXTENSIONS = 8


def _ike_valid(data: Column) -> Column:
    """The fixed IKE header: version, length range, initiator SPI, known IKEv2 exchange."""
    version, exchange, length = hex_at(data, 18, 1), uint(data, 19, 1), uint(data, 25, 4)
    return ((F.octet_length(data) >= 28) & version.isin("10", "20") & (length >= 28) & (length <= 0x40000)
            & (hex_at(data, 1, 8) != "0" * 16)
            & ((version == "10") | exchange.isin(*R.EXCHANGES_V2)))


def on_port(port: int) -> Column:
    return (F.col("sport") == port) | (F.col("dport") == port)


def classify(packets: DataFrame) -> DataFrame:
    """Add pkt_class: ike, esp, esp_natt, keepalive or other."""
    data, udp = F.col("payload"), F.col("protocol") == 17
    marked = hex_at(data, 1, 4) == "00000000"
    body = F.substring(data, F.lit(5), F.octet_length(data))
    esp_ok = (F.octet_length(data) >= 8) & (hex_at(data, 1, 4) != "00000000")
    natt = udp & on_port(4500)
    return packets.withColumn("pkt_class", F.when(natt & (F.octet_length(data) == 1) & (hex_at(data, 1, 1) == "FF"), "keepalive")
                              .when(natt & marked & _ike_valid(body), "ike")
                              .when(natt & ~marked & esp_ok, "esp_natt")
                              .when(udp & on_port(500) & ~on_port(4500) & _ike_valid(data), "ike")
                              .when((F.col("protocol") == 50) & esp_ok, "esp")
                              .otherwise("other"))


def ipsec_only(packets: DataFrame) -> DataFrame:
    """What a kernel capture filter would pass: IPv4 ESP, or UDP on 500/4500."""
    return packets.where((F.col("ip_version") == 4) & (
        (F.col("protocol") == 50) | ((F.col("protocol") == 17) & (on_port(500) | on_port(4500)))))


def event_kind(packets: DataFrame) -> DataFrame:
    """Labels of the live view: IKE, ESP, UDP-ESP, other."""
    c = classify(packets)
    return c.withColumn("kind", F.when(F.col("pkt_class") == "ike", "IKE").when(F.col("pkt_class") == "esp", "ESP")
                        .when(F.col("pkt_class") == "esp_natt", "UDP-ESP").otherwise("OTHER"))


def first_packets(packets: DataFrame, n: int, keys=("capture",)) -> DataFrame:
    """Stop after the n first packets of each capture."""
    cols = packets.columns
    return ordered(packets, list(keys), [F.col("frame")], frame_chunk(), rank="rn").where(F.col("rn") <= n).select(*cols)


def esp_from_packets(classed: DataFrame, entropy: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """ESP rows of classified packets: SPI, sequence, ciphertext length and entropy.

    Only the derived columns leave this operator, so payload never shuffles.
    """
    data = F.col("payload")
    cipher = F.substring(data, F.lit(9), F.octet_length(data))
    length = F.octet_length(data) - 8
    sample = F.when(length >= 256, F.substring(cipher, F.lit(1), F.lit(512)))
    cols = [
        *keep, "capture", "frame", "ts_us", "src", "dst", uint(data, 1, 4).alias("spi"), uint(data, 5, 4).alias("seq"),
        length.cast("bigint").alias("length"), (F.col("pkt_class") == "esp_natt").alias("encapsulated")]
    if entropy:
        cols.append(byte_entropy(sample).alias("entropy"))
    return classed.where(F.col("pkt_class").isin("esp", "esp_natt")).select(*cols)


def pinned(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns that later projections reuse instead of recomputing.

    A one-row generator stops the optimizer from substituting the expression
    into each of its many uses, which would grow the plan exponentially here.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def decode_headers(frames: DataFrame) -> DataFrame:
    """Frame bytes -> packets, without a UDF and in one pass over the frames.

    Ethernet with any number of VLAN tags, raw IP, Linux cooked and null link
    headers; IPv4 options and total length, later fragments dropped; IPv6 with
    up to eight extension headers. A frame with more of them, or whose next
    header cannot be followed, stays as a packet of that header's number.
    """
    f, link = F.col("frame_bytes"), F.col("linktype")
    tag1 = hex_at(f, 13, 2).isin(*VLAN_TAGS)
    tag2 = tag1 & hex_at(f, 17, 2).isin(*VLAN_TAGS)
    # more than two tags are rare: only then the chain is followed, four bytes a tag
    deeper = F.aggregate(F.sequence(F.lit(3), F.greatest(F.lit(3), F.floor((F.octet_length(f) - 12) / 4).cast("int"))), F.lit(22),
                         lambda at, i: F.when((at == 14 + 4 * (i - 1)) & hex_at(f, at - 1, 2).isin(*VLAN_TAGS), at + 4).otherwise(at))
    start = (F.when(link == ETHERNET, F.when(tag2, deeper).when(tag1, 18).otherwise(14))
             .when(link == LINUX_SLL, 16).when(link == NULL_LINK, 4).otherwise(0))
    d = pinned(frames, _s=start)
    # the EtherType is the two bytes in front of the IP header
    eth_type = F.when(link.isin(ETHERNET, LINUX_SLL), hex_at(f, F.col("_s") - 1, 2))
    d = pinned(d, _ip=F.substring(f, F.col("_s") + 1, F.octet_length(f)), _et=eth_type)
    ip, size = F.col("_ip"), F.octet_length("_ip").cast("bigint")
    d = pinned(d, _v=F.shiftright(uint(ip, 1, 1), 4)).where(
        (F.col("_et").isNull() | F.col("_et").isin("0800", "86DD")) & F.col("_v").isin(4, 6) & (size >= 20))

    # IPv6: walk extension headers as an expression over (next header, offset)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_EXTENSIONS)),
        F.struct(uint(ip, 7, 1).alias("nh"), F.lit(40).cast("bigint").alias("at")),
        lambda s, _i: F.when(
            s["nh"].isin(0, 43, 60) & (size >= s["at"] + 8) & (size >= s["at"] + (uint(ip, (s["at"] + 2).cast("int"), 1) + 1) * 8),
            F.struct(uint(ip, (s["at"] + 1).cast("int"), 1).alias("nh"),
                     (s["at"] + (uint(ip, (s["at"] + 2).cast("int"), 1) + 1) * 8).alias("at"))).otherwise(s))
    is4 = F.col("_v") == 4
    d = pinned(d, _w=F.when(~is4 & (size >= 40), walked), _ihl=F.pmod(uint(ip, 1, 1), F.lit(16)) * 4,
               _len=F.when(is4, uint(ip, 3, 2)).otherwise(uint(ip, 5, 2) + 40))
    d = d.where(
        (is4 & (F.col("_ihl") >= 20) & (size >= F.col("_ihl")) & (F.pmod(uint(ip, 7, 2), F.lit(8192)) == 0))
        | (~is4 & F.col("_w.nh").isNotNull()))
    stated = F.when(is4, F.col("_len") > 0).otherwise(F.col("_len") > 40)
    d = pinned(
        d, src=F.when(is4, ipv4(ip, 13)).otherwise(ipv6(ip, 9)), dst=F.when(is4, ipv4(ip, 17)).otherwise(ipv6(ip, 25)),
        protocol=F.when(is4, uint(ip, 10, 1)).otherwise(F.col("_w.nh")).cast("int"),
        _at=F.when(is4, F.col("_ihl")).otherwise(F.col("_w.at")),
        _end=F.when(stated, F.least(F.col("_len"), size)).otherwise(size),
        truncated=F.col("_len") > size)
    d = pinned(d, _body=F.substring(ip, (F.col("_at") + 1).cast("int"), (F.col("_end") - F.col("_at")).cast("int")))
    body, room = F.col("_body"), F.octet_length("_body").cast("bigint")
    d = pinned(d, _udp=F.when((F.col("protocol") == 17) & (room >= 8), uint(body, 5, 2)))
    udp = F.col("_udp").isNotNull()
    keep = F.when(F.col("_udp") >= 8, F.least(F.col("_udp"), room)).otherwise(room)
    return d.where((F.col("protocol") != 17) | udp).select(
        "capture", "frame", "ts_us", "src", "dst", "protocol",
        F.when(udp, uint(body, 1, 2)).otherwise(0).cast("int").alias("sport"),
        F.when(udp, uint(body, 3, 2)).otherwise(0).cast("int").alias("dport"),
        F.when(udp, F.substring(body, F.lit(9), (keep - 8).cast("int"))).otherwise(body).alias("payload"),
        F.col("_v").cast("int").alias("ip_version"), "truncated")


def hex_rows(df: DataFrame, key: str, data: str) -> DataFrame:
    """16-byte rows with offset, spaced hex and printable ASCII."""
    d = df.select(key, F.col(data).alias("_d")).where(F.octet_length("_d") > 0)
    rows = d.select(key, "_d", F.explode(F.sequence(F.lit(0), F.octet_length("_d") - 1, F.lit(16))).alias("offset"))
    piece = F.hex(F.substring("_d", F.col("offset") + 1, F.lit(16)))
    pairs = F.expr("regexp_extract_all(_h, '..', 0)")
    # bytes outside 0x20-0x7E show as a dot
    shown = F.expr("array_join(transform(regexp_extract_all(_h, '..', 0), x -> "
                   "CASE WHEN x >= '20' AND x <= '7E' THEN char(cast(conv(x, 16, 10) AS int)) ELSE '.' END), '')")
    return rows.withColumn("_h", piece).select(
        key, F.col("offset").cast("bigint").alias("offset"), F.lower(F.array_join(pairs, " ")).alias("hex"),
        shown.alias("ascii"))


# fixed values: class -> (IV bytes, ICV bytes, block bytes) of the packet view
WIRE_LAYOUT = {
    "64-bit block cipher": (8, 12, 8), "AES-CBC with 96-bit ICV": (16, 12, 16), "AES-CBC with 128-bit ICV": (16, 16, 16),
    "AEAD or counter mode": (8, 16, 16), "unencrypted payload": (0, 12, 4),
}


def wire_samples(classed: DataFrame, classes: DataFrame, max_samples: int = 3, high_entropy: float = 7.0) -> DataFrame:
    """First packets of every SPI with header, IV, body and ICV sizes and the residue check.

    `classes` has (capture, src, dst, spi, class); a flow without a known class
    takes 16 bytes for IV, ICV and block. The rank filter keeps
    `max_samples` rows per flow before the shuffle.
    """
    from pyspark.sql import Window as W

    esp = classed.where(F.col("pkt_class").isin("esp", "esp_natt")).withColumn("_spi", hex_at(F.col("payload"), 1, 4))
    w = W.partitionBy("capture", "src", "dst", "_spi").orderBy("frame")
    kept = esp.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max_samples)
    # entropy is computed for the kept packets only
    first = esp_from_packets(kept, keep=("nth",))
    j = first.join(classes, ["capture", "src", "dst", "spi"], "left")
    layout = {i: F.create_map(*[F.lit(x) for c, v in WIRE_LAYOUT.items() for x in (c, v[i])])[F.col("class")] for i in range(3)}
    iv, icv, block = (F.coalesce(layout[i], F.lit(d)) for i, d in ((0, 16), (1, 16), (2, 16)))
    body = F.greatest(F.col("length") - iv - icv, F.lit(0))
    return j.select(
        "capture", "src", "dst", "spi", "nth", "frame", "seq", "length", iv.alias("iv_bytes"),
        body.cast("bigint").alias("body_bytes"), icv.alias("icv_bytes"),
        (F.col("length") % block).alias("residue"), ((iv + icv) % block).cast("bigint").alias("expected"),
        (F.col("length") % block == (iv + icv) % block).alias("residue_ok"),
        (F.coalesce(F.col("entropy"), F.lit(0.0)) > high_entropy).alias("looks_encrypted"))
