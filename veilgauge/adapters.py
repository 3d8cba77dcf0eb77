"""Driver tables seen as the library's own tables.

The test tables hold no packets or handshakes, so each function projects one of
them into a library schema with plain arithmetic. All rows are used; nothing is
sampled. The DuckDB side in plans/ctes.py restates the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import registries as R
from .operators.scan import frame_chunk, ordered

SITE = "concat('site-', lpad({a}, 2, '0'), '-', lpad({b}, 2, '0'))"
SNO = ("CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 "
       "WHEN 'view' THEN 4 ELSE 5 END")
TRUTH = ("CASE sno WHEN 1 THEN '3DES-CBC / HMAC-MD5-96' WHEN 2 THEN 'AES-CBC-128 / HMAC-SHA1-96' "
         "WHEN 3 THEN 'AES-CBC-256 / HMAC-SHA2-256-128' WHEN 4 THEN 'AES-GCM-256 (ICV 16)' "
         "ELSE 'NULL encryption / HMAC-SHA1-96' END")


ROW_ID = {"events": "event_id", "orders": "o_orderkey", "documents": "doc_id", "part": "p_partkey", "supplier": "s_suppkey",
          "customer": "c_custkey", "pages": "page_id"}


#: Rows of a table that one task reads: the messages of an order take about a kilobyte, and a task sorts them in memory.
TASK_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. One that arrives in fewer splits than its rows or the cores ask for is spread by row id.

    A table of many files is read as it is; the extra exchange only serves
    files with large row groups, which would keep all work in a few tasks that
    grow with the table. Rows are counted from the footers of the files.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ROW_ID:
        return df
    splits, cores = df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    wanted = max(cores if splits < cores // 2 else 0, tasks(df))
    return df.repartition(wanted, ROW_ID[name]) if splits < wanted else df


def tasks(df: DataFrame) -> int:
    """How many tasks the rows of a table that is read from files ask for."""
    return -(-df.count() // TASK_ROWS)


def esp_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> ESP packets, one flow per (user_id % 20, event type)."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "event_id AS frame", "unix_micros(cast(ts AS timestamp)) AS ts_us", "user_id % 20 AS host",
        f"{SNO} AS sno", "40 + cast(floor(value * 8) AS bigint) AS inner_len", "event_id")
    sized = ev.selectExpr(
        "*",
        "CASE sno WHEN 1 THEN 8 WHEN 2 THEN 16 WHEN 3 THEN 16 ELSE 4 END AS b",
        "CASE sno WHEN 1 THEN 8 WHEN 2 THEN 16 WHEN 3 THEN 16 WHEN 4 THEN 8 ELSE 0 END AS iv",
        "CASE sno WHEN 3 THEN 16 WHEN 4 THEN 16 ELSE 12 END AS icv",
    ).selectExpr("*", "cast(iv + ((inner_len + 2 + b - 1) div b) * b + icv AS bigint) AS length")
    return sized.selectExpr(
        SITE.format(a="host", b="sno") + " AS capture", "frame", "ts_us",
        "concat('10.0.0.', host) AS src", "concat('203.0.113.', 10 + sno) AS dst",
        "cast(4096 + host * 8 + sno AS bigint) AS spi", "length",
        "CASE WHEN length >= 256 THEN CASE WHEN sno = 5 THEN 5.62D "
        "ELSE 7.83D + (event_id % 17 - 8) / 97D END END AS entropy",
        "host % 4 = 1 AS encapsulated", f"{TRUTH} AS truth",
        "CASE WHEN host % 3 = 0 THEN 'tunnel' ELSE 'transport' END AS mode",
        "host % 5 AS loss", "host % 2 = 0 AS tfc")


def esp_packets_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same packets with sequence numbers; every 31st event skips one."""
    p = esp_packets(spark, sf_dir)
    return ordered(p, ["capture", "src", "dst", "spi"], [F.col("frame")], frame_chunk(), rank="rn").selectExpr(
        "*", "rn + CASE WHEN frame % 31 = 0 THEN 1 ELSE 0 END AS seq").drop("rn")


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> decoded IP packets with payload bytes, in ten shapes."""
    ev = table(spark, sf_dir, "events").selectExpr(
        "event_id AS frame", "unix_micros(cast(ts AS timestamp)) AS ts_us",
        "concat('cap-', user_id % 7) AS capture", "concat('10.0.0.', user_id % 20) AS src",
        "concat('203.0.113.', user_id % 11) AS dst", "event_id % 10 AS shape", "event_id", "user_id")
    return ev.selectExpr(
        "capture", "frame", "ts_us", "src", "dst", "4 AS ip_version", "false AS truncated",
        "CASE WHEN shape IN (5, 6, 8, 9) THEN 50 WHEN shape = 7 THEN 6 ELSE 17 END AS protocol",
        "CASE WHEN shape IN (0, 4) THEN 500 WHEN shape IN (1, 2, 3) THEN 4500 WHEN shape = 7 THEN 443 ELSE 0 END AS sport",
        "CASE WHEN shape IN (0, 4) THEN 500 WHEN shape IN (1, 2, 3) THEN 4500 WHEN shape = 7 THEN 50000 ELSE 0 END AS dport",
        "unhex(CASE shape "
        " WHEN 0 THEN concat(lpad(hex(event_id + 1), 16, '0'), repeat('00', 8), '21202208', repeat('00', 4), '0000001C')"
        " WHEN 1 THEN concat('00000000', lpad(hex(event_id + 1), 16, '0'), repeat('00', 8), '21202220', repeat('00', 4), '0000001C')"
        " WHEN 2 THEN 'FF'"
        " WHEN 4 THEN concat(lpad(hex(event_id + 1), 16, '0'), repeat('00', 8), '21302208', repeat('00', 4), '0000001C')"
        " WHEN 5 THEN concat(repeat('00', 4), lpad(hex(event_id), 8, '0'), repeat('AB', 32))"
        " WHEN 6 THEN '0000100A'"
        " WHEN 7 THEN repeat('16', 24)"
        " ELSE concat(lpad(hex(4096 + user_id % 40), 8, '0'), lpad(hex(event_id), 8, '0'),"
        "   repeat(lpad(hex(event_id % 256), 2, '0'), cast(24 + 4 * (event_id % 9) AS int))) END) AS payload")


# --- handshakes ---------------------------------------------------------------
# Transforms per suite: (type, id, name, key length). 0-7 are IKEv2, 8-11 IKEv1.
HANDSHAKE_SUITES = [
    [(1, 20, "ENCR_AES_GCM_16", 256), (2, 6, "PRF_HMAC_SHA2_384", None), (4, 20, None, None)],
    [(1, 12, "ENCR_AES_CBC", 256), (2, 5, "PRF_HMAC_SHA2_256", None), (3, 12, "AUTH_HMAC_SHA2_256_128", None), (4, 14, None, None)],
    [(1, 3, "ENCR_3DES", None), (2, 2, "PRF_HMAC_SHA1", None), (3, 2, "AUTH_HMAC_SHA1_96", None), (4, 2, None, None)],
    [(1, 12, "ENCR_AES_CBC", 128), (2, 2, "PRF_HMAC_SHA1", None), (3, 2, "AUTH_HMAC_SHA1_96", None), (4, 5, None, None)],
    [(1, 20, "ENCR_AES_GCM_16", 256), (2, 7, "PRF_HMAC_SHA2_512", None), (4, 31, None, None), (6, 36, None, None)],
    [(1, 20, "ENCR_AES_GCM_16", 128), (2, 5, "PRF_HMAC_SHA2_256", None), (4, 19, None, None), (6, 0, None, None)],
    [(1, 2, "ENCR_DES", None), (2, 1, "PRF_HMAC_MD5", None), (3, 1, "AUTH_HMAC_MD5_96", None), (4, 1, None, None)],
    [(1, 28, "ENCR_CHACHA20_POLY1305", None), (2, 7, "PRF_HMAC_SHA2_512", None), (4, 36, None, None)],
    [(1, 5, "3DES_CBC", None), (2, 2, "PRF_HMAC_SHA1", None), (3, 2, "AUTH_HMAC_SHA1", None), (4, 2, None, None)],
    [(1, 7, "AES_CBC", 256), (2, 4, "PRF_HMAC_SHA2_256", None), (3, 4, "AUTH_HMAC_SHA2_256", None), (4, 14, None, None)],
    [(1, 1, "DES_CBC", None), (2, 1, "PRF_HMAC_MD5", None), (3, 1, "AUTH_HMAC_MD5", None), (4, 1, None, None)],
    [(1, 7, "AES_CBC", 64), (2, 2, "PRF_HMAC_SHA1", None), (3, 2, "AUTH_HMAC_SHA1", None), (4, 5, None, None)],
]
EXTRA_WEAK = [(1, 3, "ENCR_3DES", None), (3, 1, "AUTH_HMAC_MD5_96", None), (4, 22, None, None)]
EXTRA_PQ = [(6, 36, None, None)]

TRANSFORM_DDL = "struct<type_id:int,type_name:string,value_id:int,name:string,key_length:int>"
PROPOSAL_DDL = f"struct<number:int,protocol_id:int,protocol:string,spi:string,transforms:array<{TRANSFORM_DDL}>>"


def transform_rows(items):
    """(type_id, type_name, value_id, name, key_length) with group names filled in."""
    return [(t, R.TRANSFORM_TYPES[t], v, n or R.DH[v][0], k) for t, v, n, k in items]


def _transforms_sql(items) -> str:
    rows = ", ".join(
        f"named_struct('type_id', {t}, 'type_name', '{tn}', 'value_id', {v}, 'name', '{n}', 'key_length', "
        f"{'cast(null AS int)' if k is None else k})" for t, tn, v, n, k in transform_rows(items))
    return f"array({rows})"


def ike_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> IKE messages: one SA per order, two to five messages each.

    Orders are spread by capture and SPI, so the messages of a session are made in one task and a grouping
    by session moves no message.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    slim = orders.selectExpr(
        "o_orderkey AS k", "o_custkey AS c", "o_orderdate AS day", "o_orderpriority = '5-LOW' AS v1", "o_orderstatus <> 'P' AS confirmed",
        SITE.format(a="o_custkey % 20", b="o_orderkey % 100") + " AS capture", "lower(lpad(hex(o_orderkey + 1), 16, '0')) AS initiator_spi")
    o = slim.repartition(max(spark.sparkContext.defaultParallelism, tasks(orders)), "capture", "initiator_spi").selectExpr(
        "*", "unix_micros(cast(day AS timestamp)) AS day_us", "cast(CASE WHEN v1 THEN 8 + k % 4 ELSE k % 8 END AS int) AS sidx")
    picks = "CASE sidx " + " ".join(
        f"WHEN {i} THEN {_transforms_sql(s)}" for i, s in enumerate(HANDSHAKE_SUITES)) + " END"
    group = "CASE sidx " + " ".join(
        f"WHEN {i} THEN {next(v for t, v, _n, _k in s if t == 4)}" for i, s in enumerate(HANDSHAKE_SUITES)) + " END"
    base = o.selectExpr(
        "*", "concat('10.1.', c div 250, '.', c % 250) AS pa", "concat('203.0.113.', 10 + c % 7) AS pb",
        f"{picks} AS chosen", f"{group} AS grp",
    ).selectExpr(
        "*", "CASE WHEN k % 2 = 1 THEN pb ELSE pa END AS a", "CASE WHEN k % 2 = 1 THEN pa ELSE pb END AS b",
        f"concat(chosen, CASE WHEN k % 5 = 0 AND NOT v1 THEN {_transforms_sql(EXTRA_WEAK)} ELSE array() END,"
        f" CASE WHEN k % 11 = 0 AND NOT v1 AND sidx NOT IN (4, 5) THEN {_transforms_sql(EXTRA_PQ)} ELSE array() END) AS offer",
        "CASE WHEN v1 THEN CASE WHEN k % 9 = 0 THEN 'Aggressive Mode' ELSE 'Identity Protection (Main Mode)' END"
        " ELSE 'IKE_SA_INIT' END AS ex0",
        "CASE WHEN k % 10 = 5 THEN sha2(concat('ke-', c % 7, '-', k % 40), 256) ELSE sha2(concat('ke-', k), 256) END AS ke0",
        "CASE WHEN k % 10 = 1 THEN sha2(concat('n-', k % 100), 256) ELSE sha2(concat('n-', k), 256) END AS n0")
    # slot of each message: 1 request, 2 response, 3 resent request, 4 intermediate, 5 auth
    slots = base.selectExpr(
        "*",
        "explode(filter(array(1, 2, 3, 4, 5), s -> s = 1 OR (s = 2 AND confirmed) OR (s = 3 AND k % 13 = 0)"
        " OR (s = 4 AND confirmed AND sidx = 4 AND k % 3 <> 0) OR (s = 5 AND confirmed))) AS slot")
    prop = "array(named_struct('number', 1, 'protocol_id', 1, 'protocol', 'IKE', 'spi', '', 'transforms', {t}))"
    return slots.selectExpr(
        "capture", "k * 10 + slot AS frame", "day_us + (k % 1000) * 1000000 + slot * 1000 AS ts_us",
        "CASE WHEN slot = 2 THEN b ELSE a END AS src", "CASE WHEN slot = 2 THEN a ELSE b END AS dst",
        "500 AS sport", "500 AS dport", "CASE WHEN v1 THEN 'IKEv1' ELSE 'IKEv2' END AS version",
        "CASE WHEN slot <= 3 THEN ex0 WHEN slot = 4 THEN 'IKE_INTERMEDIATE' WHEN v1 THEN 'Quick Mode' ELSE 'IKE_AUTH' END AS exchange",
        "initiator_spi",
        "CASE WHEN slot IN (2, 4, 5) THEN lower(lpad(hex(k + 7), 16, '0')) ELSE repeat('0', 16) END AS responder_spi",
        "cast(CASE slot WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS bigint) AS message_id",
        "slot <> 2 AS is_initiator", "slot = 2 AS is_response", "slot >= 4 AS encrypted",
        f"CASE WHEN slot IN (1, 3) THEN {prop.format(t='offer')} WHEN slot = 2 THEN {prop.format(t='chosen')}"
        f" ELSE cast(array() AS array<{PROPOSAL_DDL}>) END AS proposals",
        "CASE WHEN slot <= 3 THEN grp END AS ke_group",
        "CASE WHEN slot IN (1, 3) THEN concat(array('NAT_DETECTION_SOURCE_IP'),"
        "   CASE WHEN k % 4 <> 0 AND NOT v1 THEN array('IKEV2_FRAGMENTATION_SUPPORTED') ELSE array() END)"
        " WHEN slot = 2 THEN concat(CASE WHEN k % 19 = 0 THEN array('USE_PPK') ELSE array() END,"
        "   CASE WHEN k % 23 = 0 THEN array('NO_PROPOSAL_CHOSEN') ELSE array() END)"
        " ELSE cast(array() AS array<string>) END AS notifies",
        "CASE WHEN slot = 1 THEN CASE k % 6 WHEN 0 THEN array('Cisco IOS / ASA') WHEN 1 THEN array('strongSwan')"
        "   WHEN 2 THEN array('Fortinet FortiGate') WHEN 3 THEN array('Juniper SRX / NetScreen')"
        "   WHEN 5 THEN array('Dead Peer Detection (RFC 3706)', 'Microsoft Windows IKE')"
        "   ELSE cast(array() AS array<string>) END ELSE cast(array() AS array<string>) END AS vendor_ids",
        "CASE WHEN slot = 1 AND v1 THEN 28800 * (1 + k % 5) END AS lifetime_seconds",
        "CASE WHEN slot = 1 AND v1 THEN CASE WHEN k % 2 = 0 THEN 'PRE_SHARED_KEY' ELSE 'RSA_SIGNATURES' END END AS auth_method",
        "false AS natt", "CASE WHEN slot IN (1, 3) THEN ke0 WHEN slot = 2 THEN sha2(concat('kr-', k), 256) END AS ke_digest",
        "CASE WHEN slot IN (1, 3) THEN n0 WHEN slot = 2 THEN sha2(concat('nr-', k), 256) END AS nonce_digest",
        "CASE WHEN slot <= 3 THEN CASE WHEN k % 17 = 0 AND slot <> 2 THEN 8 ELSE 32 END END AS nonce_len",
        "CASE WHEN k % 29 = 0 AND slot = 1 THEN array('snaplen-truncated frame') ELSE cast(array() AS array<string>) END AS parse_errors")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw packets wrapped in Ethernet (every third VLAN tagged) and IPv4 bytes."""
    p = raw_packets(spark, sf_dir)
    ip4 = "upper(lpad(hex(cast(split({c}, '[.]')[{i}] AS bigint)), 2, '0'))"
    addr = {c: "concat(" + ", ".join(ip4.format(c=c, i=i) for i in range(4)) + ")" for c in ("src", "dst")}
    return p.selectExpr(
        "capture", "frame", "ts_us", "1 AS linktype",
        "CASE WHEN protocol = 17 THEN concat(lpad(hex(sport), 4, '0'), lpad(hex(dport), 4, '0'),"
        " lpad(hex(octet_length(payload) + 8), 4, '0'), '0000', hex(payload)) ELSE hex(payload) END AS body",
        "protocol", f"{addr['src']} AS s4", f"{addr['dst']} AS d4",
    ).selectExpr(
        "capture", "frame", "ts_us", "linktype",
        "unhex(concat(repeat('02', 12), CASE WHEN frame % 3 = 0 THEN '81000064' ELSE '' END, '0800', '4500',"
        " lpad(hex(20 + length(body) div 2), 4, '0'), '00004000', '40', lpad(hex(protocol), 2, '0'), '0000', s4, d4, body)) AS frame_bytes")


# --- hosts ------------------------------------------------------------------------
def wifi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> networks in range, forty per host."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey div 40 AS host", "CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END AS ssid",
        "lower(lpad(hex(p_partkey), 12, '0')) AS bssid", "p_size * 2 AS signal_percent",
        "cast(CASE WHEN p_partkey % 2 = 0 THEN 1 + p_partkey % 11 ELSE 36 + 4 * (p_partkey % 8) END AS int) AS channel",
        "CASE WHEN p_partkey % 2 = 0 THEN '2.4 GHz' ELSE '5 GHz' END AS band",
        "CASE p_type WHEN 'ECONOMY' THEN 'Open' WHEN 'SMALL' THEN 'WEP' WHEN 'STANDARD' THEN 'WPA-Personal' WHEN 'MEDIUM' THEN 'WPA2-Personal'"
        " WHEN 'LARGE' THEN 'WPA2-Enterprise' ELSE 'WPA3-Personal' END AS authentication",
        "CASE p_type WHEN 'ECONOMY' THEN 'None' WHEN 'SMALL' THEN 'WEP' WHEN 'STANDARD' THEN 'TKIP' ELSE 'CCMP' END AS encryption")


def wifi_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host's own interface: its strongest network; every seventh host is offline."""
    s = wifi_scan(spark, sf_dir).groupBy("host").agg(F.max_by(
        F.struct("ssid", "bssid", "signal_percent", "channel", "band", "authentication", "encryption"),
        F.struct("signal_percent", "bssid")).alias("n"))
    return s.selectExpr(
        "host", "CASE WHEN host % 7 = 3 THEN 'disconnected' ELSE 'connected' END AS state", "n.ssid", "n.bssid", "n.signal_percent",
        "n.channel", "n.band", "n.authentication", "n.encryption AS cipher",
        "CASE host % 3 WHEN 0 THEN array('192.168.1.1') WHEN 1 THEN array('1.1.1.1') ELSE array('198.41.0.4') END AS dns_servers")


ADAPTER_NAMES = [
    "Wi-Fi|Intel Wireless-AC", "wg0|WireGuard Tunnel", "Ethernet|Intel Gigabit Ethernet", "lo|Loopback Interface", "tap0|TAP-Windows Adapter V9",
    "corp|Cisco AnyConnect", "WAN Miniport|WAN Miniport (IKEv2)", "Ethernet 2|Realtek PCIe GbE Family", "office|My VPN wireless", "proton0|ProTUN",
    "ts0|Tailscale", "eth1|USB Ethernet"]


def vpn_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """supplier -> hosts, adapters (three per host), routes and resolvers."""
    picks = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(ADAPTER_NAMES))
    a = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "s_suppkey div 3 AS host", "s_suppkey % 3 AS idx", f"CASE (s_suppkey * 7 + s_nationkey) % 12 {picks} END AS both").selectExpr(
        "s_suppkey", "host", "idx", "split(both, '[|]')[0] AS name", "split(both, '[|]')[1] AS description", "10 + s_suppkey % 5 AS metric",
        "s_suppkey % 8 <> 7 AS connected")
    hosts = a.select("host").distinct()
    routes = a.selectExpr("host", "'0.0.0.0' AS dest", "'0.0.0.0' AS mask", "name AS iface", "metric").where("host % 2 = 0 OR iface = 'Wi-Fi'")
    dns = a.where("s_suppkey % 4 <> 1").selectExpr("host", "name AS iface", "concat('10.9.', host % 200, '.', idx) AS server").unionByName(
        hosts.where("host % 5 <> 0").selectExpr("host", "'Wi-Fi' AS iface", "concat('192.0.2.', host % 200) AS server"))
    return hosts, a.drop("s_suppkey"), routes, dns


# --- labels, windows, plans ---------------------------------------------------------
def flow_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return esp_packets(spark, sf_dir).groupBy("capture", "src", "dst", "spi").agg(
        F.min("truth").alias("truth"), F.min("mode").alias("mode"), F.min("loss").alias("loss"), F.min("tfc").alias("tfc"))


def flow_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label entries of three kinds for three quarters of the flows."""
    f = flow_truth(spark, sf_dir).withColumn("host", F.expr("(spi - 4096) div 8"))
    wrong = "CASE WHEN host % 8 = 0 THEN 'ChaCha20-Poly1305' ELSE truth END"
    return f.selectExpr("capture", "explode(filter(array("
                        f"CASE WHEN host % 4 IN (0, 1) THEN named_struct('idx', 0, 'spi', spi, 'dst', CASE WHEN spi % 2 = 0 THEN dst END, 'peer_a', cast(null AS string), 'peer_b', cast(null AS string), 'suite', {wrong}, 'source', 'gateway') END,"
                        "CASE WHEN host % 4 IN (1, 2) THEN named_struct('idx', 1, 'spi', cast(null AS bigint), 'dst', cast(null AS string), 'peer_a', dst, 'peer_b', src, 'suite', truth, 'source', 'config') END,"
                        "CASE WHEN host % 4 = 2 THEN named_struct('idx', 2, 'spi', spi + 100000, 'dst', cast(null AS string), 'peer_a', cast(null AS string), 'peer_b', cast(null AS string), 'suite', truth, 'source', 'config') END"
                        "), e -> e IS NOT NULL)) AS e").select("capture", "e.*")


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> unvalidated label entries with every kind of defect."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('cap-', o_orderkey % 50) AS capture", "o_orderkey AS idx",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'BOGUS' ELSE 'ChaCha20-Poly1305' END AS suite",
        "CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE 'gateway' END AS source",
        "CASE WHEN o_orderkey % 3 <> 1 OR o_orderkey % 19 = 0 THEN CASE WHEN o_orderkey % 29 = 0 THEN 'zz' WHEN o_orderkey % 23 = 0 THEN '0x0'"
        " WHEN o_orderkey % 5 = 0 THEN concat('0x', lower(hex(o_custkey % 40 + 1))) ELSE lower(hex(o_orderkey + 1000)) END END AS spi_text",
        "cast(null AS string) AS dst",
        "CASE WHEN o_orderkey % 3 = 1 THEN array(concat('10.0.0.', o_custkey % 9), CASE WHEN o_orderkey % 31 = 0 THEN concat('10.0.0.', o_custkey % 9) ELSE '192.0.2.1' END) END AS peers")


def sensor_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> packets of 150 sensors in hourly windows."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS sensor", "event_id AS frame", "unix_micros(cast(ts AS timestamp)) AS ts_us", "unix_micros(cast(ts AS timestamp)) div 86400000000 AS window",
        "cast(40 + floor(value * 8) AS bigint) AS length", "event_id % 7 = 0 AS dropped")


def window_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_packets(spark, sf_dir).groupBy("sensor", "window").agg(
        F.sum(F.when(~F.col("dropped"), 1).otherwise(0)).alias("packets"), F.sum(F.when(F.col("dropped"), 1).otherwise(0)).alias("dropped"),
        F.max("ts_us").alias("completed_us")).withColumn("window_seconds", F.lit(3600))


def ike_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IKEv2 requests of the handshake table as UDP payload bytes: SA, KE and nonce payloads."""
    m = ike_messages(spark, sf_dir).where("version = 'IKEv2' AND frame % 10 = 1")
    one = ("concat(CASE WHEN i = n - 1 THEN '00' ELSE '03' END, '00', CASE WHEN t.key_length > 0 THEN '000C' ELSE '0008' END, lpad(hex(t.type_id), 2, '0'), '00',"
           " lpad(hex(t.value_id), 4, '0'), CASE WHEN t.key_length > 0 THEN concat('800E', lpad(hex(t.key_length), 4, '0')) ELSE '' END)")
    return m.selectExpr("*", "proposals[0].transforms AS tr", "size(proposals[0].transforms) AS n").selectExpr(
        "*", f"array_join(transform(tr, (t, i) -> {one}), '') AS body",
        "repeat(lpad(hex((frame div 10) % 256), 2, '0'), nonce_len) AS nonce",
    ).selectExpr(
        "*", "concat('2200', lpad(hex(12 + length(body) div 2), 4, '0'), '0000', lpad(hex(8 + length(body) div 2), 4, '0'), '010100', lpad(hex(n), 2, '0'), body,"
        " '28000028', lpad(hex(ke_group), 4, '0'), '0000', repeat('5A', 32), '0000', lpad(hex(4 + length(nonce) div 2), 4, '0'), nonce) AS chain",
    ).selectExpr(
        "capture", "frame", "ts_us", "src", "dst", "17 AS protocol", "500 AS sport", "500 AS dport", "false AS truncated",
        "unhex(concat(upper(initiator_spi), repeat('00', 8), '21202208', '00000000', lpad(hex(28 + length(chain) div 2), 8, '0'), chain)) AS payload")
