"""Wi-Fi scans: grades, rogue access points, host scores, channel load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

GROUP = ["host", "ssid_key"]


def is_5ghz(band: Column, channel: Column) -> Column:
    return F.contains(band, F.lit("5")) | (channel >= 32)


def centre_mhz(channel: Column, band: Column) -> Column:
    five = is_5ghz(band, channel)
    return (F.when(channel <= 0, None).when(five, 5000 + 5 * channel).when(channel == 14, 2484)
            .when(channel.between(1, 13), 2407 + 5 * channel))


def rssi(signal: Column) -> Column:
    """Percent to dBm, truncated toward zero."""
    return (signal / 2 - 100).cast("int")


def _old_wpa(auth: Column) -> Column:
    return F.contains(auth, F.lit("WPA-")) & ~F.contains(auth, F.lit("WPA2")) & ~F.contains(auth, F.lit("WPA3"))


# fixed values, first match wins: (of the authentication or the encryption, pattern in upper case, rank, grade)
SECURITY = (
    ("authentication", "OPEN", 0, "F"), ("encryption", "NONE", 0, "F"), ("authentication", "WEP", 1, "F"), ("encryption", "WEP", 1, "F"),
    ("encryption", "TKIP", 2, "D"), ("authentication", "^(?!.*WPA[23]).*WPA", 2, "D"), ("authentication", "WPA3", 4, "A+"), ("authentication", "WPA2", 3, "B"))
SECURITY_ELSE = (2, "C")


def _security(auth: Column, enc: Column, item: int) -> Column:
    """Rank (item 0) or grade (item 1) of the first row of SECURITY that matches."""
    of = {"authentication": F.upper(F.coalesce(auth, F.lit(""))), "encryption": F.upper(F.coalesce(enc, F.lit("")))}
    return F.coalesce(*[F.when(of[which].rlike(pattern), F.lit(result[item])) for which, pattern, *result in SECURITY], F.lit(SECURITY_ELSE[item]))


def security_rank(auth: Column, enc: Column) -> Column:
    """0 open, 1 WEP, 2 TKIP, WPA or unknown, 3 WPA2, 4 WPA3."""
    return _security(auth, enc, 0)


def network_grade(auth: Column, enc: Column) -> Column:
    return _security(auth, enc, 1)


def rogue_groups(scan: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host and SSID: best and worst security, clones, and whether it is the host's own network."""
    s = scan.where(F.col("ssid") != "").withColumn("ssid_key", F.lower("ssid")).withColumn(
        "rank", security_rank(F.col("authentication"), F.col("encryption")))
    per_rank = s.groupBy(*GROUP, "rank").agg(F.count(F.lit(1)).alias("n"), F.min("ssid").alias("ssid"))
    g = per_rank.groupBy(*GROUP).agg(
        F.sum("n").alias("aps"), F.max("rank").alias("best"), F.min("rank").alias("worst"), F.min("ssid").alias("ssid"),
        (F.sum("n") - F.max_by("n", "rank")).alias("weak_aps")).where(F.col("aps") >= 2)
    own = hosts.select("host", F.lower("ssid").alias("own_ssid"))
    return g.join(own, "host", "left").withColumn("own", F.coalesce(F.col("own_ssid") == F.col("ssid_key"), F.lit(False))).drop("own_ssid")


def rogue_findings(groups: DataFrame) -> DataFrame:
    """WIFI-020 for clones (own network costs 35 points), WIFI-021 for a mesh on the own network."""
    clone = F.col("worst") < F.col("best")
    title = F.when(clone & F.col("own"), "Potential Evil Twin / Rogue AP Detected").when(
        clone, F.concat(F.lit("Nearby Evil Twin / Rogue AP Detected ("), F.col("ssid"), F.lit(")"))).otherwise(
        "Multi-AP Mesh / BSS Roaming Environment")
    return groups.where(clone | F.col("own")).select(
        "host", F.when(clone, "WIFI-020").otherwise("WIFI-021").alias("rule_id"), title.alias("title"),
        F.when(clone & F.col("own"), "critical").when(clone, "high").otherwise("info").alias("severity"),
        F.when(clone & F.col("own"), -35).otherwise(0).alias("delta"))


# fixed values: resolvers taken as known; titles below are fixed values too, since findings group by them
SECURE_DNS = ("1.1.1.1", "1.0.0.1", "8.8.8.8", "8.8.4.4", "9.9.9.9")
PRIVATE = r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|0\.|::1$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"


def is_private(ip: Column) -> Column:
    """Private, loopback, link-local and documentation ranges."""
    v4 = ip.rlike(PRIVATE)
    special = ip.rlike(r"^(192\.0\.0\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|198\.1[89]\.|2(4[0-9]|5[0-5])\.)")
    return v4 | special


def host_findings(hosts: DataFrame) -> DataFrame:
    """Rules over the connected interface, one pass; each row carries its score delta."""
    a, e = F.upper("authentication"), F.upper("cipher")
    has = lambda c, t: F.contains(c, F.lit(t))
    up = F.lower("state") == "connected"

    def row(rule, title, severity, delta=0):
        return F.struct(F.lit(rule).alias("rule_id"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.lit(delta).alias("delta"))

    security = (F.when(has(a, "OPEN") | has(e, "NONE"), row("WIFI-001", "Unencrypted Open Wi-Fi Network", "critical", -60))
                .when(has(a, "WEP") | has(e, "WEP"), row("WIFI-002", "Obsolete WEP Encryption Detected", "critical", -50))
                .when(has(e, "TKIP") | _old_wpa(a), row("WIFI-003", "Vulnerable WPA/TKIP Encryption", "high", -30))
                .when(has(a, "WPA2"), row("WIFI-004", "WPA2 Pre-Shared Key (PSK) Vulnerable to Offline Dictionary Attack", "medium", -15))
                .when(has(a, "WPA3"), row("WIFI-005", "WPA3 Modern SAE Authentication Active", "info")))
    signal = F.when(F.col("signal_percent") < 40, row("WIFI-010", "Weak Wireless Signal Strength", "low", -5))
    band = F.when(has(F.col("band"), "2.4"), row("WIFI-011", "2.4 GHz Band In Use (Crowded Spectrum)", "info"))
    some = F.size("dns_servers") > 0
    dns = (F.when(some & F.exists("dns_servers", is_private), row("WIFI-030", "Local Gateway Unencrypted DNS Resolver", "medium", -5))
           .when(some & ~F.exists("dns_servers", lambda d: d.isin(*SECURE_DNS)), row("WIFI-031", "Unverified DNS Resolver Configured", "low")))
    pq = row("WIFI-040", "Wi-Fi Key Exchange Post-Quantum Susceptibility", "info")
    rules = F.when(up, F.array(security, signal, band, dns, pq)).otherwise(
        F.array(row("WIFI-000", "Wi-Fi Interface Disconnected or Offline", "info")))
    return hosts.select("host", F.inline(F.array_compact(rules)))


def audit_wifi(scan: DataFrame, hosts: DataFrame) -> DataFrame:
    up = hosts.where(F.lower("state") == "connected")
    rogue = rogue_findings(rogue_groups(scan, up)).join(up.select("host"), "host", "left_semi")
    return host_findings(hosts).unionByName(rogue)


def wifi_score(findings: DataFrame, hosts: DataFrame) -> DataFrame:
    total = findings.groupBy("host").agg(F.sum("delta").alias("delta"), F.count(F.lit(1)).alias("findings"))
    s = hosts.select("host", (F.lower("state") == "connected").alias("up")).join(total, "host", "left")
    score = F.when(F.col("up"), F.greatest(F.lit(0), F.least(F.lit(100), 100 + F.coalesce("delta", F.lit(0))))).otherwise(0).cast("int")
    s = s.withColumn("score", score)
    grade = (F.when(~F.col("up"), "\u2014").when(F.col("score") >= 95, "A+").when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B")
             .when(F.col("score") >= 70, "C").when(F.col("score") >= 55, "D").otherwise("F"))
    return s.withColumn("grade", grade).drop("delta")


def connected_flag(scan: DataFrame, hosts: DataFrame) -> DataFrame:
    """Exactly one connected network per online host: its BSSID, else the strongest with its SSID, else an added row."""
    up = hosts.where(F.lower("state") == "connected").select(
        "host", F.lower(F.trim("bssid")).alias("hb"), F.lower(F.trim("ssid")).alias("hs"))
    j = scan.join(up, "host", "left")
    # candidates rank by match kind, then signal; one candidate per host is picked by an aggregate
    kind = F.when(F.lower("bssid") == F.col("hb"), 2).when(F.lower("ssid") == F.col("hs"), 1)
    best = j.where(kind.isNotNull()).groupBy("host").agg(
        F.max_by("bssid", F.struct(kind, F.col("signal_percent"), F.col("bssid"))).alias("pick"))
    flagged = scan.join(best, "host", "left").withColumn("connected", F.coalesce(F.col("bssid") == F.col("pick"), F.lit(False))).drop("pick")
    missing = hosts.where(F.lower("state") == "connected").join(best, "host", "left_anti").select(
        "host", "ssid", "bssid", "signal_percent", "channel", "band", "authentication", F.col("cipher").alias("encryption"),
        F.lit(True).alias("connected"))
    return flagged.unionByName(missing, allowMissingColumns=True)


def cache_merge(sightings: DataFrame, keep_seconds: int = 180) -> DataFrame:
    """Networks of each host's newest scan, plus those last seen at most keep_seconds before it."""
    now = sightings.groupBy("host").agg(F.max("scan_s").alias("now"))
    last = sightings.groupBy("host", "bssid").agg(F.max("scan_s").alias("seen"), F.max_by("signal_percent", "scan_s").alias("signal_percent"))
    j = last.join(now, "host").where(F.col("now") - F.col("seen") <= keep_seconds)
    return j.select("host", "bssid", "signal_percent", (F.col("seen") == F.col("now")).alias("in_scan"))


def channel_load(scan: DataFrame, five: bool) -> DataFrame:
    """Interference per candidate channel: 3 per co-channel network, 1.5 per network one or two channels off (2.4 GHz)."""
    candidates = [36, 40, 44, 48, 149, 153, 157, 161] if five else [1, 6, 11]
    in_band = scan.where(is_5ghz(F.col("band"), F.col("channel")) if five else ~is_5ghz(F.col("band"), F.col("channel")))
    per = in_band.groupBy("host", "channel").agg(F.count(F.lit(1)).alias("n"))
    loads = per.groupBy("host").agg(*[
        F.sum(F.when(F.col("channel") == c, F.col("n") * 3.0).when(
            F.lit(not five) & (F.abs(F.col("channel") - c) <= 2), F.col("n") * 1.5).otherwise(0.0)).alias(f"c{c}") for c in candidates])
    return loads.select("host", F.inline(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.lit(i).alias("ord"), F.col(f"c{c}").alias("load")) for i, c in enumerate(candidates)])))


def best_channel(loads: DataFrame) -> DataFrame:
    return loads.groupBy("host").agg(F.min_by("channel", F.struct("load", "ord")).alias("channel"), F.min("load").alias("load"))


def ssid_groups(flagged: DataFrame) -> DataFrame:
    """Per host and SSID: access points, best signal, bands and channels (short fixed domains)."""
    key = F.when(F.col("ssid") == "", "(Hidden SSID)").otherwise(F.col("ssid"))
    return flagged.groupBy("host", key.alias("ssid")).agg(
        F.count(F.lit(1)).alias("aps"), F.max("connected").alias("connected"), F.max("signal_percent").alias("best_signal"),
        F.array_join(F.array_sort(F.collect_set("band")), " & ").alias("bands"),
        F.array_join(F.array_sort(F.collect_set("channel")), ", ").alias("channels"))
