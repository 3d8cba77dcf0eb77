"""Host tunnels: adapter type, DNS leak, split tunnel. Titles are fixed values: findings group by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import registries as R


def adapter_type(name: Column, description: Column) -> Column:
    """First matching pattern, null for physical and loopback adapters."""
    text = F.lower(F.concat_ws(" ", name, description))
    has = lambda t: F.contains(text, F.lit(t))
    skip = has("loopback") | ((has("wi-fi") | has("wireless") | has("802.11")) & ~has("vpn")) | has("gbe family") | has("gigabit")
    match = F.coalesce(*[F.when(text.rlike(p), F.lit(t)) for p, t in R.VPN_PATTERNS])
    return F.when(~skip, match)


def tunnels(adapters: DataFrame) -> DataFrame:
    """The first connected tunnel adapter of every host."""
    a = adapters.where("connected").withColumn("vpn_type", adapter_type(F.col("name"), F.col("description"))).where(F.col("vpn_type").isNotNull())
    return a.groupBy("host").agg(F.min_by(F.struct("name", "vpn_type", "metric"), "idx").alias("t")).select("host", "t.*")


def posture(hosts: DataFrame, adapters: DataFrame, routes: DataFrame, dns: DataFrame, wifi_iface: str = "Wi-Fi") -> DataFrame:
    """Tunnel state per host. `dns` lists resolvers per interface, a handful of rows each."""
    per_iface = dns.groupBy("host", "iface").agg(F.array_sort(F.collect_set("server")).alias("servers"))
    tunnel_dns = per_iface.select("host", F.col("iface").alias("name"), F.col("servers").alias("tunnel_dns"))
    wifi_dns = per_iface.where(F.col("iface") == wifi_iface).select("host", F.col("servers").alias("wifi_dns"))
    default = routes.where((F.col("dest") == "0.0.0.0") & (F.col("mask") == "0.0.0.0")).groupBy("host").agg(
        F.min_by("iface", F.struct("metric", "iface")).alias("default_iface"))
    h = hosts.join(tunnels(adapters), "host", "left").join(tunnel_dns, ["host", "name"], "left").join(wifi_dns, "host", "left").join(default, "host", "left")
    empty = F.array().cast("array<string>")
    h = h.withColumns({"connected": F.col("vpn_type").isNotNull(), "tunnel_dns": F.coalesce("tunnel_dns", empty), "wifi_dns": F.coalesce("wifi_dns", empty)})
    return h.withColumns({
        "dns_leak": F.col("connected") & (F.size("tunnel_dns") == 0) & (F.size("wifi_dns") > 0),
        "default_route": F.col("connected") & F.coalesce(F.col("default_iface") == F.col("name"), F.lit(False))})


def vpn_findings(p: DataFrame) -> DataFrame:
    def row(rule, title, severity):
        return F.struct(F.lit(rule).alias("rule_id"), title.alias("title") if isinstance(title, Column) else F.lit(title).alias("title"), F.lit(severity).alias("severity"))

    up = F.col("connected")
    rules = F.array(
        F.when(up, row("VPN-001", F.concat(F.lit("Active Encrypted "), F.col("vpn_type"), F.lit(" Overlay Tunnel Verified")), "info")),
        F.when(F.col("dns_leak"), row("VPN-002", "Critical DNS Leak Detected (Queries Bypassing VPN Tunnel)", "high"))
        .when(up & (F.size("tunnel_dns") > 0), row("VPN-003", "Encrypted Tunnel DNS Enforced", "info")),
        F.when(up & ~F.col("default_route"), row("VPN-004", "Split Tunneling Active (Partial Route Redirection)", "medium")),
        F.when(~up, row("VPN-010", "Direct Physical Egress (No Virtual VPN Tunnel)", "info")))
    return p.select("host", F.inline(F.array_compact(rules)))
