"""Cryptographic inventory tables: protocols, algorithms, inferred ESP assets, vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import registries as R
from .exposure import nist_level
from .sessions import exploded

# fixed values of the inventory format
PRIMITIVES = {1: "block-cipher", 2: "prf", 3: "mac", 4: "key-agree"}
HARDWARE = ("cisco", "juniper", "fortinet")


def bom_ref(*parts: Column | str) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit("crypto:"), F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16))


def in_use(df: DataFrame) -> DataFrame:
    """Drop empty additional key exchange slots from exploded transforms."""
    return df.where(~(F.col("type_id").isin(*R.ADDKE_TYPES) & (F.col("value_id") == 0)))


def protocols(s: DataFrame) -> DataFrame:
    return s.select(
        "capture", bom_ref("proto", F.col("subject"), F.col("version")).alias("bom_ref"),
        F.concat(F.lit("IPsec "), F.col("version"), F.lit(": "), F.col("subject")).alias("name"), F.lit("observed").alias("provenance"),
        F.when(F.col("version") == "IKEv2", "2.0").otherwise("1.0").alias("protocol_version"), "vendor_family", "classical_bits",
        "quantum_bits", "quantum_safe", "confirmed", F.when(F.col("hybrid"), F.col("kex_names")).alias("hybrid_names"))


def algorithms(s: DataFrame) -> DataFrame:
    """One asset per (capture, transform label, peer pair), taken from the earliest session."""
    t = in_use(exploded(s)).join(s.select("capture", "sid", "vendor_family"), ["capture", "sid"])
    first = t.groupBy("capture", "label", "subject").agg(F.min_by(
        F.struct("type_id", "type_name", "value_id", "name", "vendor_family"), F.struct("sid", "ord")).alias("x")).select(
        "capture", "label", "subject", "x.*")
    kex = F.col("type_id").isin(*R.KE_TYPES)
    dh = {i: F.create_map(*[F.lit(x) for g, v in R.DH.items() for x in (g, v[i])])[F.col("value_id")] for i in (3, 4, 5)}
    kem = kex & F.coalesce(dh[5] == "ml-kem", F.lit(False))
    prim = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    oid = F.create_map(*[F.lit(x) for kv in R.OIDS.items() for x in kv])
    return first.select(
        "capture", bom_ref("alg", F.col("label"), F.col("subject")).alias("bom_ref"), F.col("label").alias("name"), "subject",
        F.when(kem, "kem").otherwise(F.coalesce(prim[F.when(kex, 4).otherwise(F.col("type_id"))], F.lit("other"))).alias("primitive"),
        F.when(F.col("vendor_family").isin(*HARDWARE), "hardware").otherwise("software").alias("environment"),
        F.when(kex, nist_level(F.coalesce(dh[4], F.lit(0)))).alias("nist_level"),
        F.when(kex, F.coalesce(dh[3], F.lit(0))).alias("classical_level"), oid[F.col("label")].alias("oid"),
        F.lit("observed").alias("provenance"), F.col("type_name").alias("transform_type"))


def esp_assets(classified: DataFrame) -> DataFrame:
    members = F.create_map(*[F.lit(x) for c, (m, _s, _v) in R.FRAMING_CLASSES.items() for x in (c, ", ".join(m))])
    signature = F.create_map(*[F.lit(x) for c, (_m, s, _v) in R.FRAMING_CLASSES.items() for x in (c, s)])
    return classified.select(
        "capture", bom_ref("esp", F.col("flow")).alias("bom_ref"), "flow", F.col("class"), F.lit("inferred").alias("provenance"),
        F.format_string("%.3f", F.col("suite_confidence")).alias("confidence"), members[F.col("class")].alias("candidates"),
        signature[F.col("class")].alias("signature"), "packets")


def vulnerabilities(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isin("critical", "high")).select(
        "capture", bom_ref("vuln", F.col("rule_id"), F.col("subject")).alias("bom_ref"), F.col("rule_id").alias("id"), "severity",
        F.col("title").alias("description"), F.when(F.col("inferred"), "inferred").otherwise("observed").alias("provenance"))


def asset_counts(protocols_df: DataFrame, algorithms_df: DataFrame, esp_df: DataFrame) -> DataFrame:
    parts = [d.groupBy("capture", "provenance").agg(F.count(F.lit(1)).alias("n")) for d in (protocols_df, algorithms_df, esp_df)]
    both = parts[0].union(parts[1]).union(parts[2])
    return both.groupBy("capture").agg(
        F.sum(F.when(F.col("provenance") == "observed", F.col("n")).otherwise(0)).alias("observed"),
        F.sum(F.when(F.col("provenance") == "inferred", F.col("n")).otherwise(0)).alias("inferred"))


def search(components: DataFrame, term: str) -> DataFrame:
    """Components whose name or any property holds the term, case-blind."""
    return components.where(F.contains(F.lower(F.to_json(F.struct(*components.columns))), F.lit(term.lower())))
