"""Harvest-now-decrypt-later exposure of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import registries as R


def mosca_gap(secrecy, migration, crqc) -> Column | float:
    """Years past (positive) or before (negative) the deadline; operand order matters for exact doubles."""
    return (secrecy + migration) - crqc


def exposure(s: DataFrame, data_class: str = "official", migration_years: float = 3.0, crqc_years: float = R.CRQC_YEARS) -> DataFrame:
    """One row per session with volume: index, rate, and why. Safe links score 0."""
    gap = mosca_gap(R.SECRECY_YEARS.get(data_class, R.SECRECY_YEARS["official"]), migration_years, crqc_years)
    volume = 1.0 + F.sqrt(F.col("observed_bytes") / 1e9)
    weakness = F.greatest(F.lit(1.0), F.lit(128.0) / F.greatest(F.col("classical_bits"), F.lit(8)))
    urgency = max(0.5, 1.0 + gap / 10.0)
    rate = F.when(F.col("observed_seconds") > 0, F.try_divide(F.col("observed_bytes") * 8 / 1e6, F.col("observed_seconds"))).otherwise(0.0)
    why = (F.when(F.col("quantum_safe"), "safe").when(F.col("uncredited"), "offer not confirmed")
           .when(F.col("kex_quantum_bits") >= 128, "cipher is the limit").otherwise("classical key exchange"))
    return s.where(F.col("transforms").isNotNull()).select(
        "capture", "sid", "subject", "classical_bits", "quantum_bits", "kex_family", "quantum_safe", "kex_quantum_bits", "hybrid",
        "observed_bytes", F.round(rate, 2).alias("harvest_rate_mbps"),
        F.when(F.col("quantum_safe"), 0.0).otherwise(F.round(volume * weakness * urgency, 2)).alias("exposure_index"),
        F.lit(round(gap, 1)).alias("mosca_gap_years"), why.alias("why"))


def prioritised(e: DataFrame) -> DataFrame:
    """Rank within a capture: most exposed first, then weakest, then session id."""
    from .posture import positioned

    order = [F.desc("exposure_index"), F.asc("classical_bits"), F.asc("sid")]
    return positioned(e, ["capture"], order, [-F.floor(F.col("exposure_index") * 16)]).withColumnRenamed("pos", "priority")


def phase_of() -> Column:
    """Migration phase of an exposed link; null when safe."""
    return (F.when(F.col("quantum_safe"), None).when(F.col("classical_bits") < 112, 1)
            .when(F.col("kex_quantum_bits") >= 128, 4).when(F.col("classical_bits") < 128, 2).otherwise(3))


def phases(e: DataFrame) -> DataFrame:
    """Links per phase, counts rather than lists: a phase may hold most of the fleet."""
    p = e.withColumn("phase", phase_of()).where(F.col("phase").isNotNull())
    per = p.groupBy("capture", "phase", "subject").agg(F.count(F.lit(1)).alias("n"), F.sum("observed_bytes").alias("b"))
    return per.groupBy("capture", "phase").agg(
        F.sum("n").alias("sessions"), F.count(F.lit(1)).alias("links"), F.sum("b").alias("bytes"))


def summary(e: DataFrame) -> DataFrame:
    exposed = ~F.col("quantum_safe")
    return e.groupBy("capture").agg(
        F.count(F.lit(1)).alias("links_assessed"), F.sum(exposed.cast("bigint")).alias("quantum_exposed"),
        F.sum((~exposed).cast("bigint")).alias("quantum_safe"),
        F.sum(F.when(exposed, F.col("observed_bytes")).otherwise(0)).alias("bytes_harvestable"),
        F.round(F.sum(F.when(exposed, F.col("harvest_rate_mbps")).otherwise(0.0)), 2).alias("harvest_rate_mbps"))


def harvested(base_bytes: Column, rate_mbps: Column, elapsed_ms: Column) -> Column:
    return base_bytes + rate_mbps * 1e6 / 8 * (F.greatest(elapsed_ms, F.lit(0)) / 1000)


def deadline(gap: Column) -> Column:
    """'2 yr 06 mo' of the absolute gap, 'under 1 month' near zero."""
    months = F.round(F.abs(gap) * 12).cast("int")
    return F.when(months == 0, "under 1 month").otherwise(
        F.format_string("%d yr %02d mo", F.floor(months / 12).cast("int"), months % 12))


def nist_level(quantum_bits: Column) -> Column:
    return F.when(quantum_bits >= 256, 5).when(quantum_bits >= 192, 3).when(quantum_bits >= 128, 1).otherwise(0)
