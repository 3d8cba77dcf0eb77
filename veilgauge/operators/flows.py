"""ESP packets to flows: statistics, residues, gaps, features.

Packets are reduced in two steps. The first groups by (flow, length) with
primitive aggregates only, so it combines map-side in codegen and a flow that
holds a third of the traffic is spread over its lengths. The second groups the
few thousand (flow, length) rows per flow. Payload bytes never enter a shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window as W, functions as F

from .. import registries as R
from ..functions.framing import flow_name, gcd_of_gaps
from .scan import exact_percentiles, frame_chunk, ordered

KEYS = ["capture", "src", "dst", "spi"]
BUSIEST_PARTS = 16
# the (boundary, residue) pairs the suite catalogue asks about
RESIDUES = sorted({(max(b, 4), (iv + icv) % max(b, 4)) for b, iv, icv in R.SUITES.values()})


def length_counts(packets: DataFrame, keys=KEYS) -> DataFrame:
    """(flow, length) with counts and the parts every flow statistic adds up from."""
    return packets.groupBy(*keys, "length").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        # value of the first packet, kept in one long: frame in the high bits
        F.min(F.col("frame") * 2 + F.col("encapsulated").cast("bigint")).alias("first_frame"),
        F.count("entropy").alias("entropy_n"), F.sum("entropy").alias("entropy_sum"))


def esp_flows(packets: DataFrame, min_packets: int = 1, max_flows: int | None = None) -> DataFrame:
    """One row per (capture, src, dst, spi).

    `lengths` holds the distinct lengths of a flow, at most 65,536 by the IP
    length field. `max_flows` keeps the busiest flows per capture.
    """
    per_length = length_counts(packets)
    agree = [
        F.sum(F.when(F.col("length") % b == r, F.col("n")).otherwise(0)).alias(f"agree_{b}_{r}")
        for b, r in RESIDUES]
    flows = per_length.groupBy(*KEYS).agg(
        F.sum("n").alias("packets"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
        (F.min("first_frame") % 2 == 1).alias("encapsulated"),
        F.sum(F.col("n") * F.col("length")).alias("bytes"), F.min("length").alias("min_length"),
        F.count(F.lit(1)).alias("distinct_lengths"), F.collect_list("length").alias("lengths"),
        F.sum("entropy_n").alias("entropy_samples"), F.sum("entropy_sum").alias("entropy_total"), *agree)
    flows = flows.where(F.col("packets") >= min_packets).select(
        *KEYS, flow_name(F.col("src"), F.col("dst"), F.col("spi")).alias("flow"),
        "packets", "first_us", "last_us", ((F.col("last_us") - F.col("first_us")) / 1e6).alias("seconds"),
        "encapsulated", "bytes", "min_length", "distinct_lengths",
        gcd_of_gaps(F.col("lengths")).alias("granularity"), "entropy_samples",
        F.when(F.col("entropy_samples") >= R.MIN_ENTROPY_SAMPLES,
               F.col("entropy_total") / F.col("entropy_samples")).alias("mean_entropy"),
        *[F.col(f"agree_{b}_{r}") for b, r in RESIDUES])
    return flows if max_flows is None else busiest(flows, max_flows)


def busiest(flows: DataFrame, n: int) -> DataFrame:
    """Keep the n flows of a capture with most packets, latest seen first among equals.

    The n busiest of each of BUSIEST_PARTS parts of a capture are found first, so
    a capture with any number of flows leaves BUSIEST_PARTS x n to the last rank.
    """
    order = [F.desc("packets"), F.desc("last_us"), "src", "dst", "spi"]
    part = flows.withColumn("_part", F.pmod(F.xxhash64("src", "dst", "spi"), F.lit(BUSIEST_PARTS)))
    few = part.withColumn("_rn", F.row_number().over(W.partitionBy("capture", "_part").orderBy(*order))).where(F.col("_rn") <= n)
    return few.withColumn("_rn", F.row_number().over(W.partitionBy("capture").orderBy(*order))).where(F.col("_rn") <= n).drop("_rn", "_part")


def length_residues(packets: DataFrame) -> DataFrame:
    """Residue histograms mod 4, 8 and 16, empty residues as zero rows."""
    per_length = packets.groupBy(*KEYS, "length").agg(F.count(F.lit(1)).alias("n"))
    seen = per_length.select(*KEYS, "length", "n", F.explode(F.array(*[F.lit(m) for m in R.RESIDUE_MODULI])).alias("modulus"))
    seen = seen.groupBy(*KEYS, "modulus", (F.col("length") % F.col("modulus")).alias("residue")).agg(F.sum("n").alias("n"))
    # array of counts per modulus: 4, 8 or 16 slots
    slots = seen.groupBy(*KEYS, "modulus").agg(F.map_from_entries(F.collect_list(F.struct("residue", "n"))).alias("m"))
    return slots.select(
        *KEYS, "modulus", "m", F.explode(F.sequence(F.lit(0), F.col("modulus") - 1)).alias("residue")).select(
        *KEYS, "modulus", F.col("residue").cast("bigint").alias("residue"),
        F.coalesce(F.col("m")[F.col("residue").cast("bigint")], F.lit(0)).alias("packets"))


def sequence_gaps(packets: DataFrame) -> DataFrame:
    """Per flow, packets whose sequence number is not the previous one plus one."""
    jump = lambda prev: F.when(F.col(prev) + 1 != F.col("seq"), 1).otherwise(0)
    rows = W.partitionBy(*KEYS, "_chunk").orderBy("frame")
    inner = packets.select(*KEYS, "frame", "seq", frame_chunk().alias("_chunk")).withColumn("prev", F.lag("seq").over(rows))
    # a chunk keeps its count, inner gaps, first and last number; the borders between chunks are counted on these
    per = inner.groupBy(*KEYS, "_chunk").agg(
        F.count(F.lit(1)).alias("n"), F.sum(jump("prev")).alias("g"), F.min_by("seq", "frame").alias("seq"), F.max_by("seq", "frame").alias("last"))
    per = per.withColumn("prev", F.lag("last").over(W.partitionBy(*KEYS).orderBy("_chunk")))
    return per.groupBy(*KEYS).agg(F.sum("n").alias("packets"), F.sum(F.col("g") + jump("prev")).alias("gaps"))


def inter_arrivals(packets: DataFrame) -> DataFrame:
    """Microseconds since the latest earlier packet of the flow; packets behind it give none."""
    seen = ordered(packets.select(*KEYS, "frame", "ts_us"), KEYS, [F.col("frame")], frame_chunk(),
                   max_before={"latest": "ts_us"})
    return seen.where(F.col("ts_us") >= F.col("latest")).select(
        *KEYS, "frame", (F.col("ts_us") - F.col("latest")).alias("iat_us"))


def sample_caps(packets: DataFrame, max_samples: int = 4000, max_entropy: int = 256) -> DataFrame:
    """Bounded view of a flow: first lengths in arrival order, and first usable entropies."""
    marked = packets.select(*KEYS, "frame", "length", "entropy", F.col("entropy").isNotNull().cast("int").alias("usable"))
    ranked = ordered(marked, KEYS, [F.col("frame")], frame_chunk(), rank="rn", sum_to={"nth": "usable"})
    return ranked.where(F.col("rn") <= max_samples).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("lengths_kept"), F.sum("length").alias("bytes_kept"),
        F.count(F.when(F.col("nth") <= max_entropy, F.col("entropy"))).alias("entropy_kept"))


LENGTH_BINS, MAX_LENGTH = 36, 1600
PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


def flow_features(packets: DataFrame, root: str | None = None) -> DataFrame:
    """88 numeric features per flow, from length counts and inter-arrival counts.

    Order of columns is the model's feature order; FEATURES names them. The
    inter-arrival counts are read three times: with `root`, a folder that all
    executors reach, they are written there once, else they are made three times.
    """
    counts = packets.groupBy(*KEYS, "length").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"),
        F.count("entropy").alias("en"), F.sum("entropy").alias("es"),
        F.sum(F.col("entropy") * F.col("entropy")).alias("es2"), F.min("entropy").alias("emin"))
    n, length = F.col("n"), F.col("length")
    slot = F.least(F.floor(F.least(length, F.lit(MAX_LENGTH)) * LENGTH_BINS / MAX_LENGTH), F.lit(LENGTH_BINS - 1))
    total = F.sum("n")
    shares = [
        (F.sum(F.when(length % m == i, n).otherwise(0)) / total).alias(f"mod{m}_{i}")
        for m in (16, 8, 4) for i in range(m)]
    hist = [(F.sum(F.when(slot == i, n).otherwise(0)) / total).alias(f"lenhist_{i}") for i in range(LENGTH_BINS)]
    mean = F.sum(n * length) / total
    base = counts.groupBy(*KEYS).agg(
        *shares, *hist, total.alias("packets"), mean.alias("len_mean"),
        F.sum(n * length * length).alias("sq"), F.min("length").alias("lo"), F.max("length").alias("hi"),
        F.count(F.lit(1)).alias("uniq"), F.collect_list("length").alias("lengths"),
        (F.sum(F.when(length < 128, n).otherwise(0)) / total).alias("small_pkt_ratio"),
        (F.sum(F.when(length > 1300, n).otherwise(0)) / total).alias("mtu_pkt_ratio"),
        # exact and interpolated; a flow has at most 65,536 lengths to hold
        F.percentile("length", list(PROBS.values()), F.col("n")).alias("quantiles"),
        F.sum("en").alias("en"), F.sum("es").alias("es"), F.sum("es2").alias("es2"), F.min("emin").alias("emin"),
        F.min("t0").alias("t0"), F.max("t1").alias("t1"))

    gaps = inter_arrivals(packets).groupBy(*KEYS, "iat_us").agg(F.count(F.lit(1)).alias("k"))
    if root:
        path = f"{root}/{uuid.uuid4().hex}"
        gaps.write.parquet(path)
        gaps = packets.sparkSession.read.schema(gaps.schema).parquet(path)
    iat = gaps.groupBy(*KEYS).agg(
        F.sum("k").alias("ik"), (F.sum(F.col("k") * F.col("iat_us")) / F.sum("k")).alias("iat_mean_us"),
        F.sum(F.col("k") * (F.col("iat_us") / 1e6) * (F.col("iat_us") / 1e6)).alias("isq"))
    iat_p50 = exact_percentiles(gaps, KEYS, "iat_us", "k", {"iat_p50_us": 0.5}, width=1 << 20)
    bursts = gaps.join(iat, KEYS).groupBy(*KEYS).agg(
        (F.sum(F.when(F.col("iat_us") < F.col("iat_mean_us") * 0.25, F.col("k")).otherwise(0)) / F.sum("k")).alias("burstiness"))

    def spread(sq, mean_col, count):
        var = sq / count - mean_col * mean_col
        return F.when(count > 0, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0)

    zero = F.lit(0.0)
    e_mean = F.when(F.col("en") > 0, F.col("es") / F.col("en")).otherwise(zero)
    i_mean = F.coalesce(F.col("iat_mean_us") / 1e6, zero)
    i_std = F.coalesce(spread(F.col("isq"), i_mean, F.col("ik")), zero)
    joined = base.join(iat, KEYS, "left").join(iat_p50, KEYS, "left").join(bursts, KEYS, "left")
    low = F.col("lo").cast("bigint")
    return joined.select(
        *KEYS, *[F.col(c) for c in SHARE_NAMES],
        F.col("len_mean"), spread(F.col("sq"), F.col("len_mean"), F.col("packets")).alias("len_std"),
        F.col("lo").cast("double").alias("len_min"), F.col("hi").cast("double").alias("len_max"),
        *[F.get("quantiles", F.lit(i)).alias(f"len_{k}") for i, k in enumerate(PROBS)], (F.col("uniq") / F.col("packets")).alias("len_unique_ratio"),
        (F.col("hi") - F.col("lo")).cast("double").alias("len_range"),
        gcd_with(F.col("lengths"), low).cast("double").alias("len_gcd"),
        gcd_of_gaps(F.col("lengths")).cast("double").alias("len_delta_gcd"),
        "small_pkt_ratio", "mtu_pkt_ratio",
        e_mean.alias("entropy_mean"), F.coalesce(spread(F.col("es2"), e_mean, F.col("en")), zero).alias("entropy_std"),
        F.coalesce("emin", zero).alias("entropy_min"),
        i_mean.alias("iat_mean"), i_std.alias("iat_std"), F.coalesce(F.col("iat_p50_us") / 1e6, zero).alias("iat_p50"),
        F.when(i_mean > 1e-9, i_std / i_mean).otherwise(zero).alias("iat_cv"),
        F.coalesce("burstiness", zero).alias("burstiness"),
        (F.col("packets") / F.greatest((F.col("t1") - F.col("t0")) / 1e6, F.lit(1e-6))).alias("packet_rate"),
        F.log1p(F.col("packets").cast("double")).alias("log_packets"))


def gcd_with(lengths, low):
    """GCD of the lengths themselves: of the shortest and the gaps."""
    from ..functions.framing import gcd

    return gcd(gcd_of_gaps(lengths), low)


SHARE_NAMES = [f"mod{m}_{i}" for m in (16, 8, 4) for i in range(m)] + [f"lenhist_{i}" for i in range(LENGTH_BINS)]
FEATURES = SHARE_NAMES + [
    "len_mean", "len_std", "len_min", "len_max", "len_p25", "len_p50", "len_p75", "len_p90", "len_unique_ratio",
    "len_range", "len_gcd", "len_delta_gcd", "small_pkt_ratio", "mtu_pkt_ratio", "entropy_mean", "entropy_std",
    "entropy_min", "iat_mean", "iat_std", "iat_p50", "iat_cv", "burstiness", "packet_rate", "log_packets"]
