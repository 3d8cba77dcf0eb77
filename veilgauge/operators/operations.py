"""Sensor operations: window health and loss, window bounds, retention, rate limits, plans, policy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import registries as R
from .posture import positioned
from .scan import counted_below, frame_chunk, ordered


def window_health(log: DataFrame, now_us: int, stale_after: float | None = None) -> DataFrame:
    """healthy, degraded or failed per sensor by the age of its newest completed window."""
    last = log.groupBy("sensor").agg(F.max("completed_us").alias("completed_us"), F.max_by("window_seconds", "completed_us").alias("window_seconds"))
    age = (F.lit(now_us) - F.col("completed_us")) / 1e6
    limit = F.lit(float(stale_after)) if stale_after is not None else 2.0 * F.col("window_seconds") + 120
    d = last.withColumns({"age_seconds": age, "limit_seconds": limit})
    return d.withColumn("status", F.when(F.col("age_seconds") < -60, "degraded").when(F.col("age_seconds") > 3 * F.col("limit_seconds"), "failed")
                        .when(F.col("age_seconds") > F.col("limit_seconds"), "degraded").otherwise("healthy"))


def overall(health: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "failed", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    return health.agg(F.max(rank).alias("r"), F.count(F.lit(1)).alias("sensors")).select(
        "sensors", F.get(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("failed")), F.col("r")).alias("status"))


def window_loss(log: DataFrame) -> DataFrame:
    return log.withColumn("loss_pct", F.col("dropped") / F.greatest(F.col("packets") + F.col("dropped"), F.lit(1)) * 100)


def close_windows(packets: DataFrame, keys, max_packets: int, max_bytes: int) -> DataFrame:
    """Where each window ends: the first packet that reaches the packet or the byte bound."""
    o = ordered(packets, keys, [F.col("frame")], frame_chunk(), rank="nth", sum_to={"total": "length"})
    # both counts only rise, so a packet is inside when the one before it had reached neither bound
    kept = o.where((F.col("nth") - 1 < max_packets) & (F.col("total") - F.coalesce("length", F.lit(0)) < max_bytes))
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("length").alias("bytes"),
        ((F.sum("length") >= max_bytes) & (F.count(F.lit(1)) < max_packets)).alias("truncated"))


def evidence_to_delete(files: DataFrame, keep: int, max_bytes: int) -> DataFrame:
    """Files to remove per directory: beyond the newest `keep`, or beyond the byte ceiling, never a protected one.

    max_bytes=0 means no ceiling. A file of unknown age counts as the oldest.
    Only window-*.pcap files count. Running totals go newest first, cut into
    days so a directory with millions of files is not one task.
    """
    f = files.where(F.col("name").rlike(r"^window-.*\.pcap$"))
    guard = f.where("protected").groupBy("dir").agg(F.count(F.lit(1)).alias("pn"), F.sum("bytes").alias("pb"))
    free = f.where("NOT protected").withColumn("age", -F.coalesce("mtime_us", F.lit(-(1 << 62))))
    o = ordered(free, ["dir"], [F.col("age"), F.col("name")], F.floor(F.col("age") / (86400 * 10 ** 6)), rank="nth", sum_to={"total": "bytes"})
    o = o.join(guard, "dir", "left").fillna(0, ["pn", "pb"])
    beyond = F.col("nth") > F.greatest(F.lit(keep) - F.col("pn"), F.lit(0))
    if max_bytes:
        beyond |= F.col("total") + F.col("pb") > max_bytes
    return o.where(beyond).select("dir", "name", "bytes")


def rate_guard(events: DataFrame, key: str, ts_us: str, limit: int, seconds: int, chunk_us: int = 60 * 10 ** 6) -> DataFrame:
    """Events of the same key in the last `seconds`, this one included, and whether the limit is passed.

    The count is a difference of two ranks: events up to now, less events
    before the window. Ranks come from running counts over chunks of `chunk_us`,
    so neither a busy key nor a long window meets in one task.
    """
    span = seconds * 10 ** 6
    upto = counted_below(events, [key], ts_us, F.col(ts_us) + 1, "rank_now", chunk_us)
    both = counted_below(upto, [key], ts_us, F.col(ts_us) - (span - 1), "rank_then", chunk_us)
    return both.withColumn("recent", F.col("rank_now") - F.col("rank_then")).withColumn("allowed", F.col("recent") <= limit).drop("rank_now", "rank_then")


def bench_summary(runs: DataFrame, key: str, rate: str) -> DataFrame:
    """Upper median run and range of rates."""
    r = positioned(runs.where(F.col(rate).isNotNull()), [key], [F.asc(rate), F.asc("run")], [F.floor(rate)])
    sizes = runs.groupBy(key).agg(F.count(F.lit(1)).alias("runs"), F.min(rate).alias("low"), F.max(rate).alias("high"))
    return r.join(sizes, key).where(F.col("pos") == F.floor(F.col("runs") / 2) + 1).select(key, F.col(rate).alias("median"), "low", "high", "runs")


# --- plans ----------------------------------------------------------------------
# fixed values: platforms that plans are written for
PLATFORMS = {"cisco": "Cisco IOS / IOS-XE", "strongswan": "strongSwan (swanctl)", "fortinet": "Fortinet FortiOS", "juniper": "Juniper SRX (Junos)"}


def plans(findings: DataFrame, sessions: DataFrame) -> DataFrame:
    """One plan per capture and detected platform with the findings it addresses, counted per severity."""
    seen = sessions.where(F.col("vendor_family").isin(*PLATFORMS)).select("capture", F.col("vendor_family").alias("platform")).distinct()
    todo = findings.where(F.col("severity") != "info").groupBy("capture").agg(
        F.count(F.lit(1)).alias("findings"), F.sum((F.col("severity") == "critical").cast("bigint")).alias("critical"))
    names = F.create_map(*[F.lit(x) for kv in PLATFORMS.items() for x in kv])
    p = todo.join(seen, "capture", "left").withColumn("platform", F.coalesce("platform", F.lit("strongswan")))
    return p.withColumns({"platform_name": names[F.col("platform")], "status": F.lit("PENDING_REVIEW")})


def merge_plans(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New plans keep id, status and approver of an existing plan for the same capture and platform."""
    e = existing.select("capture", "platform", "plan_id", F.col("status").alias("old_status"), "approver")
    return new.join(e, ["capture", "platform"], "left").withColumn("status", F.coalesce("old_status", "status")).drop("old_status")


def plan_status(transitions: DataFrame) -> DataFrame:
    """Newest state per plan; the approver comes from approvals only."""
    return transitions.groupBy("plan_id").agg(
        F.max_by("to_state", "id").alias("status"), F.max_by(F.when(F.col("to_state") == "APPROVED", F.col("actor")), F.when(
            F.col("to_state") == "APPROVED", F.col("id"))).alias("approver"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("transitions"))


# --- policy tables ------------------------------------------------------------------
def policy_table(spark, policy: R.Policy = R.BASELINE_POLICY) -> DataFrame:
    """The policy as rows (setting, key); scalars keep their value as the key."""
    rows = []
    for setting, (attr, kind) in R.POLICY_FIELDS.items():
        value = getattr(policy, attr)
        rows += [(setting, str(value))] if kind == "scalar" else [(setting, str(v)) for v in value]
    return spark.createDataFrame(rows, "setting string, key string")


def check_overlay(rows: DataFrame) -> DataFrame:
    """Overlay rows (setting, value) with a problem when the setting or the type of its value is wrong."""
    kinds = F.create_map(*[F.lit(x) for s, (_a, k) in R.POLICY_FIELDS.items() for x in (s, k)])
    kind = kinds[F.col("setting")]
    number = F.col("value").rlike(r"^-?\d+$")
    return rows.withColumn("problem", F.when(kind.isNull(), "unknown setting").when((kind == "scalar") & ~number, "not an integer")
                           .when((kind == "group") & ~number, "group is not a number"))


def merge_policy(base: DataFrame, overlay: DataFrame, replace_tables: bool = False) -> DataFrame:
    """Base extended by overlay rows; scalars are replaced, and tables too when asked for."""
    scalars = [s for s, (_a, k) in R.POLICY_FIELDS.items() if k == "scalar"]
    o = overlay.select("setting", "key", F.lit("overlay").alias("origin")).distinct()
    swapped = o.select("setting").distinct() if replace_tables else o.where(F.col("setting").isin(*scalars)).select("setting").distinct()
    b = base.join(F.broadcast(swapped), "setting", "left_anti").withColumn("in_base", F.lit(True))
    return b.join(o, ["setting", "key"], "full_outer").select("setting", "key", F.coalesce("origin", F.lit("base")).alias("origin"))


def safe_text(text: Column, limit: int = 120) -> Column:
    """Control characters to spaces, runs of spaces to one, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))
