"""Links over time: downgrade verdicts, baselines, retention, history.

The reference point of a link changes only when a stronger suite has been seen
`min_observations` times, so it is a short step function of time: at most one
step per distinct bit strength. Verdicts come from building those steps with
aggregates and joining each observation to its link's steps. No window ever
spans all observations of a link, so a hub link with a third of all rows is
handled like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.net import label, peer_key


def observations(strong_sessions: DataFrame) -> DataFrame:
    """Confirmed handshakes as observations; `at` orders them within a link."""
    names = F.array_sort(F.transform("transforms", lambda t: label(t["name"], t["key_length"])))
    dh = F.get(F.filter("transforms", lambda t: t["type_id"] == 4), F.lit(0))["value_id"]
    return strong_sessions.where("confirmed").select(
        F.col("sid").alias("id"), peer_key(F.col("peer_a"), F.col("peer_b")).alias("peer_key"),
        F.col("first_us").alias("observed_us"), "capture", F.col("version").alias("ike_version"), "vendor_family",
        "classical_bits", "quantum_bits", dh.alias("dh_group"), names.alias("transforms"),
        F.struct(F.col("first_us"), F.col("sid")).alias("at"))


def thresholds(obs: DataFrame, min_observations: int) -> DataFrame:
    """(link, bits, due): the moment `bits` or more had been seen min_observations times.

    Only the first min_observations rows per (link, bits) matter; the rank
    filter drops the rest before the shuffle.
    """
    w = W.partitionBy("peer_key", "classical_bits").orderBy("at")
    first = obs.select("peer_key", "classical_bits", "at").withColumn("_rn", F.row_number().over(w)).where(
        F.col("_rn") <= min_observations)
    per_link = first.groupBy("peer_key").agg(F.collect_list(F.struct("classical_bits", "at")).alias("s"))
    return per_link.select("peer_key", "s", F.explode(F.array_distinct(F.transform("s", lambda x: x["classical_bits"]))).alias("classical_bits")).select(
        "peer_key", "classical_bits", F.get(F.array_sort(F.transform(
            F.filter("s", lambda x: x["classical_bits"] >= F.col("classical_bits")), lambda x: x["at"])),
            F.lit(min_observations - 1)).alias("due"))


def baseline_steps(obs: DataFrame, min_observations: int = 2) -> DataFrame:
    """Per link, the reference points in time order as an array (one per strength at most)."""
    point = F.struct("at", "classical_bits", "quantum_bits", "transforms", "id")
    due = thresholds(obs, min_observations).where(F.col("due").isNotNull())
    ready = obs.join(due, ["peer_key", "classical_bits"]).where(F.col("at") >= F.col("due"))
    risen = ready.groupBy("peer_key", "classical_bits").agg(F.min_by(point, "at").alias("p")).select("peer_key", "p")
    opened = obs.groupBy("peer_key").agg(F.min_by(point, "at").alias("p"))
    # candidates per link in time order, keeping those above everything before them
    merged = opened.unionByName(risen).groupBy("peer_key").agg(F.array_sort(F.collect_set("p")).alias("c"))
    return merged.select("peer_key", F.filter(
        "c", lambda x, i: (i == 0) | (x["classical_bits"] > F.array_max(F.transform(
            F.slice("c", F.lit(1), F.greatest(i, F.lit(1))), lambda y: y["classical_bits"])))).alias("steps"))


def verdicts(obs: DataFrame, min_observations: int = 2) -> DataFrame:
    """Label every observation against the reference point in force just before it."""
    steps = baseline_steps(obs, min_observations)
    due = thresholds(obs, min_observations)
    j = obs.join(steps, "peer_key").join(due, ["peer_key", "classical_bits"], "left")
    before = F.filter("steps", lambda s: s["at"] < F.col("at"))
    # `steps` is in time order and rises, so the last one before the row is in force
    j = j.withColumn("base", F.get(before, F.size(before) - 1))
    bits, base = F.col("classical_bits"), F.col("base.classical_bits")
    verdict = (F.when(F.col("base").isNull(), "new")
               .when((bits == base) & (F.col("quantum_bits") < F.col("base.quantum_bits")), "downgrade-quantum")
               .when(bits == base, "steady").when(bits < base, "downgrade")
               .when(F.coalesce(F.col("at") >= F.col("due"), F.lit(False)), "improvement").otherwise("unconfirmed"))
    return j.select(
        *obs.columns, verdict.alias("verdict"), base.alias("baseline_bits"), F.col("base.transforms").alias("baseline_transforms"),
        (bits - base).alias("delta_bits"))


def withhold(judged: DataFrame, obs: DataFrame, known: DataFrame | None = None, max_new_peers: int = 64) -> DataFrame:
    """Verdict `withheld` for observations of new links past the cap of their capture; no row is dropped."""
    past = new_peers(obs, known, max_new_peers).where("withheld").select("capture", "peer_key", "withheld")
    return judged.join(past, ["capture", "peer_key"], "left").withColumn(
        "verdict", F.when(F.col("withheld"), "withheld").otherwise(F.col("verdict"))).drop("withheld")


def baselines(obs: DataFrame, min_observations: int = 2) -> DataFrame:
    """State of every link: best suite, when and by which row it was set, rows seen."""
    totals = obs.groupBy("peer_key").agg(F.count(F.lit(1)).alias("observations"), F.min("observed_us").alias("first_seen_us"))
    best = F.element_at("steps", -1)
    return baseline_steps(obs, min_observations).select(
        "peer_key", best["classical_bits"].alias("best_classical_bits"), best["quantum_bits"].alias("best_quantum_bits"),
        best["transforms"].alias("best_transforms"), best["at"]["first_us"].alias("best_seen_us"), best["id"].alias("best_observation_id")
    ).join(totals, "peer_key")


def new_peers(obs: DataFrame, known: DataFrame | None, max_new_peers: int = 64) -> DataFrame:
    """Links a capture sees for the first time, in order, and whether the cap withholds them."""
    from .posture import positioned

    first = obs.groupBy("capture", "peer_key").agg(F.min("at").alias("at"))
    if known is not None:
        first = first.join(known.select("peer_key"), "peer_key", "left_anti")
    ranked = positioned(first, ["capture"], [F.asc("at")], [F.floor(F.col("at.first_us") / (86400 * 10 ** 6))])
    return ranked.withColumn("withheld", F.col("pos") > max_new_peers)


def latest(obs: DataFrame) -> DataFrame:
    return obs.groupBy("peer_key").agg(F.max_by(F.struct(
        "id", "capture", "observed_us", "classical_bits", "quantum_bits", "transforms", "vendor_family", "ike_version"), "at").alias("o"))


def fleet(obs: DataFrame, base: DataFrame) -> DataFrame:
    """Current state of each link next to its baseline."""
    return base.join(latest(obs), "peer_key").select(
        "peer_key", "best_classical_bits", "best_quantum_bits", "first_seen_us", "observations",
        F.col("o.classical_bits").alias("current_bits"), F.col("o.quantum_bits").alias("current_quantum"),
        F.col("o.observed_us").alias("last_seen_us"), F.col("o.transforms").alias("current_transforms"),
        F.col("o.vendor_family").alias("vendor_family"), F.col("o.ike_version").alias("ike_version"),
        (F.col("o.classical_bits") < F.col("best_classical_bits")).alias("degraded"))


def fleet_summary(view: DataFrame) -> DataFrame:
    def n(c):
        return F.sum(c.cast("bigint"))

    safe = F.col("current_quantum") >= 128
    return view.agg(
        F.count(F.lit(1)).alias("links"), F.sum("observations").alias("observations"), n(F.col("degraded")).alias("degraded"),
        n(F.col("current_bits") < 112).alias("below_112_bits"), n(safe).alias("quantum_safe"), n(~safe).alias("quantum_exposed"),
        F.min("current_bits").alias("weakest_bits"))


def prune(obs: DataFrame, base: DataFrame, now_us: int, keep: int | None = 500, days: float | None = 90, run: str | None = None) -> DataFrame:
    """Rows that stay: recent enough and within the newest `keep`, or protected.

    Protected: the row behind a baseline, the newest row of a baselined link, and
    all rows of the latest assessment. `run` is a column that numbers or dates
    assessments, and all rows of its highest value are protected; without it a
    capture is an assessment, and the capture seen last is the latest. Rows
    are told apart by (capture, id), since an id may occur in two captures. The
    rank filter keeps `keep` rows per link before the shuffle; older rows of a
    hot link never meet in one task.
    """
    row = ["capture", "id"]
    fresh = obs
    if days:
        fresh = fresh.where(F.col("observed_us") >= now_us - int(days * 86400 * 10 ** 6))
    if keep:
        w = W.partitionBy("peer_key").orderBy(F.desc("at"))
        ranked = obs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).select(*row)
        fresh = fresh.join(ranked, row, "left_semi")
    newest = latest(obs).join(base.select("peer_key"), "peer_key", "left_semi").select(F.col("o.capture").alias("capture"), F.col("o.id").alias("id"))
    last = obs.agg(F.max(run).alias("last_run") if run else F.max_by("capture", F.struct("observed_us", "capture")).alias("last_run"))  # one row
    same_run = obs.join(F.broadcast(last), F.col(run or "capture") == F.col("last_run"), "left_semi").select(*row)
    opened = obs.join(base.select("peer_key", F.col("best_observation_id").alias("id"), F.col("best_seen_us").alias("observed_us")), ["peer_key", "id", "observed_us"], "left_semi").select(*row)
    kept = fresh.select(*row).union(opened).union(newest).union(same_run).distinct()
    return obs.join(kept, row, "left_semi")


def history(obs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest rows of every link, newest first."""
    w = W.partitionBy("peer_key").orderBy(F.desc("at"))
    return obs.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit)


def replay(judged: DataFrame, base: DataFrame, limit: int = 1000) -> DataFrame:
    """Newest `limit` rows of baselined links, oldest first, with what changed against the baseline."""
    sizes = judged.groupBy("peer_key").agg(F.count(F.lit(1)).alias("rows"))
    h = history(judged, limit).join(sizes, "peer_key").join(base.select("peer_key"), "peer_key", "left_semi")
    kept = F.least(F.col("rows"), F.lit(limit))
    return changes(h).withColumns({"pos": kept - F.col("pos") + 1, "truncated": F.col("rows") > limit})


def changes(judged: DataFrame) -> DataFrame:
    """Transforms that every observation lost and gained against the baseline before it."""
    return judged.withColumns({
        "removed": F.array_except("baseline_transforms", "transforms"), "added": F.array_except("transforms", "baseline_transforms")})
