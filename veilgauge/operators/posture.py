"""Findings to scores: statistics, grades, groups, links, digests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import registries as R
from .scan import ordered


def positioned(df: DataFrame, keys, order, chunk) -> DataFrame:
    """Add `pos`, the 1-based place in the sort order within `keys`.

    `chunk` is a list of Columns that never decrease along the order, so a hot
    key is ranked piece by piece (see scan.ordered).
    """
    d = df.withColumn("_p", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(chunk)]))
    sizes = d.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_p", F.lit(0).alias("_row"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    both = d.withColumn("_row", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    w = W.partitionBy(*keys, "_p").orderBy("_row", *order).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("pos", F.sum(F.coalesce("_n0", "_row")).over(w)).where("_row = 1").drop("_p", "_row", "_n0")


def positioned_by_range(df: DataFrame, keys, order, root: str, partitions: int | None = None, distinct: bool = False) -> DataFrame:
    """Add `pos` as positioned does, by pieces that Spark's range partitioning samples from the order itself.

    For orders that no column cuts evenly, such as names with a common prefix: a
    key of most rows is split wherever its rows are, into pieces of like size.
    Rows move once. The pieces are sorted and written below `root` with their rows numbered, and how many
    rows of a key lie before a piece is written too: a row per key and piece, which Spark broadcasts
    where the file is small. `distinct` drops equal rows on the way; then the order must name every column, or columns that stand for it.
    """
    wanted = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(partitions, *wanted) if partitions else df.repartitionByRange(*wanted)
    ranged = ranged.distinct() if distinct else ranged
    path, starts = f"{root}/{uuid.uuid4().hex}", f"{root}/{uuid.uuid4().hex}"
    # numbers run on within a piece and never decrease from piece to piece
    ranged.sortWithinPartitions(*wanted).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).write.parquet(path)
    cut = df.sparkSession.read.parquet(path)
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of"), offset.alias("_offset")).write.parquet(starts)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    placed = cut.join(df.sparkSession.read.parquet(starts), [F.col("_part") == F.col("_of"), *same])
    return placed.select(*df.columns, (F.col("_at") + F.col("_offset")).alias("pos"))


def capture_stats(classed: DataFrame, min_packets: int = 8, sessions: DataFrame | None = None) -> DataFrame:
    """Packets read, by class, flows tracked and assessed, and the span of a capture.

    With `sessions`, also the key exchanges of the capture and the parse errors
    of their messages; a capture known by its sessions alone has no packets and no span.
    """
    def n(*classes):
        return F.sum(F.col("pkt_class").isin(*classes).cast("bigint"))

    totals = classed.groupBy("capture").agg(
        F.count(F.lit(1)).alias("packets_read"), n("ike").alias("ike_messages"), n("esp", "esp_natt").alias("esp_packets"),
        n("other", "keepalive").alias("other_packets"),
        F.round((F.max("ts_us") - F.min("ts_us")) / 1e6, 3).alias("capture_seconds"))
    flows = classed.where(F.col("pkt_class").isin("esp", "esp_natt")).groupBy(
        "capture", "src", "dst", F.hex(F.substring("payload", 1, 4)).alias("spi")).agg(F.count(F.lit(1)).alias("n"))
    flows = flows.groupBy("capture").agg(
        F.count(F.lit(1)).alias("flows_tracked"), F.sum((F.col("n") >= min_packets).cast("bigint")).alias("flows_assessed"))
    full = totals.join(flows, "capture", "left").fillna(0, ["flows_tracked", "flows_assessed"])
    if sessions is None:
        return full
    held = sessions.groupBy("capture").agg(F.count(F.lit(1)).alias("ike_sessions"), F.sum("parse_errors").alias("parse_errors"))
    return full.join(held, "capture", "full_outer").fillna(0, [c for c in [*full.columns, "ike_sessions", "parse_errors"] if c not in ("capture", "capture_seconds")])


def evidence_fields(findings: DataFrame) -> DataFrame:
    """(capture, rule_id, subject, field, value): what each finding rests on, a row per field; values are text.

    A field without a value has no row, and neither has a finding without evidence.
    """
    held = F.from_json("evidence", "map<string,string>")
    told = findings.select("capture", "rule_id", "subject", F.explode(held).alias("field", "value"))
    return told.where(F.col("value").isNotNull())


def throughput(stats: DataFrame, min_packets: int = 10_000) -> DataFrame:
    """Packets per second, or null with a reason when a capture is too small to say."""
    ok = (F.col("packets_read") >= min_packets) & (F.col("processing_seconds") > 0)
    return stats.withColumn("measurable", ok).withColumn(
        "packets_per_second", F.when(ok, F.round(F.try_divide("packets_read", "processing_seconds"), 1))).withColumn(
        "note", F.when(~ok, F.concat(F.lit("below "), F.lit(min_packets), F.lit(" packets"))))


# --- findings ---------------------------------------------------------------------
def rank_of(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (_w, r) in R.SEVERITY.items() for x in (k, r)])[severity]


def weight_of(severity: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, (w, _r) in R.SEVERITY.items() for x in (k, w)])[severity]


def name_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(k) for k in R.SEVERITY]), rank)


def severity_counts(findings: DataFrame, keys=("capture",)) -> DataFrame:
    """Findings per severity, zeros included; one map-side combined pass."""
    return findings.groupBy(*keys).agg(
        *[F.sum((F.col("severity") == s).cast("bigint")).alias(s) for s in R.SEVERITY], F.count(F.lit(1)).alias("findings"))


def posture(captures: DataFrame, findings: DataFrame) -> DataFrame:
    """Score 0-100 and grade per capture; a capture without findings scores 100.

    Penalty: severity weight x (1 + (n - 1) / 3, at most 3); score 100 exp(-penalty / 75).
    """
    counts = captures.select("capture").distinct().join(severity_counts(findings), "capture", "left").fillna(0)
    penalty = sum(
        (F.when(F.col(s) > 0, F.lit(float(w)) * F.least(1 + (F.col(s) - 1) / 3.0, F.lit(3.0))).otherwise(0.0)
         for s, (w, _r) in R.SEVERITY.items()), F.lit(0.0))
    scored = counts.withColumn("score", F.round(100 * F.exp(-penalty / 75.0)).cast("int"))
    return scored.withColumn("grade", grade_of(F.col("score")))


def grade_of(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("E")


def report_digest(findings: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over the sorted 'rule:subject' texts joined by '|'.

    SHA-256 is sequential, so each capture's keys pass one hasher in order; they
    move once, are reduced to distinct keys with counts where their capture lies
    and streamed batch by batch with constant memory.
    """
    keys = findings.select("capture", F.concat_ws(":", "rule_id", "subject").alias("k")).repartition("capture")
    ordered_rows = keys.groupBy("capture", "k").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("capture", "k")

    def stream(batches):
        import hashlib

        import pandas as pd

        current, state, first = None, None, True
        for b in batches:
            done = []
            for capture, k, n in zip(b["capture"], b["k"], b["n"]):
                if capture != current:
                    if current is not None:
                        done.append((current, state.hexdigest()[:16]))
                    current, state, first = capture, hashlib.sha256(), True
                one = k.encode()
                for _ in range(int(n)):
                    if not first:
                        state.update(b"|")
                    state.update(one)
                    first = False
            if done:
                yield pd.DataFrame(done, columns=["capture", "digest"])
        if current is not None:
            yield pd.DataFrame([(current, state.hexdigest()[:16])], columns=["capture", "digest"])

    return ordered_rows.mapInPandas(stream, "capture string, digest string")


GROUP = ["capture", "rule_id", "title"]


def group_subjects(findings: DataFrame) -> DataFrame:
    """Distinct subjects of every (capture, rule, title) group, long form."""
    return findings.groupBy(*GROUP, "subject").agg(
        F.count(F.lit(1)).alias("n"), F.min(rank_of(F.col("severity"))).alias("rank"), F.max("inferred").alias("inferred"))


def finding_groups(findings: DataFrame) -> DataFrame:
    """One row per (capture, rule, title): count, worst severity, subjects, whether any was inferred."""
    return group_subjects(findings).groupBy(*GROUP).agg(
        F.sum("n").alias("count"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("subjects"),
        F.max("inferred").alias("inferred")).withColumn("severity", name_of(F.col("rank")))


def with_link(findings: DataFrame) -> DataFrame:
    """Add the link named by a finding's subject, null when it names none."""
    from ..functions.net import add_link, subject_peer

    return add_link(findings, subject_peer(F.col("subject"), 0), subject_peer(F.col("subject"), 1))


PAIR = ["capture", "_p", "_q"]


def _paired(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Add two addresses as _p and _q in textual order, both null when either is null."""
    from .packets import pinned

    d = pinned(df, _a=a, _b=b)
    known = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return d.withColumns({"_p": F.when(known, F.least("_a", "_b")), "_q": F.when(known, F.greatest("_a", "_b"))}).drop("_a", "_b")


def links(sessions: DataFrame | None, flows: DataFrame | None, findings: DataFrame) -> DataFrame:
    """One row per unordered peer pair with a session or a flow.

    Sessions, flows and findings meet under the two addresses in textual order, so each moves once, as
    one row per pair and task; the link's name, which is as good a key, is made of the rows that are left.
    """
    from ..functions.net import add_link, subject_peer

    unknown = F.lit(None).cast("struct<classical_bits:int,quantum_bits:int,kex_family:string,hybrid:boolean>")
    parts = []
    if sessions is not None:
        weakest = F.when(F.col("kex_family") != "unknown", F.struct("classical_bits", "quantum_bits", "kex_family", "hybrid"))
        parts.append(_paired(sessions, F.col("peer_a"), F.col("peer_b")).select(*PAIR, F.lit(1).alias("s"), F.lit(0).alias("t"), weakest.alias("weakest")))
    if flows is not None:
        parts.append(_paired(flows, F.col("src"), F.col("dst")).select(*PAIR, F.lit(0).alias("s"), F.lit(1).alias("t"), unknown.alias("weakest")))
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    both = both.groupBy(*PAIR).agg(F.sum("s").alias("sessions"), F.sum("t").alias("tunnels"), F.min("weakest").alias("weakest"))
    named = _paired(findings.select("capture", "subject", "severity"), subject_peer(F.col("subject"), 0), subject_peer(F.col("subject"), 1))
    counts = severity_counts(named.where(F.col("_p").isNotNull()), PAIR)
    j = add_link(both.join(counts, PAIR, "left"), F.col("_p"), F.col("_q")).fillna(0, [*R.SEVERITY, "findings"])
    worst = F.coalesce(*[F.when(F.col(s) > 0, F.lit(s)) for s in R.SEVERITY])
    return j.select(
        "capture", "link", "sessions", "tunnels", (F.col("tunnels") > 1).alias("pooled"), "findings", *R.SEVERITY,
        worst.alias("worst_severity"), "weakest.classical_bits", "weakest.quantum_bits", "weakest.kex_family",
        F.coalesce("weakest.hybrid", F.lit(False)).alias("hybrid"))


def unlinked(findings: DataFrame, links_df: DataFrame) -> DataFrame:
    return with_link(findings).join(links_df.select("capture", "link"), ["capture", "link"], "left_anti").drop("link")


def groups_of_link(findings: DataFrame) -> DataFrame:
    """Rule groups restricted to each link's own findings."""
    f = with_link(findings).where(F.col("link").isNotNull())
    return f.groupBy("capture", "link", "rule_id", "title").agg(
        F.count(F.lit(1)).alias("count"), F.min(rank_of(F.col("severity"))).alias("rank")).withColumn(
        "severity", name_of(F.col("rank")))
