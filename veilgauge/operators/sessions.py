"""IKE messages to sessions (one per initiator SPI and capture).

Two passes by the same key meet in a join without another exchange: a wide one
with mergeable "value of the earliest message" aggregates and flags, and a slim
one that counts exchanges and resent messages from distinct fingerprints. A
flood of messages on one SPI is combined map-side and never becomes a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import registries as R
from ..functions.net import label

SA = ["capture", "sid"]
ZERO_SPI = "0" * 16
ALARMS = ("NO_PROPOSAL_CHOSEN", "AUTHENTICATION_FAILED", "INVALID_SYNTAX", "INVALID_KE_PAYLOAD")


def _ike_transforms() -> Column:
    """Transforms of a message's first IKE proposal."""
    return F.get(F.filter("proposals", lambda p: p["protocol"] == "IKE"), F.lit(0))["transforms"]


def _family() -> Column:
    known = F.create_map(*[F.lit(x) for kv in R.VENDOR_FAMILY.items() for x in kv])
    return F.get(F.filter(F.transform("vendor_ids", lambda v: known[v]), lambda f: f.isNotNull()), F.lit(0))


MASK_BITS = 62


def group_bits(groups) -> dict[int, tuple[int, int]]:
    """(mask, bit) per policy group; the set of groups seen travels as one long per MASK_BITS groups."""
    return {g: divmod(i, MASK_BITS) for i, g in enumerate(sorted(set(groups)))}


def sessions(messages: DataFrame, policy: R.Policy = R.BASELINE_POLICY) -> DataFrame:
    """One row per handshake with what was offered, what was selected and what was seen."""
    watched = group_bits(policy.dh_prohibited + policy.dh_legacy)
    masks = sorted({word for word, _ in watched.values()})
    bit = {word: F.coalesce(*[F.when(F.col("ke_group") == g, F.lit(1 << i).cast("bigint")) for g, (w, i) in watched.items() if w == word], F.lit(0)) for word in masks}
    order = F.struct("ts_us", "frame")
    weak, weak_group, pq = _offered_by_policy(policy)
    m = messages.withColumnRenamed("initiator_spi", "sid").withColumns({
        "_tr": _ike_transforms(), "_fam": _family(), "_o": order, "_weak": weak, "_grp": weak_group, "_pq": pq, **{f"_bit{w}": b.cast("bigint") for w, b in bit.items()}})
    has_tr = F.col("_tr").isNotNull()
    notified = lambda n: F.array_contains("notifies", n)

    # name -> (value, condition, order): the value of the earliest qualifying message
    earliest = {
        "first": (F.struct("version", "src", "dst"), F.lit(True), F.col("frame")),
        "rspi": (F.col("responder_spi"), F.col("responder_spi") != ZERO_SPI, F.col("frame")),
        # responses sort first: the selection when one was seen, else the earliest offer
        "transforms": (F.col("_tr"), has_tr, F.struct(~F.col("is_response"), "ts_us", "frame")),
        "family": (F.col("_fam"), F.col("_fam").isNotNull(), F.col("_o")),
        "weak_auth": (F.col("auth_method"), F.col("auth_method").isin(*policy.weak_auth), F.col("_o")),
        "long_life": (F.col("lifetime_seconds"), F.col("lifetime_seconds") > policy.max_ike_lifetime, F.col("_o")),
        "lifetime": (F.col("lifetime_seconds"), F.col("lifetime_seconds") > 0, F.col("_o")),
    }
    flags = {
        "confirmed": has_tr & F.col("is_response"),
        "aggressive": F.contains(F.col("exchange"), F.lit("Aggressive")),
        "ppk": notified("USE_PPK") & F.col("is_response"),
        "fragmentation": notified("IKEV2_FRAGMENTATION_SUPPORTED"),
        "short_nonce": F.coalesce(F.col("nonce_len") < 16, F.lit(False)),
        **{f"alarm_{i}": notified(n) for i, n in enumerate(ALARMS)},
    }
    aggs = [F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), *[F.bit_or(f"_bit{w}").alias(f"group_mask{w}") for w in masks],
            F.sum(F.size("parse_errors")).alias("parse_errors")]
    aggs += [F.min_by(value, F.when(cond, by)).alias(name) for name, (value, cond, by) in earliest.items()]
    aggs += [F.max(c).alias(n) for n, c in flags.items()]
    # what was offered against the policy; a set of a session's distinct offers, bounded by the policy tables
    aggs += [F.collect_set(c).alias(c) for c in ("_weak", "_grp")] + [F.max("_pq").alias("pq_offered")]
    # counts are a slim row per session and go into a hash table, so that the wide rows are not sorted once more for the join
    s = m.groupBy(*SA).agg(*aggs).join(message_counts(messages).hint("shuffle_hash"), SA)
    seen_groups = F.filter(F.array(*[
        F.when(F.col(f"group_mask{w}").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, F.lit(g)) for g, (w, i) in watched.items()]),
        lambda g: g.isNotNull())
    return s.select(
        *SA, F.col("first.version").alias("version"), F.col("first.src").alias("peer_a"), F.col("first.dst").alias("peer_b"),
        F.concat_ws(" <-> ", F.col("first.src"), F.col("first.dst")).alias("subject"),
        F.coalesce("rspi", F.lit(ZERO_SPI)).alias("responder_spi"), "messages", "retransmissions", "intermediate_exchanges",
        "followup_exchanges", "first_us", "last_us", "parse_errors", "confirmed", F.when(F.col("confirmed"), F.col("transforms")).alias("selected"), "transforms", seen_groups.alias("ke_groups"),
        F.coalesce("family", F.lit("generic")).alias("vendor_family"), "weak_auth", "long_life", "lifetime",
        "aggressive", "ppk", "fragmentation", "short_nonce", *[f"alarm_{i}" for i in range(len(ALARMS))],
        F.array_distinct(F.flatten("_weak")).alias("weak_offered"), F.array_distinct(F.flatten("_grp")).alias("weak_groups"),
        F.coalesce("pq_offered", F.lit(False)).alias("pq_offered"))


def _offered_by_policy(policy: R.Policy) -> tuple[Column, Column, Column]:
    """Of a request's IKE proposals: labels of prohibited algorithms and ids of prohibited groups, null for none, and whether a post-quantum exchange is among them."""
    offered = F.when(~F.col("is_response"), F.flatten(F.transform(F.filter("proposals", lambda x: x["protocol"] == "IKE"), lambda x: x["transforms"])))
    weak = F.transform(F.filter(offered, lambda t: ((t["type_id"] == 1) & t["name"].isin(*policy.encr_prohibited)) | (
        (t["type_id"] == 3) & t["name"].isin(*policy.integ_prohibited))), lambda t: label(t["name"], t["key_length"]))
    group = F.transform(F.filter(offered, lambda t: (t["type_id"] == 4) & t["value_id"].isin(*policy.dh_prohibited)), lambda t: t["value_id"])
    pq = F.exists(offered, lambda t: t["type_id"].isin(*R.KE_TYPES) & t["value_id"].isin(*policy.dh_pq))
    return F.when(F.size(weak) > 0, weak), F.when(F.size(group) > 0, group), pq


def message_counts(messages: DataFrame) -> DataFrame:
    """Messages, resent messages and exchanges per session.

    A message is resent when (message id, direction, exchange) was seen before.
    """
    m = messages.withColumnRenamed("initiator_spi", "sid")
    # request and response of one message id are one exchange
    ids = m.groupBy(*SA, "exchange", "message_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max(F.col("is_response").cast("int")) + F.max((~F.col("is_response")).cast("int"))).alias("directions"))

    def exchanges(name):
        return F.sum(F.when(F.col("exchange") == name, 1).otherwise(0))

    return ids.groupBy(*SA).agg(
        F.sum("n").alias("messages"), (F.sum("n") - F.sum("directions")).alias("retransmissions"),
        exchanges("IKE_INTERMEDIATE").alias("intermediate_exchanges"), exchanges("IKE_FOLLOWUP_KE").alias("followup_exchanges"))


def session_peers(messages: DataFrame) -> DataFrame:
    """Only the two peers of each session, from its first message."""
    first = messages.groupBy("capture", F.col("initiator_spi").alias("sid")).agg(
        F.min_by(F.struct("src", "dst"), "frame").alias("f"))
    return first.select(*SA, F.col("f.src").alias("peer_a"), F.col("f.dst").alias("peer_b"),
                        F.concat_ws(" <-> ", "f.src", "f.dst").alias("subject"))


def exploded(sessions_df: DataFrame, col: str = "transforms") -> DataFrame:
    """Long form of the negotiated transforms, in proposal order."""
    return sessions_df.select(*SA, "subject", "confirmed", F.posexplode(col).alias("ord", "t")).select(
        *SA, "subject", "confirmed", "ord", "t.*", label(F.col("t.name"), F.col("t.key_length")).alias("label"))


def offered_transforms(messages: DataFrame, distinct: bool = True) -> DataFrame:
    """Distinct transforms of every IKE proposal a session's requests carried; not distinct where the caller makes sets."""
    m = messages.where(~F.col("is_response")).withColumnRenamed("initiator_spi", "sid")
    p = m.select(*SA, F.explode(F.filter("proposals", lambda x: x["protocol"] == "IKE")).alias("p"))
    t = p.select(*SA, F.explode("p.transforms").alias("t"))
    t = t.select(*SA, "t.type_id", "t.type_name", "t.value_id", "t.name", label(F.col("t.name"), F.col("t.key_length")).alias("label"))
    return t.distinct() if distinct else t


def session_lists(messages: DataFrame) -> DataFrame:
    """Distinct vendor ids, notifies and child SPIs of a session in order of first sight, long form."""
    from .posture import positioned

    m = messages.withColumnRenamed("initiator_spi", "sid")
    child = F.transform(F.filter("proposals", lambda p: (p["protocol"] == "ESP") & (p["spi"] != "")), lambda p: p["spi"])
    items = m.select(*SA, "ts_us", "frame", F.explode(F.array(
        F.struct(F.lit("vendor_id").alias("kind"), F.col("vendor_ids").alias("vs")),
        F.struct(F.lit("notify").alias("kind"), F.col("notifies").alias("vs")),
        F.struct(F.lit("child_spi").alias("kind"), child.alias("vs")))).alias("l"))
    items = items.select(*SA, "ts_us", "frame", "l.kind", F.posexplode("l.vs").alias("i", "value"))
    first = items.groupBy(*SA, "kind", "value").agg(F.min(F.struct("ts_us", "frame", "i")).alias("o"))
    return positioned(first, [*SA, "kind"], [F.asc("o")], [F.col("o.ts_us")]).select(*SA, "kind", "value", "pos")


def key_exchange(sessions_df: DataFrame) -> DataFrame:
    """Method and additional exchanges of confirmed selections."""
    extra = F.filter("selected", lambda t: t["type_id"].isin(*R.ADDKE_TYPES) & (t["value_id"] != 0))
    method = F.get(F.filter("selected", lambda t: t["type_id"] == R.KE_TYPE), F.lit(0))
    names = F.transform(extra, lambda t: t["name"])
    return sessions_df.select(
        *SA, "confirmed", method["name"].alias("method"), F.array_join(names, ",").alias("additional"),
        F.coalesce(F.size(extra) > 0, F.lit(False)).alias("hybrid"), "intermediate_exchanges", "followup_exchanges",
        F.concat_ws(" + ", method["name"], F.when(F.size(extra) > 0, F.array_join(names, " + "))).alias("kex_label"))


def weak_residual(messages: DataFrame, policy: R.Policy = R.BASELINE_POLICY) -> DataFrame:
    """(capture, sid, name): prohibited ciphers and integrity algorithms that were offered although another was chosen."""
    weak = offered_transforms(messages).where(
        ((F.col("type_id") == 1) & F.col("name").isin(*policy.encr_prohibited)) | ((F.col("type_id") == 3) & F.col("name").isin(*policy.integ_prohibited)))
    chosen = exploded(sessions(messages, policy)).select("capture", "sid", "label")
    return weak.join(chosen, ["capture", "sid", "label"], "left_anti").select("capture", "sid", "name")


def registry_rows(policy: R.Policy = R.BASELINE_POLICY) -> tuple[list, list]:
    """(type, name, verdict) of the policy and (type, name, bits) of the registries: what a transform is looked up in."""
    verdicts = [(1, n, "prohibited") for n in policy.encr_prohibited] + [(3, n, "prohibited") for n in policy.integ_prohibited] \
        + [(3, n, "legacy") for n in policy.integ_legacy] + [(2, n, "prohibited") for n in policy.prf_prohibited] \
        + [(2, n, "legacy") for n in policy.prf_legacy] + [(4, R.DH[g][0], "prohibited") for g in policy.dh_prohibited] \
        + [(4, R.DH[g][0], "legacy") for g in policy.dh_legacy]
    bits = [(1, n, v[0]) for n, v in R.ENCR_STRENGTH.items()] + [(2, n, v) for n, v in R.PRF_STRENGTH.items()] \
        + [(3, n, v) for n, v in R.INTEG_STRENGTH.items()] + [(k, v[0], v[3]) for v in R.DH.values() for k in R.KE_TYPES]
    return verdicts, bits


def looked_up(transforms: DataFrame, policy: R.Policy = R.BASELINE_POLICY) -> DataFrame:
    """Transforms (type_id, name) with `verdict` of the policy, empty where it has none, and classical `bits`; unknown ones get 112 or 128 by kind."""
    verdicts, bits = registry_rows(policy)
    spark = transforms.sparkSession
    v, b = spark.createDataFrame(verdicts, "type_id int, name string, verdict string"), spark.createDataFrame(bits, "type_id int, name string, bits int")
    default = F.when(F.col("type_id").isin(*R.KE_TYPES), 112).otherwise(128)
    j = transforms.join(F.broadcast(v), ["type_id", "name"], "left").join(F.broadcast(b), ["type_id", "name"], "left")  # fixed registries
    return j.withColumns({"verdict": F.coalesce("verdict", F.lit("")), "bits": F.coalesce("bits", default)})
