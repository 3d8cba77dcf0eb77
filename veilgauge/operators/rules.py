"""Audit rules. A rule is an expression over a session row, a flow row, or a value reused within a capture.

Rules return arrays of finding structs. All enabled rules are
concatenated into one array and exploded once, so twenty rules read their table
once. Add a rule with the decorators; a user's rule needs no change here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import registries as R
from ..functions.net import add_link, label
from .packets import pinned
from .sessions import ALARMS, SA, session_peers, sessions
from .strength import attribute_volume, session_strength, sweet32

SESSION_RULES: dict[str, Callable[[R.Policy], Column]] = {}
FLOW_RULES: dict[str, Callable[[R.Policy], Column]] = {}
CAPTURE_RULES: dict[str, Callable[[R.Policy], Column]] = {}


def session_rule(rule_id: str):
    return lambda fn: SESSION_RULES.setdefault(rule_id, fn)


def flow_rule(rule_id: str):
    return lambda fn: FLOW_RULES.setdefault(rule_id, fn)


def capture_rule(rule_id: str):
    return lambda fn: CAPTURE_RULES.setdefault(rule_id, fn)


def text(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finding(rule_id: str, title, severity, detail, evidence: dict | None = None, inferred: bool = False) -> Column:
    ev = [v.cast("string").alias(k) for k, v in (evidence or {}).items()]
    return F.struct(
        F.lit(rule_id).alias("rule_id"), text(title).alias("title"), text(severity).alias("severity"),
        text(detail).alias("detail"), (F.to_json(F.struct(*ev)) if ev else F.lit("{}")).alias("evidence"),
        F.lit(inferred).alias("inferred"))


def when_one(cond: Column, f: Column) -> Column:
    return F.when(cond, F.array(f))


def for_each(items: Column, pick: Callable[[Column], Column]) -> Column:
    return F.filter(F.transform(items, pick), lambda f: f.isNotNull())


def of_type(type_id: int) -> Column:
    return F.filter("transforms", lambda t: t["type_id"] == type_id)


def selected_kex() -> Column:
    return F.filter("selected", lambda t: t["type_id"].isin(*R.KE_TYPES) & (t["value_id"] != 0))


# --- session rules (titles are fixed values: findings group by them) -----------------
@session_rule("IKE-001")
def _(p):
    return when_one(F.col("version") == "IKEv1", finding(
        "IKE-001", "IKEv1 in use", "high", "negotiated with IKEv1", {"version": F.col("version"), "spi": F.col("sid")}))


@session_rule("IKE-002")
def _(p):
    return when_one(F.col("aggressive"), finding("IKE-002", "IKEv1 Aggressive Mode", "critical", "aggressive exchange seen"))


@session_rule("IKE-003")
def _(p):
    return when_one(F.col("weak_auth").isNotNull(), finding(
        "IKE-003", F.concat(F.lit("Pre-shared key authentication ("), F.col("weak_auth"), F.lit(")")), "medium",
        "shared secret authentication", {"auth_method": F.col("weak_auth")}))


@session_rule("IKE-004")
def _(p):
    def one(t):
        name = label(t["name"], t["key_length"])
        return F.when(t["name"].isin(*p.encr_prohibited), finding(
            "IKE-004", F.concat(F.lit("Prohibited IKE encryption algorithm: "), name), "critical", "cipher is withdrawn",
            {"transform": name})).when((t["key_length"] > 0) & (t["key_length"] < p.min_key_bits), finding(
                "IKE-004", F.concat(F.lit("Undersized key length: "), name), "high", "key below the floor",
                {"transform": name}))

    return for_each(of_type(1), one)


def _verdict_rule(type_id, prohibited, legacy, what, low):
    def one(t):
        return F.when(t["name"].isin(*prohibited), finding(
            "IKE-005", F.concat(F.lit(f"Prohibited {what}: "), t["name"]), "high", f"{what} is withdrawn", {"transform": t["name"]})
        ).when(t["name"].isin(*legacy), finding(
            "IKE-005", F.concat(F.lit(f"Deprecated {what}: "), t["name"]), low, f"{what} is being phased out", {"transform": t["name"]}))

    return for_each(of_type(type_id), one)


@session_rule("IKE-005")
def _(p):
    return F.concat(
        F.coalesce(_verdict_rule(3, p.integ_prohibited, p.integ_legacy, "integrity algorithm", "medium"), F.array()),
        F.coalesce(_verdict_rule(2, p.prf_prohibited, p.prf_legacy, "PRF", "low"), F.array()))


@session_rule("IKE-006")
def _(p):
    names = F.create_map(*[F.lit(x) for g, v in R.DH.items() for x in (g, v[0])])
    groups = F.array_distinct(F.concat(
        F.coalesce(F.transform(of_type(4), lambda t: t["value_id"]), F.array().cast("array<int>")), F.col("ke_groups")))

    def one(g):
        name = F.concat(g.cast("string"), F.lit(" ("), F.coalesce(names[g], F.concat(F.lit("GROUP_"), g)), F.lit(")"))
        return F.when(g.isin(*p.dh_prohibited), finding(
            "IKE-006", F.concat(F.lit("Prohibited Diffie-Hellman group "), name), "critical", "group is too small", {"group": g})
        ).when(g.isin(*p.dh_legacy), finding(
            "IKE-006", F.concat(F.lit("Deprecated Diffie-Hellman group "), name), "high", "group is near the floor", {"group": g}))

    return for_each(F.filter(groups, lambda g: g != 0), one)


@session_rule("IKE-007")
def _(p):
    pq = F.coalesce(F.exists(selected_kex(), lambda t: t["value_id"].isin(*p.dh_pq)), F.lit(False))
    detail = (F.when(F.col("pq_offered") & F.col("confirmed"), "a post-quantum exchange was offered and declined")
              .when(F.col("pq_offered"), "a post-quantum exchange was offered, no answer was seen")
              .otherwise("key agreement is classical only"))
    return when_one(~pq & ~F.col("ppk"), finding(
        "IKE-007", "No quantum-resistant key establishment", "medium", detail,
        {"ppk": F.col("ppk"), "responder_confirmed": F.col("confirmed"), "pq_offered": F.col("pq_offered"),
         "intermediate_exchanges_seen": F.col("intermediate_exchanges")}))


@session_rule("IKE-008")
def _(p):
    chosen = F.coalesce(F.transform("transforms", lambda t: label(t["name"], t["key_length"])), F.array().cast("array<string>"))
    residual = F.array_except(F.coalesce("weak_offered", F.array().cast("array<string>")), chosen)
    groups = F.coalesce(F.transform("weak_groups", lambda g: F.concat(F.lit("DH group "), g)), F.array().cast("array<string>"))
    return when_one((F.size(residual) > 0) | (F.size(groups) > 0), finding(
        "IKE-008", "Broken transforms remain in the proposal set", "medium", "weak options are still offered",
        {"residual": F.array_join(F.array_sort(F.concat(residual, groups)), ", ")}))


@session_rule("IKE-009")
def _(p):
    hours = F.format_string("%.1f", F.col("long_life") / 3600.0)
    return when_one(F.col("long_life").isNotNull(), finding(
        "IKE-009", F.concat(F.lit("Excessive SA lifetime ("), hours, F.lit(" hours)")), "medium", "rekey interval is too long",
        {"lifetime_seconds": F.col("long_life")}))


@session_rule("IKE-010")
def _(p):
    seen = F.filter(F.array(*[F.when(F.col(f"alarm_{i}"), F.lit(n)) for i, n in enumerate(ALARMS)]), lambda x: x.isNotNull())
    return when_one(F.size(seen) > 0, finding(
        "IKE-010", "Repeated negotiation failures observed", "medium", "failure notifies seen",
        {"notifies": F.array_join(seen, ", ")}))


@session_rule("IKE-011")
def _(p):
    return when_one((F.col("version") == "IKEv2") & ~F.col("fragmentation"), finding(
        "IKE-011", "IKEv2 fragmentation not negotiated", "low", "no fragmentation support announced"))


@session_rule("IKE-012")
def _(p):
    bits = F.col("classical_bits")
    parts = {"encryption": "enc_bits", "prf": "prf_bits", "integrity": "integ_bits", "key_exchange": "kex_bits"}
    weakest = F.coalesce(*[F.when(F.col(c) == bits, F.lit(n)) for n, c in parts.items()])
    return when_one(F.col("transforms").isNotNull() & (bits < 112), finding(
        "IKE-012", F.concat(F.lit("Association provides only "), bits, F.lit("-bit security")),
        F.when(bits < 80, "critical").otherwise("high"), F.concat(F.lit("bounded by "), weakest),
        {"weakest": weakest, "classical_bits": bits, "quantum_bits": F.col("quantum_bits"), "grade": F.col("grade")}))


@session_rule("IKE-013")
def _(p):
    state = F.when(F.col("exceeds"), "already exceeds").when(F.col("ratio") > 0.1, "approaches").otherwise("remains below")
    return when_one(F.col("exceeds").isNotNull(), finding(
        "IKE-013", F.concat(F.lit("64-bit block cipher "), state, F.lit(" the Sweet32 birthday bound")),
        F.when(F.col("exceeds"), "critical").when(F.col("ratio") > 0.1, "high").otherwise("medium"),
        "bytes per key against the birthday bound of the block size",
        {c: F.col(c) for c in ("threshold_gb", "rate_mbps", "per_rekey_gb", "ratio", "seconds_to_limit")}))


@session_rule("IKE-014")
def _(p):
    extra = F.filter(selected_kex(), lambda t: t["type_id"].isin(*R.ADDKE_TYPES))
    names = F.transform(extra, lambda t: F.concat_ws("=", t["type_name"], t["name"]))
    return when_one((F.size(extra) > 0) & (F.col("intermediate_exchanges") == 0), finding(
        "IKE-014", "Additional key exchange negotiated but not observed", "info", "agreed exchange was not seen",
        {"addke_selected": F.array_join(names, ", ")}))


@session_rule("IKE-016")
def _(p):
    return when_one((F.col("version") == "IKEv2") & F.col("short_nonce"), finding(
        "IKE-016", "Nonce shorter than 128 bits", "high", "a nonce is below 16 bytes"))


# --- capture rules ----------------------------------------------------------------
VALUE = ["capture", "kind", "who", "digest"]


def carried_values(messages: DataFrame) -> DataFrame:
    """(capture, kind, who, digest, sid, src, seen): key exchange values per sender and nonces per capture, with the SAs that carry them."""
    return _items(messages).groupBy(*VALUE, "sid", "src").agg(F.min("frame").alias("seen"))


def _items(messages: DataFrame) -> DataFrame:
    kinds = F.array(
        F.struct(F.lit("ke").alias("kind"), F.col("src").alias("who"), F.col("ke_digest").alias("digest")),
        F.struct(F.lit("nonce").alias("kind"), F.lit("").alias("who"), F.col("nonce_digest").alias("digest")))
    m = messages.withColumnRenamed("initiator_spi", "sid")
    return m.select(*SA, "src", "frame", F.inline(kinds)).where(F.col("digest").isNotNull())


def reused_values(carried: DataFrame) -> DataFrame:
    """(capture, kind, who, digest, sas, senders) of the values that two or more SAs carry.

    Each count is a distinct and a plain count, so a value that many SAs carry
    is spread over its SAs and senders before it is counted.
    """
    sas = carried.groupBy(*VALUE, "sid").agg(F.lit(1)).groupBy(*VALUE).agg(F.count(F.lit(1)).alias("sas")).where(F.col("sas") >= 2)
    senders = carried.groupBy(*VALUE, "src").agg(F.lit(1)).groupBy(*VALUE).agg(F.count("src").alias("senders"))
    return sas.join(senders, VALUE)


def reuse_table(messages: DataFrame, peers: DataFrame | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """Key exchange values and nonces carried by two or more SAs, one row per (value, link).

    Both kinds go through one pass. A value that one SA carries is dropped by its
    hash before any value moves; the rest are counted exactly.
    Peers are looked up for the hit SAs only; one session, the earliest, stands
    for each link. No pair of sessions is formed. `peers`, the session table,
    saves looking the peers up in the messages again. `keep` writes a table and
    reads it back: Spark then knows how few hashes and values are left and does
    not move all values to meet them, nor make the messages once more.
    """
    packed = ["capture", "kind", "who", "packed"]
    items = _items(messages).select("capture", "kind", "who", _pack(F.col("digest")).alias("packed"), "sid", "frame").withColumn("_h", F.xxhash64(*packed))
    # one row per SA and hash, made where the messages of a session lie together; then a hash moves with a count and nothing else
    shared = keep("reuse_hashes", items.select(*SA, "_h").distinct().groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"))
    carried = keep("reuse_values", items.join(shared, "_h", "left_semi").groupBy(*packed, "sid").agg(F.min("frame").alias("seen")))
    reused = carried.groupBy(*packed).agg(F.count(F.lit(1)).alias("sas")).where(F.col("sas") >= 2)
    hits = carried.join(reused, packed)
    if peers is None:
        peers = session_peers(messages.join(
            hits.select("capture", F.col("sid").alias("initiator_spi")).distinct(), ["capture", "initiator_spi"], "left_semi"))
    linked = add_link(hits.join(peers.select(*SA, "peer_a", "peer_b"), SA), F.col("peer_a"), F.col("peer_b"))
    first = F.min_by(F.concat_ws(" <-> ", "peer_a", "peer_b"), F.struct("seen", "sid"))
    return linked.groupBy(*packed, "link").agg(first.alias("subject"), F.max("sas").alias("sas")).withColumn("digest", _unpack(F.col("packed"))).drop("packed")


def _pack(digest: Column) -> Column:
    """A text as bytes, lower-case hex at half its length; _unpack gives it back."""
    raw = F.unhex(digest)
    return F.when(F.lower(F.hex(raw)) == digest, F.concat(F.lit(b"\x01"), raw)).otherwise(F.concat(F.lit(b"\x00"), F.encode(digest, "UTF-8")))


def _unpack(packed: Column) -> Column:
    rest = F.substring(packed, F.lit(2), F.octet_length(packed))
    return F.when(F.substring(packed, F.lit(1), F.lit(1)) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def reasons() -> dict[str, str]:
    """Why each rule matters, in a sentence."""
    return {r: text for r, (_scope, _per, text) in R.RULES.items()}


@capture_rule("IKE-015")
def _(p):
    return when_one(F.col("kind") == "ke", finding(
        "IKE-015", "Key exchange public value reused across IKE SAs", "medium", "one public value in several SAs",
        {"peer": F.col("who"), "ke_sha256": F.col("digest"), "distinct_sas": F.col("sas")}))


@capture_rule("IKE-016")
def _(p):
    return when_one(F.col("kind") == "nonce", finding(
        "IKE-016", "Nonce reused across IKE SAs", "high", "one nonce in several SAs",
        {"nonce_sha256": F.col("digest"), "distinct_sas": F.col("sas")}))


# --- flow rules -------------------------------------------------------------------
CONFIDENCE_FLOOR = 0.35


@flow_rule("ESP-001")
def _(p):
    bad = F.col("verdict").isin("prohibited", "legacy")
    return when_one((F.col("confidence") >= CONFIDENCE_FLOOR) & bad, finding(
        "ESP-001", F.concat(F.lit("ESP tunnel using "), F.col("class")),
        F.when(F.col("verdict") == "prohibited", "critical").otherwise("medium"), "framing matches the class",
        {"framing_class": F.col("class"), "group_confidence": F.round("confidence", 4), "packets": F.col("packets"),
         "distinct_lengths": F.col("distinct_lengths")}, inferred=True))


@flow_rule("ESP-002")
def _(p):
    return when_one((F.col("entropy_samples") >= 12) & (F.col("mean_entropy") < 7.0), finding(
        "ESP-002", "ESP payload entropy below the ciphertext floor", "high", "payload looks structured",
        {"mean_entropy": F.round("mean_entropy", 3), "packets": F.col("packets")}, inferred=True))


@flow_rule("ESP-003")
def _(p):
    return when_one((F.col("packets") >= 50) & (F.col("gaps") >= F.col("packets") * 0.02), finding(
        "ESP-003", "Anti-replay sequence discontinuities", "low", "sequence numbers have gaps",
        {"gaps": F.col("gaps"), "packets": F.col("packets")}, inferred=True))


@flow_rule("ESP-004")
def _(p):
    return when_one(F.col("class").isNotNull() & (F.col("packets") < 60), finding(
        "ESP-004", "Insufficient sample for reliable inference", "info", "few packets seen",
        {"packets": F.col("packets")}, inferred=True))


VOLUME_RULE = "IKE-013"  # the one session rule that asks for flows

# --- running them -------------------------------------------------------------------
def _apply(df: DataFrame, rules: dict, policy: R.Policy, wanted: set[str]) -> DataFrame | None:
    arrays = [fn(policy) for rid, fn in rules.items() if rid in wanted]
    if not arrays:
        return None
    empty = "array<struct<rule_id:string,title:string,severity:string,detail:string,evidence:string,inferred:boolean>>"
    merged = F.concat(*[F.coalesce(a, F.array()).cast(empty) for a in arrays])
    return df.select("capture", "subject", F.inline(merged))


def exposed_sessions(s: DataFrame, flows: DataFrame | None, policy: R.Policy) -> DataFrame:
    """Sessions whose cipher has a short block, with their volume against the birthday bound: no other row is joined with flows."""
    s = s.where((F.col("block_bits") > 0) & (F.col("block_bits") < 128)).select(*SA, "subject", "peer_a", "peer_b", "block_bits", "lifetime")
    if flows is None:
        s = s.withColumns({"observed_bytes": F.lit(0), "observed_seconds": F.lit(0.0)})
    else:
        s = attribute_volume(s, flows)
    return sweet32(s.withColumn("rekey_seconds", F.coalesce("lifetime", F.lit(policy.max_ike_lifetime))))


def prepare_flows(classified: DataFrame, gaps: DataFrame) -> DataFrame:
    keys = ["capture", "src", "dst", "spi"]
    return classified.join(gaps.select(*keys, "gaps"), keys, "left").withColumn("gaps", F.coalesce("gaps", F.lit(0))).withColumn(
        "subject", F.col("flow"))


def audit(messages: DataFrame | None, flows: DataFrame | None, classified: DataFrame | None = None, gaps: DataFrame | None = None,
          policy: R.Policy = R.BASELINE_POLICY, disabled: Sequence[str] = (), only: Sequence[str] | None = None,
          strong: DataFrame | None = None, keep: Callable[[str, DataFrame], DataFrame] = lambda name, df: df) -> DataFrame:
    """Findings of every enabled rule over the given tables.

    `strong` is the session table with strengths under the same policy, where
    one is at hand; else it is built from the messages. `keep`: see reuse_table.
    """
    every = set(SESSION_RULES) | set(FLOW_RULES) | set(CAPTURE_RULES)
    wanted = (set(only) if only is not None else every) - set(disabled)
    parts = []
    if messages is not None:
        if wanted & set(SESSION_RULES):
            s = session_strength(sessions(messages, policy)) if strong is None else strong
            parts.append(_apply(s, SESSION_RULES, policy, wanted - {VOLUME_RULE}))
            parts.append(_apply(exposed_sessions(s, flows, policy), SESSION_RULES, policy, wanted & {VOLUME_RULE}))
        if wanted & set(CAPTURE_RULES):
            parts.append(_apply(reuse_table(messages, strong, keep), CAPTURE_RULES, policy, wanted))
    if classified is not None and wanted & set(FLOW_RULES):
        parts.append(_apply(prepare_flows(classified, gaps), FLOW_RULES, policy, wanted))
    parts = [p for p in parts if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
