"""Suite strength in bits, computed in the row from the transforms array.

A session's proposal is a short array, so strength is a set of higher-order
expressions over it: no explode, no shuffle. Registry values are map literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import registries as R
from .packets import pinned

_ENC = R.sql_map({k: v[0] for k, v in R.ENCR_STRENGTH.items()})
_BLOCK = R.sql_map({k: v[1] for k, v in R.ENCR_STRENGTH.items()})
_INTEG = R.sql_map(R.INTEG_STRENGTH)
_PRF = R.sql_map(R.PRF_STRENGTH)
_DHC = R.sql_map({g: v[3] for g, v in R.DH.items()})
_DHQ = R.sql_map({g: v[4] for g, v in R.DH.items()})
_DHF = R.sql_map({g: v[5] for g, v in R.DH.items()})


def score(df: DataFrame, transforms: str = "transforms") -> DataFrame:
    """Add classical_bits, quantum_bits, block_bits, component bits and key exchange figures.

    Weakest link over components. Within one transform type the weakest
    alternative counts; across key exchanges the strongest, for each adversary.
    """
    def weakest(type_id: int, value: str) -> Column:
        return F.expr(f"array_min(transform(filter({transforms}, t -> t.type_id = {type_id}), t -> {value}))")

    slot = "named_struct('type_id', ty, 'w', array_min(transform(filter({t}, t -> t.type_id = ty), (t, i) -> {s})), " \
           "'c', array_min(transform(filter({t}, t -> t.type_id = ty), t -> {c})))"
    c = f"coalesce(try_element_at({_DHC}, t.value_id), IF(ty = {R.KE_TYPE}, 112, 0))"
    q = f"coalesce(try_element_at({_DHQ}, t.value_id), 0)"
    fam = f"coalesce(try_element_at({_DHF}, t.value_id), IF(ty = {R.KE_TYPE}, 'modp', 'unknown'))"
    inner = f"named_struct('q', {q}, 'c', {c}, 'i', i, 'family', {fam}, 'gid', t.value_id, 'name', t.name)"
    used = (f"filter(transform(filter(array({R.sql_list(R.KE_TYPES)}), ty -> exists({transforms}, t -> t.type_id = ty)), ty -> "
            + slot.format(t=transforms, s=inner, c=c)
            + f"), x -> x.type_id = {R.KE_TYPE} OR x.w.family NOT IN ('none', 'unknown'))")
    df = pinned(
        df, _enc=weakest(1, "IF(t.key_length > 0 AND (startswith(t.name, 'ENCR_AES') OR startswith(t.name, 'AES')), "
                            f"t.key_length, coalesce(try_element_at({_ENC}, t.name), 128))"),
        _blk=weakest(1, f"coalesce(try_element_at({_BLOCK}, t.name), 128)"),
        _prf=weakest(2, f"coalesce(try_element_at({_PRF}, t.name), 128)"),
        _int=weakest(3, f"coalesce(try_element_at({_INTEG}, t.name), 128)"), _ke=F.expr(used))
    df = pinned(df, _kc=F.expr("array_max(transform(_ke, x -> x.c))"), _kq=F.expr("array_max(transform(_ke, x -> x.w.q))"))
    known = F.greatest(*[F.col(x).isNotNull() for x in ("_enc", "_prf", "_int", "_kc")])
    classical = F.when(known, F.least("_enc", "_prf", "_int", "_kc")).otherwise(0)
    grover = F.floor(F.coalesce(F.col("_enc"), F.lit(0)) / 2).cast("int")
    quantum = F.least(grover, F.coalesce("_kq", F.lit(0)))
    return df.withColumns({
        "classical_bits": classical, "quantum_raw": quantum, "block_bits": F.coalesce("_blk", F.lit(0)),
        "enc_bits": F.col("_enc"), "prf_bits": F.col("_prf"), "integ_bits": F.col("_int"), "kex_bits": F.col("_kc"),
        "kex_quantum_raw": F.coalesce("_kq", F.lit(0)),
        "kex_family": F.when(~known, "unknown").when(F.size("_ke") > 0, F.array_join(F.array_distinct(
            F.expr("transform(_ke, x -> x.w.family)")), "+")).otherwise("none"),
        "kex_names": F.array_join(F.expr("transform(_ke, x -> x.w.name)"), " + "),
        "hybrid": F.coalesce(F.size("_ke") > 1, F.lit(False)),
    }).drop("_enc", "_blk", "_prf", "_int", "_ke", "_kc", "_kq")


def session_strength(sessions_df: DataFrame) -> DataFrame:
    """Strength of the negotiated proposal; an unanswered offer earns no quantum credit."""
    s = score(sessions_df)
    uncredited = (F.col("kex_quantum_raw") > 0) & ~F.col("confirmed")
    return s.withColumns({
        "quantum_bits": F.when(uncredited, 0).otherwise(F.col("quantum_raw")),
        "kex_quantum_bits": F.when(uncredited, 0).otherwise(F.col("kex_quantum_raw")), "uncredited": uncredited,
    }).withColumns({
        "quantum_safe": F.col("quantum_bits") >= 128, "grade": grade_bits(F.col("classical_bits"))}).drop(
        "quantum_raw", "kex_quantum_raw")


def grade_bits(bits: Column) -> Column:
    return (F.when(bits >= 192, "excellent").when(bits >= 128, "adequate").when(bits >= 112, "minimum")
            .when(bits >= 80, "deprecated").otherwise("broken"))


SWEET32_BLOCKS = 2 ** 32


def sweet32(df: DataFrame, block="block_bits", nbytes="observed_bytes", seconds="observed_seconds", rekey="rekey_seconds") -> DataFrame:
    """Birthday exposure of ciphers with a short block; null columns when the block is 0 or 128 and more."""
    applies = (F.col(block) > 0) & (F.col(block) < 128)
    limit = F.floor(F.col(block) / 8) * F.lit(float(SWEET32_BLOCKS))
    rate = F.when(F.col(seconds) > 0, F.try_divide(F.col(nbytes).cast("double"), F.col(seconds).cast("double"))).otherwise(0.0)
    d = pinned(df, _limit=F.when(applies, limit), _rate=rate)
    per_key = F.col("_rate") * F.col(rekey)
    return d.withColumns({
        "threshold_gb": F.round(F.col("_limit") / 1e9, 1), "rate_mbps": F.when(applies, F.round(F.col("_rate") * 8 / 1e6, 2)),
        "per_rekey_gb": F.when(applies, F.round(per_key / 1e9, 2)),
        "ratio": F.round(F.try_divide(per_key, F.col("_limit")), 3),
        "seconds_to_limit": F.when(F.col("_rate") > 0, F.round(F.try_divide(F.col("_limit"), F.col("_rate")), 1)),
        "exceeds": F.when(applies, per_key >= F.col("_limit")),
    }).drop("_limit", "_rate")


def attribute_volume(sessions_df: DataFrame, flows: DataFrame, match: str = "any") -> DataFrame:
    """Add observed_bytes and observed_seconds of the ESP flows that go with a session.

    match="any": flows sharing at least one endpoint. Counted by inclusion and
    exclusion over per-endpoint totals (endpoint a + endpoint b - flows between
    a and b), so a hub gateway never multiplies sessions by flows.
    match="pair": flows between exactly the two peers.
    """
    f = flows.select("capture", "src", "dst", "bytes", "seconds")
    pair = f.groupBy("capture", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(
        F.sum("bytes").alias("pair_bytes"), F.max("seconds").alias("pair_seconds"))
    lo, hi = F.least("peer_a", "peer_b"), F.greatest("peer_a", "peer_b")
    s = sessions_df.withColumns({"lo": lo, "hi": hi}).join(pair, ["capture", "lo", "hi"], "left")
    if match == "pair":
        return s.withColumns({"observed_bytes": F.coalesce("pair_bytes", F.lit(0)),
                              "observed_seconds": F.coalesce("pair_seconds", F.lit(0.0))}).drop("lo", "hi", "pair_bytes", "pair_seconds")
    ends = f.select("capture", "bytes", "seconds", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end"))
    ends = ends.groupBy("capture", "end").agg(F.sum("bytes").alias("eb"), F.max("seconds").alias("es"))
    for side in ("a", "b"):
        s = s.join(ends.select("capture", F.col("end").alias(f"peer_{side}"), F.col("eb").alias(f"eb_{side}"),
                               F.col("es").alias(f"es_{side}")), ["capture", f"peer_{side}"], "left")
    zero = F.lit(0)
    both = F.coalesce("eb_a", zero) + F.coalesce("eb_b", zero) - F.coalesce("pair_bytes", zero)
    same = F.col("peer_a") == F.col("peer_b")
    return s.withColumns({
        "observed_bytes": F.when(same, F.coalesce("eb_a", zero)).otherwise(both),
        "observed_seconds": F.coalesce(F.greatest("es_a", "es_b"), F.lit(0.0)),
    }).drop("lo", "hi", "pair_bytes", "pair_seconds", "eb_a", "eb_b", "es_a", "es_b")
