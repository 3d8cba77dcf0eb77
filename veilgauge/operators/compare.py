"""Two captures side by side. Frames carry a `pair` column naming which comparison a row belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def compare_links(a: DataFrame, b: DataFrame) -> DataFrame:
    """Links of A against B: only-a, only-b, stronger, weaker, severity or same."""
    cols = ["classical_bits", "quantum_bits", "worst_severity"]
    x = a.select("pair", "link", F.lit(True).alias("in_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    y = b.select("pair", "link", F.lit(True).alias("in_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    j = x.join(y, ["pair", "link"], "full_outer")
    both = F.col("classical_bits_a").isNotNull() & F.col("classical_bits_b").isNotNull()
    dc = F.col("classical_bits_b") - F.col("classical_bits_a")
    dq = F.col("quantum_bits_b") - F.col("quantum_bits_a")
    kind = (F.when(F.col("in_a").isNull(), "only-b").when(F.col("in_b").isNull(), "only-a")
            .when(both & (dc > 0), "stronger").when(both & (dc < 0), "weaker")
            .when(both & (dq > 0), "stronger").when(both & (dq < 0), "weaker")
            .when(~F.col("worst_severity_a").eqNullSafe(F.col("worst_severity_b")), "severity").otherwise("same"))
    return j.select("pair", "link", kind.alias("kind"), dc.alias("classical_change"), dq.alias("quantum_change"))


def compare_findings(a: DataFrame, b: DataFrame) -> DataFrame:
    """Findings of A gone in B (resolved), of B known in A (persisting) and new in B.

    "Known" means the rule or the title occurs on the other side. Each side is
    reduced to its distinct rules and titles first, so joins stay small.
    """
    def keys(df, col):
        return df.select("pair", col).distinct().withColumn(f"has_{col}", F.lit(True))

    def known(df, other):
        j = df.join(keys(other, "rule_id"), ["pair", "rule_id"], "left").join(keys(other, "title"), ["pair", "title"], "left")
        return j.withColumn("known", F.col("has_rule_id").isNotNull() | F.col("has_title").isNotNull())

    resolved = known(a, b).where(~F.col("known")).withColumn("state", F.lit("resolved"))
    rest = known(b, a).withColumn("state", F.when(F.col("known"), "persisting").otherwise("new"))
    return resolved.unionByName(rest).select("pair", "rule_id", "title", "severity", "subject", "state")


# fixed values: names the comparison calls weak
WEAK_CIPHER = r"^(?i)(ENCR_)?(3?DES|DES_IV\d+|RC5|IDEA|CAST|BLOWFISH|3IDEA|NULL)"
WEAK_HASH = r"(?i)MD5|SHA1|SHA_1"
WEAK_ESP = r"(?i)64-bit|3?DES|NULL|unencrypted"
WEAK_GROUPS = (1, 2, 5, 22, 25)


def suite_info(sessions: DataFrame, classified: DataFrame, exposure: DataFrame) -> DataFrame:
    """Per capture: version, cipher, PRF and group of the first session, class of the busiest flow, exposed links."""
    def first_of(type_id):
        t = F.get(F.filter("transforms", lambda t: t["type_id"] == type_id), F.lit(0))
        return t

    def named(t):
        return F.when(t["key_length"] > 0, F.concat_ws("-", t["name"], t["key_length"])).otherwise(t["name"])

    extra = F.transform(F.filter("transforms", lambda t: (t["type_id"] >= 6) & (t["type_id"] <= 12) & (t["value_id"] != 0)), lambda t: t["name"])
    group = first_of(4)
    s = sessions.select(
        "capture", "sid", "version", named(first_of(1)).alias("cipher"), F.coalesce(named(first_of(2)), named(first_of(3))).alias("prf"),
        F.concat_ws(" + ", group["name"], F.when(F.size(extra) > 0, F.array_join(extra, " + "))).alias("dh_group"),
        group["value_id"].alias("dh_id"))
    s = s.groupBy("capture").agg(F.min_by(F.struct("version", "cipher", "prf", "dh_group", "dh_id"), "sid").alias("s")).select("capture", "s.*")
    f = classified.groupBy("capture").agg(F.max_by("class", F.struct("packets", "flow")).alias("esp"))
    e = exposure.groupBy("capture").agg(F.sum((~F.col("quantum_safe")).cast("bigint")).alias("exposed"))
    return s.join(f, "capture", "left").join(e, "capture", "left").withColumns({
        "esp": F.coalesce("esp", F.lit("None observed")), "exposed": F.coalesce("exposed", F.lit(0))})


def compare_suites(a: DataFrame, b: DataFrame) -> DataFrame:
    """Same, Improved, Worse or Changed per parameter; exposed links Same, Fewer or More."""
    cols = ["version", "cipher", "prf", "dh_group", "dh_id", "esp", "exposed"]
    j = a.select("pair", *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select("pair", *[F.col(c).alias(f"b_{c}") for c in cols]), "pair")

    def verdict(same, weak_a, weak_b):
        return F.when(same, "Same").when(weak_a & ~weak_b, "Improved").when(weak_b & ~weak_a, "Worse").otherwise("Changed")

    def row(name, col, weak):
        x, y = F.col(f"a_{col}"), F.col(f"b_{col}")
        return F.struct(F.lit(name).alias("parameter"), x.cast("string").alias("value_a"), y.cast("string").alias("value_b"),
                        verdict(x == y, weak("a"), weak("b")).alias("status"))

    rows = [
        row("IKE version", "version", lambda s: F.col(f"{s}_version") == "IKEv1"),
        row("IKE cipher", "cipher", lambda s: F.col(f"{s}_cipher").rlike(WEAK_CIPHER)),
        row("Integrity and PRF", "prf", lambda s: F.col(f"{s}_prf").rlike(WEAK_HASH)),
        row("Diffie-Hellman group", "dh_group", lambda s: F.col(f"{s}_dh_id").isin(*WEAK_GROUPS)),
        row("ESP suite", "esp", lambda s: F.col(f"{s}_esp").rlike(WEAK_ESP)),
        F.struct(F.lit("Quantum-exposed links").alias("parameter"), F.col("a_exposed").cast("string").alias("value_a"),
                 F.col("b_exposed").cast("string").alias("value_b"),
                 F.when(F.col("a_exposed") == F.col("b_exposed"), "Same").when(F.col("b_exposed") < F.col("a_exposed"), "Fewer").otherwise("More").alias("status"))]
    return j.select("pair", F.inline(F.array(*rows)))


def alg_badge(type_id, value_id, name):
    """good, warn, bad or empty for one transform."""
    kex = type_id.isin(4, 6, 7, 8, 9, 10, 11, 12)
    return (F.when(kex & (value_id == 0), "").when(kex & value_id.isin(35, 36, 37), "good").when(kex & value_id.isin(1, 2, 22, 25), "bad")
            .when(kex & value_id.isin(5, 26), "warn").when(kex, "good")
            .when(name.rlike(WEAK_CIPHER) | name.rlike("(?i)MD5"), "bad").when(name.rlike("(?i)SHA1|SHA_1"), "warn")
            .when(name.rlike("GCM|CHACHA|CCM|SHA2"), "good").otherwise(""))


def suite_badge(name):
    return (F.when(name.isNull() | (name == ""), "").when(name.rlike("(?i)NULL|3?DES|unencrypted|64-bit block"), "bad")
            .when(name.rlike("(?i)96-bit ICV") | name.rlike("CBC"), "warn").otherwise("good"))
