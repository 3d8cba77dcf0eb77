"""Ordered calculations (rank, lag, running max, running sum) that survive hot keys.

A plain window function puts every row of a key into one task, so a key that
holds a third of the data stalls the job. Here the rows of a key are cut into
chunks by a column that never decreases along the order (frame // 65536, the
hour of a timestamp, a key prefix). The row-level window then runs per
(key, chunk), where a border row in front of each chunk carries the state that a
small window over one row per chunk has found. Results equal the plain
window's, null keys included; only the largest task changes, from one key to one chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FRAME_CHUNK = 65536


def frame_chunk(col: str = "frame", size: int = FRAME_CHUNK) -> Column:
    """Chunk for rows ordered by a dense number: at most `size` rows per key."""
    return F.floor(F.col(col) / size)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Column,
    rank: str | None = None,
    lag: Mapping[str, str] | None = None,
    max_before: Mapping[str, str] | None = None,
    sum_to: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add ordered columns to every row of `df`.

    rank        name of a row_number() column
    lag         new column -> source column, value of the previous row
    max_before  new column -> source column, running max over earlier rows
    sum_to      new column -> source column, running sum up to this row
    `order` must be ascending Columns and unique within a key.
    """
    lag, max_before, sum_to = dict(lag or {}), dict(max_before or {}), dict(sum_to or {})
    keys = list(keys)
    df = df.withColumn("_chunk", chunk)
    chunks = W.partitionBy(*keys).orderBy("_chunk")
    earlier = chunks.rowsBetween(W.unboundedPreceding, -1)

    # one row per (key, chunk), combined map-side; a window over them gives the state at each border
    aggs, carries = [], []
    if rank:
        aggs.append(F.count(F.lit(1)).alias("_n"))
        carries.append(F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    for out, src in lag.items():
        aggs.append(F.max_by(F.col(src), F.struct(*order)).alias(f"_l_{out}"))
        carries.append(F.lag(f"_l_{out}").over(chunks).alias(f"_v_{out}"))
    for out, src in max_before.items():
        aggs.append(F.max(src).alias(f"_m_{out}"))
        carries.append(F.max(f"_m_{out}").over(earlier).alias(f"_v_{out}"))
    for out, src in sum_to.items():
        aggs.append(F.sum(src).alias(f"_s_{out}"))
        carries.append(F.coalesce(F.sum(f"_s_{out}").over(earlier), F.lit(0)).alias(f"_v_{out}"))
    borders = df.groupBy(*keys, "_chunk").agg(*aggs).select(*keys, "_chunk", F.lit(0).alias("_row"), *carries)

    # the border row stands first in its chunk, so the row window needs no join and keeps null keys
    both = df.select("*", F.lit(1).alias("_row"), *[F.col(src).alias(f"_v_{out}") for m in (lag, max_before, sum_to) for out, src in m.items()])
    both = both.unionByName(borders, allowMissingColumns=True)
    rows = W.partitionBy(*keys, "_chunk").orderBy("_row", *order)
    before, upto = rows.rowsBetween(W.unboundedPreceding, -1), rows.rowsBetween(W.unboundedPreceding, 0)
    if rank:
        both = both.withColumn(rank, F.sum(F.coalesce("_n0", "_row")).over(upto))
    for out in lag:
        both = both.withColumn(out, F.lag(f"_v_{out}").over(rows))
    for out in max_before:
        both = both.withColumn(out, F.max(f"_v_{out}").over(before))
    for out in sum_to:
        both = both.withColumn(out, F.sum(f"_v_{out}").over(upto))
    return both.where("_row = 1").select(*[c for c in both.columns if not c.startswith("_")])


def counted_below(df: DataFrame, keys: Sequence[str], value: str, target: Column, out: str, width: float) -> DataFrame:
    """Add `out`: how many rows of the same key have a `value` less than `target`, a number that rows may choose freely.

    Every row asks at its target and is counted at its value; one running count
    over both, cut into chunks of `width` on the number line, answers all. No
    range window, so a key that holds most rows is as many tasks as it has
    chunks. A null value is not counted, a null target has no answer (null).
    """
    asked = df.withColumns({"below_at": target, "below_is": F.lit(0)})
    counted = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("below_at"), F.lit(1).alias("below_is"))
    both = asked.where(F.col("below_at").isNotNull()).unionByName(counted, allowMissingColumns=True)
    run = ordered(both, keys, [F.col("below_at"), F.col("below_is")], F.floor(F.col("below_at") / F.lit(float(width))), sum_to={out: "below_is"})
    unasked = asked.where(F.col("below_at").isNull()).withColumn(out, F.lit(None).cast("bigint"))
    return run.where("below_is = 0").unionByName(unasked).drop("below_at", "below_is")


def exact_percentiles(
    hist: DataFrame, keys: Sequence[str], value: str, n: str, probs: Mapping[str, float], width: float,
) -> DataFrame:
    """Exact linear-interpolated percentiles from a (key, value, count) table.

    Two levels again: cumulative counts over coarse value buckets of the given
    width find the bucket of each wanted rank, and only rows of those buckets
    are ranked value by value. No task ever holds all values of a hot key.
    """
    keys = list(keys)
    h = hist.withColumn("_b", F.floor(F.col(value) / F.lit(width)))
    per = h.groupBy(*keys, "_b").agg(F.sum(n).alias("_bn"))
    w = W.partitionBy(*keys).orderBy("_b")
    per = (per.withColumn("_base", F.coalesce(F.sum("_bn").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
           .withColumn("_total", F.sum("_bn").over(W.partitionBy(*keys))))
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), ((F.col("_total") - 1).cast("double") * p).alias("at"))
        for name, p in probs.items()])
    # ranks (0-based) each percentile interpolates between
    per = per.withColumn("_want", F.filter(
        F.flatten(F.transform(wanted, lambda x: F.array(
            F.struct(x["name"].alias("name"), F.floor(x["at"]).alias("rank"),
                     (F.lit(1.0) - (x["at"] - F.floor(x["at"]))).alias("weight")),
            F.struct(x["name"].alias("name"), F.ceil(x["at"]).alias("rank"),
                     (x["at"] - F.floor(x["at"])).alias("weight"))))),
        lambda x: (x["rank"] >= F.col("_base")) & (x["rank"] < F.col("_base") + F.col("_bn"))))
    hit = per.where(F.size("_want") > 0).select(*keys, "_b", "_base", "_want")
    rows = h.join(hit, [*keys, "_b"])
    wv = W.partitionBy(*keys, "_b").orderBy(value)
    rows = (rows.withColumn("_hi", F.col("_base") + F.sum(n).over(wv.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("_lo", F.col("_hi") - F.col(n)))
    picked = rows.select(*keys, value, F.explode(F.filter(
        "_want", lambda x: (x["rank"] >= F.col("_lo")) & (x["rank"] < F.col("_hi")))).alias("_p"))
    return picked.groupBy(*keys).agg(*[
        F.sum(F.when(F.col("_p.name") == name, F.col(value) * F.col("_p.weight"))).alias(name) for name in probs])
