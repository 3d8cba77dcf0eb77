"""Token counts: exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .words import bytes_of

#: Default vocabulary file: byte-level BPE as ranks. The same path must exist on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this family cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths are summed in blocks of 2**BLOCK values, so that no task orders the whole histogram.
BLOCK = 10
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The encoder of a rank file, once per worker process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_count(path: str = RANKS):
    """UDF of a text: its number of tokens; a null or empty text has none."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(path).encode_ordinary
        data, offsets = bytes_of(texts)
        raw = data.tobytes()
        return pa.array(np.fromiter((len(encode(raw[a:b].decode("utf-8", "replace"))) for a, b in zip(offsets[:-1], offsets[1:])), np.int64, len(texts)))

    return count


def length_histogram(docs: DataFrame, text: str = "text", path: str = RANKS, special: int = 0) -> DataFrame:
    """(n_tokens, docs): documents of each encoded length, `special` added tokens included.

    Only one number per document leaves the map side, summed there already.
    Repeated rows count each time; an empty table gives an empty histogram.
    """
    length = token_count(path)(F.col(text)) + F.lit(special).cast("long")
    return docs.select(length.alias("n_tokens")).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds, per length L: tokens; docs_ge and tokens_ge of length >= L; docs_le of length <= L; docs_all, tokens_all;
    truncated_tokens, what remains when every document is cut to L.

    Sums run inside blocks of lengths and over one row per block; all are exact.
    """
    part = histogram.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("_block", F.shiftright("n_tokens", BLOCK))
    blocks = part.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    later = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = blocks.select(F.col("_block").alias("_b"), F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d_after"),
                          F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t_after"),
                          F.sum("_d").over(whole).alias("docs_all"), F.sum("_t").over(whole).alias("tokens_all"))
    inner = W.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = part.join(after, F.col("_block") == F.col("_b")).withColumns({
        "docs_ge": F.sum("docs").over(inner) + F.col("_d_after"), "tokens_ge": F.sum("tokens").over(inner) + F.col("_t_after")})
    return sums.select("n_tokens", "docs", "tokens", "docs_ge", "tokens_ge",
                       (F.col("docs_all") - F.col("docs_ge") + F.col("docs")).alias("docs_le"),
                       (F.col("tokens_all") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
                       "docs_all", "tokens_all")


def _first_beyond(sums: DataFrame, passed, values: dict[str, object]) -> DataFrame:
    """(place, values): for each place of a sorted list, over the rows for which more than `place` of its entries hold.

    passed: how many entries of the list hold for a row, which only grows with
    the length. Rows are grouped by that number, so no row meets the list itself.
    """
    few = sums.withColumn("_passed", passed).filter("_passed > 0").groupBy("_passed").agg(*[F.min(v).alias(k) for k, v in values.items()])
    return few.select(F.explode(F.sequence(F.lit(0), F.col("_passed") - 1)).alias("_place"), *values).groupBy("_place").agg(*[F.min(k).alias(k) for k in values])


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: documents over it, tokens kept and lost when cut to it. Exact for any limit, 0 included.

    One lookup each: the suffix sums at the least length over the limit.
    """
    limits = sorted({int(x) for x in limits})
    wanted = sums.sparkSession.createDataFrame(list(enumerate(limits)), "_place int, context_limit long").withColumn("_one", F.lit(1))
    over = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in limits]), lambda x: x < F.col("n_tokens")))
    found = _first_beyond(sums, over, {"_next": F.struct("n_tokens", "docs_ge", "tokens_ge")})
    whole = sums.agg(F.coalesce(F.max("tokens_all"), F.lit(0)).alias("_all")).withColumn("_one", F.lit(1))
    docs = F.coalesce("_next.docs_ge", F.lit(0))
    lost = F.coalesce(F.col("_next.tokens_ge"), F.lit(0)) - F.col("context_limit") * docs
    return wanted.join(found, "_place", "left").join(whole, "_one").select("context_limit", docs.alias("docs_over"), (F.col("_all") - lost).alias("tokens_kept"), lost.alias("tokens_lost"))


def quantiles(sums: DataFrame, at: list[float]) -> DataFrame:
    """Exact quantiles of document length: the least length that a share q of all documents do not exceed."""
    at = sorted({float(q) for q in at})
    wanted = sums.sparkSession.createDataFrame(list(enumerate(at)), "_place int, q double")
    reached = F.size(F.filter(F.array(*[F.lit(q) for q in at]), lambda q: F.greatest(F.ceil(q * F.col("docs_all")), F.lit(1)) <= F.col("docs_le")))
    return wanted.join(_first_beyond(sums, reached, {"n_tokens": F.col("n_tokens")}), "_place", "left").select("q", "n_tokens")
