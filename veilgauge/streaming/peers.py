"""The cap on new links per capture, kept across the micro-batches of a stream.

A batch is one transaction of a commit log: its rows, the links it has seen for
the first time with their places, and a Bloom filter of these, all or none.
A replayed batch finds its transaction and does nothing. The exact look-up
among all links ever seen is asked only for links that the filter lets through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.posture import positioned
from ..sources.commit_log import CommitLog

#: The filter has 2**WORD_BITS words of 64 bits, HASHES of which a link sets one bit each.
WORD_BITS, HASHES = 20, 4
SEEN = "capture string, peer_key string, place bigint"
WORDS = "word int, bits bigint"
COUNTS = "capture string, links bigint"


def filter_bits(links: DataFrame, word_bits: int = WORD_BITS) -> DataFrame:
    """(capture, peer_key, word, bit): the bits of every link."""
    spots = F.array(*[F.xxhash64(F.lit(i), "capture", "peer_key") for i in range(HASHES)])
    spread = links.select("capture", "peer_key", F.explode(spots).alias("h"))
    return spread.select("capture", "peer_key", F.shiftrightunsigned("h", 64 - word_bits).cast("int").alias("word"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("bit"))


def maybe_seen(links: DataFrame, words: DataFrame, word_bits: int = WORD_BITS) -> DataFrame:
    """The links whose bits are all set. Links that were added are all among them, of others few."""
    full = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    hit = filter_bits(links, word_bits).join(full, "word").where("bits & bit <> 0")
    return hit.groupBy("capture", "peer_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == HASHES).drop("n")


def cap_batch(batch: DataFrame, txn: str, log: CommitLog, known: DataFrame | None = None, max_new_peers: int = 64, word_bits: int = WORD_BITS) -> None:
    """One micro-batch of observations: stored as `rows` with `withheld`, once, whatever is replayed.

    A link that is not in `known` takes the next place of its capture when it is
    first seen; places beyond the cap are withheld, in this batch and later.
    """
    if log.committed(txn):
        return
    version = log.latest()
    seen, words = log.read("seen", SEEN, version), log.read("words", WORDS, version)
    first = batch.groupBy("capture", "peer_key").agg(F.min("at").alias("at"))
    if known is not None:
        first = first.join(known.select("peer_key"), "peer_key", "left_anti")
    able = maybe_seen(first, words, word_bits)
    old = seen.join(able, ["capture", "peer_key"], "left_semi")
    new = first.join(old, ["capture", "peer_key"], "left_anti")
    ranked = positioned(new, ["capture"], [F.asc("at")], [F.floor(F.col("at.first_us") / (86400 * 10 ** 6))])
    taken = log.read("counts", COUNTS, version).groupBy("capture").agg(F.sum("links").alias("before"))
    placed = ranked.join(taken, "capture", "left").select("capture", "peer_key", (F.col("pos") + F.coalesce("before", F.lit(0))).cast("bigint").alias("place"))
    folders = log.write({"seen": placed})
    placed = batch.sparkSession.read.schema(SEEN).parquet(f"{log.path}/{folders['seen']}")
    past = placed.unionByName(old.select(*placed.columns)).where(F.col("place") > max_new_peers).select("capture", "peer_key", F.lit(True).alias("withheld"))
    rows = batch.join(past, ["capture", "peer_key"], "left").withColumn("withheld", F.coalesce("withheld", F.lit(False)))
    folders |= log.write({
        "rows": rows.drop("at"), "words": filter_bits(placed, word_bits).groupBy("word").agg(F.bit_or("bit").alias("bits")),
        "counts": placed.groupBy("capture").agg(F.count(F.lit(1)).alias("links"))})
    log.commit(txn, folders, version, depends=("seen",))


def start_peer_cap(observations: DataFrame, store: str, checkpoint: str, known: DataFrame | None = None, max_new_peers: int = 64, name: str = "peers", available_now: bool = False) -> StreamingQuery:
    """A stream of observations into the store; each batch is the transaction `name`-<batch id>."""
    def write(batch: DataFrame, batch_id: int) -> None:
        cap_batch(batch, f"{name}-{batch_id}", CommitLog(batch.sparkSession, store), known, max_new_peers)

    w = observations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
