"""Bounded samples of labelled documents, from which models are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of ids by CRC-32 that no fit may see; a null id was never labelled and counts as not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int, longest: int, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc, label, text) of at most `rows` labelled documents of at most `longest` bytes, by hash of the id.

    Only ids that are not held out. Of several labels of one id the least
    counts, of several texts the greatest. The bound makes the result fit on
    the driver; everything else in the operators covers all rows.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc"), F.col(label).cast("int").alias("label")).dropna().filter(~held_out("doc"))
    chosen = known.groupBy("doc").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc"), "doc").limit(rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    return texts.join(F.broadcast(chosen), "doc").groupBy("doc", "label").agg(F.max("text").alias("text"))
