"""Peer pairs, subjects and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .bytes import address_key


def lower_peer(a: Column, b: Column) -> Column:
    """The numerically first of two addresses, IPv4 before IPv6 before text."""
    return F.when(address_key(a) <= address_key(b), a).otherwise(b)


def upper_peer(a: Column, b: Column) -> Column:
    return F.when(address_key(a) <= address_key(b), b).otherwise(a)


def link_id(a: Column, b: Column) -> Column:
    return F.concat_ws("~", lower_peer(a, b), upper_peer(a, b))


def peer_key(a: Column, b: Column) -> Column:
    """Store key of a pair: textual order, unlike link_id."""
    return F.array_join(F.array_sort(F.array(a, b)), "|")


def subject_peer(subject: Column, side: int) -> Column:
    """Address 0 or 1 named by a finding subject: 'a <-> b' or 'src->dst:0xSPI'; null when neither."""
    esp = r"^(.+?)->(.+):0x[0-9a-fA-F]+$"
    return (F.when(F.contains(subject, F.lit(" <-> ")), F.trim(F.get(F.split(subject, " <-> ", 2), F.lit(side))))
            .when(F.trim(subject).rlike(esp), F.regexp_extract(F.trim(subject), esp, side + 1)))


def label(name: Column, key_length: Column) -> Column:
    return F.when(key_length > 0, F.concat_ws("-", name, key_length.cast("string"))).otherwise(name)


def add_link(df: DataFrame, a: Column, b: Column, name: str = "link") -> DataFrame:
    """Add link_id of two address columns, null when either is null; addresses and keys are computed once per row."""
    from ..operators.packets import pinned

    d = pinned(df, _a=a, _b=b)
    d = pinned(d, _ka=address_key(F.col("_a")), _kb=address_key(F.col("_b")))
    link = F.when(F.col("_ka") <= F.col("_kb"), F.concat_ws("~", "_a", "_b")).otherwise(F.concat_ws("~", "_b", "_a"))
    return d.withColumn(name, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), link)).drop("_a", "_b", "_ka", "_kb")
