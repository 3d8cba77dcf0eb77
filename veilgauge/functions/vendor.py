"""Vendor id payload to product name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import registries as R


def vendor_name(payload: Column) -> Column:
    """Known hex prefix, else 3 to 40 printable ASCII characters, else unknown with its first 16 hex digits."""
    hexed = F.lower(F.hex(payload))
    known = F.coalesce(*[F.when(F.startswith(hexed, F.lit(p)), F.lit(n)) for p, n in R.VENDOR_IDS.items()])
    text = payload.cast("string")
    readable = hexed.rlike("^([2-6][0-9a-f]|7[0-9a-e]){3,40}$")
    return F.coalesce(known, F.when(readable, F.trim(text)), F.concat(F.lit("unknown:"), F.substring(hexed, 1, 16)))


def _named(values: dict, number: Column, prefix: str) -> Column:
    names = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(names[number.cast("int")], F.concat(F.lit(prefix), number.cast("string")))


def kex_name(group: Column) -> Column:
    """Name of a key exchange group, GROUP_<n> for one that is not registered."""
    return _named({g: v[0] for g, v in R.DH.items()}, group, "GROUP_")


def exchange_name(number: Column) -> Column:
    """Name of an IKEv2 exchange, EXCHANGE_<n> for one that is not registered."""
    return _named(dict(R.EXCHANGES_V2), number, "EXCHANGE_")
