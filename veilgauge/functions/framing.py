"""Column functions for ESP length arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def boundary(block: Column) -> Column:
    """Padding boundary in bytes: the cipher block, four at least."""
    return F.greatest(block, F.lit(4))


def residue(iv: Column, icv: Column, block: Column) -> Column:
    return (iv + icv) % boundary(block)


def cipher_len(inner: Column, block: Column, iv: Column, icv: Column, tfc: Column | int = 0) -> Column:
    """ESP ciphertext length of an inner packet: payload, pad length and next header, padded up."""
    b = boundary(block)
    tfc = tfc if isinstance(tfc, Column) else F.lit(tfc)
    return (iv + F.ceil((inner + tfc + 2) / b) * b + icv).cast("bigint")


def gcd(a: Column, b: Column, steps: int = 24) -> Column:
    """Greatest common divisor; 24 Euclid steps cover every pair below 75,025."""
    start = F.struct(F.greatest(a, b).cast("bigint").alias("a"), F.least(a, b).cast("bigint").alias("b"))
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), start,
        lambda s, _i: F.when(s["b"] == 0, s).otherwise(
            F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))
    return end["a"]


def gcd_of_gaps(lengths: Column) -> Column:
    """GCD of the gaps between distinct lengths = GCD of (length - shortest)."""
    low = F.array_min(lengths)
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda acc, x: gcd(acc, x.cast("bigint") - low))


def flow_name(src: Column, dst: Column, spi: Column) -> Column:
    return F.concat(src, F.lit("->"), dst, F.lit(":0x"), F.lower(F.lpad(F.hex(spi), 8, "0")))
