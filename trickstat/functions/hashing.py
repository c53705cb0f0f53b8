"""A keyed 64-bit hash in built-in expressions, and unsigned arithmetic on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a with 64 bits: the offset basis in halves, and its prime 2^40 + 435.
BASIS_HI, BASIS_LO = 0xCBF29CE4, 0x84222325
LOW = 0xFFFFFFFF


def fnv1a64(text: Column) -> Column:
    """struct(hi, lo): halves of FNV-1a over the UTF-8 bytes. Halves keep every product within a long, so ANSI mode is no matter."""
    code = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(code) > 0, F.sequence(F.lit(0), F.floor(F.length(code) / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(code.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("long")
        lo = h["lo"].bitwiseXOR(byte)
        low = lo * 435
        hi = (h["hi"] * 435 + F.shiftleft(lo, 8) + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(LOW))
        return F.struct(hi.alias("hi"), low.bitwiseAND(F.lit(LOW)).alias("lo"))

    return F.aggregate(places, F.struct(F.lit(BASIS_HI).cast("long").alias("hi"), F.lit(BASIS_LO).cast("long").alias("lo")), step)


def as_decimal(h: Column) -> Column:
    return h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + h["lo"].cast("decimal(20,0)")


def modulo(h: Column, n: int) -> Column:
    return ((h["hi"] % n) * ((1 << 32) % n) + h["lo"] % n) % n


def divide_modulo(h: Column, by: int, n: int) -> Column:
    """(h div by) mod n, by long division of the halves."""
    top = F.floor(h["hi"] / by).cast("long")
    rest = (h["hi"] - top * by) * (1 << 32) + h["lo"]
    bottom = F.expr("0").cast("long") + (rest - rest % by) / by
    return ((top % n) * ((1 << 32) % n) + bottom.cast("long") % n) % n
