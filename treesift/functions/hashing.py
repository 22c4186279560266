"""The finding fingerprint: 64-bit FNV-1a over rule, file, snippet and title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treesift.functions.text import strip

# FNV-1a parameters for 64 bits.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3

_LIMB = 0xFFFFFFFF


def fnv1a(value: Column) -> Column:
    """Sixteen hex digits of the hash of a string's UTF-8 bytes; null for null.

    The state is two limbs of 32 bits in longs. The prime is ``2**40 + 0x1B3``: a step multiplies both limbs
    by ``0x1B3``, carries, and adds the lower limb, moved by 40 bits, to the upper one. No step leaves 42 bits,
    so nothing wraps, and a text of n bytes costs n steps and no table.
    """
    factor = FNV_PRIME & _LIMB
    # One character per byte, whose code is the byte.
    latin = F.decode(F.encode(value, "UTF-8"), "ISO-8859-1")
    chars = F.filter(F.split(latin, ""), lambda c: c != "")

    def state(high: Column, low: Column) -> Column:
        return F.struct(high.cast("bigint").alias("high"), low.cast("bigint").alias("low"))

    def step(acc: Column, char: Column) -> Column:
        mixed = acc["low"].bitwiseXOR(F.ascii(char).cast("bigint"))
        product = mixed * factor
        high = acc["high"] * factor + F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        return state(high.bitwiseAND(F.lit(_LIMB)), product.bitwiseAND(F.lit(_LIMB)))

    def digits(limb: Column) -> Column:
        return F.lpad(F.lower(F.hex(limb)), 8, "0")

    start = state(F.lit(FNV_OFFSET >> 32), F.lit(FNV_OFFSET & _LIMB))
    return F.aggregate(chars, start, step, lambda acc: F.concat(digits(acc["high"]), digits(acc["low"])))


def fingerprint(rule_id: Column, file: Column, snippet: Column, title: Column) -> Column:
    """Sixteen hex digits that stay the same when code moves to another line."""
    return fnv1a(F.concat_ws("\0", rule_id, file, strip(snippet), title))
