"""Exact small-float arithmetic as Catalyst expressions. Arrays of blocks never leave their row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rint(c: Column) -> Column:
    """Round half to even."""
    return F.rint(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def f32(c: Column) -> Column:
    """A double rounded to single precision (as a double)."""
    return c.cast("float").cast("double")


def to_grid(c: Column, bits: int, least_exponent: int) -> Column:
    """Round to `bits` significant bits, half to even, with subnormals below 2 ** least_exponent."""
    ulp = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(c))).cast("double"), F.lit(float(least_exponent))) - (bits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c / ulp) * ulp)


def bf16(c: Column) -> Column:
    return to_grid(c, 8, -126)


def e4m3(c: Column) -> Column:
    """8-bit float with 4 exponent and 3 mantissa bits; callers clamp to +-448."""
    return to_grid(c, 4, -6)


def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def blocks(x: Column, group: int) -> Column:
    """array<double> cut into arrays of `group` (the last may be short: zeros that would pad it change no statistic that spans 0)."""
    starts = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1, F.lit(group))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.slice(x, i + 1, F.lit(group)))


def clean(block: Column) -> Column:
    return F.transform(block, lambda v: F.when(finite(v), v).otherwise(F.lit(0.0)))


def absmax(block: Column) -> Column:
    return F.greatest(F.array_max(F.transform(block, lambda v: F.abs(v))), F.lit(1e-8))


def total(values: Column) -> Column:
    """Sum of an array in its order."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def symmetric(x: Column, group: int, top: int, scale_of=bf16) -> Column:
    """array<struct<scale,q>>: one per block, symmetric codes in [-top-1, top], non-finite values coded 0."""

    def one(block: Column) -> Column:
        return let(scale_of(f32(absmax(clean(block)) / float(top))), lambda s: F.struct(
            s.alias("scale"), F.transform(block, lambda v: F.when(finite(v), clamp(F.rint(f32(v / s)), -top - 1, top)).otherwise(F.lit(0.0)).cast("int")).alias("q")))

    return F.transform(blocks(x, group), one)


def decoded(codes: Column, round_to=bf16) -> Column:
    """Values of array<struct<scale,q>> in one array."""
    return F.flatten(F.transform(codes, lambda b: F.transform(b["q"], lambda q: round_to(q * b["scale"]))))


def pack_nibbles(q: Column) -> Column:
    """Bytes (0-255) of 4-bit two's complement codes, the even position in the low nibble; an odd count gets a zero."""
    return F.transform(F.sequence(F.lit(0), F.size(q) - 1, F.lit(2)), lambda i: (F.get(q, i).bitwiseAND(15)).bitwiseOR(F.shiftleft(F.coalesce(F.get(q, i + 1), F.lit(0)).bitwiseAND(15), 4)))


def unpack_nibbles(packed: Column, n: Column) -> Column:
    sign = lambda v: F.when(v > 7, v - 16).otherwise(v)
    return F.slice(F.flatten(F.transform(packed, lambda b: F.array(sign(b.bitwiseAND(15)), sign(F.shiftright(b, 4).bitwiseAND(15))))), F.lit(1), n)


def pack_triples(q: Column) -> Column:
    """Bytes of 3-bit codes (value + 4), eight in three bytes, highest bit first, cut to ceil(3n / 8) bytes."""
    word = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, j: F.shiftleft(a, 3).bitwiseOR(F.coalesce(F.get(q, i + j) + 4, F.lit(0))))
    three = lambda w: F.array(F.shiftright(w, 16).bitwiseAND(255), F.shiftright(w, 8).bitwiseAND(255), w.bitwiseAND(255))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(q) - 1, F.lit(8)), lambda i: let(word(i), three)))
    return F.slice(every, F.lit(1), F.ceil(F.size(q) * 3 / F.lit(8)).cast("int"))


def unpack_triples(packed: Column, n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.shiftleft(bit_at(packed, i * 3), 2) + F.shiftleft(bit_at(packed, i * 3 + 1), 1) + bit_at(packed, i * 3 + 2) - 4)


def bit_at(packed: Column, k: Column) -> Column:
    """Bit k of a byte array, highest bit of each byte first."""
    return F.floor(F.get(packed, F.floor(k / 8).cast("int")) / F.pow(F.lit(2.0), F.lit(7) - k % 8)).cast("int").bitwiseAND(1)
