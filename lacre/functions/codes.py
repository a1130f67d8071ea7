"""Error-correcting codes of matrix symbols, and identifiers from names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _remainder(value: Column, bits: int, generator: int) -> Column:
    """Rest of value, shifted left by the generator's degree, divided by the generator over GF(2)."""
    degree = generator.bit_length() - 1
    steps = F.array(*(F.lit(i) for i in range(bits + degree - 1, degree - 1, -1)))
    shift = lambda n: F.call_function("shiftleft", F.lit(generator), n - degree)
    divide = lambda rest, i: F.when(F.call_function("shiftright", rest, i).bitwiseAND(1) == 1, rest.bitwiseXOR(shift(i))).otherwise(rest)
    return F.aggregate(steps, F.shiftleft(value, degree), divide)


def format_bits(value: Column) -> Column:
    """15 format bits of a symbol from its 5 data bits: BCH with 1335, masked with 21522."""
    v = value.cast("int")
    return F.when(v.between(0, 31), F.shiftleft(v, 10).bitwiseOR(_remainder(v, 5, 1335)).bitwiseXOR(F.lit(21522)))


def version_bits(value: Column) -> Column:
    """18 version bits of a symbol of version 7 to 40: BCH with 7973."""
    v = value.cast("int")
    return F.when(v.between(7, 40), F.shiftleft(v, 12).bitwiseOR(_remainder(v, 6, 7973)))
