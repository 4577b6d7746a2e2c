"""Bit operations on integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_bit(value: Column, at: int) -> Column:
    return value.bitwiseOR(F.lit(1 << at))


def clear_bit(value: Column, at: int) -> Column:
    return value.bitwiseAND(F.lit(~(1 << at)))


def get_bit(value: Column, at: int) -> Column:
    return F.getbit(value, F.lit(at)) == 1


def get_bits(value: Column, at: int, count: int) -> Column:
    """``count`` bits from ``at`` upwards as a number."""
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << count) - 1))


def count_bits(value: Column) -> Column:
    return F.bit_count(value)


def count_bits_below(value: Column, at: int) -> Column:
    """Set bits among the lowest ``at``."""
    return F.bit_count(value.bitwiseAND(F.lit((1 << at) - 1)))


def bit_string(value: Column) -> Column:
    return F.bin(value)
