"""Functions from a column (and parameters) to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add(c: Column, n=1) -> Column:
    return c + F.lit(n)


def subtract(c: Column, n=1) -> Column:
    return c - F.lit(n)


def multiply(c: Column, n) -> Column:
    return c * F.lit(n)


def divide(c: Column, n) -> Column:
    """True division; by zero gives null."""
    return F.try_divide(c, F.lit(n))


def floor_divide(c: Column, n) -> Column:
    """The integer below the quotient, as Python's // gives it; by zero gives null."""
    return F.floor(F.try_divide(c, F.lit(n)))


def floor_mod(c: Column, n) -> Column:
    """The remainder with the divisor's sign, as Python's % gives it for positive divisors."""
    return F.pmod(c, F.lit(n))


def is_odd(c: Column) -> Column:
    return F.pmod(c, F.lit(2)) == 1


def not_divisible(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n)) != 0


def strip(c: Column) -> Column:
    """Without white space at both ends (of any kind, in linear time)."""
    return F.regexp_replace(c, r"^\s++|(?<!\s)\s++$", "")


def split_words(c: Column) -> Column:
    """Parts between single blanks; empty parts stay."""
    return F.split(c, " ", -1)


def draw(seed: int, *keys: str) -> Column:
    """A whole number from 0 below 2 ** 52 drawn by a hash of the seed and key columns, the same in any SQL engine that has md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
