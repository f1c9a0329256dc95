"""Scalar text expressions, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that Python's str.strip removes.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = ("", "K", "M", "B", "T")


def strip(c: Column | str) -> Column:
    """Text without white space at either end, as Python's str.strip defines it."""
    return F.btrim(c, F.lit(WHITE))


def human(c: Column) -> Column:
    """One decimal and a unit of thousands: 1963908151 reads 2.0B."""
    out = F.format_string("%.1fP", c / F.lit(1e15))
    for i in reversed(range(len(UNITS))):
        out = F.when(F.abs(c) / F.lit(1000.0**i) < 1000, F.format_string(f"%.1f{UNITS[i]}", c / F.lit(1000.0**i))).otherwise(out)
    return out


def grouped(c: Column) -> Column:
    """Whole number with commas between thousands."""
    return F.format_number(c, 0)


def shard_name(split: Column, index: Column) -> Column:
    return F.format_string("%s/tokens_%06d.bin", split, index)


def after_thinking(c: Column) -> Column:
    """What follows the last thinking marker, stripped; text without one stays as it is."""
    return F.when(F.contains(c, F.lit("</think>")), strip(F.element_at(F.split(c, "</think>", -1), -1))).otherwise(c)


def without_channels(c: Column) -> Column:
    """Text without the spans from a channel opener to the next closer, stripped."""
    parts = F.transform(F.split(c, r"<channel\|>", -1), lambda p: F.element_at(F.split(p, r"<\|channel>", -1), 1))
    return strip(F.array_join(parts, ""))


def prefix(c: Column, n: int = 128) -> Column:
    """The first n code points."""
    return F.substring(c, 1, n)
