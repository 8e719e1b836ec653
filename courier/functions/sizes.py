"""Byte counts as text, the way they are shown to the user after a bundle or an upload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units and their thresholds (powers of 1024); TB is the last unit.
UNITS = ("B", "KB", "MB", "GB", "TB")


def human_bytes(n) -> Column:
    """``0 B``, ``1.5 KB``, ``5.0 MB`` … The unit is picked on ``abs(n) < 1024**k`` before rounding,
    ``B`` has no decimals, the rest one decimal rounded half to even.

    Whole numbers over the whole BIGINT range, in integer arithmetic: the quotient by the unit, then
    ten times the remainder (below 10 * 1024**4) by the unit again, whose own remainder decides the
    rounding. ``bigint`` input is exact; other numeric types are cast to it.
    """
    v = (F.col(n) if isinstance(n, str) else n).cast("bigint")
    # the least BIGINT has no positive counterpart; one less shows the same text
    a = F.abs(F.greatest(v, F.lit(-(1 << 63) + 1)))
    level = sum(((a >= F.lit(1024 ** k)).cast("int") for k in range(1, len(UNITS))), F.lit(0))
    pick = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), level + F.lit(1))
    div = pick([1024 ** k for k in range(len(UNITS))]).cast("bigint")
    rest = F.pmod(a, div) * F.lit(10)
    over = F.pmod(rest, div)
    tenths = _quotient(a, div) * F.lit(10) + _quotient(rest, div)
    # half to even: up if more than half of a tenth is over, or exactly half and the tenth is odd
    up = (over * 2 > div) | ((over * 2 == div) & (F.pmod(tenths, F.lit(2)) == 1))
    tenths = tenths + up.cast("int")
    number = F.when(level == 0, a.cast("string")).otherwise(
        F.concat(_quotient(tenths, F.lit(10)).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string")))
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, number, F.lit(" "), pick(UNITS))


def _quotient(a: Column, b: Column) -> Column:
    """Integer division of non-negative BIGINTs: exact where ``/`` would go through a double."""
    return F.call_function("div", a, b)


def mb_to_bytes(max_size_mb) -> Column:
    return F.lit(int(max_size_mb) * 1024 * 1024).cast("bigint")
