"""Rounding of results, so that the last digits of sums in another order don't matter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
#: Moves the rounding's boundaries off the decimal halves, on which many prices lie.
_SHIFT = 3.7


def settle(x: Column, digits: int = DIGITS) -> Column:
    return F.round(x + F.lit(_SHIFT / 10 ** (digits + 2)), digits)


def rounded(df: DataFrame, digits: int = DIGITS, coarse: tuple[str, ...] = ()) -> DataFrame:
    """All doubles of ``df`` rounded; the columns ``coarse``, which hold large sums, to two digits."""
    return df.select(*(settle(F.col(f"`{f.name}`"), 2 if f.name in coarse else digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


def settled_sql(sql: str) -> str:
    """``round(x, 2)``, ``round(x, 4)`` and ``round(x, 6)`` in ``sql`` with the same boundaries."""
    return re.sub(r", ([246])\)(?= AS )", lambda m: f" + {_SHIFT / 10 ** (int(m[1]) + 2)!r}::DOUBLE, {m[1]})", sql)
