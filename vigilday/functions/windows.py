"""Trailing windows in calendar days. Day d itself is never inside its own window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def trailing(keys: Sequence[str], days: int, day: str = "day") -> WindowSpec:
    """Rows of the same keys on days ``[d - days, d - 1]``.

    Only for frames with at most one row per key and day, whose groups are
    therefore bounded by the calendar.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return group.orderBy(F.unix_date(F.col(day))).rangeBetween(-days, -1)


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) fixed by the key ``a|b|...``: first 32 bits of its md5."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
