"""Equi joins of a large, possibly skewed side with a table that is usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilday.functions.storage import measured

MAX_ROWS = 200_000
MAX_BYTES = 32 * 1024 * 1024
SALTS = 32


def fits_broadcast(table: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Measure ``table``: few enough rows, and few enough bytes in them."""
    _, rows, size = measured(table)
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    large: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
    salts: int = SALTS,
    within: DataFrame | None = None,
) -> DataFrame:
    """Join ``large`` with ``table``, which has at most one row per key.

    ``table`` is stored, and measured while it is written. Within the bounds it is broadcast, so
    ``large`` is not shuffled at all. Beyond them the join shuffles, and every
    key of ``large`` is spread over ``salts`` tasks by a hash of its row
    (``table`` is repeated that often), so that no key is one task's work. Rows
    that may be equal must be counted, or numbered, by the caller first: equal
    rows get one salt. Map columns, which have no hash, are left out of it.
    ``within`` is a larger table, already stored, that bounds the size of ``table``: if it
    fits, ``table`` is neither stored nor measured.
    """
    if within is not None:
        if fits_broadcast(within, max_rows, max_bytes):
            return large.join(F.broadcast(table), on, how)
    table, rows, size = measured(table)
    if rows <= max_rows and size <= max_bytes:
        return large.join(F.broadcast(table), on, how)
    hashed = [c for c, kind in large.dtypes if "map<" not in kind]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int")
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", salt).join(spread, [*on, "_salt"], how).drop("_salt")
