"""Quantiles with linear interpolation between neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilday.functions.ordering import MAX_GROUP, running_sums
from vigilday.functions.storage import stored


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    p: float,
    name: str = "q",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Per group the exact ``p``-quantile of ``value`` and, as ``n_<name>``, how many values there are.

    Equal values are counted together before any shuffle, the counts are summed
    in value order, and the two values around position ``p * (n - 1)`` are
    interpolated, so a group of any size is never held in one task.
    """
    keys = list(keys)
    counts = stored(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    upto = running_sums(counts, keys, [F.col(value)], {"_upto": F.col("_n")}, totals=True, max_group=max_group)
    place = F.lit(float(p)) * (F.col("_upto_total") - 1)
    around = upto.groupBy(*keys).agg(
        F.min(F.when(F.col("_upto") > F.floor(place), F.col(value))).alias("_lo"),
        F.min(F.when(F.col("_upto") > F.ceil(place), F.col(value))).alias("_hi"),
        F.max(place - F.floor(place)).alias("_share"),
        F.max("_upto_total").alias(f"n_{name}"),
    )
    return around.select(
        *keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_share")).alias(name), f"n_{name}"
    )
