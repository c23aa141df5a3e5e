"""Both score streams on one row per user-day, on one scale, and fused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilday.functions.joins import lookup_join
from vigilday.functions.ordering import MAX_GROUP, largest_group, running_sums
from vigilday.functions.storage import stored


def align(s_f: DataFrame, s_s: DataFrame, fill: float = 0.0) -> DataFrame:
    """One row per user-day of either stream; a missing score is ``fill``."""
    return s_f.join(s_s, ["user_id", "day"], "full").na.fill(fill, ["s_f", "s_s"])


def normalise_rank(scores: DataFrame, columns: Sequence[str], max_group: int = MAX_GROUP) -> DataFrame:
    """Replace scores by their percent rank among the scores of the day.

    A NULL score stays NULL and counts in no rank; a lone score has rank 0; a NULL day is a day. A day with at most ``max_group`` users is one window group. Beyond that
    equal scores are counted, the counts summed in score order over slices, and
    the rank of each score is looked up.
    """
    if largest_group(scores, ["day"]) <= max_group:
        of_day = Window.partitionBy("day")
        place = {c: F.rank().over(of_day.orderBy(F.col(c).asc_nulls_last())) - 1 for c in columns}
        others = {c: F.count(c).over(of_day) - 1 for c in columns}
        return scores.withColumns({
            c: F.when(F.col(c).isNotNull(), F.when(others[c] == 0, 0.0).otherwise(place[c] / others[c]))
            for c in columns
        })
    out = scores
    day = F.coalesce("day", F.lit("1970-01-01").cast(scores.schema["day"].dataType))
    for c in columns:
        counts = stored(out.filter(F.col(c).isNotNull()).groupBy("day", c).agg(F.count(F.lit(1)).alias("_n")))
        upto = running_sums(counts, ["day"], [F.col(c)], {"_upto": F.col("_n")}, True, max_group)
        rank = F.when(F.col("_upto_total") == 1, 0.0).otherwise(
            (F.col("_upto") - F.col("_n")) / (F.col("_upto_total") - 1)
        )
        ranks = upto.select("day", c, rank.alias("_rank"))
        # a NULL day is a day of its own, as in a window
        ranks = ranks.withColumns({"_no_day": F.col("day").isNull(), "day": day})
        keyed = out.withColumns({"_no_day": F.col("day").isNull(), "_day": F.col("day"), "day": day})
        out = lookup_join(keyed, ranks, ["day", "_no_day", c]).withColumns({c: F.col("_rank"), "day": F.col("_day")})
        out = out.drop("_rank", "_no_day", "_day")
    return out.select(*scores.columns)


def normalise_z(
    scores: DataFrame, columns: Sequence[str], stats: dict[str, dict[str, float]]
) -> DataFrame:
    """Replace scores by z-scores with statistics of earlier rows (``fit_stats``)."""
    return scores.withColumns(
        {c: (F.col(c) - stats[c]["mean"]) / (stats[c]["sd"] or 1.0) for c in columns}
    )


def fuse(s_f: Column | str, s_s: Column | str, alpha: float | Column) -> Column:
    """``alpha * s_f + (1 - alpha) * s_s``; the convex form is our reading of the one weight."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    f = s_f if isinstance(s_f, Column) else F.col(s_f)
    s = s_s if isinstance(s_s, Column) else F.col(s_s)
    return a * f + (F.lit(1.0) - a) * s
