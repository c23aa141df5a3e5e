"""The organisation a user belonged to on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attach_org(ud: DataFrame, directory: DataFrame, columns: list[str]) -> DataFrame:
    """Add the directory ``columns`` in force on each user-day.

    A snapshot holds from its ``valid_from`` until the user's next one; before
    the first the columns are NULL. Snapshots and days of a user are put in one
    order and the latest snapshot is carried forward: one shuffle, no pairs. The
    group is a user's days and snapshots, so it is bounded by the calendar.
    """
    rest = [c for c in ud.columns if c not in ("user_id", "day")]
    org = F.struct(*columns)
    marks = directory.select(
        "user_id", F.col("valid_from").alias("day"), F.lit(0).alias("_kind"), org.alias("_org")
    )
    days = ud.select("user_id", "day", F.lit(1).alias("_kind"), F.struct("day", *rest).alias("_row"))
    so_far = (
        Window.partitionBy("user_id")
        .orderBy("day", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        days.unionByName(marks, allowMissingColumns=True)
        .withColumn("_now", F.last("_org", ignorenulls=True).over(so_far))
        .filter(F.col("_kind") == 1)
        .select("user_id", "day", *[F.col(f"_row.{c}").alias(c) for c in rest],
                *[F.col(f"_now.{c}").alias(c) for c in columns])
    )
