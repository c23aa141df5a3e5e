"""Train, validation and test parts by time, and what train may hold."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut_points(ud: DataFrame, shares: tuple[int, int, int], unit: str = "month") -> tuple[date, date]:
    """First validation day and first test day.

    The distinct units (months, or days for short data) are ranked 1..n; train
    ends at rank ``floor(n * shares[0] / 100)``, validation at
    ``floor(n * (shares[0] + shares[1]) / 100)``. The list read here is bounded
    by the calendar, and literal cut days let later scans prune partitions.
    """
    starts = sorted(
        r[0] for r in ud.select(F.to_date(F.date_trunc(unit, "day"))).distinct().collect()
    )
    n = len(starts)
    after = date(9999, 1, 1)
    first = [n * shares[0] // 100, n * (shares[0] + shares[1]) // 100]
    val_from, test_from = [starts[i] if i < n else after for i in first]
    return val_from, test_from


def split_at(ud: DataFrame, val_from: date, test_from: date) -> DataFrame:
    """Add ``split`` from two cut days."""
    return ud.withColumn(
        "split",
        F.when(F.col("day") < F.lit(val_from), "train")
        .when(F.col("day") < F.lit(test_from), "val")
        .otherwise("test"),
    )


def split_ratio(ud: DataFrame, shares: tuple[int, int, int], unit: str = "month") -> DataFrame:
    """Split by share of the months (or days), oldest first."""
    return split_at(ud, *cut_points(ud, shares, unit))


def split_fixed_train(ud: DataFrame, n_months: int, val_months: int = 0) -> DataFrame:
    """Train on the first ``n_months``, test on the rest week by week.

    ``fold`` is the Monday of a test day's week. ``val_months`` takes the last
    months of the training span for validation.
    """
    first = ud.agg(F.trunc(F.min("day"), "month")).first()[0]
    start = F.lit(first)
    test_from = F.add_months(start, n_months)
    val_from = F.add_months(start, n_months - val_months)
    return ud.withColumn(
        "split",
        F.when(F.col("day") < val_from, "train").when(F.col("day") < test_from, "val").otherwise("test"),
    ).withColumn("fold", F.when(F.col("split") == "test", F.to_date(F.date_trunc("week", "day"))))


def train_policy(ud: DataFrame, policy: str) -> DataFrame:
    """What to do with malicious days in train.

    ``drop_days`` leaves out the labelled days, ``keep`` leaves train as it is,
    ``drop_users`` leaves out every train day of a user who is labelled anywhere.
    Validation and test are never changed.
    """
    train = F.col("split") == "train"
    if policy == "keep":
        return ud
    if policy == "drop_days":
        return ud.filter(~(train & (F.col("label") == 1)))
    if policy == "drop_users":
        insiders = ud.filter("label = 1").select("user_id").distinct()
        return ud.filter(train).join(insiders, "user_id", "left_anti").unionByName(ud.filter(~train))
    raise ValueError(f"unknown policy {policy}")


def split_summary(ud: DataFrame) -> DataFrame:
    """Per part its dates, user-days, users and malicious user-days."""
    per_user = ud.groupBy("split", "user_id").agg(
        F.min("day").alias("a"), F.max("day").alias("z"), F.count(F.lit(1)).alias("n"), F.sum("label").alias("m")
    )
    return per_user.groupBy("split").agg(
        F.min("a").alias("first_day"),
        F.max("z").alias("last_day"),
        F.sum("n").alias("n_user_days"),
        F.count(F.lit(1)).alias("n_users"),
        F.sum("m").alias("n_malicious"),
    )


def leakage_check(ud: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """One row per check with the number of offending user-days (0 is clean).

    ``fitted_on`` holds the user-days that statistics were fitted on.
    """
    spans = ud.groupBy("split").agg(F.min("day").alias("a"), F.max("day").alias("z")).collect()
    first = {r["split"]: r["a"] for r in spans}
    late = date(9999, 1, 1)
    val_from, test_from = first.get("val", late), first.get("test", late)
    not_before = (
        ud.agg(
            F.count_if((F.col("split") == "train") & (F.col("day") >= F.lit(min(val_from, test_from)))).alias("a"),
            F.count_if((F.col("split") == "val") & (F.col("day") >= F.lit(test_from))).alias("b"),
        )
        .select(F.expr("stack(2, 'train_before_val', a, 'val_before_test', b) as (check, n_bad)"))
    )
    twice = (
        ud.groupBy("user_id", "day")
        .agg(F.min("split").alias("a"), F.max("split").alias("z"))
        .agg(F.count_if(F.col("a") != F.col("z")).alias("n_bad"))
        .select(F.lit("one_split_per_user_day").alias("check"), "n_bad")
    )
    outside = (
        fitted_on.select("user_id", "day")
        .join(ud.filter("split = 'train'").select("user_id", "day"), ["user_id", "day"], "left_anti")
        .agg(F.count(F.lit(1)).alias("n_bad"))
        .select(F.lit("fitted_on_train_only").alias("check"), "n_bad")
    )
    return not_before.unionByName(twice).unionByName(outside)
