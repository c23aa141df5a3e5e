"""Known insider windows on events and user-days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilday.functions.joins import lookup_join


def label_events(events: DataFrame, answers: DataFrame, **bounds) -> DataFrame:
    """Events inside an active window of a known insider, both ends included.

    A user's windows are gathered to one row first, so the join adds no rows
    when windows overlap, and a very active insider is split like any other
    user. The largest scenario number of the windows hit is kept.
    """
    windows = answers.groupBy("user_id").agg(
        F.collect_list(F.struct("start", "end", "scenario")).alias("_windows")
    )
    hit = F.filter(
        "_windows", lambda w: (F.col("ts") >= w["start"]) & (F.col("ts") <= w["end"])
    )
    return (
        lookup_join(events, windows, ["user_id"], "inner", **bounds)
        .withColumn("_hit", hit)
        .filter(F.size("_hit") > 0)
        .withColumn("scenario", F.array_max(F.transform("_hit", lambda w: w["scenario"])))
        .drop("_windows", "_hit")
    )


def label_days(ud: DataFrame, labelled: DataFrame) -> DataFrame:
    """Label 1 and the scenario for user-days with a labelled event, else 0."""
    days = labelled.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max("scenario").cast("int").alias("scenario"), F.lit(1).alias("label")
    )
    return ud.join(days, ["user_id", "day"], "left").na.fill(0, ["label", "scenario"])
