"""Five logs to one event table, and events to user-days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilday.sources.cert import email_columns, web_columns

EVENT_COLUMNS = ["event_id", "ts", "user_id", "day", "log", "action", "object", "objects", "qty", "month"]


def _event(log: str, action, obj, qty, objects=None) -> list:
    return [
        F.col("id").alias("event_id"),
        F.col("ts"),
        F.col("user").alias("user_id"),
        F.to_date("ts").alias("day"),
        F.lit(log).alias("log"),
        action.alias("action"),
        obj.alias("object"),
        (F.array_compact(F.array(obj)) if objects is None else objects).alias("objects"),
        qty.cast("double").alias("qty"),
        F.date_format("ts", "yyyy-MM").alias("month"),
    ]


def normalise(logs: dict[str, DataFrame]) -> DataFrame:
    """One schema for the five logs (any subset of them).

    The object is the machine, file, first-named recipient or host, and
    ``objects`` all of them (every recipient of an email); the amount is the size of an email and 1 otherwise. Text columns are not selected.
    """
    one = F.lit(1.0)
    shapes = {
        "logon": lambda d: d.select(_event("logon", F.lower("activity"), F.col("pc"), one)),
        "device": lambda d: d.select(_event("device", F.lower("activity"), F.col("pc"), one)),
        "file": lambda d: d.select(_event("file", F.lit("copy"), F.col("filename"), one)),
        "email": lambda d: email_columns(d).select(
            _event("email", F.lit("send"), F.try_element_at("recipients", F.lit(1)), F.col("size"), F.col("recipients"))
        ),
        "http": lambda d: web_columns(d).select(_event("http", F.lit("visit"), F.col("host"), one)),
    }
    return reduce(DataFrame.unionByName, [shapes[name](df) for name, df in logs.items()])


def split_valid(rows: DataFrame, time: str = "ts", user: str = "user") -> tuple[DataFrame, DataFrame]:
    """Rows with a readable time and a user, and the rest."""
    bad = F.col(time).isNull() | F.col(user).isNull() | (F.trim(F.col(user).cast("string")) == "")
    return rows.filter(~bad), rows.filter(bad)


def user_days(events: DataFrame) -> DataFrame:
    """Each user's active days with the number of events and the first and last time."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def densify(ud: DataFrame, value: str = "n_events") -> DataFrame:
    """Add the silent days between a user's first and last active day, with ``value`` 0."""
    days = (
        ud.groupBy("user_id")
        .agg(F.min("day").alias("_from"), F.max("day").alias("_to"))
        .select("user_id", F.explode(F.expr("sequence(_from, _to, interval 1 day)")).alias("day"))
    )
    return days.join(ud.select("user_id", "day", value), ["user_id", "day"], "left").na.fill(0, [value])


def flag_hours(events: DataFrame, start: int, end: int) -> DataFrame:
    """Flag events outside ``[start, end)`` o'clock or on Saturday or Sunday."""
    off = (F.hour("ts") < start) | (F.hour("ts") >= end)
    weekend = F.weekday("ts") >= 5
    return events.withColumns(
        {"off_hours": off.cast("int"), "weekend": weekend.cast("int"), "off": (off | weekend).cast("int")}
    )


def filter_users(ud: DataFrame, min_days: int) -> DataFrame:
    """Keep the users with at least ``min_days`` active days (the rule is ours)."""
    kept = ud.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_days)
    return ud.join(kept, "user_id", "left_semi")
