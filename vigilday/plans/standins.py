"""The driver's tables in the roles of logs, directory and known insiders.

``events`` plays the five logs, its users are the customers. All values here are
choices for these synthetic tables only; they say nothing about real behaviour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilday.functions.storage import new_table_path, stored
from vigilday.operators import features, normalise, sequences, split
from vigilday.operators.fusion import align, normalise_z
from vigilday.sources import cert

# Which event type stands for which log.
LOG_OF = {"signup": "logon", "click": "device", "purchase": "file", "error": "email", "view": "http"}
ACTIONS = list(LOG_OF)
COUNTS = [f"n_{a}" for a in ACTIONS]
# The settings used on the test tables.
HOURS = (8, 18)
SHARES = (60, 15, 25)
W, W_TAU, REFRESH, P, MIN_HIST = 14, 14, 7, 0.95, 5
K_P, K_G, MIN_GROUP, BUDGET, ALPHA, SD_FLOOR = 7, 30, 5, 5, 0.5, 0.5
FIXED_WEIGHTS = (0.5, 0.3, 0.2)
GROUP = "segment"
SEED = 42


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised events."""
    log = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(name)) for t, name in LOG_OF.items()])
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.to_date("ts").alias("day"),
        log.alias("log"),
        F.col("event_type").alias("action"),
        F.get_json_object("props", "$.k").alias("object"),
        F.col("value").alias("qty"),
        F.date_format("ts", "yyyy-MM").alias("month"),
    )


def raw_logs(spark: SparkSession, sf: str) -> str:
    """The stand-ins written as the raw CSV files of a dataset; the folder they are in.

    The page of a web event is the host ``H<object>``; an email has a second
    recipient in cc. The directory has one snapshot a month.
    """
    raw = new_table_path(spark, "raw")
    root = f"{raw}/cert-{cert.VERSION}"
    moment = "MM/dd/yyyy HH:mm:ss"
    obj, amount = F.col("object"), F.col("qty").cast("string")
    # what each column of a log is filled with; the others stay empty
    filled = {
        "logon": {"pc": obj, "activity": F.initcap("action")},
        "device": {"pc": obj, "activity": F.initcap("action")},
        "file": {"filename": obj, "content": amount},
        "email": {"to": obj, "cc": F.concat(F.lit("c"), obj), "size": amount},
        "http": {"url": F.concat(F.lit("http://H"), obj, F.lit("/a?b=c")), "content": amount},
    }

    def write(df: DataFrame, path: str) -> None:
        df.write.option("header", True).option("escape", '"').csv(path)

    def columns(names: list[str], known: dict) -> list:
        return [known.get(c, F.lit(None)).cast("string").alias(c) for c in names]

    every = stored(events(spark, sf))
    for log, names in cert.LOG_COLUMNS.items():
        known = {"id": F.col("event_id"), "date": F.date_format("ts", f"{moment}.SSSSSS"), "user": F.col("user_id")}
        write(every.filter(F.col("log") == log).select(columns(names, known | filled[log])), f"{root}/{log}.csv")

    latest = F.struct("qty", "event_id")
    people = every.groupBy("user_id", "month").agg(
        F.max_by("action", latest).alias("role"), F.max_by("log", latest).alias("department")
    )
    known = {c: F.col(c) for c in ("user_id", "role", "department")}
    (
        people.select("month", *columns(cert.DIRECTORY_COLUMNS, known))
        .write.partitionBy("month").option("header", True).csv(f"{root}/LDAP")
    )

    known = {"dataset": F.lit(cert.VERSION.removeprefix("r")), "scenario": F.col("scenario"), "user": F.col("user_id")}
    known |= {c: F.date_format(c, moment) for c in ("start", "end")}
    write(answers(spark, sf).select(columns(cert.ANSWER_COLUMNS, known)), f"{root}/answers/insiders.csv")
    return raw


def one_log(spark: SparkSession, sf: str, log: str) -> DataFrame:
    return events(spark, sf).filter(F.col("log") == log)


def flagged(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.flag_hours(events(spark, sf), *HOURS)


def people(spark: SparkSession, sf: str) -> DataFrame:
    """A user's fixed attributes: segment, nation and region."""
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region")
    )
    return (
        table(spark, sf, "customer")
        .select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation"),
        )
        .join(nation, "nation", "left")
        .select("user_id", "segment", "nation", "region")
    )


def directory(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly snapshots: a user's role is last week's event type of the largest value."""
    week = F.to_date(F.date_trunc("week", "ts"))
    return (
        events(spark, sf)
        .groupBy("user_id", week.alias("week"))
        .agg(F.max_by("action", F.struct("qty", "event_id")).alias("role"),
             F.max_by("log", F.struct("qty", "event_id")).alias("department"))
        .select("user_id", F.date_add("week", 7).alias("valid_from"), "role", "department")
    )


# Scenario number, first and last moment of its active window, by segment.
WINDOWS = {
    "AUTOMOBILE": (1, "2024-01-08 00:00:00", "2024-01-14 12:00:00"),
    "BUILDING": (1, "2024-01-08 00:00:00", "2024-01-14 12:00:00"),
    "FURNITURE": (2, "2024-01-17 08:00:00", "2024-01-25 18:00:00"),
    "HOUSEHOLD": (2, "2024-01-17 08:00:00", "2024-01-25 18:00:00"),
    "MACHINERY": (3, "2024-01-20 00:00:00", "2024-01-28 23:59:59"),
}


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Known insiders: customers in debt, their window by segment."""

    def by_segment(i: int):
        return F.coalesce(*[F.when(F.col("c_mktsegment") == s, F.lit(w[i])) for s, w in WINDOWS.items()])

    return (
        table(spark, sf, "customer")
        .filter("c_acctbal < 0")
        .select(
            F.col("c_custkey").alias("user_id"),
            by_segment(0).cast("int").alias("scenario"),
            by_segment(1).cast("timestamp_ntz").alias("start"),
            by_segment(2).cast("timestamp_ntz").alias("end"),
        )
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """User-days with their label and scenario."""
    from vigilday.operators.labels import label_days, label_events

    ev = events(spark, sf)
    return label_days(normalise.user_days(ev), label_events(ev, answers(spark, sf)))


def cuts(spark: SparkSession, sf: str):
    """First validation and first test day, from the days of the raw events alone."""
    return split.cut_points(events(spark, sf).select("day"), SHARES, "day")


def day_scores(spark: SparkSession, sf: str) -> DataFrame:
    """User-days with the count score s."""
    return normalise.user_days(events(spark, sf)).withColumn("s", F.col("n_events").cast("double"))


def split_days(spark: SparkSession, sf: str) -> DataFrame:
    """The same with their part by time."""
    return split.split_at(day_scores(spark, sf), *cuts(spark, sf))


def grouped_days(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the group attributes of the user."""
    return day_scores(spark, sf).join(people(spark, sf), "user_id", "left")


def count_table(spark: SparkSession, sf: str, cut=None) -> DataFrame:
    """Count features with their part by time, written once: they are fitted on and scored."""
    counts = features.count_features(events(spark, sf), ACTIONS)
    return stored(split.split_at(counts, *(cut or cuts(spark, sf))))


def volume_scores(spark: SparkSession, sf: str, cut=None) -> DataFrame:
    counts = count_table(spark, sf, cut)
    stats = features.fit_stats(counts.filter("split = 'train'"), COUNTS)
    return features.diag_score(counts, COUNTS, stats)


def seq(spark: SparkSession, sf: str, cut=None) -> DataFrame:
    """Placed tokens with their part by time."""
    return split.split_at(sequences.tokens(flagged(spark, sf)), *(cut or cuts(spark, sf)))


def steps(spark: SparkSession, sf: str, back: int = 1, ahead: int = 0, cut=None) -> DataFrame:
    """Counted steps per user-day with their part by time, written once."""
    near = sequences.neighbours(seq(spark, sf, cut), back, ahead)
    return stored(sequences.count_steps(near, ["user_id", "day", "split"]))


def order_scores(spark: SparkSession, sf: str, cut=None) -> DataFrame:
    counted = steps(spark, sf, cut=cut)
    model = sequences.fit_ngram(counted.filter("split = 'train'"), 2)
    return sequences.day_score(sequences.nll(counted, model))


def streams(spark: SparkSession, sf: str) -> DataFrame:
    """Both streams per user-day as train z-scores, with part and group attributes."""
    cut = cuts(spark, sf)
    both = stored(align(volume_scores(spark, sf, cut), order_scores(spark, sf, cut)))
    both = split.split_at(both, *cut)
    stats = features.fit_stats(both.filter("split = 'train'"), ["s_f", "s_s"])
    return normalise_z(both, ["s_f", "s_s"], stats).join(people(spark, sf), "user_id", "left")
