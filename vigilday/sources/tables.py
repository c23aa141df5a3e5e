"""Parquet tables between the stages, and the tables of results."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_interim(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store normalised events by log and month.

    The rebalance gathers each (log, month) for the write and lets Spark cut the
    large ones into files of the advisory partition size, by their real size: the
    web log of a busy month is many tasks, and a quiet one a single file.
    """
    events.hint("rebalance", "log", "month").write.mode(mode).partitionBy("log", "month").parquet(path)


def read_interim(
    spark: SparkSession,
    path: str,
    months: Iterable[str] | None = None,
    logs: Iterable[str] | None = None,
) -> DataFrame:
    """Read stored events back; ``months`` and ``logs`` prune whole folders."""
    spark_type = {"log": "string", "month": "string"}
    df = spark.read.parquet(path)
    df = df.withColumns({c: F.col(c).cast(t) for c, t in spark_type.items() if dict(df.dtypes)[c] != t})
    if months is not None:
        df = df.filter(F.col("month").isin(list(months)))
    if logs is not None:
        df = df.filter(F.col("log").isin(list(logs)))
    return df


PROCESSED = ("x_f", "tokens", "labels", "split")


def write_processed(path: str, mode: str = "overwrite", **tables: DataFrame) -> None:
    """Store the tables keyed by user-day (features, tokens, labels, split), one folder each."""
    for name, df in tables.items():
        if name not in PROCESSED:
            raise ValueError(f"unknown table {name}; known are {PROCESSED}")
        df.write.mode(mode).parquet(f"{path}/{name}")


def read_processed(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Store alerts by day. Only the days present in ``alerts`` are replaced."""
    (
        alerts.hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("day", F.col("day").cast("date"))


def run_rows(metrics: DataFrame, run_id: str, params: dict[str, str]) -> DataFrame:
    """Metrics (variant, metric, value) with the run's id and its merged settings."""
    pairs = [F.lit(x) for key in sorted(params) for x in (key, str(params[key]))]
    settings = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    return metrics.select(
        F.lit(run_id).alias("run_id"), "variant", "metric", "value", settings.alias("params")
    )


def write_run(metrics: DataFrame, params: dict[str, str], run_id: str, path: str) -> None:
    """Store one run; writing the same run again replaces only that run."""
    (
        run_rows(metrics, run_id, params)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All stored runs. Run ids are read as text, so that ``0001`` stays ``0001``."""
    found = spark.read.parquet(path).schema
    text = [T.StructField(f.name, T.StringType()) if f.name == "run_id" else f for f in found]
    return spark.read.schema(T.StructType(text)).parquet(path)


def write_by_user(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """Store a table with user_id and day as ``name``, dealt over ``buckets`` by user and sorted by day.

    Windows by user and joins on the user read it without a shuffle. A folder of its own at ``path`` holds the files.
    """
    (
        df.repartition(buckets, "user_id").write.mode("overwrite").bucketBy(buckets, "user_id").sortBy("user_id", "day")
        .option("path", path).saveAsTable(name)
    )


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Append the rows of one run to the ledger at ``path``; a run that is appended again counts once, with its last rows.

    The rows are written under the name of this attempt first, then a one-row commit names the attempt. A write that ends half-way leaves rows that
    no commit names, which :func:`read_ledger` ignores. Nothing that is there is read, moved or overwritten.
    """
    attempt = uuid.uuid4().hex
    marked = rows.withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)})
    marked.write.mode("append").parquet(f"{path}/rows")
    commit = rows.sparkSession.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at")
    )
    commit.write.mode("append").parquet(f"{path}/commits")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of every run's last committed attempt."""
    commits = spark.read.parquet(f"{path}/commits")
    last = commits.groupBy("run_id").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    return spark.read.parquet(f"{path}/rows").join(last.select("attempt"), "attempt", "left_semi").drop("attempt")
