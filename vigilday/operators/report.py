"""Tables generated from stored runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report(runs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per run and variant, one column per metric.

    The metric names are given, which saves the pass that would look for them.
    """
    return (
        runs.groupBy("run_id", "variant").pivot("metric", list(metrics)).agg(F.first("value", ignorenulls=True))
    )


def metric_rows(wide: DataFrame, variant, metrics: Sequence[str]) -> DataFrame:
    """Metric columns to rows (variant, metric, value)."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics
    ])
    return wide.select(variant.alias("variant"), F.explode(rows).alias("_r")).select("variant", "_r.*")


def seed_summary(runs: DataFrame) -> DataFrame:
    """Mean, sd and number of seeds per variant and metric."""
    return runs.groupBy("variant", "metric").agg(
        F.count("value").alias("n_seeds"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
    )


def ledger(runs: DataFrame, date: str, question: str, note: str, test_opened: int) -> DataFrame:
    """The experiment table: date, run, configuration, question, three metrics, note.

    ``test_opened`` counts how often the test part has been looked at so far.
    """
    wide = report(runs, ["pr_auc", "recall_1pct", "fpr"])
    return wide.select(
        F.lit(date).cast("date").alias("date"),
        "run_id",
        F.col("variant").alias("config"),
        F.lit(question).alias("rq"),
        "pr_auc", "recall_1pct", "fpr",
        F.lit(note).alias("note"),
        F.lit(test_opened).alias("test_opened"),
    )
