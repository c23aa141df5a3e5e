"""A threshold of its own for every user, and the alerts above it.

The quantile form, the meaning of the refresh interval and the cold-start chain
are our readings. History is always strictly before the day it is used for.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilday.functions.joins import lookup_join
from vigilday.functions.ordering import MAX_GROUP, top_rows
from vigilday.functions.quantiles import exact_quantile
from vigilday.functions.windows import trailing

KEYS = ["user_id", "day"]
EPS = 1e-9
# k of the quantile sketches
SKETCH = 200


def quantile_threshold(
    scores: DataFrame, score: str, p: float, days: int, min_hist: int = 1, by: Sequence[str] = ("user_id",)
) -> DataFrame:
    """Add ``tau``, the p-quantile of the user's own scores on days ``[d - days, d - 1]``.

    NULL with fewer than ``min_hist`` scores in the window. A group of ``by`` has
    one row per day, so the calendar bounds it.
    """
    w = trailing(list(by), days)
    tau = F.percentile(F.col(score), F.lit(float(p))).over(w)
    return scores.withColumn("tau", F.when(F.count(score).over(w) >= min_hist, tau))


def first_day(scores: DataFrame) -> date:
    """The day the refresh blocks are counted from."""
    return scores.agg(F.min("day")).first()[0]


def covered_blocks(scores: DataFrame, refresh: int, days: int, start: date) -> DataFrame:
    """Each row once per refresh block whose history window it lies in.

    Block k uses days ``[d0 + kR - days, d0 + kR - 1]``, so a row is in at most
    ``ceil(days / R)`` blocks, whatever its user or group.
    """
    since = F.datediff("day", F.lit(start))
    low = F.floor(since / refresh) + 1
    high = F.floor((since + days) / refresh)
    return (
        scores.withColumn("_low", low.cast("int"))
        .withColumn("_high", high.cast("int"))
        .filter("_low <= _high")
        .withColumn("block", F.explode(F.sequence("_low", "_high")))
        .drop("_low", "_high")
    )


def block_of(scores: DataFrame, refresh: int, start: date) -> DataFrame:
    return scores.withColumn("block", F.floor(F.datediff("day", F.lit(start)) / refresh).cast("int"))


def refreshed_threshold(
    scores: DataFrame, score: str, p: float, days: int, refresh: int, min_hist: int = 1,
    start: date | None = None,
) -> DataFrame:
    """Add ``tau`` recomputed every ``refresh`` days and held in between, with its ``block``.

    One quantile per user and block, instead of one per user and day.
    """
    start = start or first_day(scores)
    history = covered_blocks(scores.filter(F.col(score).isNotNull()), refresh, days, start)
    taus = (
        history.groupBy("user_id", "block")
        .agg(F.percentile(F.col(score), F.lit(float(p))).alias("tau"), F.count(F.lit(1)).alias("_h"))
        .filter(F.col("_h") >= min_hist)
        .drop("_h")
    )
    return block_of(scores, refresh, start).join(taus, ["user_id", "block"], "left")


def threshold_series(with_tau: DataFrame) -> DataFrame:
    """The threshold of each user by the day it takes effect (start of its block)."""
    return (
        with_tau.groupBy("user_id", "block")
        .agg(F.min("day").alias("effective_from"), F.max("tau").alias("tau"))
        .filter(F.col("tau").isNotNull())
        .select("user_id", "effective_from", "tau")
    )


def threshold_intervals(with_tau: DataFrame, refresh: int, start: date) -> DataFrame:
    """The thresholds of :func:`refreshed_threshold` as closed-open validity intervals: user_id, valid_from, valid_to, tau.

    A threshold takes effect on the first day of its block and holds until the user's next one, over blocks in which the
    history was too short; the last has no end (NULL).
    """
    begins = F.date_add(F.lit(start), (F.col("block") * refresh).cast("int"))
    taken = (
        with_tau.filter(F.col("tau").isNotNull()).groupBy("user_id", "block").agg(F.max("tau").alias("tau"))
        .select("user_id", begins.alias("valid_from"), "tau")
    )
    after = F.lead("valid_from").over(Window.partitionBy("user_id").orderBy("valid_from"))
    return taken.select("user_id", "valid_from", after.alias("valid_to"), "tau")


def in_force(scores: DataFrame, intervals: DataFrame) -> DataFrame:
    """Add ``tau``, the threshold in force on the day of each score, whenever the score arrives.

    No quantile is computed again: intervals and scores of a user are put in one order and the latest
    threshold is carried forward, one shuffle and no pairs. Before a user's first interval there is no threshold.
    """
    starts = intervals.select("user_id", F.col("valid_from").alias("day"), F.lit(0).alias("_kind"), "tau")
    rest = [c for c in scores.columns if c not in (*KEYS, "tau")]
    rows = scores.select(*KEYS, F.lit(1).alias("_kind"), F.struct("day", *rest).alias("_row"))
    so_far = (
        Window.partitionBy("user_id").orderBy("day", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.unionByName(starts, allowMissingColumns=True)
        .withColumn("_tau", F.last("tau", ignorenulls=True).over(so_far))
        .filter("_kind = 1")
        .select(*KEYS, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_tau").alias("tau"))
    )


def sketched_quantile(
    scores: DataFrame, keys: Sequence[str], score: str, p: float, days: int, refresh: int, start: date,
    name: str = "tau", size: int = SKETCH,
) -> DataFrame:
    """Per (keys, block) the approximate ``p``-quantile of the block's history, from one sketch per (keys, day).

    The scores of a day are sketched once; a block merges the sketches of its days, so a score is not repeated for every block that
    covers it. ``size`` is the sketch's k: at 200 ranks are off by about 1.4 % of the scores at most, with 99 % confidence.
    """
    daily = scores.filter(F.col(score).isNotNull()).groupBy(*keys, "day").agg(
        F.kll_sketch_agg_double(F.col(score).cast("double"), size).alias("_sketch"), F.count(F.lit(1)).alias("_n")
    )
    merged = covered_blocks(daily, refresh, days, start).groupBy(*keys, "block").agg(
        F.kll_merge_agg_double("_sketch", size).alias("_sketch"), F.sum("_n").alias(f"n_{name}")
    )
    return merged.select(*keys, "block", F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))).alias(name), f"n_{name}")


def cold_start_threshold(
    scores: DataFrame,
    score: str,
    p: float,
    days: int,
    refresh: int,
    min_hist: int,
    group_key: str,
    sketch: bool = False,
    max_group: int = MAX_GROUP,
    **bounds,
) -> DataFrame:
    """Own threshold, or the group's, or the company's, with ``tau_from`` saying which.

    A tier is used when its window holds at least ``min_hist`` scores; with no
    tier there is no threshold. Group and company quantiles are exact, from
    counts of equal scores, or approximate, from one mergeable sketch per day.
    """
    start = first_day(scores)
    own = refreshed_threshold(scores, score, p, days, refresh, min_hist, start).withColumnRenamed("tau", "tau_own")
    known = scores.filter(F.col(score).isNotNull())
    if sketch:
        in_group = known.filter(F.col(group_key).isNotNull())
        by_group = sketched_quantile(in_group, [group_key], score, p, days, refresh, start, "tau_group")
        by_all = sketched_quantile(known, [], score, p, days, refresh, start, "tau_all")
    else:
        history = covered_blocks(known, refresh, days, start)
        in_group = history.filter(F.col(group_key).isNotNull())
        by_group = exact_quantile(in_group, [group_key, "block"], score, p, "tau_group", max_group)
        by_all = exact_quantile(history, ["block"], score, p, "tau_all", max_group)
    out = lookup_join(own, by_group, [group_key, "block"], **bounds)
    out = lookup_join(out, by_all, ["block"], **bounds)
    group_tau = F.when(F.col("n_tau_group") >= min_hist, F.col("tau_group"))
    all_tau = F.when(F.col("n_tau_all") >= min_hist, F.col("tau_all"))
    source = (
        F.when(F.col("tau_own").isNotNull(), "own")
        .when(group_tau.isNotNull(), "group")
        .when(all_tau.isNotNull(), "company")
    )
    return out.withColumns({"tau": F.coalesce("tau_own", group_tau, all_tau), "tau_from": source}).drop(
        "tau_own", "tau_group", "n_tau_group", "tau_all", "n_tau_all"
    )


def alerts(scored: DataFrame, score: str = "score", eps: float = EPS) -> DataFrame:
    """User-days whose score is above their threshold: user_id, day, score, tau, margin.

    ``eps`` keeps a score that equals its threshold but for rounding out.
    """
    return (
        scored.filter(F.col(score) - F.col("tau") > eps)
        .select(*KEYS, F.col(score).alias("score"), "tau", (F.col(score) - F.col("tau")).alias("margin"))
    )


def budget_curve(
    scores: DataFrame, score: str, grid: Sequence[float], history: str = "split = 'train'",
    target: str = "split = 'val'", budget: float = 5.0, eps: float = EPS,
) -> DataFrame:
    """Alerts per validation day for each p of the grid, and which p is chosen.

    Every user's thresholds for all p come from one pass over their history
    before validation. Chosen is the smallest p whose mean is within the budget,
    else the largest p. No label is read.
    """
    taus = scores.filter(history).groupBy("user_id").agg(
        F.percentile(F.col(score), F.array(*[F.lit(float(p)) for p in grid])).alias("_taus")
    )
    counted = (
        scores.filter(target)
        .join(taus, "user_id", "left")
        .groupBy("day")
        .agg(*[
            F.count_if(F.col(score) - F.element_at("_taus", i + 1) > eps).alias(f"_a{i}")
            for i in range(len(grid))
        ])
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            *[F.sum(f"_a{i}").alias(f"_a{i}") for i in range(len(grid))],
        )
    )
    rows = F.array(*[
        F.struct(F.lit(float(p)).alias("p"), F.coalesce(f"_a{i}", F.lit(0)).alias("n_alerts"))
        for i, p in enumerate(grid)
    ])
    within = F.filter("_rows", lambda r: r["n_alerts"] <= budget * F.col("n_days"))
    smallest = F.array_min(F.transform(within, lambda r: r["p"]))
    return (
        counted.select("n_days", rows.alias("_rows"))
        .withColumn("_p", F.coalesce(smallest, F.lit(float(max(grid)))))
        .select("n_days", "_p", F.explode("_rows").alias("_r"))
        .select(
            F.col("_r.p").alias("p"),
            F.col("_r.n_alerts").alias("n_alerts"),
            F.try_divide(F.col("_r.n_alerts").cast("double"), F.col("n_days")).alias("alerts_per_day"),
            (F.col("_r.p") == F.col("_p")).cast("int").alias("chosen"),
        )
    )


def select_p(
    selection: str, p: float | None = None, curve: DataFrame | None = None
) -> float:
    """The p in use: given (``fixed``) or the chosen one of :func:`budget_curve` (``budget``)."""
    if selection == "fixed":
        return float(p)
    if selection == "budget":
        return float(curve.filter("chosen = 1").first()["p"])
    raise ValueError(f"unknown selection {selection}")


def cap(found: DataFrame, budget: int) -> DataFrame:
    """At most ``budget`` alerts a day, the widest margins first; ``rank`` is their place.

    The budget is the feature: how many alerts a day can be looked into. Margins
    are compared to nine digits, then the user decides.
    """
    return top_rows(found, ["day"], [F.desc(F.round("margin", 9)), F.col("user_id")], budget)
