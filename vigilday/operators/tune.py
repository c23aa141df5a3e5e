"""Choosing parameters on validation days, without labels.

A seeded random search stands in for an adaptive optimiser. The objective, how
stable the daily alerts are, is ours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilday.functions.joins import lookup_join
from vigilday.functions.ordering import top_rows
from vigilday.functions.storage import stored
from vigilday.functions.windows import trailing, unit_hash
from vigilday.operators.fusion import fuse
from vigilday.operators.threshold import EPS
from vigilday.operators.tiers import flag_size, shrink, users_seen, weights

SUMS = ("n", "a", "b", "aa", "bb", "ab")


@dataclass(frozen=True)
class Trial:
    trial: int
    alpha: float
    k_p: int
    k_g: int
    days: int
    p: float = 0.95
    order: int = 2
    latent: int = 2


@dataclass(frozen=True)
class Space:
    """Ranges searched: alpha in [0, 1] to two digits, whole numbers, and lists.

    ``order`` is the length of the order model's n-grams, 0 for the masked model;
    ``latent`` the number of directions the volume model keeps.
    """

    k_p: tuple[int, int] = (1, 20)
    k_g: tuple[int, int] = (5, 60)
    days: tuple[int, ...] = (7, 14)
    p: tuple[float, ...] = (0.8, 0.9, 0.95, 0.99)
    order: tuple[int, ...] = (0, 2, 3)
    latent: tuple[int, ...] = (1, 2, 3, 4)


def draw_trials(n: int, seed: int, space: Space = Space()) -> list[Trial]:
    """``n`` parameter sets, fixed by the seed."""

    def u(i: int, name: str) -> float:
        return int(hashlib.md5(f"{seed}|{i}|{name}".encode()).hexdigest()[:8], 16) / 2**32

    def whole(i: int, name: str, low: int, high: int) -> int:
        return low + int(u(i, name) * (high - low + 1))

    def one_of(i: int, name: str):
        choices = getattr(space, name)
        return choices[int(u(i, name) * len(choices))]

    return [
        Trial(i, round(u(i, "alpha"), 2), whole(i, "k_p", *space.k_p), whole(i, "k_g", *space.k_g),
              *[one_of(i, name) for name in ("days", "p", "order", "latent")])
        for i in range(1, n + 1)
    ]


def subsample_users(ud: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A fixed share of the users, each with all their days (a tuning option)."""
    users = ud.select("user_id").distinct().filter(unit_hash(F.lit(seed), F.col("user_id")) < share)
    return ud.join(users, "user_id", "left_semi")


def _products() -> dict[str, Column]:
    a, b = F.col("s_f"), F.col("s_s")
    return {"n": F.lit(1.0), "a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}


def _with_past_sums(ud: DataFrame, group_key: str, windows: Sequence[int], min_group_size: int, **bounds) -> DataFrame:
    """Trailing sums of both streams and their products, per tier and window length, and the group guard.

    They determine mean and variance of every fused score, so the windows are
    computed once and not once per trial.
    """
    ud = stored(ud.withColumns({f"_{k}": v for k, v in _products().items()}))

    def past(df: DataFrame, keys: list[str], tier: str) -> DataFrame:
        return df.withColumns({
            f"{k}_{tier}_{d}": F.coalesce(F.sum(f"_{k}").over(trailing(keys, d)), F.lit(0.0))
            for d in windows for k in SUMS
        })

    def daily(df: DataFrame, keys: list[str], tier: str) -> DataFrame:
        sums = df.groupBy(*keys, "day").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in SUMS])
        return past(sums, keys, tier).drop(*[f"_{k}" for k in SUMS])

    # sums and size of a group are one table, looked up once
    known = ud.filter(F.col(group_key).isNotNull())
    of_group = daily(known, [group_key], "g").join(users_seen(known, [group_key]), [group_key, "day"])
    out = flag_size(lookup_join(ud, of_group, [group_key, "day"], **bounds), min_group_size)
    out = out.join(F.broadcast(daily(ud, [], "a")), "day", "left")  # one row per calendar day
    return past(out, ["user_id"], "p").drop(*[f"_{k}" for k in SUMS])


def _trial_scores(
    summed: DataFrame, trials: Sequence[Trial], days: int, floor: float, keep: Sequence[str] = ()
) -> DataFrame:
    """Deviation of every row under each trial with this window length."""
    sums = [F.col(f"{k}_{t}_{days}").alias(f"{k}_{t}") for t in "pga" for k in SUMS]
    choices = ", ".join(f"{t.trial}, {t.alpha}D, {t.k_p}, {t.k_g}" for t in trials)
    fan = summed.select(
        "user_id", "day", *keep, "s_f", "s_s", "group_ok", *sums,
        F.expr(f"stack({len(trials)}, {choices}) as (trial, alpha, k_p, k_g)"),
    ).filter("n_a > 0")
    fan = fan.withColumn("s", fuse("s_f", "s_s", F.col("alpha")))
    fan = fan.withColumns({
        f"mu_{t}_s": F.expr(f"try_divide(alpha * a_{t} + (1 - alpha) * b_{t}, n_{t})") for t in "pga"
    })
    square = "(alpha * alpha * aa_{t} + 2 * alpha * (1 - alpha) * ab_{t} + (1 - alpha) * (1 - alpha) * bb_{t})"
    fan = fan.withColumns({
        f"sd_{t}_s": F.expr(f"sqrt(greatest(try_divide({square.format(t=t)}, n_{t}) - mu_{t}_s * mu_{t}_s, 0D))")
        for t in "pga"
    })
    return (
        fan.withColumns(weights("k_p", "k_g"))
        .withColumn("z", F.round(shrink("s", floor), 6))
        .select("trial", "day", "user_id", *keep, "z")
    )


def _stability(found: DataFrame) -> DataFrame:
    """Mean overlap of one day's alerts with the next day's, per trial. A budget bounds the rows per trial and day."""
    mine = Window.partitionBy("trial", "user_id").orderBy("day")
    stays = found.withColumn(
        "_again", (F.datediff("day", F.lag("day").over(mine)) == 1).cast("int")
    )
    daily = stays.groupBy("trial", "day").agg(
        F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("_again"), F.lit(0)).alias("_both")
    )
    days = Window.partitionBy("trial").orderBy("day")
    overlap = daily.withColumns({
        "_gap": F.datediff("day", F.lag("day").over(days)), "_n0": F.lag("_n").over(days)
    }).filter("_gap = 1")
    return overlap.groupBy("trial").agg(
        F.avg(F.col("_both") / (F.col("_n") + F.col("_n0") - F.col("_both"))).alias("objective")
    )


def sweep(
    ud: DataFrame, trials: Sequence[Trial], *, group_key: str, min_group_size: int, budget: int,
    floor: float = 0.5, **bounds,
) -> DataFrame:
    """Objective of every trial: the mean overlap of one validation day's alerts with the next's.

    ``ud`` has user_id, day, split, s_f, s_s and the group; there is no label in
    it. Only validation rows fan out to trials, and each map task keeps at most
    ``budget`` rows per trial and day before anything is shuffled.
    """
    windows = sorted({t.days for t in trials})
    ud = stored(ud)
    summed = stored(_with_past_sums(ud, group_key, windows, min_group_size, **bounds).filter("split = 'val'"))
    scored = reduce(
        DataFrame.unionByName,
        [_trial_scores(summed, [t for t in trials if t.days == d], d, floor) for d in windows],
    )
    found = top_rows(scored, ["trial", "day"], [F.desc("z"), F.col("user_id")], budget)
    objective = _stability(found)
    values = ", ".join(f"{t.trial}, {t.alpha}D, {t.k_p}, {t.k_g}, {t.days}" for t in trials)
    given = ud.sparkSession.range(1).select(
        F.expr(f"stack({len(trials)}, {values}) as (trial, alpha, k_p, k_g, days)")
    )
    return given.join(objective, "trial", "left")


def search(
    ud: DataFrame, trials: Sequence[Trial], order_loss: DataFrame, latent_loss: DataFrame, *, group_key: str,
    min_group_size: int, budget: int, floor: float = 0.5, eps: float = EPS, **bounds,
) -> DataFrame:
    """All trials with three objectives, none of which reads a label.

    ``stability``: the overlap of one validation day's alerts with the next's, an alert being a deviation above the
    user's own threshold, the trial's ``p``-quantile of the user's train deviations. A user's train
    deviations under a trial are one sorted history, from which the quantiles at all ``p`` of the
    search are read at once. ``order_loss`` (order, nll) and ``latent_loss`` (latent, error) give the held-out losses of the
    two models, one row per setting. ``ud`` has user_id, day, split, s_f, s_s and the group.
    """
    windows = sorted({t.days for t in trials})
    grid = sorted({t.p for t in trials})
    ud = stored(ud)
    summed = stored(_with_past_sums(ud, group_key, windows, min_group_size, **bounds).filter("split in ('train', 'val')"))
    scored = stored(reduce(
        DataFrame.unionByName,
        [_trial_scores(summed, [t for t in trials if t.days == d], d, floor, ["split"]) for d in windows],
    ))
    place = F.create_map(*[F.lit(x) for t in trials for x in (t.trial, grid.index(t.p) + 1)])
    # a user's days bound the history that one (trial, user) holds
    history = scored.filter("split = 'train' and z is not null").groupBy("trial", "user_id").agg(
        F.percentile("z", F.array(*[F.lit(float(p)) for p in grid])).alias("_taus")
    )
    taus = history.select("trial", "user_id", F.element_at("_taus", place[F.col("trial")]).alias("tau"))
    above = (
        scored.filter("split = 'val'").join(taus, ["trial", "user_id"])
        .withColumn("margin", F.col("z") - F.col("tau")).filter(F.col("margin") > eps)
    )
    found = stored(top_rows(above, ["trial", "day"], [F.desc(F.round("margin", 9)), F.col("user_id")], budget))
    days = scored.filter("split = 'val'").agg(F.count_distinct("day").alias("_days"))
    volume = found.groupBy("trial").agg(F.count(F.lit(1)).alias("_alerts"))
    values = ", ".join(f"{t.trial}, {t.alpha}D, {t.k_p}, {t.k_g}, {t.days}, {t.p}D, {t.order}, {t.latent}" for t in trials)
    given = ud.sparkSession.range(1).select(
        F.expr(f"stack({len(trials)}, {values}) as (trial, alpha, k_p, k_g, days, p, order, latent)")
    )
    # one row per trial, setting or in all: small whatever the data
    return (
        given.join(_stability(found).withColumnRenamed("objective", "stability"), "trial", "left")
        .join(volume, "trial", "left")
        .join(order_loss.select("order", "nll"), "order", "left")
        .join(latent_loss.select("latent", "error"), "latent", "left")
        .join(F.broadcast(days), F.lit(True))
        .select(
            *[f for f in Trial.__dataclass_fields__], "stability", "nll", "error",
            F.try_divide(F.coalesce("_alerts", F.lit(0)).cast("double"), F.col("_days")).alias("alerts_per_day"),
        )
    )


def searched_table(trials: DataFrame, run: str, space: Space = Space()) -> DataFrame:
    """Chosen value per parameter of :func:`search`, with its tier, range, goal, objective, trial and run.

    Fusion, tier and threshold parameters come from the most stable trial, a model's from the trial with its least held-out
    loss; the earliest of equals.
    """

    def listed(values: Sequence) -> str:
        return "{" + ", ".join(str(v) for v in values) + "}"

    goals = {
        "stability": ("stability", {
            "alpha": ("fusion", "[0, 1]"),
            "k_p": ("tiers", f"[{space.k_p[0]}, {space.k_p[1]}]"),
            "k_g": ("tiers", f"[{space.k_g[0]}, {space.k_g[1]}]"),
            "days": ("tiers", listed(space.days)),
            "p": ("threshold", listed(space.p)),
        }),
        "nll": ("-nll", {"order": ("order model", listed(space.order))}),
        "error": ("-error", {"latent": ("volume model", listed(space.latent))}),
    }
    trials = stored(trials)
    parts = []
    for goal, (score, facts) in goals.items():
        best = (
            trials.withColumn("_score", F.round(F.expr(score), 9)).filter("_score is not null")
            .orderBy(F.desc("_score"), "trial").limit(1)
        )
        rows = F.array(*[
            F.struct(
                F.lit(tier).alias("tier"), F.lit(name).alias("parameter"),
                F.col(name).cast("double").alias("value"), F.lit(span).alias("search_range"),
            )
            for name, (tier, span) in facts.items()
        ])
        parts.append(best.select(
            F.explode(rows).alias("_r"), F.lit(goal).alias("goal"), F.col(goal).alias("objective"), "trial"
        ).select("_r.*", "goal", "objective", "trial", F.lit(run).alias("run_id")))
    return reduce(DataFrame.unionByName, parts)


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the largest objective; the earliest of equals."""
    return trials.filter("objective is not null").orderBy(F.desc(F.round("objective", 9)), "trial").limit(1)


def tuned_table(trials: DataFrame, run: str, space: Space = Space()) -> DataFrame:
    """Chosen value per parameter with its tier, range, objective, trial and run."""
    facts = {
        "alpha": ("fusion", "[0, 1]"),
        "k_p": ("tiers", f"[{space.k_p[0]}, {space.k_p[1]}]"),
        "k_g": ("tiers", f"[{space.k_g[0]}, {space.k_g[1]}]"),
        "days": ("tiers", "{" + ", ".join(str(d) for d in space.days) + "}"),
    }
    rows = F.array(*[
        F.struct(
            F.lit(tier).alias("tier"), F.lit(name).alias("parameter"),
            F.col(name).cast("double").alias("value"), F.lit(span).alias("search_range"),
        )
        for name, (tier, span) in facts.items()
    ])
    return best_trial(trials).select(F.explode(rows).alias("_r"), "objective", "trial").select(
        "_r.*", "objective", "trial", F.lit(run).alias("run_id")
    )
