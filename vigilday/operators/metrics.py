"""Evaluation: the only stage that reads labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilday.functions.ordering import MAX_GROUP, positions, running_sums
from vigilday.functions.storage import stored
from vigilday.functions.windows import unit_hash



def poisson_cuts(steps: float = 2.0**32) -> list[float]:
    """Chances of a Poisson(1) draw of at most 0, 1, 2 ..., as far as a hash of ``steps`` values tells them from 1."""
    cuts, term, total = [], math.exp(-1.0), 0.0
    while total < 1.0 - 1.0 / steps:
        total += term
        cuts.append(round(total, 12))
        term /= len(cuts)
    return cuts


POISSON_CUTS = poisson_cuts()


def confusion(judged: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    """Counts of user-days by alert and label. ``judged`` has ``alert`` and ``label`` as 0 or 1."""
    a, y = F.col("alert") == 1, F.col("label") == 1
    return judged.groupBy(*by).agg(
        F.count_if(a & y).alias("tp"),
        F.count_if(a & ~y).alias("fp"),
        F.count_if(~a & ~y).alias("tn"),
        F.count_if(~a & y).alias("fn"),
    )


def fpr(counts: DataFrame) -> DataFrame:
    """False-positive rate and recall of :func:`confusion`; NULL where undefined."""
    return counts.withColumns({
        "fpr": F.try_divide(F.col("fp").cast("double"), F.col("fp") + F.col("tn")),
        "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")),
    })


def judge(scored: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``alert`` to every scored user-day."""
    hit = found.select("user_id", "day", F.lit(1).alias("alert"))
    return scored.join(hit, ["user_id", "day"], "left").na.fill(0, ["alert"])


def pr_auc(
    scores: DataFrame, score: str, label: str = "label", by: Sequence[str] = (), weight: Column | None = None,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Average precision per ``by``: sum of tp_i * TP_i / N_i over scores, divided by P.

    Equal scores are one step. They are counted together first; the running sums
    over the steps are sliced by score, so no task holds a whole ranking.
    """
    w = F.lit(1) if weight is None else weight
    steps = stored(
        scores.filter(F.col(score).isNotNull())
        .groupBy(*by, score)
        .agg(F.sum(w).alias("_n"), F.sum(w * F.col(label)).alias("_t"))
    )
    run = running_sums(
        steps, by, [F.desc(score)], {"_cn": F.col("_n"), "_ct": F.col("_t")}, totals=True, max_group=max_group
    )
    part = F.try_divide(F.col("_t") * F.col("_ct"), F.col("_cn").cast("double"))
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(part), F.max("_ct_total")).alias("pr_auc"),
        F.max("_cn_total").alias("n"),
        F.max("_ct_total").alias("n_pos"),
    )


def recall_at_k(
    scores: DataFrame, score: str, ks: Sequence[float], keys: Sequence[str], label: str = "label",
    by: Sequence[str] = (), max_group: int = MAX_GROUP,
) -> DataFrame:
    """Share of the positives among the first ceil(k * n) rows by score, then ``keys``."""
    ranked = positions(
        stored(scores.filter(F.col(score).isNotNull()).select(*by, *keys, score, label)),
        by, [F.desc(score), *[F.col(k) for k in keys]], "_pos", totals=True, max_group=max_group,
    )
    y = F.col(label) == 1
    inside = [F.count_if(y & (F.col("_pos") <= F.ceil(F.lit(float(k)) * F.col("_pos_total")))) for k in ks]
    counted = ranked.groupBy(*by).agg(
        F.count_if(y).alias("n_pos"), F.count(F.lit(1)).alias("n"),
        *[c.alias(f"_h{i}") for i, c in enumerate(inside)],
    )
    rows = F.array(*[
        F.struct(F.lit(float(k)).alias("k"), F.col(f"_h{i}").alias("hits")) for i, k in enumerate(ks)
    ])
    return counted.select(*by, "n", "n_pos", F.explode(rows).alias("_r")).select(
        *by, F.col("_r.k").alias("k"), F.col("_r.hits").alias("hits"), "n_pos",
        F.try_divide(F.col("_r.hits").cast("double"), F.col("n_pos")).alias("recall"),
    )


def recall_by_scenario(judged: DataFrame) -> DataFrame:
    """Insiders with an alert on a malicious day, by scenario: a user counts once."""
    per_user = (
        judged.filter("label = 1").groupBy("scenario", "user_id").agg(F.max("alert").alias("found"))
    )
    return per_user.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_insiders"),
        F.sum("found").cast("bigint").alias("n_found"),
        F.avg("found").alias("recall"),
    )


def poisson_weight(*key: Column | str) -> Column:
    """How often a user is drawn in one bootstrap replicate, fixed by the key."""
    u = unit_hash(*key)
    drawn = F.lit(0)
    for cut in POISSON_CUTS:
        drawn = drawn + (u >= cut).cast("int")
    return drawn


def bootstrap(
    scores: DataFrame, score: str, n: int, k: float, seed: int = 42, label: str = "label",
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Average precision and recall at ``k`` in each of ``n`` replicates of the users.

    All days of a user are drawn together. A user's equal scores are counted
    before the replicates fan out, and each replicate's steps are summed in the
    map tasks, so the shuffle carries scores, not user-days. Rows of the score
    step that straddles the cut count in proportion.
    """
    per_user = (
        scores.filter(F.col(score).isNotNull())
        .groupBy("user_id", score)
        .agg(F.count(F.lit(1)).alias("_m"), F.sum(label).alias("_y"))
    )
    # a user's draw is made once per replicate, not once per score; a user's scores are bounded by their days
    per_user = per_user.groupBy("user_id").agg(F.collect_list(F.struct(score, "_m", "_y")).alias("_s"))
    drawn = (
        per_user.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("_w", poisson_weight(F.lit(seed), F.col("user_id"), F.col("rep")))
        .filter("_w > 0")
        .select("rep", "_w", F.inline("_s"))
    )
    steps = stored(drawn.groupBy("rep", score).agg(
        F.sum(F.col("_w") * F.col("_m")).alias("_n"), F.sum(F.col("_w") * F.col("_y")).alias("_t")
    ))
    run = running_sums(
        steps, ["rep"], [F.desc(score)], {"_cn": F.col("_n"), "_ct": F.col("_t")}, totals=True, max_group=max_group
    )
    cut = F.ceil(F.lit(float(k)) * F.col("_cn_total"))
    share = F.greatest(F.least((cut - (F.col("_cn") - F.col("_n"))) / F.col("_n"), F.lit(1.0)), F.lit(0.0))
    part = F.col("_t") * F.col("_ct") / F.col("_cn").cast("double")
    return run.groupBy("rep").agg(
        F.try_divide(F.sum(part), F.max("_ct_total")).alias("pr_auc"),
        F.try_divide(F.sum(F.col("_t") * share), F.max("_ct_total")).alias("recall"),
    )


def bootstrap_ci(replicates: DataFrame, metrics: Sequence[str] = ("pr_auc", "recall")) -> DataFrame:
    """2.5, 50 and 97.5 percent points over the replicates that have positives."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))
    return (
        replicates.select(rows.alias("_r"))
        .groupBy(F.col("_r.metric").alias("metric"))
        .agg(
            F.count("_r.value").alias("n_reps"),
            F.percentile(F.col("_r.value"), F.lit(0.025)).alias("low"),
            F.percentile(F.col("_r.value"), F.lit(0.5)).alias("mid"),
            F.percentile(F.col("_r.value"), F.lit(0.975)).alias("high"),
        )
    )
