"""Variants with parts of the method switched off, and outside baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilday.functions.quantiles import exact_quantile
from vigilday.functions.storage import stored
from vigilday.functions.windows import trailing
from vigilday.operators.fusion import fuse
from vigilday.operators.metrics import confusion, fpr, pr_auc
from vigilday.operators.threshold import EPS
from vigilday.operators.tiers import baselines, shrink, weights

STREAMS = {"feature": "s_f", "sequence": "s_s", "fused": "s"}
TIERS = ("off", "P", "PG", "PGA")


def variant_scores(
    ud: DataFrame, *, alpha: float, group_key: str, days: int, min_group_size: int,
    k_p: float, k_g: float, p: float, tau_days: int, min_hist: int, floor: float = 0.5,
) -> DataFrame:
    """One row per user-day and variant (stream, tiers) with its score and own threshold.

    All variants are columns first, so the baselines and thresholds of the twelve
    share one shuffle by user and one by (group, day); rows fan out last. No past
    in the tiers a variant uses means no deviation: score 0.
    """
    fused = ud.withColumn("s", fuse("s_f", "s_s", alpha))
    based = baselines(fused, list(STREAMS.values()), group_key, days, min_group_size)
    for tier in TIERS[1:]:
        based = based.withColumns(weights(k_p, k_g, tier))
    names = {(s, t): f"v_{s}_{t}" for s in STREAMS for t in TIERS}
    scores = {}
    for (stream, tier), name in names.items():
        c = STREAMS[stream]
        value = F.col(c) if tier == "off" else shrink(c, floor, tier)
        scores[name] = F.coalesce(value, F.lit(0.0))
    w = trailing(["user_id"], tau_days)
    enough = F.count(F.lit(1)).over(w) >= min_hist
    taus = {
        f"t{name}": F.when(enough, F.percentile(F.col(name), F.lit(float(p))).over(w)) for name in names.values()
    }
    wide = based.withColumns(scores).withColumns(taus)
    rows = ", ".join(f"'{s}', '{t}', {n}, t{n}" for (s, t), n in names.items())
    return wide.select(
        "user_id", "day", "split", F.expr(f"stack({len(names)}, {rows}) as (stream, tiers, score, tau)")
    )


def ablate(variants: DataFrame, labels: DataFrame, p: float, eps: float = EPS) -> DataFrame:
    """Test metrics per stream, tiers and threshold (``user`` or one ``global`` for all).

    The global threshold is the validation quantile of the variant. Labels
    (user_id, day, label) are joined here and nowhere earlier.
    """
    variants = stored(variants.filter("split in ('val', 'test')"))
    shared = exact_quantile(
        variants.filter("split = 'val'"), ["stream", "tiers"], "score", p, "tau_all"
    ).drop("n_tau_all")
    test = (
        variants.filter("split = 'test'")
        .join(labels.select("user_id", "day", "label"), ["user_id", "day"], "left")
        .na.fill(0, ["label"])
        .join(F.broadcast(shared), ["stream", "tiers"], "left")  # twelve rows
    )
    test = stored(test)
    # both thresholds are counted in one pass, then become rows
    y = F.col("label") == 1
    counted = []
    for kind, tau in (("user", "tau"), ("global", "tau_all")):
        a = F.coalesce(F.col("score") - F.col(tau) > eps, F.lit(False))
        counted.append(F.struct(
            F.lit(kind).alias("threshold"), F.count_if(a & y).alias("tp"), F.count_if(a & ~y).alias("fp"),
            F.count_if(~a & ~y).alias("tn"), F.count_if(~a & y).alias("fn"),
        ))
    judged = test.groupBy("stream", "tiers").agg(F.array(*counted).alias("_k"))
    counts = fpr(judged.select("stream", "tiers", F.inline("_k")))
    area = pr_auc(
        test.withColumn("score", F.round("score", 9)), "score", by=["stream", "tiers"]
    ).select("stream", "tiers", "pr_auc")
    return counts.join(F.broadcast(area), ["stream", "tiers"])  # twelve rows


def rollup(ablation: DataFrame) -> DataFrame:
    """Sub-totals of the ablation over each axis, each pair of axes, and overall."""
    return ablation.cube("stream", "tiers", "threshold").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.sum("tp").alias("tp"),
        F.sum("fp").alias("fp"),
        F.avg("pr_auc").alias("mean_pr_auc"),
        F.max("pr_auc").alias("best_pr_auc"),
    )


def baseline_compare(
    scored: DataFrame, labels: DataFrame, columns: Sequence[str], p: float, eps: float = EPS
) -> DataFrame:
    """Simple outside baselines: each score column under one company-wide validation quantile."""
    rows = F.array(*[F.struct(F.lit(c).alias("baseline"), F.col(c).cast("double").alias("score")) for c in columns])
    long = scored.select("user_id", "day", "split", F.explode(rows).alias("_b")).select(
        "user_id", "day", "split", "_b.*"
    )
    tau = exact_quantile(long.filter("split = 'val'"), ["baseline"], "score", p, "tau").drop("n_tau")
    test = (
        long.filter("split = 'test'")
        .join(labels.select("user_id", "day", "label"), ["user_id", "day"], "left")
        .na.fill(0, ["label"])
        .join(F.broadcast(tau), "baseline")  # one row per baseline
        .withColumn("alert", (F.col("score") - F.col("tau") > eps).cast("int"))
    )
    counts = fpr(confusion(test, ["baseline", "tau"]))
    area = pr_auc(test.withColumn("score", F.round("score", 9)), "score", by=["baseline"])
    return counts.join(F.broadcast(area.select("baseline", "pr_auc")), "baseline")
