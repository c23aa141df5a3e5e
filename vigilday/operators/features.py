"""The volume stream: counts per user-day, their scaling and two scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilday.functions.joins import lookup_join
from vigilday.functions.windows import trailing

KEYS = ["user_id", "day"]


def count_features(events: DataFrame, actions: Sequence[str], by: str = "action") -> DataFrame:
    """How often each of the named actions occurs in a user-day, in one pass."""
    return events.groupBy(*KEYS).agg(*[F.count_if(F.col(by) == a).alias(f"n_{a}") for a in actions])


def offhour_features(flagged: DataFrame, actions: Sequence[str], by: str = "action") -> DataFrame:
    """The same counts for events flagged as outside working time (column ``off``)."""
    return flagged.groupBy(*KEYS).agg(
        *[F.count_if((F.col(by) == a) & (F.col("off") == 1)).alias(f"off_{a}") for a in actions]
    )


def fit_list(train: DataFrame, item: str, top_n: int, min_users: int) -> DataFrame:
    """The ``top_n`` most frequent items used by at least ``min_users`` users.

    Give train rows only: a list drawn from later rows would know the answers.
    """
    counted = (
        train.filter(F.col(item).isNotNull())
        .groupBy(item, "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(item)
        .agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_users"))
        .filter(F.col("n_users") >= min_users)
    )
    return counted.orderBy(F.desc("n_events"), item).limit(top_n)


def domain_list_features(web: DataFrame, domains: DataFrame, **bounds) -> DataFrame:
    """Web events per user-day, those whose host is on the list, and how many such hosts.

    Visits are counted by user-day and host before the join, so that a user who
    visits one host all day is one row of it.
    """
    listed = domains.select("host").distinct().withColumn("_listed", F.col("host"))
    visits = web.groupBy(*KEYS, "host").agg(F.count(F.lit(1)).alias("_n"))
    per_host = lookup_join(visits, listed, ["host"], **bounds)
    return per_host.groupBy(*KEYS).agg(
        F.sum("_n").alias("n_web"),
        F.coalesce(F.sum(F.when(F.col("_listed").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_listed"),
        F.count("_listed").alias("n_listed_hosts"),
    )


def words_of(text: Column) -> Column:
    """The lower-case words of a text: its runs of letters, marks, digits and underscore in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))


def keyword_features(
    texts: DataFrame, keywords: DataFrame, keys: Sequence[str] = KEYS, **bounds
) -> DataFrame:
    """Words, listed words and different listed words in the whole texts of each key.

    While the list is within the bounds of a broadcast, words off it become one
    NULL and are counted before the shuffle. Beyond them each word is joined by
    itself; its place in the text keeps equal words apart for the salt.
    """
    each = texts.select(*keys, F.posexplode_outer(words_of(F.col("text"))).alias("_place", "word"))
    known = keywords.select("word").distinct().withColumn("_listed", F.col("word"))
    counts = lookup_join(each, known, ["word"], **bounds).groupBy(*keys, "_listed").agg(
        F.count("word").alias("_all"), F.count("_listed").alias("_hit")
    )
    return counts.groupBy(*keys).agg(
        F.sum("_all").alias("n_words"), F.sum("_hit").alias("n_hits"), F.count("_listed").alias("n_keywords")
    )


def breadth_features(events: DataFrame) -> DataFrame:
    """Different objects and logs touched in a user-day, and the summed amount.

    Events with a list ``objects`` (all recipients of an email) touch each of
    them; the amount of such an event is counted once.
    """
    each = events.select(*KEYS, "object", "log", "qty")
    if "objects" in events.columns:
        each = events.select(
            *KEYS, "log", "qty", F.posexplode_outer("objects").alias("_place", "object")
        ).withColumn("qty", F.when(F.coalesce("_place", F.lit(0)) == 0, F.col("qty")))
    per_object = each.groupBy(*KEYS, "object", "log").agg(F.sum("qty").alias("_qty"))
    per_object = per_object.groupBy(*KEYS, "object").agg(
        F.sum("_qty").alias("_qty"), F.collect_set("log").alias("_logs")
    )
    return per_object.groupBy(*KEYS).agg(
        F.count("object").alias("n_objects"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_logs")))).cast("bigint").alias("n_logs"),
        F.sum("_qty").alias("sum_qty"),
    )


def fit_stats(train: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float]]:
    """Mean, population sd, least and largest train value per column: one row is read."""
    aggregates = []
    for c in columns:
        aggregates += [
            F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__sd"),
            F.min(c).cast("double").alias(f"{c}__low"), F.max(c).cast("double").alias(f"{c}__high"),
        ]
    row = train.agg(*aggregates).first()
    return {c: {k: row[f"{c}__{k}"] for k in ("mean", "sd", "low", "high")} for c in columns}


def transform(
    x_f: DataFrame, kind: str, columns: Sequence[str], stats: dict[str, dict[str, float]] | None = None
) -> DataFrame:
    """Scale features: ``none``, ``log1p``, ``zscore`` or ``minmax`` (the last two by train statistics)."""

    def scaled(c: str) -> Column:
        value = F.col(c).cast("double")
        if kind == "none":
            return value
        if kind == "log1p":
            return F.log1p(value)
        s = stats[c]
        if kind == "zscore":
            return (value - s["mean"]) / s["sd"] if s["sd"] else F.lit(0.0)
        if kind == "minmax":
            width = s["high"] - s["low"]
            return (value - s["low"]) / width if width else F.lit(0.0)
        raise ValueError(f"unknown transform {kind}")

    return x_f.withColumns({c: scaled(c) for c in columns})


def diag_score(x_f: DataFrame, columns: Sequence[str], stats: dict[str, dict[str, float]]) -> DataFrame:
    """Volume score: mean squared train z-score over the features, as ``s_f``."""
    z = transform(x_f, "zscore", columns, stats)
    total = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    return z.select(*KEYS, (total / len(columns)).alias("s_f"))


def fit_pca(train: DataFrame, columns: Sequence[str], k: int) -> PipelineModel:
    """Standardise on train rows and keep ``k`` principal directions.

    Stands in for the volume model, with its latent size as ``k``. Only the
    d x d covariance reaches the driver. Training needs centred data, hence the
    scaler in front.
    """
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="_x"),
            StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True),
            PCA(k=k, inputCol="_z", outputCol="_p"),
        ]
    ).fit(train)


def pca_score(x_f: DataFrame, model: PipelineModel) -> DataFrame:
    """Volume score: squared distance from the train subspace, as ``s_f``."""

    def length(c: str) -> Column:
        return F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, v: a + v * v)

    return model.transform(x_f).select(
        *KEYS, F.greatest(length("_z") - length("_p"), F.lit(0.0)).alias("s_f")
    )


def daily_state(x_f: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("day",)) -> DataFrame:
    """Mergeable state of the columns per key: ``n``, ``means`` and ``comoments`` (sums of products of deviations, by rows).

    States are merged by :func:`merge_state`, so a further day is added, or a day left out, without reading any other again.
    """
    def product(a: str, b: str) -> Column:
        return (F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) * F.count(F.lit(1))).alias(f"{a}|{b}")

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = x_f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m|{c}") for c in columns], *[product(a, b) for a, b in pairs]
    )
    known = {f"{a}|{b}" for a, b in pairs}
    return sums.select(
        *keys, "n",
        F.array(*[F.col(f"`m|{c}`") for c in columns]).alias("means"),
        F.array(*[F.col(f"`{a}|{b}`" if f"{a}|{b}" in known else f"`{b}|{a}`") for a in columns for b in columns]).alias("comoments"),
    )


def merge_state(states: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One state from many: the rows (``i``, ``j``, ``n``, ``mean_i``, ``mean_j``, ``comoment``) of all pairs of columns.

    The parts' co-moments are added to those of their means around the common mean.
    """
    d = len(columns)
    names = F.array(*[F.lit(c) for c in columns])
    means = states.agg(
        F.sum("n").alias("_n"), *[(F.sum(F.col("n") * F.get("means", F.lit(i))) / F.sum("n")).alias(f"_m{i}") for i in range(d)]
    )
    both = states.join(F.broadcast(means), F.lit(True))  # one row
    off = [F.get("means", F.lit(i)) - F.col(f"_m{i}") for i in range(d)]
    total = [
        F.sum(F.get("comoments", F.lit(i * d + j)) + F.col("n") * off[i] * off[j]).alias(f"_c{i * d + j}") for i in range(d) for j in range(d)
    ]
    first = [F.first(f"_m{i}").alias(f"_m{i}") for i in range(d)]
    merged = both.agg(F.first("_n").alias("n"), *first, *total)
    rows = F.array(*[
        F.struct(
            F.get(names, F.lit(i)).alias("i"), F.get(names, F.lit(j)).alias("j"), F.col("n"), F.col(f"_m{i}").alias("mean_i"),
            F.col(f"_m{j}").alias("mean_j"), F.col(f"_c{i * d + j}").alias("comoment"),
        )
        for i in range(d) for j in range(d)
    ])
    return merged.select(F.explode(rows).alias("_r")).select("_r.*").filter("n > 0")


@dataclass(frozen=True)
class Directions:
    """Principal directions of standardised columns, largest variance first, with what is needed to standardise."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    variances: tuple[float, ...]
    directions: tuple[tuple[float, ...], ...]


def fit_directions(state: DataFrame, columns: Sequence[str]) -> Directions:
    """The principal directions from :func:`merge_state`: d * d numbers reach the driver, whatever the rows.

    A column without spread is left at 0 and adds nothing to any direction.
    """
    rows = {(r["i"], r["j"]): r for r in state.collect()}
    if not rows:
        raise ValueError("there are no rows to fit on")
    n = next(iter(rows.values()))["n"]
    cov = np.array([[rows[a, b]["comoment"] for b in columns] for a in columns]) / max(1, n - 1)
    sds = np.sqrt(np.diag(cov))
    scale = np.where(sds > 0, sds, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    return Directions(
        tuple(columns), tuple(float(rows[c, c]["mean_i"]) for c in columns), tuple(float(s) for s in sds),
        tuple(float(v) for v in values[::-1]), tuple(tuple(float(x) for x in vectors[:, i]) for i in range(len(columns))[::-1]),
    )


def reconstruction_errors(x_f: DataFrame, fit: Directions, keep: Sequence[str] = KEYS) -> DataFrame:
    """Squared distance of every row from the span of the first k directions, for k = 0 to d: column ``errors``.

    One pass gives all k, so choosing the latent size costs no further fit.
    """
    z = [
        (F.col(c).cast("double") - F.lit(m)) / F.lit(s) if s else F.lit(0.0)
        for c, m, s in zip(fit.columns, fit.means, fit.sds)
    ]
    marked = x_f.select(*keep, *[v.alias(f"_z{i}") for i, v in enumerate(z)])
    parts = [sum((F.lit(w) * F.col(f"_z{i}") for i, w in enumerate(d)), F.lit(0.0)) for d in fit.directions]
    whole = sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(len(z))), F.lit(0.0))
    marked = marked.withColumns({"_all": whole, **{f"_p{i}": p * p for i, p in enumerate(parts)}})
    errors = [
        F.greatest(F.col("_all") - sum((F.col(f"_p{i}") for i in range(k)), F.lit(0.0)), F.lit(0.0)) for k in range(len(parts) + 1)
    ]
    return marked.select(*keep, F.array(*errors).alias("errors"))


def latent_losses(x_f: DataFrame, fit: Directions) -> DataFrame:
    """Per k the mean error of train rows, of validation rows, and the variance that k directions discard of train rows.

    ``x_f`` has the part. The train error equals the discarded variance, never grows with k, and is 0 with all directions.
    """
    d = len(fit.columns)
    errors = reconstruction_errors(x_f, fit, ["split"])
    found = errors.filter("split in ('train', 'val')").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get("errors", F.lit(k))) for k in range(d + 1)]).alias("mean")
    )
    wide = found.agg(*[
        F.max(F.when(F.col("split") == part, F.struct("n", "mean"))).alias(part) for part in ("train", "val")
    ])
    discarded = F.array(*[F.lit(float(sum(fit.variances[k:]))) for k in range(d + 1)])
    return wide.select("train", "val", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("latent")).select(
        "latent",
        F.get("train.mean", F.col("latent")).alias("train_error"),
        # variances divide by one row less than the mean does
        (F.get(discarded, F.col("latent")) * (F.col("train.n") - 1) / F.col("train.n")).alias("discarded"),
        F.get("val.mean", F.col("latent")).alias("error"),
    )


def trailing_breadth(events: DataFrame, days: int, lg_k: int = 12) -> DataFrame:
    """About how many different objects a user touched on days ``[d - days, d - 1]``: ``n_objects_past``.

    One sketch per user-day is made from the events; a window is the union of its days' sketches, so no
    event is read for more than its own day. Without earlier days it is 0. The relative standard error is about 0.8 / sqrt(2^lg_k).
    """
    sketches = events.groupBy(*KEYS).agg(F.hll_sketch_agg("object", F.lit(lg_k)).alias("_sketch"))
    past = F.hll_union_agg("_sketch").over(trailing(["user_id"], days))
    before = F.count(F.lit(1)).over(trailing(["user_id"], days))
    return sketches.withColumns({"_past": past, "_days": before}).select(
        *KEYS, F.when(F.col("_days") > 0, F.hll_sketch_estimate("_past")).otherwise(F.lit(0)).cast("bigint").alias("n_objects_past")
    )
