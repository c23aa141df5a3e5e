"""The order stream: tokens of a user-day, count models over them, and scores.

The count models stand in for a neural sequence model; they read order, but
their scores are not comparable with one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilday.functions.joins import lookup_join
from vigilday.functions.ordering import positions, top_rows
from vigilday.functions.storage import stored
from vigilday.functions.windows import unit_hash

KEYS = ["user_id", "day"]
START, END, UNKNOWN = "<BOS>", "<EOS>", "<UNK>"
SLICE = 100_000


def tokens(flagged: DataFrame, **bounds) -> DataFrame:
    """One row per event: its place in the user-day and its token.

    The token is log, action and whether it was outside working time. Events are
    ordered by time, then id. ``pos_total`` is the length of the day.
    """
    token = F.concat_ws(":", "log", "action", F.when(F.col("off") == 1, "off").otherwise("work"))
    placed = positions(
        flagged.select(*KEYS, "ts", "event_id", token.alias("token")),
        KEYS, [F.col("ts"), F.col("event_id")], totals=True, **bounds,
    )
    return placed.select(*KEYS, "pos", "pos_total", "token")


def token_arrays(seq: DataFrame, size: int = SLICE) -> DataFrame:
    """Tokens of a user-day as arrays, one per ``size`` places.

    The key is (user_id, day, chunk), and every row says in ``n_chunks`` how many
    make up its day: one for a usual day, more for a day longer than ``size``,
    because a row must stay within one task's memory.
    """
    return (
        seq.groupBy(*KEYS, F.floor((F.col("pos") - 1) / size).alias("chunk"))
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_t"),
            (F.floor((F.max("pos_total") - 1) / size) + 1).alias("n_chunks"),
        )
        .select(*KEYS, "chunk", "n_chunks", F.transform("_t", lambda t: t["token"]).alias("tokens"))
    )


def truncate(seq: DataFrame, max_len: int, mode: str) -> DataFrame:
    """Shorten long days: keep the ``head`` or ``tail``, or cut into a ``chunk`` column.

    Places and lengths are already known, so none of the three moves a row.
    """
    if mode == "head":
        return seq.filter(F.col("pos") <= max_len)
    if mode == "tail":
        return seq.filter(F.col("pos") > F.col("pos_total") - max_len)
    if mode == "chunk":
        return seq.withColumn("chunk", F.floor((F.col("pos") - 1) / max_len))
    raise ValueError(f"unknown truncation {mode}")


def fit_vocab(train: DataFrame, min_count: int) -> DataFrame:
    """Train tokens that occur at least ``min_count`` times."""
    return train.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def apply_vocab(seq: DataFrame, vocab: DataFrame, **bounds) -> DataFrame:
    """Replace tokens outside the vocabulary by ``<UNK>``."""
    known = vocab.select("token", F.lit(True).alias("_known"))
    return lookup_join(seq, known, ["token"], **bounds).withColumn(
        "token", F.when(F.col("_known"), F.col("token")).otherwise(UNKNOWN)
    ).drop("_known")


def neighbours(seq: DataFrame, back: int = 1, ahead: int = 0, size: int = SLICE) -> DataFrame:
    """Add the tokens before (``prev1``, ``prev2`` …) and after (``next1`` …) each one.

    A day is read in slices of ``size`` places. The rows next to a slice's edge
    are repeated in the neighbouring slice, serve there as context only and are
    dropped again, so a day of any length is spread over tasks.
    """
    if size < max(back, ahead):
        raise ValueError("a slice must be at least as long as the context")
    place = F.col("pos") - 1
    own = F.floor(place / size)
    last, first = place % size >= size - back, (place % size < ahead) & (own > 0)
    reach = (
        F.when(last & first, F.array(own - 1, own, own + 1))
        .when(last, F.array(own, own + 1))
        .when(first, F.array(own - 1, own))
        .otherwise(F.array(own))
    )
    spread = seq.withColumn("_own", own).withColumn("_slice", F.explode(reach))
    w = Window.partitionBy(*KEYS, "_slice").orderBy("pos")
    added = {f"prev{i}": F.coalesce(F.lag("token", i).over(w), F.lit(START)) for i in range(1, back + 1)}
    added |= {f"next{i}": F.coalesce(F.lead("token", i).over(w), F.lit(END)) for i in range(1, ahead + 1)}
    return spread.withColumns(added).filter(F.col("_slice") == F.col("_own")).drop("_slice", "_own")


@dataclass(frozen=True)
class CountModel:
    """Add-one smoothed counts: one table per context, its totals, and the vocabulary size.

    ``contexts`` lists the context columns of each table, ``weights`` how their
    probabilities are mixed.
    """

    contexts: tuple[tuple[str, ...], ...]
    weights: tuple[float, ...]
    tables: tuple[DataFrame, ...]
    totals: tuple[DataFrame | float, ...]
    size: float


def count_steps(
    near: DataFrame, keys: Sequence[str] = KEYS, n: Column | None = None, name: str = "n"
) -> DataFrame:
    """How often each step (a token with its neighbours) occurs per key.

    ``near`` is a result of :func:`neighbours`; its context columns are found by
    name. ``n`` is a 0/1 mask of the places to count, all when left out. Models
    are fitted on and looked up for these counts, so tokens are read once.
    """
    context = [c for c in near.columns if c.startswith(("prev", "next"))]
    total = F.count(F.lit(1)) if n is None else F.sum(n.cast("bigint"))
    counted = near.groupBy(*keys, *context, "token").agg(total.alias(name))
    return counted if n is None else counted.filter(F.col(name) > 0)


def fit_counts(
    train: DataFrame, contexts: Sequence[Sequence[str]], weights: Sequence[float], spare: int
) -> CountModel:
    """Sum the train steps (:func:`count_steps`) by context.

    ``spare`` is added to the train vocabulary to leave room for unseen tokens.
    """
    row = train.agg(F.count_distinct("token").alias("v"), F.sum("n").alias("n")).first()
    tables, totals = [], []
    for i, context in enumerate(contexts):
        counted = stored(train.groupBy(*context, "token").agg(F.sum("n").alias(f"_n{i}")))
        tables.append(counted)
        totals.append(
            counted.groupBy(*context).agg(F.sum(f"_n{i}").alias(f"_c{i}")) if context else float(row["n"] or 0)
        )
    return CountModel(
        tuple(tuple(c) for c in contexts), tuple(weights), tuple(tables), tuple(totals), float(row["v"] + spare)
    )


def fit_ngram(train: DataFrame, n: int) -> CountModel:
    """Next-token model: ``n`` = 2 is P(token | previous); 3 mixes trigram, bigram and unigram."""
    if n == 2:
        return fit_counts(train, [["prev1"]], [1.0], spare=1)
    if n == 3:
        return fit_counts(train, [["prev2", "prev1"], ["prev1"], []], [0.6, 0.3, 0.1], spare=1)
    raise ValueError("n must be 2 or 3")


def fit_cloze(train: DataFrame) -> CountModel:
    """Masked-token model: P(token | left neighbour, right neighbour)."""
    return fit_counts(train, [["prev1", "next1"]], [1.0], spare=0)


def nll(steps: DataFrame, model: CountModel, **bounds) -> DataFrame:
    """Add ``nll``, minus the log of the model's probability, to counted steps."""
    out, mixed = steps, F.lit(0.0)
    for i, (context, weight) in enumerate(zip(model.contexts, model.weights)):
        out = lookup_join(out, model.tables[i], [*context, "token"], **bounds)
        total = model.totals[i]
        if isinstance(total, DataFrame):
            # a table of totals has no more rows, and narrower ones, than the table it sums
            out = lookup_join(out, total, list(context), within=model.tables[i], **bounds)
            total = F.coalesce(f"_c{i}", F.lit(0))
        else:
            total = F.lit(total)
        mixed = mixed + F.lit(weight) * (F.coalesce(f"_n{i}", F.lit(0)) + 1) / (total + F.lit(model.size))
    helpers = [c for i in range(len(model.contexts)) for c in (f"_n{i}", f"_c{i}")]
    return out.withColumn("nll", -F.log(mixed)).drop(*helpers)


def held_out_loss(near: DataFrame, train: str = "split = 'train'", target: str = "split = 'val'", **bounds) -> DataFrame:
    """Mean surprise of the target tokens under each order model: ``order`` (n-gram length, 0 for the masked model), ``nll``, ``n``.

    ``near`` is a result of :func:`neighbours` with two tokens before and one after, and the part. The steps of
    both parts are counted once for all models; no label is read.
    """
    counted = stored(count_steps(near, ["split"]))
    known, later = counted.filter(train), counted.filter(target)
    models = {0: fit_cloze(known), 2: fit_ngram(known, 2), 3: fit_ngram(known, 3)}
    losses = [
        nll(later, model, **bounds).agg((F.sum(F.col("nll") * F.col("n")) / F.sum("n")).alias("nll"), F.sum("n").alias("n"))
        .select(F.lit(order).alias("order"), "nll", "n")
        for order, model in models.items()
    ]
    return reduce(DataFrame.unionByName, losses)


def sampled(ratio: float, *key: Column | str) -> Column:
    """Whether a place is masked: fixed by its user, day and position (and a seed)."""
    return unit_hash(*(key or ("user_id", "day", "pos"))) < ratio


def day_score(steps: DataFrame, agg: str = "mean", keys: Sequence[str] = KEYS) -> DataFrame:
    """One order score ``s_s`` per day from :func:`nll`: ``mean``, ``max`` or ``top3`` mean."""
    if agg == "mean":
        return steps.groupBy(*keys).agg((F.sum(F.col("nll") * F.col("n")) / F.sum("n")).alias("s_s"))
    if agg == "max":
        return steps.groupBy(*keys).agg(F.max("nll").alias("s_s"))
    if agg == "top3":
        same = steps.groupBy(*keys, "nll").agg(F.sum("n").alias("n"))
        first = top_rows(same, keys, [F.desc("nll")], 3)
        before = (
            Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        )
        left = F.greatest(F.lit(3) - F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(0))
        taken = first.withColumn("_k", F.least(F.col("n"), left))
        return taken.groupBy(*keys).agg((F.sum(F.col("nll") * F.col("_k")) / F.sum("_k")).alias("s_s"))
    raise ValueError(f"unknown aggregation {agg}")


def masked_score(steps: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean surprise ``s_s`` of a day's ``n_masked`` masked places.

    ``steps`` has ``n`` places and ``n_masked`` masked ones per step. A day
    without a masked place is scored at all its places, so every day has a score.
    """
    masked = F.sum("n_masked")
    return steps.groupBy(*keys).agg(
        F.when(masked > 0, F.try_divide(F.sum(F.col("nll") * F.col("n_masked")), masked))
        .otherwise(F.try_divide(F.sum(F.col("nll") * F.col("n")), F.sum("n"))).alias("s_s"),
        masked.alias("n_masked"),
    )


def seeded_scores(near: DataFrame, model: CountModel, ratio: float, seeds: Sequence[int], **bounds) -> DataFrame:
    """Mean surprise of the masked places under each seed: seed, user_id, day, s_s.

    The seeds are columns while steps are counted and looked up, so the tokens are
    read once however many seeds there are.
    """
    context = [c for c in near.columns if c.startswith(("prev", "next"))]
    masks = {f"_m{i}": F.count_if(sampled(ratio, F.lit(i), "user_id", "day", "pos")) for i in seeds}
    counted = near.groupBy(*KEYS, *context, "token").agg(*[c.alias(n) for n, c in masks.items()])
    per_day = nll(counted, model, **bounds).groupBy(*KEYS).agg(*[
        F.try_divide(F.sum(F.col("nll") * F.col(m)), F.sum(m)).alias(m) for m in masks
    ])
    rows = F.array(*[F.struct(F.lit(i).alias("seed"), F.col(f"_m{i}").alias("s_s")) for i in seeds])
    return (
        per_day.select(*KEYS, F.explode(rows).alias("_r"))
        .select("_r.seed", *KEYS, "_r.s_s")
        .filter("s_s is not null")
    )
