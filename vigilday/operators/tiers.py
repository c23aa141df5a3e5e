"""Personal, group and company baselines over trailing days, and their combination.

The window form, the weighting formulas and the group fallback are our readings
of bare parameter names. Every baseline uses past days only and no label: what a
person did is part of their past, because a running system could not know better.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilday.functions.joins import lookup_join
from vigilday.functions.storage import stored
from vigilday.functions.windows import trailing

# share of a sum of squares that must remain for a difference with it to keep its digits
KEPT_DIGITS = 1e-3


def personal(ud: DataFrame, columns: Sequence[str], days: int) -> DataFrame:
    """Own mean ``mu_p_*``, population sd ``sd_p_*`` and number of days ``n_p``."""
    w = trailing(["user_id"], days)
    added: dict[str, Column] = {"n_p": F.count(F.lit(1)).over(w)}
    for c in columns:
        added[f"mu_p_{c}"] = F.avg(c).over(w)
        added[f"sd_p_{c}"] = F.stddev_pop(c).over(w)
    return ud.withColumns(added)


def _past_moments(
    ud: DataFrame, keys: Sequence[str], columns: Sequence[str], days: int, tier: str, centre: float
) -> DataFrame:
    """Per (keys, day) the trailing mean, sd and row count of all rows of the keys.

    Rows become one count, mean and sum of squared deviations per (keys, day)
    before the window, which then holds a group's days only. The days of a window
    are combined around their common mean, so large scores lose no digits. A day's
    deviations come from its sums, which no order of rows changes much, unless
    next to nothing is left of them; then from Spark's merged variance.
    ``centre`` is taken off first; it changes no result.
    """
    shifted = {c: F.col(c) - F.lit(centre) for c in columns}
    of_day = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        n, total_of, squares = F.count(c), F.sum(shifted[c]), F.sum(shifted[c] * shifted[c])
        left = squares - F.try_divide(total_of * total_of, n)
        deviations = F.when(left > squares * KEPT_DIGITS, left).otherwise(F.var_pop(shifted[c]) * n)
        of_day.append(
            F.struct(n.cast("double").alias("n"), F.avg(shifted[c]).alias("m"), deviations.alias("q")).alias(f"_d_{c}")
        )
    daily = ud.groupBy(*keys, "day").agg(*of_day)
    w = trailing(keys, days)
    known = {f"_w_{c}": F.filter(F.collect_list(f"_d_{c}").over(w), lambda d: d["n"] > 0) for c in columns}
    daily = daily.withColumns({f"n_{tier}": F.coalesce(F.sum("_n").over(w), F.lit(0)), **known})

    def total(c: str, term) -> Column:
        return F.aggregate(f"_w_{c}", F.lit(0.0), lambda a, d: a + term(d))

    number = {f"_n_{c}": total(c, lambda d: d["n"]) for c in columns}
    mean = {f"_m_{c}": F.try_divide(total(c, lambda d: d["n"] * d["m"]), F.col(f"_n_{c}")) for c in columns}

    def spread(c: str) -> Column:
        off = F.col(f"_m_{c}")
        return total(c, lambda d: d["q"] + d["n"] * (d["m"] - off) * (d["m"] - off))

    out = {f"mu_{tier}_{c}": F.col(f"_m_{c}") + F.lit(centre) for c in columns}
    # no earlier day: no mean, and a spread of 0
    sd = {c: F.sqrt(F.try_divide(spread(c), F.col(f"_n_{c}"))) for c in columns}
    out |= {f"sd_{tier}_{c}": F.coalesce(sd[c], F.lit(0.0)) for c in columns}
    return daily.withColumns(number).withColumns(mean).withColumns(out).select(*keys, "day", f"n_{tier}", *out)


def group(
    ud: DataFrame, keys: Sequence[str], columns: Sequence[str], days: int, centre: float = 0.0, **bounds
) -> DataFrame:
    """The same over everybody of the user's group: ``mu_g_*``, ``sd_g_*``, ``n_g`` user-days.

    The group includes the user. A user-day without a group gets no group baseline.
    """
    moments = _past_moments(_in_group(ud, keys), keys, columns, days, "g", centre)
    return lookup_join(ud, moments, [*keys, "day"], **bounds).na.fill(0, ["n_g"])


def company(
    ud: DataFrame, columns: Sequence[str], days: int, centre: float = 0.0, source: DataFrame | None = None
) -> DataFrame:
    """The same over everybody: ``mu_a_*``, ``sd_a_*``, ``n_a`` user-days.

    The table joined back has one row per calendar day, which bounds it. It is
    summed from ``source`` when that is a cheaper frame with the same rows.
    """
    moments = _past_moments(ud if source is None else source, [], columns, days, "a", centre)
    return ud.join(F.broadcast(moments), "day", "left")


def users_seen(ud: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (group, day): how many different users the group had before that day."""
    first = ud.groupBy(*keys, "user_id").agg(F.min("day").alias("_first"))
    joined = first.groupBy(*keys, F.col("_first").alias("day")).agg(F.count(F.lit(1)).alias("_new"))
    days = ud.groupBy(*keys, "day").agg(F.lit(0).alias("_new"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(F.unix_date("day"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    return (
        joined.unionByName(days.withColumn("_new", F.lit(0).cast("bigint")))
        .groupBy(*keys, "day")
        .agg(F.sum("_new").alias("_new"))
        .withColumn("n_users", F.coalesce(F.sum("_new").over(earlier), F.lit(0)))
        .drop("_new")
    )


def guard_group(ud: DataFrame, keys: Sequence[str], min_size: int, **bounds) -> DataFrame:
    """Add ``n_users`` and ``group_ok``: whether the group had enough users before the day."""
    seen = users_seen(_in_group(ud, keys), keys)
    return flag_size(lookup_join(ud, seen, [*keys, "day"], **bounds), min_size)


def _in_group(ud: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        ud = ud.filter(F.col(k).isNotNull())
    return ud


def flag_size(ud: DataFrame, min_size: int) -> DataFrame:
    return ud.na.fill(0, ["n_users"]).withColumn("group_ok", (F.col("n_users") >= min_size).cast("int"))


def baselines(
    ud: DataFrame,
    columns: Sequence[str],
    group_key: str | Sequence[str],
    days: int,
    min_group_size: int,
    centre: float = 0.0,
    **bounds,
) -> DataFrame:
    """All three baselines and the group guard for every score column at once.

    ``group_key`` is any attribute of the user-day, or several together. One
    table per (group, day) and one per day are joined, and one window per user
    is opened, however many columns there are.
    """
    keys = [group_key] if isinstance(group_key, str) else list(group_key)
    ud = stored(ud)
    known = _in_group(ud, keys)
    per_group = _past_moments(known, keys, columns, days, "g", centre).join(
        users_seen(known, keys), [*keys, "day"]
    )
    with_group = lookup_join(ud, per_group, [*keys, "day"], **bounds).na.fill(0, ["n_g"])
    return personal(company(flag_size(with_group, min_group_size), columns, days, centre, ud), columns, days)


def _z(value: Column, mu: Column, sd: Column, floor: float) -> Column:
    return (value - mu) / F.greatest(sd, F.lit(floor))


_HAS_GROUP = "(group_ok = 1 and n_g > 0)"


def weights(k_p: float | str, k_g: float | str, tiers: str = "PGA") -> dict[str, Column]:
    """How far a user-day leans on its tiers: columns for :func:`shrink`.

    w_P = n_P / (n_P + k_P) and w_G = n_G / (n_G + k_G), with w_G = 0 for a group
    under its least size. ``tiers`` limits the mixture to ``P`` or ``PG`` for
    ablation. ``known`` is whether any tier in use has a past. The constants are
    numbers or column names.
    """
    w_p = f"if(n_p > 0, n_p / (n_p + {k_p}), 0D)"
    w_g = f"if({_HAS_GROUP}, n_g / (n_g + {k_g}), 0D)"
    known = "n_a > 0"
    if tiers == "P":
        w_p, known = "1D", "n_p > 0"
    elif tiers == "PG":
        w_p, w_g, known = f"if({_HAS_GROUP}, {w_p}, 1D)", "1D", f"(n_p > 0 or {_HAS_GROUP})"
    return {
        f"w_p_{tiers}": F.expr(w_p), f"w_g_{tiers}": F.expr(w_g), f"known_{tiers}": F.expr(f"coalesce({known}, false)")
    }


def shrink(c: str, floor: float = 0.5, tiers: str = "PGA") -> Column:
    """Deviation from one baseline that leans on a tier the more days it has.

    Means and variances of the tiers are mixed by the columns of :func:`weights`;
    a tier without a past has weight 0.
    """

    def mix(term: str) -> str:
        p, g, a = (f"coalesce({term.format(t=t, c=c)}, 0D)" for t in "pga")
        return f"(w_p_{tiers} * {p} + (1 - w_p_{tiers}) * (w_g_{tiers} * {g} + (1 - w_g_{tiers}) * {a}))"

    sd = f"sqrt({mix('sd_{t}_{c} * sd_{t}_{c}')})"
    return F.expr(f"if(known_{tiers}, ({c} - {mix('mu_{t}_{c}')}) / greatest({sd}, {floor}D), null)")


def tier_z(c: str, floor: float = 0.5) -> dict[str, Column]:
    """Deviation from each tier by itself; NULL where the tier has no past."""
    has = {"p": F.col("n_p") > 0, "g": F.expr(_HAS_GROUP), "a": F.col("n_a") > 0}
    return {t: F.when(ok, _z(F.col(c), F.col(f"mu_{t}_{c}"), F.col(f"sd_{t}_{c}"), floor)) for t, ok in has.items()}


def fixed(c: str, shares: Sequence[float], floor: float = 0.5) -> Column:
    """Weighted mean of the three deviations, over the tiers that have a past."""
    z = tier_z(c, floor)
    total = sum((F.coalesce(z[t] * w, F.lit(0.0)) for t, w in zip("pga", shares)), F.lit(0.0))
    share = sum((F.when(z[t].isNotNull(), w).otherwise(0.0) for t, w in zip("pga", shares)), F.lit(0.0))
    return F.when(share > 0, total / share)


def largest(c: str, floor: float = 0.5) -> Column:
    """The largest of the three deviations."""
    z = tier_z(c, floor)
    return F.greatest(z["p"], z["g"], z["a"])


def band(c: str, k_p: float, k_g: float, k_a: float, eps: float = 1e-9) -> dict[str, Column]:
    """Other reading of the two constants: above mean plus k sd, flagged per tier."""
    flags = {}
    for t, k in (("p", k_p), ("g", k_g), ("a", k_a)):
        over = F.col(c) - F.col(f"mu_{t}_{c}") - k * F.col(f"sd_{t}_{c}") > eps
        if t == "g":
            over = over & (F.col("group_ok") == 1)
        flags[f"band_{t}"] = F.coalesce(over.cast("int"), F.lit(0))
    return flags


def combine(
    based: DataFrame, columns: Sequence[str], weighting: str, *, k_p: float = 7, k_g: float = 30,
    shares: Sequence[float] = (0.5, 0.3, 0.2), floor: float = 0.5,
) -> DataFrame:
    """Add ``z_<column>``, the deviation under the chosen weighting, to :func:`baselines`."""
    if weighting == "shrink":
        based = based.withColumns(weights(k_p, k_g))
        return based.withColumns({f"z_{c}": shrink(c, floor) for c in columns})
    if weighting == "fixed":
        return based.withColumns({f"z_{c}": fixed(c, shares, floor) for c in columns})
    if weighting == "max":
        return based.withColumns({f"z_{c}": largest(c, floor) for c in columns})
    raise ValueError(f"unknown weighting {weighting}")


PLACEMENTS = ("fused", "streams", "features")


def place(
    ud: DataFrame,
    placements: str | Sequence[str],
    *,
    features: Sequence[str],
    alpha: float,
    group_key: str | Sequence[str],
    days: int,
    min_group_size: int,
    weighting: str = "shrink",
    k_p: float = 7,
    k_g: float = 30,
    shares: Sequence[float] = (0.5, 0.3, 0.2),
    floor: float = 0.5,
) -> DataFrame:
    """Apply the tiers to the features, to each stream, or to the fused score.

    ``ud`` has the feature columns and both streams s_f and s_s. The result has
    the placed score ``z``, or ``z_<placement>`` of each if several are named: their
    baselines are one table and one window for all columns. For ``features`` the volume score is
    rebuilt as the mean squared deviation of the features.
    """
    named = [placements] if isinstance(placements, str) else list(placements)
    if not set(named) <= set(PLACEMENTS):
        raise ValueError(f"unknown placement in {named}")
    needed = {"fused": ["s"], "streams": ["s_f", "s_s"], "features": list(features)}
    columns = [c for name in named for c in needed[name]]
    if "fused" in named:
        ud = ud.withColumn("s", F.lit(alpha) * F.col("s_f") + F.lit(1 - alpha) * F.col("s_s"))
    based = baselines(ud, columns, group_key, days, min_group_size)
    each = combine(based, columns, weighting, k_p=k_p, k_g=k_g, shares=shares, floor=floor)
    squares = sum((F.col(f"z_{c}") * F.col(f"z_{c}") for c in features), F.lit(0.0))
    value = {
        "fused": lambda: F.col("z_s"),
        "streams": lambda: F.lit(alpha) * F.col("z_s_f") + F.lit(1 - alpha) * F.col("z_s_s"),
        "features": lambda: F.lit(alpha) * squares / len(features) + F.lit(1 - alpha) * F.col("s_s"),
    }
    return each.withColumns({("z" if placements == name else f"z_{name}"): value[name]() for name in named})
