"""Queries over fusion, the three tiers, thresholds and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilday.functions.storage import stored
from vigilday.operators import fusion, threshold, tiers
from vigilday.plans import sql as q
from vigilday.plans import standins as st
from vigilday.plans.registry import query, rounded

KEYS = ["user_id", "day"]

# ---- fusion ------------------------------------------------------------------------

_BOTH = ",\n".join([q.EV, q.SP, q.FEAT, q.FSTATS, q.SF, q.TOK, q.NEAR, q.BIGRAM, q.SS, q.BOTH])


def _aligned(spark, sf) -> DataFrame:
    return fusion.align(st.volume_scores(spark, sf), st.order_scores(spark, sf))


@query("align_scores", f"WITH {_BOTH} SELECT user_id, day, round(s_f, 6) AS s_f, round(s_s, 6) AS s_s FROM both_")
def align_scores(spark, sf):
    return rounded(_aligned(spark, sf), ["s_f", "s_s"])


@query(
    "normalise_rank",
    f"""WITH {q.BASE_SCORES}, e AS (SELECT user_id, day, s, round(sum(qty), 2) AS amount FROM ev JOIN sc USING (user_id, day)
          GROUP BY user_id, day, s)
        SELECT user_id, day, round(percent_rank() OVER (PARTITION BY day ORDER BY s), 6) AS s,
               round(percent_rank() OVER (PARTITION BY day ORDER BY amount), 6) AS amount FROM e""",
)
def normalise_rank(spark, sf):
    ev = st.events(spark, sf).groupBy(*KEYS).agg(
        F.count(F.lit(1)).cast("double").alias("s"), F.round(F.sum("qty"), 2).alias("amount")
    )
    return rounded(fusion.normalise_rank(ev, ["s", "amount"]), ["s", "amount"])


@query(
    "normalise_z",
    f"WITH {q.BASE_STREAMS} SELECT user_id, day, round(s_f, 6) AS s_f, round(s_s, 6) AS s_s FROM streams",
)
def normalise_z(spark, sf):
    return rounded(st.streams(spark, sf), ["s_f", "s_s"]).select(*KEYS, "s_f", "s_s")


@query(
    "fuse_alpha",
    f"""WITH {q.BASE_STREAMS} SELECT user_id, day, round({st.ALPHA}::DOUBLE * s_f + (1 - {st.ALPHA}::DOUBLE) * s_s, 6) AS s
        FROM streams""",
)
def fuse_alpha(spark, sf):
    return st.streams(spark, sf).select(*KEYS, F.round(fusion.fuse("s_f", "s_s", st.ALPHA), 6).alias("s"))


# ---- tiers -------------------------------------------------------------------------

_BL = f"{q.BASE_SCORES}, {q.tiers('sc', ['s'])}"


def _based(spark, sf, key=st.GROUP) -> DataFrame:
    return tiers.baselines(st.grouped_days(spark, sf), ["s"], key, st.W, st.MIN_GROUP)


def _combined(spark, sf, weighting: str) -> DataFrame:
    z = tiers.combine(
        _based(spark, sf), ["s"], weighting, k_p=st.K_P, k_g=st.K_G, shares=st.FIXED_WEIGHTS, floor=st.SD_FLOOR
    )
    return z.select(*KEYS, F.round("z_s", 6).alias("z"))


def _three(tier: str) -> str:
    return f"round(mu_{tier}_s, 6) AS mu, round(sd_{tier}_s, 6) AS sd, n_{tier} AS n"


def _show(df: DataFrame, tier: str, *extra: str) -> DataFrame:
    return df.select(
        *KEYS, *extra, F.round(f"mu_{tier}_s", 6).alias("mu"), F.round(f"sd_{tier}_s", 6).alias("sd"),
        F.col(f"n_{tier}").alias("n"),
    )


@query(
    "tier_personal",
    f"""WITH {_BL} SELECT user_id, day, {_three('p')}, round((s - mu_p_s) / greatest(sd_p_s, {st.SD_FLOOR}), 6) AS z
        FROM bl WHERE n_p >= {st.MIN_HIST}""",
)
def tier_personal(spark, sf):
    return _personal_z(spark, sf).select(
        *KEYS, F.round("mu_p_s", 6).alias("mu"), F.round("sd_p_s", 6).alias("sd"), F.col("n_p").alias("n"),
        F.round("z", 6).alias("z"),
    )


def _personal_z(spark, sf) -> DataFrame:
    """Deviation from the own past for user-days with enough of it."""
    own = tiers.personal(st.day_scores(spark, sf), ["s"], st.W).filter(F.col("n_p") >= st.MIN_HIST)
    return own.withColumn("z", tiers.tier_z("s", st.SD_FLOOR)["p"])


@query("tier_group", f"WITH {_BL} SELECT user_id, day, segment, {_three('g')} FROM bl")
def tier_group(spark, sf):
    return _show(tiers.group(st.grouped_days(spark, sf), ["segment"], ["s"], st.W), "g", "segment")


@query("tier_global", f"WITH {_BL} SELECT user_id, day, {_three('a')} FROM bl")
def tier_global(spark, sf):
    return _show(tiers.company(st.day_scores(spark, sf), ["s"], st.W), "a")


_SWITCH = {"segment": ["segment"], "region": ["region"], "segment+region": ["segment", "region"]}


def _switch_sql(label: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    return f"""SELECT '{label}' AS group_key, user_id, day, coalesce(n, 0) AS n, round(mu, 6) AS mu, round(sd, 6) AS sd
    FROM sc LEFT JOIN (
      SELECT {k}, day, CAST(sum(c) OVER w AS BIGINT) AS n, sum(t) OVER w / sum(c) OVER w AS mu,
             sqrt(greatest(sum(q) OVER w / sum(c) OVER w - (sum(t) OVER w / sum(c) OVER w) * (sum(t) OVER w / sum(c) OVER w), 0)) AS sd
      FROM (SELECT {k}, day, count(*) AS c, sum(s) AS t, sum(s * s) AS q FROM sc GROUP BY {k}, day)
      WINDOW w AS {q.past(k, st.W)}) USING ({k}, day)"""


@query(
    "group_key_switch",
    f"WITH {q.BASE_SCORES} " + " UNION ALL ".join(_switch_sql(name, keys) for name, keys in _SWITCH.items()),
)
def group_key_switch(spark, sf):
    ud = stored(st.grouped_days(spark, sf))
    out = None
    for name, keys in _SWITCH.items():
        one = _show(tiers.group(ud, keys, ["s"], st.W), "g").withColumn("group_key", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("min_group_size", f"WITH {_BL} SELECT user_id, day, segment, n_users, group_ok FROM bl")
def min_group_size(spark, sf):
    return tiers.guard_group(st.grouped_days(spark, sf), ["segment"], st.MIN_GROUP).select(
        *KEYS, "segment", "n_users", "group_ok"
    )


@query("tier_weight_shrink", f"WITH {_BL} SELECT user_id, day, round({q.shrink('s')}, 6) AS z FROM bl")
def tier_weight_shrink(spark, sf):
    return _combined(spark, sf, "shrink")


_TZ = q.tier_z("s")
_WSUM = " + ".join(f"coalesce(z_{t} * {w}, 0)" for t, w in zip("pga", st.FIXED_WEIGHTS))
_WALL = " + ".join(f"CASE WHEN z_{t} IS NULL THEN 0 ELSE {w} END" for t, w in zip("pga", st.FIXED_WEIGHTS))
_Z3 = f"{_BL}, z3 AS (SELECT user_id, day, {', '.join(f'{e} AS z_{t}' for t, e in _TZ.items())} FROM bl)"


@query(
    "tier_weight_fixed",
    f"""WITH {_Z3} SELECT user_id, day, CASE WHEN {_WALL} > 0 THEN round(CAST({_WSUM} AS DOUBLE) / CAST({_WALL} AS DOUBLE), 6) END AS z
        FROM z3""",
)
def tier_weight_fixed(spark, sf):
    return _combined(spark, sf, "fixed")


@query("tier_weight_max", f"WITH {_Z3} SELECT user_id, day, round(greatest(z_p, z_g, z_a), 6) AS z FROM z3")
def tier_weight_max(spark, sf):
    return _combined(spark, sf, "max")


@query(
    "tier_band",
    f"""WITH {_BL} SELECT user_id, day,
        CAST(coalesce(s - mu_p_s - 1.5 * sd_p_s > 1e-9, FALSE) AS INTEGER) AS band_p,
        CAST(coalesce(s - mu_g_s - 2.0 * sd_g_s > 1e-9 AND group_ok = 1, FALSE) AS INTEGER) AS band_g,
        CAST(coalesce(s - mu_a_s - 2.5 * sd_a_s > 1e-9, FALSE) AS INTEGER) AS band_a FROM bl""",
)
def tier_band(spark, sf):
    return _based(spark, sf).select(*KEYS, *[c.alias(n) for n, c in tiers.band("s", 1.5, 2.0, 2.5).items()])


_XF = f"""{q.BASE_STREAMS}, xf AS (
  SELECT streams.*, {st.ALPHA}::DOUBLE * s_f + (1 - {st.ALPHA}::DOUBLE) * s_s AS s, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in st.COUNTS)}
  FROM streams JOIN feat USING (user_id, day))"""
_SQUARES = " + ".join(f"({q.shrink(c)}) * ({q.shrink(c)})" for c in st.COUNTS)


@query(
    "tier_placement",
    f"""WITH {_XF}, {q.tiers('xf', ['s', 's_f', 's_s', *st.COUNTS])}
    SELECT 'fused' AS placement, user_id, day, round({q.shrink('s')}, 6) AS z FROM bl
    UNION ALL SELECT 'streams', user_id, day,
      round({st.ALPHA}::DOUBLE * ({q.shrink('s_f')}) + (1 - {st.ALPHA}::DOUBLE) * ({q.shrink('s_s')}), 6) FROM bl
    UNION ALL SELECT 'features', user_id, day,
      round({st.ALPHA}::DOUBLE * ({_SQUARES}) / {len(st.COUNTS)} + (1 - {st.ALPHA}::DOUBLE) * s_s, 6) FROM bl""",
)
def tier_placement(spark, sf):
    counts = st.count_table(spark, sf).drop("split")
    ud = stored(st.streams(spark, sf).join(counts, KEYS))
    placed = tiers.place(
        ud, tiers.PLACEMENTS, features=st.COUNTS, alpha=st.ALPHA, group_key=st.GROUP, days=st.W,
        min_group_size=st.MIN_GROUP, k_p=st.K_P, k_g=st.K_G, floor=st.SD_FLOOR,
    )
    rows = ", ".join(f"'{name}', round(z_{name}, 6)" for name in tiers.PLACEMENTS)
    return placed.select(*KEYS, F.expr(f"stack({len(tiers.PLACEMENTS)}, {rows}) as (placement, z)"))


# ---- thresholds and alerts -----------------------------------------------------------

_TAU = f"""{q.BASE_SCORES},
tq AS (SELECT *, CASE WHEN count(s) OVER w >= {st.MIN_HIST} THEN quantile_cont(s, {st.P}) OVER w END AS tau
       FROM sc WINDOW w AS {q.past('user_id', st.W_TAU)})"""


def _own_tau(spark, sf) -> DataFrame:
    return threshold.quantile_threshold(st.day_scores(spark, sf), "s", st.P, st.W_TAU, st.MIN_HIST)


@query("threshold_quantile", f"WITH {_TAU} SELECT user_id, day, s, round(tau, 6) AS tau FROM tq")
def threshold_quantile(spark, sf):
    return rounded(_own_tau(spark, sf), ["tau"]).select(*KEYS, "s", "tau")


_D0 = "(SELECT min(day) FROM sc)"
_BLOCKS = f"""{q.BASE_SCORES},
blk AS (SELECT *, (day - {_D0}) // {st.REFRESH} AS block FROM sc),
hist AS (
  SELECT sc.*, k AS block FROM sc, (SELECT DISTINCT block AS k FROM blk)
  WHERE day - {_D0} BETWEEN k * {st.REFRESH} - {st.W_TAU} AND k * {st.REFRESH} - 1),
own AS (SELECT user_id, block, quantile_cont(s, {st.P}) AS tau FROM hist GROUP BY user_id, block
        HAVING count(*) >= {st.MIN_HIST})"""


@query(
    "threshold_refresh",
    f"""WITH {_BLOCKS} SELECT user_id, day, CAST(block AS INTEGER) AS block, s, round(tau, 6) AS tau
        FROM blk LEFT JOIN own USING (user_id, block)""",
)
def threshold_refresh(spark, sf):
    ud = stored(st.day_scores(spark, sf))
    held = threshold.refreshed_threshold(ud, "s", st.P, st.W_TAU, st.REFRESH, st.MIN_HIST)
    return rounded(held, ["tau"]).select(*KEYS, "block", "s", "tau")


_COLD = f"""{_BLOCKS},
grp AS (SELECT segment, block, quantile_cont(s, {st.P}) AS tau_g FROM hist GROUP BY segment, block HAVING count(*) >= {st.MIN_HIST}),
al AS (SELECT block, quantile_cont(s, {st.P}) AS tau_a FROM hist GROUP BY block HAVING count(*) >= {st.MIN_HIST})"""


@query(
    "threshold_cold_start",
    f"""WITH {_COLD} SELECT user_id, day, round(coalesce(tau, tau_g, tau_a), 6) AS tau,
        CASE WHEN tau IS NOT NULL THEN 'own' WHEN tau_g IS NOT NULL THEN 'group' WHEN tau_a IS NOT NULL THEN 'company' END AS tau_from
        FROM blk LEFT JOIN own USING (user_id, block) LEFT JOIN grp USING (segment, block) LEFT JOIN al USING (block)""",
)
def threshold_cold_start(spark, sf):
    ud = stored(st.grouped_days(spark, sf))
    out = threshold.cold_start_threshold(ud, "s", st.P, st.W_TAU, st.REFRESH, st.MIN_HIST, st.GROUP)
    return rounded(out, ["tau"]).select(*KEYS, "tau", "tau_from")


@query("threshold_cold_start_sketch")
def threshold_cold_start_sketch(spark, sf):
    """The same with approximate group and company quantiles."""
    ud = stored(st.grouped_days(spark, sf))
    out = threshold.cold_start_threshold(ud, "s", st.P, st.W_TAU, st.REFRESH, st.MIN_HIST, st.GROUP, sketch=True)
    return rounded(out, ["tau"]).select(*KEYS, "tau", "tau_from")


@query(
    "select_p_fixed",
    f"""WITH {_TAU} SELECT split, {st.P}::DOUBLE AS p, count(tau) AS n_with_tau, count(*) FILTER (s - tau > 1e-9) AS n_alerts
        FROM tq GROUP BY split""",
)
def select_p_fixed(spark, sf):
    p = threshold.select_p("fixed", p=st.P)
    with_tau = threshold.quantile_threshold(st.split_days(spark, sf), "s", p, st.W_TAU, st.MIN_HIST)
    return with_tau.groupBy("split").agg(
        F.lit(p).alias("p"), F.count("tau").alias("n_with_tau"),
        F.count_if(F.col("s") - F.col("tau") > threshold.EPS).alias("n_alerts"),
    )


GRID = (0.8, 0.9, 0.95, 0.99)
_CURVE = f"""{q.BASE_SCORES},
pt AS (SELECT user_id, unnest([{', '.join(f'{p}::DOUBLE' for p in GRID)}]) AS p,
       unnest(quantile_cont(s, [{', '.join(map(str, GRID))}])) AS tau FROM sc WHERE split = 'train' GROUP BY user_id),
nd AS (SELECT count(DISTINCT day) AS n FROM sc WHERE split = 'val'),
cv AS (SELECT p, count(*) FILTER (s - tau > 1e-9) AS n_alerts FROM pt LEFT JOIN (SELECT * FROM sc WHERE split = 'val') USING (user_id) GROUP BY p),
ch AS (SELECT coalesce(min(p) FILTER (n_alerts <= {st.BUDGET} * n), max(p)) AS pick FROM cv, nd)"""


@query(
    "select_p_budget",
    f"""WITH {_CURVE} SELECT p, n_alerts, round(n_alerts / CAST(n AS DOUBLE), 6) AS alerts_per_day,
        CAST(p = pick AS INTEGER) AS chosen FROM cv, nd, ch""",
)
def select_p_budget(spark, sf):
    curve = threshold.budget_curve(st.split_days(spark, sf), "s", GRID, budget=st.BUDGET)
    return rounded(curve, ["alerts_per_day"])


@query(
    "budget_top_b",
    f"""WITH {_TAU}, r AS (SELECT user_id, day, s AS score, tau, s - tau AS margin,
          row_number() OVER (PARTITION BY day ORDER BY round(s - tau, 9) DESC, user_id) AS rank FROM tq WHERE s - tau > 1e-9)
        SELECT user_id, day, score, round(tau, 6) AS tau, round(margin, 6) AS margin, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {st.BUDGET}""",
)
def budget_top_b(spark, sf):
    return rounded(threshold.cap(threshold.alerts(_own_tau(spark, sf), "s"), st.BUDGET), ["tau", "margin"])


@query(
    "alerts",
    f"""WITH {_BL}, pz AS (
          SELECT user_id, day, (s - mu_p_s) / greatest(sd_p_s, {st.SD_FLOOR}) AS z FROM bl WHERE n_p >= {st.MIN_HIST}),
        t AS (SELECT *, CASE WHEN count(z) OVER w >= {st.MIN_HIST} THEN quantile_cont(z, {st.P}) OVER w END AS tau
              FROM pz WINDOW w AS {q.past('user_id', st.W_TAU)})
        SELECT user_id, day, round(z, 6) AS score, round(tau, 6) AS tau, round(z - tau, 6) AS margin
        FROM t WHERE z - tau > 1e-9""",
)
def alerts(spark, sf):
    """Users' unusual days: own trailing deviation above the own trailing quantile of it."""
    with_tau = threshold.quantile_threshold(_personal_z(spark, sf), "z", st.P, st.W_TAU, st.MIN_HIST)
    return rounded(threshold.alerts(with_tau, "z"), ["score", "tau", "margin"])
