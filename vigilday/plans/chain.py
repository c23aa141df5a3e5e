"""Queries over the whole chain from events to stored alerts, thresholds in force, sketches by day, stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilday.functions.storage import new_table_path, stored
from vigilday.operators import features, fusion, threshold, tiers
from vigilday.operators.org import attach_org
from vigilday.plans import sql as q
from vigilday.plans import standins as st
from vigilday.plans.registry import query, rounded
from vigilday.sources import tables

KEYS = ["user_id", "day"]
ROLE = "role"

# ---- the whole chain ----------------------------------------------------------------

_ROLES = f"""{q.BASE_STREAMS}, {q.DIRECTORY},
spans AS (SELECT user_id, role, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from) AS valid_to FROM directory),
ro AS (SELECT s.user_id, s.day, s.split, {st.ALPHA}::DOUBLE * s_f + (1 - {st.ALPHA}::DOUBLE) * s_s AS s, o.role
       FROM streams s LEFT JOIN spans o ON o.user_id = s.user_id AND s.day >= o.valid_from AND (o.valid_to IS NULL OR s.day < o.valid_to))"""

_FULL = f"""{_ROLES}, {q.tiers('ro', ['s'], ROLE)},
zs AS (SELECT user_id, day, role, {q.shrink('s')} AS z FROM bl),
d0 AS (SELECT min(day) AS d FROM zs),
blk AS (SELECT zs.*, (day - d) // {st.REFRESH} AS block FROM zs, d0),
hist AS (SELECT zs.user_id, zs.role, zs.z, k AS block FROM zs, d0, (SELECT DISTINCT block AS k FROM blk)
         WHERE z IS NOT NULL AND day - d BETWEEN k * {st.REFRESH} - {st.W_TAU} AND k * {st.REFRESH} - 1),
own AS (SELECT user_id, block, quantile_cont(z, {st.P}) AS t FROM hist GROUP BY user_id, block HAVING count(*) >= {st.MIN_HIST}),
grp AS (SELECT role, block, quantile_cont(z, {st.P}) AS tg FROM hist WHERE role IS NOT NULL GROUP BY role, block HAVING count(*) >= {st.MIN_HIST}),
al AS (SELECT block, quantile_cont(z, {st.P}) AS ta FROM hist GROUP BY block HAVING count(*) >= {st.MIN_HIST}),
held AS (SELECT user_id, day, role, z, coalesce(t, tg, ta) AS tau,
                CASE WHEN t IS NOT NULL THEN 'own' WHEN tg IS NOT NULL THEN 'group' WHEN ta IS NOT NULL THEN 'company' END AS tau_from
         FROM blk LEFT JOIN own USING (user_id, block) LEFT JOIN grp USING (role, block) LEFT JOIN al USING (block)),
capped AS (SELECT *, z - tau AS margin, row_number() OVER (PARTITION BY day ORDER BY round(z - tau, 9) DESC, user_id) AS rank
           FROM held WHERE z - tau > 1e-9)"""


def roles(spark, sf) -> DataFrame:
    """Both streams per user-day, fused, with the role that was in force on that day."""
    both = st.streams(spark, sf).select(*KEYS, "split", "s_f", "s_s")
    both = both.withColumn("s", fusion.fuse("s_f", "s_s", st.ALPHA)).select(*KEYS, "split", "s")
    return attach_org(both, st.directory(spark, sf), [ROLE])


def deviations(spark, sf) -> DataFrame:
    """Deviation of every user-day from three tiers; the group of a day, past ones too, is the role in force on it."""
    based = tiers.baselines(roles(spark, sf), ["s"], ROLE, st.W, st.MIN_GROUP)
    z = tiers.combine(based, ["s"], "shrink", k_p=st.K_P, k_g=st.K_G, floor=st.SD_FLOOR)
    return stored(z.select(*KEYS, ROLE, F.col("z_s").alias("z")))


@query(
    "alerts_full",
    f"""WITH {_FULL} SELECT user_id, day, round(z, 6) AS score, round(tau, 6) AS tau, round(margin, 6) AS margin, tau_from, role,
        CAST(rank AS INTEGER) AS rank FROM capped WHERE rank <= {st.BUDGET}""",
)
def alerts_full(spark, sf):
    """Alerts of the whole chain: both streams, fused, three tiers by the role in force, cold-start thresholds, budget, sink."""
    held = threshold.cold_start_threshold(deviations(spark, sf), "z", st.P, st.W_TAU, st.REFRESH, st.MIN_HIST, ROLE)
    found = held.withColumn("margin", F.col("z") - F.col("tau")).filter(F.col("margin") > threshold.EPS)
    capped = threshold.cap(found.select(*KEYS, F.col("z").alias("score"), "tau", "margin", "tau_from", ROLE), st.BUDGET)
    path = new_table_path(spark, "alerts")
    tables.write_alerts(rounded(capped, ["score", "tau", "margin"]), path)
    return tables.read_alerts(spark, path)


@query(
    "tier_role_in_force",
    f"""WITH {_ROLES}, {q.tiers('ro', ['s'], ROLE)} SELECT user_id, day, role, n_g, n_users, group_ok, round(mu_g_s, 6) AS mu,
        round(sd_g_s, 6) AS sd, round({q.shrink('s')}, 6) AS z FROM bl""",
)
def tier_role_in_force(spark, sf):
    """Group baseline by the role in force: a user who changes role leaves their past days in the old one."""
    based = tiers.baselines(roles(spark, sf), ["s"], ROLE, st.W, st.MIN_GROUP)
    z = tiers.combine(based, ["s"], "shrink", k_p=st.K_P, k_g=st.K_G, floor=st.SD_FLOOR)
    return z.select(
        *KEYS, ROLE, "n_g", "n_users", "group_ok", F.round("mu_g_s", 6).alias("mu"), F.round("sd_g_s", 6).alias("sd"),
        F.round("z_s", 6).alias("z"),
    )


# ---- thresholds as intervals ----------------------------------------------------------

_FITTED = f"""{q.BASE_SCORES},
fs AS (SELECT user_id, day, s FROM sc WHERE split = 'train'),
fd AS (SELECT min(day) AS d FROM fs),
fb AS (SELECT DISTINCT user_id, (day - d) // {st.REFRESH} AS block FROM fs, fd),
fh AS (SELECT user_id, s, k AS block FROM fs, fd, (SELECT DISTINCT block AS k FROM fb)
       WHERE day - d BETWEEN k * {st.REFRESH} - {st.W_TAU} AND k * {st.REFRESH} - 1),
ft AS (SELECT user_id, block, quantile_cont(s, {st.P}) AS tau FROM fh JOIN fb USING (user_id, block) GROUP BY user_id, block
       HAVING count(*) >= {st.MIN_HIST}),
iv AS (SELECT user_id, CAST(d + CAST(block * {st.REFRESH} AS INTEGER) AS DATE) AS valid_from, tau FROM ft, fd),
ivs AS (SELECT user_id, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from) AS valid_to, tau FROM iv)"""


def _intervals(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(all scores, intervals fitted on the train part alone)."""
    ud = stored(st.split_days(spark, sf))
    fitted = ud.filter("split = 'train'")
    start = threshold.first_day(fitted)
    held = threshold.refreshed_threshold(fitted, "s", st.P, st.W_TAU, st.REFRESH, st.MIN_HIST, start)
    return ud, stored(threshold.threshold_intervals(held, st.REFRESH, start))


@query("threshold_intervals", f"WITH {_FITTED} SELECT user_id, valid_from, valid_to, round(tau, 6) AS tau FROM ivs")
def threshold_intervals(spark, sf):
    return rounded(_intervals(spark, sf)[1], ["tau"])


@query(
    "threshold_in_force",
    f"""WITH {_FITTED} SELECT sc.user_id, sc.day, sc.split, s, round(tau, 6) AS tau, CAST(coalesce(s - tau > 1e-9, FALSE) AS INTEGER) AS alert
        FROM sc LEFT JOIN ivs ON ivs.user_id = sc.user_id AND sc.day >= valid_from AND (valid_to IS NULL OR sc.day < valid_to)""",
)
def threshold_in_force(spark, sf):
    """Scores of all days, also before and after the fitted ones, under the thresholds fitted on train."""
    ud, intervals = _intervals(spark, sf)
    alert = F.coalesce((F.col("s") - F.col("tau") > threshold.EPS).cast("int"), F.lit(0))
    held = threshold.in_force(ud.select(*KEYS, "split", "s"), intervals).withColumn("alert", alert)
    return rounded(held, ["tau"]).select(*KEYS, "split", "s", "tau", "alert")


# ---- sketches by day -------------------------------------------------------------------

RANK_BOUND = 0.02
_HISTORY = f"""{q.BASE_SCORES}, d0 AS (SELECT min(day) AS d FROM sc),
hist AS (SELECT segment, s, k AS block FROM sc, d0, (SELECT DISTINCT (day - d) // {st.REFRESH} AS k FROM sc, d0)
         WHERE day - d BETWEEN k * {st.REFRESH} - {st.W_TAU} AND k * {st.REFRESH} - 1)"""


@query(
    "threshold_sketch_rank",
    f"""WITH {_HISTORY}, n AS (SELECT segment, CAST(block AS INTEGER) AS block, count(*) AS n FROM hist WHERE segment IS NOT NULL GROUP BY ALL
        UNION ALL SELECT NULL, CAST(block AS INTEGER), count(*) FROM hist GROUP BY block)
        SELECT segment, block, n, {RANK_BOUND}::DOUBLE AS bound, 1 AS within FROM n""",
)
def threshold_sketch_rank(spark, sf):
    """Whether each threshold from sketches lies within the stated bound of the rank it should have, by exact ranks.

    The group is null for the company.
    """
    ud = stored(st.grouped_days(spark, sf).select(*KEYS, "s", st.GROUP))
    start = threshold.first_day(ud)
    args = ("s", st.P, st.W_TAU, st.REFRESH, start)
    in_group = ud.filter(F.col(st.GROUP).isNotNull())
    taus = threshold.sketched_quantile(in_group, [st.GROUP], *args).unionByName(
        threshold.sketched_quantile(ud, [], *args).withColumn(st.GROUP, F.lit(None).cast("string"))
    )
    # equal scores are counted first, then ranked against the threshold
    history = threshold.covered_blocks(ud, st.REFRESH, st.W_TAU, start)
    both = history.filter(F.col(st.GROUP).isNotNull()).select(st.GROUP, "block", "s").unionByName(
        history.select(F.lit(None).cast("string").alias(st.GROUP), "block", "s")
    )
    scored = threshold.block_of(ud, st.REFRESH, start).select("block").distinct()
    both = both.join(scored, "block", "left_semi")
    counts = both.groupBy(st.GROUP, "block", "s").agg(F.count(F.lit(1)).alias("_n"))
    taus = taus.withColumnsRenamed({st.GROUP: "_group", "block": "_block"})
    same = F.col(st.GROUP).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))
    ranked = counts.join(taus, same).groupBy(st.GROUP, "block").agg(
        F.sum("_n").alias("n"),
        F.sum(F.when(F.col("s") < F.col("tau"), F.col("_n")).otherwise(0)).alias("_below"),
        F.sum(F.when(F.col("s") <= F.col("tau"), F.col("_n")).otherwise(0)).alias("_upto"),
    )
    # one place more on either side: a quantile lies between two scores
    low, high = (F.col("_below") - 1) / F.col("n"), (F.col("_upto") + 1) / F.col("n")
    off = F.greatest(low - st.P, F.lit(st.P) - high, F.lit(0.0))
    return ranked.select(
        st.GROUP, "block", "n", F.lit(RANK_BOUND).alias("bound"), (off <= RANK_BOUND).cast("int").alias("within")
    )


BREADTH_DAYS, BREADTH_BOUND = 7, 0.05


@query(
    "breadth_trailing",
    f"""WITH {q.EV}, ob AS (SELECT DISTINCT user_id, day, object FROM ev), ud AS (SELECT DISTINCT user_id, day FROM ev)
        SELECT ud.user_id, ud.day, count(DISTINCT object) AS n_exact, 1 AS within FROM ud LEFT JOIN ob
        ON ob.user_id = ud.user_id AND ob.day BETWEEN ud.day - {BREADTH_DAYS} AND ud.day - 1 GROUP BY ud.user_id, ud.day""",
)
def breadth_trailing(spark, sf):
    """Different objects of the past week by merged sketches, beside the exact count; ``within``: off by the stated share at most."""
    ev = st.events(spark, sf)
    about = features.trailing_breadth(ev, BREADTH_DAYS)
    each = stored(ev.select(*KEYS, "object").distinct())
    days = each.select(*KEYS).distinct()
    later = each.withColumn("day", F.explode(F.expr(f"sequence(date_add(day, 1), date_add(day, {BREADTH_DAYS}), interval 1 day)")))
    exact = later.join(days, KEYS, "left_semi").groupBy(*KEYS).agg(F.count_distinct("object").alias("n_exact"))
    both = about.join(exact, KEYS, "left").na.fill(0, ["n_exact"])
    within = F.abs(F.col("n_objects_past") - F.col("n_exact")) <= BREADTH_BOUND * F.col("n_exact")
    return both.select(*KEYS, "n_exact", within.cast("int").alias("within"))


# ---- stored by user --------------------------------------------------------------------

BUCKETS = 8


def bucketed_days(spark, sf) -> DataFrame:
    """User-days with their score, stored in buckets by user."""
    name = f"user_days_{uuid.uuid4().hex}"
    tables.write_by_user(st.day_scores(spark, sf), name, new_table_path(spark, "user_days"), BUCKETS)
    return spark.table(name)


def bucketed_tau(spark, sf) -> DataFrame:
    return threshold.quantile_threshold(bucketed_days(spark, sf), "s", st.P, st.W_TAU, st.MIN_HIST)


_TAU = f"""{q.BASE_SCORES},
tq AS (SELECT *, CASE WHEN count(s) OVER w >= {st.MIN_HIST} THEN quantile_cont(s, {st.P}) OVER w END AS tau
       FROM sc WINDOW w AS {q.past('user_id', st.W_TAU)})"""


@query("threshold_bucketed", f"WITH {_TAU} SELECT user_id, day, s, round(tau, 6) AS tau FROM tq")
def threshold_bucketed(spark, sf):
    """The sliding threshold over user-days stored by user: its window needs no shuffle."""
    return rounded(bucketed_tau(spark, sf), ["tau"]).select(*KEYS, "s", "tau")
