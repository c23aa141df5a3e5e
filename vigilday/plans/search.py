"""Queries over the label-free search, the fitted volume model and the appended ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilday.functions.storage import new_table_path, stored
from vigilday.operators import features, sequences, tune
from vigilday.plans import evaluation as ev
from vigilday.plans import sql as q
from vigilday.plans import standins as st
from vigilday.plans.registry import SQL, query, rounded
from vigilday.plans.streams import cloze_sql
from vigilday.sources import tables

KEYS = ["user_id", "day"]

# ---- the volume model's fit ----------------------------------------------------------

D = len(st.COUNTS)
STEPS = 45


def _logs(spark, sf) -> DataFrame:
    return features.transform(st.count_table(spark, sf), "log1p", st.COUNTS)


def _fit(scaled: DataFrame) -> features.Directions:
    """Directions of the train part, from one state per day."""
    states = features.daily_state(scaled.filter("split = 'train'"), st.COUNTS)
    return features.fit_directions(features.merge_state(states, st.COUNTS), st.COUNTS)


def _directions_sql() -> str:
    """Projections on the principal directions, largest variance first, by squaring the correlation matrix again and again.

    Powers of a symmetric matrix, scaled to trace 1, tend to the projection on its first direction; taking that off leaves the next.
    """
    cells = range(D * D)
    square = ", ".join(
        " + ".join(f"m[{i // D * D + k + 1}] * m[{k * D + i % D + 1}]" for k in range(D)) for i in cells
    )
    trace = " + ".join(f"x[{i * D + i + 1}]" for i in range(D))
    scaled = ", ".join(f"x[{i + 1}] / ({trace})" for i in cells)
    z = ", ".join(f"({c} - avg({c}) FILTER (split = 'train') OVER ()) / stddev_samp({c}) FILTER (split = 'train') OVER () AS {c}" for c in st.COUNTS)
    corr = ", ".join(f"corr({a}, {b})" for a in st.COUNTS for b in st.COUNTS)
    parts = [
        f"lx AS (SELECT user_id, day, split, {', '.join(f'ln({c} + 1) AS {c}' for c in st.COUNTS)} FROM feat JOIN sp USING (day))",
        f"zx AS (SELECT user_id, day, split, {z} FROM lx)",
        f"a0 AS (SELECT [{corr}] AS m FROM lx WHERE split = 'train')",
    ]
    for k in range(D):
        parts.append(
            f"w{k} AS (SELECT 0 AS i, m FROM a{k} UNION ALL SELECT i + 1, [{scaled}] FROM (SELECT i, [{square}] AS x FROM w{k} WHERE i < {STEPS}))"
        )
        value = " + ".join(f"a.m[{i + 1}] * p.m[{i + 1}]" for i in cells)
        parts.append(f"p{k} AS (SELECT p.m, {value} AS v FROM a{k} a, w{k} p WHERE i = {STEPS})")
        rest = ", ".join(f"a.m[{i + 1}] - p.v * p.m[{i + 1}]" for i in cells)
        parts.append(f"a{k + 1} AS (SELECT [{rest}] AS m FROM a{k} a, p{k} p)")
    whole = " + ".join(f"{c} * {c}" for c in st.COUNTS)
    along = [
        " + ".join(f"{a} * {b} * p{k}.m[{i * D + j + 1}]" for i, a in enumerate(st.COUNTS) for j, b in enumerate(st.COUNTS))
        for k in range(D)
    ]
    errors = ", ".join(f"greatest({' - '.join([f'({whole})', *(f'({x})' for x in along[:k])])}, 0) AS e{k}" for k in range(D + 1))
    parts.append(f"er AS (SELECT user_id, day, split, {errors} FROM zx, {', '.join(f'p{k}' for k in range(D))})")
    return ", ".join([q.EV, q.SP, q.FEAT, *parts])


_ER = _directions_sql()
SQL["feature_score_pca"] = f"WITH RECURSIVE {_ER} SELECT user_id, day, round(e2, 6) AS s_f FROM er"


@query(
    "pca_state",
    f"""WITH {q.EV}, {q.SP}, {q.FEAT}, lx AS (SELECT split, {', '.join(f'ln({c} + 1) AS {c}' for c in st.COUNTS)} FROM feat JOIN sp USING (day))
    SELECT i, j, n, round(mean_i, 6) AS mean_i, round(mean_j, 6) AS mean_j, round(comoment, 6) AS comoment FROM (
    {' UNION ALL '.join(
        f"SELECT '{a}' AS i, '{b}' AS j, count(*) AS n, avg({a}) AS mean_i, avg({b}) AS mean_j, covar_pop({a}, {b}) * count(*) AS comoment FROM lx WHERE split = 'train'"
        for a in st.COUNTS for b in st.COUNTS)})""",
)
def pca_state(spark, sf):
    """Counts, means and co-moments of the train part, merged from one state per day."""
    states = features.daily_state(_logs(spark, sf).filter("split = 'train'"), st.COUNTS)
    return rounded(features.merge_state(states, st.COUNTS), ["mean_i", "mean_j", "comoment"])


@query(
    "pca_latent",
    f"""WITH RECURSIVE {_ER} SELECT CAST(k AS INTEGER) AS latent, round(avg(e) FILTER (split = 'train'), 6) AS train_error,
        round(avg(e) FILTER (split = 'train'), 6) AS discarded, round(avg(e) FILTER (split = 'val'), 6) AS error
        FROM (SELECT split, unnest(range({D + 1})) AS k, unnest([{', '.join(f'e{k}' for k in range(D + 1))}]) AS e FROM er) GROUP BY k""",
)
def pca_latent(spark, sf):
    """Errors by latent size: on train equal to the discarded variance, 0 with all directions; on validation the search's objective."""
    scaled = _logs(spark, sf)
    return rounded(features.latent_losses(scaled, _fit(scaled)), ["train_error", "discarded", "error"])


# ---- the search -------------------------------------------------------------------------

_HELD_OUT = f"""{cloze_sql('TRUE')},
nv AS (SELECT count(DISTINCT token) + 1 AS v, count(*) AS n FROM near WHERE split = 'train'),
o3 AS (SELECT prev2, prev1, token, count(*) AS n3 FROM near WHERE split = 'train' GROUP BY ALL), m3 AS (SELECT prev2, prev1, sum(n3) AS m3 FROM o3 GROUP BY ALL),
o2 AS (SELECT prev1, token, count(*) AS n2 FROM near WHERE split = 'train' GROUP BY ALL), m2 AS (SELECT prev1, sum(n2) AS m2 FROM o2 GROUP BY ALL),
o1 AS (SELECT token, count(*) AS n1 FROM near WHERE split = 'train' GROUP BY ALL),
hl AS (SELECT coalesce(n3, 0) AS n3, coalesce(m3, 0) AS m3, coalesce(n2, 0) AS n2, coalesce(m2, 0) AS m2, coalesce(n1, 0) AS n1, n, v
       FROM near LEFT JOIN o3 USING (prev2, prev1, token) LEFT JOIN m3 USING (prev2, prev1) LEFT JOIN o2 USING (prev1, token)
       LEFT JOIN m2 USING (prev1) LEFT JOIN o1 USING (token), nv WHERE split = 'val'),
ol AS (SELECT 2 AS order_, avg(-ln((n2 + 1) / CAST(m2 + v AS DOUBLE))) AS nll, count(*) AS n FROM hl
       UNION ALL SELECT 3, avg(-ln(0.6::DOUBLE * (n3 + 1) / CAST(m3 + v AS DOUBLE) + 0.3::DOUBLE * (n2 + 1) / CAST(m2 + v AS DOUBLE)
                                   + 0.1::DOUBLE * (n1 + 1) / CAST(n + v AS DOUBLE))), count(*) FROM hl
       UNION ALL SELECT 0, avg(nll), count(*) FROM cl WHERE split = 'val')"""


def _order_losses(spark, sf) -> DataFrame:
    return sequences.held_out_loss(sequences.neighbours(st.seq(spark, sf), back=2, ahead=1))


@query("sequence_held_out", f'WITH {_HELD_OUT} SELECT order_ AS "order", round(nll, 6) AS nll, n FROM ol')
def sequence_held_out(spark, sf):
    """Held-out surprise of the order models on validation days, no label read."""
    return rounded(_order_losses(spark, sf), ["nll"])


_P_GRID = sorted({t.p for t in ev._TRIALS})
_SEARCHED = ", ".join(f"({t.trial}, {t.p}::DOUBLE, {_P_GRID.index(t.p) + 1}, {t.order}, {t.latent})" for t in ev._TRIALS)
_OVERLAP_FROM = ev._SWEEP.index("top AS (")
_SEARCH = f"""{ev._SWEEP[:_OVERLAP_FROM].replace("WHERE split = 'val')),", "WHERE split IN ('train', 'val'))),").replace("trial, user_id, day, round(", "trial, user_id, day, split, round(")}
tx (trial, p, place, order_, latent) AS (VALUES {_SEARCHED}),
hs AS (SELECT trial, user_id, quantile_cont(z, [{', '.join(map(str, _P_GRID))}]) AS taus FROM z WHERE split = 'train' AND z IS NOT NULL GROUP BY ALL),
ab AS (SELECT z.trial, z.user_id, day, z - taus[place] AS margin FROM z JOIN hs USING (trial, user_id) JOIN tx USING (trial)
       WHERE split = 'val' AND z - taus[place] > 1e-9),
top AS (SELECT trial, user_id, day FROM ab
        QUALIFY row_number() OVER (PARTITION BY trial, day ORDER BY round(margin, 9) DESC, user_id) <= {st.BUDGET}),
{ev._SWEEP[ev._SWEEP.index("cnt AS ("):]},
nd AS (SELECT count(DISTINCT day) AS n_days FROM z WHERE split = 'val'),
na AS (SELECT trial, count(*) AS alerts FROM top GROUP BY trial)"""
# the SQL of three queries in one, without a name in common
_LOSSES = f"""ol AS (SELECT "order" AS order_, nll FROM ({SQL['sequence_held_out']})), la AS (SELECT latent, error FROM ({SQL['pca_latent']}))"""
_TRIED = f"""{_SEARCH}, {_LOSSES},
tt AS (SELECT trial, alpha, k_p, k_g, days, p, order_ AS "order", tx.latent, round(objective, 6) AS stability, nll, error,
       round(coalesce(alerts, 0) / CAST(nd.n_days AS DOUBLE), 6) AS alerts_per_day
       FROM sw JOIN tx USING (trial) LEFT JOIN na USING (trial) LEFT JOIN ol USING (order_) LEFT JOIN la ON la.latent = tx.latent, nd)"""


def _search(spark, sf) -> DataFrame:
    scaled = _logs(spark, sf)
    return tune.search(
        st.streams(spark, sf).select(*KEYS, "split", "s_f", "s_s", st.GROUP), ev._TRIALS, _order_losses(spark, sf),
        features.latent_losses(scaled, _fit(scaled)), group_key=st.GROUP, min_group_size=st.MIN_GROUP, budget=st.BUDGET,
        floor=st.SD_FLOOR,
    )


@query("search", f"WITH {_TRIED} SELECT * FROM tt")
def search(spark, sf):
    """Every trial with its three objectives: stability of the alerts, held-out surprise, held-out reconstruction error."""
    return rounded(_search(spark, sf), ["stability", "nll", "error", "alerts_per_day"])


_CHOSEN = f"""{_TRIED},
bs AS (SELECT * FROM tt WHERE stability IS NOT NULL ORDER BY stability DESC, trial LIMIT 1),
bn AS (SELECT * FROM tt ORDER BY nll, trial LIMIT 1), be AS (SELECT * FROM tt ORDER BY error, trial LIMIT 1),
tp_ AS (SELECT unnest(['fusion', 'tiers', 'tiers', 'tiers', 'threshold']) AS tier, unnest(['alpha', 'k_p', 'k_g', 'days', 'p']) AS parameter,
       unnest([alpha, k_p::DOUBLE, k_g::DOUBLE, days::DOUBLE, p]) AS value, unnest(['[0, 1]', '[1, 20]', '[5, 60]', '{{7, 14}}', '{{0.8, 0.9, 0.95, 0.99}}']) AS search_range,
       'stability' AS goal, stability AS objective, trial FROM bs
       UNION ALL SELECT 'order model', 'order', "order"::DOUBLE, '{{0, 2, 3}}', 'nll', nll, trial FROM bn
       UNION ALL SELECT 'volume model', 'latent', latent::DOUBLE, '{{1, 2, 3, 4}}', 'error', error, trial FROM be)"""


@query(
    "tuned_params_ledger",
    f"WITH {_CHOSEN} SELECT tp_.*, run_id FROM tp_, (SELECT unnest(['search-1', 'search-2']) AS run_id)",
)
def tuned_params_ledger(spark, sf):
    """Chosen parameters appended run by run: one run twice, one once, and one whose commit never came."""
    trials = stored(_search(spark, sf))
    path = new_table_path(spark, "tuned")
    for run in ("search-1", "search-2", "search-1"):
        tables.append_run(tune.searched_table(trials, run), path, run)
    _half_written(tune.searched_table(trials, "search-3"), path)
    return rounded(tables.read_ledger(spark, path), ["objective"])


def _half_written(rows: DataFrame, path: str) -> None:
    """What an append leaves behind that ends before its commit."""
    rows.withColumn("attempt", F.lit("0" * 32)).write.mode("append").parquet(f"{path}/rows")


_LEDGER = SQL["experiment_ledger"]


@query("experiment_ledger_appended", f"SELECT * EXCLUDE (run) REPLACE (run AS run_id) FROM ({_LEDGER}), (SELECT unnest(['r-1', 'r-2']) AS run)")
def experiment_ledger_appended(spark, sf):
    """The results table after two appended runs, a repeat of the first and a half-written third."""
    rows = stored(ev.experiment_ledger(spark, sf))
    path = new_table_path(spark, "ledger")
    for run in ("r-1", "r-2", "r-1"):
        tables.append_run(rows, path, run)
    _half_written(rows.withColumn("run_id", F.lit("r-3")), path)
    return tables.read_ledger(spark, path).select(*rows.columns)
