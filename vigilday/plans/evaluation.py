"""Queries over metrics, ablation, tuning and reports.

The labels of the test tables have nothing to do with behaviour, so these values
show that the arithmetic is right and nothing about detection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilday.functions.storage import stored
from vigilday.operators import ablation, metrics, report, sequences, threshold, tune
from vigilday.operators.fusion import fuse
from vigilday.plans import sql as q
from vigilday.plans import standins as st
from vigilday.plans.registry import query, rounded
from vigilday.plans.streams import MASK_RATIO, cloze_sql

KEYS = ["user_id", "day"]
KS = (0.01, 0.05, 0.1)
REPS = 20

_JUDGED = f"""{q.BASE_SCORES}, {q.ANSWERS}, {q.LAB},
tq AS (SELECT *, CASE WHEN count(s) OVER w >= {st.MIN_HIST} THEN quantile_cont(s, {st.P}) OVER w END AS tau
       FROM sc WINDOW w AS {q.past('user_id', st.W_TAU)}),
jd AS (SELECT user_id, day, split, s, label, scenario, CAST(coalesce(s - tau > 1e-9, FALSE) AS INTEGER) AS alert
       FROM tq JOIN (SELECT user_id, day, label, scenario FROM lab) USING (user_id, day))"""


def _judged(spark, sf) -> DataFrame:
    """Every user-day with its score, alert, label and scenario."""
    with_tau = threshold.quantile_threshold(st.split_days(spark, sf), "s", st.P, st.W_TAU, st.MIN_HIST)
    with_tau = stored(with_tau)
    judged = metrics.judge(with_tau, threshold.alerts(with_tau, "s"))
    known = st.labels(spark, sf).select(*KEYS, "label", "scenario")
    return judged.join(known, KEYS).select(*KEYS, "split", "s", "label", "scenario", "alert")


_CONF = f"""{_JUDGED}, cf AS (SELECT split, count(*) FILTER (alert = 1 AND label = 1) AS tp, count(*) FILTER (alert = 1 AND label = 0) AS fp,
  count(*) FILTER (alert = 0 AND label = 0) AS tn, count(*) FILTER (alert = 0 AND label = 1) AS fn FROM jd GROUP BY split)"""


@query("confusion", f"WITH {_CONF} SELECT * FROM cf")
def confusion(spark, sf):
    return metrics.confusion(_judged(spark, sf))


@query(
    "fpr",
    f"""WITH {_CONF} SELECT split, round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) AS fpr,
        round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall FROM cf""",
)
def fpr(spark, sf):
    return rounded(metrics.fpr(metrics.confusion(_judged(spark, sf))), ["fpr", "recall"]).select("split", "fpr", "recall")


def _ap_sql(source: str, score: str, label: str, by: str = "", digits: int | None = 6) -> str:
    value = "sum(t * ct / CAST(cn AS DOUBLE)) / nullif(max(p), 0)"
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    whole = f"({part.strip()})" if by else "()"
    return f"""SELECT {lead}{value if digits is None else f'round({value}, {digits})'} AS pr_auc,
      CAST(sum(n) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS n_pos FROM (
      SELECT *, sum(n) OVER w AS cn, sum(t) OVER w AS ct, sum(t) OVER {whole} AS p
      FROM (SELECT {lead}{score} AS score, count(*) AS n, sum({label}) AS t FROM {source} GROUP BY {lead}{score})
      WINDOW w AS ({part}ORDER BY score DESC)) {f'GROUP BY {by}' if by else ''}"""


@query("pr_auc", f"WITH {_JUDGED} {_ap_sql('jd', 's', 'label', 'split')}")
def pr_auc(spark, sf):
    return rounded(metrics.pr_auc(stored(_judged(spark, sf)), "s", by=["split"]), ["pr_auc"])


_DOCS = "dl AS (SELECT doc_id, round(ln(n_chars + 1), 2) AS s, toxic FROM documents JOIN labels USING (doc_id))"


def _documents(spark, sf) -> DataFrame:
    """Documents with a score and a label: a second table for the metric arithmetic."""
    return (
        st.table(spark, sf, "documents")
        .select("doc_id", F.round(F.log(F.col("n_chars") + 1), 2).alias("s"))
        .join(st.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    )


@query("pr_auc_documents", f"WITH {_DOCS} {_ap_sql('dl', 's', 'toxic')}")
def pr_auc_documents(spark, sf):
    return rounded(metrics.pr_auc(stored(_documents(spark, sf)), "s", "toxic"), ["pr_auc"])


def _recall_sql(source: str, keys: str, label: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grid = ", ".join(f"{k}::DOUBLE" for k in KS)
    return f"""SELECT {lead}k, count(*) FILTER ({label} = 1 AND pos <= ceil(k * n)) AS hits,
      count(*) FILTER ({label} = 1) AS n_pos,
      round(count(*) FILTER ({label} = 1 AND pos <= ceil(k * n)) / nullif(CAST(count(*) FILTER ({label} = 1) AS DOUBLE), 0), 6) AS recall
      FROM (SELECT *, row_number() OVER ({part}ORDER BY s DESC, {keys}) AS pos, count(*) OVER ({part.strip()}) AS n FROM {source}),
      (SELECT unnest([{grid}]) AS k) GROUP BY {lead}k"""


@query("recall_at_k", f"WITH {_JUDGED} {_recall_sql('jd', 'user_id, day', 'label', 'split')}")
def recall_at_k(spark, sf):
    judged = stored(_judged(spark, sf))
    return rounded(metrics.recall_at_k(judged, "s", KS, KEYS, by=["split"]), ["recall"])


@query("recall_at_k_documents", f"WITH {_DOCS} {_recall_sql('dl', 'doc_id', 'toxic')}")
def recall_at_k_documents(spark, sf):
    return rounded(metrics.recall_at_k(stored(_documents(spark, sf)), "s", KS, ["doc_id"], "toxic"), ["recall"])


@query(
    "recall_by_scenario",
    f"""WITH {_JUDGED} SELECT scenario, count(*) AS n_insiders, CAST(sum(found) AS BIGINT) AS n_found, round(avg(found), 6) AS recall
        FROM (SELECT scenario, user_id, max(alert) AS found FROM jd WHERE label = 1 GROUP BY scenario, user_id) GROUP BY scenario""",
)
def recall_by_scenario(spark, sf):
    return rounded(metrics.recall_by_scenario(_judged(spark, sf)), ["recall"])


_U = q.u("'42'", "user_id", "rep")
_WEIGHT = " + ".join(f"CAST(u >= {cut} AS INTEGER)" for cut in metrics.POISSON_CUTS)
_BOOT = f"""{_JUDGED},
dr AS (SELECT user_id, rep, {_WEIGHT} AS wt FROM (
  SELECT user_id, rep, {_U} AS u FROM (SELECT DISTINCT user_id FROM jd), (SELECT unnest(generate_series(1, {REPS})) AS rep))),
stp AS (SELECT rep, s, sum(wt) AS n, sum(wt * label) AS t FROM jd JOIN dr USING (user_id) WHERE wt > 0 GROUP BY rep, s),
cum AS (SELECT *, sum(n) OVER w AS cn, sum(t) OVER w AS ct, sum(n) OVER (PARTITION BY rep) AS nn, sum(t) OVER (PARTITION BY rep) AS p
        FROM stp WINDOW w AS (PARTITION BY rep ORDER BY s DESC)),
rp AS (SELECT rep, sum(t * ct / CAST(cn AS DOUBLE)) / nullif(max(p), 0) AS pr_auc,
       sum(t * greatest(least((ceil(0.05::DOUBLE * nn) - (cn - n)) / n, 1), 0)) / nullif(max(p), 0) AS recall FROM cum GROUP BY rep)"""


@query(
    "bootstrap_ci",
    f"""WITH {_BOOT}, l AS (SELECT 'pr_auc' AS metric, pr_auc AS v FROM rp UNION ALL SELECT 'recall', recall FROM rp)
        SELECT metric, count(v) AS n_reps, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.5), 6) AS mid,
               round(quantile_cont(v, 0.975), 6) AS high FROM l GROUP BY metric""",
)
def bootstrap_ci(spark, sf):
    replicates = metrics.bootstrap(stored(_judged(spark, sf)), "s", REPS, 0.05, st.SEED)
    return rounded(metrics.bootstrap_ci(replicates), ["low", "mid", "high"])


SEEDS = (1, 2, 3, 4, 5)
_SEEDED = " UNION ALL ".join(
    f"SELECT {i} AS seed, user_id, day, avg(nll) AS s FROM cl WHERE {q.u(repr(str(i)), 'user_id', 'day', 'pos')} < {MASK_RATIO} GROUP BY user_id, day"
    for i in SEEDS
)


@query(
    "seed_summary",
    f"""WITH {cloze_sql('TRUE')}, {q.UD}, {q.ANSWERS}, {q.LAB}, sd AS ({_SEEDED}),
    sl AS (SELECT seed, round(s, 9) AS s, label FROM sd JOIN sp USING (day) JOIN (SELECT user_id, day, label FROM lab) USING (user_id, day) WHERE split <> 'train'),
    ap AS ({_ap_sql('sl', 's', 'label', 'seed', None)})
    SELECT 'masked' AS variant, 'pr_auc' AS metric, count(pr_auc) AS n_seeds, round(avg(pr_auc), 6) AS mean, round(stddev_samp(pr_auc), 6) AS sd FROM ap""",
)
def seed_summary(spark, sf):
    """The masked order score under five mask seeds, evaluated after train."""
    near = sequences.neighbours(st.seq(spark, sf), back=1, ahead=1)
    model = sequences.fit_cloze(sequences.count_steps(near.filter("split = 'train'"), []))
    scores = sequences.seeded_scores(near.filter("split <> 'train'"), model, MASK_RATIO, SEEDS)
    later = scores.withColumn("s_s", F.round("s_s", 9))
    labelled = stored(later.join(st.labels(spark, sf).select(*KEYS, "label"), KEYS))
    area = metrics.pr_auc(labelled, "s_s", by=["seed"])
    rows = report.metric_rows(area, F.lit("masked"), ["pr_auc"])
    return rounded(report.seed_summary(rows), ["mean", "sd"])


_STREAMS_S = f"""{q.BASE_STREAMS}, st3 AS (SELECT *, {st.ALPHA}::DOUBLE * s_f + (1 - {st.ALPHA}::DOUBLE) * s_s AS s FROM streams)"""


def _variants_sql() -> str:
    parts = []
    for stream, c in ablation.STREAMS.items():
        for tier in ablation.TIERS:
            value = c if tier == "off" else q.shrink(c, which=tier)
            parts.append((stream, tier, f"coalesce({value}, 0)"))
    return f"""vr AS (SELECT user_id, day, split, unnest([{', '.join(repr(p[0]) for p in parts)}]) AS stream,
      unnest([{', '.join(repr(p[1]) for p in parts)}]) AS tiers, unnest([{', '.join(p[2] for p in parts)}]) AS score FROM bl),
    vt AS (SELECT *, CASE WHEN count(*) OVER w >= {st.MIN_HIST} THEN quantile_cont(score, {st.P}) OVER w END AS tau
           FROM vr WINDOW w AS {q.past('stream, tiers, user_id', st.W_TAU)}),
    vq AS (SELECT stream, tiers, quantile_cont(score, {st.P}) AS tau_all FROM vr WHERE split = 'val' GROUP BY stream, tiers),
    ts AS (SELECT vt.*, tau_all, label FROM vt JOIN vq USING (stream, tiers) JOIN (SELECT user_id, day, label FROM lab) USING (user_id, day) WHERE split = 'test'),
    tj AS (SELECT stream, tiers, label, 'user' AS threshold, coalesce(score - tau > 1e-9, FALSE) AS alert FROM ts
           UNION ALL SELECT stream, tiers, label, 'global', coalesce(score - tau_all > 1e-9, FALSE) FROM ts),
    tr9 AS (SELECT stream, tiers, round(score, 9) AS s, label FROM ts),
    tap AS ({_ap_sql('tr9', 's', 'label', 'stream, tiers', None)}),
    ab AS (SELECT stream, tiers, threshold, tp, fp, tn, fn, fp / nullif(CAST(fp + tn AS DOUBLE), 0) AS fpr,
                  tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall, pr_auc FROM (
           SELECT stream, tiers, threshold, count(*) FILTER (alert AND label = 1) AS tp, count(*) FILTER (alert AND label = 0) AS fp,
                  count(*) FILTER (NOT alert AND label = 0) AS tn, count(*) FILTER (NOT alert AND label = 1) AS fn
           FROM tj GROUP BY stream, tiers, threshold) JOIN tap USING (stream, tiers))"""


_ABL = f"{_STREAMS_S}, {q.UD}, {q.ANSWERS}, {q.LAB}, {q.tiers('st3', ['s_f', 's_s', 's'])}, {_variants_sql()}"


def _ablation(spark, sf) -> DataFrame:
    scored = ablation.variant_scores(
        st.streams(spark, sf), alpha=st.ALPHA, group_key=st.GROUP, days=st.W, min_group_size=st.MIN_GROUP,
        k_p=st.K_P, k_g=st.K_G, p=st.P, tau_days=st.W_TAU, min_hist=st.MIN_HIST, floor=st.SD_FLOOR,
    )
    return ablation.ablate(scored, st.labels(spark, sf), st.P)


@query(
    "ablation",
    f"WITH {_ABL} SELECT stream, tiers, threshold, tp, fp, tn, fn, round(fpr, 6) AS fpr, round(recall, 6) AS recall,\n        round(pr_auc, 6) AS pr_auc FROM ab",
)
def ablation_table(spark, sf):
    return rounded(_ablation(spark, sf), ["fpr", "recall", "pr_auc"])


@query(
    "ablation_rollup",
    f"""WITH {_ABL} SELECT stream, tiers, threshold, count(*) AS n_variants, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
        round(avg(pr_auc), 6) AS mean_pr_auc, round(max(pr_auc), 6) AS best_pr_auc FROM ab GROUP BY CUBE (stream, tiers, threshold)""",
)
def ablation_rollup(spark, sf):
    return rounded(ablation.rollup(stored(_ablation(spark, sf))), ["mean_pr_auc", "best_pr_auc"])


_SIMPLE = ["s_f", "s_s", "s"]
_BASE = f"""{_STREAMS_S}, {q.UD}, {q.ANSWERS}, {q.LAB},
ln_ AS (SELECT user_id, day, split, unnest({_SIMPLE}) AS baseline, unnest([{', '.join(_SIMPLE)}]) AS score FROM st3),
lq AS (SELECT baseline, quantile_cont(score, {st.P}) AS tau FROM ln_ WHERE split = 'val' GROUP BY baseline),
lt AS (SELECT baseline, tau, round(score, 9) AS s, score - tau > 1e-9 AS alert, label, user_id, day
       FROM ln_ JOIN lq USING (baseline) JOIN (SELECT user_id, day, label FROM lab) USING (user_id, day) WHERE split = 'test'),
la AS ({_ap_sql('lt', 's', 'label', 'baseline')}),
lc AS (SELECT baseline, round(tau, 6) AS tau, count(*) FILTER (alert AND label = 1) AS tp, count(*) FILTER (alert AND label = 0) AS fp,
       count(*) FILTER (NOT alert AND label = 0) AS tn, count(*) FILTER (NOT alert AND label = 1) AS fn FROM lt GROUP BY baseline, tau),
lr AS ({_recall_sql('lt', 'user_id, day', 'label', 'baseline')})"""


def _fused(spark, sf) -> DataFrame:
    return st.streams(spark, sf).withColumn("s", fuse("s_f", "s_s", st.ALPHA))


@query(
    "baseline_compare",
    f"""WITH {_BASE} SELECT baseline, tau, tp, fp, tn, fn, round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) AS fpr,
        round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, pr_auc FROM lc JOIN la USING (baseline)""",
)
def baseline_compare(spark, sf):
    table = ablation.baseline_compare(stored(_fused(spark, sf)), st.labels(spark, sf), _SIMPLE, st.P)
    return rounded(table, ["tau", "fpr", "recall", "pr_auc"])


@query(
    "experiment_ledger",
    f"""WITH {_BASE} SELECT DATE '2024-01-31' AS date, 'streams' AS run_id, baseline AS config, 'both streams' AS rq, pr_auc,
        lr.recall AS recall_1pct, round(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 6) AS fpr, 'test tables' AS note, 1 AS test_opened
        FROM lc JOIN la USING (baseline) JOIN lr USING (baseline) WHERE k = 0.01""",
)
def experiment_ledger(spark, sf):
    scored, labels = stored(_fused(spark, sf)), stored(st.labels(spark, sf))
    simple = ablation.baseline_compare(scored, labels, _SIMPLE, st.P)
    long = report.metric_rows(
        scored.filter("split = 'test'").join(labels.select(*KEYS, "label"), KEYS).withColumn("_r", F.struct(*KEYS, "label")),
        F.col("_r"), _SIMPLE,
    ).select("variant.*", F.col("metric").alias("baseline"), F.round("value", 9).alias("score"))
    top = metrics.recall_at_k(stored(long), "score", [0.01], KEYS, by=["baseline"])
    wide = simple.join(top.select("baseline", F.col("recall").alias("recall_1pct")), "baseline")
    rows = report.metric_rows(wide, F.col("baseline"), ["pr_auc", "recall_1pct", "fpr"])
    runs = rows.select(F.lit("streams").alias("run_id"), "*")
    out = report.ledger(runs, "2024-01-31", "both streams", "test tables", 1)
    return rounded(out, ["pr_auc", "recall_1pct", "fpr"])


N_TRIALS = 20
_TRIALS = tune.draw_trials(N_TRIALS, st.SEED)
_VALUES = ", ".join(f"({t.trial}, {t.alpha}::DOUBLE, {t.k_p}, {t.k_g}, {t.days})" for t in _TRIALS)


def _by_window(expr: str) -> str:
    return f"CASE WHEN days = 7 THEN {expr} OVER w7 ELSE {expr} OVER w14 END"


def _pooled(tier: str, key: str) -> str:
    """Trailing moments of the fused score of every trial, straight from its values."""
    lead = f"{key}, " if key else ""
    mean = "sum(t_) OVER {w} / sum(n_) OVER {w}"
    sd = f"sqrt(greatest(sum(q_) OVER {{w}} / sum(n_) OVER {{w}} - ({mean}) * ({mean}), 0))"

    def pick(e: str) -> str:
        return f"CASE WHEN days = 7 THEN {e.format(w='w7')} ELSE {e.format(w='w14')} END"

    return f"""t{tier} AS (SELECT trial, {lead}day, coalesce({pick('sum(n_) OVER {w}')}, 0) AS n_{tier}, {pick(mean)} AS mu_{tier}_s, {pick(sd)} AS sd_{tier}_s
    FROM (SELECT trial, days, {lead}day, count(*) AS n_, sum(s) AS t_, sum(s * s) AS q_ FROM f GROUP BY trial, days, {lead}day)
    WINDOW w7 AS {q.past('trial' + (', ' + key if key else ''), 7)}, w14 AS {q.past('trial' + (', ' + key if key else ''), 14)})"""


_SWEEP = f"""{q.BASE_STREAMS}, tr (trial, alpha, k_p, k_g, days) AS (VALUES {_VALUES}),
f AS (SELECT tr.*, user_id, day, split, segment, alpha * s_f + (1 - alpha) * s_s AS s FROM streams, tr),
tp AS (SELECT *, {_by_window('count(*)')} AS n_p, {_by_window('avg(s)')} AS mu_p_s, {_by_window('stddev_pop(s)')} AS sd_p_s
       FROM f WINDOW w7 AS {q.past('trial, user_id', 7)}, w14 AS {q.past('trial, user_id', 14)}),
{_pooled('g', 'segment')},
{_pooled('a', '')},
ns AS (SELECT segment, day, (SELECT count(*) FROM (SELECT segment AS sg, user_id, min(day) AS d FROM streams GROUP BY 1, 2) x
       WHERE x.sg = y.segment AND x.d < y.day) AS n_users FROM (SELECT DISTINCT segment, day FROM streams) y),
z AS (SELECT trial, user_id, day, round({q.shrink('s', 'k_p', 'k_g')}, 6) AS z FROM (
      SELECT tp.*, n_g, mu_g_s, sd_g_s, n_a, mu_a_s, sd_a_s, CAST(n_users >= {st.MIN_GROUP} AS INTEGER) AS group_ok
      FROM tp LEFT JOIN tg USING (trial, segment, day) LEFT JOIN ta USING (trial, day) LEFT JOIN ns USING (segment, day)
      WHERE split = 'val')),
top AS (SELECT trial, user_id, day FROM z WHERE z IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY trial, day ORDER BY z DESC, user_id) <= {st.BUDGET}),
cnt AS (SELECT trial, day, count(*) AS n FROM top GROUP BY trial, day),
ov AS (SELECT b.trial, b.day, b.n, a.n AS n0, (SELECT count(*) FROM top x JOIN top y ON x.trial = y.trial AND x.user_id = y.user_id
              AND y.day = x.day + 1 WHERE y.trial = b.trial AND y.day = b.day) AS both_
       FROM cnt b JOIN cnt a ON a.trial = b.trial AND b.day = a.day + 1),
ob AS (SELECT trial, avg(both_ / CAST(n + n0 - both_ AS DOUBLE)) AS objective FROM ov GROUP BY trial),
sw AS (SELECT tr.*, objective FROM tr LEFT JOIN ob USING (trial))"""


def _sweep(spark, sf) -> DataFrame:
    return tune.sweep(
        st.streams(spark, sf).select(*KEYS, "split", "s_f", "s_s", st.GROUP), _TRIALS,
        group_key=st.GROUP, min_group_size=st.MIN_GROUP, budget=st.BUDGET, floor=st.SD_FLOOR,
    )


@query("sweep", f"WITH {_SWEEP} SELECT trial, alpha, k_p, k_g, days, round(objective, 6) AS objective FROM sw")
def sweep(spark, sf):
    return rounded(_sweep(spark, sf), ["objective"])


@query(
    "tuned_params",
    f"""WITH {_SWEEP}, b AS (SELECT * FROM sw WHERE objective IS NOT NULL ORDER BY round(objective, 9) DESC, trial LIMIT 1)
    SELECT unnest(['fusion', 'tiers', 'tiers', 'tiers']) AS tier, unnest(['alpha', 'k_p', 'k_g', 'days']) AS parameter,
           unnest([alpha, CAST(k_p AS DOUBLE), CAST(k_g AS DOUBLE), CAST(days AS DOUBLE)]) AS value,
           unnest(['[0, 1]', '[1, 20]', '[5, 60]', '{{7, 14}}']) AS search_range,
           round(objective, 6) AS objective, trial, 'search' AS run_id FROM b""",
)
def tuned_params(spark, sf):
    return rounded(tune.tuned_table(_sweep(spark, sf), "search"), ["objective"])


SHARE = 0.3


@query(
    "sweep_user_subsample",
    f"WITH {q.EV}, {q.UD} SELECT user_id, day, n_events FROM ud WHERE {q.u(repr('42'), 'user_id')} < {SHARE}",
)
def sweep_user_subsample(spark, sf):
    """A share of the users is the feature here: tuning on fewer people."""
    return tune.subsample_users(st.day_scores(spark, sf), SHARE, st.SEED).select(*KEYS, "n_events")
