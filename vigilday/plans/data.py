"""Queries over sources, sinks, normalisation, labels and parts by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilday.functions.storage import new_table_path, stored
from vigilday.operators import features, labels, normalise, org, report, sequences, split, threshold
from vigilday.plans import sql as q
from vigilday.plans import standins as st
from vigilday.plans.registry import query, rounded
from vigilday.sources import cert, tables

# ---- raw logs, directory, answers -------------------------------------------------

# Per log its query, and the columns of the file that hold the object and the rest.
_SCANS = {
    "logon": ("scan_logon", "pc", "activity"), "device": ("scan_device", "pc", "activity"),
    "file": ("scan_file", "filename", "content"), "email": ("scan_email", "to", "size"),
    "http": ("scan_http", "host", "content"),
}
_OBJECT = "CASE WHEN log = 'http' THEN 'h' || object ELSE object END"


def _scan(log: str, obj: str, rest: str):
    def scan(spark, sf):
        """One raw log as its reader returns it."""
        rows = cert.read_log(spark, st.raw_logs(spark, sf), log)
        rows = cert.web_columns(rows) if log == "http" else rows
        value = F.lower(rest) if rest == "activity" else F.col(rest).cast("double")
        return rows.select(
            F.col("id").cast("long").alias("event_id"), "ts", F.col("user").cast("long").alias("user_id"),
            F.col(obj).alias("object"), value.alias("action" if rest == "activity" else "qty"),
        )

    return scan


for _log, (_name, _obj, _rest) in _SCANS.items():
    _value = "action" if _rest == "activity" else "qty"
    query(
        _name, f"WITH {q.EV} SELECT event_id, ts, user_id, {_OBJECT} AS object, {_value} FROM ev WHERE log = '{_log}'"
    )(_scan(_log, _obj, _rest))


@query(
    "scan_directory",
    f"""WITH {q.EV} SELECT user_id, CAST(date_trunc('month', ts) AS DATE) AS valid_from,
        arg_max(action, (qty, event_id)) AS role, arg_max(log, (qty, event_id)) AS department
        FROM ev GROUP BY ALL""",
)
def scan_directory(spark, sf):
    rows = cert.read_directory(spark, st.raw_logs(spark, sf))
    return rows.select(F.col("user_id").cast("long").alias("user_id"), "valid_from", "role", "department")


@query("scan_answers", f'WITH {q.ANSWERS} SELECT user_id, scenario, t0 AS "start", t1 AS "end" FROM answers')
def scan_answers(spark, sf):
    found = cert.read_answers(spark, st.raw_logs(spark, sf))
    return found.withColumn("user_id", F.col("user_id").cast("long"))


@query(
    "interim_by_month",
    f"""WITH {q.EV} SELECT log, month, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
        min(ts) AS first_ts, max(event_id) AS last_id FROM ev GROUP BY log, month""",
)
def interim_by_month(spark, sf):
    path = new_table_path(spark, "interim")
    tables.write_interim(st.events(spark, sf), path)
    return (
        tables.read_interim(spark, path)
        .groupBy("log", "month")
        .agg(
            F.count(F.lit(1)).alias("n_events"), F.count_distinct("user_id").alias("n_users"),
            F.min("ts").alias("first_ts"), F.max("event_id").alias("last_id"),
        )
    )


@query(
    "processed_tables",
    f"""WITH {q.EV}, {q.UD}, {q.SP}, {q.ANSWERS}, {q.LAB}, {q.FEAT}, {q.TOK}
    SELECT user_id, day, split, label, scenario, n_signup, n_click, n_purchase, n_error, n_view, n_tokens
    FROM lab JOIN sp USING (day) JOIN feat USING (user_id, day)
    JOIN (SELECT user_id, day, count(*) AS n_tokens FROM tok GROUP BY user_id, day) USING (user_id, day)""",
)
def processed_tables(spark, sf):
    path = new_table_path(spark, "processed")
    labelled = stored(st.labels(spark, sf))
    tables.write_processed(
        path,
        x_f=features.count_features(st.events(spark, sf), st.ACTIONS),
        tokens=sequences.tokens(st.flagged(spark, sf)),
        labels=labelled.select("user_id", "day", "label", "scenario"),
        split=split.split_at(labelled, *st.cuts(spark, sf)).select("user_id", "day", "split"),
    )
    keys = ["user_id", "day"]
    lengths = tables.read_processed(spark, path, "tokens").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tokens"))
    out = tables.read_processed(spark, path, "split")
    for name in ("labels", "x_f"):
        out = out.join(tables.read_processed(spark, path, name), keys)
    return out.join(lengths, keys)


@query(
    "dataset_profile",
    f"""WITH {q.EV}, {q.ANSWERS} SELECT log, count(*) AS n_rows, count(DISTINCT ev.user_id) AS n_users,
        count(DISTINCT answers.user_id) AS n_insiders, min(ts) AS first_ts, max(ts) AS last_ts
        FROM ev LEFT JOIN answers USING (user_id) GROUP BY log""",
)
def dataset_profile(spark, sf):
    logs = {log: st.one_log(spark, sf, log) for log in st.LOG_OF.values()}
    return cert.profile(logs, st.answers(spark, sf))


@query(
    "version_guard",
    """SELECT o_orderpriority, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_users
       FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""",
)
def version_guard(spark, sf):
    kept = cert.keep_version(st.table(spark, sf, "orders"), "F", "o_orderstatus")
    return kept.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_users")
    )


_ALERTS = f"""{q.BASE_SCORES},
tq AS (SELECT *, CASE WHEN count(s) OVER w >= {st.MIN_HIST} THEN quantile_cont(s, {st.P}) OVER w END AS tau
       FROM sc WINDOW w AS {q.past('user_id', st.W_TAU)})"""


@query(
    "alert_sink",
    f"""WITH {_ALERTS} SELECT user_id, day, s AS score, round(tau, 6) AS tau, round(s - tau, 6) AS margin
        FROM tq WHERE s - tau > 1e-9""",
)
def alert_sink(spark, sf):
    path = new_table_path(spark, "alerts")
    ud = threshold.quantile_threshold(st.day_scores(spark, sf), "s", st.P, st.W_TAU, st.MIN_HIST)
    tables.write_alerts(threshold.alerts(ud, "s"), path)
    return rounded(tables.read_alerts(spark, path), ["tau", "margin"]).select(
        "user_id", "day", "score", "tau", "margin"
    )


_RUN = f"""{q.BASE_SCORES}, runs AS (
  SELECT 'counts' AS run_id, split AS variant, unnest(['n_user_days', 'n_events', 'mean_s']) AS metric,
         unnest([CAST(count(*) AS DOUBLE), CAST(sum(n_events) AS DOUBLE), avg(s)]) AS value
  FROM sc GROUP BY split)"""


def _runs(spark, sf):
    """One stored run: a few counts per part."""
    path = new_table_path(spark, "runs")
    wide = st.split_days(spark, sf).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_user_days"), F.sum("n_events").alias("n_events"), F.avg("s").alias("mean_s")
    )
    rows = report.metric_rows(wide, F.col("split"), ["n_user_days", "n_events", "mean_s"])
    tables.write_run(rows, {"W": st.W, "p": st.P}, "counts", path)
    return tables.read_runs(spark, path)


@query(
    "run_sink",
    f"WITH {_RUN} SELECT run_id, variant, metric, round(value, 6) AS value, '{st.W}' AS w, '{st.P}' AS p FROM runs",
)
def run_sink(spark, sf):
    return _runs(spark, sf).select(
        "run_id", "variant", "metric", F.round("value", 6).alias("value"),
        F.col("params")["W"].alias("w"), F.col("params")["p"].alias("p"),
    )


@query(
    "report_tables",
    f"""WITH {_RUN} SELECT run_id, variant, max(value) FILTER (metric = 'n_user_days') AS n_user_days,
        max(value) FILTER (metric = 'n_events') AS n_events,
        round(max(value) FILTER (metric = 'mean_s'), 6) AS mean_s FROM runs GROUP BY run_id, variant""",
)
def report_tables(spark, sf):
    return rounded(report.report(_runs(spark, sf), ["n_user_days", "n_events", "mean_s"]), ["mean_s"])


# ---- normalise, label, split ---------------------------------------------------------


@query(
    "normalise_events",
    f"""WITH {q.EV} SELECT event_id, ts, user_id, day, log, month, {_OBJECT} AS object,
        CASE log WHEN 'file' THEN 'copy' WHEN 'email' THEN 'send' WHEN 'http' THEN 'visit' ELSE action END AS action,
        CASE WHEN log = 'email' THEN qty ELSE 1.0 END AS qty,
        CASE WHEN object IS NULL THEN '' WHEN log = 'email' THEN object || ';c' || object ELSE {_OBJECT} END AS objects
        FROM ev""",
)
def normalise_events(spark, sf):
    """The raw logs through their readers to events; the list of objects is shown as one text."""
    raw = st.raw_logs(spark, sf)
    done = normalise.normalise({log: cert.read_log(spark, raw, log) for log in cert.LOG_COLUMNS})
    return done.withColumns({
        "event_id": F.col("event_id").cast("long"), "user_id": F.col("user_id").cast("long"),
        "objects": F.array_join("objects", ";"),
    })


@query(
    "reject_bad_rows",
    f"""WITH {q.EV} SELECT log, count(*) FILTER (log <> 'http') AS n_good, count(*) FILTER (log = 'http') AS n_bad
        FROM ev GROUP BY log""",
)
def reject_bad_rows(spark, sf):
    """Times are written as text again, the web log's in a form the reader does not know."""
    raw = st.events(spark, sf).withColumn(
        "date",
        F.when(F.col("log") == "http", F.col("ts").cast("string")).otherwise(
            F.date_format("ts", "MM/dd/yyyy HH:mm:ss")
        ),
    )
    good, bad = normalise.split_valid(raw.withColumn("ts", cert.parse_time(F.col("date"))), user="user_id")
    both = good.select("log", F.lit(1).alias("ok")).unionByName(bad.select("log", F.lit(0).alias("ok")))
    return both.groupBy("log").agg(
        F.count_if(F.col("ok") == 1).alias("n_good"), F.count_if(F.col("ok") == 0).alias("n_bad")
    )


@query("user_day", f"WITH {q.EV}, {q.UD} SELECT * FROM ud")
def user_day(spark, sf):
    return normalise.user_days(st.events(spark, sf))


@query(
    "user_day_calendar",
    f"""WITH {q.EV}, {q.UD}, cal AS (
          SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day
          FROM ud GROUP BY user_id)
        SELECT user_id, day, coalesce(n_events, 0) AS n_events FROM cal LEFT JOIN ud USING (user_id, day)""",
)
def user_day_calendar(spark, sf):
    return normalise.densify(normalise.user_days(st.events(spark, sf)))


@query("work_hours_flag", f"WITH {q.EV} SELECT event_id, off_hours, weekend, off FROM ev")
def work_hours_flag(spark, sf):
    return st.flagged(spark, sf).select("event_id", "off_hours", "weekend", "off")


@query(
    "user_filter",
    f"""WITH {q.EV}, {q.UD} SELECT user_id, day, n_events FROM ud
        WHERE user_id IN (SELECT user_id FROM ud GROUP BY user_id HAVING count(*) >= 27)""",
)
def user_filter(spark, sf):
    return normalise.filter_users(normalise.user_days(st.events(spark, sf)), 27).select("user_id", "day", "n_events")


@query(
    "label_events",
    f"""WITH {q.EV}, {q.ANSWERS} SELECT event_id, user_id, ts, max(scenario) AS scenario
        FROM ev JOIN answers USING (user_id) WHERE ts BETWEEN t0 AND t1 GROUP BY event_id, user_id, ts""",
)
def label_events(spark, sf):
    return labels.label_events(st.events(spark, sf), st.answers(spark, sf)).select(
        "event_id", "user_id", "ts", "scenario"
    )


@query("label_user_days", f"WITH {q.BASE_LABELS} SELECT user_id, day, n_events, label, scenario FROM lab")
def label_user_days(spark, sf):
    return st.labels(spark, sf).select("user_id", "day", "n_events", "label", "scenario")


@query(
    "org_as_of",
    f"""WITH {q.EV}, {q.UD}, {q.DIRECTORY}
        SELECT ud.user_id, ud.day, n_events, role, department
        FROM ud ASOF LEFT JOIN directory ON ud.user_id = directory.user_id AND ud.day >= directory.valid_from""",
)
def org_as_of(spark, sf):
    ud = normalise.user_days(st.events(spark, sf)).select("user_id", "day", "n_events")
    return org.attach_org(ud, st.directory(spark, sf), ["role", "department"])


_ORDERS = "od AS (SELECT o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day, count(*) AS n_events FROM orders GROUP BY ALL)"


def _order_days(spark, sf):
    """Order days by customer: the stand-in that spans many months."""
    return (
        st.table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("user_id"), F.to_date("o_orderdate").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )


@query("split_ratio_month", f"WITH {_ORDERS}, {q.ratio('od', (60, 15, 25), 'month')} SELECT user_id, day, n_events, split FROM od JOIN sp USING (day)")
def split_ratio_month(spark, sf):
    return split.split_ratio(_order_days(spark, sf), (60, 15, 25), "month")


@query("split_ratio_alt", f"WITH {_ORDERS}, {q.ratio('od', (50, 20, 30), 'month')} SELECT user_id, day, n_events, split FROM od JOIN sp USING (day)")
def split_ratio_alt(spark, sf):
    return split.split_ratio(_order_days(spark, sf), (50, 20, 30), "month")


@query(
    "split_rolling_week",
    f"""WITH {_ORDERS}, f AS (SELECT date_trunc('month', min(day)) AS m0 FROM od), sp AS (
          SELECT od.*, CASE WHEN day < m0 + INTERVAL 45 MONTH THEN 'train' WHEN day < m0 + INTERVAL 48 MONTH THEN 'val'
                 ELSE 'test' END AS split FROM od, f)
        SELECT user_id, day, n_events, split,
               CASE WHEN split = 'test' THEN CAST(date_trunc('week', day) AS DATE) END AS fold FROM sp""",
)
def split_rolling_week(spark, sf):
    return split.split_fixed_train(_order_days(spark, sf), 48, val_months=3)


_LABELLED = f"{q.BASE_LABELS}, ls AS (SELECT user_id, day, n_events, label, split FROM lab JOIN sp USING (day))"


def _labelled_split(spark, sf):
    return split.split_at(st.labels(spark, sf), *st.cuts(spark, sf)).select(
        "user_id", "day", "n_events", "label", "split"
    )


@query("train_drop_malicious_days", f"WITH {_LABELLED} SELECT * FROM ls WHERE NOT (split = 'train' AND label = 1)")
def train_drop_malicious_days(spark, sf):
    return split.train_policy(_labelled_split(spark, sf), "drop_days")


@query("train_keep_all", f"WITH {_LABELLED} SELECT * FROM ls")
def train_keep_all(spark, sf):
    return split.train_policy(_labelled_split(spark, sf), "keep")


@query(
    "train_drop_insiders",
    f"""WITH {_LABELLED} SELECT * FROM ls
        WHERE NOT (split = 'train' AND user_id IN (SELECT user_id FROM ls WHERE label = 1))""",
)
def train_drop_insiders(spark, sf):
    return split.train_policy(stored(_labelled_split(spark, sf)), "drop_users")


@query(
    "split_summary",
    f"""WITH {_LABELLED} SELECT split, min(day) AS first_day, max(day) AS last_day, count(*) AS n_user_days,
        count(DISTINCT user_id) AS n_users, CAST(sum(label) AS BIGINT) AS n_malicious FROM ls GROUP BY split""",
)
def split_summary(spark, sf):
    return split.split_summary(_labelled_split(spark, sf))


@query(
    "leakage_check",
    f"""WITH {_LABELLED}, d AS (SELECT min(day) FILTER (split = 'val') AS v, min(day) FILTER (split = 'test') AS t FROM ls)
        SELECT 'train_before_val' AS "check", count(*) FILTER (split = 'train' AND day >= least(v, t)) AS n_bad FROM ls, d
        UNION ALL SELECT 'val_before_test', count(*) FILTER (split = 'val' AND day >= t) FROM ls, d
        UNION ALL SELECT 'one_split_per_user_day', count(*) FROM (
          SELECT user_id, day FROM ls GROUP BY user_id, day HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'fitted_on_train_only', count(*) FROM ls WHERE split <> 'train' AND label = 0""",
)
def leakage_check(spark, sf):
    """Statistics are said to be fitted on train and, wrongly, on quiet later days too."""
    ud = stored(_labelled_split(spark, sf))
    return split.leakage_check(ud, ud.filter("split = 'train' OR label = 0"))
