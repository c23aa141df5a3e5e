"""Common parts of the SQL that results are compared with."""

from __future__ import annotations

from vigilday.plans import standins as st

_LOG = " ".join(f"WHEN '{t}' THEN '{name}'" for t, name in st.LOG_OF.items())

EV = f"""ev AS (
  SELECT event_id, ts, user_id, CAST(ts AS DATE) AS day, CASE event_type {_LOG} END AS log,
         event_type AS action, regexp_extract(props, '"k": *([0-9]+)', 1) AS object, value AS qty,
         strftime(ts, '%Y-%m') AS month,
         CAST(hour(ts) < {st.HOURS[0]} OR hour(ts) >= {st.HOURS[1]} AS INTEGER) AS off_hours,
         CAST(isodow(ts) >= 6 AS INTEGER) AS weekend,
         CAST(hour(ts) < {st.HOURS[0]} OR hour(ts) >= {st.HOURS[1]} OR isodow(ts) >= 6 AS INTEGER) AS off
  FROM events)"""

UD = """ud AS (
  SELECT user_id, day, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts
  FROM ev GROUP BY user_id, day)"""


def ratio(source: str, shares: tuple[int, int, int], unit: str, name: str = "sp") -> str:
    """Part by time of every day in ``source``."""
    a, b = shares[0], shares[0] + shares[1]
    return f"""{name} AS (
  SELECT day, CASE WHEN r <= n * {a} // 100 THEN 'train' WHEN r <= n * {b} // 100 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT DISTINCT day FROM {source}) JOIN (
    SELECT u, row_number() OVER (ORDER BY u) AS r, count(*) OVER () AS n
    FROM (SELECT DISTINCT date_trunc('{unit}', day) AS u FROM {source})) ON u = date_trunc('{unit}', day))"""


SP = ratio("ev", st.SHARES, "day")

PEOPLE = """people AS (
  SELECT c_custkey AS user_id, c_mktsegment AS segment, c_nationkey AS nation, n_regionkey AS region
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""

SC = """sc AS (
  SELECT ud.*, split, CAST(n_events AS DOUBLE) AS s, segment, nation, region
  FROM ud JOIN sp USING (day) LEFT JOIN people USING (user_id))"""

_WINDOWS = {i: " ".join(f"WHEN '{s}' THEN {w[i]!r}" for s, w in st.WINDOWS.items()) for i in range(3)}
ANSWERS = f"""answers AS (
  SELECT c_custkey AS user_id, CAST(CASE c_mktsegment {_WINDOWS[0]} END AS INTEGER) AS scenario,
         CAST(CASE c_mktsegment {_WINDOWS[1]} END AS TIMESTAMP) AS t0,
         CAST(CASE c_mktsegment {_WINDOWS[2]} END AS TIMESTAMP) AS t1
  FROM customer WHERE c_acctbal < 0)"""

LAB = """lab AS (
  SELECT user_id, day, n_events, first_ts, last_ts, coalesce(label, 0) AS label, coalesce(scenario, 0) AS scenario
  FROM ud LEFT JOIN (
    SELECT user_id, day, 1 AS label, max(scenario) AS scenario
    FROM ev JOIN answers USING (user_id) WHERE ts BETWEEN t0 AND t1 GROUP BY user_id, day) USING (user_id, day))"""

DIRECTORY = """directory AS (
  SELECT user_id, CAST(date_trunc('week', ts) AS DATE) + 7 AS valid_from,
         arg_max(action, (qty, event_id)) AS role, arg_max(log, (qty, event_id)) AS department
  FROM ev GROUP BY user_id, valid_from)"""

FEAT = f"""feat AS (
  SELECT user_id, day, {', '.join(f"count(*) FILTER (action = '{a}') AS n_{a}" for a in st.ACTIONS)}
  FROM ev GROUP BY user_id, day)"""


def stats(source: str, columns: list[str], name: str) -> str:
    parts = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in columns)
    return f"{name} AS (SELECT {parts} FROM {source} JOIN sp USING (day) WHERE split = 'train')"


FSTATS = stats("feat", st.COUNTS, "fstats")
SF = f"""sf AS (
  SELECT user_id, day,
         ({' + '.join(f"CASE WHEN d_{c} = 0 THEN 0 ELSE (({c} - m_{c}) / d_{c}) * (({c} - m_{c}) / d_{c}) END" for c in st.COUNTS)}) / {len(st.COUNTS)} AS s_f
  FROM feat, fstats)"""

TOK = """tok AS (
  SELECT user_id, day, split, row_number() OVER w AS pos, count(*) OVER (PARTITION BY user_id, day) AS pos_total,
         log || ':' || action || ':' || CASE WHEN off = 1 THEN 'off' ELSE 'work' END AS token
  FROM ev JOIN sp USING (day) WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id))"""

NEAR = """near AS (
  SELECT *, coalesce(lag(token) OVER w, '<BOS>') AS prev1, coalesce(lag(token, 2) OVER w, '<BOS>') AS prev2,
         coalesce(lead(token) OVER w, '<EOS>') AS next1
  FROM tok WINDOW w AS (PARTITION BY user_id, day ORDER BY pos))"""

BIGRAM = """v AS (SELECT count(DISTINCT token) + 1 AS v, count(*) AS n FROM near WHERE split = 'train'),
c2 AS (SELECT prev1, token, count(*) AS n2 FROM near WHERE split = 'train' GROUP BY ALL),
c1 AS (SELECT prev1, sum(n2) AS n1 FROM c2 GROUP BY ALL),
steps AS (
  SELECT user_id, day, split, pos, -ln((coalesce(n2, 0) + 1) / CAST(coalesce(n1, 0) + v AS DOUBLE)) AS nll
  FROM near LEFT JOIN c2 USING (prev1, token) LEFT JOIN c1 USING (prev1), v)"""

SS = "ss AS (SELECT user_id, day, avg(nll) AS s_s FROM steps GROUP BY user_id, day)"

BOTH = "both_ AS (SELECT user_id, day, coalesce(s_f, 0) AS s_f, coalesce(s_s, 0) AS s_s FROM sf FULL JOIN ss USING (user_id, day))"
BSTATS = stats("both_", ["s_f", "s_s"], "bstats")
STREAMS = """streams AS (
  SELECT user_id, day, split, (s_f - m_s_f) / d_s_f AS s_f, (s_s - m_s_s) / d_s_s AS s_s, segment, nation, region
  FROM both_ JOIN sp USING (day) LEFT JOIN people USING (user_id), bstats)"""

BASE_STREAMS = ",\n".join([EV, SP, PEOPLE, FEAT, FSTATS, SF, TOK, NEAR, BIGRAM, SS, BOTH, BSTATS, STREAMS])
BASE_SCORES = ",\n".join([EV, UD, SP, PEOPLE, SC])
BASE_LABELS = ",\n".join([EV, UD, SP, ANSWERS, LAB])


def past(keys: str, days: int) -> str:
    """Window clause for the days before d."""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"({part}ORDER BY day RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"


def tiers(source: str, columns: list[str], key: str = st.GROUP, days: int = st.W, size: int = st.MIN_GROUP) -> str:
    """CTE ``bl``: ``source`` with the three baselines and the group guard."""

    def moments(tier: str, keys: str) -> str:
        lead = f"{keys}, " if keys else ""
        sums = ", ".join(f"sum({c}) AS s_{c}_, sum({c} * {c}) AS q_{c}_" for c in columns)
        out = ", ".join(
            f"sum(s_{c}_) OVER w / sum(n_) OVER w AS mu_{tier}_{c}, "
            f"sqrt(greatest(sum(q_{c}_) OVER w / sum(n_) OVER w - (sum(s_{c}_) OVER w / sum(n_) OVER w) * "
            f"(sum(s_{c}_) OVER w / sum(n_) OVER w), 0)) AS sd_{tier}_{c}"
            for c in columns
        )
        known = f" WHERE {' AND '.join(k.strip() + ' IS NOT NULL' for k in keys.split(','))}" if keys else ""
        return f"""m{tier} AS (
  SELECT {lead}day, CAST(coalesce(sum(n_) OVER w, 0) AS BIGINT) AS n_{tier}, {out}
  FROM (SELECT {lead}day, count(*) AS n_, {sums} FROM {source}{known} GROUP BY {lead}day)
  WINDOW w AS {past(keys, days)})"""

    own = ", ".join(
        f"avg({c}) OVER wp AS mu_p_{c}, stddev_pop({c}) OVER wp AS sd_p_{c}" for c in columns
    )
    return f"""{moments("g", key)},
{moments("a", "")},
seen AS (
  SELECT {key}, day, CAST(coalesce(sum(new_) OVER (PARTITION BY {key} ORDER BY day
         RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING), 0) AS BIGINT) AS n_users
  FROM (SELECT {key}, day, sum(new_) AS new_ FROM (
    SELECT {key}, min(day) AS day, 1 AS new_ FROM {source} GROUP BY {key}, user_id
    UNION ALL SELECT DISTINCT {key}, day, 0 FROM {source}) GROUP BY {key}, day)),
bl AS (
  SELECT x.*, coalesce(n_g, 0) AS n_g, n_a, coalesce(n_users, 0) AS n_users,
         CAST(coalesce(n_users, 0) >= {size} AS INTEGER) AS group_ok,
         {', '.join(f"mu_g_{c}, sd_g_{c}, mu_a_{c}, sd_a_{c}" for c in columns)},
         count(*) OVER wp AS n_p, {own}
  FROM {source} x LEFT JOIN mg USING ({key}, day) LEFT JOIN ma USING (day) LEFT JOIN seen USING ({key}, day)
  WINDOW wp AS {past("user_id", days).replace("ORDER BY day", "ORDER BY x.day").replace("BY user_id", "BY x.user_id")})"""


def shrink(c: str, k_p: str | float = st.K_P, k_g: str | float = st.K_G, which: str = "PGA") -> str:
    ok = "(group_ok = 1 AND n_g > 0)"
    w_p = f"(CASE WHEN n_p > 0 THEN n_p / CAST(n_p + {k_p} AS DOUBLE) ELSE 0.0 END)"
    w_g = f"(CASE WHEN {ok} THEN n_g / CAST(n_g + {k_g} AS DOUBLE) ELSE 0.0 END)"
    known = "n_a > 0"
    if which == "P":
        known, w_p = "n_p > 0", "1.0"
    elif which == "PG":
        known = f"(n_p > 0 OR {ok})"
        w_p, w_g = f"(CASE WHEN {ok} THEN {w_p} ELSE 1.0 END)", "1.0"

    def mix(f: str) -> str:
        p, g, a = (f.replace("#", t) for t in "pga")
        return f"(CAST({w_p} AS DOUBLE) * {p} + (1 - CAST({w_p} AS DOUBLE)) * (CAST({w_g} AS DOUBLE) * {g} + (1 - CAST({w_g} AS DOUBLE)) * {a}))"

    mu = mix(f"coalesce(mu_#_{c}, 0)")
    sd = f"sqrt({mix(f'coalesce(sd_#_{c}, 0) * coalesce(sd_#_{c}, 0)')})"
    return f"CASE WHEN {known} THEN ({c} - {mu}) / greatest({sd}, {st.SD_FLOOR}) END"


def tier_z(c: str) -> dict[str, str]:
    ok = {"p": "n_p > 0", "g": "group_ok = 1 AND n_g > 0", "a": "n_a > 0"}
    return {
        t: f"CASE WHEN {cond} THEN ({c} - mu_{t}_{c}) / greatest(sd_{t}_{c}, {st.SD_FLOOR}) END"
        for t, cond in ok.items()
    }


def u(*parts: str) -> str:
    """The keyed number in [0, 1)."""
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT) / 4294967296.0)"
