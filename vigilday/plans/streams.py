"""Queries over the volume and the order stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilday.functions.joins import lookup_join
from vigilday.functions.storage import stored
from vigilday.operators import features, sequences
from vigilday.operators.split import split_at
from vigilday.plans import sql as q
from vigilday.plans import standins as st
from vigilday.plans.registry import query, rounded

# ---- volume ------------------------------------------------------------------------


@query("count_features", f"WITH {q.EV}, {q.FEAT} SELECT * FROM feat")
def count_features(spark, sf):
    return features.count_features(st.events(spark, sf), st.ACTIONS)


@query(
    "offhour_features",
    f"""WITH {q.EV} SELECT user_id, day, {', '.join(f"count(*) FILTER (action = '{a}' AND off = 1) AS off_{a}" for a in st.ACTIONS)}
        FROM ev GROUP BY user_id, day""",
)
def offhour_features(spark, sf):
    return features.offhour_features(st.flagged(spark, sf), st.ACTIONS)


_HOST = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)"
_WEB = f"""{q.EV}, {q.SP}, web AS (
  SELECT user_id, day, split, lower(nullif({_HOST}, '')) AS host
  FROM ev JOIN sp USING (day) LEFT JOIN pages ON CAST(object AS BIGINT) = page_id WHERE log = 'http'),
lst AS (SELECT host, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM web
        WHERE split = 'train' AND host IS NOT NULL GROUP BY host
        HAVING count(DISTINCT user_id) >= 2 ORDER BY n_events DESC, host LIMIT 10)"""


def _web(spark, sf):
    """Web events with the host of the page their object number names, and their part by time."""
    pages = st.table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("object"),
        F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host"),
    )
    every = split_at(st.one_log(spark, sf, "http"), *st.cuts(spark, sf))
    return lookup_join(every.select("user_id", "day", "split", "event_id", "object"), pages, ["object"])


@query(
    "domain_list_features",
    f"""WITH {_WEB} SELECT user_id, day, count(*) AS n_web, count(lst.host) AS n_listed,
        count(DISTINCT lst.host) AS n_listed_hosts FROM web LEFT JOIN lst USING (host) GROUP BY user_id, day""",
)
def domain_list_features(spark, sf):
    web = _web(spark, sf)
    return features.domain_list_features(web, features.fit_list(web.filter("split = 'train'"), "host", 10, 2))


# The listed words of the test.
KEYWORDS = ["password", "secret", "license", "email", "confidential", "token", "key", "the", "für", "éeau", "ción"]


@query(
    "keyword_features",
    f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> '')) AS word
                   FROM documents),
        c AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (word IN ({', '.join(map(repr, KEYWORDS))})) AS n_hits,
              count(DISTINCT word) FILTER (word IN ({', '.join(map(repr, KEYWORDS))})) AS n_keywords FROM w GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hits, 0) AS n_hits, coalesce(n_keywords, 0) AS n_keywords
        FROM documents LEFT JOIN c USING (doc_id)""",
)
def keyword_features(spark, sf):
    words = spark.range(1).select(F.explode(F.array(*map(F.lit, KEYWORDS))).alias("word"))
    return features.keyword_features(st.table(spark, sf, "documents").select("doc_id", "text"), words, ["doc_id"])


@query("list_from_train", f"WITH {_WEB} SELECT * FROM lst")
def list_from_train(spark, sf):
    return features.fit_list(_web(spark, sf).filter("split = 'train'"), "host", 10, 2)


@query(
    "breadth_features",
    f"""WITH {q.EV} SELECT user_id, day, count(DISTINCT object) AS n_objects, count(DISTINCT log) AS n_logs,
        round(sum(qty), 4) AS sum_qty FROM ev GROUP BY user_id, day""",
)
def breadth_features(spark, sf):
    return rounded(features.breadth_features(st.events(spark, sf)), ["sum_qty"], 4)


_LIN = f"""{q.EV}, {q.SP}, {q.FEAT}, r AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}, min({c}) AS a_{c}, max({c}) AS z_{c}' for c in st.COUNTS)}
  FROM feat JOIN sp USING (day) WHERE split = 'train')"""


@query(
    "feature_transform",
    f"""WITH {_LIN}
    SELECT 'log1p' AS kind, user_id, day, {', '.join(f'round(ln(1 + CAST({c} AS DOUBLE)), 6) AS {c}' for c in st.COUNTS)} FROM feat
    UNION ALL SELECT 'minmax', user_id, day, {', '.join(f'round(({c} - a_{c}) / CAST(z_{c} - a_{c} AS DOUBLE), 6)' for c in st.COUNTS)} FROM feat, r
    UNION ALL SELECT 'none', user_id, day, {', '.join(f'CAST({c} AS DOUBLE)' for c in st.COUNTS)} FROM feat
    UNION ALL SELECT 'zscore', user_id, day, {', '.join(f'round(({c} - m_{c}) / d_{c}, 6)' for c in st.COUNTS)} FROM feat, r""",
)
def feature_transform(spark, sf):
    counts = st.count_table(spark, sf)
    stats = features.fit_stats(counts.filter("split = 'train'"), st.COUNTS)
    out = None
    for kind in ("log1p", "minmax", "none", "zscore"):
        one = rounded(features.transform(counts, kind, st.COUNTS, stats), st.COUNTS).select(
            F.lit(kind).alias("kind"), "user_id", "day", *st.COUNTS
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("feature_score_pca")
def feature_score_pca(spark, sf):
    counts = st.count_table(spark, sf)
    scaled = features.transform(counts, "log1p", st.COUNTS)
    model = features.fit_pca(scaled.filter("split = 'train'"), st.COUNTS, 2)
    return rounded(features.pca_score(scaled, model), ["s_f"])


@query(
    "feature_score_diag",
    f"WITH {q.EV}, {q.SP}, {q.FEAT}, {q.FSTATS}, {q.SF} SELECT user_id, day, round(s_f, 6) AS s_f FROM sf",
)
def feature_score_diag(spark, sf):
    return rounded(st.volume_scores(spark, sf), ["s_f"])


# ---- order -------------------------------------------------------------------------

_TOK = f"{q.EV}, {q.SP}, {q.TOK}"
_NEAR = f"{_TOK}, {q.NEAR}"
_STEPS = f"{_NEAR}, {q.BIGRAM}"


@query("sequence_tokens", f"WITH {_TOK} SELECT user_id, day, pos, pos_total, token FROM tok")
def sequence_tokens(spark, sf):
    return sequences.tokens(st.flagged(spark, sf))



@query("token_arrays", f"WITH {_TOK} SELECT user_id, day, CAST(0 AS BIGINT) AS chunk, CAST(1 AS BIGINT) AS n_chunks, string_agg(token, ' ' ORDER BY pos) AS tokens FROM tok GROUP BY user_id, day")
def token_arrays(spark, sf):
    return sequences.token_arrays(sequences.tokens(st.flagged(spark, sf))).withColumn(
        "tokens", F.array_join("tokens", " ")
    )


MAX_LEN = 3


@query("truncate_head", f"WITH {_TOK} SELECT user_id, day, pos, token FROM tok WHERE pos <= {MAX_LEN}")
def truncate_head(spark, sf):
    return sequences.truncate(sequences.tokens(st.flagged(spark, sf)), MAX_LEN, "head").drop("pos_total")


@query("truncate_tail", f"WITH {_TOK} SELECT user_id, day, pos, token FROM tok WHERE pos > pos_total - {MAX_LEN}")
def truncate_tail(spark, sf):
    return sequences.truncate(sequences.tokens(st.flagged(spark, sf)), MAX_LEN, "tail").drop("pos_total")


@query(
    "truncate_chunks",
    f"""WITH {_STEPS}, c AS (
          SELECT user_id, day, (pos - 1) // {MAX_LEN} AS chunk, count(*) AS n, avg(nll) AS s FROM steps GROUP BY ALL)
        SELECT user_id, day, count(*) AS n_chunks, CAST(max(n) AS BIGINT) AS longest, round(max(s), 6) AS s_s
        FROM c GROUP BY user_id, day""",
)
def truncate_chunks(spark, sf):
    """Each chunk is scored, and the day gets its most surprising chunk."""
    keys = ["user_id", "day", "chunk"]
    near = sequences.truncate(sequences.neighbours(st.seq(spark, sf), back=1), MAX_LEN, "chunk")
    counted = stored(sequences.count_steps(near, [*keys, "split"]))
    steps = sequences.nll(counted, sequences.fit_ngram(counted.filter("split = 'train'"), 2))
    per_chunk = steps.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(F.col("nll") * F.col("n")) / F.sum("n")).alias("s_s")
    )
    return per_chunk.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.max("n").alias("longest"), F.round(F.max("s_s"), 6).alias("s_s")
    )



@query(
    "vocab_train",
    f"""WITH {_TOK}, known AS (SELECT token FROM tok WHERE split = 'train' GROUP BY token HAVING count(*) >= 100)
        SELECT user_id, day, pos, coalesce(known.token, '<UNK>') AS token FROM tok LEFT JOIN known USING (token)""",
)
def vocab_train(spark, sf):
    placed = st.seq(spark, sf)
    vocab = sequences.fit_vocab(placed.filter("split = 'train'"), 100)
    return sequences.apply_vocab(placed, vocab).select("user_id", "day", "pos", "token")


@query("seq_score_next", f"WITH {_STEPS}, {q.SS} SELECT user_id, day, round(s_s, 6) AS s_s FROM ss")
def seq_score_next(spark, sf):
    return rounded(st.order_scores(spark, sf), ["s_s"])


@query(
    "seq_score_trigram",
    f"""WITH {_STEPS},
    c3 AS (SELECT prev2, prev1, token, count(*) AS n3 FROM near WHERE split = 'train' GROUP BY ALL),
    x3 AS (SELECT prev2, prev1, sum(n3) AS m3 FROM c3 GROUP BY ALL),
    c0 AS (SELECT token, count(*) AS n0 FROM near WHERE split = 'train' GROUP BY ALL),
    t AS (SELECT user_id, day, -ln(
            0.6::DOUBLE * (coalesce(n3, 0) + 1) / CAST(coalesce(m3, 0) + v AS DOUBLE)
          + 0.3::DOUBLE * (coalesce(n2, 0) + 1) / CAST(coalesce(n1, 0) + v AS DOUBLE)
          + 0.1::DOUBLE * (coalesce(n0, 0) + 1) / CAST(n + v AS DOUBLE)) AS nll
          FROM near LEFT JOIN c3 USING (prev2, prev1, token) LEFT JOIN x3 USING (prev2, prev1)
          LEFT JOIN c2 USING (prev1, token) LEFT JOIN c1 USING (prev1) LEFT JOIN c0 USING (token), v)
    SELECT user_id, day, round(avg(nll), 6) AS s_s FROM t GROUP BY user_id, day""",
)
def seq_score_trigram(spark, sf):
    counted = st.steps(spark, sf, back=2)
    model = sequences.fit_ngram(counted.filter("split = 'train'"), 3)
    return rounded(sequences.day_score(sequences.nll(counted, model)), ["s_s"])


MASK_RATIO = 0.3


def cloze_sql(mask: str) -> str:
    return f"""{_NEAR},
    vv AS (SELECT count(DISTINCT token) AS v FROM near WHERE split = 'train'),
    k3 AS (SELECT prev1, next1, token, count(*) AS n3 FROM near WHERE split = 'train' GROUP BY ALL),
    k2 AS (SELECT prev1, next1, sum(n3) AS n2 FROM k3 GROUP BY ALL),
    cl AS (SELECT user_id, day, split, pos, -ln((coalesce(n3, 0) + 1) / CAST(coalesce(n2, 0) + v AS DOUBLE)) AS nll
           FROM near LEFT JOIN k3 USING (prev1, next1, token) LEFT JOIN k2 USING (prev1, next1), vv WHERE {mask})"""


@query(
    "seq_score_masked",
    f"""WITH {cloze_sql('TRUE')}, m AS (SELECT *, {q.u('user_id', 'day', 'pos')} < {MASK_RATIO} AS masked FROM cl)
        SELECT user_id, day, count(*) FILTER (masked) AS n_masked,
               round(coalesce(avg(nll) FILTER (masked), avg(nll)), 6) AS s_s FROM m GROUP BY user_id, day""",
)
def seq_score_masked(spark, sf):
    near = sequences.neighbours(st.seq(spark, sf), back=1, ahead=1)
    both = near.groupBy("user_id", "day", "split", "prev1", "next1", "token").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sequences.sampled(MASK_RATIO)).alias("n_masked")
    )
    counted = stored(both)
    model = sequences.fit_cloze(counted.filter("split = 'train'"))
    return rounded(sequences.masked_score(sequences.nll(counted, model)), ["s_s"])


@query(
    "seq_day_score",
    f"""WITH {_STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY nll DESC) AS k FROM steps)
        SELECT user_id, day, round(avg(nll), 6) AS mean_s, round(max(nll), 6) AS max_s,
               round(avg(nll) FILTER (k <= 3), 6) AS top3_s FROM r GROUP BY user_id, day""",
)
def seq_day_score(spark, sf):
    counted = st.steps(spark, sf)
    steps = stored(sequences.nll(counted, sequences.fit_ngram(counted.filter("split = 'train'"), 2)))
    keys = ["user_id", "day"]
    out = None
    for agg in ("mean", "max", "top3"):
        one = sequences.day_score(steps, agg).select(*keys, F.round("s_s", 6).alias(f"{agg}_s"))
        out = one if out is None else out.join(one, keys)
    return out
