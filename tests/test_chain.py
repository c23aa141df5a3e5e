"""Intervals, ledgers, sketches by day, merged fits and the search, on small frames."""

import datetime as dt
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from vigilday.functions.storage import new_table_path
from vigilday.operators import features, threshold, tiers, tune
from vigilday.operators.org import attach_org
from vigilday.plans import chain
from vigilday.sources import tables

SF = "/root/testdata/sf0.001"
DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def scores(spark, n_users=3, n_days=30, seed=1):
    rng = random.Random(seed)
    made = [(u, day(d), float(rng.randint(0, 50))) for u in range(n_users) for d in range(n_days) if rng.random() < 0.8]
    return spark.createDataFrame(made, "user_id long, day date, s double")


def test_intervals_carry_thresholds_forward(spark):
    held = spark.createDataFrame(
        [(1, 0, None), (1, 1, 5.0), (1, 1, 5.0), (1, 2, None), (1, 3, 7.0), (2, 0, None)], "user_id long, block int, tau double"
    )
    found = threshold.threshold_intervals(held, 7, DAY0)
    assert set(map(tuple, found.collect())) == {(1, day(7), day(21), 5.0), (1, day(21), None, 7.0)}
    late = [(1, day(6)), (1, day(7)), (1, day(20)), (1, day(21)), (1, day(400)), (2, day(9)), (3, day(9))]
    asked = spark.createDataFrame(late, "user_id long, day date").withColumn("s", F.lit(6.0))
    got = {(r["user_id"], r["day"]): r["tau"] for r in threshold.in_force(asked, found).collect()}
    assert [got[k] for k in late] == [None, 5.0, 5.0, 7.0, 7.0, None, None]


def test_ledger_counts_committed_runs_once(spark):
    path = new_table_path(spark, "ledger")
    frame = lambda v: spark.createDataFrame([(v, 1.0), (v, None)], "name string, value double")
    tables.append_run(frame("first"), path, "0001")
    tables.append_run(frame("other"), path, "b")
    # a write that ended before its commit: of a new run, and of a repeat
    for run in ("c", "b"):
        frame("lost").withColumns({"run_id": F.lit(run), "attempt": F.lit("f" * 32)}).write.mode("append").parquet(f"{path}/rows")
    tables.append_run(frame("again"), path, "0001")
    tables.append_run(frame("again"), path, "0001")
    got = tables.read_ledger(spark, path)
    assert sorted((r["run_id"], r["name"], r["value"] or 0.0) for r in got.collect()) == [
        ("0001", "again", 0.0), ("0001", "again", 1.0), ("b", "other", 0.0), ("b", "other", 1.0)
    ]


def test_sketches_by_day_equal_exact_quantiles_when_small(spark):
    # below the sketch's k nothing is compressed, and a quantile is one of the scores
    df = scores(spark, 4).withColumn("g", F.col("user_id") % 2)
    found = threshold.sketched_quantile(df, ["g"], "s", 0.9, 14, 7, DAY0).toPandas()
    values = df.toPandas()
    for r in found.itertuples():
        lo, hi = day(int(r.block) * 7 - 14), day(int(r.block) * 7 - 1)
        own = np.sort(values[(values.g == r.g) & (values.day >= lo) & (values.day <= hi)].s.to_numpy())
        assert r.n_tau == len(own) and r.tau in own
        assert (own < r.tau).mean() <= 0.9 + 1 / len(own) and (own <= r.tau).mean() >= 0.9 - 1 / len(own)


def test_sketch_path_of_the_cold_start(spark):
    df = scores(spark, 6).withColumn("g", F.when(F.col("user_id") < 5, F.col("user_id") % 2))
    args = ("s", 0.9, 14, 7, 6, "g")
    exact = {(r["user_id"], r["day"]): r for r in threshold.cold_start_threshold(df, *args).collect()}
    about = threshold.cold_start_threshold(df, *args, sketch=True).collect()
    assert len(about) == len(exact) == df.count()
    assert all(r["tau_from"] == exact[r["user_id"], r["day"]]["tau_from"] for r in about)


def test_trailing_breadth(spark):
    rng = random.Random(3)
    made = [(u, day(d), str(rng.randint(0, 40))) for u in range(3) for d in range(20) for _ in range(rng.randint(0, 9))]
    got = features.trailing_breadth(spark.createDataFrame(made, "user_id long, day date, object string"), 7)
    for u, d, n in map(tuple, got.collect()):
        assert n == len({o for v, e, o in made if v == u and d - dt.timedelta(days=7) <= e < d})


def test_states_merge_to_the_whole(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + 1e6
    made = [(i, day(i % 7), *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(made, "user_id long, day date, a double, b double, c double")
    state = features.merge_state(features.daily_state(df, ["a", "b", "c"]), ["a", "b", "c"])
    want = np.cov(x.T, bias=True) * len(x)
    for r in state.collect():
        i, j = "abc".index(r["i"]), "abc".index(r["j"])
        assert r["n"] == 300 and np.isclose(r["comoment"], want[i, j], rtol=1e-6) and np.isclose(r["mean_i"], x[:, i].mean())
    fit = features.fit_directions(state, ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    errors = features.reconstruction_errors(df, fit).orderBy("user_id").toPandas()["errors"]
    values, vectors = np.linalg.eigh(np.corrcoef(x.T))
    for k in range(4):
        kept = vectors[:, ::-1][:, :k]
        assert np.allclose([e[k] for e in errors], ((z - z @ kept @ kept.T) ** 2).sum(1), atol=1e-6)
    losses = features.latent_losses(df.withColumn("split", F.when(F.col("user_id") < 300, "train")), fit).orderBy("latent").collect()
    train = [r["train_error"] for r in losses]
    assert np.allclose(train, [r["discarded"] for r in losses]) and train[-1] < 1e-9 and train == sorted(train, reverse=True)
    assert all(r["error"] is None for r in losses)


def test_constant_columns_and_no_rows(spark):
    df = spark.createDataFrame([(i, DAY0, 1.0, float(i)) for i in range(9)], "user_id long, day date, a double, b double")
    fit = features.fit_directions(features.merge_state(features.daily_state(df, ["a", "b"]), ["a", "b"]), ["a", "b"])
    assert fit.sds[0] == 0 and np.allclose([r["errors"][-1] for r in features.reconstruction_errors(df, fit).collect()], 0)
    empty = features.merge_state(features.daily_state(df.limit(0), ["a", "b"]), ["a", "b"])
    assert empty.count() == 0
    with pytest.raises(ValueError):
        features.fit_directions(empty, ["a", "b"])


def test_role_of_each_past_day_counts(spark):
    # user 1 moves from a to b on day 5: its first days stay in a's baseline, its later ones are b's
    ud = spark.createDataFrame([(u, day(d), float(10 * u)) for u in (1, 2, 3) for d in range(8)], "user_id long, day date, s double")
    book = spark.createDataFrame(
        [(1, day(0), "a"), (1, day(5), "b"), (2, day(0), "a"), (3, day(0), "b")], "user_id long, valid_from date, role string"
    )
    based = tiers.baselines(attach_org(ud, book, ["role"]), ["s"], "role", 7, 1)
    got = {(r["user_id"], r["day"]): (r["role"], r["n_g"], r["mu_g_s"]) for r in based.collect()}
    assert got[2, day(7)] == ("a", 5 + 7, (5 * 10 + 7 * 20) / 12)
    assert got[1, day(7)] == ("b", 2 + 7, (2 * 10 + 7 * 30) / 9)
    assert got[1, day(5)] == ("b", 5, 30.0) and got[1, day(4)] == ("a", 8, 15.0)


def test_bucketed_days_need_no_shuffle_for_their_windows(spark):
    found = chain.bucketed_tau(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" in plan
    plain = threshold.quantile_threshold(chain.bucketed_days(spark, SF), "s", 0.95, 14, 5)
    assert rows(found) == rows(plain)


def test_search_reads_each_users_own_threshold(spark):
    rng = random.Random(8)
    made = [
        (u, day(d), "train" if d < 14 else "val", rng.gauss(0, 1), rng.gauss(0, 1), "x") for u in range(12) for d in range(24)
    ]
    ud = spark.createDataFrame(made, "user_id long, day date, split string, s_f double, s_s double, grp string")
    trials = [tune.Trial(i, 0.5, 7, 30, 7, p, 2, 1) for i, p in enumerate((0.5, 0.9, 0.99), 1)]
    order = spark.createDataFrame([(2, 1.5)], "order int, nll double")
    latent = spark.createDataFrame([(1, 0.25)], "latent int, error double")
    out = tune.search(ud, trials, order, latent, group_key="grp", min_group_size=2, budget=1000).orderBy("trial").collect()
    volume = [r["alerts_per_day"] for r in out]
    assert volume[0] > volume[1] > volume[2] >= 0 and all(r["nll"] == 1.5 and r["error"] == 0.25 for r in out)
    table = tune.searched_table(spark.createDataFrame(out), "r")
    assert {r["parameter"] for r in table.collect()} == {"alpha", "k_p", "k_g", "days", "p", "order", "latent"}
