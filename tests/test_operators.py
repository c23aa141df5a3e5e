"""What must hold whatever the data: no look-ahead, whole results, and equal ways."""

import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from vigilday.operators import (
    ablation, features, fusion, metrics, normalise, report, sequences, split, threshold, tiers, tune,
)

START = date(2024, 1, 1)
KEYS = ["user_id", "day"]


@pytest.fixture(scope="module")
def events(spark):
    """One user makes more than a third of all events, most of them on one day."""
    rnd = random.Random(11)
    data = []
    for i in range(900):
        hot = rnd.random() < 0.4
        user = "hot" if hot else f"u{rnd.randint(1, 9)}"
        offset = 12 if hot and rnd.random() < 0.6 else rnd.randint(0, 24)
        ts = datetime(2024, 1, 1) + timedelta(days=offset, hours=rnd.randint(0, 23), minutes=rnd.randint(0, 3))
        log = rnd.choice(["logon", "device", "file", "email", "http"])
        data.append((i, ts, user, log, log + str(rnd.randint(1, 2)), f"o{rnd.randint(1, 6)}", float(rnd.randint(1, 50))))
    df = spark.createDataFrame(
        data, "event_id long, ts timestamp_ntz, user_id string, log string, action string, object string, qty double")
    return normalise.flag_hours(df.withColumn("day", F.to_date("ts")), 8, 18).cache()


@pytest.fixture(scope="module")
def scored(spark):
    """Thirty days of twelve users in three groups, one user without a group."""
    rnd = random.Random(5)
    data = [
        (f"u{u}", START + timedelta(days=d), float(rnd.randint(0, 12)), rnd.random(),
         None if u == 0 else f"g{u % 3}", int(u == 4 and 20 <= d <= 26))
        for u in range(12) for d in range(30) if rnd.random() < 0.9
    ]
    df = spark.createDataFrame(data, "user_id string, day date, s double, t double, grp string, label int")
    return split.split_ratio(df, (60, 15, 25), "day").cache()


# ---- order stream ------------------------------------------------------------------------


def test_sliced_tokens_equal_plain_tokens(events):
    plain, sliced = sequences.tokens(events), sequences.tokens(events, max_group=20, slices=9)
    assert rows(plain) == rows(sliced)


def test_neighbours_do_not_depend_on_the_slice(events):
    placed = sequences.tokens(events)
    whole = sequences.neighbours(placed, back=2, ahead=1)
    assert rows(whole) == rows(sequences.neighbours(placed, back=2, ahead=1, size=3))
    w = Window.partitionBy(*KEYS).orderBy("pos")
    plain = placed.withColumns({
        "prev1": F.coalesce(F.lag("token").over(w), F.lit("<BOS>")),
        "prev2": F.coalesce(F.lag("token", 2).over(w), F.lit("<BOS>")),
        "next1": F.coalesce(F.lead("token").over(w), F.lit("<EOS>")),
    })
    assert rows(whole.select(*plain.columns)) == rows(plain)


def test_long_days_become_several_arrays(events):
    placed = sequences.tokens(events)
    arrays = sequences.token_arrays(placed, size=50)
    assert arrays.agg(F.max(F.size("tokens"))).first()[0] == 50
    back = arrays.select(*KEYS, F.posexplode("tokens").alias("p", "token"), "chunk").select(
        *KEYS, (F.col("chunk") * 50 + F.col("p") + 1).alias("pos"), "token")
    assert rows(back) == rows(placed.select(*KEYS, "pos", "token"))


@pytest.mark.parametrize("mode", ["head", "tail", "chunk"])
def test_truncation_keeps_what_it_says(events, mode):
    short = sequences.truncate(sequences.tokens(events), 4, mode)
    longest = short.groupBy(*KEYS, *(["chunk"] if mode == "chunk" else [])).count().agg(F.max("count")).first()[0]
    assert longest == 4
    if mode == "chunk":
        assert short.count() == events.count()


@pytest.mark.parametrize("n", [2, 3])
def test_next_token_probabilities_sum_to_one(spark, events, n):
    near = sequences.neighbours(sequences.tokens(events), back=2)
    train = sequences.count_steps(near.filter(F.col("day") < F.lit(date(2024, 1, 15))))
    model = sequences.fit_ngram(train, n)
    vocabulary = train.select("token").distinct().unionByName(
        spark.createDataFrame([(f"unseen{i}",) for i in range(int(model.size) - train.select("token").distinct().count())], "token string"))
    contexts = train.select("prev1", "prev2").distinct().limit(20)
    every = contexts.join(F.broadcast(vocabulary), how="cross").withColumn("n", F.lit(1))
    sums = sequences.nll(every, model).groupBy("prev1", "prev2").agg(F.sum(F.exp(-F.col("nll"))).alias("p")).collect()
    assert all(abs(r.p - 1) < 1e-9 for r in sums)


def test_rare_tokens_become_unknown(events):
    placed = sequences.tokens(events)
    counts = {r.token: r["count"] for r in placed.groupBy("token").count().collect()}
    out = sequences.apply_vocab(placed, sequences.fit_vocab(placed, 40))
    salted = sequences.apply_vocab(placed, sequences.fit_vocab(placed, 40), max_rows=1)
    assert rows(out) == rows(salted)
    assert out.filter("token = '<UNK>'").count() == sum(c for c in counts.values() if c < 40)


def test_day_scores_from_counts_equal_scores_from_tokens(events):
    near = sequences.neighbours(sequences.tokens(events))
    steps = sequences.count_steps(near)
    model = sequences.fit_ngram(steps, 2)
    per_token = {}
    table = {(r.prev1, r.token): r.nll for r in sequences.nll(steps, model).collect()}
    for r in near.collect():
        per_token.setdefault((r.user_id, r.day), []).append(table[(r.prev1, r.token)])
    counted = sequences.nll(steps, model)
    want = {
        "mean": lambda v: sum(v) / len(v), "max": max,
        "top3": lambda v: sum(sorted(v)[-3:]) / len(sorted(v)[-3:]),
    }
    for agg, f in want.items():
        got = {(r.user_id, r.day): r.s_s for r in sequences.day_score(counted, agg).collect()}
        assert got.keys() == per_token.keys()
        assert all(abs(got[k] - f(v)) < 1e-9 for k, v in per_token.items())


def test_mask_share_and_seeds(events):
    near = sequences.neighbours(sequences.tokens(events), ahead=1)
    share = near.filter(sequences.sampled(0.3)).count() / near.count()
    assert 0.2 < share < 0.4
    model = sequences.fit_cloze(sequences.count_steps(near))
    seeded = sequences.seeded_scores(near, model, 0.3, [1, 2])
    one = sequences.day_score(
        sequences.nll(sequences.count_steps(near, n=sequences.sampled(0.3, F.lit(2), "user_id", "day", "pos")), model))
    got = {(r.user_id, r.day): r.s_s for r in seeded.filter("seed = 2").collect()}
    want = {(r.user_id, r.day): r.s_s for r in one.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


# ---- volume stream -----------------------------------------------------------------------


def test_pca_error_falls_with_k_and_is_never_negative(events):
    actions = [r.log for r in events.select("log").distinct().collect()]
    counts = features.count_features(events, actions, by="log")
    names = [f"n_{a}" for a in actions]
    errors = []
    for k in (1, 2, 4, 5):
        out = features.pca_score(counts, features.fit_pca(counts, names, k))
        low, mean = out.agg(F.min("s_f"), F.avg("s_f")).first()
        assert low >= 0
        errors.append(mean)
    assert errors == sorted(errors, reverse=True) and errors[-1] < 1e-9


def test_lists_short_and_long_agree(spark):
    texts = spark.createDataFrame(
        [("a", "The KEY, the key; and a Secret!"), ("a", "nothing"), ("b", None), ("c", "key_1 key")],
        "user_id string, text string")
    words = spark.createDataFrame([("key",), ("secret",), ("zebra",)], "word string")
    want = [("a", 8, 3, 2), ("b", 0, 0, 0), ("c", 2, 1, 1)]
    assert rows(features.keyword_features(texts, words, ["user_id"])) == want
    assert rows(features.keyword_features(texts, words, ["user_id"], max_rows=0)) == want


def test_domain_list_broadcast_and_salted_agree(spark, events):
    web = events.withColumn("host", F.col("object"))
    listed = features.fit_list(web.filter(F.col("day") < F.lit(date(2024, 1, 15))), "host", 2, 1).select("host")
    assert rows(features.domain_list_features(web, listed)) == rows(features.domain_list_features(web, listed, max_rows=0))


@pytest.mark.parametrize("kind, low, high", [("minmax", 0.0, 1.0), ("zscore", None, None), ("none", None, None), ("log1p", 0.0, None)])
def test_transforms(events, kind, low, high):
    counts = features.count_features(events, ["logon", "http"], by="log")
    stats = features.fit_stats(counts, ["n_logon", "n_http"])
    out = features.transform(counts, kind, ["n_logon", "n_http"], stats)
    a, b, mean = out.agg(F.min("n_http"), F.max("n_http"), F.avg("n_http")).first()
    assert (low is None or a == low) and (high is None or b == high)
    if kind == "zscore":
        assert abs(mean) < 1e-9


# ---- split -------------------------------------------------------------------------------


@given(shares=st.sampled_from([(60, 15, 25), (50, 20, 30), (34, 33, 33)]), days=st.sets(st.integers(0, 400), min_size=1, max_size=25))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_parts_cover_every_user_day_in_time_order(spark, shares, days):
    ud = spark.createDataFrame([("u", START + timedelta(days=d)) for d in sorted(days)], "user_id string, day date")
    for unit in ("month", "day"):
        out = split.split_ratio(ud, shares, unit)
        assert out.count() == len(days)
        order = [r.split for r in out.orderBy("day").collect()]
        assert order == sorted(order, key=["train", "val", "test"].index)
        assert all(r.n_bad == 0 for r in split.leakage_check(out, out.filter("split = 'train'")).collect())


def test_policies_touch_train_only(scored):
    labelled = scored.withColumn("label", F.when(F.col("user_id") == "u7", (F.col("day") < F.lit(START + timedelta(days=5))).cast("int")).otherwise(F.col("label")))
    later = rows(labelled.filter("split <> 'train'"))
    for policy in ("keep", "drop_days", "drop_users"):
        out = split.train_policy(labelled, policy)
        assert rows(out.filter("split <> 'train'")) == later
        train = out.filter("split = 'train'")
        if policy == "drop_days":
            assert train.filter("label = 1").count() == 0 and train.filter("user_id = 'u7'").count() > 0
        if policy == "drop_users":
            assert train.filter("user_id in ('u7', 'u4')").count() == 0


def test_leaks_are_counted(scored):
    late = scored.withColumn("split", F.when(F.col("day") == F.lit(START), "test").otherwise(F.col("split")))
    doubled = scored.unionByName(scored.filter("user_id = 'u1'").withColumn("split", F.lit("test")))
    bad = {r.check: r.n_bad for r in split.leakage_check(late, scored.filter("split = 'val'")).collect()}
    assert bad["train_before_val"] > 0 and bad["fitted_on_train_only"] > 0
    assert {r.check: r.n_bad for r in split.leakage_check(doubled, doubled.limit(0)).collect()}["one_split_per_user_day"] > 0


def test_fixed_train_takes_validation_from_its_end(spark):
    ud = spark.createDataFrame([("u", date(2024, m, 15)) for m in range(1, 7)], "user_id string, day date")
    out = split.split_fixed_train(ud, 3, val_months=1).orderBy("day").collect()
    assert [r.split for r in out] == ["train", "train", "val", "test", "test", "test"]
    assert out[3].fold == date(2024, 4, 15) and out[0].fold is None


# ---- tiers and thresholds ------------------------------------------------------------------


def _future(scored, day):
    """The same rows with everything from ``day`` on changed."""
    later = F.col("day") >= F.lit(day)
    return scored.withColumn("s", F.when(later, F.col("s") * 3 + 100).otherwise(F.col("s")))


def test_no_baseline_or_threshold_sees_its_own_day_or_later(scored):
    day = START + timedelta(days=17)

    def past_only(df):
        based = tiers.baselines(df, ["s"], "grp", 7, 3)
        cold = threshold.cold_start_threshold(df, "s", 0.9, 7, 3, 3, "grp").select(*KEYS, F.col("tau").alias("tau_cold"))
        own = threshold.quantile_threshold(df, "s", 0.9, 7, 2).select(*KEYS, F.col("tau").alias("tau_own"))
        held = [c for c in based.columns if c.startswith(("mu_", "sd_", "n_", "group_ok"))]
        out = based.select(*KEYS, *held).join(cold, KEYS).join(own, KEYS)
        return out.filter(F.col("day") <= F.lit(day)).select(*sorted(out.columns))

    assert [tuple(str(x) for x in r) for r in rows(past_only(scored))] == [
        tuple(str(x) for x in r) for r in rows(past_only(_future(scored, day)))]


def test_group_and_company_baselines_equal_direct_computation(scored):
    got = {(r.user_id, r.day): r for r in tiers.baselines(scored, ["s"], "grp", 7, 3).collect()}
    data = scored.collect()
    for (user, day), r in got.items():
        for tier, inside in (("g", lambda x: x.grp == r.grp and r.grp is not None), ("a", lambda x: True), ("p", lambda x: x.user_id == user)):
            past = [x.s for x in data if inside(x) and day - timedelta(days=7) <= x.day < day]
            assert r[f"n_{tier}"] == len(past)
            if past:
                mean = sum(past) / len(past)
                sd = (sum((v - mean) ** 2 for v in past) / len(past)) ** 0.5
                assert abs(r[f"mu_{tier}_s"] - mean) < 1e-9 and abs(r[f"sd_{tier}_s"] - sd) < 1e-6
        seen = {x.user_id for x in data if x.grp == r.grp and x.day < day} if r.grp else set()
        assert r.n_users == len(seen) and r.group_ok == int(len(seen) >= 3)


def test_salted_group_join_agrees(scored):
    plain = tiers.baselines(scored, ["s"], "grp", 7, 3)
    salted = tiers.baselines(scored, ["s"], "grp", 7, 3, max_rows=1)
    assert rows(plain.select(*sorted(plain.columns))) == rows(salted.select(*sorted(plain.columns)))


def test_centre_changes_no_baseline(scored):
    a, b = (rows(tiers.company(scored, ["s"], 7, c).select(*KEYS, F.round("mu_a_s", 9), F.round("sd_a_s", 6))) for c in (0.0, 6.0))
    assert a == b


def test_no_shrinkage_is_the_personal_tier(scored):
    based = tiers.baselines(scored, ["s"], "grp", 7, 3)
    z = tiers.combine(based, ["s"], "shrink", k_p=0, k_g=30).withColumn("own", tiers.tier_z("s")["p"]).filter("n_p > 0")
    assert z.filter(F.abs(F.col("z_s") - F.col("own")) > 1e-9).count() == 0 and z.count() > 0


def test_small_groups_fall_back_to_the_company(scored):
    based = tiers.baselines(scored, ["s"], "grp", 7, 99)
    z = tiers.combine(based, ["s"], "shrink", k_p=10**12, k_g=0).withColumn("all", tiers.tier_z("s")["a"]).filter("n_a > 0")
    assert z.filter(F.abs(F.col("z_s") - F.col("all")) > 1e-6).count() == 0


def test_alpha_ends_give_one_stream(scored):
    out = scored.select(fusion.fuse("s", "t", 1).alias("a"), fusion.fuse("s", "t", 0).alias("b"), "s", "t")
    assert out.filter("a <> s or b <> t").count() == 0


def test_budget_is_kept_and_every_day_has_a_threshold_after_the_start(scored):
    cold = threshold.cold_start_threshold(scored, "s", 0.8, 7, 1, 3, "grp")
    days = cold.groupBy("day").agg(F.count("tau").alias("t"), F.count(F.lit(1)).alias("n")).orderBy("day").collect()
    assert days[0].t == 0 and all(r.t == r.n for r in days[1:])
    found = threshold.alerts(cold, "s")
    capped = threshold.cap(found, 2)
    assert capped.groupBy("day").count().agg(F.max("count")).first()[0] == 2
    assert found.filter("score <= tau").count() == 0


def test_sliced_cold_start_agrees_and_sketch_is_close(scored):
    plain = threshold.cold_start_threshold(scored, "s", 0.8, 7, 3, 99, "grp")
    sliced = threshold.cold_start_threshold(scored, "s", 0.8, 7, 3, 99, "grp", max_group=2)
    keep = [*KEYS, "tau", "tau_from"]
    assert rows(plain.select(*keep)) == rows(sliced.select(*keep))
    # a sketch returns one of the values: it lies between nearby exact quantiles
    near = threshold.cold_start_threshold(scored, "s", 0.8, 7, 3, 20, "grp", sketch=True)
    both = near.select(*KEYS, "tau", "tau_from")
    for name, p in (("low", 0.72), ("high", 0.88)):
        exact = threshold.cold_start_threshold(scored, "s", p, 7, 3, 20, "grp")
        both = both.join(exact.select(*KEYS, F.col("tau").alias(name), F.col("tau_from").alias(f"{name}_from")), KEYS)
    assert both.filter("tau is not null").count() > 0
    assert both.filter("tau < low or tau > high or tau_from <> low_from").count() == 0


def test_refresh_holds_the_threshold(scored):
    held = threshold.refreshed_threshold(scored, "s", 0.8, 14, 7, 3)
    assert held.groupBy("user_id", "block").agg(F.count_distinct("tau").alias("n")).filter("n > 1").count() == 0
    series = threshold.threshold_series(held)
    assert series.count() == held.filter("tau is not null").select("user_id", "block").distinct().count()


def test_budget_chooses_the_smallest_p_that_fits(scored):
    grid = (0.5, 0.8, 0.9, 0.99)
    curve = threshold.budget_curve(scored, "s", grid, budget=2).orderBy("p").collect()
    rates = [r.alerts_per_day for r in curve]
    assert rates == sorted(rates, reverse=True)
    fits = [r.p for r in curve if r.alerts_per_day <= 2]
    assert [r.p for r in curve if r.chosen] == [min(fits) if fits else max(grid)]
    frame = threshold.budget_curve(scored, "s", grid, budget=0)
    assert threshold.select_p("budget", curve=frame) == (min([r.p for r in curve if r.n_alerts == 0] or [0.99]))


# ---- evaluation ------------------------------------------------------------------------------


def test_average_precision_and_recall_equal_direct_computation(scored):
    data = sorted(((r.s, r.label) for r in scored.collect()), reverse=True)
    positives, total, seen, hits = sum(y for _, y in data), 0.0, 0, 0
    for value in sorted({s for s, _ in data}, reverse=True):
        step = [y for s, y in data if s == value]
        seen, hits = seen + len(step), hits + sum(step)
        total += sum(step) * hits / seen
    for limit in (10**6, 2):
        got = metrics.pr_auc(scored, "s", max_group=limit).first()
        assert abs(got.pr_auc - total / positives) < 1e-12 and (got.n, got.n_pos) == (len(data), positives)
        recalls = metrics.recall_at_k(scored, "s", [0.0, 0.1, 1.0], KEYS, max_group=limit).orderBy("k").collect()
        assert recalls[0].recall == 0 and recalls[2].recall == 1
        assert recalls[1].hits == metrics.recall_at_k(scored, "s", [0.1], KEYS).first().hits


def test_confusion_adds_up_and_rates(scored):
    judged = scored.withColumn("alert", (F.col("s") > 10).cast("int"))
    counts = metrics.fpr(metrics.confusion(judged, ["split"])).collect()
    assert sum(r.tp + r.fp + r.tn + r.fn for r in counts) == scored.count()
    train = next(r for r in counts if r.split == "train")
    assert train.recall is None or train.tp + train.fn > 0


def test_bootstrap_is_reproducible_and_weights_look_poisson(spark, scored):
    once, again = (rows(metrics.bootstrap(scored, "s", 15, 0.1, max_group=m)) for m in (10**6, 3))
    assert [r[0] for r in once] == [r[0] for r in again]
    assert all(a == b or abs(a - b) < 1e-12 for x, y in zip(once, again) for a, b in zip(x[1:], y[1:]) if a is not None)
    drawn = spark.range(4000).select(metrics.poisson_weight(F.lit(1), F.col("id")).alias("w"))
    mean, low, high = drawn.agg(F.avg("w"), F.min("w"), F.max("w")).first()
    assert abs(mean - 1) < 0.06 and low == 0 and high <= 7


def test_bootstrap_with_weight_one_is_the_plain_metric(scored, monkeypatch):
    monkeypatch.setattr(metrics, "poisson_weight", lambda *key: F.lit(1))
    got = metrics.bootstrap(scored, "s", 2, 0.1).collect()
    want = metrics.pr_auc(scored, "s").first().pr_auc
    assert all(abs(r.pr_auc - want) < 1e-12 for r in got)


def test_variants_and_rollup(scored):
    ud = scored.select(*KEYS, "split", F.col("s").alias("s_f"), F.col("t").alias("s_s"), "grp")
    variants = ablation.variant_scores(
        ud, alpha=1.0, group_key="grp", days=7, min_group_size=3, k_p=7, k_g=30, p=0.9, tau_days=7, min_hist=3)
    assert variants.count() == 12 * scored.count()
    same = variants.filter("tiers = 'off'").groupBy(*KEYS).pivot("stream", ["feature", "fused"]).agg(F.first("score"))
    assert same.filter("feature <> fused").count() == 0  # alpha 1 is the volume stream
    table = ablation.ablate(variants, scored.select(*KEYS, "label"), 0.9)
    assert table.count() == 24
    cube = ablation.rollup(table)
    assert cube.filter("stream is null and tiers is null and threshold is null").first().n_variants == 24


def test_sweep_is_reproducible_and_reads_no_label(scored):
    trials = tune.draw_trials(6, 1)
    assert trials == tune.draw_trials(6, 1) != tune.draw_trials(6, 2)
    ud = scored.select(*KEYS, "split", F.col("s").alias("s_f"), F.col("t").alias("s_s"), "grp")
    out = tune.sweep(ud, trials, group_key="grp", min_group_size=3, budget=3)
    assert rows(out) == rows(tune.sweep(ud, trials, group_key="grp", min_group_size=3, budget=3))
    found = out.filter("objective is not null").collect()
    assert found and all(0 <= r.objective <= 1 for r in found)
    chosen = tune.tuned_table(out, "r1").collect()
    assert {r.parameter for r in chosen} == {"alpha", "k_p", "k_g", "days"}
    assert chosen[0].objective == max(r.objective for r in found)


def test_subsample_takes_whole_users(scored):
    part = tune.subsample_users(scored, 0.5)
    users = {r.user_id for r in part.select("user_id").distinct().collect()}
    assert 0 < len(users) < 12
    assert rows(part) == rows(scored.filter(F.col("user_id").isin(*users)))


def test_ledger_and_seed_summary(spark):
    runs = spark.createDataFrame(
        [("r", "a", "pr_auc", 0.2), ("r", "a", "recall_1pct", 0.1), ("r", "a", "fpr", 0.05), ("r", "b", "pr_auc", 0.4)],
        "run_id string, variant string, metric string, value double")
    out = {r.config: (r.pr_auc, r.recall_1pct, r.fpr, r.test_opened) for r in report.ledger(runs, "2024-01-31", "q", "", 1).collect()}
    assert out == {"a": (0.2, 0.1, 0.05, 1), "b": (0.4, None, None, 1)}
    one = report.seed_summary(runs.filter("metric = 'pr_auc'").withColumn("variant", F.lit("x"))).first()
    assert (one.n_seeds, round(one["mean"], 9), round(one.sd, 6)) == (2, 0.3, 0.141421)


def test_only_the_evaluation_takes_labels():
    """No argument and no column named in the scoring code is a label."""
    import ast
    import inspect

    for module in (features, sequences, fusion, tiers, threshold, tune):
        tree = ast.parse(inspect.getsource(module))
        texts = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant)}
        for node in ast.walk(tree):
            if isinstance(node, ast.arg):
                assert "label" not in node.arg
            if isinstance(node, ast.Constant) and isinstance(node.value, str) and id(node) not in texts:
                assert "label" not in node.value
