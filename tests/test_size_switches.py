"""Both sides of every size switch give the same rows, NULLs included."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vigilday.functions.ordering import running_sums
from vigilday.operators import features, fusion, metrics, sequences, tiers
from vigilday.sources import cert, tables


def test_a_null_key_is_one_group_in_slices(spark):
    df = spark.range(1000).select(F.lit(None).cast("string").alias("k"), "id")
    for limit in (1, 10_000):
        out = running_sums(df, ["k"], [F.col("id")], {"n": F.lit(1)}, totals=True, max_group=limit, slices=4)
        assert out.agg(F.max("n"), F.min("n_total"), F.max("n_total"), F.count_distinct("n")).first() == (
            1000, 1000, 1000, 1000,
        )


def test_null_values_carry_the_sum_before_them(spark):
    values = [None, 5, None, 12, None, None, 1, None]
    df = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate(values)], "k string, i int, v int")

    def summed(limit):
        return rows(running_sums(df, ["k"], [F.col("i")], {"s": F.col("v")}, True, max_group=limit, slices=6))

    assert summed(1) == summed(100)
    assert [r[3] for r in summed(1) if r[0] == "a"] == [None, 5, 5, 17, 17, 17, 18, 18]


def test_null_scores_have_no_rank(spark):
    day = dt.date(2024, 1, 1)
    data = [(1, day, None, 1.0), (2, day, 1.0, 1.0), (3, day, 2.0, 1.0), (4, day, 3.0, None), (5, None, 9.0, None)]
    df = spark.createDataFrame(data, "user_id int, day date, s_f double, s_s double")
    few, many = (rows(fusion.normalise_rank(df.filter("day is not null"), ["s_f", "s_s"], m)) for m in (100, 1))
    assert few == many
    assert [r[2] for r in few] == [None, 0.0, 0.5, 1.0]
    assert [r[3] for r in few] == [0.0, 0.0, 0.0, None]


def test_a_null_day_is_a_day_to_ranks(spark):
    day = dt.date(1970, 1, 1)
    data = [(1, day, 9.0), (2, day, 8.0), (3, None, 9.0), (4, None, 7.0), (5, None, None)]
    df = spark.createDataFrame(data, "user_id int, day date, s_f double")
    few, many = (rows(fusion.normalise_rank(df, ["s_f"], m)) for m in (100, 1))
    assert few == many and [r[2] for r in few] == [1.0, 0.0, 1.0, 0.0, None]


def test_token_arrays_say_how_many_make_up_a_day(spark):
    seq = spark.range(25).select(
        F.lit(1).alias("user_id"), F.lit("d").alias("day"), (F.col("id") + 1).alias("pos"),
        F.lit(25).alias("pos_total"), F.lit("t").alias("token"),
    )
    for size, chunks in ((10, 3), (100, 1), (25, 1)):
        found = sequences.token_arrays(seq, size).select("chunk", "n_chunks", F.size("tokens")).collect()
        assert len(found) == chunks and {r["n_chunks"] for r in found} == {chunks}
        assert sum(r[2] for r in found) == 25


def test_poisson_cuts_reach_the_last_hash_value():
    cuts = metrics.POISSON_CUTS
    assert cuts[0] == round(math.exp(-1), 12) and cuts == sorted(cuts)
    assert 1 - cuts[-1] < 2**-32 <= 1 - cuts[-2]


def test_a_day_without_masked_places_is_scored_at_all_of_them(spark):
    data = [(1, "a", 2.0, 3, 0), (1, "a", 4.0, 1, 0), (1, "b", 2.0, 3, 1), (1, "b", 4.0, 1, 0)]
    steps = spark.createDataFrame(data, "user_id int, day string, nll double, n int, n_masked int")
    assert rows(sequences.masked_score(steps)) == [(1, "a", 2.5, 0), (1, "b", 2.0, 1)]


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_spread_of_large_scores(spark, offset):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    data = [(u, d, "g", offset + (u + i) % 2) for u in range(4) for i, d in enumerate(days)]
    ud = spark.createDataFrame(data, "user_id int, day date, role string, s double")
    of_group = tiers.group(ud, ["role"], ["s"], 14).filter(F.col("day") == days[2])
    of_all = tiers.company(ud, ["s"], 14).filter(F.col("day") == days[2])
    for found in (of_group.select("mu_g_s", "sd_g_s", "n_g"), of_all.select("mu_a_s", "sd_a_s", "n_a")):
        assert found.count() == 4
        assert all(tuple(r) == (offset + 0.5, pytest.approx(0.5, rel=1e-6), 8) for r in found.collect())


def test_words_of_other_scripts(spark):
    text = spark.createDataFrame([("Für élève, naïve_1 señor",)], "text string")
    assert text.select(features.words_of(F.col("text"))).first()[0] == ["für", "élève", "naïve_1", "señor"]


def test_every_recipient_is_an_object_and_keeps_its_zeros(spark):
    mail = spark.createDataFrame([("60;10", " 21 ", None, "5")], "to string, cc string, bcc string, size string")
    mail = mail.withColumn("attachments", F.lit("0"))
    assert cert.email_columns(mail).first()["recipients"] == ["60", "10", "21"]
    events = spark.createDataFrame(
        [(1, "d", "60", ["60", "10", "21"], "email", 5.0), (1, "d", None, [], "http", 1.0)],
        "user_id int, day string, object string, objects array<string>, log string, qty double",
    )
    assert rows(features.breadth_features(events)) == [(1, "d", 3, 2, 6.0)]


def test_run_ids_keep_their_zeros(spark, tmp_path):
    metric = spark.createDataFrame([("v", "m", 1.0)], "variant string, metric string, value double")
    tables.write_run(metric, {"a": "1"}, "0001", str(tmp_path))
    assert [r.run_id for r in tables.read_runs(spark, str(tmp_path)).collect()] == ["0001"]


def test_equal_visits_are_one_row_of_a_join_past_the_bound(spark):
    web = spark.range(1_000_000).select(F.lit(1).alias("user_id"), F.lit("d").alias("day"), F.lit("h").alias("host"))
    hosts = spark.createDataFrame([("h",)], "host string")
    assert rows(features.domain_list_features(web, hosts, max_rows=0)) == [(1, "d", 1_000_000, 1_000_000, 1)]
