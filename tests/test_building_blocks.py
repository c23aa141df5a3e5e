"""The skew-safe ways must give exactly what the plain ways give."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from vigilday.functions import joins, ordering, quantiles, storage, windows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third and more of the rows under one key, with many equal values."""
    rnd = random.Random(7)
    data = [(rnd.choice(["hot"] * 5 + ["a", "b", "c"]), i, float(rnd.randint(0, 9)), rnd.randint(0, 1)) for i in range(700)]
    return spark.createDataFrame(data, "k string, id int, v double, y int")


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("desc", [False, True])
def test_sliced_sums_equal_the_plain_window(skewed, keys, desc):
    order = [F.desc("v") if desc else F.asc("v"), F.col("id")]
    sums = {"n": F.lit(1), "t": F.col("y")}
    plain = ordering.running_sums(skewed, keys, order, sums, totals=True)
    sliced = ordering.running_sums(skewed, keys, order, sums, totals=True, max_group=10, slices=7)
    assert rows(plain.select(*sorted(plain.columns))) == rows(sliced.select(*sorted(plain.columns)))


def test_sliced_positions_split_the_hot_group(skewed):
    cut = skewed.repartitionByRange(7, "k", "v", "id").filter("k = 'hot'")
    assert cut.select(F.spark_partition_id()).distinct().count() > 2
    out = ordering.positions(skewed, ["k"], [F.col("v"), F.col("id")], max_group=10, slices=7)
    hot = sorted(r.pos for r in out.filter("k = 'hot'").collect())
    assert hot == list(range(1, len(hot) + 1))


def test_top_rows_small_and_large(spark, skewed):
    order = [F.desc("v"), F.col("id")]
    small = ordering.top_rows(skewed, ["k"], order, 3)
    assert "WindowGroupLimit" in small._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "2")
    try:
        large = ordering.top_rows(skewed, ["k"], order, 3)
        assert rows(small.select("k", "id", "rank")) == rows(large.select("k", "id", "rank"))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("max_group", [10**6, 3])
def test_exact_quantile_is_percentile(skewed, p, max_group):
    ours = quantiles.exact_quantile(skewed, ["k"], "v", p, max_group=max_group)
    plain = skewed.groupBy("k").agg(F.percentile("v", F.lit(p)).alias("q"), F.count("v").alias("n_q"))
    left, right = rows(ours), rows(plain)
    assert [(a[0], a[2]) for a in left] == [(b[0], b[2]) for b in right]
    assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(left, right))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_broadcast_join(spark, skewed, how):
    table = spark.createDataFrame([("hot", 1), ("a", 2), ("zzz", 3)], "k string, w int")
    plain = joins.lookup_join(skewed, table, ["k"], how)
    salted = joins.lookup_join(skewed, table, ["k"], how, max_rows=1, salts=5)
    assert rows(plain.select("k", "id", "w")) == rows(salted.select("k", "id", "w"))


def test_broadcast_is_refused_by_rows_and_by_bytes(spark):
    table = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert joins.fits_broadcast(table)
    assert not joins.fits_broadcast(table, max_rows=99)
    assert not joins.fits_broadcast(table, max_bytes=50_000)


def test_trailing_window_leaves_out_the_day_itself(spark):
    df = spark.sql("select 'u' as user_id, date_add(date'2024-01-01', cast(id as int)) as day, id from range(5)")
    got = df.withColumn("s", F.sum("id").over(windows.trailing(["user_id"], 2))).orderBy("day").collect()
    assert [r.s for r in got] == [None, 0, 1, 3, 5]


def test_unit_hash_is_fixed_and_even(spark):
    df = spark.range(2000).select(windows.unit_hash(F.lit(42), F.col("id")).alias("u"))
    low, high, mean = df.agg(F.min("u"), F.max("u"), F.avg("u")).first()
    assert 0 <= low and high < 1 and abs(mean - 0.5) < 0.03
    assert spark.range(1).select(windows.unit_hash(F.lit("a"), F.lit("b"))).first()[0] == pytest.approx(
        int(__import__("hashlib").md5(b"a|b").hexdigest()[:8], 16) / 2**32)


def test_shared_folder_comes_from_the_session(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = storage.stored(spark.range(3))
    assert storage.stored(df) is df and df.count() == 3
    assert spark.conf.get("spark.checkpoint.dir").split("/")[-1] in df.inputFiles()[0]


def test_plain_window_agrees_for_percent_rank(spark, skewed):
    from vigilday.operators.fusion import normalise_rank

    days = skewed.select(F.col("id").alias("user_id"), F.col("k").alias("day"), "v")
    plain = days.withColumn("v", F.percent_rank().over(Window.partitionBy("day").orderBy("v")))
    sliced = normalise_rank(days, ["v"], max_group=5)
    left, right = rows(plain.select("user_id", "v")), rows(sliced.select("user_id", "v"))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(left, right))
