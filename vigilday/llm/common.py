"""Helpers the operators share: tables, positions in an order, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilday.functions.storage import stored

SLICE_ROWS = 20_000
# Fixed value: a run of anything but ASCII white space, the definition of a word.
WORD = r"[^\x20\x09-\x0D]+"
# Fixed value: ASCII white space, as one class of a Java or RE2 pattern.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of ``keys`` between two aliased frames, with null equal to null."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return condition


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], rows: int
) -> DataFrame:
    """Add per name in ``sums`` the sum over the group's rows before this one.

    The order is pseudorandom but fixed by the values: first a slice number hashed
    from ``order``, then ``order`` itself. ``rows`` (the rows of ``df``) sets the
    number of slices, so that a group of any size is dealt over slices of about
    ``SLICE_ROWS`` rows. Every slice is summed by itself and the sums of the slices
    before it are added. Rows alike in all of ``order`` share a slice and may be
    exchanged with each other. ``df`` is read twice and should be a stored table.
    """
    keys = list(keys)
    slices = max(1, -(-rows // SLICE_ROWS))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(F.lit("slice"), *order), F.lit(slices)).cast("int"))
    parts = cut.groupBy(*keys, "_slice").agg(*[F.sum(e).alias(f"_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    inside = (
        Window.partitionBy(*[F.col(f"a.{k}") for k in keys], F.col("a._slice"))
        .orderBy(*[F.col(f"a.{o}") for o in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    values = cut.withColumns({f"_v_{n}": e for n, e in sums.items()})
    joined = values.alias("a").join(parts.alias("b"), same("a", "b", [*keys, "_slice"]))
    return joined.select(
        *[F.col(f"a.{c}") for c in df.columns],
        *[
            (F.col(f"b._{n}") + F.coalesce(F.sum(F.col(f"a._v_{n}")).over(inside), F.lit(0))).alias(n)
            for n in sums
        ],
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest id reachable from every id that has an edge: columns ``id``, ``component``.

    ``edges`` has the columns ``a`` and ``b``. Large-star and small-star steps in
    turn: every id is linked to the smallest id it knows, until each is linked to its
    component's smallest id. Each round is a written table, so a lost executor
    repeats one round only. No group is collected: minima are aggregated map-side and joined
    back, and a hub with many edges is split by the skew join.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = stored(canonical(edges))
    seen = state(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        least = least.withColumn("m", F.least("k", "m"))
        # large star: the larger neighbours of every id go to the smallest id it knows
        large = both.join(least, F.col("a") == F.col("k")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = canonical(large)
        # small star: the smaller neighbours of every id, and itself, go to the smallest of them
        small = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        linked = large.join(small, F.col("a") == F.col("k"))
        after = canonical(
            linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b")))
        )
        now = stored(after)
        found = state(now)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
