"""Running sums and positions over an order, without putting a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilday.functions.storage import stored

MAX_GROUP = 2_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group (of the whole frame when ``keys`` is empty)."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    totals: bool = False,
    max_group: int = MAX_GROUP,
    slices: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add, per name in ``sums``, the sum over the group's rows up to this one.

    ``order`` must be total within a group. With ``totals`` the sum over the
    whole group is added as ``<name>_total``. When the largest group has at most
    ``max_group`` rows an ordinary window does it. Otherwise the frame is cut
    into slices by range of (keys, order), which splits a large group; the cut
    is stored, because a recomputed cut could fall elsewhere; each slice is
    summed by itself and the sums of the slices before it are added. ``largest``
    saves the count of the groups when it is known. Both ways agree on NULLs: a
    NULL key is a group, and a sum is NULL until its first value.
    """
    keys = list(keys)
    if (largest_group(df, keys) if largest is None else largest) <= max_group:
        group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = df.withColumns({name: F.sum(expr).over(upto) for name, expr in sums.items()})
        if totals:
            out = out.withColumns({f"{name}_total": F.sum(expr).over(group) for name, expr in sums.items()})
        return out

    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(
        df.repartitionByRange(slices, *[F.col(k) for k in keys], *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    parts = cut.groupBy(*keys, "_slice").agg(*[F.sum(e).alias(f"_{n}") for n, e in sums.items()])
    # only a group that goes on in the next slice needs the sums of its earlier
    # slices; a slice has at most one such group, so these rows are bounded by
    # the number of slices
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    known = {f"_{n}_before": F.sum(f"_{n}").over(before) for n in sums}
    known |= {f"_{n}_whole": F.sum(f"_{n}").over(group) for n in sums}
    spanning = (
        parts.withColumns({**known, "_slices": F.count(F.lit(1)).over(group)})
        .filter("_slices > 1")
        .select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_slice").alias("_in"), *known)
    )
    same = F.col("_slice") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    one = Window.partitionBy(*keys, "_slice")
    upto = one.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {n: F.sum(e).over(upto) for n, e in sums.items()}
    if totals:
        local |= {f"{n}_total": F.sum(e).over(one) for n, e in sums.items()}
    out = cut.withColumns(local).join(F.broadcast(spanning), same, "left")
    final = {
        n: F.coalesce(F.col(n) + F.coalesce(f"_{n}_before", F.lit(0)), F.col(f"_{n}_before")) for n in sums
    }
    if totals:
        final |= {f"{n}_total": F.coalesce(f"_{n}_whole", f"{n}_total") for n in sums}
    return out.withColumns(final).drop("_slice", "_in", *[f"_key_{k}" for k in keys], *known)


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "pos",
    totals: bool = False,
    max_group: int = MAX_GROUP,
    slices: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``."""
    return running_sums(df, keys, order, {name: F.lit(1)}, totals, max_group, slices, largest)


def top_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group with their rank.

    A small ``n`` is cut in every map task before the shuffle (Spark's window
    group limit), so a large group never travels whole. A large ``n`` is ranked
    by :func:`positions`.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n <= limit and keys:
        ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        ranked = positions(df, keys, order, rank).withColumn(rank, F.col(rank).cast("int"))
    return ranked.filter(F.col(rank) <= n)
