"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters the rows by a seeded hash into buckets that fit a task's memory. Pass two draws a
Fisher-Yates permutation of every bucket. The buckets one after the other are the
shuffled corpus, and each shard is one run of it; a row's place follows from the rows of
the buckets before its own, so no global sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilday.functions.storage import stored
from vigilday.llm.common import table
from vigilday.llm.registry import query

SHARDS = 40
SEED = 20
BUCKET_BYTES = 32 << 20
# a bucket this many times larger than meant holds repeated rows and is split further
OVERSIZE = 4
ROW_BYTES = 16


def text_bytes(text: Column) -> Column:
    """Size of a row in the law: UTF-8 bytes of its text, and 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def shuffled_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard), in random order.

    Row counts of shards differ by one at most. The order is fixed by the seed and the values: the bucket is hashed from
    id and text, each bucket is sorted before it is permuted, and the permutation depends on the
    bucket's place alone. Rows alike in id and text would all meet in one bucket; such a bucket is split by
    the rows' place in the input. Null ids and texts are values like others. An empty table gives an
    empty result. All columns are kept (they must be of types that can be ordered); columns named
    like the two new ones are replaced. The result is a written table: the permutation is drawn once.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    size = text_bytes(F.col(text_col))
    total = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size")).first()
    buckets = max(4 * shards, -(-total["size"] // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    marked = docs.select(
        F.pmod(key, F.lit(buckets)).alias("_bucket"),
        key.alias("_key"),
        size.alias("_size"),
        F.struct(*names).alias("_row"),
    )
    measured = stored(marked.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("_size").alias("size")))
    large = measured.filter((F.col("size") > OVERSIZE * bucket_bytes) & (F.col("n") > 1))
    if not large.isEmpty():
        parts = F.ceil(F.col("size") / bucket_bytes).cast("long")
        place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
        part = F.coalesce(F.pmod("_place", F.col("_parts")), F.lit(0).cast("long"))
        marked = (
            marked.withColumn("_place", place)
            .join(large.select("_bucket", parts.alias("_parts")), "_bucket", "left")
            .withColumn("_bucket", F.col("_bucket") + part * buckets)
            .drop("_place", "_parts")
        )
        measured = stored(marked.groupBy("_bucket").agg(F.count("*").alias("n")))
    # one row per bucket: a running sum over buckets, not over rows
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = measured.select("_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    tasks = max(1, -(-buckets // 4))
    permuted = (
        marked.repartition(tasks, "_bucket")
        .groupBy("_bucket")
        .agg(F.sort_array(F.collect_list(F.struct("_key", "_row"))).alias("_rows"))
        .join(offsets, "_bucket")
        .sortWithinPartitions("_bucket")
        .select("_before", F.shuffle("_rows", seed).alias("_rows"))
        .select("_before", F.posexplode("_rows").alias("_pos", "_item"))
    )
    n = max(1, total["n"])
    position = F.col("_before") + F.col("_pos")
    shard = f"(_before + _pos) * {shards}L div {n}L"
    first = F.expr(f"(({shard}) * {n}L + {shards - 1}L) div {shards}L")
    return stored(
        permuted.select(
            *[F.col("_item._row").getField(c).alias(c) for c in names],
            F.expr(shard).cast("int").alias("shard"),
            (position - first).cast("long").alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard as a folder ``shard=<k>`` of Parquet files, every file in the order of slots."""
    sharded.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


@query("op10_two_pass_shuffle")
def op10_two_pass_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return shuffled_shards(table(spark, sf, "documents")).select(
        "doc_id",
        text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
