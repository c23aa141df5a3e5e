"""A trie of conversation prefixes, all depths grouped together by ROLLUP.

The turns of a conversation are cut into blocks of ``WIDTH``. A row per block holds the ids of its turns
in one column each, and the key of the node that the blocks before it lead to. GROUP BY that key and ROLLUP over
the columns groups every prefix of every block in one aggregation; grouping_id tells how many columns a group has
kept. So no block waits for another, and a conversation of any length needs no more columns.

A node's key is the hash of the prior block's node key and the ids within the block; the keys at the ends
of blocks are found while the sorted turns stream by. Each node is owned by its smallest member, and
a conversation owns the nodes of its path from some depth on. Sums over subtrees follow from this without walking
the tree: they are the owned totals of the node's members (a second ROLLUP) less what its owner has above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilday.functions.storage import stored
from vigilday.llm.common import table
from vigilday.llm.registry import query

WIDTH = 8
# a slice of the ids that end at a node covers this many consecutive ids
SLICE_IDS = 1024
# Fixed value: the key of the root.
ROOT = hashlib.sha256(b"").digest()
COLUMNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that tell (role, text) apart."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)


def key_of(prior: Column, ids: Column) -> Column:
    """The key of the node that the turn ids ``ids`` (joined) lead to from the node ``prior``; no ids: ``prior`` itself."""
    return F.when(F.length(ids) == 0, prior).otherwise(F.unhex(F.sha2(F.concat(prior, ids), 256)))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the key of the node before the block to turns that come by conversation and place.

    One hash is carried on from turn to turn, also across batches, so memory does not grow with a conversation.
    """
    own, prior, block, inside = None, ROOT, 0, []
    for batch in batches:
        priors = []
        convs, places, tids = (batch.column(c).to_pylist() for c in ("conv", "place", "tid"))
        for conv, place, tid in zip(convs, places, tids):
            if conv != own:
                own, prior, block, inside = conv, ROOT, 0, []
            elif place // WIDTH != block:
                prior = hashlib.sha256(prior + b"".join(inside)).digest()
                block, inside = place // WIDTH, []
            inside.append(tid)
            priors.append(prior)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(priors, pa.binary())], names=[*batch.schema.names, "prior"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined parts of each key; parts come by key and slice and stream through one hash."""
    own, state = None, None
    for batch in batches:
        keys, found = [], []
        for key, part in zip(batch.column("key"), batch.column("part")):
            key, part = key.as_py(), part.as_py().encode()
            if key != own:
                if own is not None:
                    keys.append(own)
                    found.append(state.hexdigest())
                own, state = key, hashlib.sha256(part)
            else:
                state.update(b"," + part)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
    if own is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([own], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"]
        )


def turn_ids(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, place from 0, tid, chars) of the turns of conversations with an id, in their order."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        # equal turns are told apart by nothing, others by role and text
        F.sha2(role, 256).alias("by_role"),
        turn_id(role, text).alias("tid"),
        F.length(text).cast("long").alias("chars"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "by_role", "tid")
    return cut.select("conv", (F.row_number().over(order) - 1).alias("place"), "tid", "chars")


def rollup_sql(measures: str) -> str:
    """One aggregation over all prefixes of all blocks of ``{blocks}``; ``level`` is the number of columns kept."""
    level = " ".join(f"WHEN {(1 << (WIDTH - i)) - 1} THEN {i}" for i in range(WIDTH + 1))
    last = " ".join(f"WHEN {i} THEN {c} IS NOT NULL" for i, c in enumerate(COLUMNS, 1))
    joined = f"concat({', '.join(f'coalesce({c}, X{chr(39)}{chr(39)})' for c in COLUMNS)})"
    return f"""
    SELECT block, prior, level, {joined} AS ids, * EXCEPT (block, prior, level, {', '.join(COLUMNS)})
    FROM (
      SELECT block, prior, {', '.join(COLUMNS)}, CASE grouping_id() {level} END AS level, {measures}
      FROM {{blocks}} GROUP BY block, prior, ROLLUP ({', '.join(COLUMNS)})
    )
    WHERE CASE level WHEN 0 THEN block = 0 {last} END
    """


def prefix_trie(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    convs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of all conversations' prefixes, and the node at which each conversation ends.

    Nodes: ``key``, ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_chars`` (over its subtree, the members beyond the first times the code points of a node's last text). Ends: ``key``, ``conv``.

    Turns stand in the order of the turn number (null first), those with equal numbers, repeated rows too, by role
    and text (in the order of their hashes); a null role or text is empty. Rows without a conversation id belong to no
    conversation and are left out. ``convs`` (one column ``conv``, distinct) may name conversations without turns; they are members of the
    root. An empty table gives an empty result; other columns are not read. No conversation and no
    node's members are collected; a conversation's turns are sorted and streamed in one task.
    """
    told = turn_ids(turns, conv_col, turn_col, role_col, text_col)
    return build(told, told.select("conv").distinct() if convs is None else convs)


def build(told: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of turns (conv, place, tid, chars); ``convs`` lists all conversations."""
    spark = told.sparkSession
    told = stored(told)
    schema = "conv long, place int, tid binary, prior binary"
    chained = (
        told.select("conv", F.col("place").cast("int").alias("place"), "tid")
        .repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(_chain, schema)
    )
    block = F.floor(F.col("place") / WIDTH).cast("int")
    here = F.col("place") % WIDTH
    rows = chained.groupBy("conv", block.alias("block"), "prior").agg(
        *[F.max(F.when(here == i, F.col("tid"))).alias(c) for i, c in enumerate(COLUMNS)]
    )
    silent = convs.join(told.select("conv").distinct(), "conv", "left_anti").select(
        "conv", F.lit(0).alias("block"), F.lit(ROOT).alias("prior"), *[F.lit(None).cast("binary").alias(c) for c in COLUMNS]
    )
    blocks = stored(rows.unionByName(silent))

    first = spark.sql(rollup_sql("min(conv) AS conv_id, count(*) AS n_convs"), blocks=blocks)
    keyed = first.select(
        (F.col("block") * WIDTH + F.col("level")).alias("depth"),
        key_of(F.col("prior"), F.col("ids")).alias("key"),
        # without its last id, or for the root nothing
        F.when(F.col("level") > 0, key_of(F.col("prior"), F.expr(f"substring(ids, 1, 16 * (level - 1))"))).alias("parent"),
        "conv_id",
        "n_convs",
    )
    nodes = stored(keyed)
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    sizes = told.select(F.col("conv").alias("conv_id"), (F.col("place") + 1).alias("depth"), "chars")
    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    owned = (
        nodes.join(children, "key", "left")
        .join(sizes, ["conv_id", "depth"], "left")
        .withColumns({
            "n_children": F.coalesce("n_children", F.lit(0)),
            "leaf": F.when(F.col("n_children").isNull(), 1).otherwise(0),
            "saved": (F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0)),
        })
        .withColumns({
            "leaves_above": F.coalesce(F.sum("leaf").over(above), F.lit(0)),
            "saved_above": F.coalesce(F.sum("saved").over(above), F.lit(0)),
            # the owner of the node above: the same, but for the first node that a conversation owns
            "top": F.row_number().over(Window.partitionBy("conv_id").orderBy("depth")) == 1,
        })
    )
    owned = stored(owned)
    totals = owned.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    weighed = blocks.join(totals, "conv", "left").fillna(0, ["leaves", "saved"])
    second = spark.sql(rollup_sql("sum(leaves) AS leaves_in, sum(saved) AS saved_in"), blocks=weighed)
    within = second.select(key_of(F.col("prior"), F.col("ids")).alias("key"), "leaves_in", "saved_in")
    parents = (
        owned.filter("top AND parent IS NOT NULL").select("key", "parent").alias("c")
        .join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv")), "parent")
        .select("key", "parent_conv")
    )
    found = (
        owned.join(within, "key")
        .join(parents, "key", "left")
        .select(
            "key",
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            F.when(F.col("parent").isNotNull(), F.coalesce("parent_conv", "conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.col("n_children").cast("long").alias("n_children"),
            (F.col("leaves_in") - F.col("leaves_above")).alias("n_leaves"),
            (F.col("saved_in") - F.col("saved_above")).alias("saved_chars"),
        )
    )
    last = blocks.groupBy("conv").agg(F.max("block").alias("block"))
    held = F.concat(*[F.coalesce(F.col(c), F.lit(b"")) for c in COLUMNS])
    ends = blocks.join(last, ["conv", "block"]).select(key_of(F.col("prior"), held).alias("key"), "conv")
    return found, ends


def with_ends(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Add ``ends_sha256``: the hash of the ids of the conversations that end at a node, ascending and comma-joined.

    The ids are first joined by slices of consecutive ids, so a node at which very many conversations end is
    gathered in many tasks; its hash, which is defined over all of them in turn, then streams over the slices.
    """
    parts = ends.groupBy("key", F.floor(F.col("conv") / SLICE_IDS).alias("slice")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("part")
    )
    digests = (
        parts.repartition("key").sortWithinPartitions("key", "slice").select("key", "part")
        .mapInArrow(_digests, "key binary, ends_sha256 string")
    )
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))


def rebuilt(told: DataFrame) -> DataFrame:
    """Conversations c that begin with the first h turns of conversation c - c % 100, h = crc32(c as text) % 6.

    Then follow c's own turns after its first h. ``told``: (conv, place, tid, chars).
    """
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")
    convs = told.select("conv").distinct().withColumns({"h": h, "head": F.col("conv") - F.col("conv") % 100})
    heads = told.filter("conv % 100 = 0 AND place < 5").select(
        F.col("conv").alias("head"), F.col("place"), "tid", "chars"
    )
    # at most five turns of a head, each for at most 199 conversations (99 on both sides of 0)
    copied = convs.join(heads, "head").filter("place < h").select("conv", "place", "tid", "chars")
    lengths = copied.groupBy("conv").agg(F.count("*").cast("int").alias("n"))
    kept = (
        told.withColumn("h", h).filter("place >= h").join(lengths, "conv", "left")
        .select("conv", (F.col("place") - F.col("h") + F.coalesce("n", F.lit(0))).alias("place"), "tid", "chars")
    )
    return copied.unionByName(kept)


# crc32 of a number's decimal digits, bit by bit: DuckDB has no such function
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST({0} AS VARCHAR)) + 1), lambda i: ascii(CAST({0} AS VARCHAR)[i])::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
      lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

SQL = f"""
WITH placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(coalesce(role, '')),
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head, {_CRC.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM placed)
), paths AS (
  SELECT c.conv_id,
    coalesce((SELECT list({{'role': role, 'text': text}} ORDER BY place) FROM placed p WHERE p.conv_id = c.head AND place < h), [])
    || coalesce((SELECT list({{'role': role, 'text': text}} ORDER BY place) FROM placed p WHERE p.conv_id = c.conv_id AND place >= h), [])
    AS path
  FROM convs c
), prefixes AS (
  SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths
), nodes AS (
  SELECT path[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(path) = depth), '') AS ends,
    (count(*) - 1) * coalesce(length(any_value(path)[depth].text), 0) AS saved
  FROM prefixes GROUP BY 1, 2
), children AS (
  SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)
), sums AS (
  SELECT prefix[1:k] AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM counted) GROUP BY 1
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN sums USING (prefix) LEFT JOIN nodes p ON c.depth > 0 AND p.prefix = c.prefix[1:c.depth - 1]
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    told = stored(turn_ids(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text"))
    nodes, ends = build(rebuilt(told), told.select("conv").distinct())
    return with_ends(nodes, ends).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved_chars").alias("saved_tokens"), "ends_sha256",
    )
