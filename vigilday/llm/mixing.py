"""Mixing sources to target weights, block by block.

Every source's documents, in a hashed order, are one run of words cut into blocks of a fixed length (shorter in
a source too small for it, so that its target is a number of blocks too).
The mix is a row of output shards with a fixed number of slots. Each slot draws its source by
the targets, which gives every shard multinomial source counts; what a source was drawn
beyond its quota of blocks goes to the sources that were drawn too little, so that the mix as a whole meets the
targets. The i-th slot of a source takes the i-th block of a pseudorandom permutation of its
blocks; when all are used, the next permutation begins. The permutation is computed from the index, nothing is sorted, and
blocks are joined by their index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilday.functions.storage import stored
from vigilday.llm.common import SPACE, WORD, positions, same, table
from vigilday.llm.registry import query

SEED = 3
BLOCK = 64
SLOTS = 4096
# a target is this many blocks at least, unless a block is one word
TARGET_BLOCKS = 32
EPOCHS = 3
WEIGHTS = (5, 2, 1)
ROUNDS = 16
# pieces of the line of quotas by which a drawn number finds its source
PARTS = 4096


def words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(df: DataFrame, index: str, n: str, keys: list[str], seed: int, out: str) -> DataFrame:
    """Add ``out``: where a pseudorandom permutation of 0..n-1, one for each value of ``keys``, sends ``index``.

    Swap-or-not: in each round an index is paired with (k - index) mod n, and a hash of
    the larger of the two says whether they change places. That works for any n. Each round
    is a projection of its own, so that its values are computed once, in generated code.
    """
    df = df.withColumn(out, F.col(index).cast("long"))
    for r in range(ROUNDS):
        pair = F.pmod(F.xxhash64(F.lit(seed + r), *keys) - F.col(out), F.col(n))
        swap = F.xxhash64(F.lit(seed + r), *keys, F.greatest(out, "_pair")).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn("_pair", pair).withColumn(out, F.when(swap, F.col("_pair")).otherwise(F.col(out)))
    return df.drop("_pair")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Add ``sid`` (place in code point order, null last), ``target`` to rows (source, source_size, ...).

    Targets share the sum of all sizes by weight, the weights repeating in the order of the sources. No target exceeds
    ``epochs`` times its source; the excess is shared by weight among the others. In order of
    size by weight the sources that stop are the first ones, so the common level is found with running sums.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("sid", F.row_number().over(ordered))
    named = named.withColumn(
        "w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    ).withColumn("stop", F.lit(epochs) * F.col("source_size"))
    by_level = Window.orderBy(F.col("stop") / F.col("w"), "sid")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    here = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levelled = named.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("w").over(here),
    ).withColumn("at", F.row_number().over(by_level))
    open_ = F.when(F.col("level") * F.col("w") <= F.col("stop"), F.struct("at", "level"))
    first = levelled.withColumn("first", F.min(open_).over(everything))
    stopped = F.col("first").isNull() | (F.col("at") < F.col("first.at"))
    return first.withColumn(
        "target", F.when(stopped, F.col("stop").cast("double")).otherwise(F.col("w") * F.col("first.level"))
    ).drop("w", "stop", "level", "at", "first")


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, seed: int, slots: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in their source, slots with their block)."""
    spark = docs.sparkSession
    base = stored(docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col).isNull(), F.col(text_col)).alias("key"),
    ))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    unit = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.least("source_size", "target") / TARGET_BLOCKS))).cast("long")
    blocks = F.expr("(source_size + unit - 1) div unit")
    # a quota counts blocks of the source's mean length, so that a stopped source takes all of its blocks
    quota = F.least(F.col("blocks") * EPOCHS, F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long"))
    line = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = stored(
        targets(sizes)
        .withColumn("unit", unit)
        .withColumn("blocks", blocks)
        .withColumn("quota", quota)
        .withColumn("below", F.coalesce(F.sum("quota").over(line), F.lit(0)))
    )
    found = sources.agg(F.sum("quota"), F.sum("n_docs")).first()
    total, rows = found[0] or 0, found[1] or 0
    known = base.alias("d").join(sources.alias("s"), same("d", "s", ["source"])).select(
        "d.*", "s.sid", "s.source_size", "s.target", "s.unit"
    )
    placed = positions(stored(known), ["sid"], ["id", "key"], {"start": F.col("size")}, rows)

    # multinomial draws: every slot's number falls on the line of quotas
    width = max(1, -(-total // PARTS))
    parts = sources.filter("quota > 0").select(
        "sid", "below", "quota",
        F.explode(F.expr(f"sequence(below div {width}L, (below + quota - 1) div {width}L)")).alias("part"),
    )
    drawn = spark.range(total).select(
        F.expr(f"id div {slots}L").alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, total))).alias("at"),
    ).withColumn("part", F.expr(f"at div {width}L"))
    counts = (
        drawn.join(parts, "part")
        .filter("at >= below and at < below + quota")
        .groupBy("shard", "sid")
        .agg(F.count("*").alias("n"))
    )
    # a shard's draws are numbered within their source, the shards in a hashed order
    counts = stored(counts)
    counts = stored(
        positions(counts, ["sid"], ["shard"], {"before": F.col("n")}, counts.count())
        .join(sources.select("sid", "quota"), "sid")
        .withColumn("keep", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("before"))))
    )
    kept = counts.filter("keep > 0").select("shard", "sid", F.explode(F.expr("sequence(before, before + keep - 1)")).alias("ordinal"))
    # slots drawn beyond a quota, in turn, go to the blocks that are missing, in turn
    spare = stored(counts.filter("n > keep").select("shard", "sid", (F.col("n") - F.col("keep")).alias("spare")))
    spare = positions(spare, [], ["shard", "sid"], {"from": F.col("spare")}, spare.count()).select(
        "shard", F.explode(F.expr("sequence(from, from + spare - 1)")).alias("e")
    )
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = sources.join(got, "sid", "left").select(
        "sid", F.coalesce("got", F.lit(0)).alias("got"), (F.col("quota") - F.coalesce("got", F.lit(0))).alias("lack")
    ).filter("lack > 0")
    short = short.withColumn("from", F.coalesce(F.sum("lack").over(line), F.lit(0))).select(
        "sid", F.posexplode(F.expr("sequence(from, from + lack - 1)")).alias("i", "e"), "got"
    ).select("sid", (F.col("got") + F.col("i")).alias("ordinal"), "e")
    taken = kept.unionByName(spare.join(short, "e").select("shard", "sid", "ordinal"))
    taken = taken.join(sources.select("sid", "blocks"), "sid").select(
        "shard", "sid", "blocks", F.expr("ordinal div blocks").alias("epoch"), F.expr("ordinal % blocks").alias("index")
    )
    # stored: a filter pushed down through the rounds would repeat each of them in the next
    picks = stored(permuted(taken, "index", "blocks", ["sid", "epoch"], seed, "block").drop("blocks", "index"))
    return placed, picks


def shares(placed: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows (document, block): the words ``lo`` to ``hi`` of the document that lie in the block, and the ``epochs`` that draw it (bits)."""
    drawn = picks.groupBy("sid", "block").agg(F.sum(F.expr("1L << cast(epoch as int)")).alias("epochs"))
    cut = placed.filter("size > 0").withColumn(
        "block", F.explode(F.expr("sequence(start div unit, (start + size - 1) div unit)"))
    )
    return cut.join(drawn, ["sid", "block"], "left").withColumns({
        "epochs": F.coalesce("epochs", F.lit(0)),
        "lo": F.expr("greatest(0L, block * unit - start)"),
        "hi": F.expr("least(size, (block + 1) * unit - start)"),
    })


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
    seed: int = SEED,
    slots: int = SLOTS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` counts the words of the document in the mix, repeats included: at most three times
    its size, since every block occurs once per permutation. Texts that are null or hold no word have size 0 and are never
    taken; a null source is a source, the last one. Reruns give the same mix; rows alike in id and
    text may change places. An empty table gives an empty result. Other columns are neither read nor returned.
    """
    placed, picks = plan(docs, id_col, text_col, source_col, block, seed, slots)
    placed = stored(placed)
    names = ["id", "size", "source_size", "target", "sid", "start"]
    counted = shares(placed, picks).groupBy(*names).agg(
        F.sum((F.col("hi") - F.col("lo")) * F.bit_count("epochs")).alias("taken")
    )
    none = placed.filter("size = 0").select(*names, F.lit(0).cast("long").alias("taken"))
    return counted.unionByName(none).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def slots_of(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block: int = BLOCK, seed: int = SEED, slots: int = SLOTS,
) -> DataFrame:
    """The mix itself: rows (``shard``, ``sid``, ``epoch``, ``block``), one for each slot."""
    return plan(docs, id_col, text_col, source_col, block, seed, slots)[1]


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """``docs`` as the mix takes them: a row per document and permutation that draws any of it, its text the words drawn.

    A document drawn whole keeps its text as it is; of another, the words of its drawn blocks are joined by
    blanks in their order. Documents that are not drawn, and texts without words, drop out. All columns are kept; a column
    ``n_chars`` is set to the length of the new text.
    """
    placed, picks = plan(docs, id_col, text_col, source_col, block, seed, SLOTS)
    # rows alike in id and text are told apart by a number
    alike = Window.partitionBy("id", "key").orderBy(F.lit(0))
    numbered = placed.withColumn("copy", F.row_number().over(alike))
    drawn = (
        shares(stored(numbered), picks)
        .groupBy("id", "key", "copy", "size")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("epochs") > 0, F.struct("lo", "hi", "epochs")))).alias("parts"),
            F.bit_and("epochs").alias("whole"),
            F.bit_or("epochs").alias("some"),
        )
        .filter("some > 0")
    )
    text = F.col(f"row.{text_col}")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col).isNull(), F.col(text_col)).alias("key"),
        F.struct(*docs.columns).alias("row"),
    )
    rows = rows.withColumn("copy", F.row_number().over(alike))
    joined = rows.alias("r").join(drawn.alias("p"), same("r", "p", ["id", "key", "copy"])).select("r.row", "p.parts", "p.whole", "p.some")
    fanned = joined.withColumn("e", F.explode(F.filter(F.array(*[F.lit(e) for e in range(EPOCHS)]), lambda e: F.expr("some").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), e)) != 0)))
    bit = F.expr("1L << e")
    pieces = F.filter("parts", lambda p: p["epochs"].bitwiseAND(bit) != 0)
    own = F.split(F.regexp_replace(text, f"^{SPACE}", ""), SPACE)
    # the words are bound once, as the one item of an array: the text is split once, not for each of its pieces
    taken = lambda w: F.flatten(F.transform(pieces, lambda p: F.slice(w, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int"))))
    cut = F.array_join(F.get(F.transform(F.array(own), taken), F.lit(0)), " ")
    new = F.when(F.col("whole").bitwiseAND(bit) != 0, text).otherwise(cut)
    out = fanned.withColumn("new", new)
    return out.select(*[
        F.col("new").alias(c) if c == text_col
        else F.length("new").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.{c}").alias(c)
        for c in docs.columns
    ])


@query("op3_weighted_mix")
def op3_weighted_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))
