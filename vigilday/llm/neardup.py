"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one node. Every node keeps a list of its nearest nodes. The lists start from
small cells of random hyperplanes and are refined round by round: the nodes that name a node, or that it names,
are compared with each other, and better neighbours enter their lists. Entries that are new take
part in the next round, until few lists change. A full list whose last entry is still a link is saturated: its
component is compared in blocks, within itself and with the other such components of the label that the angles between
block centers leave in reach, and kept as counts. Links found are measured against brute force for some nodes of each kind, and longer lists, more cells and rounds
follow if a node misses too many on average; if that doesn't help, all pairs of a label are compared. Every link counted or joined has been checked in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilday.functions.storage import stored
from vigilday.llm import vectors as vec
from vigilday.llm.common import components, table
from vigilday.llm.registry import query

THRESHOLD = 0.93
LIST = 10
CELLS = 4
CELL = 128
GROUP = 64
ROUNDS = 8
SETTLED = 0.002
SEED = 1
AUDIT = 256
RECALL = 0.99
# searches, each with lists twice as long, before all pairs of a label are compared
ATTEMPTS = 3
# unit vectors travel in half precision; an entry this far below the threshold may be a link
SLACK = 0.004

ENTRIES = "a long, bs array<long>, sims array<float>"


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _entries(a: list, bs: list, sims: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(bs, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32()))],
        names=["a", "bs", "sims"],
    )


def _in_cells(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The nearest nodes of each node within its cell."""
    for batch in batches:
        a, bs, sims = [], [], []
        for row in batch.column("members"):
            members = row.as_py()
            ids = np.array([m["node"] for m in members])
            x = np.frombuffer(b"".join(m["unit"] for m in members), "<f2").reshape(len(ids), -1).astype(np.float32)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            k = min(size, len(ids) - 1)
            if k < 1:
                continue
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            a += ids.tolist()
            bs += list(ids[best])
            sims += list(np.take_along_axis(s, best, 1))
        yield _entries(a, bs, sims)


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the nodes around a node; a pair comes out if one is new here and it improves a list."""
    for batch in batches:
        a, bs, sims = [], [], []
        for row in batch.column("members"):
            members = row.as_py()
            ids = np.array([m["node"] for m in members])
            last = np.array([m["last"] for m in members], np.float32)
            new = np.array([m["fresh"] for m in members])
            x = np.frombuffer(b"".join(m["unit"] for m in members), "<f2").reshape(len(ids), -1).astype(np.float32)
            s = x @ x.T
            good = (s > last[:, None]) & (new[:, None] | new) & (ids[:, None] != ids)
            for i in np.flatnonzero(good.any(1)):
                a.append(ids[i])
                bs.append(ids[good[i]])
                sims.append(s[i][good[i]])
        yield _entries(a, bs, sims)


def _update(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The best entries of the old list and of what was found: node, list, similarities, which are new."""
    for batch in batches:
        a, bs, sims, fresh = [], [], [], []
        for node, lists in zip(batch.column("a").to_pylist(), batch.column("lists")):
            lists = lists.as_py()
            b = np.concatenate([np.array(x["bs"], np.int64) for x in lists])
            s = np.concatenate([np.array(x["sims"], np.float32) for x in lists])
            known = np.concatenate([np.full(len(x["bs"]), x["old"]) for x in lists])
            order = np.lexsort((~known, b))
            b, s, known = b[order], s[order], known[order]
            first = np.r_[True, b[1:] != b[:-1]]
            b, s, known = b[first], s[first], known[first]
            order = np.lexsort((b, -s))[:size]
            a.append(node)
            bs.append(b[order])
            sims.append(s[order])
            fresh.append(~known[order])
        out = _entries(a, bs, sims)
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(fresh, pa.list_(pa.bool_()))], names=["a", "bs", "sims", "fresh"])


def _merge(lists: DataFrame, size: int) -> DataFrame:
    grouped = lists.groupBy("a").agg(F.collect_list(F.struct("bs", "sims", "old")).alias("lists"))
    return stored(grouped.mapInArrow(lambda b: _update(b, size), ENTRIES + ", fresh array<boolean>"))


def start(nodes: DataFrame, dim: int, labels: int, count: int, seed: int, size: int) -> DataFrame:
    """First lists: the nearest nodes of the same label and side of some random hyperplanes, several times.

    A cell that is larger than meant (nodes that are all alike) is cut into blocks by a hash.
    """
    bits = max(0, ceil(log2(max(1, count / (labels * CELL)))))
    lines = np.random.default_rng(seed).standard_normal((CELLS, bits, dim))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("unit").to_pylist()), "<f2").reshape(-1, dim).astype(np.float64)
            for t in range(CELLS):
                cell = ((x @ lines[t].T > 0) << np.arange(bits)).sum(1) * CELLS + t
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), pa.array(cell, pa.int64()), batch.column("node"), batch.column("unit")],
                    names=["label", "cell", "node", "unit"],
                )

    dealt = stored(
        nodes.select("label", "node", "unit").mapInArrow(cells, f"label {nodes.schema['label'].dataType.simpleString()}, cell long, node long, unit binary")
    )
    counts = dealt.groupBy("label", "cell").agg(F.ceil(F.count("*") / (4 * CELL)).alias("blocks"))
    blocks = (
        dealt.join(counts, ["label", "cell"])
        .groupBy("label", "cell", F.pmod(F.xxhash64(F.lit(seed), "node"), "blocks").alias("block"))
        .agg(F.collect_list(F.struct("node", "unit")).alias("members"))
    )
    found = blocks.select("members").mapInArrow(lambda b: _in_cells(b, size), ENTRIES)
    return found.withColumn("old", F.lit(False))


def descend(nodes: DataFrame, first: DataFrame, count: int, size: int, rounds: int) -> DataFrame:
    """Lists (a, bs, sims, fresh) after rounds of local joins, until fewer than ``SETTLED`` of all entries change.

    A node that many others name is compared with them in groups of ``GROUP``, in the order of similarity.
    """
    lists = _merge(first, size)
    for _ in range(rounds):
        changed = lists.agg(F.sum(F.size(F.filter("fresh", lambda f: f)))).first()[0] or 0
        if changed <= SETTLED * count * size:
            break
        edges = lists.select("a", F.explode(F.arrays_zip("bs", "sims", "fresh")).alias("e")).select(
            "a", F.col("e.bs").alias("b"), F.col("e.sims").alias("sim"), F.col("e.fresh").alias("fresh")
        )
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "fresh"))
        around = both.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
        nearest = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
        grouped = around.withColumn("group", F.floor((F.row_number().over(nearest) - 1) / GROUP))
        # a list that is not full lets everything in
        last = lists.select(F.col("a").alias("node"), F.when(F.size("sims") >= size, F.array_min("sims")).otherwise(F.lit(-2.0)).cast("float").alias("last"))
        known = nodes.select("node", "unit").join(last, "node", "left").withColumn("last", F.coalesce("last", F.lit(-2.0).cast("float")))
        groups = (
            grouped.join(known, grouped.b == known.node)
            .groupBy("a", "group")
            .agg(F.collect_list(F.struct("node", "last", "fresh", "unit")).alias("members"), F.max("fresh").alias("any"))
            .filter("any")
        )
        found = groups.select("members").mapInArrow(_local_join, ENTRIES).withColumn("old", F.lit(False))
        lists = _merge(lists.select("a", "bs", "sims", F.lit(True).alias("old")).unionByName(found), size)
    return lists


def _bridges(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> set[tuple[int, int]]:
    """Few pairs of the groups ``left`` (of the rows) and ``right`` (of the columns) that connect all that the links connect."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return set()
    left, right = left[rows], right[cols]
    if (left == left[0]).all() and (right == left[0]).all():
        return set()
    part = linked[np.ix_(rows, cols)]
    far = np.iinfo(np.int64).max
    low = left.copy()
    while True:  # the smallest group spreads along the links
        high = np.minimum(right, np.where(part, low[:, None], far).min(0))
        after = np.minimum(low, np.where(part, high, far).min(1))
        if (after == low).all():
            break
        low = after
    return {(g, t) for g, t in zip(np.r_[left, right].tolist(), np.r_[low, high].tolist()) if g != t}


def _counts(batches: Iterator[pa.RecordBatch], dim: int, dtype: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """Vectors linked with each node of one block in another (node, links, null), and groups they connect (group, 0, group)."""
    for batch in batches:
        for row in range(batch.num_rows):
            same_block = batch.column("same")[row].as_py()
            left, right = ([p for p in batch.column(c)[row].as_py()] for c in ("left", "right"))
            a, x = vec.unpack(left, dim, dtype)
            b, y = vec.unpack(right, dim, dtype)
            weights, groups = ([np.frombuffer(b"".join(p[c] for p in side), "<i8") for side in (left, right)] for c in ("copies", "grps"))
            linked = _units(x) @ _units(y).T >= threshold
            linked &= a[:, None] != b
            out = [(a, linked @ weights[1])]
            if not same_block:
                out.append((b, linked.T @ weights[0]))
            bridges = sorted(_bridges(linked, *groups))
            ids = np.concatenate([i for i, _ in out] + [np.array([g for g, _ in bridges], np.int64)])
            n = np.concatenate([n for _, n in out] + [np.zeros(len(bridges), np.int64)]).astype(np.int64)
            other = [None] * (len(ids) - len(bridges)) + [t for _, t in bridges]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(other, pa.int64())], names=["node", "links", "other"])


def _centers(batches: Iterator[pa.RecordBatch], dim: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Add the mean direction of each block, and the largest angle of a vector of the block with it."""
    for batch in batches:
        centers, angles = [], []
        for parts in batch.column("parts"):
            x = _units(vec.unpack(parts.as_py(), dim, dtype)[1])
            mean = x.sum(0)
            length = np.sqrt((mean * mean).sum())
            center = mean / length if length > 1e-6 else x[0]
            centers.append(center)
            angles.append(float(np.arccos(np.clip((x @ center).min(), -1, 1))))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(centers, pa.list_(pa.float64())), pa.array(angles, pa.float64())],
            names=[*batch.schema.names, "center", "angle"],
        )


def _reaching(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """Parts that blocks connect whose vectors may be within ``reach`` of each other."""
    for batch in batches:
        for row in range(batch.num_rows):
            sides = [batch.column(c)[row].as_py() for c in ("left", "right")]
            x, y = (np.array([m["center"] for m in side]) for side in sides)
            r, t = (np.array([m["angle"] for m in side]) for side in sides)
            near = np.arccos(np.clip(x @ y.T, -1, 1)) <= reach + r[:, None] + t + 1e-6
            found = sorted(_bridges(near, *(np.array([m["part"] for m in side], np.int64) for side in sides)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["a", "b"]
            )


def clusters(blocks: DataFrame, reach: float, size: int = 1024) -> DataFrame:
    """(part, cluster): parts of a label between which there may be links, by the angles of their blocks' centers."""
    sizes = blocks.groupBy("label").agg(F.ceil(F.count("*") / size).alias("chunks"))
    chunks = stored(
        blocks.join(sizes, "label")
        .groupBy("label", "chunks", F.pmod(F.xxhash64("part", "block"), "chunks").alias("chunk"))
        .agg(F.collect_list(F.struct("part", "center", "angle")).alias("members"))
    )
    # every pair of chunks is a key of its own
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    sides = [
        chunks.withColumn("with", met).filter(keep).select("label", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), F.col("members").alias(name))
        for name, keep in (("left", F.col("chunk") <= F.col("with")), ("right", F.col("chunk") >= F.col("with")))
    ]
    pairs = sides[0].join(sides[1], ["label", "low", "high"]).select("left", "right")
    near = stored(pairs.mapInArrow(lambda b: _reaching(b, reach), "a long, b long").distinct())
    parts = blocks.select("part").distinct()
    return parts.join(components(near), F.col("part") == F.col("id"), "left").select("part", F.coalesce("component", "part").alias("cluster"))


def dense_counts(
    nodes: DataFrame, groups: DataFrame, dim: int, dtype: str, threshold: float, block: int = 1024
) -> tuple[DataFrame, DataFrame]:
    """(node, links), the vectors of its label linked with each node, and (a, b), groups that links connect.

    ``groups`` has the rows (node, part, grp) of the nodes compared. The nodes of a part are cut into blocks. Two blocks of a label meet
    once, within a part and across parts, unless the angle between their centers and the angles within them rule out any link;
    no pair leaves a task, only a count per node and block.
    """
    rows = nodes.join(groups, "node").select("label", "part", "grp", "node", "copies", "vector")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vec.matrix(batch.column("vector"), dim, dtype)
            number = lambda c: pa.array([int(i).to_bytes(8, "little", signed=True) for i in batch.column(c).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("part"), number("node"), number("copies"), number("grp"), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["label", "part", "ids", "copies", "grps", "vecs"],
            )

    kind = nodes.schema["label"].dataType.simpleString()
    packed = stored(rows.mapInArrow(pack, f"label {kind}, part long, ids binary, copies binary, grps binary, vecs binary"))
    sizes = packed.groupBy("label", "part").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = (
        packed.join(sizes, ["label", "part"])
        .groupBy("label", "part", F.pmod(F.xxhash64("ids"), "blocks").alias("block"))
        .agg(F.collect_list(F.struct("ids", "copies", "grps", "vecs")).alias("parts"))
    )
    dealt = stored(dealt.mapInArrow(
        lambda b: _centers(b, dim, dtype), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in dealt.schema)}, center array<double>, angle double"
    ))
    reach = float(np.arccos(threshold))
    held = dealt.join(clusters(dealt.select("label", "part", "block", "center", "angle"), reach), "part")
    l, r = held.alias("l"), held.alias("r")
    together = (F.col("l.label") == F.col("r.label")) & (F.col("l.cluster") == F.col("r.cluster"))
    once = F.struct("l.part", "l.block") <= F.struct("r.part", "r.block")
    same = (F.col("l.part") == F.col("r.part")) & (F.col("l.block") == F.col("r.block"))
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec.product(F.col("l.center"), F.col("r.center")))))
    near = between <= F.col("l.angle") + F.col("r.angle") + F.lit(reach + 1e-6)
    pairs = l.join(r, together & once & (same | near)).select(same.alias("same"), F.col("l.parts").alias("left"), F.col("r.parts").alias("right"))
    found = stored(pairs.mapInArrow(lambda b: _counts(b, dim, dtype, threshold), "node long, links long, other long"))
    counts = found.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    return counts, found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def verified(nodes: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of the lists whose cosine in double precision reaches the threshold."""
    pairs = lists.select("a", F.explode(F.arrays_zip("bs", "sims")).alias("e")).filter(F.col("e.sims") >= threshold - SLACK)
    pairs = pairs.select(F.least("a", "e.bs").alias("a"), F.greatest("a", "e.bs").alias("b")).distinct()
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("vector").alias(f"v{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    norm = lambda v: F.sqrt(vec.product(F.col(v), F.col(v)))
    return both.filter(vec.product(F.col("va"), F.col("vb")) / (norm("va") * norm("vb")) >= threshold).select("a", "b")


def linked(
    nodes: DataFrame, lists: DataFrame, dim: int, dtype: str, threshold: float, size: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, links) and (id, component) for the nodes that have links, and the nodes that were counted in blocks.

    Links of the components with a saturated list are counted exactly, also those between such components, which no list may hold.
    """
    edges = stored(verified(nodes, lists, threshold))
    groups = stored(components(edges))
    full = lists.filter((F.size("sims") >= size) & (F.array_min("sims") >= threshold - SLACK)).select(F.col("a").alias("id"))
    # a full node without a verified link (its list lies within SLACK) is a component of its own
    alone = full.join(groups, "id", "left_anti").select("id", F.col("id").alias("component"))
    placed = groups.unionByName(alone)
    dense = stored(
        placed.join(full, "id").select("component").distinct().join(placed, "component").select(F.col("id").alias("node"), "component")
    )
    exact, bridges = dense_counts(nodes, dense.select("node", F.col("component").alias("part"), F.col("component").alias("grp")), dim, dtype, threshold)
    bridges = stored(bridges)
    if not bridges.isEmpty():
        joined = components(bridges).toDF("old", "new")
        groups = stored(
            placed.join(joined, placed.component == joined.old, "left").select("id", F.coalesce("new", "component").alias("component"))
        )
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    sparse = both.join(dense, "node", "left_anti")
    weights = nodes.select(F.col("node").alias("other"), "copies")
    found = sparse.join(weights, "other").groupBy("node").agg(F.sum("copies").alias("links"))
    return stored(found.unionByName(exact.filter("links > 0"))), groups, dense


def audit(nodes: DataFrame, counts: DataFrame, dense: DataFrame, dim: int, dtype: str, threshold: float, size: int = AUDIT) -> float:
    """Mean share of a node's links found, by brute force for some nodes; the worse of dense and other nodes.

    Up to ``size`` nodes are drawn from each of three strata: the nodes of ``dense``, others with links found, and others without any. The last two
    are weighed by their number of nodes, so that nodes all of whose links were missed count as much as there are of them.
    """
    strata = stored(
        nodes.select("node", "label", "vector")
        .join(dense.select("node", F.lit(0).alias("d")), "node", "left")
        .join(counts.select("node", "links"), "node", "left")
        .withColumn("stratum", F.coalesce("d", F.when(F.col("links") > 0, 1).otherwise(2)))
        .select("node", "label", "vector", "links", "stratum")
    )
    weights = {r["stratum"]: r["count"] for r in strata.groupBy("stratum").count().collect()}
    by_hash = F.xxhash64(F.lit(SEED), "node")
    rows = [r for i in sorted(weights) for r in strata.filter(F.col("stratum") == i).orderBy(by_hash, "node").limit(size).collect()]
    ids, units = np.array([r["node"] for r in rows]), _units(np.array([r["vector"] for r in rows]))
    order = {x: i for i, x in enumerate({r["label"] for r in rows})}
    labels = np.array([order[r["label"]] for r in rows])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = units @ _units(vec.matrix(batch.column("vector"), dim, dtype)).T >= threshold
            close &= labels[:, None] == np.array([order.get(x, -1) for x in batch.column("label").to_pylist()])
            close &= ids[:, None] != batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(close @ batch.column("copies").to_numpy(), pa.int64())], names=["node", "true"]
            )

    truth = nodes.select("node", "label", "copies", "vector").mapInArrow(scan, "node long, true long")
    true = {r["node"]: r["true"] for r in truth.groupBy("node").agg(F.sum("true").alias("true")).collect()}  # the sample

    def recall(chosen: tuple[int, ...]) -> float:
        found = asked = 0.0
        for i in chosen:
            of = [r for r in rows if r["stratum"] == i and true[r["node"]]]
            each = weights.get(i, 0) / max(1, sum(r["stratum"] == i for r in rows))
            asked += each * len(of)
            found += each * sum(min(1.0, (r["links"] or 0) / true[r["node"]]) for r in of)
        return found / asked if asked else 1.0

    return min(recall((0,)), recall((1, 2)))


def every_pair(nodes: DataFrame, dim: int, dtype: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (id, component) for the nodes that have links, from all blocks of a label: exact, and quadratic in a label's nodes."""
    counts, edges = dense_counts(nodes, nodes.select("node", F.xxhash64("label").alias("part"), F.col("node").alias("grp")), dim, dtype, threshold)
    return stored(counts.filter("links > 0")), stored(components(edges))


def near_duplicates(
    df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    size: int = LIST,
) -> DataFrame:
    """One row per row of ``df``: id, ``n_links``, ``component_id``, ``kept``.

    Rows link if their labels are equal and not null and the cosine of their vectors reaches the threshold. Vectors that are null,
    zero, of another length than most, or hold null or non-finite components link with nothing, nor do
    rows with a null label or id; they are components of their own, and kept. ``n_links`` counts the other rows linked directly, copies
    included. Rows that repeat an id are rows of their own. An empty table gives an empty result; other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    able = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & vec.usable(F.col("vector")))
    dim, dtype = vec.usual_length(able, "vector"), vec.dtype_of(able, "vector")
    able = able.filter(F.size("vector") == dim)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(vec.matrix(batch.column("vector"), dim, dtype)).astype("<f2")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v.tobytes() for v in x], pa.binary())], names=[*batch.schema.names, "unit"])

    classes = stored(able.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    # a node is named by its smallest id, or by a number where rows of one id have different vectors or labels
    found = classes.agg(F.count("*"), F.count_distinct("least")).first()
    classes = classes.withColumn("node", F.col("least").cast("long") if found[0] == found[1] else F.monotonically_increasing_id())
    kind = able.schema
    nodes = stored(classes.select("label", "vector", "node", "least", "copies").mapInArrow(
        unit, f"label {kind['label'].dataType.simpleString()}, vector {kind['vector'].dataType.simpleString()}, node long, least {kind['id'].dataType.simpleString()}, copies long, unit binary"
    ))
    count, labels = nodes.agg(F.count("*"), F.count_distinct("label")).first()
    if not count:  # no vector takes part
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    lists = descend(nodes, start(nodes, dim, labels, count, SEED, size), count, size, ROUNDS)
    for attempt in range(1, ATTEMPTS + 1):
        counts, groups, dense = linked(nodes, lists, dim, dtype, threshold, size)
        if audit(nodes, counts, dense, dim, dtype, threshold) >= RECALL:
            break
        if attempt == ATTEMPTS:
            counts, groups = every_pair(nodes, dim, dtype, threshold)
            break
        size *= 2
        more = start(nodes, dim, labels, count, SEED + attempt, size)
        lists = descend(nodes, lists.select("a", "bs", "sims", F.lit(True).alias("old")).unionByName(more), count, size, ROUNDS)
    grouped = nodes.join(groups, nodes.node == groups.id, "left").select(
        "node", "label", "vector", "least", "copies", F.coalesce("component", "node").alias("component")
    )
    if found[0] != found[1]:
        named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
        grouped = grouped.join(named, "component")
    else:
        grouped = grouped.withColumn("component_id", F.col("component"))
    placed = grouped.join(counts, "node", "left").select(
        "label", "vector",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("component_id").cast(kind["id"].dataType).alias("component_id"),
    )
    joined = rows.alias("r").join(placed.alias("p"), F.col("r.id").isNotNull() & (F.col("r.label") == F.col("p.label")) & (F.col("r.vector") == F.col("p.vector")), "left")
    own = F.coalesce("p.component_id", "r.id")
    return joined.select(
        F.col("r.id").alias(id_col),
        F.coalesce("p.n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        own.eqNullSafe(F.col("r.id")).alias("kept"),
    )


@query("op1_nn_descent_dedup")
def op1_nn_descent_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "embeddings"))
