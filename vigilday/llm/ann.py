"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Vectors are scaled to the largest norm and get one component more, which makes all of them equally long; the
largest inner product is then the smallest distance. A table's bucket is given by Gaussian projections, each moved by a
random offset and cut into cells of one width, which is chosen from the distances of near neighbours in a sample. A query visits, in each table, its own and the perturbed buckets in
the order of the estimated chance that a near vector lies there, until the chances add up to a target.
Buckets are compared in blocks, and the candidates of all tables are ranked by their exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, e, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilday.functions.storage import stored
from vigilday.llm import vectors as vec
from vigilday.llm.common import table
from vigilday.llm.registry import query

TABLES = 2
# width of a cell in distances of near neighbours, and its bounds (a projection has a standard deviation of 1)
WIDTH, LEAST_WIDTH, MOST_WIDTH = 2.0, 0.75, 1.5
SPLIT = 2
SEED = 6
# buckets a query visits in a table at most, if their chances don't add up to the target before
PROBES = 4096
# chances of the buckets visited in each table; the next one is tried where recall falls short, and after the last all vectors are compared
TARGETS = (0.82, 0.93)
# vectors of a key over which all are dealt for that; each key gets a copy of the queries
SHARE = 50_000
RECALL = 0.93
AUDIT = 64
FLUSH = 50_000
# queries whose buckets are sought and packed together: a copy of the vector goes to each of up to PROBES buckets
PROBED = 64


class Tables:
    """Projections of all tables, and the buckets of vectors and of queries."""

    def __init__(self, dim: int, n: int, norm: float, near: float):
        self.dim, self.norm = dim, norm
        self.width = min(MOST_WIDTH, max(LEAST_WIDTH, WIDTH * sqrt(2 * (1 - near))))
        # about this many bits tell the cells of one projection apart; a table has about n ** (1 / SPLIT) buckets
        bits = log2(sqrt(2 * pi * e) / self.width)
        self.hashes = min(16, max(1, ceil(log2(max(2, n)) / SPLIT / bits)))
        rng = np.random.default_rng(SEED)
        self.lines = [rng.standard_normal((dim + 1, self.hashes)) for _ in range(TABLES)]
        self.offsets = [rng.uniform(0, self.width, self.hashes) for _ in range(TABLES)]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors as points of the unit sphere, in one dimension more."""
        x = x.astype(np.float64) / self.norm
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def key(self, t: int, cells: np.ndarray) -> np.ndarray:
        """Bucket number: the table, and 3 bits for each cell (cells beyond -4..3 are merged)."""
        digits = np.clip(cells, -4, 3).astype(np.int64) + 4
        return (digits << 3 * np.arange(self.hashes)).sum(-1) << 2 | t

    def buckets(self, t: int, x: np.ndarray) -> np.ndarray:
        return self.key(t, np.floor((self.lifted(x) @ self.lines[t] + self.offsets[t]) / self.width))

    def probes(self, t: int, q: np.ndarray, near: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of the query, bucket) of the likeliest buckets of each query.

        A vector at cosine ``near`` (one for each query) of the query is projected to a normal variable around ``near`` times the query's
        projection; a bucket's chance is the product over its cells. The best products are extended projection by
        projection; keeping the ``PROBES`` best is exact, as a good bucket has good beginnings.
        """
        unit = q / np.sqrt((q * q).sum(1, keepdims=True))
        center = near[:, None] * (np.hstack([unit, np.zeros((len(q), 1))]) @ self.lines[t])
        spread = np.sqrt(np.maximum(1e-9, 1 - near * near))
        edges = np.arange(-3, 4) * self.width - self.offsets[t][None, :, None] - center[:, :, None]
        edges = _normal(edges / spread[:, None, None])
        cell = np.diff(edges, axis=2, prepend=0.0, append=1.0)  # cells -4 .. 3
        chance, digits = np.ones((len(q), 1)), np.zeros((len(q), 1), np.int64)
        for j in range(self.hashes):
            chance = (chance[:, :, None] * cell[:, j, None, :]).reshape(len(q), -1)
            digits = (digits[:, :, None] | (np.arange(8) << 3 * j)).reshape(len(q), -1)
            order = np.argsort(-chance, axis=1, kind="stable")[:, :PROBES]
            chance, digits = np.take_along_axis(chance, order, 1), np.take_along_axis(digits, order, 1)
            used = max(1, int((chance > 1e-9).any(0).sum()))
            chance, digits = chance[:, :used], digits[:, :used]
        visit = (np.cumsum(chance, axis=1) - chance < target) & (chance > 1e-9)
        row, at = np.nonzero(visit)
        return row, digits[row, at] << 2 | t


def _normal(x: np.ndarray) -> np.ndarray:
    """Distribution function of the normal distribution (Abramowitz and Stegun 7.1.26, error below 1e-6)."""
    z = np.abs(x) / sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x >= 0, 1 - tail / 2, tail / 2)


PACKED = "bucket long, n long, ids binary, vecs binary"


def _pack(bucket: np.ndarray, ids: np.ndarray, x: np.ndarray, row: np.ndarray | None = None) -> pa.RecordBatch:
    """One row per bucket with the ids and vectors that fall into it: of ``row`` if given, else one after the other.

    The vectors are copied once, in the order of the buckets, and are the column's memory as they are.
    """
    order = np.argsort(bucket, kind="stable")
    bucket, row = bucket[order], order if row is None else row[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.array([], int)
    edges = np.r_[starts, len(bucket)]

    def column(values: np.ndarray) -> pa.Array:
        offsets = (edges * (values.nbytes // max(1, len(row)))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    columns = [pa.array(bucket[starts]), pa.array(np.diff(edges)), column(ids[row].astype("<i8")), column(x[row])]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "n", "ids", "vecs"])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, by score and then by id."""
    if scores.shape[1] > k:
        bound = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        some = np.flatnonzero((scores >= bound[:, None]).any(0))
        scores, ids = scores[:, some], np.broadcast_to(ids, scores.shape)[:, some]
    ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores))[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


FOUND = "query long, class array<long>, score array<double>"


def _rank(batches: Iterator[pa.RecordBatch], dim: int, dtype: str, k: int) -> Iterator[pa.RecordBatch]:
    """Compare blocks of queries with blocks of vectors; a query's best of all blocks of the task come out once."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def out() -> pa.RecordBatch:
        rows = list(best.items())
        best.clear()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([q for q, _ in rows], pa.int64()),
                pa.array([i for _, (_, i) in rows], pa.list_(pa.int64())),
                pa.array([s for _, (s, _) in rows], pa.list_(pa.float64())),
            ],
            names=["query", "class", "score"],
        )

    for batch in batches:
        for at in range(batch.num_rows):
            queries, q = vec.unpack(batch.column("queries")[at].as_py(), dim, dtype)
            ids, x = vec.unpack(batch.column("parts")[at].as_py(), dim, dtype)
            for start in range(0, len(queries), 512):
                scores, near = _best(q[start : start + 512] @ x.T, ids, k)
                for number, s, i in zip(queries[start : start + 512].tolist(), scores, near):
                    if number in best:
                        s, i = np.r_[best[number][0], s], np.r_[best[number][1], i]
                        _, first = np.unique(i, return_index=True)  # both tables may have found it
                        order = np.lexsort((i[first], -s[first]))[:k]
                        s, i = s[first][order], i[first][order]
                    best[number] = (s, i)
            if len(best) > FLUSH:
                yield out()
    if best:
        yield out()


def _scan(batches: Iterator[pa.RecordBatch], queries: np.ndarray, q: np.ndarray, dim: int, dtype: str, k: int) -> Iterator[pa.RecordBatch]:
    """Brute force for a few queries: the best of every batch."""
    for batch in batches:
        scores, ids = _best(q @ vec.matrix(batch.column("vector"), dim, dtype).astype(np.float64).T, batch.column("class").to_numpy(), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries), pa.array(list(ids), pa.list_(pa.int64())), pa.array(list(scores), pa.list_(pa.float64()))],
            names=["query", "class", "score"],
        )


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best classes of each query of lists found: rows (query, class, score)."""
    pairs = found.select("query", F.explode(F.arrays_zip("class", "score")).alias("c")).select("query", "c.class", "c.score")
    pairs = pairs.groupBy("query", "class").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    return pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).drop("place")


def nearest(
    df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", audit: int = AUDIT
) -> DataFrame:
    """The ``k`` rows of largest inner product of every row that ``is_query`` (a function of the id column) picks.

    Rows (``query_id``, ``rank`` from 1, ``vec_id``, ``score``), all other rows if fewer, ties to the smaller id. Rows take no part
    whose id is null or whose vector is null, zero, of another length than most, or holds null or non-finite
    components. Equal vectors are one class, so copies of any number are compared once; rows alike in id
    and vector count once. Recall is measured on ``audit`` queries by brute force, and more buckets are visited until it reaches
    ``RECALL``, by what each query has found so far; the last step compares every query with every vector. An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).filter(
        F.col("id").isNotNull() & vec.usable(F.col("vector"))
    )
    dim, dtype = vec.usual_length(rows, "vector"), vec.dtype_of(rows, "vector")
    rows = rows.filter(F.size("vector") == dim)
    rows = rows.distinct()
    classes = stored(rows.groupBy("vector").agg(F.min("id").alias("class")))
    # a class is named by its smallest id, or by a number where rows of one id have different vectors
    found = classes.agg(F.count("*"), F.count_distinct("class")).first()
    if found[0] != found[1]:
        classes = stored(classes.withColumn("class", F.monotonically_increasing_id()))
    named = stored(rows.join(classes, "vector"))
    classes = classes.select("class", "vector")
    queries = named.filter(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "class")
    asked = classes.join(queries.select("class").distinct(), "class", "left_semi")
    size = classes.agg(F.count("*").alias("n"), F.max(F.sqrt(vec.product(F.col("vector"), F.col("vector")))).alias("norm")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not size["n"]:
        return spark.createDataFrame([], schema)
    wide = k + 1  # the query's own class is among them

    # a few queries by brute force: how near a k-th neighbour is, and what to measure recall against
    sample = asked.orderBy(F.xxhash64(F.lit(SEED), "class")).limit(audit).collect()
    few = np.array([r["class"] for r in sample], np.int64)
    if not len(few):
        return spark.createDataFrame([], schema)
    q = np.array([r["vector"] for r in sample], np.float64)
    exact = _merged(classes.mapInArrow(lambda b: _scan(b, few, q, dim, dtype, wide), FOUND), wide).collect()
    truth = {(r["query"], r["class"]): r["score"] for r in exact}
    norms = dict(zip(few.tolist(), np.sqrt((q * q).sum(1)) * size["norm"]))
    worst = {a: min(s / norms[a] for (b, _), s in truth.items() if b == a) for a in few.tolist()}
    near = float(np.clip(np.quantile(list(worst.values()), 0.25), 0.0, 0.999))
    far = float(np.clip(min(worst.values()), 0.0, 0.999))

    tables = Tables(dim, size["n"], size["norm"], near)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = vec.matrix(batch.column("vector"), dim, dtype), batch.column("class").to_numpy()
            for t in range(TABLES):
                yield _pack(tables.buckets(t, x), ids, x)

    def compared(held: DataFrame, visiting: DataFrame) -> DataFrame:
        pairs = held.select("bucket", "parts").join(visiting.select("bucket", F.col("parts").alias("queries")), "bucket")
        return pairs.select("parts", "queries").mapInArrow(lambda b: _rank(b, dim, dtype, wide), FOUND)

    def recall_of(found: DataFrame) -> float:
        hits = found.filter(F.col("query").isin(few.tolist())).select("query", "class").collect()
        return sum((r["query"], r["class"]) in truth for r in hits) / len(truth)

    held = vec.blocks(stored(classes.mapInArrow(index, PACKED)), ["bucket"])
    nearness = asked.withColumn("near", F.lit(near))
    lists = found = None
    for target in TARGETS:
        def probe(batches: Iterator[pa.RecordBatch], target: float = target) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, PROBED):
                    part = batch.slice(at, PROBED)
                    x, ids = vec.matrix(part.column("vector"), dim, dtype), part.column("class").to_numpy()
                    for t in range(TABLES):
                        row, bucket = tables.probes(t, x.astype(np.float64), part.column("near").to_numpy(), target)
                        yield _pack(bucket, ids, x, row)

        visiting = vec.blocks(stored(nearness.mapInArrow(probe, PACKED)), ["bucket"], 1024)
        more = compared(held, visiting)
        found = stored(_merged(more if lists is None else lists.unionByName(more), wide))
        if recall_of(found) >= RECALL:
            break
        # what a query has found bounds how near its k-th neighbour is; with too few found it may be as far as any
        lists = found.groupBy("query").agg(F.collect_list("class").alias("class"), F.collect_list("score").alias("score"))
        length = F.sqrt(vec.product(F.col("vector"), F.col("vector"))) * F.lit(size["norm"])
        own = F.when(F.size("score") >= min(wide, size["n"]), F.greatest(F.lit(0.0), F.least(F.lit(0.999), F.array_min("score") / length)))
        nearness = asked.join(lists.select(F.col("query").alias("class"), "score"), "class", "left").select(
            "class", "vector", F.coalesce(own, F.lit(far)).alias("near")
        )
    else:
        shares = max(16, -(-size["n"] // SHARE))

        def shared(batches: Iterator[pa.RecordBatch], copies: bool) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, ids = vec.matrix(batch.column("vector"), dim, dtype), batch.column("class").to_numpy()
                for share in range(shares) if copies else [None]:
                    mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % shares
                    yield _pack(mixed if share is None else np.full(len(ids), share), ids, x)

        everything = vec.blocks(stored(classes.mapInArrow(lambda b: shared(b, False), PACKED)), ["bucket"])
        every_query = vec.blocks(stored(asked.mapInArrow(lambda b: shared(b, True), PACKED)), ["bucket"], 1024)
        found = stored(_merged(compared(everything, every_query), wide))

    # exact scores of the classes found, and as many of their smallest ids as can be needed
    left = classes.select(F.col("class").alias("query"), F.col("vector").alias("qv"))
    scored = (
        found.select("query", "class").join(classes, "class").join(left, "query")
        .select("query", "class", vec.product(F.col("qv"), F.col("vector")).alias("score"))
    )
    first = Window.partitionBy("class").orderBy("id")
    members = named.select("class", "id").withColumn("at", F.row_number().over(first)).filter(F.col("at") <= wide)
    # how many rows of nearer classes there are: classes of one score count alike, whatever their ids
    upto, alike = Window.partitionBy("query").orderBy(F.desc("score")), Window.partitionBy("query", "score")
    useful = (
        scored.join(members.groupBy("class").agg(F.count("*").alias("n")), "class")
        .withColumn("before", F.sum("n").over(upto) - F.sum("n").over(alike))
        .filter(F.col("before") <= k)
        .join(members, "class")
        .select("query", F.col("class").alias("of"), "id", "score")
    )
    # rows of one id and different vectors are queries of their own, and candidates of each other
    order = Window.partitionBy("query_id", "class").orderBy(F.desc("score"), "id")
    return (
        queries.join(useful, F.col("class") == F.col("query"))
        .filter((F.col("id") != F.col("query_id")) | (F.col("of") != F.col("class")))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )


@query("op6_multiprobe_lsh")
def op6_multiprobe_lsh(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(table(spark, sf, "embeddings"), lambda i: i % 20 == 0)
