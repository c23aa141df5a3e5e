"""SimHash near-duplicates found by Golay fuzzy hashing.

A document's 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). If
two fingerprints differ in at most three bits, then by the pigeonhole principle two of
the three segments differ in at most one bit each. A segment, padded to 23 bits, is decoded
with the perfect binary Golay code to the index of its codeword; the segments one bit away
decode to at most five more indices. Segments one bit apart therefore share an index:
the own index of the one is among the nearby indices of the other. Every fingerprint
gives, for each of the three pairs of segments, keys (own index, nearby indices) and keys
(nearby indices, own index); the first kind is joined with the second, and the differing
bits are counted in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from vigilday.functions.storage import stored
from vigilday.llm.common import components, table
from vigilday.llm.registry import query

SEED = 42
SHINGLE = 3
MAX_BITS = 3
CHUNK = 1 << 16
# The generator polynomial of the binary Golay code, its length and its parity bits.
GENERATOR, LENGTH, PARITY = 0xAE3, 23, 11
# Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of a text: a bit is set if over half the shingles' hashes have it.

    Words are runs of bytes that are no ASCII white space, A-Z lower-cased. A text of fewer
    words than ``width`` has one shingle, all its words; without words (or null) it is 0.
    The hashes are summed in chunks, so memory does not grow with the counts.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    n = len(words) - width + 1
    first, last, digest = starts[:n].tolist(), ends[width - 1 :].tolist(), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array(
            [digest(line[s:e], SEED) for s, e in zip(first[at : at + CHUNK], last[at : at + CHUNK])], "<u8"
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in texts.cast(pa.binary())]
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint of a text as a signed long."""
    return _fingerprints(text)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial."""
    rest = words.copy()
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - PARITY), 0)
    return rest


def _leaders() -> np.ndarray:
    """The one error of at most three bits for each of the 2,048 remainders (the code is perfect)."""
    bits = [1 << i for i in range(LENGTH)]
    errors = [0, *bits]
    errors += [a | b for i, a in enumerate(bits) for b in bits[:i]]
    errors += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    table_ = np.zeros(1 << PARITY, np.int64)
    table_[_syndrome(np.array(errors, np.int64))] = errors
    return table_


LEADERS = _leaders()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ LEADERS[_syndrome(words)]) >> PARITY


def nearby(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codeword indices of each word and of the words one bit away: row numbers and indices."""
    flips = np.array([0] + [1 << i for i in range(width)], np.int64)
    index = decode((words[:, None] ^ flips).ravel()).reshape(len(words), -1)
    index.sort(axis=1)
    new = np.ones(index.shape, bool)
    new[:, 1:] = index[:, 1:] != index[:, :-1]
    row, _ = np.nonzero(new)
    return row, index[new]


def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fuzzy keys of fingerprints: (key, fp, side), side 0 to be joined with side 1."""
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(whole), 4096):
            fps = whole[at : at + 4096]
            words = [(fps.view(np.uint64) >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
            own = [decode(w) for w in words]
            near = [nearby(w, width) for w, (_, width) in zip(words, SEGMENTS)]
            for pair, (i, j) in enumerate(PAIRS):
                for side, (row, key) in enumerate((
                    (near[j][0], own[i][near[j][0]] << 12 | near[j][1]),
                    (near[i][0], near[i][1] << 12 | own[j][near[i][0]]),
                )):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pair << 24 | key), pa.array(fps[row]), pa.array(np.full(len(row), side, np.int32))],
                        names=["key", "fp", "side"],
                    )


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in column ``fp`` that differ in 1 to ``max_bits`` (3 at most) bits.

    Each link comes out once: the join keeps it only under the first pair of segments with at
    most one differing bit each, under which it has exactly one common key.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys are complete for 3 differing bits at most")
    keyed = stored(fingerprints.select("fp").mapInArrow(keys, "key long, fp long, side int"))
    differs = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    close = [
        F.bit_count(F.shiftrightunsigned(differs, low).bitwiseAND(F.lit((1 << width) - 1))) <= 1 for low, width in SEGMENTS
    ]
    first = F.when(close[0] & close[1], 0).when(close[0] & close[2], 1).otherwise(2)
    return (
        keyed.filter("side = 0").alias("a")
        .join(
            keyed.filter("side = 1").alias("b"),
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.fp") < F.col("b.fp"))
            & (F.bit_count(differs) <= max_bits)
            & (F.shiftright("a.key", 24) == first),
        )
        .select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed long), ``component_id``.

    The component is the smallest id reachable by links, null ids last (null only if the component
    has no other id). Rows of one fingerprint are one node, so a group of copies of any size is
    never paired. Null and empty texts and texts of white space have fingerprint 0 and are linked like any
    other. An empty table gives an empty result; other columns are neither read nor returned.
    """
    marked = stored(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")))
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("least")))
    linked = components(links(nodes, max_bits))
    placed = nodes.join(linked, nodes.fp == linked.id, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    groups = placed.join(named, "component").select("fp", "component_id")
    return marked.join(groups, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one of the smallest id.

    Of rows that repeat an id the one with the least hash of its text stays. A null id counts as
    larger than any other. All columns are returned as they came.
    """
    key = F.xxhash64(F.lit("id"), F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    names = [f"_key_{len(docs.columns)}", f"_size_{len(docs.columns)}"]
    marked = stored(docs.select(
        F.col(id_col).alias("id"),
        key.alias("key"),
        F.coalesce(F.octet_length(F.col(text_col)), F.lit(-1)).alias("size"),
        fingerprint_column(F.col(text_col)).alias("fp"),
    ))
    best = F.struct(F.col("id").isNull().alias("none"), "id", "key", "size")
    nodes = stored(marked.groupBy("fp").agg(F.min(best).alias("best")))
    linked = components(links(nodes))
    kept = (
        nodes.join(linked, nodes.fp == linked.id, "left")
        .groupBy(F.coalesce("component", "fp").alias("component"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.key").alias(names[0]), F.col("best.size").alias(names[1]))
    )
    whole = docs.withColumns({names[0]: key, names[1]: F.coalesce(F.octet_length(F.col(text_col)), F.lit(-1))})
    return whole.join(kept, names, "left_semi").dropDuplicates(names).select(*docs.columns)


@query("op5_simhash_dedup")
def op5_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
