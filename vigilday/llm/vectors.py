"""Vectors as rows and as blocks: which take part, equal ones as one class, exact scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 4096


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, only finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def usual_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of a vector (the smaller of equals), 0 without any."""
    found = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def dtype_of(df: DataFrame, vector: str) -> str:
    """How vectors of this column are packed into bytes without loss."""
    return "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def matrix(column: pa.Array, dim: int, dtype: str) -> np.ndarray:
    """A list column of vectors of one length as rows of a matrix."""
    flat = column.flatten().cast(pa.float32() if dtype == "<f4" else pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


def product(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed in the order of the components."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def blocks(packed: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """Join packed rows (keys, ``n``, ``ids``, ``vecs``) of a key into rows of about ``size`` vectors: columns keys, ``block``, ``parts``.

    A key of any size is cut into as many blocks as it needs, so no task holds more than a block of it.
    """
    counts = packed.groupBy(*keys).agg(F.sum("n").alias("_all"))
    dealt = packed.join(counts, keys).withColumn(
        "block", F.pmod(F.xxhash64("ids"), F.ceil(F.col("_all") / size)).cast("int")
    )
    return dealt.groupBy(*keys, "block").agg(F.collect_list(F.struct("ids", "vecs")).alias("parts"))


def unpack(parts: list[dict], dim: int, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    ids = np.frombuffer(b"".join(p["ids"] for p in parts), "<i8")
    return ids, np.frombuffer(b"".join(p["vecs"] for p in parts), dtype).reshape(-1, dim).astype(np.float64)
