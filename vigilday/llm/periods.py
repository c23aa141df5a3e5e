"""Runs of repeated words, found by block convolution.

At scale B = 1, 2, 4, ... the words are cut into aligned blocks of B. The sum of squared differences between a
block and every place B to 2B - 1 words further on comes from one exact cross-correlation (a number-theoretic transform of
2B points) and prefix sums of squares; it is zero just where the block occurs again. A run of period q and
at least 4q words holds two adjacent blocks of its scale (B <= q < 2B) that occur again q words on, so
adjacent zeros at one distance are the seeds. Each seed is extended word by word to both sides, by less than
a block, and kept if it is long enough.

Two exact tests save transforms. A block whose words do not all come again within 2B words has no
occurrence. A block whose whole window lies in a run found at a smaller scale has occurrences only at multiples of
that run's period (Fine and Wilf), which are the same run.

The texts of an Arrow batch are searched as one sequence with a separator between texts that equals nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from vigilday.llm.common import SPACE, table
from vigilday.llm.registry import query

MIN_LENGTH = 6
MIN_EXPONENT = 4
# Primes with transforms of up to 2^23 and 2^26 points, and a generator of both.
PRIMES = (998244353, 469762049)
GENERATOR = 3
# points transformed together, and words searched together (a longer text is searched alone)
POINTS = 1 << 19
GROUP_WORDS = 1 << 19


@lru_cache(maxsize=64)
def _roots(size: int, prime: int, inverse: bool) -> np.ndarray:
    """The first ``size / 2`` powers of a root of unity of order ``size``."""
    root = pow(GENERATOR, (prime - 1) // size, prime)
    if inverse:
        root = pow(root, prime - 2, prime)
    powers = np.ones(1, np.uint64)
    while len(powers) < size // 2:
        powers = np.concatenate((powers, powers * np.uint64(pow(root, len(powers), prime)) % np.uint64(prime)))
    return powers


def forward(rows: np.ndarray, prime: int) -> np.ndarray:
    """Transform of each row modulo ``prime``, its points in bit-reversed order."""
    p, (n, size) = np.uint64(prime), rows.shape
    width = size
    while width > 1:
        pairs = rows.reshape(n, size // width, 2, width // 2)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        rows = np.stack(((low + high) % p, (low + p - high) * _roots(width, prime, False) % p), axis=2).reshape(n, size)
        width //= 2
    return rows


def backward(rows: np.ndarray, prime: int) -> np.ndarray:
    """The inverse of ``forward``."""
    p, (n, size) = np.uint64(prime), rows.shape
    width = 2
    while width <= size:
        pairs = rows.reshape(n, size // width, 2, width // 2)
        low, high = pairs[:, :, 0], pairs[:, :, 1] * _roots(width, prime, True) % p
        rows = np.stack(((low + high) % p, (low + p - high) % p), axis=2).reshape(n, size)
        width *= 2
    return rows * np.uint64(pow(size, prime - 2, prime)) % p


def correlate(blocks: np.ndarray, windows: np.ndarray, prime: int) -> np.ndarray:
    """Sums of products of each block with its window (twice as wide) at shifts 0 to B - 1, modulo ``prime``."""
    n, width = blocks.shape
    turned = np.zeros_like(windows)
    turned[:, 0] = blocks[:, 0]
    turned[:, width + 1 :] = blocks[:, :0:-1]
    p = np.uint64(prime)
    return backward(forward(turned % p, prime) * forward(windows % p, prime) % p, prime)[:, :width]


def occurrences(ids: np.ndarray, squares: list[np.ndarray], starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (their starts) and distances in [width, 2 * width) at which they occur again.

    ``ids`` ends in 3 * ``width`` words of padding; ``squares`` are, per prime, the sums of squares (each modulo the
    prime) before each word. The result is exact: a sum of squared differences below the product of the primes is zero if its
    remainders by both are, and where it could be larger (texts of millions of words) the words are compared as well.
    """
    found_at, found_by = [], []
    spread = np.arange(width)
    step = max(1, POINTS // (2 * width))
    for at in range(0, len(starts), step):
        part = starts[at : at + step]
        alive = np.arange(len(part))
        zero = None
        for prime, sums in zip(PRIMES, squares):
            first = part[alive]
            blocks = ids[first[:, None] + spread]
            windows = ids[(first + width)[:, None] + np.arange(2 * width)]
            p = np.uint64(prime)
            shifted = first[:, None] + width + spread
            own = (sums[first + width] - sums[first])[:, None]
            total = (own + sums[shifted + width] - sums[shifted]) % p
            here = total == 2 * correlate(blocks, windows, prime) % p
            if zero is None:
                alive = np.flatnonzero(here.any(axis=1))
                zero = here[alive]
            else:
                zero &= here
            if not len(alive):
                break
        if len(alive):
            row, shift = np.nonzero(zero)
            if int(ids.max()) ** 2 * width >= PRIMES[0] * PRIMES[1]:
                here = part[alive][row]
                equal = [bool((ids[a : a + width] == ids[a + b : a + b + width]).all()) for a, b in zip(here, shift + width)]
                row, shift = row[equal], shift[equal]
            found_at.append(part[alive][row])
            found_by.append(shift + width)
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_by)


def _reach(ids: np.ndarray, at: np.ndarray, by: np.ndarray, width: int, back: bool) -> np.ndarray:
    """How many words from ``at`` on (or before it) equal those ``by`` words further on; at most ``width``."""
    out = np.empty(len(at), np.int64)
    reach = np.arange(1, width + 1)
    step = max(1, POINTS // width)
    for i in range(0, len(at), step):
        spots = at[i : i + step, None] + (-reach if back else reach - 1)
        left = np.maximum(spots, 0)
        differ = (ids[left] != ids[left + by[i : i + step, None]]) | (spots < 0)
        out[i : i + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return out


def find_runs(words: np.ndarray, texts: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs in ``words`` (ids from 0), by start and period.

    ``texts`` holds the number of words of each text; no run reaches across texts. Each length is
    ``min_length`` and ``MIN_EXPONENT`` periods at least, each period is the smallest of its words.
    """
    if not len(texts) or int(texts.max()) < min_length:
        return np.zeros((0, 3), np.int64)
    # a separator behind each text, with an id of its own; positions of words in the joined sequence
    gaps = np.repeat(np.arange(len(texts)), texts)
    total = len(words) + len(texts)
    top = int(words.max()) + 1
    widest = 1
    while 2 * widest * MIN_EXPONENT <= int(texts.max()):
        widest *= 2
    ids = np.arange(top + len(texts), top + len(texts) + total + 3 * widest, dtype=np.uint64)
    ids[np.arange(len(words)) + gaps] = words
    ids[np.cumsum(texts + 1) - 1] = top + np.arange(len(texts), dtype=np.uint64)
    ids[total:] = top + len(texts) + np.arange(3 * widest, dtype=np.uint64)
    squares = [
        np.concatenate((np.zeros(1, np.uint64), np.cumsum(ids * ids % np.uint64(p), dtype=np.uint64))) for p in PRIMES
    ]
    # how far on each word comes again
    order = np.argsort(ids[:total], kind="stable")
    again = np.full(total, np.iinfo(np.int64).max)
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]

    runs = np.zeros((0, 3), np.int64)
    width = 1
    while width <= widest:
        starts = np.arange(0, total - width + 1, width)
        hardest = again[: len(starts) * width].reshape(-1, width).max(axis=1)
        starts = starts[hardest < 2 * width]
        if len(runs):
            furthest = np.maximum.accumulate(runs[:, 0] + runs[:, 1])
            before = np.searchsorted(runs[:, 0], starts, "right")
            covered = np.where(before > 0, furthest[before - 1], 0)
            starts = starts[covered < starts + 3 * width - 1]
        at, by = occurrences(ids, squares, starts, width)
        if len(runs) and len(at):
            # an occurrence inside a run of which the distance is a multiple belongs to that run
            ends = runs[:, 0] + runs[:, 1]
            furthest = np.maximum.accumulate(ends)
            leader = np.maximum.accumulate(np.where(ends == furthest, np.arange(len(ends)), 0))
            before = np.searchsorted(runs[:, 0], at, "right")
            by_run = leader[np.maximum(before - 1, 0)]
            inside = (before > 0) & (ends[by_run] >= at + by + width) & (by % runs[by_run, 2] == 0)
            at, by = at[~inside], by[~inside]
        if len(at):
            # chains of adjacent blocks with one distance
            chained = np.lexsort((at, by))
            at, by = at[chained], by[chained]
            new = np.ones(len(at), bool)
            new[1:] = (by[1:] != by[:-1]) | (at[1:] != at[:-1] + width)
            first = np.flatnonzero(new)
            last = np.concatenate((first[1:], [len(at)])) - 1
            long_enough = last > first
            first, last = first[long_enough], last[long_enough]
            if len(first):
                period = by[first]
                start = at[first] - _reach(ids, at[first], period, width, True)
                after = at[last] + width
                stop = after + _reach(ids, after, period, width, False) + period
                seen = np.column_stack((start, stop - start, period))
                seen = seen[seen[:, 1] >= np.maximum(min_length, MIN_EXPONENT * period)]
                runs = np.concatenate((runs, seen))
                # of equal stretches the smallest period counts
                runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
                fresh = np.ones(len(runs), bool)
                fresh[1:] = (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 1])
                runs = runs[fresh]
        width *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
FOUND = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])


def _collapse(texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[bytes]]:
    """Per text its runs, starts counted from its first word, and its words without the repetitions."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    known: dict[bytes, int] = {}
    flat = [known.setdefault(w, len(known)) for words in texts for w in words]
    runs = find_runs(np.array(flat, np.uint64), counts)
    first = np.concatenate(([0], np.cumsum(counts + 1)))
    cuts = np.searchsorted(runs[:, 0], first)
    found, kept = [], []
    for i, words in enumerate(texts):
        own = runs[cuts[i] : cuts[i + 1]] - [first[i], 0, 0]
        found.append(own)
        if len(own):
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, own[:, 0] + own[:, 2], 1)
            np.add.at(edges, own[:, 0] + own[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
        kept.append(b" ".join(words))
    return found, kept


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the texts in column 1 by what is found in them; at most ``GROUP_WORDS`` words, or one text, at a time."""

    def found(ids: list[pa.Array], group: list[list[bytes]]) -> pa.RecordBatch:
        runs, kept = _collapse(group)
        offsets = np.concatenate(([0], np.cumsum(list(map(len, runs))))).astype(np.int32)
        rows = np.concatenate(runs)
        items = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], RUN.names)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays(ids),
                pa.array(list(map(len, group)), pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), items),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["id", *FOUND.names],
        )

    for batch in batches:
        ids, group, size = [], [], 0
        for i, value in enumerate(batch.column(1).cast(pa.binary())):
            # Python splits bytes at ASCII white space, which is what ends a word here
            words = (value.as_py() or b"").split()
            if group and size + len(words) > GROUP_WORDS:
                yield found(ids, group)
                ids, group, size = [], [], 0
            ids.append(batch.column(0).slice(i, 1))
            group.append(words)
            size += len(words)
        if group:
            yield found(ids, group)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``runs`` (start, length, period; by start), ``collapsed``.

    A run is a longest stretch of at least ``MIN_LENGTH`` words and ``MIN_EXPONENT`` times its smallest period. ``collapsed`` are
    the text's words, joined by one space, without those that follow the first period of a run. Null texts count as
    empty: no word, no run, an empty text. Repeated rows and null ids come out as they came in, an empty table gives an
    empty result, and other columns are neither read nor returned. One pass without a shuffle; a text is one task's work.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([texts.schema["id"], *FOUND.fields])
    return texts.mapInArrow(_search, schema).withColumnRenamed("id", id_col)


def repeated(text: Column, key: Column) -> Column:
    """``text``; where 10 divides the crc32 of ``key`` (as text), with its words from one place on replaced by repetitions.

    With h the hash, g = floor(h / 10), n words and a = g % n, word i >= a becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). A null key or text, and a text without words, stay as they are.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    cut = F.filter(F.split(text, SPACE), lambda w: w != "")

    def rebuilt(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i)))
        return F.when(n > 0, F.array_join(moved, " "))

    # the words are bound once, as the one item of an array
    bound = F.transform(F.array(cut), rebuilt)
    return F.when(h % 10 == 0, F.coalesce(F.get(bound, F.lit(0)), text)).otherwise(text)


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", repeated(F.col("text"), F.col("doc_id")).alias("text"))
    found = collapse_runs(docs)
    # the greatest length first, then the smallest start and period
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(told, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.expr("1000 * best.length div -best.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
