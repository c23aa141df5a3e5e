"""Exact token counts of a sentencepiece BPE model at every prefix of a text, by dynamic programming.

The encoding of a prefix ends in one token, and what stands before that token is the encoding
of a shorter prefix. So one pass over the characters finds, for every prefix, its last token
and its count: among the tokens that end there exactly one is not merged with the last token of
the prefix before it. Pieces never hold a non-space followed by a space, so the text splits into
chunks (spaces, then other characters, and line ends) whose counts add up, and the prefix table of a chunk
is kept for its next occurrence. A text's table is its chunks' tables and the running counts at their ends.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vigilday.llm.common import table
from vigilday.llm.registry import query

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
# chunks whose tables a worker keeps (in two generations), and pairs
KEPT = 400_000
LAST = itemgetter(-1)
# chunks longer than this are not kept
KEPT_CHARS = 64
SPACE = "▁"
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+")


class Tables(dict):
    """Prefix tables of chunks: those used since the last ``KEPT`` new ones, the others are found anew."""

    def __init__(self, scan):
        self.scan, self.older = scan, {}

    def __missing__(self, chunk: str):
        found = self.older.get(chunk) or self.scan(chunk)
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found


class PrefixCounter:
    """Counts for one model whose normalisation leaves texts as they are (checked when it is loaded).

    Special strings in a text are ordinary text, no begin or end token is counted, and a character without a
    piece counts as many tokens as it has bytes: what the library does by default.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.vocab_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        probe = "a  ﬁ É́　A\t"
        if (
            any(SPACE in p.lstrip(SPACE) or "\n" in p or not all(c in self.rank for c in p) for p in self.rank)
            or model.decode(model.encode(probe)) != probe
        ):
            raise ValueError(f"{path}: pieces cross words or hold characters that are none, or texts are normalised")
        # the pieces that the model gives for their own text can end a prefix; the automaton finds
        # those that end at each character, longest first
        self.pieces = [p for p in self.rank if len(p) == 1 or self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for number, piece in enumerate(self.pieces):
            self.automaton.add_word(piece, (len(piece), number))
        self.automaton.make_automaton()
        self.chunks = Tables(self.scan)
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best-scored pair is merged, the leftmost of equals, until none is left."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            scored = [(rank.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            best = max(((s, -i) for s, i in scored if s is not None), default=None)
            if best is None:
                break
            at = -best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: int, right: int) -> bool:
        """Whether the piece ``right`` can follow the piece ``left`` without being merged with it."""
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        a, b = self.pieces[left], self.pieces[right]
        known = self.pairs[left << 32 | right] = self.merged(a + b) == [a, b]
        return known

    def scan(self, chunk: str) -> bytes | tuple[int, ...]:
        """The dynamic programme: the last token and the count of each prefix from those of shorter ones.

        ``last`` is None at the start and after a character without a piece, with which nothing is merged.
        """
        last: list[int | None] = [None]
        counts, done, pairs = [0], 0, self.pairs
        for end, (size, piece) in self.automaton.iter(chunk):
            if end < done:
                continue
            while done < end:
                last.append(None)
                counts.append(counts[done] + len(chunk[done].encode()))
                done += 1
            start = end + 1 - size
            left = last[start]
            if left is not None:
                follows = pairs.get(left << 32 | piece)
                if not (self.stands(left, piece) if follows is None else follows):
                    continue
            last.append(piece)
            counts.append(counts[start] + 1)
            done += 1
        for char in chunk[done:]:
            counts.append(counts[-1] + len(char.encode()))
        return bytes(counts[1:]) if max(counts) < 256 else tuple(counts[1:])

    def table(self, text: str) -> list[bytes | tuple[int, ...]]:
        """The prefix tables of a text's chunks.

        The library puts one space before a text that is not empty; it is the first chunk's first character.
        """
        if not text:
            return []
        return list(map(self.chunks.__getitem__, CHUNKS.findall(SPACE + text.replace(" ", SPACE))))

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its table."""
        return total(self.table(text))

    def counts(self, text: str) -> np.ndarray:
        """Token count of every prefix, from no character to all."""
        inner = self.table(text)
        flat = [before + n for before, t in zip(accumulate(map(LAST, inner), initial=0), inner) for n in t]
        # the added space makes the first entry; no character has no token
        return np.array([0, *flat[1:]], np.int64)

    def longest_within(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, read off the table."""
        return longest(self.table(text), budget)


def total(inner: list[bytes | tuple[int, ...]]) -> int:
    return sum(map(LAST, inner))


def longest(inner: list[bytes | tuple[int, ...]], budget: int) -> int:
    """Characters of the longest prefix within ``budget``; a longer prefix may have fewer tokens than a shorter one."""
    ends = list(accumulate(map(LAST, inner)))
    at = int(np.searchsorted(ends, budget, "right")) if ends else 0
    if at >= len(inner):
        return sum(map(len, inner)) - bool(inner)
    chars = sum(map(len, inner[:at]))
    for chunk in range(at, -1, -1):
        before = ends[chunk - 1] if chunk else 0
        fits = [i for i, n in enumerate(inner[chunk], 1) if before + n <= budget]
        if fits:
            return max(0, chars + fits[-1] - 1)
        chars -= len(inner[chunk - 1]) if chunk else 0
    return 0


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One counter per model and Python worker, so that its tables serve all the worker's tasks."""
    return PrefixCounter(path)


COUNTS = StructType([StructField("n_tokens", LongType()), StructField("cut_chars", IntegerType())])


def token_counts(text: Column, path: str, budget: int = LIMIT) -> Column:
    """A struct per text: ``n_tokens``, and ``cut_chars``, the code points of its longest prefix within ``budget`` tokens.

    Null counts as empty: 0 tokens. Both are read off one prefix table; the text is never encoded again.
    """

    @arrow_udf(COUNTS)
    def count(texts: pa.Array) -> pa.Array:
        own = counter(path)
        totals, cuts = [], []
        for value in texts:
            text = value.as_py() or ""
            inner = own.table(text)
            totals.append(total(inner))
            cuts.append(len(text) if totals[-1] <= budget else longest(inner, budget))
        return pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(cuts, pa.int32())], ["n_tokens", "cut_chars"])

    return count(text)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens``, ``over_limit``, ``cut_chars``.

    Null texts count as empty (0 bytes, 0 tokens). Repeated rows and null ids come out as often as they
    came in, an empty table gives an empty result, and other columns are neither read nor returned. One pass, no shuffle.
    """
    text = F.col(text_col)
    return (
        docs.select(
            F.col(id_col).alias(id_col),
            F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
            token_counts(text, path, budget).alias("_counts"),
        )
        .select(id_col, "n_bytes", "_counts.n_tokens", (F.col("_counts.n_tokens") > budget).alias("over_limit"), "_counts.cut_chars")
    )


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf, "documents"), public_tokenizers.path(MODEL))
