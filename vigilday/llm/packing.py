"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A document's tokens are cut into pieces only where it is longer than a sequence. Packing looks at
lengths alone, and there are at most ``seq_len`` of them: the histogram of lengths is planned
as patterns (a bin's lengths and how many bins have them), and the pieces are then dealt to the bins by their
rank within their length. So all pieces of the corpus are packed together, while the
planner sees no more than ``seq_len`` numbers and no task sees a whole group.
"""

from __future__ import annotations

import ctypes
import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from vigilday.functions.storage import stored
from vigilday.llm.common import positions, table
from vigilday.llm.registry import query

MODEL = "word_bpe_49k.json"
SEQ_LEN = 2048
END = b"\0\0\0\0"
# words whose ids a worker keeps, their ids, and the longest word that is kept
KEPT = 400_000
KEPT_IDS = 4_000_000
KEPT_CHARS = 64
# bytes of texts whose words are looked up together, and new words encoded as one text
GROUP_BYTES = 1 << 22
TOGETHER = 32_768
# The tokenizer's own split into words, and the same for lower-cased texts whose
# characters are all plain: ASCII or accented Latin letters, neither composed nor special. What is no letter is put between blanks.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"\A[\t\n\r -~À-ÖØ-öø-ÿ]*\z"
PLAIN_APART = r"'(?:s|t|re|ve|m|ll|d)|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+"


def gather(tokens: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``tokens`` in turn, each from ``first`` on and of its size."""
    ends = np.cumsum(sizes)
    at = np.repeat(first - (ends - sizes), sizes)
    at += np.arange(len(at))
    return tokens[at]


class Words:
    """Words and their ids, held as one array each: a run of ``ids`` per word.

    Kept are the words met, until there are more than ``KEPT`` or they have more than ``KEPT_IDS`` ids. Then the half used
    most goes on, and uses count half from there. A word that is gone is encoded again if it comes back, which the same ids follow from.
    """

    def __init__(self, encode):
        self.encode = encode
        self.known = pa.array([], pa.string())
        self.ids = np.empty(0, "<u4")
        self.sizes = np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)

    def lookup(self, words: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each word begin and how many they are. The words differ and occur ``counts`` times; new ones are encoded together."""
        spots = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        old = spots >= 0
        self.uses[spots[old]] += counts[old]
        new = np.flatnonzero(~old)
        if len(new):
            missing = words.take(pa.array(new))
            ids, sizes = self.encode(missing.to_pylist())
            spots[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.known = pa.concat_arrays([self.known, missing])
            self.ids = np.concatenate([self.ids, ids])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.uses = np.concatenate([self.uses, counts[new]])
        starts = np.cumsum(self.sizes) - self.sizes
        found = self.ids, starts[spots], self.sizes[spots]
        if len(new):
            self.drop(starts)
        return found

    def drop(self, starts: np.ndarray) -> None:
        """Keep no long words, and the words used most if they are too many."""
        keep = pc.less_equal(pc.utf8_length(self.known), KEPT_CHARS).to_numpy(zero_copy_only=False)
        if keep.sum() > KEPT or self.sizes[keep].sum() > KEPT_IDS:
            order = np.flatnonzero(keep)
            order = order[np.argsort(-self.uses[order], kind="stable")][: KEPT // 2]
            order = order[np.cumsum(self.sizes[order]) <= KEPT_IDS // 2]
            keep[:] = False
            keep[order] = True
            self.uses //= 2
        if keep.all():
            return
        self.ids = gather(self.ids, starts[keep], self.sizes[keep])
        self.known, self.sizes, self.uses = self.known.filter(pa.array(keep)), self.sizes[keep], self.uses[keep]


class Encoder:
    """Ids of texts for one byte-level tokenizer that drops white space and marks the ends of words.

    No token and no normalisation reaches across ASCII white space, so a text's ids are those
    of its words in turn, and each word is encoded once while it is remembered. Plain texts without special strings are split
    further, as the tokenizer itself does, so that there are fewer different words. Many texts are split, and their different words
    found and looked up, by Arrow. The new words of plain texts are encoded together, by the same
    model without its normalisation and split, and told apart by the tokens that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        steps = config["pre_tokenizer"]
        patterns = [p["pattern"].get("Regex") for p in steps.get("pretokenizers", [steps]) if "pattern" in p]
        suffix = config["model"].get("end_of_word_suffix")
        vocabulary = config["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.words, self.parts = Words(self.alone), Words(self.run)
        self.splits = bool(suffix) and SPLIT in patterns
        if self.splits:
            byte_level = [p for p in steps["pretokenizers"] if p["type"] == "ByteLevel"]
            plain = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *byte_level]}
            config |= {"normalizer": None, "pre_tokenizer": plain, "post_processor": None, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(config))

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, read where a text is not plain."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def check(self) -> None:
        """Raise an error if the tokenizer is none of the kind."""
        probe = "ab'll  c1\tÉßà<|endoftext|>\n x"
        words = ["ab", "'ll", "1", "éßà", "endoftext", "...", "x"]
        if self.splits and self.together(words) != self.each(words):
            raise ValueError(f"{self.path}: words encoded together differ from words alone")
        for text in (probe, probe.replace("<|", "")):
            if self.encode(text).tobytes() != self.ids(text):
                raise ValueError(f"{self.path}: tokens reach across white space, or words do not end in tokens of their own")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in turn, each encoded as a text of its own, and how many each has."""
        found = [f.ids for f in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum())), sizes

    def run(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for plain words, encoded as texts of ``TOGETHER`` words and told apart behind each token that ends a word."""
        runs = (" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER))
        found = [np.array(self.bare.encode_batch_fast([r], add_special_tokens=False)[0].ids, "<u4") for r in runs]
        ids = np.concatenate(found) if found else np.empty(0, "<u4")
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(words) or sizes.sum() != len(ids):
            raise ValueError("a word does not end in one token of its own")
        return ids, sizes

    def each(self, words: list[str]) -> list[bytes]:
        return cut(*self.alone(words))

    def together(self, words: list[str]) -> list[bytes]:
        return cut(*self.run(words))

    def ids(self, text: str) -> bytes:
        return next(self.many(pa.array([text], pa.string()))).tobytes()

    def many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of texts in turn; texts of about ``GROUP_BYTES`` bytes, or one text, are looked up together."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + GROUP_BYTES, "right")))
            yield from self._group(pc.fill_null(texts.slice(at, to - at), ""))
            at = to

    def _group(self, texts: pa.Array) -> Iterator[np.ndarray]:
        plain = pc.match_substring_regex(texts, PLAIN)
        plain = pc.and_not(plain, pc.match_substring(texts, "<|")) if self.splits else pc.and_(plain, False)
        apart = pc.replace_substring_regex(pc.utf8_lower(texts.filter(plain)), PLAIN_APART, r" \0 ")
        parts = joined(pc.ascii_split_whitespace(apart), self.parts)
        words = joined(pc.split_pattern_regex(texts.filter(pc.invert(plain)), "[ \t\n\r]+"), self.words)
        for p in plain.to_pylist():
            yield next(parts if p else words)


def joined(texts: pa.ListArray, known: Words) -> Iterator[np.ndarray]:
    """The ids of texts, each a list of words; every different word is looked up once.

    White space at the ends of a text makes words without a character, which have no ids.
    """
    flat = texts.flatten().dictionary_encode()
    which, different = flat.indices.to_numpy(), flat.dictionary
    times = np.bincount(which, minlength=len(different))
    blank = pc.index(different, "").as_py()
    if blank >= 0:
        others = np.arange(len(different)) != blank
        different, times = different.filter(pa.array(others)), times[others]
    tokens, first, sizes = known.lookup(different, times)
    if blank >= 0:
        first, sizes = np.insert(first, blank, 0), np.insert(sizes, blank, 0)
    end = 0
    for n in pc.list_value_length(texts).to_pylist():
        own = which[end : end + n]
        end += n
        yield gather(tokens, first[own], sizes[own])


def cut(ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The ids of words one by one."""
    whole, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
    return [whole[s:e] for s, e in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per tokenizer and Python worker."""
    return Encoder(path)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker lives on beside others, idle or not."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


PIECES = ArrayType(StructType([StructField(n, LongType()) for n in ("piece", "start", "length", "ids_crc32")]))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN) -> DataFrame:
    """A row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``. Null texts count as empty: one piece, id 0 alone."""
    encoder(path).check()

    @arrow_udf(PIECES)
    def pieces_of(texts: pa.Array) -> pa.Array:
        own = encoder(path)
        out, offsets = [], [0]
        for ids in own.many(texts):
            whole = ids.tobytes() + END
            n = len(whole) // 4
            for piece, start in enumerate(range(0, n, seq_len)):
                part = whole[4 * start : 4 * (start + seq_len)]
                out.append((piece, start, len(part) // 4, zlib.crc32(part)))
            offsets.append(len(out))
        give_back()
        columns = [pa.array(column, pa.int64()) for column in np.array(out, np.int64).reshape(-1, 4).T]
        items = pa.StructArray.from_arrays(columns, PIECES.elementType.names)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)

    return docs.select(F.col(id_col).alias("id"), pieces_of(F.col(text_col)).alias("cut")).select(
        F.col("id").alias(id_col), F.inline("cut")
    )


def plan(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[list[int], int]]:
    """Bins for ``histogram`` (count by length): a list of (lengths in a bin, bins like it).

    A bin starts with the longest length left and is filled with the longest that fits, again and
    again. Then its smallest document (never its first, which would come back as a bin of its own) is taken out
    if two documents left over fit the gap so expanded more tightly than it did. As many bins of this kind are made as
    the lengths left allow, then the next kind is sought. Each kind uses up a length, so kinds are few.
    """
    left = np.zeros(seq_len + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= seq_len:
            raise ValueError(f"length {length} does not fit {seq_len}")
        left[length] = n
    kinds: list[tuple[list[int], int]] = []
    # below[i]: the longest length of at most i that is left, kept right by looking down from i
    while left.any():
        held: list[int] = []
        gap = seq_len
        while gap:
            fits = np.flatnonzero(left[1 : gap + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            copies = min(gap // length, int(left[length]))
            held += [length] * copies
            left[length] -= copies
            gap -= length * copies
        if gap and len(held) > 1:
            smallest = held[-1]
            pair = best_two(left, gap + smallest, smallest)
            if pair:
                held.pop()
                left[smallest] += 1
                for length in pair:
                    left[length] -= 1
                    held.append(length)
        lengths, uses = np.unique(held, return_counts=True)
        more = int((left[lengths] // uses).min())
        left[lengths] -= more * uses
        kinds.append((held, 1 + more))
    return kinds


def best_two(left: np.ndarray, gap: int, least: int) -> tuple[int, int] | None:
    """The two lengths left whose sum is largest within ``gap`` and above ``least``; None if there are none."""
    have = np.flatnonzero(left[: gap + 1])
    if not len(have):
        return None
    # the longest length left that is at most i, for every i up to the gap
    longest = np.zeros(gap + 1, np.int64)
    longest[have] = have
    longest = np.maximum.accumulate(longest)
    partner = longest[gap - have]
    alone = (partner == have) & (left[have] < 2)
    partner[alone] = longest[np.maximum(have[alone] - 1, 0)]
    sums = np.where(partner > 0, have + partner, 0)
    best = int(sums.argmax())
    return (int(have[best]), int(partner[best])) if sums[best] > least else None


def slots(kinds: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows (length, first rank, ranks, first bin, offset) in order of length and rank.

    The piece of rank r within its length takes the slot with first rank <= r < first rank + ranks: it goes
    to bin first bin + r - first rank, at the slot's offset.
    """
    rows, taken, first = [], {}, 0
    for held, bins in kinds:
        offset = 0
        for length in held:
            rank = taken.get(length, 0)
            rows.append((length, rank, bins, first, offset))
            taken[length] = rank + bins
            offset += length
        first += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(batches: Iterator[pa.RecordBatch], where: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Add the sequence and the offset of pieces by their length and rank."""
    starts = where[:, 0] << 48 | where[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        slot = where[np.searchsorted(starts, length << 48 | rank, "right") - 1]
        columns = [batch.column(c) for c in range(batch.num_columns) if batch.schema.names[c] != "rank"]
        names = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(slot[:, 3] + rank - slot[:, 1]), pa.array(slot[:, 4])], names=[*names, "sequence_id", "offset"]
        )


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN
) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Every text's ids end in id 0. A null or empty text is a piece of length 1. Repeated rows, also of one
    id, are documents of their own, null ids too; an empty table gives an empty result; other columns are neither
    read nor returned. Pieces of equal length are exchangeable, and which of them comes first is fixed by a hash.
    """
    cut = stored(pieces(docs, path, id_col, text_col, seq_len))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # seq_len rows at most
    where = slots(plan(counts, seq_len))
    ranked = positions(cut, ["length"], [id_col, "piece", "ids_crc32"], {"rank": F.lit(1)}, sum(counts.values()))
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.withColumn("rank", F.col("rank").cast("long")).mapInArrow(lambda batches: place(batches, where), schema)


@query("op9_best_two_fit")
def op9_best_two_fit(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf, "documents"), public_tokenizers.path(MODEL))
