"""Language of texts and of the spans within them: script ranges, scores per word, Viterbi with a switching penalty.

A word is a run of letters. Its script decides which languages can have it: those that wrote some of their
training letters in that script. Its score in each of these is the log probability of its character trigrams, word
ends included. The best path over a text's words, where a change of language costs ``PENALTY``, cuts it into
spans; the text's language is the one with most letters in its spans. A model has one number per language and
trigram bucket, so its size does not depend on the data, while its counts are taken over all of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from vigilday.llm.common import table
from vigilday.llm.registry import query

UNKNOWN = "und"
# a model's buckets per language, the count added to each, and what a change of language costs in nats
BUCKETS = 1 << 15
SMOOTHING = 0.5
PENALTY = 12.0
# a language can have words of a script that makes up this share of its training letters
SCRIPT_SHARE = 0.001
# scores of words that a worker keeps, and numbers in one table of scores
KEPT = 200_000
GROUP_SCORES = 1 << 21
WORDS = re.compile(r"([^\W\d_]+)")
# First code points of the letters of scripts, in order; the last of each range is the next one's first.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"),
    (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"),
    (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(name) for _, name in SCRIPTS])


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of words in turn, the word's number for each, and the script of each word's first letter.

    Words are lower-cased and stand between line ends, which no word holds.
    """
    joined = "\n" + "\n".join(map(str.lower, words)) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    inner = np.flatnonzero(points != 10)
    p = np.uint64(0x9E3779B97F4A7C15)
    mixed = ((points[inner - 1] * p + points[inner]) * p + points[inner + 1]) * p
    number = np.cumsum(points == 10)[inner] - 1
    first = np.flatnonzero(points[:-1] == 10)[: len(words)] + 1
    return (mixed >> np.uint64(64 - 15)).astype(np.int64), number, SCRIPT_OF[np.searchsorted(STARTS, points[first], "right") - 1]


def letters_in(word: str) -> int:
    return sum(map(str.isalpha, word))


def _counter(langs: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of (language, cell) over a partition; cells are trigram buckets, then scripts."""
    index = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(langs), BUCKETS + len(NAMES)), np.int64)
        for batch in batches:
            known: dict[str, int] = {}
            spots: list[list[int]] = [[] for _ in langs]
            for text, lang in zip(batch.column("text"), batch.column("lang")):
                words = WORDS.findall(text.as_py() or "")
                spots[index[lang.as_py()]] += [known.setdefault(w, len(known)) for w in words]
            words = [w for w in known if letters_in(w)]
            bucket, number, script = grams(words)
            rows = np.array([known[w] for w in words], np.int64)
            sizes = np.array([letters_in(w) for w in words], np.int64)
            for i, own in enumerate(spots):
                times = np.bincount(np.array(own, np.int64), minlength=len(known))[rows]
                held[i, :BUCKETS] += np.bincount(bucket, times[number], BUCKETS).astype(np.int64)
                held[i, BUCKETS:] += np.bincount(script, times * sizes, len(NAMES)).astype(np.int64)
        lang, cell = np.nonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(held[lang, cell])],
            names=["lang", "cell", "n"],
        )

    return count


@dataclass
class Model:
    """Log probabilities of trigram buckets by language, which scripts a language has, and how common it is."""

    langs: list[str]
    logs: np.ndarray
    scripts: np.ndarray
    prior: np.ndarray
    kept: int = KEPT
    known: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    sizes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "table": None, "sizes": None}

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A score per word and language, and the letters of each word.

        Only languages that have the word's script can have the word, unless none has it: then all have, alike.
        """
        bucket, number, script = grams(words)
        sums = np.zeros((len(words), len(self.langs)))
        if len(number):
            filled, first = np.unique(number, return_index=True)
            sums[filled] = np.add.reduceat(self.logs[bucket], first, axis=0)
        fits = self.scripts[script]
        sums = np.where(fits, sums, -1e6)
        sums[~fits.any(axis=1)] = 0
        return sums.astype(np.float32), np.array([letters_in(w) for w in words], np.int64)

    def rows_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``scores`` of words, most of which were asked for before."""
        if self.table is None or len(self.known) > self.kept:
            self.known, self.table, self.sizes = {}, np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        known = self.known
        before = len(known)
        spots = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        if len(known) > before:
            fresh = list(known)[before:]
            scores, sizes = self.scores(fresh)
            self.table = np.concatenate((self.table, scores))
            self.sizes = np.concatenate((self.sizes, sizes))
        return self.table[spots], self.sizes[spots]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the languages in ``lang_col``, counted over all words of all rows; None without a row.

    Rows with a null language are left out; a null text counts as empty. The counts that reach the driver are
    bounded: languages times (``BUCKETS`` and the scripts).
    """
    rows = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    found = rows.mapInArrow(_counter(langs), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    seen = found.toPandas()
    counts = np.zeros((len(langs), BUCKETS + len(NAMES)))
    counts[seen["lang"], seen["cell"]] = seen["n"]
    held, scripts = counts[:, :BUCKETS] + SMOOTHING, counts[:, BUCKETS:]
    letters = scripts.sum(axis=1)
    return Model(
        langs,
        np.ascontiguousarray(np.log(held / held.sum(axis=1, keepdims=True)).T.astype(np.float32)),
        (scripts > SCRIPT_SHARE * letters[:, None]).T,
        np.log((letters + 1) / (letters + 1).sum()),
    )


def best_path(scores: np.ndarray, counts: np.ndarray, prior: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of every word on the best path of its text; ``counts`` are the words of each text in turn.

    All texts take a step together, the longest first; of equal paths the one that stays, then the smaller language, wins.
    """
    order = np.argsort(-counts, kind="stable")
    lengths = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), "left")
    best_before = np.zeros(len(scores), np.int16)
    stays = np.zeros(scores.shape, bool)
    value = np.zeros((len(counts), len(prior)))
    value[:] = prior
    for t in range(steps):
        n = alive[t]
        spots, own = first[:n] + t, value[:n]
        if t:
            best = own.argmax(axis=1)
            moved = own[np.arange(n), best][:, None] - penalty
            stays[spots] = own >= moved
            best_before[spots] = best
            own = np.maximum(own, moved)
        value[:n] = own + scores[spots]
    out = np.zeros(len(scores), np.int16)
    lang = value.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        spots = first[:n] + t
        out[spots] = lang[:n]
        if t:
            lang[:n] = np.where(stays[spots, lang[:n]], lang[:n], best_before[spots])
    return out


SPAN = StructType([
    StructField("lang", StringType()), StructField("start", IntegerType()), StructField("length", IntegerType()),
    StructField("letters", IntegerType()),
])
LABELLED = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(SPAN))])


def label(model: Model, texts: list[str]) -> list[tuple[str, float, list[dict]]]:
    """(language, its share of the letters, spans) of each text."""
    cut = [WORDS.split(t) for t in texts]
    words = [[w for w in c[1::2] if letters_in(w)] if any(not w.isalpha() for w in c[1::2]) else c[1::2] for c in cut]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    scores, sizes = model.rows_of([w for own in words for w in own])
    path = best_path(scores, counts, model.prior)
    out, at = [], 0
    for pieces, own, n in zip(cut, words, counts.tolist()):
        if not n:
            out.append((UNKNOWN, 0.0, []))
            continue
        langs, letters = path[at : at + n], sizes[at : at + n]
        at += n
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))[1::2]
        starts = ends - np.fromiter(map(len, pieces[1::2]), np.int64, len(ends))
        if len(ends) != n:
            kept = [i for i, w in enumerate(pieces[1::2]) if letters_in(w)]
            starts, ends = starts[kept], ends[kept]
        change = np.flatnonzero(np.diff(langs)) + 1
        from_, to = np.concatenate(([0], change)), np.concatenate((change, [n]))
        in_span = np.add.reduceat(letters, from_)
        total = np.bincount(langs, letters, len(model.langs))
        top = int(total.argmax())
        spans = [
            {"lang": model.langs[langs[a]], "start": int(starts[a]), "length": int(ends[b - 1] - starts[a]), "letters": int(k)}
            for a, b, k in zip(from_.tolist(), to.tolist(), in_span.tolist())
        ]
        out.append((model.langs[top], float(total[top] / total.sum()), spans))
    return out


def language(text: Column, model: Model | None) -> Column:
    """A struct per text: ``lang_pred``, ``score``, ``spans`` (lang, start and length in code points, letters).

    A text without letters (null, empty) is ``und`` with score 0 and no span; without a model all are.
    """
    if model is None:
        none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(ArrayType(SPAN)).alias("spans"))
        return none

    @arrow_udf(LABELLED)
    def labelled(texts: pa.Array) -> pa.Array:
        found: list[tuple[str, float, list[dict]]] = []
        group, size = [], 0
        for value in texts:
            text = value.as_py() or ""
            # a word needs a letter and something else at least, so this is no less than the number of words
            upper = (len(text) + 1) // 2 * len(model.langs)
            if group and size + upper > 2 * GROUP_SCORES:
                found += label(model, group)
                group, size = [], 0
            group.append(text)
            size += upper
        found += label(model, group)
        langs, scores, spans = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.struct([
                ("lang", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("letters", pa.int32()),
            ])))],
            LABELLED.names,
        )

    return labelled(text)


def identify(
    docs: DataFrame, trained: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score`` (share of its letters), ``spans``; learned from ``trained``.

    Of ``docs`` only id and text are read, of ``trained`` only text and language. Repeated rows and null ids come out as they came in,
    an empty table gives an empty result. One pass over each, without a shuffle of texts.
    """
    model = fit(trained, text_col, lang_col)
    found = docs.select(F.col(id_col).alias(id_col), language(F.col(text_col), model).alias("_found"))
    return found.select(id_col, "_found.lang_pred", "_found.score", "_found.spans")


def fold(key: Column) -> Column:
    """Remainder of the crc32 of ``key`` (as text) by 3."""
    return F.crc32(key.cast("string").cast("binary")) % 3


@query("op13_language_spans")
def op13_language_spans(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    # a null id belongs to no fold: it is not learned from, and not held out
    found = identify(docs, docs.filter(fold(F.col("doc_id")) != 1).select("text", "lang"))
    return found.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
