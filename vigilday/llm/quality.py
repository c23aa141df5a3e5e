"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, all of its text. Every passage is encoded: hashed byte pairs and
character classes, then a learned layer. Gated attention, learned from the documents' labels alone, weighs
the passages; the weighted sum of their encodings is scored. Only the text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from vigilday.functions.storage import stored
from vigilday.llm.common import table
from vigilday.llm.registry import query

PASSAGE = 1024
PAIRS = 256
SHRINK = 64
HIDDEN, GATE = 32, 16
SEED = 7
EPOCHS, BATCH, RATE, DECAY = 40, 64, 0.01, 1e-5
# labelled documents of each class that the model is fitted on, and passages of all those of a class together
SAMPLE, SAMPLE_PASSAGES = 3000, 30_000
THRESHOLD = 0.3
# passages of a text that are encoded at a time
CHUNK = 512
# Character classes of bytes, later ones take precedence.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\r", b".,;:!?'\"()-", bytes(range(128, 256)))
WIDTH = PAIRS + len(CLASSES) + 3

_class = np.full(256, len(CLASSES), np.int64)
for _number, _bytes in enumerate(CLASSES):
    _class[list(_bytes)] = _number
# a pair of bytes falls into one of PAIRS columns
_column = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIRS


def passages(text: bytes) -> int:
    """Number of passages of a text; an empty one has one."""
    return max(1, -(-len(text) // PASSAGE))


def encode(text: bytes) -> np.ndarray:
    """One row per passage: square roots of its shares of byte pairs and classes, their evenness, its length."""
    n = passages(text)
    codes = np.frombuffer(text, np.uint8).astype(np.int64)
    place = np.arange(len(codes)) // PASSAGE
    pairs = np.bincount(place[1:] * PAIRS + _column[codes[:-1] << 8 | codes[1:]], minlength=n * PAIRS).reshape(n, PAIRS) if len(codes) > 1 else np.zeros((n, PAIRS))
    border = np.arange(PASSAGE, len(codes), PASSAGE)
    pairs[border // PASSAGE, _column[codes[border - 1] << 8 | codes[border]]] -= 1  # a pair across two passages is in neither
    kinds = len(CLASSES) + 1
    classes = np.bincount(place * kinds + _class[codes], minlength=n * kinds).reshape(n, kinds)
    seen = pairs.sum(1, keepdims=True)
    share = pairs / np.maximum(1, seen)
    even = -(share * np.log(np.maximum(share, 1e-12))).sum(1, keepdims=True) / np.log(np.clip(seen, 2, PAIRS))
    length = classes.sum(1, keepdims=True)
    # few pairs say little: their shares are drawn towards 0
    return np.hstack([np.sqrt(pairs / (seen + SHRINK)), np.sqrt(classes / np.maximum(1, length)), even, length / PASSAGE])


class AttentionModel:
    """Encoder layer, gated attention and score of a bag of passages, with its gradient."""

    NAMES = ("W", "c", "V", "bv", "U", "bu", "w", "u", "b")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def start(cls, seed: int) -> AttentionModel:
        rng = np.random.default_rng(seed)
        shapes = {"W": (WIDTH, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "u": (HIDDEN,)}
        weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
        return cls(weights | {"c": np.zeros(HIDDEN), "bv": np.zeros(GATE), "bu": np.zeros(GATE), "b": np.zeros(1)})

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["W"] + p["c"])
        a, g = np.tanh(h @ p["V"] + p["bv"]), 1 / (1 + np.exp(-(h @ p["U"] + p["bu"])))
        return h, a, g, (a * g) @ p["w"]

    def score(self, text: bytes) -> float:
        """Score of a whole text. Passages come in chunks; the softmax over all of them is carried along."""
        top, weight, total = -np.inf, 0.0, np.zeros(HIDDEN)
        for at in range(0, max(1, len(text)), CHUNK * PASSAGE):
            h, _, _, e = self.hidden(encode(text[at : at + CHUNK * PASSAGE]))
            new = max(top, float(e.max()))
            part = np.exp(e - new)
            weight = weight * np.exp(top - new) + part.sum()
            total = total * np.exp(top - new) + part @ h
            top = new
        p = self.weights
        return float(1 / (1 + np.exp(-(total / weight @ p["u"] + p["b"][0]))))

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted mean log loss over bags; ``starts`` are the bags' first rows."""
        p = self.weights
        bag = np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
        h, a, g, e = self.hidden(x)
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        att = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(att[:, None] * h, starts)
        score = 1 / (1 + np.exp(-(z @ p["u"] + p["b"])))
        dl = importance * (score - y) / importance.sum()
        dz = dl[:, None] * p["u"]
        da = (dz[bag] * h).sum(1)
        de = att * (da - np.add.reduceat(att * da, starts)[bag])
        dag = de[:, None] * p["w"]
        dpa, dpg = dag * g * (1 - a * a), dag * a * g * (1 - g)
        dh = (att[:, None] * dz[bag] + dpa @ p["V"].T + dpg @ p["U"].T) * (1 - h * h)
        return {
            "W": x.T @ dh, "c": dh.sum(0), "V": h.T @ dpa, "bv": dpa.sum(0), "U": h.T @ dpg, "bu": dpg.sum(0),
            "w": (a * g).T @ de, "u": z.T @ dl, "b": dl.sum(keepdims=True),
        }

    @classmethod
    def fit(cls, bags: list[np.ndarray], y: np.ndarray, importance: np.ndarray, seed: int = SEED) -> AttentionModel:
        """Adam over shuffled batches of bags; without any bag the model scores one half."""
        model, rng = cls.start(seed), np.random.default_rng(seed)
        if not len(bags):
            return cls({k: np.zeros_like(v) for k, v in model.weights.items()})
        first = {k: np.zeros_like(v) for k, v in model.weights.items()}
        second = {k: np.zeros_like(v) for k, v in model.weights.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                x = np.concatenate([bags[i] for i in part])
                starts = np.concatenate([[0], np.cumsum([len(bags[i]) for i in part])[:-1]])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, grad in model.gradient(x, starts, y[part], importance[part]).items():
                    grad = grad + DECAY * model.weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    model.weights[k] = model.weights[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
        return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from fitting: crc32 of its id as text is divisible by 5 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All passages of sampled documents, encoded, as bytes."""
    for batch in batches:
        bags = []
        for value in batch.column("text"):
            text = value.as_buffer().to_pybytes() if value.is_valid else b""
            bags.append(encode(text).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").cast(pa.string()), batch.column("label"), batch.column("importance"), pa.array(bags, pa.binary())],
            names=["id", "label", "importance", "bag"],
        )


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["id"], r["label"], r["bag"]))
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, WIDTH).astype(float) for r in rows]
    model = AttentionModel.fit(bags, np.array([r["label"] for r in rows], float), np.array([r["importance"] for r in rows], float))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([model.weights[k].ravel().tolist() for k in AttentionModel.NAMES], pa.list_(pa.float64())),
            pa.array(list(AttentionModel.NAMES)),
        ],
        names=["value", "name"],
    )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AttentionModel:
    """Fit on at most ``SAMPLE`` labelled documents of each class, those with the least hash of their id.

    They are whole texts: those of over a tenth of ``SAMPLE_PASSAGES`` are passed over, the others are taken in the order of
    the hash until the class has ``SAMPLE_PASSAGES`` passages. Held-out documents, null labels and ids, and labels other than 0 and 1 are
    left out. Each class counts as often as it occurs among all labels used, so that scores are probabilities. The sample
    is bounded, so one task fits it; the weights, some ten thousand numbers, are all that the driver sees.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id"))
    )
    by_hash = F.xxhash64(F.lit(SEED), "id")
    first = [known.filter(F.col("label") == c).orderBy(by_hash, "id").limit(SAMPLE) for c in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE))
    sized = texts.join(F.broadcast(first[0].union(first[1])), "id").groupBy("id", "label").agg(F.sum(size).alias("n"))
    # 2 * SAMPLE rows at most: one task adds them up
    fitting = Window.partitionBy("label").orderBy(by_hash, "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = sized.filter(F.col("n") <= SAMPLE_PASSAGES // 10).withColumn("upto", F.sum("n").over(fitting))
    chosen = small.filter(F.col("upto") <= SAMPLE_PASSAGES)
    counts = known.groupBy("label").agg(F.count("*").alias("all"))
    used = chosen.groupBy("label").agg(F.count("*").alias("used"))
    weight = counts.join(used, "label").select("label", (F.col("all") / F.col("used")).alias("importance"))
    chosen = stored(chosen.join(weight, "label").select("id", "label", "importance"))
    sample = texts.join(F.broadcast(chosen), "id")  # 2 * SAMPLE ids at most
    encoded = sample.select("id", "label", "importance", "text").mapInArrow(
        _bags, "id string, label int, importance double, bag binary"
    )
    fitted = encoded.repartition(1).mapInArrow(_fit, "value array<double>, name string")
    weights = {r["name"]: np.array(r["value"]) for r in fitted.collect()}
    shapes = AttentionModel.start(SEED).weights
    return AttentionModel({k: weights[k].reshape(shapes[k].shape) for k in AttentionModel.NAMES})


def scores(text: Column, model: AttentionModel) -> Column:
    """The score of a whole text, from 0 to 1; null counts as empty."""

    @arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.binary())])

    return score(text)


def score_documents(
    docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score``, ``predicted``.

    Null and empty texts get the score of a passage without characters. Repeated rows score alike, a null id is never
    held out, an empty table gives an empty result, and other columns are neither read nor returned. Without any
    usable label every score is one half.
    """
    model = train(docs, labels, label, id_col, text_col)
    scored = docs.select(F.col(id_col).alias("id"), scores(F.col(text_col), model).alias("score"))
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows the classifier rejects, all columns as they came."""
    model = train(docs, labels, "quality", id_col, text_col)
    name = f"_score_{len(docs.columns)}"
    return docs.withColumn(name, scores(F.col(text_col), model)).filter(F.col(name) >= threshold).select(*docs.columns)


@query("op7_attention_quality")
def op7_attention_quality(spark: SparkSession, sf: str) -> DataFrame:
    return score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))
