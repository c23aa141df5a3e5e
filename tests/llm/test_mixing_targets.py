"""Targets and taken words of the mix recomputed from their definition; small sources; empty tables."""

import re

import pytest
from pyspark.sql import functions as F

from vigilday.llm import mixing, packing, quality, sharding, simhash, tokencount

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """Sources by name (None last): shares by weight, stopped at ``epochs`` times the size, the excess shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = total - sum(stopped.values())
        open_ = [s for s in names if s not in stopped]
        shares = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s: float(epochs * sizes[s]) for s in open_ if shares[s] > epochs * sizes[s]}
        if not over:
            return {**shares, **stopped}
        stopped |= over


def check(spark, docs, near):
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(frame).toPandas()
    size = {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    source = {d: s for d, _, s in docs}
    sizes = {}
    for d, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[d]
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows.itertuples():
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= max(1, near * want[s]), (s, n, want[s])


def test_small_sources_are_taken_near_their_targets(spark):
    check(spark, [(i, " ".join(f"w{k}" for k in range(20)), f"s{i:02}") for i in range(60)], 0.1)
    check(spark, [(i, " ".join(["é"] * (i + 1)), f"s{i:03}") for i in range(100)], 0.1)


def test_mixed_sizes_null_source_and_excess(spark):
    docs = [(i, "a b\tc\n" * (1 + i * 7 % 50), ["x", "y", None][i % 3]) for i in range(300)]
    docs += [(1000, "lone", "a"), (1001, None, "b"), (1002, " \t", "c"), (1003, "word " * 30000, "z")]
    check(spark, docs, 0.05)


def test_texts_are_split_once(spark):
    # the words of a mixed text are bound before its pieces are cut: one split stands in the plan of each new text
    docs = spark.createDataFrame([(1, "w " * 3000, "a"), (2, "v " * 9000, "b")], "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(docs)
    texts = {r["doc_id"]: r["text"].split() for r in mixed.collect()}
    assert set(texts) == {1, 2} and set(texts[1]) == {"w"}


def test_empty_tables(spark):
    import public_tokenizers

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_documents(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0 and simhash.keep_one(docs).count() == 0
    assert quality.keep_good(docs, labels).count() == 0
    assert packing.pack(docs, public_tokenizers.path(packing.MODEL)).count() == 0
    assert tokencount.count_tokens(docs, public_tokenizers.path(tokencount.MODEL)).count() == 0
    assert sharding.shuffled_shards(docs).count() == 0


def test_whole_labelled_texts_are_fitted(spark, monkeypatch):
    long = "some words and 12 more. " * 2000
    docs = spark.createDataFrame([(i, long if i % 2 else "short", None) for i in range(40)], "doc_id long, text string, x string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.train(docs, labels)
    assert model.score(long.encode()) > 0.9 > 0.1 > model.score(b"short")
    batch = docs.filter("doc_id = 1").select(
        F.col("doc_id").alias("id"), F.lit(1).alias("label"), F.lit(1.0).alias("importance"), F.col("text").cast("binary").alias("text")
    )
    bag = batch.mapInArrow(quality._bags, "id string, label int, importance double, bag binary").first()["bag"]
    assert len(bag) // 4 // quality.WIDTH == quality.passages(long.encode()) > 16
