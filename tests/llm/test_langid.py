"""Language spans against a plain Viterbi, and on held-out labels."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilday.llm import langid
from vigilday.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"
RUSSIAN = "привет мир это просто текст на русском языке"
ENGLISH = "this is the plain english text with some words"
FRENCH = "voici une phrase écrite dans la langue française"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(1, RUSSIAN, "ru"), (2, ENGLISH, "en"), (3, FRENCH, "fr"), (4, None, "en"), (5, "", "fr"), (6, "x", None)] * 3
    return langid.fit(spark.createDataFrame(rows, DOCS))


def test_path_equals_plain_viterbi():
    rng = np.random.default_rng(3)
    for penalty in (0.0, 1.0, 5.0):
        counts = rng.integers(0, 12, 40)
        scores = rng.integers(-6, 1, (int(counts.sum()), 3)).astype(float)
        prior = np.array([-1.0, -1.5, -2.0])
        got, at = langid.best_path(scores, counts, prior, penalty), 0
        for n in counts.tolist():
            own, path = scores[at : at + n], got[at : at + n]
            cost = lambda p: prior[p[0]] + sum(own[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
            at += n
            if n:
                value = prior + own[0]
                for row in own[1:]:
                    value = np.maximum(value, value.max() - penalty) + row
                assert math.isclose(cost(path), value.max())


def test_counts_equal_brute_force(spark, model):
    words = [w.lower() for w in FRENCH.split()] * 3
    counts = np.zeros(langid.BUCKETS)
    for w in words:
        for bucket in langid.grams([w])[0]:
            counts[bucket] += 1
    want = np.log((counts + langid.SMOOTHING) / (counts + langid.SMOOTHING).sum())
    assert model.langs == ["en", "fr", "ru"] and np.allclose(model.logs[:, 1], want, atol=1e-4)
    assert sum(map(len, words)) == counts.sum()


def test_scripts_narrow_the_candidates(model):
    scores, sizes = model.scores(["мир", "english", "漢字"])
    assert (scores[0][:2] < -1e5).all() and scores[1][2] < -1e5 and (scores[2] == 0).all()
    assert sizes.tolist() == [3, 7, 2]


def test_spans_of_a_mixed_text(model):
    text = f"1. {ENGLISH}! {RUSSIAN}, {FRENCH}."
    (lang, score, spans), = langid.label(model, [text])
    assert [text[s["start"] : s["start"] + s["length"]] for s in spans] == [ENGLISH, RUSSIAN, FRENCH]
    assert [s["lang"] for s in spans] == ["en", "ru", "fr"]
    letters = {s["lang"]: s["letters"] for s in spans}
    assert letters["en"] == sum(map(str.isalpha, ENGLISH)) and lang == max(letters, key=letters.get)
    assert math.isclose(score, letters[lang] / sum(letters.values()))


def test_words_that_are_no_longer_kept_score_the_same(model):
    texts = [ENGLISH, "", RUSSIAN, FRENCH] * 3
    whole = langid.label(model, texts)
    few = langid.Model(model.langs, model.logs, model.scripts, model.prior, kept=1)
    assert [langid.label(few, [t])[0] for t in texts] == whole


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ½ ² _ !", "en"), (4, ENGLISH, None), (4, ENGLISH, None), (None, RUSSIAN, "en"),
            (5, f"½{FRENCH}²", "en"), (6, (ENGLISH + " ") * 3000, "fr"), (7, "漢字", "en"), (8, "İ ﬁ ǅ é́ \x00", "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "id": F.lit(1)})
    trained = spark.createDataFrame([(RUSSIAN, "ru"), (ENGLISH, "en"), (FRENCH, "fr"), (None, "fr"), ("x", None)], "text string, lang string")
    got = langid.identify(docs, trained).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [by_id[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert all(by_id[i]["score"] == 0 and by_id[i]["spans"] == [] for i in (1, 2, 3))
    assert [by_id[i]["lang_pred"] for i in (4, None, 5, 6)] == ["en", "ru", "fr", "en"]
    assert by_id[6]["score"] == 1.0 and by_id[7]["lang_pred"] in ("en", "fr", "ru")
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(docs.limit(0), trained).count() == 0
    none = langid.identify(docs, trained.limit(0)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_query_on_held_out_documents(spark):
    got = QUERIES["op13_language_spans"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    seen = got.join(docs, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert got.count() == docs.count() and seen > 0.97


def test_prediction_reads_no_label(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(1)
    trained = docs.filter("doc_id % 2 = 0").select("text", "lang")
    shuffled = docs.withColumn("lang", F.lit(rng.choice(["de", "fr"])))
    both = [sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(d, trained).collect()) for d in (docs, shuffled)]
    assert both[0] == both[1]
