"""The licence scan is fitted and calibrated on every line."""

from pyspark.sql import functions as F

from vigilday.llm import licenses


def test_licence_model_counts_every_line(spark):
    # 700 documents, more than any sample of 300; every line is its own, but each comes in two documents
    plain = [f"row {i % 350} of a plain text\nand its second line number {i % 350}" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(plain)), "id long, text string")
    seen = licenses.examples(docs)
    assert seen.agg(F.sum("n")).first()[0] == 700
    assert {r["family"] for r in seen.collect()} == {licenses.UNKNOWN}


def test_licence_cut_holds_for_all_lines(spark):
    # near misses stand only in documents that come last by the hash that chose 300 documents before
    near = "the apache tribe {} told its general version of mit software history under review without attribution to any source"
    ids = spark.range(700).withColumn("at", F.xxhash64(F.lit(licenses.SEED), "id")).orderBy("at", "id")
    texts = [(r["id"], f"plain {n}" if n < 300 else "\n".join(near.format(f"x{n}y{j}") for j in range(8))) for n, r in enumerate(ids.collect())]
    scanner = licenses.fit(spark.createDataFrame(texts, "id long, text string"))
    lines = licenses.paragraphs(spark.createDataFrame(texts, "id long, text string")).withColumn("grams", licenses.grams(F.col("line")))
    named = scanner.named(lines).filter(F.col("family") != licenses.UNKNOWN).count()
    assert named <= licenses.FALSE_RATE * lines.count()


def test_example_labels(spark):
    known = licenses.templates(spark).collect()
    found = set(licenses.vocabulary(known))
    label = lambda line: licenses.example(line.lower(), known, found)[0]
    assert all(label(t) == f for f, t in licenses.TEMPLATES)
    assert label("a plain line") == label("...") == licenses.UNKNOWN
    assert label("This work is licensed under the GNU Library General Public License, version 3.") == licenses.UNKNOWN
    assert label("the mit license") is None  # a piece of a template
    pattern = licenses.whole_words({"mit", "by", "license"})
    hits = spark.createDataFrame([("the license.",), ("licensed",), ("2.0license",), ("submit",), ("cc by-nc",), ("",)], "t string")
    assert [r[0] for r in hits.select(F.col("t").rlike(pattern)).collect()] == [True, False, True, False, True, False]


def test_examples_follow_the_definition_by_columns(spark):
    known = licenses.templates(spark).collect()
    found = set(licenses.vocabulary(known))
    lines = [t for _, t in licenses.TEMPLATES] + [t.replace("License", "Licence text") for _, t in licenses.TEMPLATES]
    lines += [" ".join(t.split()[:n]) for _, t in licenses.TEMPLATES for n in (2, 4, 6, 9)] + ["a plain line", "...", "a1license", "2.0license", "by cc", "ÉTÉ GNU"]
    lines += ["This work is licensed under the GNU Library General Public License, version 3.", "gnu lesser general public license, version 3 of affero"]
    lines += [f"{t} and word {i} more" for i, (_, t) in enumerate(licenses.TEMPLATES)]
    lines = sorted(set(lines))
    docs = spark.createDataFrame([("\n".join(lines[i::3]), ) for i in range(3)], "text string")
    frame = licenses.examples(docs)
    # nothing but DataFrame operations: no Python on the executors
    plan = frame._jdf.queryExecution().toString()
    assert not [n for n in ("Python", "MapInArrow", "Pandas") if n in plan]
    want = {}
    for line in lines:
        family, seen = licenses.example(line.lower(), known, found)
        if family is not None:
            key = family, tuple(seen)
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in frame.collect():
        key = r["family"], tuple(r["known"])
        got[key] = got.get(key, 0) + r["n"]
    assert got == want


def test_texts_are_split_into_lines_once(spark, monkeypatch):
    # one pass over the texts for the fit and the lines named, one for notices over several lines
    splits, split = [], licenses.paragraphs
    monkeypatch.setattr(licenses, "paragraphs", lambda docs: (splits.append(1), split(docs))[1])
    text = "a plain line\n// Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."
    found = licenses.scan(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["n_licenses"], r["families"]) for r in found] == [(2, "apache-2.0,mit"), (0, ""), (0, "")]
    assert len(splits) == 1
