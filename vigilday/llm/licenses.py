"""License scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs (lines, and lines joined with those after them, as notices are often wrapped) are described by their words and word pairs, as a sparse vector of hashed n-grams. A
multinomial logistic regression, fitted on licence templates and on paragraphs of the corpus, names the licence family
or none. How sure it must be is calibrated on paragraphs kept from fitting. A named paragraph counts as confirmed if
it holds enough of the n-grams of a template of its family, and those that tell the family from its relatives. Everything is DataFrame expressions and ``spark.ml``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vigilday.functions.storage import stored
from vigilday.llm.common import same, table
from vigilday.llm.registry import query

# Short notices by licence family, as they are commonly written.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("bsd-2-clause", "Released under the BSD 2-Clause License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# n-grams that tell a family from its relatives: a template's own ones among them must all be found
DECIDING = {
    "mit": ("mit license", "deal in", "without restriction"),
    "apache-2.0": ("apache license", "version 2.0"),
    "apache-1.1": ("apache license", "version 1.1"),
    "gpl-3.0": ("gnu general", "version 3"),
    "gpl-2.0": ("gnu general", "version 2"),
    "lgpl-3.0": ("gnu lesser", "version 3"),
    "agpl-3.0": ("gnu affero", "version 3"),
    "cc-by-nc-4.0": ("by nc", "nc 4.0", "attribution noncommercial", "noncommercial 4.0"),
    "cc-by-sa-4.0": ("by sa", "sa 4.0", "attribution sharealike", "sharealike 4.0"),
    "cc-by-4.0": ("by 4.0", "attribution 4.0"),
    "bsd-3-clause": ("bsd 3", "3 clause", "redistribution and"),
    "bsd-2-clause": ("bsd 2", "2 clause"),
    "mpl-2.0": ("mozilla public", "v 2.0"),
}
# n-grams that must not be found: a relative's name
BARRED = {
    "gpl-3.0": ("gnu lesser", "gnu affero", "gnu library"),
    "gpl-2.0": ("gnu lesser", "gnu affero", "gnu library"),
    "lgpl-3.0": ("gnu affero",),
    "agpl-3.0": ("gnu lesser",),
}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *sorted({family for family, _ in TEMPLATES}))
# different examples in a partition, at most about
TOGETHER = 100_000
# share of a template's n-grams that make a paragraph an example of its family, and below which it is an example of none
EXAMPLE, NO_EXAMPLE = 0.8, 0.5
# share of a paragraph's own n-grams that lie in one template, from which it may be a piece of a wrapped notice
PIECE = 0.5
# share of the calibration paragraphs without a licence that may be named one
FALSE_RATE = 0.001
# share of a template's n-grams that a named paragraph must hold to be confirmed
CONFIRMED = 0.8
PENALTY = 3e-3
SEED = 8


WORDS = "[a-z0-9]+(?:[.][0-9]+)*"


def grams(text: Column) -> Column:
    """Distinct words and word pairs of a paragraph; words are ASCII letters and digits, numbers keep their points."""
    return grams_of(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))


def grams_of(found: Column) -> Column:
    """Distinct words and word pairs of an array of words."""
    rest = F.greatest(F.size(found) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(found, F.lit(1), rest), F.slice(found, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(found, pairs))


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(TEMPLATES), "family string, template string")
    return rows.withColumn("marks", grams(F.col("template")))


def likeness(marks: Column, found: Column) -> Column:
    """Share of a template's n-grams among those found."""
    return F.size(F.array_intersect(marks, found)) / F.size(marks)


def decided(family: str, marks: list[str], found: Column) -> Column:
    """Whether the n-grams found hold all that tell a template of ``marks`` from other families, and none of a relative."""
    needed = [m for m in DECIDING[family] if m in marks]
    barred = BARRED.get(family, ())
    held = F.size(F.array_intersect(F.array(*[F.lit(m) for m in needed]), found)) == len(needed)
    return held & ~F.arrays_overlap(F.array(*[F.lit(m) for m in barred]), found) if barred else held


NAMES = {w.lower() for _, t in TEMPLATES for w in re.findall(r"\b[A-Z]{2,}\b", t)}


def telling(gram: str) -> str | None:
    """The word of an n-gram that tells most: a capital name, or else the longest word, of five letters at least."""
    words = gram.split(" ")
    return next((w for w in words if w in NAMES), max((w for w in words if len(w) > 4 and w.isalpha()), key=len, default=None))


class Scanner:
    """A fitted model: its vocabulary, its weights, and the chance from which a paragraph is named."""

    def __init__(self, vectors: CountVectorizerModel, model: LogisticRegressionModel, cut: float):
        self.vectors, self.model, self.cut = vectors, model, cut
        self.anchors = self.needed()

    def named(self, paragraphs: DataFrame) -> DataFrame:
        """Add ``family`` and ``chance`` to rows with ``grams``."""
        scored = self.model.transform(self.vectors.transform(paragraphs))
        chances = vector_to_array("probability")
        licensed = F.slice(chances, 2, len(FAMILIES) - 1)
        best = F.array_position(licensed, F.array_max(licensed))
        chance = 1 - chances[0]
        family = F.when(chance >= self.cut, F.element_at(F.array(*[F.lit(f) for f in FAMILIES[1:]]), best.cast("int")))
        return scored.select(*paragraphs.columns, F.coalesce(family, F.lit(UNKNOWN)).alias("family"), chance.alias("chance"))

    def needed(self) -> list[str]:
        """Words of which a paragraph must hold one to be named, by the weights alone.

        Taking out the n-grams that speak most for a licence, one after the other, until the sum of what the
        others can give any family stays below the cut: a paragraph without those taken out cannot be named.
        """
        import numpy as np

        weights = self.model.coefficientMatrix.toArray()
        offset = self.model.interceptVector.toArray()
        gain = np.maximum(0, weights[1:] - weights[0])
        least = np.log(self.cut / (1 - self.cut)) - np.log(len(FAMILIES) - 1)
        base = offset[1:] - offset[0]
        order = np.argsort(-gain.max(0), kind="stable")
        for taken in range(len(order) + 1):
            if (base + gain[:, order[taken:]].sum(1) < least).all():
                break
        return sorted({telling(self.vectors.vocabulary[i]) for i in order[:taken]})


def paragraphs(docs: DataFrame) -> DataFrame:
    """Rows (all columns but ``text``, ``place``, ``line``) of the lines of ``text``."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, F.posexplode(F.split("text", "\n")).alias("place", "line"))


def wrapped(docs: DataFrame) -> DataFrame:
    """Rows (all columns but ``text``, ``place``, ``tokens``): every line of ``text`` with what follows it.

    ``tokens`` are the words of the line, and twice the longest template's of the lines after it, with each line break as a token, so that a
    notice wrapped at any width, one word a line even, lies whole in the row of its first line.
    """
    others = [c for c in docs.columns if c != "text"]
    span = 4 * max(len(re.findall(WORDS, t.lower())) for _, t in TEMPLATES)
    split = docs.withColumn("_all", F.regexp_extract_all(F.lower("text"), F.lit(f"\n|{WORDS}"), F.lit(0)))
    # where the lines begin, counted from 0, and the end of the last one
    breaks = F.filter(F.transform("_all", lambda t, i: F.when(t == "\n", i + 1)), lambda i: i.isNotNull())
    split = split.withColumn("_from", F.concat(F.array(F.lit(0)), breaks))
    ends = F.concat(F.slice("_from", 2, F.size("_from")), F.array(F.size("_all")))
    rows = F.zip_with("_from", ends, lambda a, b: F.slice("_all", a + 1, b - a + span))
    return split.select(*others, F.posexplode(rows).alias("place", "tokens"))


def deciding() -> str:
    """A pattern that a lower-cased text must match to hold a deciding n-gram of every template it could be confirmed by.

    Words of an n-gram follow each other with anything but letters and digits between them, line breaks too.
    """
    firsts = set()
    for family, template in TEMPLATES:
        found = re.findall(WORDS, template.lower())
        marks = {*found, *(f"{a} {b}" for a, b in zip(found, found[1:]))}
        firsts.add(next(m for m in DECIDING[family] if m in marks))
    return from_word_starts("[^a-z0-9]+".join(map(re.escape, m.split())) for m in firsts)


def joined(rows: DataFrame, scanner: Scanner) -> DataFrame:
    """Notices that go over several lines: rows (id, key, ``place``, ``last``, ``family``, ``chance``) of the first and last line.

    Only texts that hold a deciding n-gram are cut into lines with those after them.

    A line begins a notice if the fewest lines from it on that hold a template do so (as for single lines), and not from the next line on.
    The model must name them, as any licence. Notices of a family that are confirmed from consecutive lines on are one.
    """
    rows = rows.filter(F.lower("text").rlike(deciding()))
    able = wrapped(rows).filter(F.arrays_overlap("tokens", F.array(*[F.lit(a) for a in scanner.anchors]).cast("array<string>")))
    words = lambda t: F.filter(t, lambda w: w != "\n")
    able = able.withColumn("grams", grams_of(words(F.col("tokens"))))
    known = templates(rows.sparkSession).collect()  # the templates, fixed values
    marks = lambda r: F.array(*[F.lit(m) for m in r["marks"]])
    likely = F.array(*[F.when(likeness(marks(r), F.col("grams")) >= CONFIRMED, F.lit(i)) for i, r in enumerate(known)])
    some = able.withColumn("t", F.explode(F.filter(likely, lambda i: i.isNotNull()))).drop("grams")
    # the beginnings of the row by whole lines, from the fewest lines on
    cuts = F.concat(
        F.filter(F.transform("tokens", lambda t, i: F.when(t == "\n", i)), lambda i: i.isNotNull()), F.array(F.size("tokens"))
    )
    some = some.select("*", F.posexplode(cuts).alias("more", "size"))
    some = some.withColumn("grams", grams_of(words(F.slice("tokens", F.lit(1), F.col("size")))))
    holds = F.lit(False)
    for i, r in enumerate(known):
        holds = F.when(F.col("t") == i, (likeness(marks(r), F.col("grams")) >= CONFIRMED) & decided(r["family"], r["marks"], F.col("grams"))).otherwise(holds)
    family = F.element_at(F.array(*[F.lit(r["family"]) for r in known]), F.col("t") + 1)
    held = some.filter(holds).withColumn("of", family).groupBy("id", "key", "place", "of").agg(
        F.min_by(F.struct("more", "grams"), "more").alias("first")
    )
    named = scanner.named(held.select("id", "key", "place", "of", F.col("first.more").alias("more"), F.col("first.grams").alias("grams")))
    named = stored(
        named.filter(F.col("family") != UNKNOWN).select("id", "key", "place", (F.col("place") + F.col("more")).alias("last"), F.col("of").alias("family"), "chance")
    )
    later = named.select("id", "key", (F.col("place") - 1).alias("place"), "family")
    ends = named.alias("a").join(later.alias("b"), same("a", "b", ["id", "key", "place", "family"]), "left_anti")
    return ends.filter("last > place")


def from_word_starts(patterns: Iterable[str]) -> str:
    """A pattern for any of ``patterns``, each of which begins with a letter, where a word of :data:`WORDS` can begin.

    They are sorted by that letter, and a place without one of these letters is passed over at once.
    """
    begins: dict[str, list[str]] = {}
    for pattern in sorted(patterns):
        begins.setdefault(pattern[0], []).append(pattern[1:])
    tails = "|".join(f"(?<={first})(?:{'|'.join(rest)})" for first, rest in begins.items())
    return f"[{''.join(begins)}](?<![a-z].)(?:{tails})" if begins else "(?!)"


def whole_words(words: Iterable[str]) -> str:
    """A pattern that a lower-cased text must match to hold one of the words, which are of letters, as :data:`WORDS` finds them."""
    return f"{from_word_starts(words)}(?![a-z0-9])"


def example(line: str, known: list[Row], found: set[str]) -> tuple[str | None, list[str]]:
    """The family a lower-cased line is an example of (None: of nothing), and its n-grams among ``found``.

    The definition for one line, which :func:`examples` follows by columns.
    """
    words = re.findall(WORDS, line)
    own = {*words, *map(" ".join, zip(words, words[1:]))}
    shared = [len(own.intersection(r["marks"])) for r in known]
    like = [n / len(r["marks"]) for n, r in zip(shared, known)]
    sure = [
        (x, r["family"]) for x, r in zip(like, known)
        if x >= EXAMPLE and own.issuperset({*DECIDING[r["family"]]}.intersection(r["marks"])) and own.isdisjoint(BARRED.get(r["family"], ()))
    ]
    seen = sorted(own & found)
    # near misses, like a template but of another family, are examples of none
    none = not seen or max(like) >= EXAMPLE or (max(like) < NO_EXAMPLE and max(shared) / len(own) < PIECE)
    return max(sure)[1] if sure else UNKNOWN if none else None, seen


def told(docs: DataFrame) -> DataFrame:
    """Every line of ``text`` that is not blank: rows (all other columns, ``place``, ``hash``, ``held``, ``line``).

    ``line`` is the line in lower case, or null if it holds no word by which the model could know an n-gram of it.
    Three in ten lines are held from fitting, by their hash.
    """
    others = [c for c in docs.columns if c != "text"]
    lowered = F.lower("line")
    telling_words = {telling(m) for m in vocabulary(templates(docs.sparkSession).collect())}  # of the templates, fixed values
    return paragraphs(docs).filter(F.trim("line") != "").select(
        *others,
        "place",
        F.xxhash64("line").alias("hash"),
        (F.pmod(F.xxhash64(F.lit(SEED), F.lit("held"), "line"), F.lit(10)) < 3).alias("held"),
        F.when(lowered.rlike(whole_words(telling_words)), lowered).alias("line"),
    )


def examples(docs: DataFrame) -> DataFrame:
    """Every different line of ``text`` that is not blank, by what the model can see of it: see :func:`examples_among`."""
    return examples_among(told(docs.select("text")))


def examples_among(lines: DataFrame) -> DataFrame:
    """Every different line of those :func:`told`, by what the model can see of it: rows (``held``, ``family``, ``known``, ``n``).

    ``n`` lines hold the n-grams ``known`` of the model's vocabulary and no others of it. A line that holds most n-grams of a template, and
    those that decide, is an example of its family; one that holds fewer than half of any, or most but not those that decide, is an example
    of none, the others, and pieces of a template such as the lines of a wrapped notice, are left out. A line without any n-gram of the
    vocabulary is an example of none. Lines are told apart by a hash, so none is shuffled, and judged by their n-grams that stand in any template
    or are barred, and the number of all: lines alike in these are judged once.
    """
    known = templates(lines.sparkSession).collect()  # the templates, fixed values
    found = vocabulary(known)
    heard = sorted({m for r in known for m in r["marks"]}.union(*BARRED.values()))
    own = lines.select("hash", "held", F.coalesce(grams(F.col("line")), F.array().cast("array<string>")).alias("own"))
    own = own.select("hash", "held", F.size("own").alias("size"), F.array_sort(F.filter("own", lambda m: m.isin(heard))).alias("heard"))
    # written, so that what is asked of the families is not asked of every line
    kinds = stored(own.distinct().groupBy("held", "size", "heard").agg(F.count("*").alias("n")))
    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    compared = F.transform(
        F.array(*[
            F.struct(
                F.lit(r["family"]).alias("family"), texts(r["marks"]).alias("marks"), texts(BARRED.get(r["family"], ())).alias("barred"),
                texts(m for m in DECIDING[r["family"]] if m in r["marks"]).alias("needed"),
            )
            for r in known
        ]),
        lambda r: F.struct(
            likeness(r["marks"], F.col("heard")).alias("like"),
            r["family"].alias("family"),
            F.size(F.array_intersect(r["marks"], F.col("heard"))).alias("shared"),
            ((F.size(F.array_except(r["needed"], F.col("heard"))) == 0) & ~F.arrays_overlap(r["barred"], F.col("heard"))).alias("decided"),
        ),
    )
    kinds = kinds.select("*", F.filter("heard", lambda m: m.isin(found)).alias("known"), compared.alias("compared"))
    sure = F.array_max(F.filter("compared", lambda c: c["decided"] & (c["like"] >= EXAMPLE)))
    # near misses, like a template but of another family, are examples of none
    most = F.array_max("compared.like")
    apart = (most < NO_EXAMPLE) & (F.array_max("compared.shared") / F.greatest("size", F.lit(1)) < PIECE)
    none = F.when((F.size("known") == 0) | (most >= EXAMPLE) | apart, F.lit(UNKNOWN))
    judged = kinds.select("held", F.coalesce(sure["family"], none).alias("family"), "known", "n")
    return judged.filter("family is not null").groupBy("held", "family", "known").agg(F.sum("n").alias("n"))


def vocabulary(known: list[Row]) -> list[str]:
    """The n-grams the model knows: those of the templates with a word that tells something."""
    return sorted({m for r in known for m in r["marks"] if telling(m)})


def fit(docs: DataFrame) -> Scanner:
    """Fit and calibrate on the templates and on all lines of ``docs`` (column ``text``): see :func:`fit_lines`."""
    return fit_lines(told(docs.select("text")))


def fit_lines(lines: DataFrame) -> Scanner:
    """Fit and calibrate on the templates and on all lines :func:`told`.

    Every line takes part, as :func:`examples_among` counts them. Each template is an example too, followed by every line of none.
    Four kinds of examples are weighed, so that the many lines of none do not drown the few of a licence: lines of none with n-grams the model
    knows, those without, templates followed by lines, lines of a licence. Each kind weighs the same for each family, and those of none
    as much as all families. Three in ten lines calibrate the cut and are not fitted on: a line counts once there.
    """
    spark = lines.sparkSession
    known = templates(spark)
    seen = stored(examples_among(lines))
    own = seen.filter(~F.col("held")).select(
        "family", F.when(F.col("family") != UNKNOWN, 0).when(F.size("known") > 0, 1).otherwise(2).alias("kind"), F.col("known").alias("grams"), "n"
    )
    found = vocabulary(known.collect())  # the templates, fixed values
    none = own.filter(f"family = '{UNKNOWN}'").select("grams", "n").union(spark.createDataFrame([([], 1)], "grams array<string>, n long"))
    longer = none.join(F.broadcast(known.select("family", "marks")), F.lit(True)).select(
        "family", F.lit(3).alias("kind"),
        F.array_sort(F.array_union("grams", F.array_intersect("marks", F.array(*[F.lit(m) for m in found])))).alias("grams"), "n",
    )
    counted = stored(own.union(longer).groupBy("family", "kind", "grams").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("family", "kind").agg(F.sum("n").alias("total"))  # a row per family and kind
    number = F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1
    weight = F.col("n") / F.col("total") * F.when(F.col("family") == UNKNOWN, len(FAMILIES) - 1).otherwise(1)
    weighed = counted.join(F.broadcast(totals), ["family", "kind"]).select(
        "grams", number.cast("double").alias("label"), weight.alias("weight"), F.xxhash64("family", "kind", "grams").alias("place")
    )
    vectors = CountVectorizerModel.from_vocabulary(found, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    parts = -(-counted.count() // TOGETHER)
    training = vectors.transform(weighed).repartition(parts, "place").sortWithinPartitions("place", "label").select("features", "label", "weight").cache()
    # every family is seen, by its templates, so the classes are numbered as the families are
    model = LogisticRegression(
        family="multinomial", regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=100, weightCol="weight"
    ).fit(training)
    training.unpersist()
    scanner = Scanner(vectors, model, 0.5)
    calibration = scanner.named(seen.filter(F.col("held") & (F.col("family") == UNKNOWN)).select(F.col("known").alias("grams"), "n"))
    high = calibration.agg(F.percentile("chance", 1 - FALSE_RATE, F.col("n"))).first()[0]
    return Scanner(vectors, model, min(0.99, max(0.5, high or 0.0)))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The paragraphs of ``docs`` that are named: ``id``, ``key``, ``place`` (line number from 0), ``last``, ``family``, ``chance``, ``confirmed``.

    Lines by themselves, and notices that are confirmed only over several lines (to line ``last``); unconfirmed lines of those are part of them.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # hashes of all lines, and the few lines the model could name: the texts are split into lines once
    lines = stored(told(rows))
    scanner = fit_lines(lines)
    able = lines.filter(F.col("line").rlike(whole_words(scanner.anchors)))
    named = scanner.named(able.select("id", "key", "place", grams(F.col("line")).alias("grams"))).filter(F.col("family") != UNKNOWN)
    sure = F.lit(False)
    for r in templates(spark).collect():  # the templates, fixed values
        own = F.when(F.col("family") == r["family"], likeness(F.array(*[F.lit(m) for m in r["marks"]]), F.col("grams")))
        sure = sure | ((own >= CONFIRMED) & decided(r["family"], r["marks"], F.col("grams")))
    # rows alike in id and text give equal lines, which count once; texts themselves are not shuffled
    alone = stored(
        named.withColumn("confirmed", F.coalesce(sure, F.lit(False)))
        .select("id", "key", "place", F.col("place").alias("last"), "family", "chance", "confirmed").dropDuplicates(["id", "key", "place"])
    )
    over = joined(rows, scanner).withColumn("confirmed", F.lit(True))
    inside = same("n", "l", ["id", "key"]) & F.col("l.place").between(F.col("n.place"), F.col("n.last"))
    # a line that is confirmed by itself is the notice, not the lines from before it to it
    over = stored(over.alias("n").join(alone.filter("confirmed").alias("l"), inside & (F.col("n.family") == F.col("l.family")), "left_anti"))
    pieces = alone.filter("not confirmed").alias("l").join(over.alias("n"), inside, "left_anti")
    return alone.filter("confirmed").unionByName(pieces).unionByName(over.select(*alone.columns))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_paragraphs``, ``n_licenses`` (confirmed), ``families`` (theirs, sorted), ``n_unconfirmed``, ``max_chance``.

    A null text counts as empty, and an empty text is one paragraph without a licence. Rows alike in id and text
    have the same result; null ids are kept. An empty table gives an empty result; other columns are neither read nor returned.
    """
    found = find(docs, id_col, text_col).groupBy("id", "key").agg(
        F.count_if("confirmed").alias("n_licenses"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count_if(~F.col("confirmed")).alias("n_unconfirmed"),
        F.max("chance").alias("max_chance"),
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("key"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_paragraphs"),
    )
    return rows.alias("a").join(found.alias("b"), same("a", "b", ["id", "key"]), "left").select(
        F.col("a.id").alias(id_col),
        "n_paragraphs",
        F.coalesce("n_licenses", F.lit(0)).alias("n_licenses"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"),
        F.coalesce("max_chance", F.lit(0.0)).alias("max_chance"),
    )


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan(table(spark, sf, "documents"))
