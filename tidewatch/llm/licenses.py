"""License notices found by a trained paragraph classifier, with DataFrame functions only.

A sparse multinomial logistic regression over word bigrams and trigrams is trained on notices of each
family and on all ordinary paragraphs of the documents that do not calibrate; paragraphs with the same
n-grams of the notices' words are one weighted row. A paragraph's score is the sum of its n-grams' weights: n-grams
are exploded and joined with the small table of weights, so a paragraph without a weighted n-gram,
which is surely unknown, costs no shuffle. The least probability of a family is calibrated on
ordinary paragraphs that were not trained on, and every prediction is confirmed, or not, by comparing
the paragraph with the notices of its family.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.files import stored

UNKNOWN = "unknown"
#: Wording of common notices by family.
NOTICES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
        "This software is licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Content is released under CC BY-NC-SA 4.0 for noncommercial use only.",
        "Released under the Creative Commons BY-NC license.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL version 3.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This software is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
}
#: Words of the notices, as `words` finds them. An n-gram of other words says nothing of a notice.
OWN = sorted({w for texts in NOTICES.values() for t in texts for w in re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", t.lower())})
#: Size of the model: so many n-grams, commonest in all ordinary paragraphs of the fit, beside those of the notices.
COMMON = 4000
HELD = 5  # every fifth document, by the hash of its key, calibrates; all others are trained on
FIT_ROWS = 100_000  # distinct rows of the fit for a task
LEAST, MOST = 0.5, 0.95  # bounds of the calibrated probability
SIMILAR = 0.5  # share of the shorter text's n-grams that confirms


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line of each text, from 0: key, paragraph, words (lower case)."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = docs.select(F.col(key).alias("key"), F.posexplode(lines).alias("paragraph", "line"))
    return rows.select("key", "paragraph", words(F.col("line")).alias("words"))


def words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"([\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*)"), 1)


def ngrams(of: Column) -> Column:
    """Bigrams and trigrams of an array of words."""
    n = F.size(of)
    at = lambda i, k: F.array_join(F.slice(of, i, k), " ")
    two = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: at(i, 2)))
    three = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: at(i, 3)))
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(two, none), F.coalesce(three, none))


def own_ngrams(of: Column) -> Column:
    """Those bigrams and trigrams that consist of words of the notices, as most lines have few."""

    def among(own: Column) -> Column:
        text = F.array_join(F.transform(of, lambda w: F.when(F.array_contains(own, w), w)), " ", "|")
        runs = F.filter(F.split(text, r" ?\| ?"), lambda r: F.contains(r, F.lit(" ")))
        return F.flatten(F.transform(F.transform(runs, lambda r: F.split(r, " ")), ngrams))

    # a lambda's argument is computed once, not once for each word
    return F.flatten(F.transform(F.array(F.array_intersect(of, F.array(*map(F.lit, OWN)))), among))


def notices(spark: SparkSession) -> DataFrame:
    """family, words of the notices."""
    rows = [(f, t) for f, texts in NOTICES.items() for t in texts]
    return spark.createDataFrame(rows, "family string, line string").select("family", words(F.col("line")).alias("words"))


def ordinary(docs: DataFrame, key: str, text: str, held: int) -> DataFrame:
    """words and grams (distinct n-grams of the notices' words, sorted) of all paragraphs that the
    comparison with the notices would not confirm, whatever wording they share with them: those of
    the documents that are trained on, or, with `held`, of the others."""
    known = [r.grams for r in notices(docs.sparkSession).select(F.array_distinct(ngrams(F.col("words"))).alias("grams")).collect()]
    known = F.array(*[F.array(*map(F.lit, g)) for g in known])  # of fixed size
    fold = F.pmod(F.xxhash64(key), F.lit(HELD))
    rows = paragraphs(docs.filter(fold == 0 if held else fold != 0), key, text)
    # an array of one, so that no filter computes it again
    parts = F.transform(
        F.array(F.array_sort(F.array_distinct(own_ngrams(F.col("words"))))),
        lambda g: F.struct(g.alias("grams"), F.when(F.size(g) > 0, F.size(F.array_distinct(ngrams(F.col("words"))))).alias("n")),
    )
    rows = rows.select("words", F.explode(F.array(parts)).alias("x")).select("words", F.col("x")[0].alias("x"))
    grams, n = F.col("x.grams"), F.col("x.n")

    def similar(notice: Column) -> Column:
        least = F.least(n, F.size(notice)) * SIMILAR
        return (F.size(grams) >= least) & (F.size(F.array_intersect(notice, grams)) >= least)

    plain = F.when(F.size(grams) > 0, ~F.exists(known, similar)).otherwise(F.size("words") > 1)
    return rows.filter(plain).select("words", grams.alias("grams"))


def train(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str], list[float]]:
    """Weights (gram, w0, w1, ...) of the n-grams that have any, the families, and the intercepts."""
    spark = docs.sparkSession
    known = notices(spark)
    # whole notices and their halves, as they are often cut
    half = F.ceil(F.size("words") / 2).cast("int")
    long = known.filter(F.size("words") >= 8)
    cut = known.union(long.select("family", F.slice("words", F.lit(1), half))).union(long.select("family", F.slice("words", half, F.size("words"))))
    cut = cut.select("family", F.array_distinct(ngrams(F.col("words"))).alias("grams"), F.lit(1).cast("bigint").alias("n"))
    # paragraphs with the same n-grams are one row; it weighs the root of how many differ in their
    # words, so that the many without any n-gram do not outweigh the wording to be told apart
    apart = F.count_distinct(F.xxhash64("words")).alias("n")
    plain = ordinary(docs, key, text, 0).groupBy("grams").agg(apart).select(F.lit(UNKNOWN).alias("family"), "grams", "n")
    families = [UNKNOWN, *sorted(NOTICES)]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = stored(cut.union(plain).select(label.cast("double").alias("label"), "grams", "n"), "license-training")
    own = [r.gram for r in rows.filter("label > 0").select(F.explode("grams").alias("gram")).distinct().orderBy("gram").collect()]
    counts = rows.filter("label = 0").select(F.explode("grams").alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))
    common = [r.gram for r in counts.filter(~F.col("gram").isin(own)).orderBy(F.desc("n"), "gram").limit(COMMON).collect()]
    vocabulary = [*own, *common]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    # every class weighs alike
    sizes = rows.groupBy("label").agg(F.sum(F.sqrt("n")).alias("all"), F.count(F.lit(1)).alias("rows")).collect()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["label"], 1.0 / r["all"])])
    # few tasks: each sends a gradient an iteration
    tasks = max(2, -(-sum(r["rows"] for r in sizes) // FIT_ROWS))
    weighed = counter.transform(rows).select("label", "features", (F.sqrt("n") * share[F.col("label")]).alias("weight")).repartition(tasks)
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=2e-4, elasticNetParam=0.5, maxIter=80, standardization=False).fit(weighed)
    matrix, intercept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    used = np.flatnonzero((matrix != 0).any(axis=0))
    known_classes = len(matrix)  # labels above the largest one seen have no row
    columns = [matrix[c, used] if c < known_classes else np.zeros(len(used)) for c in range(len(families))]
    table = pa.table({"gram": np.array(vocabulary, dtype=object)[used].tolist()} | {f"w{c}": x for c, x in enumerate(columns)})
    table = table.cast(pa.schema([("gram", pa.string()), *[(f"w{c}", pa.float64()) for c in range(len(families))]]))
    return spark.createDataFrame(table), families, [float(intercept[c]) if c < known_classes else -1e9 for c in range(len(families))]


def rated(rows: DataFrame, weights: DataFrame, families: list[str], intercepts: list[float]) -> DataFrame:
    """key, paragraph, words, family (the likeliest but unknown) and probability of the paragraphs that
    have a weighted n-gram."""
    # all weighted n-grams consist of words of the notices; in an array of one no filter computes them again
    grams = rows.select("key", "paragraph", "words", F.explode(F.array(own_ngrams(F.col("words")))).alias("grams"))
    grams = grams.select("key", "paragraph", "words", F.explode("grams").alias("gram"))
    # the weights are those of the notices and of COMMON other n-grams
    sums = grams.join(F.broadcast(weights), "gram").groupBy("key", "paragraph").agg(
        F.first("words").alias("words"), *[F.sum(f"w{c}").alias(f"s{c}") for c in range(len(families))]
    )
    score = [F.exp(F.least(F.col(f"s{c}") + F.lit(i), F.lit(500.0))) for c, i in enumerate(intercepts)]
    total = score[0]
    for s in score[1:]:
        total = total + s
    best = F.greatest(*[F.struct((s / total).alias("probability"), F.lit(f).alias("family")) for s, f in zip(score[1:], families[1:])])
    return sums.select("key", "paragraph", "words", best.alias("b")).select("key", "paragraph", "words", "b.family", "b.probability")


def calibrated(held: DataFrame, weights: DataFrame, families: list[str], intercepts: list[float]) -> float:
    """The least probability: the highest of the held-out ordinary paragraphs, within LEAST and MOST."""
    rows = held.select(F.monotonically_increasing_id().alias("key"), F.lit(0).alias("paragraph"), "words")
    top = rated(rows, weights, families, intercepts).agg(F.max("probability")).first()[0] or 0.0
    return min(MOST, max(LEAST, float(top)))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The notices found: key, paragraph (number of the line, from 0), family, probability,
    similarity (share of the shorter text's n-grams that the nearest notice of the family has too)
    and confirmed.

    Null and empty texts have one empty paragraph, which is unknown, as is every paragraph of one
    word. The model is trained on the notices above and on all ordinary paragraphs of four documents in
    five, the least probability comes from all those of the others; every paragraph is judged. Repeated keys get
    their paragraphs judged together. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    weights, families, intercepts = train(docs, key, text)
    weights = stored(weights, "license-weights")
    least = calibrated(ordinary(docs, key, text, 1), weights, families, intercepts)
    found = rated(paragraphs(docs, key, text), weights, families, intercepts).filter(F.col("probability") >= least)
    known = notices(spark).select("family", ngrams(F.col("words")).alias("notice"))
    both = found.join(F.broadcast(known), "family")  # a notice's own words
    own = F.array_distinct(ngrams(F.col("words")))
    share = F.size(F.array_intersect(own, "notice")) / F.least(F.size(own), F.size(F.array_distinct("notice")))
    out = both.groupBy("key", "paragraph", "family", "probability").agg(F.max(share).alias("similarity"))
    return out.withColumn("confirmed", F.col("similarity") >= SIMILAR).withColumnRenamed("key", key)


def license_families(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every key with n_notices (confirmed ones) and families, sorted and comma-joined (`unknown`
    without any)."""
    found = scan_licenses(docs, key, text).filter("confirmed")
    per = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_notices"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))
    out = docs.select(key).join(per, key, "left")
    return out.select(key, F.coalesce("n_notices", F.lit(0)).cast("bigint").alias("n_notices"), F.coalesce("families", F.lit(UNKNOWN)).alias("families"))
