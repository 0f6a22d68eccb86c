"""Licence notices in documents: a trained paragraph classifier, confirmed by comparison with templates.

Features are word n-grams (one to three words) that hold an anchor word, i.e. a word of the templates that is rare in
other paragraphs. A multinomial logistic regression is fitted on the templates, on the templates with each word left
out in turn, on notices of other licences (class unknown), and on a bounded sample of document paragraphs (class none).
A paragraph without an anchor has no feature and belongs to none.

The probability a family needs is calibrated on a fifth of the training rows that the fit does not see. A paragraph
whose best family has less, or shares too few words with every template of it, is a notice of unknown licence.

Only DataFrame functions are used: paragraphs are scored once each, by a join with the table of weights.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.llm.common import cut, hash_sample

NONE, UNKNOWN = "none", "unknown"

# Wording of common licence notices, by SPDX-like family name.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "This project is released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released into the public domain.", "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.", "Copyright. All rights reserved.", "Unauthorized copying of this file is strictly prohibited.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
    UNKNOWN: [
        "Licensed under the Eclipse Public License.", "Released under the zlib license.", "Licensed under the ISC License.",
        "Licensed under the Server Side Public License.", "Distributed under the Boost Software License.",
        "Licensed under the Artistic License.", "Licensed under the SIL Open Font License.",
        "Licensed under the Open Database License.", "Use is subject to license terms.", "See the license for details.",
        "Released under a custom license.", "Licensed under the European Union Public Licence.",
    ],
}


def words_of(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams_of(words: Column, anchors: list[str]) -> Column:
    """Distinct n-grams of one to three words with an anchor among them."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    triples = F.zip_with(pairs, F.slice(words, 3, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    every = F.concat(words, pairs, triples)
    return F.array_distinct(F.filter(every, lambda g: F.exists(F.split(g, " "), lambda w: w.isin(anchors))))


def template_rows(spark: SparkSession) -> DataFrame:
    """(family, template, words)"""
    rows = [F.struct(F.lit(family).alias("family"), F.lit(text).alias("template"))
            for family, texts in TEMPLATES.items() for text in texts]
    table = spark.range(1, numPartitions=1).select(F.explode(F.array(*rows)).alias("row")).select("row.*")
    return table.withColumn("words", words_of("template"))


def paragraphs_of(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select(*keys, F.explode(F.split("text", "\n")).alias("paragraph"))


class Classifier:
    """Anchors, the table of weights, the intercepts by class, and the calibrated limit."""

    def __init__(self, anchors: list[str], weights: DataFrame, intercepts: dict[str, float], limit: float):
        self.anchors, self.weights, self.intercepts, self.limit = anchors, weights, intercepts, limit


def probabilities(rows: DataFrame, model_weights: DataFrame, intercepts: dict[str, float], key: str) -> DataFrame:
    """(key, best class, its probability) from (key, grams); rows without known grams keep the intercepts."""
    names = list(intercepts)
    hits = rows.select(key, F.explode_outer("grams").alias("gram")).join(model_weights, "gram", "left")
    sums = hits.groupBy(key).agg(*[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(len(names))])
    logits = [F.col(f"s{i}") + intercepts[name] for i, name in enumerate(names)]
    best = F.array_max(F.array(*[F.struct(z.alias("z"), F.lit(n).alias("name")) for z, n in zip(logits, names, strict=True)]))
    out = sums.withColumn("best", best)
    total = reduce(Column.__add__, [F.exp(z - F.col("best.z")) for z in logits])
    return out.select(key, F.col("best.name").alias("family"), (1 / total).alias("probability"))


def train(docs: DataFrame, sample_docs: int = 500, rare: float = 0.005, precision: float = 0.95) -> Classifier:
    """`sample_docs` bounds the documents whose paragraphs stand for the class none."""
    spark = docs.sparkSession
    templates = cut(template_rows(spark))
    some = hash_sample(docs.select("doc_id", "text"), "doc_id", sample_docs)
    plain = cut(paragraphs_of(some).withColumn("words", words_of("paragraph")).where(F.size("words") > 0))
    known = [r[0] for r in templates.select(F.explode("words")).distinct().orderBy("col").collect()]
    n = plain.count()
    # licence notices among the sampled paragraphs repeat the templates' phrases: those are no evidence of rarity
    phrases = templates.select(F.explode(grams_of(F.col("words"), known)).alias("g")).where(
        F.size(F.split("g", " ")) == 3).distinct()
    triples = plain.select("paragraph", F.explode(grams_of(F.col("words"), known)).alias("g"))
    notices = cut(triples.join(phrases, "g", "left_semi").select("paragraph").distinct())
    clean = plain.join(notices, "paragraph", "left_anti")
    common = {r["w"] for r in clean.select(F.explode(F.array_distinct("words")).alias("w")).where(F.col("w").isin(known))
              .groupBy("w").count().where(F.col("count") > rare * n).collect()}
    anchors = [w for w in known if w not in common and len(w) > 1 and not w.isdigit()]

    dropped = templates.select("family", "words", F.explode(F.sequence(F.lit(0), F.size("words"))).alias("at")).select(
        "family", F.filter("words", lambda w, i: i != F.col("at")).alias("words"))
    rows = dropped.unionByName(clean.select(F.lit(NONE).alias("family"), "words"))
    names = sorted([*TEMPLATES, NONE])
    number = F.array_position(F.lit(names), F.col("family")).cast("double") - 1
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "family", number.alias("label"),
                       grams_of(F.col("words"), anchors).alias("grams"),
                       (F.pmod(F.xxhash64("words"), F.lit(5)) == 0).alias("held"))
    # the many paragraphs of class none weigh as much as three families
    rows = cut(rows)
    size = {r["family"]: r["count"] for r in rows.groupBy("family").count().collect()}
    share = 3 * sum(size[f] for f in TEMPLATES) / len(TEMPLATES) / max(size.get(NONE, 0), 1)
    rows = rows.withColumn("weight", F.when(F.col("family") == NONE, share).otherwise(1.0))
    vectorizer = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1, vocabSize=1 << 15).fit(rows)
    fitted = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-4, maxIter=100, standardization=False).fit(
        vectorizer.transform(rows.where(~F.col("held"))))
    classes = names[: fitted.numClasses]
    matrix = fitted.coefficientMatrix.toArray()
    table = [(gram, *[float(x) for x in matrix[:, i]]) for i, gram in enumerate(vectorizer.vocabulary)]
    shape = "gram string, " + ", ".join(f"w{i} double" for i in range(len(classes)))
    weights = cut(spark.createDataFrame(table, shape))
    intercepts = dict(zip(classes, [float(x) for x in fitted.interceptVector], strict=True))

    guesses = probabilities(rows.where("held"), weights, intercepts, "id").withColumnRenamed("family", "guess")
    judged = rows.join(guesses, "id").where(~F.col("guess").isin(NONE, UNKNOWN)).select(
        "probability", (F.col("guess") == F.col("family")).alias("right")).orderBy("probability").collect()
    limit = 0.5
    for i, row in enumerate(judged):  # held-out rows of the templates: a bounded list
        above = judged[i:]
        if row["probability"] >= limit and sum(r["right"] for r in above) >= precision * len(above):
            limit = row["probability"] if i else limit
            break
    return Classifier(anchors, weights, intercepts, min(limit, 0.95))


def paragraph_families(paragraphs: DataFrame, model: Classifier, overlap: float = 0.6) -> DataFrame:
    """(paragraph, family, probability, likeness) of distinct paragraphs that hold an anchor and are not none.

    `likeness` is the largest share of words in common with a template of the family, by the shorter of the two word
    pair sets; below `overlap`, or below the calibrated probability, the family is unknown.
    """
    spark = paragraphs.sparkSession
    words = paragraphs.withColumn("words", words_of("paragraph")).where(
        F.exists("words", lambda w: w.isin(model.anchors)))
    distinct = words.groupBy("paragraph").agg(F.count("*").alias("times")).withColumn("words", words_of("paragraph"))
    rows = distinct.withColumn("grams", grams_of(F.col("words"), model.anchors))
    guess = probabilities(rows, model.weights, model.intercepts, "paragraph").where(F.col("family") != NONE)

    def pairs(words: Column) -> Column:
        return F.array_distinct(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
                                           lambda a, b: F.concat_ws(" ", a, b)))

    own = template_rows(spark).select("family", pairs(F.col("words")).alias("of_template"))
    common = F.size(F.array_intersect(pairs(words_of("paragraph")), "of_template"))
    least = F.least(F.size(pairs(words_of("paragraph"))), F.size("of_template"))
    near = guess.join(own, "family").groupBy("paragraph", "family", "probability").agg(
        F.max(common / F.greatest(least, F.lit(1))).alias("likeness"))
    sure = (F.col("probability") >= model.limit) & (F.col("likeness") >= overlap)
    return near.select("paragraph", F.when(sure, F.col("family")).otherwise(UNKNOWN).alias("family"), "probability", "likeness")


def scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(doc_id, families, n_notices, n_unknown, best_probability) of every document.

    A paragraph stands between line feeds. `families` holds the confirmed ones, sorted; a document without notices has
    an empty array, zero counts and no probability, as have null and empty texts. Rows that repeat id and text give one
    row; texts that share an id each have one. An empty table gives no rows.
    """
    if model is None:
        model = train(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    lines = paragraphs_of(rows, "doc_id", "text_key")
    anchored = cut(lines.withColumn("words", words_of("paragraph")).where(
        F.exists("words", lambda w: w.isin(model.anchors))).groupBy("doc_id", "text_key", "paragraph").agg(
        F.count("*").alias("times")))
    found = anchored.join(paragraph_families(anchored.select("paragraph"), model), "paragraph")
    every = rows.select("doc_id", "text_key", F.lit(None).cast("string").alias("family"), F.lit(0).cast("long").alias("times"),
                        F.lit(None).cast("double").alias("probability")).unionByName(
        found.select("doc_id", "text_key", "family", "times", "probability"))
    is_family = F.col("family") != UNKNOWN
    return every.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_set(F.when(is_family, F.col("family")))).alias("families"),
        F.sum("times").alias("n_notices"),
        F.sum(F.when(F.col("family") == UNKNOWN, F.col("times")).otherwise(0)).alias("n_unknown"),
        F.max("probability").alias("best_probability")).drop("text_key")
