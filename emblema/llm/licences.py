"""Licence scans: a trained classifier of paragraphs, confirmed against templates.

A sparse multinomial logistic regression over word n-grams tells the families of licences, paragraphs of other licences
(``unknown``) and ordinary ones. A prediction whose calibrated chance is below the threshold becomes ``unknown``, and a
family is confirmed if the paragraph shares enough word triples with one of its templates. All work is DataFrame
operations; n-grams that ordinary paragraphs have are no features, so a paragraph without any is ordinary.

Defined cases: a null or empty text has no findings; a null id is carried; repeated rows give repeated findings; an
empty table gives an empty result; further columns are left aside; a paragraph is a line, however long.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emblema.session import settled

#: Usual short notices of public licences.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "This project is licensed under the terms of the MIT license.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GPL version 2.",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
    ),
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL version 3.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License Version 2.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "unknown": (
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This software is proprietary and confidential and is licensed under the terms of the license agreement.",
        "Licensed under the terms of the company license; redistribution requires written permission.",
        "Copyright of the authors. Licensed material, no redistribution without permission.",
        "This work is licensed under a custom license.",
    ),
}
ORDINARY = "none"
#: Bounds of the training set: variants of each template, and ordinary paragraphs of the corpus, chosen by hash.
VARIANTS, ORDINARY_ROWS = 40, 3_000
#: Share of a template's or the paragraph's word triples that confirms a family.
CONFIRMED = 0.5
KEPT_RIGHT = 0.99


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+(?:\.[0-9]+)*"), F.lit(0))


def grams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a blank."""
    if n == 1:
        return tokens
    count = F.size(tokens) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.array_join(F.slice(tokens, k, n), " "))).otherwise(
        F.array().cast("array<string>")
    )


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, paragraph, text``: the lines of each document, numbered from 0."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))


@dataclass
class LicenceModel:
    """Weights of n-grams for each family; ``temperature`` and ``threshold`` calibrate the chances."""

    families: list[str]
    bias: list[float]
    weights: dict[str, list[float]]
    temperature: float = 1.0
    threshold: float = 0.5
    singles: list[str] = field(default_factory=list)

    def chances(self, tokens: Column) -> Column:
        """A chance for each family, in order."""
        features = F.array_distinct(F.concat(grams(tokens, 1), grams(tokens, 2)))
        if not self.weights:
            return softmax(F.array(*[F.lit(float(b)) for b in self.bias]), self.temperature)
        known = F.create_map(*[x for gram, row in self.weights.items() for x in (F.lit(gram), F.array(*[F.lit(float(w)) for w in row]))])
        total = F.aggregate(
            features,
            F.array(*[F.lit(float(b)) for b in self.bias]),
            lambda sums, gram: F.coalesce(F.zip_with(sums, F.element_at(known, gram), lambda a, b: a + b), sums),
        )
        return softmax(total, self.temperature)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is read."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(total: Column, temperature: float) -> Column:
    raised = bound(total, lambda sums: bound(F.array_max(sums), lambda top: F.transform(sums, lambda x: F.exp((x - top) / temperature))))
    return bound(raised, lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda sum_: F.transform(e, lambda x: x / sum_)))


def templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(family).alias("family"), F.lit(text).alias("text")) for family, texts in TEMPLATES.items() for text in texts]
    return spark.range(1).select(F.inline(F.array(*rows)))


def training_rows(docs: DataFrame) -> DataFrame:
    """``family, tokens``: variants of the templates that lack a few words, have foreign ones or stand in longer text, and ordinary paragraphs."""
    spark = docs.sparkSession
    varied = templates(spark).select("family", "text", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v"))
    tokens = words(F.col("text"))
    thinned = F.filter(tokens, lambda w, k: (F.col("v") < 8) | (F.pmod(F.xxhash64(w, k, "v"), F.lit(12)) != 0))
    licence = varied.select("family", thinned.alias("tokens"), "v")
    marks = "(?i)licen[cs]|copyright|permission|rights reserved|public domain|redistribut"
    # the hash takes in id and place, so a line that many documents share gets its share of the sample and no more
    sample = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).where((F.length("text") > 0) & ~F.col("text").rlike(marks))
    ordinary = sample.orderBy(F.xxhash64("doc_id", "at", "text"), "text").limit(ORDINARY_ROWS).select(F.lit(ORDINARY).alias("family"), words(F.col("text")).alias("tokens"), F.lit(0).alias("v"))
    return licence.unionByName(ordinary)


def train(rows: DataFrame, penalty: float = 0.0005) -> LicenceModel:
    """Fitted on three quarters of the variants; the rest calibrates temperature and threshold."""
    rows = settled(rows.withColumn("held", (F.col("v") % 4 == 3) & (F.col("family") != ORDINARY)), "licence-training")
    listed = rows.withColumn("grams", F.array_distinct(F.concat(grams(F.col("tokens"), 1), grams(F.col("tokens"), 2))))
    by_gram = listed.select((F.col("family") == ORDINARY).alias("ordinary"), F.explode("grams").alias("gram")).groupBy("gram").agg(
        F.sum(F.col("ordinary").cast("int")).alias("in_ordinary"), F.sum((~F.col("ordinary")).cast("int")).alias("in_licence")
    )
    vocabulary = sorted(row["gram"] for row in by_gram.where("in_ordinary = 0 and in_licence >= 8").collect())  # bounded by the templates
    singles = {g for g in vocabulary if " " not in g}
    vocabulary = [g for g in vocabulary if singles & set(g.split(" "))]
    families = [ORDINARY, *TEMPLATES]
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features")
    counter.setBinary(True)
    features = counter.transform(listed.withColumn("label", label.cast("double")))
    model = LogisticRegression(family="multinomial", regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(features.where("not held").repartition(2))
    matrix, bias = model.coefficientMatrix.toArray(), list(model.interceptVector)
    weights = {gram: [float(x) for x in matrix[:, j]] for j, gram in enumerate(vocabulary) if abs(matrix[:, j]).max() > 0}
    made = LicenceModel(families, [float(b) for b in bias], weights)
    made.singles = sorted({w for g in weights for w in g.split(" ") if w in singles})
    return calibrated(made, rows.where("held"))


def calibrated(model: LicenceModel, held: DataFrame) -> LicenceModel:
    """The temperature with the least loss on held-out rows, and the chance above which 99 in 100 right ones lie."""
    truth = F.array_position(F.array(*[F.lit(f) for f in model.families]), F.col("family")).cast("int")
    steps = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    losses = []
    for t in steps:
        model.temperature = t
        losses.append(-F.avg(F.log(F.greatest(F.element_at(model.chances(F.col("tokens")), truth), F.lit(1e-9)))).alias(f"t{len(losses)}"))
    found = list(held.agg(*[loss.alias(f"loss_{k}") for k, loss in enumerate(losses)]).first())
    model.temperature = min(zip(found, steps, strict=True), key=lambda x: x[0] if x[0] is not None else math.inf)[1]
    right = held.withColumn("chances", model.chances(F.col("tokens"))).where(F.array_position("chances", F.array_max("chances")) == truth)
    lowest = right.agg(F.percentile_approx(F.array_max("chances"), 1 - KEPT_RIGHT)).first()[0]
    model.threshold = max(0.3, min(0.9, lowest if lowest is not None else 0.5))
    return model


def findings(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """A row for each paragraph that speaks of a licence: its family, chance, likeness to the family's templates, and verdict.

    Only documents with a word that is a feature are cut into paragraphs; every feature has such a word.
    """
    spark = docs.sparkSession
    singles = F.array(*[F.lit(w) for w in model.singles]) if model.singles else F.array().cast("array<string>")
    cut = F.split(F.lower("text"), r"[^a-z0-9.]+|\.(?![0-9])|(?<![0-9a-z])\.")
    rows = paragraphs(docs.select("doc_id", "text").where(F.arrays_overlap(cut, singles)))
    rows = rows.withColumn("tokens", words(F.col("text"))).where(F.arrays_overlap("tokens", singles))
    rows = rows.withColumn("chances", model.chances(F.col("tokens"))).withColumn("chance", F.array_max("chances"))
    best = F.element_at(F.array(*[F.lit(f) for f in model.families]), F.array_position("chances", F.col("chance")).cast("int"))
    rows = rows.withColumn("likeliest", best).where(F.col("likeliest") != ORDINARY)
    known = templates(spark).withColumn("triples", F.array_distinct(grams(words(F.col("text")), 3)))
    by_family = known.groupBy("family").agg(F.collect_list("triples").alias("templates"))
    rows = rows.withColumn("triples", F.array_distinct(grams(F.col("tokens"), 3))).join(F.broadcast(by_family), rows["likeliest"] == by_family["family"], "left")
    alike = F.array_max(
        F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("triples"))) / F.greatest(F.lit(1), F.least(F.size(t), F.size("triples"))))
    )
    rows = rows.withColumn("likeness", F.coalesce(alike, F.lit(0.0)))
    sure = (F.col("chance") >= model.threshold) & (F.col("likeliest") != "unknown")
    return rows.select(
        "doc_id",
        F.col("paragraph").cast("bigint").alias("paragraph"),
        F.when(sure, F.col("likeliest")).otherwise("unknown").alias("licence"),
        "chance",
        "likeness",
        (sure & (F.col("likeness") >= CONFIRMED)).alias("confirmed"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """The query: the licence paragraphs of every document."""
    return findings(docs, train(training_rows(docs)))
