"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by template comparison.

Everything on the main path is a DataFrame or SQL function. The classifier is a multinomial logistic regression with an L1 penalty
(``pyspark.ml``) over n-grams of one to three words that hold a licence word. It learns from the templates and from licence-like phrases
with arbitrary names (the class ``unknown``), with words left out, and from licence words among arbitrary ones (``none``); a temperature is
chosen on variants that the weights did not see. Nothing is learnt from the scanned corpus, so no frequent wording can hide itself.

A unit is a line with a licence word; a line without one has no feature and is ``none``. Notices are often wrapped, so each unit has a
window of the lines around it. Each distinct unit and window is scored once: a licence line that a third of all documents hold costs one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

# A licence family and phrases that state it, from the published notices.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2.0", "See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Licensed under the ISC License."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3.0", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-3.0", "You should have received a copy of the GNU General Public License along with this program."),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ("lgpl", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("agpl-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Licensed under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("epl-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
]
# Licence-like phrases; X stands for an arbitrary word.
UNKNOWN = [
    "Licensed under the X License.",
    "Licensed under the X License, version 3.",
    "Licensed under the X Public License, version 7.",
    "Licensed under X.",
    "Released under the X X License, version 1.",
    "Released under the X license.",
    "This work is licensed under the terms of the X agreement.",
    "This work is licensed under the X License.",
    "This software is licensed under the X License.",
    "Distributed under a X license, see the license file.",
    "Distributed under the X license.",
    "SPDX-License-Identifier: X",
    "SPDX-License-Identifier: X-2.0",
    "Use is permitted under the X licence terms.",
    "Use of this file is governed by the X licence.",
    "You may use this file under the terms of the X license.",
]
# Phrases with licence words that state no licence; X stands for an arbitrary word.
ORDINARY = ["Copyright (c) X X", "Copyright X X", "the X license of X", "X lost the license for X", "with the permission of X", "X asked permission to X", "the rights of X", "X has a licence to X", "X public X", "the X commons of X"]
# Words of the notices that text about other things seldom has (so not "mit", a common German word).
LICENCE_WORDS = """
    agpl apache attribution cc cc0 commons copyright gnu gpl hereby isc lgpl licence licenced licences license licensed licenses
    merchantability mozilla mpl noncommercial permission permitted redistribute redistribution redistributions reproduced reserved rights
    sharealike spdx warranties warranty waived
""".split()

_LICENCE_LINE = r"(?i)(?<![\p{L}\p{N}])(" + "|".join(LICENCE_WORDS) + r")(?![\p{L}\p{N}])"
AROUND = 6  # lines before and after a unit that its window has


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    last = F.size(words) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def _once(value: Column, f) -> Column:
    """``f`` of a value that is computed once for the row and not for each element of an inner function."""
    return F.transform(F.array(value), f)[0]


def _features(text: Column) -> Column:
    """The distinct n-grams of one to three words that hold a licence word."""
    near = F.lit(LICENCE_WORDS)
    every = lambda words: F.concat(*[ngrams(words, n) for n in (1, 2, 3)])
    return F.array_distinct(F.filter(_once(words_of(text), every), lambda g: F.arrays_overlap(F.split(g, " "), near)))


def _grams(text: Column) -> Column:
    """What templates are compared by: distinct three-word sequences; a shorter text is one sequence."""
    return F.array_distinct(_once(words_of(text), lambda words: F.when(F.size(words) < 3, F.array(F.array_join(words, " "))).otherwise(ngrams(words, 3))))


def units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, unit, around``: lines with a licence word, and each with the lines around it."""
    rows = docs.where(F.col(text_col).rlike(_LICENCE_LINE)).select(F.col(id_col).alias("doc_id"), F.split(text_col, "\n").alias("lines"))
    rows = rows.select("doc_id", "lines", F.explode(F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i).rlike(_LICENCE_LINE))).alias("at"))
    first = F.greatest(F.col("at") - AROUND, F.lit(1))
    return rows.select("doc_id", F.element_at("lines", F.col("at")).alias("unit"), F.array_join(F.slice("lines", first, F.col("at") + AROUND + 1 - first), "\n").alias("around"))


class LicenceModel:
    """``weights``: n-gram -> weight of each class; ``classes`` in their order; a temperature."""

    def __init__(self, classes: list[str], weights: list[tuple[str, list[float]]], intercepts: list[float], temperature: float):
        self.classes, self.weights, self.intercepts, self.temperature = classes, weights, intercepts, temperature

    def logits(self, texts: DataFrame, key: str) -> DataFrame:
        """``key`` and ``z``, a logit of each class, of rows with distinct ``key`` and ``grams``."""
        table = F.broadcast(texts.sparkSession.createDataFrame(self.weights, "gram string, w array<double>"))  # bounded by the templates
        sums = [F.coalesce(F.sum(F.col("w")[k]), F.lit(0.0)) + b for k, b in enumerate(self.intercepts)]
        return texts.select(key, F.explode_outer("grams").alias("gram")).join(table, "gram", "left").groupBy(key).agg(F.array(*sums).alias("z"))

    def score(self, texts: DataFrame, key: str) -> DataFrame:
        """Distinct ``key`` texts with ``family`` (the likeliest class) and ``probability``."""
        z = self.logits(texts.select(key).distinct().withColumn("grams", _features(F.col(key))), key)
        total = F.aggregate("z", F.lit(0.0), lambda s, x: s + F.exp((x - F.array_max("z")) / self.temperature))
        name = F.element_at(F.lit(self.classes), F.array_position("z", F.array_max("z")).cast("int"))
        return z.select(key, name.alias("family"), (1 / total).alias("probability"))


def _variants(spark: SparkSession, each: int) -> DataFrame:
    """Templates and phrases with up to a fifth of their words left out, and licence words among arbitrary ones; ``k`` numbers the variants."""
    alone = [("none", f"X X {w} X X") for w in LICENCE_WORDS]
    rows = spark.createDataFrame(TEMPLATES + [("unknown", t) for t in UNKNOWN] + [("none", t) for t in ORDINARY] + alone, "family string, text string").coalesce(1)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
    # an arbitrary word is made of a hash's digits, as letters
    pick = lambda i: F.translate(F.left(F.hex(F.xxhash64("text", "k", i)), F.lit(4) + F.pmod(F.xxhash64("k", i), F.lit(6)).cast("int")), "0123456789ABCDEF", "aeioubdklmnprstv")
    word = F.transform(words_of(F.col("text")), lambda w, i: F.when(F.col("family").isin("unknown", "none") & (w == "x"), pick(i)).otherwise(w))
    kept = F.filter(word, lambda w, i: F.pmod(F.xxhash64("k", "text", i), F.lit(100)) >= 10 * (F.col("k") % 3))
    return rows.select("family", "k", F.array_join(kept, " ").alias("unit"))


def fit_licences(spark: SparkSession, each: int = 10, penalty: float = 2e-4, iterations: int = 60) -> LicenceModel:
    """Train on ``each`` variants of every template and phrase; a fifth of them only sets the temperature.

    The training table is bounded by the templates (some 1,000 rows), so it is one partition.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    rows = C.written(_variants(spark, each).withColumn("grams", _features(F.col("unit"))), "licence-training").coalesce(1)
    learn, check = rows.where("k % 5 <> 4").cache(), rows.where("k % 5 = 4")
    vector = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=8192).fit(learn)
    label = StringIndexer(inputCol="family", outputCol="y", stringOrderType="alphabetAsc").fit(learn)
    fitted = LogisticRegression(featuresCol="x", labelCol="y", regParam=penalty, elasticNetParam=1.0, family="multinomial", standardization=False, maxIter=iterations).fit(label.transform(vector.transform(learn)))
    learn.unpersist()
    matrix = fitted.coefficientMatrix.toArray()
    weights = [(g, [float(v) for v in matrix[:, k]]) for k, g in enumerate(vector.vocabulary) if matrix[:, k].any()]
    return _calibrated(LicenceModel(list(label.labels), weights, [float(v) for v in fitted.interceptVector.toArray()], 1.0), check)


def _calibrated(model: LicenceModel, check: DataFrame) -> LicenceModel:
    """The temperature, out of a few, with the least log loss on rows that the weights did not see."""
    rows = check.select(F.struct("family", "k", "unit").alias("row"), "grams")
    own = F.element_at("z", F.array_position(F.lit(model.classes), F.col("row.family")).cast("int"))
    options = [0.5, 0.7, 1.0, 1.4, 2.0, 3.0]
    loss = [F.avg(F.log(F.aggregate(F.transform("z", lambda x: F.exp((x - own) / F.lit(t))), F.lit(0.0), lambda s, x: s + x))).alias(f"t{i}") for i, t in enumerate(options)]
    found = model.logits(rows, "row").agg(*loss).first()
    if found[0] is not None:
        model.temperature = options[min(range(len(options)), key=lambda i: found[i])]
    return model


def scan_licences(docs: DataFrame, model: LicenceModel | None = None, least: float = 0.5, share: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, family, paragraphs, probability``: licences that each document states, and by how many lines.

    A family holds if the classifier gives it to the line with at least ``least`` and at least ``share`` of the three-word sequences of one
    of its templates occur in the line; or if it gives it to the line's window, the template occurs there, and over half of the line's
    own sequences are the template's: then the line is a part of a wrapped notice. A line that looks like a licence but fails these tests is
    ``unknown``. Documents without a licence have no row, like null and empty texts. Rows of an id are counted together; null ids are kept.
    An empty table gives no rows; other columns are not read.
    """
    model = model or fit_licences(docs.sparkSession)
    held = C.written(units(docs, id_col, text_col).groupBy("doc_id", "unit", "around").agg(F.count(F.lit(1)).alias("n")), "licence-units")
    every = held.select(F.explode(F.array("unit", "around")).alias("unit"))
    scores = C.written(model.score(every, "unit"), "licence-scores")
    pairs = held.select("unit", "around").distinct().join(scores, "unit")
    pairs = pairs.join(scores.select(F.col("unit").alias("around"), F.col("family").alias("wide"), F.col("probability").alias("wide_probability")), "around")
    pairs = C.written(pairs.where("family <> 'none' OR wide <> 'none'"), "licence-pairs")
    templates = F.broadcast(docs.sparkSession.createDataFrame(TEMPLATES, "stated string, text string").select("stated", _grams(F.col("text")).alias("template")))
    both = pairs.select("*", F.explode(F.array_distinct(F.array("family", "wide"))).alias("stated"), _grams(F.col("unit")).alias("own"), _grams(F.col("around")).alias("near")).join(templates, "stated")
    within = lambda c: F.size(F.array_intersect("template", c)) / F.size("template")
    alone = (F.col("stated") == F.col("family")) & (F.col("probability") >= least) & (within("own") >= share)
    wrapped = (F.col("stated") == F.col("wide")) & (F.col("wide_probability") >= least) & (within("near") >= share) & (F.size(F.array_intersect("own", "template")) * 2 > F.size("own"))
    sure = both.select("unit", "around", "stated", F.when(alone, F.col("probability") + 1).when(wrapped, F.col("wide_probability")).alias("rank")).where("rank IS NOT NULL")
    sure = sure.groupBy("unit", "around").agg(F.max(F.struct("rank", "stated")).alias("best"))
    name = F.coalesce("best.stated", F.when(F.col("family") != "none", "unknown"))
    probability = F.coalesce(F.when(F.col("best.rank") > 1, F.col("best.rank") - 1).otherwise(F.col("best.rank")), F.col("probability"))
    named = pairs.join(sure, ["unit", "around"], "left").select("unit", "around", name.alias("family"), probability.alias("probability")).where("family IS NOT NULL")
    return held.join(named, ["unit", "around"]).groupBy("doc_id", "family").agg(F.sum("n").alias("paragraphs"), F.max("probability").alias("probability"))


def op2_licences(spark, sf_dir: str) -> DataFrame:
    """Licence families that each document of ``documents`` states; null and empty texts and texts without a licence give no row."""
    return scan_licences(C.read(spark, sf_dir, "documents"))
