"""License scans by a trained paragraph classifier, DataFrame functions only.

Text is cut into paragraphs (blank lines) and those that hold a marker word
into sentences, with and without cuts at line ends (a notice may be wrapped, or
follow a line that ends in no full stop). A multinomial logistic regression over sparse word n-grams
(one to three words, hashed to ``FEATURES`` slots) gives each sentence a licence
family or ``unknown``. Its probabilities are calibrated by a temperature and
the level at which a family counts as found is set, both on held-out rows. A
template comparison then confirms: the sentence and a template of the predicted
family must share at least ``SIMILARITY`` of the five-word shingles of the
shorter one.

Short notices (identifiers, titles, reworded notice lines) have few shingles or
none, so units of at most ``SHORT`` words are also compared word by word: a unit
that is made up of licence names (``NAMES``) between notice words only
(``LEAD``, ``JOIN``, ``TAIL``; up to three words of any kind, as a project's
name, may stand before "is ... under") is a notice of each licence it names,
whatever the classifier says, with similarity 1 and the classifier's probability
of that family. Web addresses are left out of this comparison. A name
without a version counts; another version of a one-version family does not.

Training rows: all windows of ``WINDOWS`` words of the templates, with their
family; as ``unknown``, at most ``NEGATIVES`` sentences of the corpus (those of
the documents with the smallest id hashes) and as many sentences of template
words in hashed order, so that single licence words are no evidence. One row in
four is held out. Only the fit is bounded; every document is scanned.

Scale. Documents without a marker word go at the scan; there is no shuffle but
the final count per document and family. The model is a few MB.

Defined cases. Null text counts as empty; texts without a confirmed sentence
give no row; documents are counted by ``doc_id`` (rows that share an id are one
document, null is an id of its own); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.tables import stored, table, text_of

UNKNOWN = "unknown"
FEATURES = 1 << 14
NEGATIVES = 2000
WINDOWS = (5, 8, 12, 20)
SHINGLE, SIMILARITY = 5, 0.8
#: Share of held-out unknown rows that may exceed the level of detection.
FALSE_ALARMS = 0.005
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0)

#: Opening and notice texts of common licences.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
        "express or implied.",
    ),
    "mit": (
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Every template sentence holds one of these; a paragraph without any has no notice.
MARKERS = r"(?i)licen[sc]e|copyright|permission|redistribut|warrant|public domain|creative commons|software|source code"
#: What may hold a notice: as above, or a licence name without any such word.
NOTED = MARKERS + r"|licen[sc]|\bl?gpl|\bmpl\b|\bcc0|\bcc[ \-]by|\b(?:apache|asl)[ \-](?:version |v ?)?2|\bunder\b.{0,40}\b(?:mit|expat|bsd|isc)\b"
#: End of a sentence; the stop of "v. 2.0" is none.
STOP = r"(?<=[.!?])(?<![ ,][vV]\.)\s+"
#: Longest unit compared word by word.
SHORT = 24
_TWO = r"(?: (?:version |v )?v?2(?:\.0)?)?"
_GNU = r"(?: (?:version |v )?v?[1-3](?:\.[0-9])?)?"
_CC = r"(?: v?[1-4]\.0)?(?: (?:international|unported|generic|universal))?(?: public)?(?: licen[sc]e)?"
#: Family: its names in lower-case words. Names in ``_BARE`` mean other things
#: too and need a word of licensing beside them.
NAMES = {
    "apache-2.0": rf"apache-(?:license-)?2(?:\.0)?(?: licen[sc]e)?|apache(?: software)? licen[sc]e{_TWO}|apache (?:version |v )?v?2(?:\.0)?(?: licen[sc]e)?|asl 2\.0",
    "mit": r"(?:mit|expat|mit-style)(?: (?:x11 )?licen[sc]e)?",
    "bsd": r"(?:(?:new|modified|revised|simplified|original|[0-4]-clause|two-clause|three-clause|four-clause) )?bsd(?:-style)?(?: (?:[0-4]|two|three|four)[ \-]clause)?"
           r"(?: licen[sc]e)?|bsd-[0-4]-clause(?: licen[sc]e)?",
    "gpl": rf"(?:gnu )?(?:general public licen[sc]e(?: gpl)?|gpl){_GNU}|(?:gnu )?gpl-?v?[1-3](?:\.[0-9])?(?:-only|-or-later)?",
    "lgpl": rf"(?:gnu )?(?:(?:lesser|library) general public licen[sc]e(?: lgpl)?|lgpl){_GNU}|(?:gnu )?lgpl-?v?[1-3](?:\.[0-9])?(?:-only|-or-later)?",
    "mpl-2.0": rf"mozilla public licen[sc]e(?: mpl)?{_TWO}|mpl-?v?2(?:\.0)?|mpl{_TWO}",
    "isc": r"isc(?: licen[sc]e)?",
    "cc-by-nc": rf"(?:cc[ \-]by[ \-]nc(?:-[1-4]\.0)?|creative commons attribution[ \-]non-?commercial){_CC}",
    "cc-by-sa": rf"(?:cc[ \-]by[ \-]sa(?:-[1-4]\.0)?|creative commons attribution[ \-]share-?[ ]?alike){_CC}",
    "cc-by": rf"(?:cc[ \-]by(?:-[1-4]\.0)?|creative commons attribution){_CC}",
    "cc0": r"(?:cc0(?:-1\.0)?|creative commons(?: cc0)? zero|creative commons cc0)(?: v?1\.0)?(?: universal)?(?: public domain dedication)?(?: licen[sc]e)?",
    "unlicense": r"unlicense(?: licen[sc]e)?",
}
_BARE = r"mit|expat|bsd|isc|mit-style|bsd-style"
#: Words that may stand before the first name, between names and after the last.
LEAD = (
    "a|all|an|and|are|at|available|by|code|content|contents|copyright|covered|data|dataset|distributed|distribution|document|documentation|dual|dual-licensed|dually|"
    "everything|file|files|following|free|governed|here|identifier|in|is|issued|it|its|library|licence|licences|licenced|license|licenses|licensed|licensing|made|material|"
    "module|name|notice|of|offered|open|open-source|our|package|program|project|provided|publicly|published|released|repository|script|site|software|source|spdx|"
    "spdx-license-identifier|subject|term|terms|conditions|text|texts|that|the|these|this|to|type|under|version|via|website|with|work|works|your|book|article|either|both"
)
JOIN = "and|or|the|a|an|with|under|at|your|option|either|any|later|version|licen[sc]es?|terms|of|only"
TAIL = (
    "licen[sc]es?|licensed|only|or|any|newer|later|version|versions|at|your|option|unless|except|where|otherwise|noted|stated|specified|see|for|details|more|information|the|file|in|"
    "copy|copying|of|full|text|terms|and|as|published|by|free|software|foundation|"
    "applies|exception|this|repository|project|md|txt|license\\.md|license\\.txt"
)
_ANY_NAME = "(?:" + "|".join(NAMES.values()) + ")"
_NOTICE = rf"^ (?:(?:(?!not |no |never |without |if |unless )[^ ]+ ){{1,3}}(?:is|are) (?=[^.]*under ))?(?:(?:{LEAD}) )*{_ANY_NAME}(?: (?:(?:{JOIN}) ){{0,6}}{_ANY_NAME})* (?:(?:{TAIL}) )*$"
_LICENSING = r" (?:licen[sc]\S*|spdx-license-identifier|unlicense|under|dual-licensed) "


def words_of(text: Column) -> Column:
    """Lower-case words; a full stop or hyphen stays inside a word only."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"), F.lit(0))


def shingles_of(words: Column) -> Column:
    """Distinct five-word shingles; fewer words: the whole."""
    def of(w: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
        return F.array_distinct(joined)

    return F.transform(F.array(words), of)[0]


def named_in(sentence: Column) -> Column:
    """Families that a short notice names; empty if the unit is none."""
    words = words_of(F.regexp_replace(sentence, r"(?i)\bhttps?://\S+|\bwww\.\S+", " "))

    def of(w: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        names = F.regexp_extract_all(line, F.lit(rf"(?<= ){_ANY_NAME}(?= )"), F.lit(0))
        names = F.filter(names, lambda n: ~n.rlike(rf"^(?:{_BARE})$") | line.rlike(_LICENSING))
        of_name = lambda n: F.coalesce(*[F.when(n.rlike(rf"^(?:{pattern})$"), F.lit(f)) for f, pattern in NAMES.items()])
        short = F.size(w).between(1, SHORT) & ~sentence.rlike(r"\?\s*$")
        return F.when(short & line.rlike(_NOTICE), F.array_distinct(F.transform(names, of_name))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), of)[0]


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", markers: str | None = MARKERS, least: int = 1) -> DataFrame:
    """(doc_id, sentence, words) of the paragraphs that hold a marker; units of
    fewer than ``least`` words are left out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.where(F.col("text").rlike(markers)) if markers else rows
    rows = rows.select("doc_id", F.explode(F.split("text", r"\n[ \t]*\n")).alias("paragraph"))
    rows = rows.where(F.col("paragraph").rlike(markers)) if markers else rows
    units = F.array_distinct(F.concat(F.split("paragraph", STOP), F.split("paragraph", STOP + r"|\n")))
    rows = rows.select("doc_id", F.explode(units).alias("sentence"))
    return rows.withColumn("words", words_of(F.col("sentence"))).where(F.size("words") >= least)


def templates(spark: SparkSession) -> DataFrame:
    """(family, words) of each template sentence."""
    rows = [(family, text) for family, texts in TEMPLATES.items() for text in texts]
    return spark.createDataFrame(rows, "family string, text string").select("family", words_of(F.col("text")).alias("words"))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(family, words, held): a bounded table, whatever the size of ``docs``."""
    known = templates(docs.sparkSession)
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (n - 1), F.lit(1))), lambda i: F.slice("words", i, n))
    windows = known.select("family", F.explode(F.flatten(F.array(F.array("words"), *[cut(n) for n in WINDOWS]))).alias("words")).distinct()
    mixed = windows.select(F.explode("words").alias("w")).distinct()
    mixed = mixed.select("w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NEGATIVES // 8 - 1).cast("long"))).alias("id"))
    mixed = mixed.withColumn("h", F.xxhash64("w", "id")).where(F.pmod("h", F.lit(16)) == 0)
    mixed = mixed.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "w"))), lambda x: x["w"]).alias("words"))
    mixed = mixed.select(F.lit(UNKNOWN).alias("family"), F.slice("words", 1, 12).alias("words"))
    few = docs.select(id_col, text_col).orderBy(F.xxhash64(F.col(id_col)), F.xxhash64(text_col)).limit(NEGATIVES // 10)
    few = sentences(few, id_col, text_col, markers=None, least=3).where(~F.col("sentence").rlike(MARKERS))
    few = few.orderBy(F.xxhash64("sentence"), "sentence").limit(NEGATIVES).select(F.lit(UNKNOWN).alias("family"), "words")
    rows = windows.unionByName(mixed).unionByName(few)
    return rows.withColumn("held", F.pmod(F.xxhash64(F.array_join("words", " ")), F.lit(4)) == 0)


def _features() -> list:
    joined = SQLTransformer(statement="SELECT *, concat(words, two, three) AS grams FROM __THIS__")
    return [NGram(n=2, inputCol="words", outputCol="two"), NGram(n=3, inputCol="words", outputCol="three"), joined,
            HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features")]


class LicenseModel:
    """The fitted classifier, its temperature and level."""

    def __init__(self, model: PipelineModel, families: list[str], temperature: float, level: float):
        self.model, self.families, self.temperature, self.level = model, families, temperature, level

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with words) and the best family with its probability."""
        return self.scored(rows).select(*rows.columns, F.col("best.family").alias("family"), F.col("best.p").alias("probability"))

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``p``, the probability of each family in the order of
        ``families``, and ``best`` (p, family)."""
        scored = self.model.transform(rows).withColumn("p", _softmax(vector_to_array("rawPrediction"), self.temperature))
        names = F.array(*[F.lit(f) for f in self.families])
        best = F.array_max(F.transform("p", lambda p, i: F.struct(p.alias("p"), F.get(names, i).alias("family"))))
        return scored.select(*rows.columns, "p", best.alias("best"))

    def found(self, units: DataFrame) -> DataFrame:
        """``units`` (with named) per family that they may be a notice of: the
        best one at the level, and those named; its probability."""
        families = F.array(*[F.lit(f) for f in self.families])
        best = F.filter(F.array("best"), lambda b: (b["family"] != UNKNOWN) & (b["p"] >= self.level))
        every = F.array_distinct(F.concat("named", F.transform(best, lambda b: b["family"])))
        rows = self.scored(units).select(*units.columns, "p", F.explode(every).alias("family"))
        return rows.withColumn("probability", F.get("p", F.array_position(families, F.col("family")).cast("int") - 1)).drop("p")


def _softmax(raw: Column, temperature: float) -> Column:
    def of(x: Column) -> Column:
        e = F.transform(x, lambda v: F.exp((v - F.array_max(x)) / temperature))
        return F.transform(F.array(e), lambda a: F.transform(a, lambda v: v / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))[0]

    return F.transform(F.array(raw), of)[0]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    rows = stored(training_rows(docs, id_col, text_col).coalesce(1), "license-rows")
    families = [*sorted(TEMPLATES), UNKNOWN]
    indexer = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    families = list(indexer.labels)
    weighted = rows.join(F.broadcast(rows.groupBy("family").count()), "family").withColumn("weight", 1.0 / F.sqrt("count"))
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial", regParam=1e-3, maxIter=60)
    fitted = Pipeline(stages=[*_features(), lr]).fit(indexer.transform(weighted.where("not held")).select("words", "label", "weight"))
    held = fitted.transform(indexer.transform(rows.where("held"))).select("family", "label", vector_to_array("rawPrediction").alias("raw"))
    losses = held.agg(*[F.avg(-F.log(F.get(_softmax(F.col("raw"), t), F.col("label").cast("int")) + 1e-12)).alias(str(k)) for k, t in enumerate(TEMPERATURES)]).first()
    temperature = min(zip([x if x is not None else math.inf for x in losses], TEMPERATURES))[1]
    unknown = families.index(UNKNOWN)
    false = F.array_max(F.transform(_softmax(F.col("raw"), temperature), lambda p, i: F.when(i == unknown, 0.0).otherwise(p)))
    level = held.where(F.col("family") == UNKNOWN).agg(F.percentile(false, F.lit(1 - FALSE_ALARMS))).first()[0]
    return LicenseModel(fitted, families, temperature, max(0.5, min(level or 0.5, 0.99)))


def confirmed(found: DataFrame) -> DataFrame:
    """``found`` (words, named, family) with the similarity to its family's
    nearest template (1 if named), where that is at least ``SIMILARITY``."""
    spark = found.sparkSession
    known = templates(spark).select("family", shingles_of(F.col("words")).alias("t")).groupBy("family").agg(F.collect_list("t").alias("ts"))
    met = found.join(F.broadcast(known), "family").withColumn("s", shingles_of(F.col("words")))  # one row per family
    alike = F.transform("ts", lambda t: F.size(F.array_intersect(t, "s")) / F.least(F.size(t), F.size("s")))
    similarity = F.when(F.array_contains("named", F.col("family")), F.lit(1.0)).otherwise(F.array_max(alike))
    return met.withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY).drop("ts", "s")


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: LicenseModel | None = None) -> DataFrame:
    """One row per document and licence family found in it: doc_id, family,
    n_passages (distinct sentences or lines of a paragraph), probability and
    similarity of the clearest."""
    model = model or fit(docs, id_col, text_col)
    units = sentences(docs, id_col, text_col, markers=NOTED).withColumn("named", named_in(F.col("sentence")))
    return confirmed(model.found(units)).groupBy("doc_id", "family").agg(
        F.count(F.lit(1)).alias("n_passages"), F.round(F.max("probability"), 6).alias("probability"), F.max("similarity").alias("similarity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))
