"""Licence scans: a trained paragraph classifier, confirmed by templates; DataFrame functions and Spark ML only.

A paragraph ends at a blank line. A notice in it may fill one line, or be wrapped over several among lines of prose, so
what is classified are the lines that hold a word of a notice that ordinary lines lack, each by itself and neighbouring
ones joined. The features are the word 1- and 2-grams of known notices with such a word, as sparse vectors; a
multinomial logistic regression tells licence families from prose by them. It is trained on notices of each family inside
scraps of prose, on sentences that only speak of licences, and on bounded samples of the corpus's own lines, those that
share some words with a notice among them. The probability from which a family is believed comes from all lines of
the corpus in paragraphs that are far from every template; below it a paragraph is unknown. A believed family is confirmed
by a template that shares enough words with the paragraph, whose numbers the paragraph holds, and that fits better, by
words and pairs of neighbouring words, than any template of another family or of a sibling licence that is like it; a
tie confirms nothing, nor does a sentence that denies the licence. Siblings are hard negatives of the training, too.
"""

from __future__ import annotations

import re
import zlib

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store, text_key

# Notices of public licences by family (SPDX names).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
# The families' SPDX identifiers, and notices and identifiers of licences that are like theirs and none of them.
IDENTIFIERS = {
    "Apache-2.0": ["Apache-2.0"], "BSD-3-Clause": ["BSD-3-Clause"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"],
}
OTHER_IDENTIFIERS = ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "BSD-2-Clause", "BSD-4-Clause", "CC-BY-3.0", "CC-BY-NC-3.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT-0", "MPL-1.1", "Unlicense")
SIBLINGS = (
    "Licensed under the Apache License, Version 1.1.",
    "Released under the BSD 2-Clause License.", "Released under the BSD 4-Clause License.",
    "Licensed under CC BY 3.0.", "Licensed under CC BY-NC 3.0.", "Licensed under CC BY-SA 3.0.", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
)
#: Identifier lines are templates of their family or siblings, like notices.
_IDENTIFIED = "SPDX-License-Identifier: {}"
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] += [_IDENTIFIED.format(n) for n in _names]
SIBLINGS += tuple(_IDENTIFIED.format(n) for n in OTHER_IDENTIFIERS)
FAMILIES = sorted(TEMPLATES)
UNKNOWN = len(FAMILIES)
#: Words that a notice may hold; paragraphs with one say nothing about which words are ordinary.
_CUES = r"(?i)licen[cs]e|spdx|copyright|creative commons|cc by|redistribut|hereby granted"
#: Sentences that speak of licences and are no notices.
NOT_NOTICES = (
    "She renewed her driving licence last week and paid the fee in cash.",
    "The licence for the software was too expensive, so they bought another one.",
    "Questions of copyright are answered by the publisher.",
    "Permission was granted to enter the building free of charge.",
    "A copy of the letter was obtained by any person who asked for it.",
    "The source of the river has many forms and names.",
    "Free software is discussed in the third chapter of this book.",
    "He is subject to the terms of the contract with the foundation.",
    "The creative work of the commons committee found international attribution.",
    "This work is described in the following pages, with or without pictures.",
    "The conditions of use are met in both binary and source models.",
    "An Apache helicopter of version 2.0 was shown to the general public.",
)
#: Ordinary lines and lines with some words of a notice that are drawn, and scraps around each notice.
SAMPLE_LINES, VARIANTS = 3_000, 30
#: Share of the lines with words of a notice, in paragraphs far from any template, that may be believed to be notices.
FALSE_ALARMS = 0.001
#: Share of a template's words that a notice must hold; lines of paragraphs that hold less than SOME are examples of no notice.
OVERLAP, SOME = 0.7, 0.35
#: Templates with this share of their words in common are compared; a sentence that matches DENIED says that a licence is not given.
ALIKE, DENIED = 0.5, r"\b(?:not|never|nor|cannot|isn t|aren t|wasn t|no longer|neither)(?: \S+){0,2} (?:released|licensed|licenced|available|distributed|covered|offered|published|under|subject)\b"
#: A word is ordinary from this share of all lines on.
COMMON = 0.005


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?=\P{N}|$)", " "), " +"), "")


def paragraphs(text: Column) -> Column:
    """What blank lines separate; blank ones are left out."""
    return F.filter(F.split(text, r"\R[^\S\r\n]*(?:\R[^\S\r\n]*)+"), lambda p: F.trim(p) != "")


def lines(docs: DataFrame, text: str) -> DataFrame:
    """A row per line that is not blank, with all columns but the text, ``paragraph`` and ``line`` (numbers), ``cue`` (the paragraph has one), ``words``."""
    rest = [c for c in docs.columns if c != text]
    parts = docs.select(*rest, F.posexplode(paragraphs(F.col(text))).alias("paragraph", "p"))
    each = parts.select(*rest, "paragraph", F.col("p").rlike(_CUES).alias("cue"), F.posexplode(F.split("p", r"\R")).alias("line", "p"))
    return each.select(*rest, "paragraph", "cue", "line", words(F.col("p")).alias("words")).where(F.size("words") > 0)


def _template_words() -> list[list[str]]:
    """The distinct words of each template, by family and template."""
    return [sorted(set(_plain(t))) for f in FAMILIES for t in TEMPLATES[f]]


def _plain(text: str) -> list[str]:
    """``words`` of a fixed text."""
    low = re.sub(r"[^\w.]+|_|\.(?=\D|$)", " ", text.lower())
    return low.split()


def ordinary_words(every: DataFrame) -> tuple[set[str], int]:
    """The words of notices that more than a share of COMMON of the lines hold, in paragraphs without a cue, and these lines' number."""
    own = sorted({w for t in _template_words() for w in t})
    marked = F.concat(F.array_distinct("words"), F.array(F.lit("")))  # the empty word stands for the line, so that one pass counts both
    seen = every.where("not cue").select(F.explode(marked).alias("w")).where(F.col("w").isin("", *own)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    count = {r.w: r.n for r in seen.collect()}  # at most the words of all templates
    n = count.pop("", 0)
    return {w for w, k in count.items() if k > max(1, COMMON * n)}, n


def overlap() -> Column:
    """The largest share of a template's words that the column ``words`` holds, over all templates."""
    return F.array_max(F.transform(_table(_template_words()), lambda own: F.size(F.array_intersect("words", own)) / F.size(own)))


def training_rows(ordinary: list[list[str]], likely: list[list[str]]) -> list[tuple[list[str], int]]:
    """(words, label): notices alone and between scraps of prose; ordinary lines, lines like notices, and sentences about licences."""
    scraps = [w[:6] for w in ordinary] or [[]]
    pick = lambda *key: scraps[zlib.crc32(repr(key).encode()) % len(scraps)]
    rows = []
    for label, family in enumerate(FAMILIES):
        for t in TEMPLATES[family]:
            for v in range(VARIANTS):
                w = _plain(t)
                if v % 3 == 2:  # a word in eight is lost
                    w = [x for k, x in enumerate(w) if zlib.crc32(f"{t}{v}{k}".encode()) % 8]
                rows.append(((pick(family, v, "a") if v % 4 > 1 else []) + w + (pick(family, v, "b") if v % 2 else []), label))
    for t in SIBLINGS:
        rows += [((pick(t, v, "a") if v % 4 > 1 else []) + _plain(t) + (pick(t, v, "b") if v % 2 else []), UNKNOWN) for v in range(VARIANTS // 5)]
    for t in NOT_NOTICES:
        rows += [(pick(t, v, "a") * (v > 0) + _plain(t) + pick(t, v, "b") * (v > 1), UNKNOWN) for v in range(VARIANTS // 5)]
    return rows + [(w, UNKNOWN) for w in [*ordinary, *likely]] + [([], UNKNOWN)]


def grams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def features(rare: set[str]) -> list[str]:
    """1- and 2-grams of the templates and siblings that hold one of the words ``rare``, or one that siblings alone have."""
    every = set()
    rare = rare | ({x for t in SIBLINGS for x in _plain(t)} - {x for own in _template_words() for x in own})
    for t in _known():
        w = _plain(t)
        every |= {x for x in w if x in rare} | {f"{x} {y}" for x, y in zip(w, w[1:]) if {x, y} & rare}
    return sorted(every)


class LicenceModel:
    def __init__(self, model: PipelineModel, threshold: float = 0.0):
        self.model, self.threshold = model, threshold

    def predict(self, units: DataFrame) -> DataFrame:
        """``units`` with ``family`` (null: unknown), ``probability`` and ``confirmed``, by their column ``words``."""
        scored = self.model.transform(units.withColumn("grams", grams(F.col("words")))).withColumn("_p", F.slice(vector_to_array("probability"), 1, len(FAMILIES)))
        best = F.array_max("_p")
        family = F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position("_p", best).cast("int") - 1)
        scored = scored.select(*units.columns, "grams", F.when(best >= self.threshold, family).alias("family"), best.alias("probability"))
        fits = F.when(F.col("family").isNotNull(), _fits())
        return scored.withColumn("fits", fits).withColumn("confirmed", F.col("family").isNotNull() & _confirmed()).drop("grams", "fits")


def _plain_grams(text: str) -> list[str]:
    """``grams`` of a fixed text."""
    w = _plain(text)
    return sorted({*w, *(f"{x} {y}" for x, y in zip(w, w[1:]))})


def _rivals(family: str, template: str) -> list[str]:
    """Templates of other families and siblings that have ALIKE of the words of ``template``, or of their own, in common with it."""
    own = set(_plain(template))
    others = [t for f in FAMILIES if f != family for t in TEMPLATES[f]] + list(SIBLINGS)
    return [t for t in others if len(own & set(_plain(t))) >= ALIKE * min(len(own), len(set(_plain(t))))]


def _known() -> list[str]:
    """All templates, of families and siblings."""
    return [*(t for f in FAMILIES for t in TEMPLATES[f]), *SIBLINGS]


def _fits() -> Column:
    """For each of ``_known()``, the share of its words and word pairs that the column ``grams`` holds."""
    return F.transform(_table([_plain_grams(t) for t in _known()]), lambda own: F.size(F.array_intersect("grams", own)) / F.size(own))


def _table(rows: list[list[str]]) -> Column:
    """A constant array of arrays, one expression however many there are."""
    return F.array(*[F.array(*[F.lit(x) for x in r]).cast("array<string>") for r in rows])


def _confirmed() -> Column:
    """Whether a template of the column ``family`` confirms it, by ``words`` and ``fits``."""
    at = {t: k for k, t in enumerate(_known())}
    rows = []
    for f in FAMILIES:
        for t in TEMPLATES[f]:
            own = sorted(set(_plain(t)))
            numbers = [w for w in own if any(c.isdigit() for c in w)]
            strings = [F.array(*[F.lit(w) for w in ws]).cast("array<string>") for ws in (own, numbers)]
            rows.append(F.struct(F.lit(f).alias("family"), F.lit(at[t]).alias("at"), strings[0].alias("own"), strings[1].alias("numbers"), F.array(*[F.lit(at[r]) for r in _rivals(f, t)]).cast("array<int>").alias("rivals")))

    def holds(t: Column) -> Column:
        enough = F.size(F.array_intersect("words", t["own"])) >= OVERLAP * F.size(t["own"])
        numbered = F.size(F.array_except(t["numbers"], "words")) == 0
        return (t["family"] == F.col("family")) & enough & numbered & F.forall(t["rivals"], lambda r: F.get("fits", t["at"]) > F.get("fits", r))

    return F.exists(F.array(*rows), holds) & ~F.array_join("words", " ").rlike(DENIED)


def train(spark: SparkSession, docs: DataFrame, held: DataFrame, rare: set[str], n: int) -> LicenceModel:
    """``docs`` (text_key, text) has ``n`` lines without a cue, ``held`` are the units with a word of ``rare``.

    Ordinary lines are drawn from documents that hashes of their texts pick, some 20 times SAMPLE_LINES at most on average.
    """
    draw = lambda rows: [r.words for r in rows.select("words").distinct().orderBy(F.xxhash64("words"), "words").limit(SAMPLE_LINES).collect()]
    likely = held.where(F.col("most") < SOME)
    some = F.pmod(F.xxhash64("text_key"), F.lit(max(1, n // (20 * SAMPLE_LINES))))  # so that few texts are cut again and few lines ordered
    ordinary = draw(lines(docs.where(some == 0), "text").where(~F.col("cue") & ~F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(rare) or [""]]))))
    rows = spark.createDataFrame(training_rows(ordinary, draw(likely)), "words array<string>, label int")
    counts = CountVectorizerModel.from_vocabulary(features(rare) or ["licence"], "grams", "features").setBinary(True)
    regression = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, labelCol="label", featuresCol="features")
    model = Pipeline(stages=[counts, regression]).fit(rows.withColumn("grams", grams(F.col("words"))).coalesce(2))  # a bounded sample, small tasks
    alarms = LicenceModel(model).predict(likely).agg(F.percentile_approx("probability", F.lit(1 - FALSE_ALARMS), F.lit(100_000))).first()[0]
    return LicenceModel(model, min(0.99, max(0.5, (alarms or 0.0) + 1e-9)))


def joined_lines(held: DataFrame) -> DataFrame:
    """``held`` and, of each paragraph, its neighbouring lines (at most one other between two) joined; ``most`` is the paragraph's largest ``overlap``."""
    by = ["doc_id", "text_key", "paragraph"]
    order = W.partitionBy(*by).orderBy("line")
    new = F.coalesce(F.col("line") - F.lag("line").over(order) > 2, F.lit(True))
    runs = held.withColumn("run", F.sum(new.cast("int")).over(order))
    whole = runs.groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("line", "words"))).alias("l")).where("n > 1")
    units = held.select(*by, "words").unionByName(whole.select(*by, F.flatten(F.transform("l", lambda x: x["words"])).alias("words")))
    return units.withColumn("most", F.max(overlap()).over(W.partitionBy(*by)))


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: paragraphs, lines and joined lines believed to be notices and confirmed by a template, families.

    ``families`` lists the confirmed ones, sorted and comma-joined ("" if none); ``probability`` is the highest that
    was confirmed. A null text has no paragraphs; a null key is kept; rows that agree in key and text get the same. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), text_key(body).alias("text_key"), body.alias("text"))
    every = lines(rows, "text")
    own = {w for t in _template_words() for w in t}
    ordinary, n = ordinary_words(every)
    rare = own - ordinary or own  # a corpus of notices alone makes every word ordinary
    marked = every.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in sorted(rare)])))
    units = store(joined_lines(marked.dropDuplicates(["doc_id", "text_key", "paragraph", "line"])), "units")  # repeated rows once
    model = train(spark, rows, units, rare, n)
    found = model.predict(units).where("family is not null")
    per = found.groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("believed"), F.count_if("confirmed").alias("confirmed"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"), F.max(F.when(F.col("confirmed"), F.col("probability"))).alias("probability"),
    )
    whole = rows.select("doc_id", "text_key", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.size(paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))
    same = whole["doc_id"].eqNullSafe(per["doc_id"]) & (whole["text_key"] == per["text_key"])
    zero = lambda c: F.coalesce(per[c], F.lit(0)).cast("long")
    return whole.join(per, same, "left").select(whole["doc_id"], "text_crc32", "n_paragraphs", zero("believed").alias("n_believed"), zero("confirmed").alias("n_confirmed"), F.coalesce(per["families"], F.lit("")).alias("families"), F.round(per["probability"], 6).alias("probability"))
