"""Licence scans: a paragraph classifier on word n-grams, confirmed by comparison with templates, in Spark's own functions."""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import by_size, written

# Sentences of the families' public standard notices, and sentences that only sound like one.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under BSD 3-Clause.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GNU GPL version 2.",
        "Released under the GPL v3.",
        "Licensed under GPL v2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "Released under CC0 1.0.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without the prior written permission of the copyright holder.",
        "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited. All rights reserved.",
    ],
}
UNKNOWN = [
    "He lost his driving license and had to renew it at the office.",
    "The licensed practitioner opened a clinic last year.",
    "Artists took poetic license with the story of the war.",
    "The public asked for permission to use the school hall.",
    "Copyright law was the subject of the lecture in version one of the course.",
    "The software comes with a warranty of two years and free delivery.",
    "A fishing license is required under the law of this state.",
    "The general public attended the foundation's meeting in the library.",
    "The apache helicopter landed near the free market.",
    "He studied at MIT and released a new version of his book.",
    "Creative people share common work and get attribution for it.",
    "The terms of the license agreement are discussed by both parties.",
    "The council reserved the room without any conditions.",
    "Commercial redistribution of wealth is a common subject.",
]

# English function words. A pair of two of these says nothing about a licence.
FUNCTION_WORDS = frozenset(
    "a about above after all an and any are as at be been both but by can could did do does following for from had has have he her his how if in into is it its"
    " may more most must no nor not of on one or other our out over shall she should so some such than that the their them then there these they this those to"
    " under up was we were what when where which who will with within without would you your".split()
)

#: A line break is a wrap, not a paragraph's end, behind a line of 40 to 120 characters that ends in no closing mark, table cell, tag or brace, and before a line with a word.
WRAP = r"\n(?<=[^\n]{40}\n)(?<![^\n]{121}\n)(?<![.:!?|>}][ \t\r]{0,4}\n)(?=[^\nA-Za-z0-9]*[A-Za-z0-9])"
SEED, VARIANTS, FOLDS = 11, 16, 4
STEPS = 150
#: Grams beyond so many no longer dilute a paragraph's score.
GRAMS = 48
#: A prediction counts from this probability of not being `unknown`, and is confirmed by such a part of a template's word pairs; so many are shared at least.
ENOUGH, ALIKE, PAIRS = 0.5, 0.6, 2

CLASSES = ("unknown", *TEMPLATES)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams_of(words: list[str]) -> list[str]:
    """Distinct words and pairs of words."""
    return list(dict.fromkeys([*words, *map(" ".join, zip(words, words[1:], strict=False))]))


def pairs_of(words: list[str]) -> list[str]:
    return list(dict.fromkeys(map(" ".join, zip(words, words[1:], strict=False))))


def telling_pairs() -> list[str]:
    """The templates' pairs of words that aren't two function words."""
    return sorted({p for v in TEMPLATES.values() for t in v for p in pairs_of(words_of(t)) if not FUNCTION_WORDS.issuperset(p.split())})


def examples() -> list[tuple[list[str], int, int]]:
    """Training rows (words, class, number of its sentence in the class): the templates and other sentences, with words left out, cut short, and with other words around them."""
    rng = random.Random(SEED)
    syllables = [a + b for a in "bdfglmnprst" for b in ("a", "en", "in", "or", "us")]
    pool = sorted({w for t in (*UNKNOWN, *(x for v in TEMPLATES.values() for x in v)) for w in words_of(t)})

    def noise(n: int) -> list[str]:
        return ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n)]

    rows = []
    for label, name in enumerate(CLASSES):
        for number, text in enumerate(TEMPLATES.get(name, UNKNOWN)):
            own = words_of(text)
            for v in range(VARIANTS):
                words = own
                if v % 4 == 1:
                    words = [w for w in own if rng.random() > 0.1]
                elif v % 4 == 2 and len(own) > 12:
                    at = rng.randrange(len(own) - 9)
                    words = own[at : at + 10] if label == 0 or at == 0 else own[: max(10, len(own) - at)]
                elif v % 4 == 3:
                    words = [*noise(rng.randrange(4)), *own, *noise(rng.randrange(6))]
                rows.append((words, label, number))
    for number in range(30 * VARIANTS):
        words = noise(rng.randrange(4, 30))
        for w in rng.sample(pool, rng.randrange(4)):
            words.insert(rng.randrange(len(words)), w)
        rows.append((words, 0, number))
    return rows


def _fitted(x: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a multinomial regression."""
    w, b = np.zeros((x.shape[1], want.shape[1])), np.zeros(want.shape[1])
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        off = (want - _softmax(x @ w + b)) / len(x)
        speed_w = 0.9 * speed_w + (x.T @ off - 1e-5 * w)
        speed_b = 0.9 * speed_b + off.sum(axis=0)
        w, b = w + 30.0 * speed_w, b + 2.0 * speed_b
    return w, b


@cache
def trained() -> tuple[dict[str, list[float]], list[float], float]:
    """Weights by gram, each class's bias, and the temperature.

    Temperature and the bias of `unknown` are calibrated on sentences of which a fit has seen no variant: each of FOLDS
    fits leaves out every FOLDS-th sentence of each class, and every FOLDS-th family as a whole, whose sentences it
    should then call unknown.
    """
    rows = examples()
    vocabulary = {g: n for n, g in enumerate(sorted({g for words, label, _ in rows if label for g in grams_of(words)}))}
    x = np.zeros((len(rows), len(vocabulary)))
    for n, (words, _, _) in enumerate(rows):
        grams = grams_of(words)
        for g in grams:
            if g in vocabulary:
                x[n, vocabulary[g]] = 1 / np.sqrt(min(GRAMS, max(1, len(grams))))
    y = np.array([label for _, label, _ in rows])
    number = np.array([n for _, _, n in rows])
    want = np.eye(len(CLASSES))[y]
    logits, truth = [], []
    for fold in range(FOLDS):
        foreign = (y > 0) & (y % FOLDS == fold)
        held = foreign | (number % FOLDS == fold)
        w, b = _fitted(x[~held], want[~held])
        logits.append(x[held] @ w + b)
        truth.append(np.where(foreign, 0, y)[held])
    z, t = np.concatenate(logits), np.concatenate(truth)

    def loss(temperature: float, more: float) -> float:
        return float(-np.log(_softmax((z + more * np.eye(len(CLASSES))[0]) / temperature)[np.arange(len(t)), t] + 1e-12).mean())

    temperature, more = min(((0.5 * 1.2**k, 0.25 * m) for k in range(20) for m in range(-8, 17)), key=lambda v: loss(*v))
    w, b = _fitted(x, want)
    b[0] += more
    kept = {g: [round(float(v), 5) for v in w[n]] for g, n in vocabulary.items() if np.abs(w[n]).max() > 1e-3}
    return kept, [round(float(v), 5) for v in b], float(temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, n, text of each paragraph that shares a telling pair of words with a template; no other can have a family."""
    telling = telling_pairs()
    single = sorted({w for p in telling for w in p.split()} - FUNCTION_WORDS)
    lines = docs.select(F.col("doc_id").cast("long"), F.posexplode(F.split(F.regexp_replace("text", WRAP, " "), "\n")).alias("n", "text"))
    some = lines.filter(F.exists(_words("text"), lambda w: w.isin(single)))
    return some.filter(F.exists(_pairs(_words("text")), lambda p: p.isin(telling)))


def classified(found: DataFrame) -> DataFrame:
    """found: paragraph (distinct strings). Gives key (its MD5), family, nearest, probability, similarity and confirmed.

    The weights and templates are tables whose sizes the templates bound, so they may be broadcast.
    """
    spark = found.sparkSession
    weights, bias, temperature = trained()
    columns = [f"w{n}" for n in range(len(CLASSES))]
    table = spark.createDataFrame([(g, *v) for g, v in sorted(weights.items())], ", ".join(["gram string", *(f"{c} double" for c in columns)]))
    split = found.select(F.md5("paragraph").alias("key"), _words("paragraph").alias("_words"))
    split = split.select("key", "_words", F.array_distinct(_pairs(F.col("_words"))).alias("_pairs"))
    grams = split.select("key", F.array_distinct(F.concat("_words", "_pairs")).alias("_grams"))
    each = grams.select("key", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram"))
    summed = each.join(F.broadcast(table), "gram").groupBy("key", "_n").agg(*[F.sum(c).alias(c) for c in columns])
    scale = F.sqrt(F.least(F.col("_n"), F.lit(GRAMS)))
    classes = [F.struct(((F.col(c) / scale + b) / temperature).alias("z"), F.lit(name).alias("name")) for c, b, name in zip(columns, bias, CLASSES, strict=True)]
    scored = summed.select("key", classes[0]["z"].alias("_unknown"), F.array(*classes[1:]).alias("_z")).withColumn("_top", F.array_max("_z"))
    odds = F.aggregate("_z", F.lit(0.0), lambda s, v: s + F.exp(v["z"] - F.col("_unknown")))
    named = scored.select("key", F.col("_top")["name"].alias("nearest"), F.round(odds / (1 + odds), 6).alias("probability"))
    named = named.filter(F.col("probability") >= ENOUGH)
    templates = spark.createDataFrame([(name, pairs_of(words_of(t))) for name, v in TEMPLATES.items() for t in v], "nearest string, _template array<string>")
    both = named.join(split.select("key", "_pairs"), "key").join(F.broadcast(templates), "nearest")
    both = both.withColumn("_shared", F.array_intersect("_pairs", "_template"))
    telling = telling_pairs()
    enough = (F.size("_shared") >= PAIRS) & F.exists("_shared", lambda p: p.isin(telling))
    alike = F.size("_shared") / F.least(F.size("_pairs"), F.size("_template"))
    best = both.filter(enough).groupBy("key", "nearest", "probability").agg(F.round(F.max(alike), 6).alias("similarity"))
    best = best.withColumn("confirmed", F.col("similarity") >= ALIKE)
    return best.withColumn("family", F.when(F.col("confirmed"), F.col("nearest")).otherwise("unknown"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its number from 0), family, nearest, probability, similarity, confirmed of every paragraph that is like a licence notice.

    docs: doc_id and text; other columns are ignored. Paragraphs are the lines of every whole text; lines that are
    wrapped (WRAP) are one. `nearest` is the likeliest family of a regression on words and word pairs, `probability`
    the calibrated one that the class is not `unknown`; paragraphs for which that is below ENOUGH, or whose family has no
    template that shares PAIRS word pairs, one of them with a word that isn't a function word, have no row. It is confirmed, and then is `family`, if ALIKE of
    the word pairs of one of its templates, or of the paragraph's if it has fewer, are shared; else `family` is
    `unknown`: a notice of a family without template, or of none. Of classes that tie, the name later by alphabet counts.
    Null and empty texts have no paragraphs; repeated rows give repeated rows, null doc_ids stay; no documents, no rows.

    Texts are read and split once. Each distinct paragraph is classified once, summed before the shuffle, so a notice
    that a third of all documents carry is one row; its verdict is joined back by MD5, from a written table that is
    broadcast up to a number of rows and else shuffled, where Spark can split a key by size.
    """
    rows = written(paragraphs(docs).select("doc_id", F.col("n").alias("paragraph"), F.md5("text").alias("key"), "text"), "paragraphs")
    verdicts = written(classified(rows.select(F.col("text").alias("paragraph")).distinct()), "verdicts")
    return rows.select("doc_id", "paragraph", "key").join(by_size(verdicts), "key").select("doc_id", "paragraph", "family", "nearest", "probability", "similarity", "confirmed")
