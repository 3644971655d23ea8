"""Licence families on sentences that were not trained on, and on the documents' own notices."""

import collections
import math

import regex

from siltbed.llm import licenses
from siltbed.llm.queries import op10_licenses

NEW = {
    "Licensed under the Apache License, Version 2.0, see the file for more.": "apache-2.0",
    "# Released under the MIT License, 2021 by the authors": "mit",
    "This file is licensed under the GNU General Public License version 3": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "Her fishing license was valid under the law": None,
    "The copyright lecture is free and open to the general public": None,
    "He asked for permission to leave the library early": None,
    "The warranty covers all parts of the machine": None,
}


def test_new_sentences(spark):
    docs = spark.createDataFrame([(n, f"Some line.\n{t}\nmore") for n, t in enumerate(NEW)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect() if r["confirmed"]}
    assert {n: got[n]["family"] if n in got else None for n in range(len(NEW))} == dict(enumerate(NEW.values()))
    assert {r["paragraph"] for r in got.values()} == {1}


def plain(text):
    """What scan() gives for a text, paragraph by paragraph, without Spark and without its filters."""
    weights, bias, temperature = licenses.trained()
    telling = {p for v in licenses.TEMPLATES.values() for t in v for p in licenses.pairs_of(licenses.words_of(t)) if not licenses.FUNCTION_WORDS.issuperset(p.split())}
    for n, paragraph in enumerate(regex.sub(licenses.WRAP, " ", text).split("\n")):
        words = licenses.words_of(paragraph)
        grams = licenses.grams_of(words)
        scale = math.sqrt(min(licenses.GRAMS, max(1, len(grams))))
        z = [(sum(weights[g][c] for g in grams if g in weights) / scale + b) / temperature for c, b in enumerate(bias)]
        top = max(range(1, len(z)), key=z.__getitem__)
        probability = 1 - 1 / sum(math.exp(v - z[0]) for v in z)
        nearest = licenses.CLASSES[top]
        own = set(licenses.pairs_of(words))
        similarity = 0.0
        for t in licenses.TEMPLATES.get(nearest, []):
            other = set(licenses.pairs_of(licenses.words_of(t)))
            if len(own & other) >= licenses.PAIRS and own & other & telling:
                similarity = max(similarity, len(own & other) / min(len(own), len(other)))
        if probability >= licenses.ENOUGH and similarity:
            yield n, nearest if similarity >= licenses.ALIKE else "unknown", nearest, probability, similarity


def test_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = [(10_000_000 + n, t) for n, t in enumerate([*NEW, *WRAPPED.values(), *FOREIGN, *SHORT, *licenses.UNKNOWN, *(t for v in licenses.TEMPLATES.values() for t in v)])]
    want = {(d, n): rest for d, t in texts + made for n, *rest in plain(t or "")}
    got = {(r["doc_id"], r["paragraph"]): r for r in licenses.scan(docs.union(spark.createDataFrame(made, docs.schema))).collect()}
    assert got.keys() == want.keys() and len(want) > 60
    for at, (family, nearest, probability, similarity) in want.items():
        r = got[at]
        assert (r["family"], r["nearest"]) == (family, nearest)
        assert abs(r["probability"] - probability) < 2e-6 and abs(r["similarity"] - similarity) < 2e-6


WRAPPED = {
    "mit": """# Permission is hereby granted, free of charge, to any person obtaining a
# copy of this software and associated documentation files (the "Software"),
# to deal in the Software without restriction, including without limitation
# the rights to use, copy, modify, merge, publish, distribute, sublicense,
# and/or sell copies of the Software.""",
    "apache-2.0": """ * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "gpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
}

#: Sentences of notices of families without templates: ISC, zlib, EPL, Boost, the PostgreSQL licence.
FOREIGN = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted.",
]

SHORT = {
    "Text available under CC BY-SA 4.0.": "cc-by-sa",
    "Released under the GPL v3.": "gpl",
    "Dedicated under CC0 1.0 Universal.": "public-domain",
    "Distributed under BSD 3-Clause terms.": "bsd",
}


def families(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = collections.defaultdict(set)
    for r in licenses.scan(docs).collect():
        out[r["doc_id"]].add((r["paragraph"], r["family"]))
    return [out[n] for n in range(len(docs.collect()))]


def test_wrapped_notices_are_one_paragraph(spark):
    assert families(spark, [f"First line.\n\n{t}\n\nMore." for t in WRAPPED.values()]) == [{(2, name)} for name in WRAPPED]


def test_short_notices_without_licence_words(spark):
    assert families(spark, SHORT) == [{(0, name)} for name in SHORT.values()]


def test_unseen_families_get_no_family(spark):
    assert all(name == "unknown" for found in families(spark, FOREIGN) for _, name in found)


def test_every_template_is_found_with_its_family(spark):
    rows = [(name, t) for name, v in licenses.TEMPLATES.items() for t in v]
    got = families(spark, [t for _, t in rows])
    assert sum(found == {(0, name)} for found, (name, _) in zip(got, rows, strict=True)) >= len(rows) - 1


def test_op10(spark):
    sf = "/root/testdata/sf0.01"
    notice = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    want = collections.Counter((r["doc_id"], n, notice[x]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for n, x in enumerate(r["text"].split("\n")) if x in notice)
    got = op10_licenses(spark, sf).collect()
    assert collections.Counter((r["doc_id"], r["paragraph"], r["family"]) for r in got if r["confirmed"]) == want and len(want) > 30


def test_odd_rows(spark):
    mit = "Released under the MIT License."
    rows = [(None, mit), (1, None), (2, ""), (3, mit), (3, mit), (4, "\n" * 5 + mit + " " + "word " * 50_000), (5, "licence " * 50_000), *((n, mit) for n in range(10, 200))]
    docs = spark.createDataFrame([(d, t, "p", "f") for d, t in rows], "doc_id long, text string, paragraph string, family string")
    got = [r for r in licenses.scan(docs).collect() if r["doc_id"] not in (4, 5)]
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter([None, 3, 3, *range(10, 200)])
    assert licenses.scan(docs.limit(0)).count() == 0
