"""Quality against held-out labels."""

import random

from siltbed.llm import quality
from siltbed.llm.queries import op8_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    hidden = labels.filter("doc_id % 3 = 0")
    got = {r["doc_id"]: r["kept"] for r in quality.score(docs, labels.filter("doc_id % 3 <> 0")).collect()}
    rows = hidden.collect()
    good = [got[r["doc_id"]] for r in rows if r["quality"] == 1]
    bad = [got[r["doc_id"]] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_op8_is_whole_and_stable(spark, sf):
    one, two = ({tuple(r) for r in op8_quality(spark, sf).collect()} for _ in range(2))
    assert one == two and len(one) == 200


def test_rounds_teach_the_other_view(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for d in range(600):
        bad = d % 3 == 0
        text = " ".join(rng.choice("alpha beta gamma delta".split()) + ("$$$" if bad else "") for _ in range(rng.randrange(5, 60)))
        rows.append((d, text, "en", "junk" if bad else "good", len(text)))
        if d < 60:
            labels.append((d, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = quality.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert {r["doc_id"] for r in got if not r["kept"]} == set(range(0, 600, 3))


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", None, None, None), (2, "a b", None, None, None), (3, "x " * 200_000, "en", "s", 400_000), (4, " \n\n ", "en", "s", -5)]
    rows += [(n, "good words stand here, and more." if n % 2 else "BAD!! BAD!! $$$ $$$", "en", "s", 30) for n in range(10, 60)]
    types = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, 0.1, "q") for r in rows], types + ", content double, quality string")
    labels = spark.createDataFrame([(n, n % 2, 5) for n in range(10, 40)] + [(1, None, 0), (None, 1, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["p_quality"] <= 1 for r in got)
    assert {r["kept"] for r in quality.score(docs, labels.limit(0)).collect()} == {True}
    assert quality.score(docs.limit(0), labels).count() == 0
