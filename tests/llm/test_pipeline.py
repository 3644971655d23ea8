"""The pipeline's stages, each against a plain version on its own input."""

import re

import corpus_pipeline
from siltbed.llm import pii
from tests.llm.test_near_dedup import plain
from tests.llm.test_pii import PLAIN
from tests.llm.test_substring_dedup import verbatim
from tests.llm.test_tokens import held

TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    sf_labels = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = rows_of(docs)
    step = dict(corpus_pipeline.STAGES)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = rows_of(step["quality"](spark, docs, sf_labels))
    assert all(kept[d] == before[d] for d in kept)
    assert sum(d in kept for d, q in labels.items() if q) / sum(labels.values()) > 0.97
    good = spark.createDataFrame(list(kept.values()), TYPES)
    one = rows_of(step["near_dedup"](spark, good, sf))
    assert set(one) == {d for d, _, _, k in plain([(d, r["text"]) for d, r in kept.items()], 5) if k}
    cut = rows_of(step["substring_dedup"](spark, spark.createDataFrame(list(one.values()), TYPES), sf))
    assert set(cut) == set(one)
    need, _ = verbatim([(d, r["text"]) for d, r in one.items()])
    assert {d for d in cut if cut[d]["text"] != one[d]["text"]} >= set(need)
    assert not verbatim([(d, r["text"]) for d, r in cut.items()])[0]
    assert all(r["n_chars"] == len(r["text"]) for d, r in cut.items() if r["text"] != one[d]["text"])
    masked = rows_of(step["pii"](spark, spark.createDataFrame(list(cut.values()), TYPES), sf))
    assert set(masked) == set(cut)
    for d, r in masked.items():
        assert not any(good(m[0]) for p, good in PLAIN.values() for m in re.finditer(p, r["text"]))
        assert r["text"] == cut[d]["text"] or pii.find(cut[d]["text"])
    packed = step["packing"](spark, spark.createDataFrame(list(masked.values()), TYPES), sf).collect()
    used, least = held([(d, r["text"]) for d, r in masked.items()], packed, 2048)
    assert used <= least + 1


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b", None, None, None), (2, "a b", None, None, None), (3, "x y z " * 20_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], TYPES + ", key string, spans int")
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "quality":
            assert stage(spark, docs, sf).count() == len(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert set(dict(corpus_pipeline.STAGES)["quality"](spark, docs, sf).columns) == set(corpus_pipeline.COLUMNS)
