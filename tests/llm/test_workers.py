"""What a Python worker holds when it goes on from one operator to the next."""

import public_tokenizers
import pytest

from siltbed.llm import byte_bpe, near_dedup, packing, pii, quality, substring_dedup

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("operator", [quality.views, near_dedup.near_duplicates, substring_dedup.windows, substring_dedup._shingles, pii.find_pii, pii.redact])
def test_an_operator_without_caches_releases_those_of_others(spark, monkeypatch, operator):
    docs = spark.createDataFrame([(1, "some words", "en", "a", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    ran = []

    class Caught(Exception):
        pass

    def caught(df, f, *args, **options):
        ran.append((f, df.toArrow().to_batches()))
        raise Caught

    monkeypatch.setattr(type(docs), "mapInArrow", caught)
    with pytest.raises(Caught):
        operator(docs)
    texts = ["The same words as before, and more."]
    ids = packing.encode_texts(texts, WORDS)
    byte_bpe.encode_texts(texts, byte_bpe.vocabulary(RANKS, public_tokenizers.PATTERN))
    assert packing._chunks and byte_bpe._vocabularies
    f, batches = ran[0]
    assert sum(b.num_rows for b in f(iter(batches))) > 0 or operator is substring_dedup.windows
    assert not packing._chunks and not byte_bpe._vocabularies
    assert packing.encode_texts(texts, WORDS) == ids
