"""Batches of texts against one text after another."""

import random

import numpy as np
import pyarrow as pa

from siltbed.llm import shingles


def test_batches():
    rng = random.Random(1)
    texts = ["", None, " ", "a", "A b", "é É x", "foo\tbar\nBaz  qux\x0b\x0c\r ", "x" * 100 + " " + "y" * 300_000 + " z", "ab"]
    texts += ["".join(rng.choice("abC é\n\t中 ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    h, at = shingles.hashed_words(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        assert at[i + 1] - at[i] == len(words)
        assert all(seen.setdefault(w, v) == v for w, v in zip(words, h[at[i] : at[i + 1]].tolist(), strict=True))
    assert len(set(seen.values())) == len(seen)
    assert (shingles.hashed_words(pa.array(texts)[5:50])[0] == h[at[5] : at[50]]).all()
    for n in (1, 2, 5):
        every, to = shingles.shingled_rows(h, at, n)
        of = {}
        for i, text in enumerate(texts):
            words = (text or "").encode().lower().split()
            own = every[to[i] : to[i + 1]].tolist()
            plain = [tuple(words[k : k + n]) for k in range(max(len(words) - n + 1, bool(words)))]
            assert len(own) == len(plain) and all(of.setdefault(p, v) == v for p, v in zip(plain, own, strict=True))
            assert np.array_equal(shingles.shingled(h[at[i] : at[i + 1]], n), every[to[i] : to[i + 1]])
        assert len(set(of.values())) == len(of)
