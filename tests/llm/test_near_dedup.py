"""Near duplicates against all pairs compared."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from siltbed.llm import near_dedup
from siltbed.llm.queries import op3_near_dedup


def plain_sets(texts, n):
    out = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    return out


def plain(texts, n):
    sets = plain_sets(texts, n)
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    index = {}
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) * 100 >= 80 * max(len(x), len(y)) > 0 and top(a) != top(b):
            shared = len(x & y)
            if 100 * shared >= 80 * (len(x) + len(y) - shared):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {(d, len(s), top(d), top(d) == d) for d, s in sets.items()}


def test_op3(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in op3_near_dedup(spark, sf).collect()} == plain(texts, 2)


@pytest.mark.parametrize("tile", [512, 16])
def test_a_group_of_near_copies_that_link_in_chains(spark, tile, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "TRIES", 2)
    rng = random.Random(tile)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=150)
    texts = []
    for d in range(150):
        own = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 18)):
            own[at] = rng.choice(vocabulary)
        texts.append((d, " ".join(own)))
    chain = rng.choices(vocabulary, k=100)
    for d in range(200, 230):
        texts.append((d, " ".join(chain)))
        chain = chain[4:] + rng.choices(vocabulary, k=4)
    docs = spark.createDataFrame([(d, t, "s") for d, t in texts], "doc_id long, text string, id string")
    assert {tuple(r) for r in near_dedup.near_duplicates(docs, 2).collect()} == plain(texts, 2)


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "a b"), (7, "A  b"), (8, "é É"), (9, "x y " * 20_000), (10, "x y " * 20_001), *((n, "the same text here again") for n in range(20, 300))]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in [*texts, (None, "a b"), (4, "One")]], "doc_id long, text string, key string, component long")
    got = near_dedup.near_duplicates(docs, 2).collect()
    assert {tuple(r) for r in got if r["doc_id"] is not None} == plain(texts, 2)
    assert len(got) == len(texts) + 2
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, 1, None, True)]
    assert near_dedup.near_duplicates(docs.limit(0), 2).count() == 0


def test_the_estimate_is_corrected():
    rng = np.random.default_rng(1)
    errors = []
    for j in (0.0, 0.3, 0.8, 1.0):
        for _ in range(30):
            shared, own = int(1000 * j), 1000 - int(1000 * j)
            pool = rng.integers(0, 1 << 64, shared + 2 * own, dtype=np.uint64)
            a, b = (near_dedup.packed(near_dedup.minima(x)[None]) for x in (pool[: shared + own], np.concatenate([pool[:shared], pool[shared + own :]])))
            missed = sum(bin(int(x)).count("1") for x in _groups(a[0] ^ b[0]))
            agree = 1 - missed / near_dedup.HASHES
            errors.append((agree - 1 / 16) / (15 / 16) - shared / (shared + 2 * own))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.035


def _groups(d):
    g = d | d >> np.uint64(1)
    return (g | g >> np.uint64(2)) & np.uint64(0x1111111111111111)


def test_components(spark):
    rng = random.Random(6)
    edges = [(n, n + 1) for n in range(0, 300) if n % 40] + [(1000, n) for n in range(1001, 1400)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    root = {v: v for e in edges for v in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    assert {tuple(r) for r in got.collect()} == set(root.items())
