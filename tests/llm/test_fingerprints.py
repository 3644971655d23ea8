"""Fingerprints: order, edited texts and sketches against plain versions."""

import hashlib

from siltbed.llm import fingerprints
from siltbed.llm.queries import op4_fingerprints


def plain_words(t):
    return t.lower().translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).replace(" ", "\n").split("\n")


def held(texts, rows):
    """texts: (doc_id, text) with distinct ids; checks rows of fingerprints()."""
    order = sorted(texts, key=lambda x: -x[0])
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(rows) == len(texts)
    prints = {}
    for (d, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        t, after, r = t or "", after or "", got[d]
        n = len(t)
        edited = t[: n - n // 2] + after[: n // 2]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        prints.setdefault(edited, r["edited_fingerprint"])
        assert prints[edited] == r["edited_fingerprint"]
        if after == t:
            assert r["near_next"] == 1
    return got


def test_op4(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = held(texts, op4_fingerprints(spark, sf).collect())
    text = dict(texts)
    errors = []
    for d, r in got.items():
        words = [w for w in plain_words(text[d]) if w]
        if len(words) > 400:
            true = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
            errors.append(len(r["fingerprint"].split(",")) / len(true) - 1 / fingerprints.KEEP)
            assert 0.3 < r["near_edited"] <= 1
    assert errors and abs(sum(errors) / len(errors)) < 0.02


def test_sketches_merge_and_estimate_containment(spark):
    words = [f"w{i}" for i in range(6000)]
    rows = [(1, " ".join(words[:3000])), (2, " ".join(words[:6000])), (3, " ".join(words[2996:6000])), (4, " ".join(words[2400:2800]))]
    df = fingerprints.with_sketch(spark.createDataFrame(rows, "id int, text string"), "text", "s")
    s = {r["id"]: set(r["s"]) for r in df.collect()}
    assert s[1] | s[3] == s[2]
    near = df.alias("a").join(df.alias("b"), "id").count() and {
        (x, y): len(s[x] & s[y]) / min(len(s[x]), len(s[y])) for x in s for y in s
    }
    assert near[1, 2] == 1 and near[4, 1] == 1 and near[1, 3] < 0.02


def test_following_over_blocks(spark, monkeypatch):
    keys = [0, 1, 5, 511, 512, 513, 2000, 100_000, 5_000_000_000, -7, -600] + list(range(10_000, 14_000, 3))
    want = dict(zip(sorted(keys, reverse=True), sorted(keys, reverse=True)[1:] + [max(keys)], strict=True))
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for blocks in (4096, 3):
        monkeypatch.setattr(fingerprints, "BLOCKS", blocks)
        assert {r["key"]: r["next"] for r in fingerprints.following(df).collect()} == want


def test_odd_rows(spark):
    texts = [(0, None), (1, ""), (2, "a"), (3, "one two"), (600, "é" * 30_001), (601, "x y z " * 40_000), (5_000_000, "same text of some words here"), (5_000_001, "same text of some words here"), (7, " \n "), (8, "Ab cD\te f g h")]
    docs = spark.createDataFrame([(d, t, "n", 1, "b") for d, t in texts], "doc_id long, text string, _next string, n_chars int, _block string")
    held(texts, fingerprints.fingerprints(docs).collect())
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    alone = fingerprints.fingerprints(docs.filter("doc_id = 8")).collect()
    held([texts[-1]], alone)
    more = spark.createDataFrame([(None, "a b c"), (4, "z"), (4, "a"), (4, "a"), (3, "q")], "doc_id long, text string")
    rows = fingerprints.fingerprints(more).collect()
    assert len(rows) == 5 and [r["near_next"] for r in rows if r["doc_id"] is None] == [1.0]
