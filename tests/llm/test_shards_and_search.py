"""Sharding and exact search against plain versions."""

import collections
import math
import random
import zlib

from siltbed.llm import sharding, top_k
from siltbed.llm.queries import op1_top_k, op5_sharding

SHARDS = 8


def held(texts, rows, rounds=True):
    """Checks rows of shard(); texts: (doc_id, text). Returns the shards' bytes."""
    raw = [(d, (t or "").encode()) for d, t in texts]
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((d, len(b) + 1, zlib.crc32(b)) for d, b in raw)
    slots, where, total = collections.defaultdict(list), collections.defaultdict(set), collections.Counter({s: 0 for s in range(SHARDS)})
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        where[r["size"], r["text_crc32"]].add(r["shard"])
        total[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in where.values())
    return [total[s] for s in range(SHARDS)]


def test_op5(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op5_sharding(spark, sf).collect()
    total = held(texts, rows)
    assert max(total) - min(total) <= max(r["size"] for r in rows)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def test_shard_odd_rows(spark, monkeypatch):
    texts = [(None, None), (1, ""), (2, "a"), (2, "a"), (3, "é" * 50_000), *((n, "hot") for n in range(10, 400)), *((n, str(n) * (n % 7)) for n in range(400, 900))]
    docs = spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in texts], "doc_id long, text string, item string, size int, shard string, block int")
    held(texts, sharding.shard(docs).collect())
    monkeypatch.setattr(sharding, "FAN_IN", 16)
    total = held([x for x in texts if x[0] != 3], sharding.shard(docs.filter("doc_id is null or doc_id != 3")).collect())
    assert sum(total) == sum(len((t or "").encode()) + 1 for d, t in texts if d != 3)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_large_groups_beside_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN_IN", 128)
    rng = random.Random(4)
    sizes = [rng.randrange(100, 20_000) for _ in range(2000)]
    for shares in ((0.06,), (0.12, 0.05), (1 / 3,)):
        large = [int(sum(sizes) * x / (1 - sum(shares))) for x in shares]
        groups = [(str(n).encode(), x) for n, x in enumerate(sizes + large)]
        got = {bytes(r["item"]): r["shard"] for r in sharding.shards_of(spark.createDataFrame(groups, "item binary, bytes long"), SHARDS).collect()}
        total = collections.Counter()
        for item, x in groups:
            total[got[item]] += x
        even = sum(x for _, x in groups) / SHARDS
        assert len(got) == len(groups) and max(total.values()) <= 1.01 * max(even, *large), (shares, total)


def test_difference_is_tight():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 20_000) for _ in range(1000)]
    goes = sharding.difference([(s, *[0] * 7) for s in sizes])
    total = collections.Counter()
    for s, g in zip(sizes, goes, strict=True):
        assert sorted(g) == list(range(8))
        total[g[0]] += s
    assert max(total.values()) - min(total.values()) < 20


def brute(rows, k=5):
    def whole(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    parts = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and whole(v)]
    out = set()
    for q in sorted({i for i, _ in parts if i % 50 == 0}):
        own = max(v for i, v in parts if i == q)
        scored = sorted((-min(max(sum(a * b for a, b in zip(own, v, strict=False)), -(2**63)), 2**63 - 1), i) for i, v in parts if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_op1(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op1_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect()} == brute(rows)


def test_search_odd_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * (rng.random() < 0.6) for _ in range(6)]) for i in range(300)]
    rows += [(0, [0.5] * 6), (50, None), (100, [None, 1.0]), (150, [float("nan")] * 6), (None, [1.0] * 6), (301, [float("inf")]), (350, []), (400, [1.0]), (302, rows[3][1]), (302, rows[3][1])]
    schema = "vec_id long, embedding array<double>, weights string, q int, c int, rank string"
    make = lambda rows: spark.createDataFrame([(*r, "w", 1, 1, "r") for r in rows], schema)
    for most in (1024, 32):
        monkeypatch.setattr(top_k, "FEWEST", most)
        monkeypatch.setattr(top_k, "QUERY_ROWS", most // 8)
        assert {tuple(r) for r in top_k.top_k(make(rows)).collect()} == brute(rows)
    assert top_k.top_k(make(rows).limit(0)).count() == 0
    huge = [(0, [1e30, 2.0]), (1, [1e30, 1.0]), (2, [-1e30, 3.0]), (3, [0.1, 0.2]), (50, [1e9, 1e9])]
    assert {tuple(r) for r in top_k.top_k(make(huge)).collect()} == brute(huge)
