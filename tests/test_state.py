"""The keyed state against a dictionary that the same operations are applied to."""

import random

import pytest
from pyspark.sql import functions as F

from siltbed.functions import keys
from siltbed.functions.merge import APPEND, REPLACE, folding
from siltbed.operators import dml, resolve, scan, stats

OPS = "k string, v string, seq long, is_delete boolean"


def random_ops(n, seed, keys_=60):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        k = f"k{rng.randrange(keys_):03d}"
        dead = rng.random() < 0.1
        out.append((k, None if dead else rng.choice(["", "a", "bb", "ccc"]), seq, dead))
    return out


def applied(ops, append=False):
    state = {}
    for k, v, _, dead in sorted(ops, key=lambda o: o[2]):
        if dead:
            state.pop(k, None)
        else:
            state[k] = state.get(k, "") + v if append else v
    return state


def as_dict(df):
    rows = df.collect()
    assert len({r["k"] for r in rows}) == len(rows)
    return {r["k"]: r["v"] for r in rows}


@pytest.mark.parametrize("merge", [REPLACE, APPEND])
def test_fold_of_folds(spark, merge):
    ops = random_ops(800, 1)
    df = spark.createDataFrame(random.Random(2).sample(ops, len(ops)), OPS)
    want = applied(ops, merge is APPEND)
    assert as_dict(resolve.live(df, merge=merge)) == want
    for cut in (1, 250, 799):
        old, new = resolve.resolve(df.filter(F.col("seq") < cut), merge=merge), resolve.resolve(df.filter(F.col("seq") >= cut), merge=merge)
        if merge is REPLACE:
            assert as_dict(resolve.merged(old, new, drop_deletes=True)) == want
            assert as_dict(resolve.by_precedence([new, old]).filter("not is_delete")) == want


def test_a_merge_of_ones_own(spark):
    longest = folding("longest", F.lit(""), lambda s, v: F.when(F.length(v) > F.length(s), v).otherwise(s))
    ops = [("a", "xx", 1, False), ("a", "y", 2, False), ("b", "zzz", 1, False), ("b", None, 2, True), ("b", "q", 3, False), ("c", None, 5, True)]
    assert as_dict(resolve.live(spark.createDataFrame(ops, OPS), merge=longest)) == {"a": "xx", "b": "q"}


def test_boundary_keys(spark):
    raw = [b"", b"\x00", b"a", b"a\x00", b"ab", b"\x7f", b"\x80", b"\xff"]
    rows = [(bytearray(k), bytearray(k), n, False) for n, k in enumerate(raw)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "k binary, v binary, seq long, is_delete boolean")
    assert [bytes(r["k"]) for r in scan.ordered(resolve.live(df)).collect()] == sorted(raw)
    got = scan.bounded(resolve.live(df), start=b"a", end=b"\x80", start_included=False, end_included=True).collect()
    assert sorted(bytes(r["k"]) for r in got) == [b"a\x00", b"ab", b"\x7f", b"\x80"]


def test_an_empty_value_is_not_a_tombstone(spark):
    df = spark.createDataFrame([("a", "x", 1, False), ("a", "", 2, False), ("b", "x", 1, False), ("b", None, 2, True), ("c", "x", 1, False), ("c", None, 2, False)], OPS)
    assert as_dict(resolve.live(df)) == {"a": "", "c": None}
    assert dml.collect_garbage(df, resolve.resolve(df)).count() == 3


def test_ttl_does_not_uncover(spark):
    df = spark.createDataFrame([("a", "old", 1, False), ("a", None, 3, True), ("b", "x", 2, False), ("c", "y", 9, False)], OPS)
    left = resolve.unexpired(resolve.resolve(df), 10, 5)
    assert {(r["k"], r["is_delete"]) for r in left.collect()} == {("a", True), ("c", False)}
    assert resolve.unexpired(resolve.resolve(df), 10, 8).filter("k = 'b'").count() == 1


def test_purge_needs_every_level_below(spark):
    make = lambda rows: spark.createDataFrame(rows, OPS)
    up = make([("a", None, 9, True), ("b", None, 9, True), ("c", "v", 9, False)])
    assert {r["k"] for r in resolve.purgeable(up, [make([("x", "v", 1, False)]), make([("b", "v", 1, False)])]).collect()} == {"a"}


def test_replay_twice_is_once(spark):
    ops = random_ops(300, 5)
    log = spark.createDataFrame(ops, OPS)
    for merge in (REPLACE, APPEND):
        want = applied(ops, merge is APPEND)
        assert as_dict(dml.replay(log.union(log), merge=merge).filter("not is_delete")) == want


def test_claims_of_free_keys_are_a_permutation(spark):
    """Every client asks for all keys in its own order; each key is won once, by the first that asked."""
    rng = random.Random(9)
    asks = [(f"{k:03d}", c, rng.random()) for c in range(128) for k in range(128)]
    asks = [(k, c, n) for n, (k, c, _) in enumerate(sorted(asks, key=lambda a: a[2]))]
    df = spark.createDataFrame(asks, "k string, v long, seq long")
    won = dml.test_and_set_absent(df.limit(0).withColumn("is_delete", F.lit(False)), df).collect()
    assert sorted(r["k"] for r in won) == [f"{k:03d}" for k in range(128)]
    first = {}
    for k, c, _ in asks:
        first.setdefault(k, c)
    assert {r["k"]: r["v"] for r in won} == first


def test_compare_and_set(spark):
    state = spark.createDataFrame([("a", "1", 1, False), ("b", None, 2, True)], OPS)
    asks = spark.createDataFrame([("a", 5, "1", "2"), ("a", 6, "2", "3"), ("a", 7, "1", "9"), ("b", 8, None, "x"), ("c", 9, "y", "z")], "k string, seq long, expected string, v string")
    assert {r["seq"] for r in dml.test_and_set_match(state, asks.withColumnRenamed("v", "new").withColumn("v", F.col("new"))).collect()} == {5, 7, 8}
    assert {r["seq"] for r in dml.test_and_set_chain(state, asks).collect() if r["won"]} == {5, 6, 8}


def test_histogram(spark):
    rows = lambda n: spark.range(n).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("k"))
    got = sorted(tuple(r) for r in stats.histogram(rows(100), 5).select("i", "k", "stride").collect())
    assert [g[0] for g in got] == [1, 27, 53, 79, 100] and {g[2] for g in got} == {26} and got[1][1] == "0026"
    assert stats.histogram(rows(4), 4).count() == 4
    assert stats.histogram(rows(0), 4).count() == 0
    with pytest.raises(ValueError):
        stats.histogram(rows(10), 2)


def test_limits(spark):
    rows = spark.createDataFrame([(f"{n:02d}", "v" * n) for n in range(1, 20)], "k string, v string")
    size = F.octet_length("k") + F.octet_length("v")
    assert [r["k"] for r in scan.within_bytes(rows, size, max_bytes=8).collect()] == ["01", "02", "03"]
    assert [r["k"] for r in scan.within_bytes(rows, size, max_records=2, max_bytes=8).collect()] == ["01", "02"]
    assert [r["k"] for r in scan.within_bytes(rows, size, max_bytes=20, descending=True).collect()] == ["19"]
    assert scan.within_bytes(rows, size).count() == 19


def test_encodings(spark):
    df = spark.createDataFrame([(5, "a", "b"), (300, "a", "bb"), (70000, "aa", "")], "n long, x string, y string")
    got = df.select(keys.integer_key(F.col("n")).alias("i"), keys.composite_key(F.col("x"), F.col("y")).alias("c"), keys.map_key(F.col("n"), F.encode("x", "UTF-8")).alias("m"), keys.stamp_of(keys.stamped_key(F.encode("x", "UTF-8"), F.col("n"))).alias("s")).collect()
    assert [bytes(r["i"]) for r in got] == [n.to_bytes(8, "big") for n in (5, 300, 70000)]
    assert bytes(got[0]["c"]) == b"a\xfeb" and bytes(got[1]["m"]) == (300).to_bytes(4, "big") + b"a"
    assert [r["s"] for r in got] == [5, 300, 70000]


def test_sizes():
    assert stats.size_ratio(0, 100) == 3.0 and stats.size_ratio(10_000, 1) == 100.0
    assert stats.should_promote(400, 100, 3.0) and not stats.should_promote(200, 100, 3.0)


def test_range_filters_reach_the_scan(spark, sf):
    from siltbed.plans import oplog

    plan = resolve.live(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("k"), "source", F.col("doc_id").alias("seq"), F.lit(False).alias("is_delete"))).filter("k >= 5 and k < 9")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,5)" in plan and "LessThan(doc_id,9)" in plan
    assert "text" not in plan and oplog.last_seq(oplog.ops(spark, sf)) > 0
