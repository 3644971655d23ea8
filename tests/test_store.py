"""Stores, maps and streams."""

import math
import random

import pytest

from siltbed.operators import maps
from siltbed.plans import oplog
from siltbed.sources.store import Store
from siltbed.streaming import upsert
from tests.test_state import OPS, applied, as_dict, random_ops


@pytest.mark.parametrize("merge", ["replace", "append"])
def test_compaction_never_changes_a_read(spark, tmp_path, merge):
    ops = random_ops(600, 3)
    store = Store.create(spark, f"file://{tmp_path}/s", merge=merge)
    done = []
    for n, at in enumerate(range(0, 600, 100)):
        part = ops[at : at + 100]
        store.insert(spark.createDataFrame(part, OPS))
        done += part
        if n in (1, 4):
            store.compact(0)
        if n == 2:
            store.compact(0)
            store.compact(1)
        if n == 3:
            store.flush()
        again = Store.open(spark, store.path)
        assert as_dict(again.live()) == applied(done, merge == "append")
    store.compact(0)
    store.compact(1)
    assert {r["level"] for r in store.block_map()} == {2} and as_dict(store.live()) == applied(ops, merge == "append")
    assert store.ops().filter("is_delete").count() == 0
    store.vacuum()
    assert as_dict(Store.open(spark, store.path).live()) == applied(ops, merge == "append")


def test_reads(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s")
    assert store.live() is None and store.scan() is None
    store.insert(spark.createDataFrame([(f"k{n}", str(n), n, False) for n in range(9)], OPS))
    store.insert(spark.createDataFrame([("k3", None, 20, True), ("k4", "new", 21, False)], OPS))
    assert [r["v"] for r in store.scan("k2", "k6").collect()] == ["2", "new", "5"]
    assert [r["k"] for r in store.scan("k2", "k6", 2, False, True, True).collect()] == ["k6", "k5"]
    assert store.get("k4").first()["v"] == "new" and store.get("k3").count() == 0
    found = store.find(spark.createDataFrame([("k1",), ("k3",), ("zz",)], "k string")).collect()
    assert {r["k"]: r["found"] for r in found} == {"k1": True, "k3": False, "zz": False}


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", merge="append")
    batch = spark.createDataFrame([("a", "x", 1, False), ("a", "y", 2, False)], OPS)
    store.insert(batch)
    store.insert(batch)
    assert as_dict(store.live()) == {"a": "xy"} and len(store.block_map()) == 1


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    one = Store.create(spark, f"file://{tmp_path}/s")
    two = Store.open(spark, one.path)
    one.insert(spark.createDataFrame([("a", "x", 1, False)], OPS))
    with pytest.raises(RuntimeError):
        two.insert(spark.createDataFrame([("b", "y", 2, False)], OPS))
    assert as_dict(Store.open(spark, one.path).live()) == {"a": "x"}


def test_expiry(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", expiry=5)
    store.insert(spark.createDataFrame([(f"k{n}", str(n), n, False) for n in range(10)], OPS))
    store.compact(0)
    store.compact(1)
    assert set(as_dict(store.live())) == {f"k{n}" for n in range(4, 10)}


def test_the_map_script(spark):
    """Insert, get, update, add again, remove twice, and scans with either bound."""
    catalogue = spark.createDataFrame([("db", 3), ("db1", 4)], "name string, id long")
    key = "kkkkkkkkkkkkk"
    asks = lambda rows: spark.createDataFrame(rows, "map string, k string, v string")
    codes = lambda df: [r["response_code"] for r in df.orderBy("map", "k").collect()]
    empty = asks([("db", "x", "y")]).limit(0)
    done = maps.insert(catalogue, empty, asks([("db", f"{key}{n}", f"v{n}") for n in (1, 2, 3)]))
    assert codes(done) == ["Success"] * 3
    records = maps.after_writes(empty, done)
    assert [r["v"] for r in maps.get(catalogue, records, records.select("map", "k")).orderBy("k").collect()] == ["v1", "v2", "v3"]
    done = maps.update(catalogue, records, asks([("db", f"{key}{n}", f"v1{n}") for n in (0, 1, 2, 3)]))
    assert codes(done) == ["RecordNotFound", "Success", "Success", "Success"]
    records = maps.after_writes(records, done)
    assert codes(maps.add_maps(catalogue, spark.createDataFrame([("db",)], "name string")).withColumnRenamed("name", "map").selectExpr("map", "'' k", "response_code")) == ["MapExists"]
    records = maps.after_writes(records, maps.insert(catalogue, records, asks([("db1", "new key", "n")])))
    assert codes(maps.get(catalogue, records, asks([("db", "new key", ""), ("db1", "new key", ""), ("none", "a", "")]))) == ["RecordNotFound", "Success", "MapNotFound"]
    gone = maps.remove(catalogue, records, asks([("db1", "new key", None)]))
    assert codes(gone) == ["Success"]
    records = maps.after_writes(records, gone)
    assert codes(maps.remove(catalogue, records, asks([("db1", "new key", None)]))) == ["RecordNotFound"]
    assert codes(maps.insert(catalogue, records, asks([("db", f"{key}1", "z")]))) == ["RecordExists"]
    assert codes(maps.insert(catalogue, records, asks([("db", f"{key}1", "z")]), blind=True)) == ["Success"]
    got = lambda *a: [r["v"] for r in maps.scan(records, "db", *a, 100, 100).collect()]
    assert got("", "", True, True) == ["v11", "v12", "v13"]
    assert got(f"{key}1", f"{key}3", False, False) == ["v12"]
    assert got(f"{key}1", f"{key}3", True, True) == ["v11", "v12", "v13"]
    assert got(f"{key}2", f"{key}2", True, True) == ["v12"]
    assert got("k", f"{key}4", True, True) == ["v11", "v12", "v13"]
    assert maps.next_id(catalogue).first()[0] == 5 and maps.next_id(catalogue.limit(0)).first()[0] == 3
    assert maps.drop_map(records, "db").count() == 0


def test_streams_give_the_batch_state(spark, tmp_path):
    ops = random_ops(400, 8)
    rng = random.Random(4)
    for n in range(4):
        part = ops[n * 100 : n * 100 + 100]
        spark.createDataFrame(rng.sample(part, 100), OPS).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = lambda: spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    store = Store.create(spark, f"file://{tmp_path}/s")
    for _ in range(2):
        upsert.into_store(source(), store.path, f"file://{tmp_path}/c", flush_every=2).awaitTermination()
    assert as_dict(Store.open(spark, store.path).live()) == applied(ops)
    numbers = source().selectExpr("k", "cast(length(v) as double) v", "seq", "is_delete")
    seen = {}

    def collect(batch, _):
        for r in batch.collect():
            seen[r["k"]] = r

    upsert.live_state(numbers).writeStream.foreachBatch(collect).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert {k: r["v"] for k, r in seen.items() if not r["is_delete"]} == {k: float(len(v)) for k, v in applied(ops).items()}


def test_live_state_gives_only_what_changes(spark, tmp_path):
    """Late and repeated operations change nothing, a NaN stays one, and no key is a call of Python."""
    nan = float("nan")
    batches = [
        [("a", 1.0, 5, False), ("b", 2.0, 1, False), ("c", nan, 2, False), ("a", 9.0, 3, False)],
        [("a", 0.0, 4, False), ("b", 2.0, 1, False), ("b", 7.0, 1, False), ("c", nan, 2, False)],
        [("a", None, 6, True), ("d", None, 7, False), ("b", 3.0, 8, False)],
        [("a", 4.0, 9, False), ("d", 1.0, 6, False)],
    ]
    schema = "k string, v double, seq long, is_delete boolean"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    changes = upsert.live_state(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"))
    assert "Pandas" not in changes._jdf.queryExecution().analyzed().toString()
    seen, own = {}, spark.conf.get(upsert.STATE_STORE)

    def write(batch, number):
        seen[number] = {tuple(map(str, r)) for r in batch.select("k", "v", "seq", "is_delete").collect()}

    stream = upsert.on_changes(changes, write, f"file://{tmp_path}/c")
    stream.awaitTermination()
    assert [seen.get(n, set()) for n in range(4)] == [
        {("a", "1.0", "5", "False"), ("b", "2.0", "1", "False"), ("c", "nan", "2", "False")},
        set(),
        {("a", "None", "6", "True"), ("d", "None", "7", "False"), ("b", "3.0", "8", "False")},
        {("a", "4.0", "9", "False")},
    ]
    assert any(name.startswith("rocksdb") for name in stream.recentProgress[0]["stateOperators"][0]["customMetrics"]) and spark.conf.get(upsert.STATE_STORE) == own


def test_every_query_has_rows(spark):
    from siltbed.plans.queries import ORACLE_SQL, QUERIES

    assert set(QUERIES) == set(ORACLE_SQL)
    assert QUERIES["kv_resolve"](spark, "/root/testdata/sf0.001").columns == ["k", "v", "seq"]
    rows = oplog.ops(spark, "/root/testdata/sf0.001")
    assert rows.count() == 1000


def test_decayed_rate(spark):
    import math

    from siltbed.operators import stats

    samples = [("a", 0.0, 10.0), ("a", 60.0, 20.0), ("a", 90.0, 5.0)]
    got = stats.decayed(spark.createDataFrame(samples[::-1], "g string, t double, x double"), "g", "t", "x").first()["rate"]
    want = 10.0
    for (_, s, _), (_, t, x) in zip(samples, samples[1:], strict=False):
        d = math.exp(-(t - s) / 60)
        want = (1 - d) * x + d * want
    assert abs(got - want) < 1e-9


def test_an_expired_row_never_uncovers_an_older_one(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", expiry=5)
    store.insert(spark.createDataFrame([("a", "old", 1, False)], OPS))
    store.compact(0)
    store.compact(1)
    store.insert(spark.createDataFrame([("a", "new", 2, False), ("b", "x", 100, False)], OPS))
    reads = [as_dict(store.live())]
    for level in (0, 1):
        store.compact(level)
        reads.append(as_dict(store.live()))
    assert reads == [{"b": "x"}] * 3 and store.get("a").count() == 0
    assert [r["k"] for r in store.scan("a", "z").collect()] == ["b"]


def test_late_operations_stay(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s")
    store.insert(spark.createDataFrame([("a", "x", 10, False)], OPS))
    late = spark.createDataFrame([("b", "y", 9, False), ("c", "z", 11, False), ("a", "older", 3, False)], OPS)
    store.insert(late)
    store.insert(late)
    again = Store.open(spark, store.path)
    again.compact(0)
    again.insert(late)
    assert as_dict(again.live()) == {"a": "x", "b": "y", "c": "z"} and len(again.block_map()) == 1
    assert [r["k"] for r in again.scan("x", "y").collect()] == []


def test_each_row_and_the_one_before(spark):
    from siltbed.operators import resolve, stats

    rng = random.Random(4)
    rows = [(rng.choice("ab"), n, rng.randrange(1000), rng.random()) for n in range(3000)]
    df = spark.createDataFrame(rows, "g string, seq long, k long, x double")
    want, last = set(), {}
    for g, n, k, _ in rows:
        if g in last and last[g] >= k:
            want.add((g, n))
        last[g] = k
    assert {(r["g"], r["seq"]) for r in resolve.out_of_order(df, "k", "g").collect()} == want
    rate, at = {}, {}
    for g, n, _, x in rows:
        d = math.exp(-(n - at[g]) / 60) if g in at else 0.0
        rate[g], at[g] = (1 - d) * x + d * rate.get(g, 0.0), n
    got = {r["g"]: r["rate"] for r in stats.decayed(df, "g", "seq", "x").collect()}
    assert got.keys() == rate.keys() and all(abs(got[g] - rate[g]) < 1e-5 for g in rate)


def test_rows_without_bytes_count_for_nothing(spark):
    from siltbed.operators import scan

    rows = spark.createDataFrame([("", ""), ("a", ""), ("b", ""), ("c", "")], "k string, v string")
    size = scan.F.octet_length("k") + scan.F.octet_length("v")
    read = lambda **x: [r["k"] for r in scan.within_bytes(rows, size, **x).collect()]
    assert read(max_bytes=2) == ["", "a", "b"] and read(max_bytes=2, max_records=2) == ["", "a"]
    assert read(max_bytes=2, descending=True) == ["c", "b"] and read(max_bytes=9) == ["", "a", "b", "c"] and read(max_records=1) == [""]


def test_adding_dropping_and_how_scans_end(spark):
    catalogue = spark.createDataFrame([("db", 3), ("db1", 7)], "name string, id long")
    names = spark.createDataFrame([("x",), ("db",), ("b",), ("x",)], "name string")
    assert {tuple(r) for r in maps.new_maps(catalogue, names).collect()} == {("b", 8), ("x", 9)}
    assert {tuple(r) for r in maps.new_maps(catalogue.limit(0), names).collect()} == {("b", 3), ("db", 4), ("x", 5)}
    codes = maps.drop_maps(catalogue, names.distinct())
    assert {tuple(r) for r in codes.collect()} == {("x", "MapNotFound"), ("db", "Success"), ("b", "MapNotFound")}
    records = spark.createDataFrame([("db", "k1", "v"), ("db", "k2", "v"), ("db1", "k1", "v")], "map string, k string, v string")
    assert [tuple(r) for r in maps.after_writes(records, maps.dropped_records(records, codes)).collect()] == [("db1", "k1", "v")]
    assert maps.scan_code(catalogue, maps.scan(records, "none"), "none") == "MapNotFound"
    assert maps.scan_code(catalogue, maps.scan(records, "db"), "db", 9, 9) == "ScanEnded"
    assert maps.scan_code(catalogue, maps.scan(records, "db", max_records=1), "db", 1) == "Success"
