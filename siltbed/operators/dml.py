"""Writes, as new operations for the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions.merge import REPLACE, Merge
from siltbed.operators.resolve import deduplicated, live, resolve


def upsert(state: DataFrame, batch: DataFrame, key: str = "k", merge: Merge = REPLACE) -> DataFrame:
    """State after a batch of operations; both sides may hold tombstones."""
    return resolve(state.unionByName(batch), key, merge)


def bulk_insert(batches: list[DataFrame], key: str = "k", merge: Merge = REPLACE) -> DataFrame:
    """State after many batches at once: one union, one fold."""
    rows = batches[0]
    for more in batches[1:]:
        rows = rows.unionByName(more)
    return resolve(rows, key, merge)


def replay(log: DataFrame, state: DataFrame | None = None, truncated: int | None = None, key: str = "k", merge: Merge = REPLACE) -> DataFrame:
    """State from the log's operations after `truncated`, each once, on top of what was durable by then."""
    log = deduplicated(log if truncated is None else log.filter(F.col("seq") > truncated))
    return resolve(log if state is None else state.unionByName(log), key, merge)


def test_and_set_absent(state: DataFrame, requests: DataFrame, key: str = "k") -> DataFrame:
    """Requests that win: their key has no live row, and of requests for one key the first by seq."""
    first = requests.groupBy(key).agg(*[F.min_by(c, "seq").alias(c) for c in requests.columns if c not in (key, "seq")], F.min("seq").alias("seq"))
    return first.join(live(state, key).select(key), key, "left_anti").select(*requests.columns)


def test_and_set_match(state: DataFrame, requests: DataFrame, key: str = "k", value: str = "v", expected: str = "expected") -> DataFrame:
    """Requests whose expected value is the stored one. A null expectation asks for a key without a live row."""
    stored = live(state, key).select(key, F.col(value).alias("_stored"), F.lit(True).alias("_there"))
    both = requests.join(stored, key, "left")
    absent = F.col(expected).isNull() & F.col("_there").isNull()
    return both.filter(absent | (F.col(expected) == F.col("_stored"))).drop("_stored", "_there")


def test_and_set_chain(state: DataFrame, requests: DataFrame, key: str = "k", value: str = "v", expected: str = "expected") -> DataFrame:
    """Requests in order of seq, each seeing what the earlier ones of its key have set; adds `won`.

    A key's requests are folded in one array: chains are per key, and a key's contention has to fit in a task.
    """
    stored = live(state, key).select(key, F.col(value).alias("_stored"))
    grouped = requests.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", expected, value))).alias("_asks")).join(stored, key, "left")
    kind = requests.schema[value].dataType.simpleString()
    zero = F.struct(F.col("_stored").alias("now"), F.array().cast("array<bigint>").alias("won"))

    def step(s, r):
        wins = s["now"].eqNullSafe(r[expected])
        return F.struct(F.when(wins, r[value]).otherwise(s["now"]).cast(kind).alias("now"), F.when(wins, F.concat(s["won"], F.array(r["seq"]))).otherwise(s["won"]).alias("won"))

    folded = grouped.select(key, F.aggregate("_asks", zero, step).alias("_end"), F.explode("_asks").alias("_ask"))
    return folded.select(key, "_ask.*", F.array_contains("_end.won", F.col("_ask.seq")).alias("won"))


def drop_all(ops: DataFrame, seq: int, key: str = "k") -> DataFrame:
    """A tombstone for each live key."""
    rows = live(ops, key)
    return rows.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) if c not in (key, "seq") else F.col(c) for c in rows.columns]).withColumn("seq", F.lit(seq).cast("long")).withColumn("is_delete", F.lit(True))


def collect_garbage(memory: DataFrame, merged: DataFrame, key: str = "k") -> DataFrame:
    """Operations still in memory that a merge has not taken: the same key and seq identify one, whatever its value is."""
    return memory.join(merged.select(key, "seq"), [key, "seq"], "left_anti")
