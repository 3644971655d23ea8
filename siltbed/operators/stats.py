"""Statistics: histogram by key, space, merges and requests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a row costs in memory besides its own, and the part that allocation adds.
PER_ROW, OVERHEAD = 220, 1.04
#: Ranges that an order is cut into where each row looks at the one before.
BUCKETS = 1024


def ranked(rows: DataFrame, key: str = "k", to: str = "i") -> DataFrame:
    """Rows with their rank from 1 in key order, without a window over all rows.

    Ranges of keys are ordered each in its own task, and the counts of the ranges before give each its first rank. The
    ranges are kept in storage, so both readers see the same ones.
    """
    ranges = rows.repartitionByRange(key).withColumn("_range", F.spark_partition_id()).persist()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_range").orderBy(key)
    return ranges.withColumn("_own", F.row_number().over(own)).join(first, "_range").withColumn(to, (F.col("_first") + F.col("_own")).cast("long")).drop("_range", "_own", "_first")


def histogram(rows: DataFrame, limit: int, key: str = "k") -> DataFrame:
    """At most `limit` keys that stand a stride apart, with the first and the last: i, key, stride."""
    if limit < 3:
        raise ValueError("a histogram needs three keys at least")
    n = rows.count()
    stride = n // (limit - 1) + 1 if n > limit else 1
    picked = ranked(rows.select(key), key).filter(((F.col("i") - 1) % stride == 0) | (F.col("i") == n))
    return picked.withColumn("stride", F.lit(stride).cast("long"))


def level_stats(levels: DataFrame, key: str = "k") -> DataFrame:
    """Operations, keys and tombstones of each level."""
    return levels.groupBy("level").agg(F.count(F.lit(1)).alias("ops"), F.countDistinct(key).alias("keys"), F.sum(F.col("is_delete").cast("long")).alias("tombstones"))


def space_usage(rows: DataFrame, size: Column, by: str) -> DataFrame:
    """Rows, bytes and the bytes that they would take in memory, by a column."""
    total, n = F.sum(size), F.count(F.lit(1))
    estimate = F.greatest((total + PER_ROW * n).cast("double"), F.lit(OVERHEAD) * total)
    return rows.groupBy(by).agg(n.alias("n"), total.alias("bytes"), estimate.alias("memory_bytes"))


def request_stats(requests: DataFrame, kind: str, took: str) -> DataFrame:
    return requests.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(took), 6).alias("total"), F.round(F.avg(took), 6).alias("mean"))


def running_mean(runs: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Mean of the runs so far, for each `by`."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("mean", F.avg(value).over(so_far))


def decayed(samples: DataFrame, by: str, seconds: str, value: str, life: float = 60.0) -> DataFrame:
    """Exponentially decayed mean of a throughput, (1 - d) * x + d * before with d = exp(-dt / life), after the last sample.

    Written out, a sample counts for what its own step adds, decayed since: so a group needs the gap to the sample
    before, and a sum that combines before the shuffle. Samples of one moment after the first count for nothing, and of
    the first moment's samples the smallest value is the first. The gaps are taken in ranges of time, whose tasks know
    the last moment of the range before, so no group is ordered in one task.
    """
    moments = samples.groupBy(by, seconds).agg(F.min(value).alias("_x"))
    gaps = with_previous(moments, by, seconds).withColumn("_gap", F.col(seconds) - F.col("_previous"))
    ends = samples.groupBy(by).agg(F.max(seconds).alias("_end"))
    share = F.when(F.col("_gap").isNull(), 1.0).otherwise(1 - F.exp(-F.col("_gap") / life))
    each = gaps.join(F.broadcast(ends), by).withColumn("_w", share * F.col("_x") * F.exp((F.col(seconds) - F.col("_end")) / life))
    return each.groupBy(by).agg(F.sum("_w").alias("rate"))


def with_previous(rows: DataFrame, by: str, order: str, to: str = "_previous", carried: str | None = None) -> DataFrame:
    """Adds what the row before has in `carried` (or `order`), among the rows of the same `by`, without ordering all of them in one task.

    Rows are dealt to BUCKETS buckets of equal width in `order`; each bucket is a window of its own, and its first row
    takes the last one of the buckets before, of which there is a row for each bucket and `by`.
    """
    carried = carried or order
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = max((high - low) / BUCKETS, 1e-9) if low is not None else 1.0
    dealt = rows.withColumn("_bucket", F.floor((F.col(order) - F.lit(low)) / F.lit(step)).cast("int"))
    last = dealt.groupBy(by, "_bucket").agg(F.max_by(carried, order).alias("_last"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_carry", F.last("_last").over(before)).drop("_last")
    own = F.lag(F.struct(F.col(carried).alias("x"))).over(Window.partitionBy(by, "_bucket").orderBy(order))
    joined = dealt.withColumn("_own", own).join(last, [by, "_bucket"])
    return joined.withColumn(to, F.when(F.col("_own").isNull(), F.col("_carry")).otherwise(F.col("_own.x"))).drop("_bucket", "_own", "_carry")


def size_ratio(large_bytes: int, mean_run_bytes: float) -> float:
    """How many times larger each level is than the one above it."""
    return max(3.0, math.sqrt(large_bytes / mean_run_bytes)) if mean_run_bytes else 3.0


def should_promote(level_bytes: int, mean_run_bytes: float, ratio: float) -> bool:
    """Whether a level has grown out of its ratio and goes to the next."""
    return bool(mean_run_bytes) and 1.05 * level_bytes / mean_run_bytes > ratio
