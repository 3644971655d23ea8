"""State of an op-log: ops(key, values..., seq, is_delete) folded by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.functions.merge import REPLACE, Merge
from siltbed.operators.stats import with_previous

OWN = ("seq", "is_delete", "level")


def values_of(ops: DataFrame, key: str) -> list[str]:
    return [c for c in ops.columns if c != key and c not in OWN]


def resolve(ops: DataFrame, key: str = "k", merge: Merge = REPLACE) -> DataFrame:
    """One row for each key, tombstones included. A filter on the key reaches the scan through the aggregate."""
    return merge.fold(ops, key, values_of(ops, key))


def live(ops: DataFrame, key: str = "k", merge: Merge = REPLACE) -> DataFrame:
    """resolve() without tombstones, which have to take part in the fold and so go last."""
    return resolve(ops, key, merge).filter(~F.col("is_delete")).drop("is_delete")


def partial(ops: DataFrame, key: str = "k", merge: Merge = REPLACE) -> DataFrame:
    """resolve() for rows that older ones will still be folded with.

    Where a merge builds on what was there, a live row that stands on a tombstone keeps that tombstone beside it, so that
    nothing older comes back under it.
    """
    rows = resolve(ops, key, merge)
    if merge.name == REPLACE.name:
        return rows
    cut = ops.filter("is_delete").groupBy(key).agg(F.max("seq").alias("seq"))
    kept = cut.join(rows.filter(~F.col("is_delete")).select(key), key)
    nulls = [F.lit(None).cast(ops.schema[c].dataType).alias(c) for c in values_of(ops, key)]
    return rows.unionByName(kept.select(key, *nulls, "seq", F.lit(True).alias("is_delete")))


def deduplicated(ops: DataFrame) -> DataFrame:
    """Operations once for each seq: a log that was read twice gives the same state, also with merges that aren't idempotent."""
    return ops.dropDuplicates(["seq"])


def by_precedence(levels: list[DataFrame], key: str = "k") -> DataFrame:
    """Union of resolved levels, newest first: of each key the row of the first level that has it."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("level", F.lit(n)) for n, df in enumerate(levels)])
    first = [F.min_by(c, "level").alias(c) for c in rows.columns if c not in (key, "level")]
    return rows.groupBy(key).agg(*first)


def merged(old: DataFrame, new: DataFrame, key: str = "k", merge: Merge = REPLACE, drop_deletes: bool = False) -> DataFrame:
    """Two levels' rows as one: a full outer merge by key, as one union and aggregate, which combines before its one shuffle."""
    rows = resolve(old.unionByName(new), key, merge)
    return rows.filter(~F.col("is_delete")) if drop_deletes else rows


def purgeable(upper: DataFrame, below: list[DataFrame], key: str = "k") -> DataFrame:
    """Tombstones of `upper` that hide nothing: no level below has their key."""
    out = upper.filter("is_delete")
    for df in below:
        out = out.join(df.select(key), key, "left_anti")
    return out


def unexpired(rows: DataFrame, now: int, expiry: int) -> DataFrame:
    """Rows of at most `expiry` operations ago, tombstones whatever their age: what they hide must not come back.

    Goes after resolve(), so that an expired version never uncovers an older one.
    """
    return rows.filter(F.col("is_delete") | (F.col("seq") >= now - expiry)) if expiry else rows


def out_of_order(rows: DataFrame, key: str, within: str) -> DataFrame:
    """Rows of an ordered run whose key isn't larger than the one before; `within` is a column that splits the run.

    The run is cut into ranges of seq, each its own task, and a range's first row is held against the last one before.
    """
    return with_previous(rows, within, "seq", "_before", key).filter(F.col("_before") >= F.col(key)).drop("_before")
