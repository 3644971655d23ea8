"""Reads of resolved rows: point and batch lookups, range scans with row and byte limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.merge import REPLACE, Merge
from siltbed.operators.resolve import live, resolve


def bounded(rows: DataFrame, key: str = "k", start=None, end=None, start_included: bool = True, end_included: bool = False) -> DataFrame:
    """Filters that Parquet's scan takes over. None, and for the end also an empty key, is no bound."""
    if start is not None:
        rows = rows.filter(F.col(key) >= start if start_included else F.col(key) > start)
    if end not in (None, "", b""):
        rows = rows.filter(F.col(key) <= end if end_included else F.col(key) < end)
    return rows


def ordered(rows: DataFrame, key: str = "k", limit: int = 0, descending: bool = False) -> DataFrame:
    """Rows in key order; a limit of 0 is none, and any other is a top-k by key rather than a sort."""
    rows = rows.orderBy(F.desc(key) if descending else F.asc(key))
    return rows.limit(limit) if limit else rows


def within_bytes(rows: DataFrame, size: Column, key: str = "k", max_records: int = 0, max_bytes: int = 0, descending: bool = False) -> DataFrame:
    """Rows in key order until so many, or until their sizes reach max_bytes; the row that reaches it is the last.

    Of rows that have a byte at least, max_bytes rows hold the one that reaches it, so the running sum is over those
    only; rows without bytes count for nothing, however many there are. That row's key then bounds the scan.
    """
    if max_bytes:
        most = min([n for n in (max_records, max_bytes) if n])
        some = ordered(rows.select(key, size.alias("_size")).filter("_size > 0"), key, most, descending)
        so_far = Window.orderBy(F.desc(key) if descending else F.asc(key)).rowsBetween(Window.unboundedPreceding, 0)
        reached = some.withColumn("_sum", F.sum("_size").over(so_far)).filter(F.col("_sum") >= max_bytes)
        cut = reached.agg((F.max if descending else F.min)(key)).first()[0]
        if cut is not None:
            rows = rows.filter(F.col(key) >= cut if descending else F.col(key) <= cut)
    return ordered(rows, key, max_records, descending)


def get(ops: DataFrame, value, key: str = "k", merge: Merge = REPLACE) -> DataFrame:
    """The live row of one key, folded over all its operations."""
    return live(ops.filter(F.col(key) == value), key, merge)


def get_first(levels: DataFrame, value, key: str = "k") -> DataFrame:
    """The live row of one key from the newest level that has it; right for merges that replace. levels has `level`, 0 newest."""
    hits = levels.filter(F.col(key) == value)
    latest = Window.partitionBy(key).orderBy("level", F.desc("seq"))
    return hits.withColumn("_n", F.row_number().over(latest)).filter((F.col("_n") == 1) & ~F.col("is_delete")).drop("_n", "is_delete")


def find(ops: DataFrame, requests: DataFrame, key: str = "k", merge: Merge = REPLACE) -> DataFrame:
    """Each request with its live row's columns and `found`; requests that meet nothing stay, with nulls."""
    state = resolve(ops, key, merge).filter(~F.col("is_delete")).drop("is_delete").withColumn("_hit", F.lit(True))
    return requests.join(state, key, "left").withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def min_max(rows: DataFrame, key: str = "k") -> DataFrame:
    return rows.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(F.lit(1)).alias("n"))


def with_prefix(rows: DataFrame, prefix: str, key: str = "k") -> DataFrame:
    return rows.filter(F.col(key).startswith(prefix))
