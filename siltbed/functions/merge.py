"""Merge functions: how the operations on one key, in order of seq, become its state."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Merge:
    """fold(ops, key, values) gives a row for each key: key, values, seq, is_delete. It is associative over levels."""

    name: str
    fold: Callable[[DataFrame, str, list[str]], DataFrame]


def _replace(ops: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The latest operation wins. Its value may be null, which max_by() keeps; with fixed-width values this is one hash aggregate."""
    latest = [F.max_by(c, "seq").alias(c) for c in [*values, "is_delete"]]
    return ops.groupBy(key).agg(*latest, F.max("seq").alias("seq")).select(key, *values, "seq", "is_delete")


def since_tombstone(ops: DataFrame, key: str) -> DataFrame:
    """The operations of each key after its last tombstone, and that tombstone where nothing follows it."""
    last = F.max(F.when(F.col("is_delete"), F.col("seq"))).over(Window.partitionBy(key))
    newest = F.max("seq").over(Window.partitionBy(key))
    marked = ops.withColumn("_cut", last).withColumn("_new", newest)
    return marked.filter(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")) | ((F.col("seq") == F.col("_cut")) & (F.col("seq") == F.col("_new")))).drop("_cut", "_new")


def _append(ops: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Values joined in order of seq, from the last tombstone on. The window and the aggregate share one shuffle."""
    joined = [F.expr(f"listagg({c}, '') WITHIN GROUP (ORDER BY seq)").alias(c) for c in values]
    return since_tombstone(ops, key).groupBy(key).agg(*joined, F.max("seq").alias("seq"), F.bool_or("is_delete").alias("is_delete")).select(key, *values, "seq", "is_delete")


def folding(name: str, zero: Column, step: Callable[[Column, Column], Column]) -> Merge:
    """A merge function from a step (state, value) -> state over one value column, applied since the last tombstone."""

    def fold(ops: DataFrame, key: str, values: list[str]) -> DataFrame:
        (value,) = values
        ordered = F.array_sort(F.collect_list(F.struct("seq", value, "is_delete")))
        state = F.aggregate(F.filter("_ops", lambda o: ~o["is_delete"]), zero, lambda s, o: step(s, o[value]))
        rows = since_tombstone(ops, key).groupBy(key).agg(ordered.alias("_ops"), F.max("seq").alias("seq"), F.bool_or("is_delete").alias("is_delete"))
        return rows.withColumn(value, F.when(~F.col("is_delete"), state)).select(key, value, "seq", "is_delete")

    return Merge(name, fold)


REPLACE = Merge("replace", _replace)
APPEND = Merge("append", _append)
MERGES = {m.name: m for m in (REPLACE, APPEND)}
