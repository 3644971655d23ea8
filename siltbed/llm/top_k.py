"""Exact top-k by inner product: term-at-a-time accumulation of query blocks over candidate blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.common import written

#: Rows of a candidate block at least and at most, rows of a query block, and query rows that have dense score arrays at once.
FEWEST, MOST, QUERY_ROWS, AT_ONCE = 1024, 16_384, 1024, 64
#: Weights up to this take 64-bit sums of up to 2^21 terms; larger ones are summed as Python's integers and kept in long's range.
SAFE = 1 << 21
LONG = (-(1 << 63), (1 << 63) - 1)


def scaled(vectors: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id and weights = floor(scale * component), without vectors that are null or hold null or non-finite components, and without null ids."""
    whole: Column = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    weights = F.transform(F.col(vector), lambda x: _floor(x.cast("double") * scale))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & whole).select(F.col("vec_id").cast("long"), weights.alias("weights"))


def _floor(x: Column) -> Column:
    """floor() as double; doubles from 2^53 on have no fraction, and would leave long's range."""
    return F.when(F.abs(x) >= float(1 << 53), x).otherwise(F.floor(x).cast("double"))


def _postings(rows: list[np.ndarray], kind: type) -> dict[int, tuple[object, np.ndarray]]:
    """term -> (rows with a weight for it, the weights); the rows are a slice where all have one."""
    out = {}
    for term in range(max(map(len, rows), default=0)):
        column = np.array([r[term] if term < len(r) else 0 for r in rows], dtype=object if kind is object else np.float64)
        at = np.flatnonzero(column)
        if len(at):
            weights = np.array([int(x) for x in column[at]], dtype=kind)
            out[term] = (slice(None) if len(at) == len(rows) else at, weights)
    return out


def best(queries: pa.Table, candidates: pa.Table, k: int) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score) of the k best candidates in this block of each query of this block, ties to smaller ids."""
    order = np.argsort(candidates.column("vec_id").to_numpy(), kind="stable")
    ids = candidates.column("vec_id").to_numpy()[order]
    rows = [np.asarray(x, dtype=np.float64) for x in candidates.column("weights").to_pylist()]
    rows = [rows[i] for i in order]
    asked = [np.asarray(x, dtype=np.float64) for x in queries.column("weights").to_pylist()]
    asked_ids = queries.column("vec_id").to_pylist()
    largest = max([0.0, *(float(np.abs(r).max()) for r in (*rows, *asked) if len(r))])
    kind = np.int64 if largest <= SAFE else object
    postings = _postings(rows, kind)
    out = []
    for at in range(0, len(asked), AT_ONCE):
        part = asked[at : at + AT_ONCE]
        scores = np.zeros((len(part), len(ids)), dtype=kind)
        for term, (where, weights) in postings.items():
            own = [int(q[term]) if term < len(q) else 0 for q in part]
            having = [i for i, w in enumerate(own) if w]
            if not having:
                continue
            add = np.array([own[i] for i in having], dtype=kind)[:, None] * weights[None, :]
            if isinstance(where, slice):
                scores[having] += add
            else:
                scores[np.ix_(having, where)] += add
        for i, query in enumerate(asked_ids[at : at + AT_ONCE]):
            line = scores[i]
            others = np.flatnonzero(ids != query)
            if not len(others):
                continue
            values = line[others]
            if kind is object:
                values = np.array([min(max(v, LONG[0]), LONG[1]) for v in values], dtype=np.int64)
            if len(values) > k:
                least = np.partition(values, len(values) - k)[len(values) - k]
                near = np.flatnonzero(values >= least)
            else:
                near = np.arange(len(values))
            near = near[np.argsort(-values[near].astype(object) if kind is object else -values[near], kind="stable")][:k]
            out += [(query, int(ids[others[j]]), int(values[j])) for j in near]
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """For each row whose vec_id is divisible by `every`, the k rows with the highest inner products, its own id left out.

    Returns query_id, rank (from 1), vec_id, score; all candidates where there are fewer than k. Components become
    floor(scale * x); vectors that are null or hold a null or non-finite component, and rows without an id, take no part.
    Vectors of different lengths meet in the terms that both have. Equal scores go to the smaller vec_id. A score beyond
    long's range is kept at its end.

    Rows are dealt by their id's hash into blocks whose sizes have fixed bounds, and each pair of a query block and a
    candidate block is one group: the query set is stated and meets all rows, so the work is queries times rows, but no
    group, and no score array, grows with the data. Each group gives k rows for each of its queries, which are merged by
    one rank over the query. Repeated rows of an id are candidates of their own; a repeated query id is asked once for
    each candidate, by the row with the largest weights in array order.
    """
    rows = written(scaled(vectors, vector, scale), "weights")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("weights").alias("weights"))
    n = rows.count()
    blocks = max(1, -(-n // min(MOST, max(FEWEST, n // 64))))
    sets = max(1, -(-n // (every * QUERY_ROWS)))

    def tile(many: int, *of: str) -> Column:
        return F.pmod(F.xxhash64(*of, F.lit(17)), F.lit(many)).cast("int")

    candidates = rows.withColumn("c", tile(blocks, "vec_id")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))))
    queries = asked.withColumn("q", tile(sets, "vec_id")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        found = best(left, right, k) if left.num_rows and right.num_rows else []
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    tiles = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(score, "query_id long, vec_id long, score long")
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(merged)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
