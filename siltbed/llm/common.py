"""What the corpus operators share: reading tables, written intermediate tables, ranks that no hot key can pile up."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import accumulate, chain, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one Arrow batch holds at most: texts may be long, and a batch is in memory as a whole.
BATCH_ROWS = 500
#: Rows of one key that one window partition of gapless_rank() is planned for.
RANK_ROWS = 20_000
RANK_SALTS = 64
#: Slices that among() joins large tables in, at most.
SLICES = 8
#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of ids up to which a table is broadcast rather than joined with a shuffle: some tens of megabytes; in sliced() half as many more of one or two columns.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch in this session; a smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def uncollected() -> Iterator[None]:
    """Python looks for no cycles meanwhile: with large caches a search takes long, and what a tokenizer makes has none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


#: What operators have cached in this process, by cache().
_caches: list[dict] = []


def cache() -> dict:
    """An empty dictionary that release() empties again."""
    _caches.append({})
    return _caches[-1]


def release() -> None:
    """Empties what other operators have cached in this process and gives the memory back to the system.

    A Python worker goes on from one operator to the next; those that cache nothing themselves call this as they begin
    a task, so that an executor doesn't hold a tokenizer and its words beside their data.
    """
    if not any(_caches):
        return
    for known in _caches:
        known.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def looked_up(split: list[list[str]], known: dict[str, bytes], learn: Callable[[set[str]], dict[str, bytes]]) -> list[bytes]:
    """Each list's words' bytes in a row, every word looked up once; learn() gives a dictionary with those of the words that `known` hasn't got."""
    words = list(chain.from_iterable(split))
    got = list(map(known.get, words))
    lacking = [i for i, x in enumerate(got) if x is None]
    new = [words[i] for i in lacking]
    learned = learn(set(new))
    for i, w in zip(lacking, new, strict=True):
        got[i] = learned[w]
    ends = list(accumulate(map(len, split), initial=0))
    return [b"".join(got[x:y]) for x, y in pairwise(ends)]


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = spark.sparkContext._conf.get("siltbed.own.dir")
        if not named:
            named = "file://" + tempfile.mkdtemp(prefix="siltbed-")
            spark.sparkContext._conf.set("siltbed.own.dir", named)
            atexit.register(_remove_own, named.removeprefix("file://"))
    return named.rstrip("/")


def _remove_own(folder: str) -> None:
    import shutil

    shutil.rmtree(folder, ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage is cut and survives lost executors.

    Nothing reads the write's shuffles after it, so their files go with its end rather than with some later collection
    of the driver's garbage.
    """
    return written_parts([df], name)


def written_parts(parts: list[DataFrame], name: str) -> DataFrame:
    """All parts, of one schema, as one table of written(); each is computed by itself, so the disk holds one part's shuffles at a time."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        for df in parts:
            df.write.parquet(path, mode="append", compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._siltbed_path = path
    return out


def sliced(df: DataFrame, few: DataFrame, key: str, how: str = "inner") -> list[DataFrame]:
    """df's rows whose `key`, a long, is in `few`, a written table, in one part or, where `few` is too large to be broadcast, in several by key."""
    n, most = few.count(), BROADCAST_ROWS * 3 // 2 if len(few.columns) <= 2 else BROADCAST_ROWS
    slices = min(SLICES, -(-n // most))
    if slices <= 1:
        return [df.join(F.broadcast(few), key, how)]
    # Some bits that neither the shuffle nor a count of buckets goes by.
    slice_of = F.pmod(F.shiftrightunsigned(key, 17), F.lit(slices))
    small = n <= slices * most
    parts = []
    for k in range(slices):
        own = few.filter(slice_of == k)
        parts.append(df.filter(slice_of == k).join(F.broadcast(own) if small else own, key, how))
    return parts


def among(df: DataFrame, few: DataFrame, key: str, name: str, how: str = "inner") -> DataFrame:
    """written() of sliced(), so that no shuffle holds all of df."""
    return written_parts(sliced(df, few, key, how), name)


def by_size(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table for a join: broadcast up to so many rows, else left to a shuffle, which splits what is too large."""
    return F.broadcast(df) if df.count() <= rows else df


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, getattr(df, "_siltbed_path", None)
        if path:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def gapless_rank(df: DataFrame, key: str, order: list[str], to: str) -> DataFrame:
    """Adds the row's rank from 0 within its key, without gaps.

    df is a written table (it is read twice). A key's rows are dealt over salts, so that a key which holds a third of
    all rows is ranked by many tasks; counts by key and salt, which the input's rows are summed to before the shuffle,
    give each salt its first rank. Rows that agree in all of `order` are ranked in any order.
    """
    salts = max(RANK_SALTS, df.count() // RANK_ROWS)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        salted.groupBy(key, "_salt")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    own = Window.partitionBy(key, "_salt").orderBy(*order)
    return (
        salted.withColumn("_own", F.row_number().over(own) - 1)
        .join(first, [key, "_salt"])
        .withColumn(to, F.col("_first") + F.col("_own"))
        .drop("_salt", "_first", "_own")
    )


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
