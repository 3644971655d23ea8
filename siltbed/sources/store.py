"""A keyed table as levels of immutable sorted Parquet runs, listed by versioned manifests."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.merge import MERGES
from siltbed.operators.resolve import deduplicated, partial, resolve, unexpired
from siltbed.operators.scan import bounded, find, ordered
from siltbed.operators.stats import should_promote, size_ratio

#: Levels: the newest runs, the level that takes them, and the one at the bottom.
LEVELS = 3
#: Files of seqs seen that are kept apart.
PARTS = 32


@dataclass
class Manifest:
    """What a version of the table consists of. Runs are listed newest first within a level."""

    merge: str = "replace"
    expiry: int = 0
    truncated: int = -1
    last_seq: int = -1
    version: int = 0
    runs: list[dict] = field(default_factory=list)
    #: Seqs that were inserted: min, max and rows of each part, and its file where it has gaps.
    seen: list[dict] = field(default_factory=list)


class Store:
    """ops(k, values..., seq, is_delete) in a folder that Spark can read and write, local or remote.

    A reader sees the runs of one manifest, which are never changed, so a scan is of one snapshot. A write adds a run
    and then a manifest under the next number; two writers can't both take a number, since it is a rename to a name that
    may not exist. One writer at a time is the intended use; one that loses fails and may try again.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest

    # -- folders

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    @classmethod
    def create(cls, spark: SparkSession, path: str, merge: str = "replace", expiry: int = 0) -> Store:
        store = cls(spark, path, Manifest(merge=merge, expiry=expiry))
        store._commit()
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Store:
        fs, folder = cls._fs(spark, f"{path.rstrip('/')}/manifest")
        found = sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        version = found[-1] if version is None else version
        fs, at = cls._fs(spark, f"{path.rstrip('/')}/manifest/{version:012d}.json")
        stream = fs.open(at)
        try:
            raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return cls(spark, path, Manifest(**json.loads(raw)))

    def _commit(self) -> None:
        m = self.manifest
        m.version += 1
        fs, temp = self._fs(self.spark, f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(json.dumps(asdict(m)).encode())
        out.close()
        _, final = self._fs(self.spark, f"{self.path}/manifest/{m.version:012d}.json")
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise RuntimeError(f"version {m.version} of {self.path} was written by another writer")

    # -- runs

    def _write_run(self, rows: DataFrame, level: int) -> dict | None:
        name = f"level-{level}/{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        writer = rows.repartitionByRange("k").sortWithinPartitions("k").write
        writer.option("parquet.bloom.filter.enabled#k", "true").parquet(at)
        back = self.spark.read.parquet(at)
        lo, hi, n, seq = back.agg(F.min("k"), F.max("k"), F.count(F.lit(1)), F.max("seq")).first()
        if not n:
            return None
        size = self._fs(self.spark, at)[0].getContentSummary(self._fs(self.spark, at)[1]).getLength()
        text = (lambda k: k if isinstance(k, str) or k is None else bytes(k).hex())
        return {"path": name, "level": level, "min": text(lo), "max": text(hi), "rows": n, "bytes": size, "last_seq": seq}

    def _runs(self, level: int) -> list[dict]:
        return [r for r in self.manifest.runs if r["level"] == level]

    def read_level(self, level: int, start=None, end=None) -> DataFrame | None:
        """All operations of one level, unresolved across its runs; of a key range, of the runs that reach into it."""
        text = lambda k: k if isinstance(k, str) else bytes(k).hex()
        low, high = (None if k in (None, "", b"") else text(k) for k in (start, end))
        runs = [r for r in self._runs(level) if r["min"] is None or ((low is None or r["max"] >= low) and (high is None or r["min"] <= high))]
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{r['path']}") for r in runs]) if runs else None

    def ops(self, start=None, end=None) -> DataFrame | None:
        """Operations of all levels; with bounds, of the runs whose keys reach between them, or none of any where no run does."""
        parts = [df for level in range(LEVELS) if (df := self.read_level(level, start, end)) is not None]
        if not parts and self.manifest.runs:
            return self.spark.read.parquet(f"{self.path}/{self.manifest.runs[0]['path']}").limit(0)
        return reduce(DataFrame.unionByName, parts) if parts else None

    # -- writes

    @property
    def merge(self):
        return MERGES[self.manifest.merge]

    def insert(self, batch: DataFrame, truncate_log: bool = False) -> None:
        """Adds a batch of operations as a run. Operations that came before, by seq, are left out; late ones are not."""
        fresh = deduplicated(batch)
        low, high = fresh.agg(F.min("seq"), F.max("seq")).first()
        if low is None:
            return
        for part in self.manifest.seen:
            if part["min"] <= high and part["max"] >= low:
                if "path" in part:
                    fresh = fresh.join(self.spark.read.parquet(f"{self.path}/{part['path']}"), "seq", "left_anti")
                else:
                    fresh = fresh.filter(~F.col("seq").between(part["min"], part["max"]))
        name = f"seqs/{uuid.uuid4().hex}"
        fresh.select("seq").write.parquet(f"{self.path}/{name}")
        mine = self.spark.read.parquet(f"{self.path}/{name}")
        low, high, n = mine.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
        if not n:
            return
        run = self._write_run(partial(fresh.select(*batch.columns), "k", self.merge), 0)
        self.manifest.runs.insert(0, run)
        self.manifest.last_seq = max(self.manifest.last_seq, run["last_seq"])
        self._remember({"min": low, "max": high, "rows": n} | ({} if high - low + 1 == n else {"path": name}))
        if truncate_log:
            self.manifest.truncated = self.manifest.last_seq
        self._commit()

    def _remember(self, part: dict) -> None:
        """Adds to the seqs seen; parts without gaps that touch become one, and many parts with gaps one file."""
        seen = sorted([*self.manifest.seen, part], key=lambda x: x["min"])
        out: list[dict] = []
        for x in seen:
            if out and "path" not in x and "path" not in out[-1] and x["min"] <= out[-1]["max"] + 1:
                out[-1] = {"min": out[-1]["min"], "max": max(out[-1]["max"], x["max"]), "rows": out[-1]["rows"] + x["rows"]}
            else:
                out.append(dict(x))
        if len(gaps := [x for x in out if "path" in x]) > PARTS:
            name = f"seqs/{uuid.uuid4().hex}"
            reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{x['path']}") for x in gaps]).write.parquet(f"{self.path}/{name}")
            whole = {"min": min(x["min"] for x in gaps), "max": max(x["max"] for x in gaps), "rows": sum(x["rows"] for x in gaps), "path": name}
            out = [x for x in out if "path" not in x] + [whole]
        self.manifest.seen = out

    replay = insert

    def compact(self, level: int) -> None:
        """Merges a level into the next one. At the bottom tombstones and expired rows go; further up a tombstone goes if no level below has its key.

        Above the bottom an expired row becomes a tombstone, as what is older may lie below.
        """
        new, old = self.read_level(level), self.read_level(level + 1)
        if new is None:
            return
        bottom = level + 1 == LEVELS - 1
        both = old.unionByName(new) if old is not None else new
        rows = resolve(both, "k", self.merge) if bottom else partial(both, "k", self.merge)
        if self.manifest.expiry:
            gone = F.col("seq") < self.manifest.last_seq - self.manifest.expiry
            own = [F.when(~gone, F.col(c)).alias(c) if c not in ("k", "seq", "is_delete") else F.col(c) for c in rows.columns if c != "is_delete"]
            rows = rows.select(*own, (F.col("is_delete") | gone).alias("is_delete")).select(*rows.columns).dropDuplicates(["k", "seq", "is_delete"])
        dead = rows.filter("is_delete")
        rows = rows.filter(~F.col("is_delete"))
        if not bottom and (below := [df.select("k") for n in range(level + 2, LEVELS) if (df := self.read_level(n)) is not None]):
            rows = rows.unionByName(dead.join(reduce(DataFrame.union, below), "k", "left_semi"))
        run = self._write_run(rows, level + 1)
        self.manifest.runs = [r for r in self.manifest.runs if r["level"] not in (level, level + 1)] + ([run] if run else [])
        self.manifest.runs.sort(key=lambda r: r["level"])
        self._commit()

    def flush(self) -> None:
        """Everything new goes down a level, and that level further if it has outgrown its ratio."""
        fresh = self._runs(0)
        mean = sum(r["bytes"] for r in fresh) / len(fresh) if fresh else 0.0
        self.compact(0)
        size = sum(r["bytes"] for r in self._runs(1))
        if should_promote(size, mean, size_ratio(sum(r["bytes"] for r in self._runs(2)), mean)):
            self.compact(1)

    def drop_all(self) -> None:
        self.manifest.runs = []
        self._commit()

    def vacuum(self) -> None:
        """Deletes files of runs and manifests that the newest manifest doesn't list; no reader of an older one may be left."""
        used = {r["path"] for r in self.manifest.runs}
        for level in range(LEVELS):
            fs, folder = self._fs(self.spark, f"{self.path}/level-{level}")
            for s in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"level-{level}/{s.getPath().getName()}" not in used:
                    fs.delete(s.getPath(), True)
        fs, folder = self._fs(self.spark, f"{self.path}/manifest")
        for s in fs.listStatus(folder):
            if s.getPath().getName() != f"{self.manifest.version:012d}.json":
                fs.delete(s.getPath(), False)

    # -- reads

    def _live(self, ops: DataFrame) -> DataFrame:
        """What is neither deleted nor expired; expiry goes last, so a compaction never changes a read."""
        rows = unexpired(resolve(ops, "k", self.merge), self.manifest.last_seq, self.manifest.expiry)
        return rows.filter(~F.col("is_delete")).drop("is_delete")

    def live(self) -> DataFrame | None:
        ops = self.ops()
        return None if ops is None else self._live(ops)

    def get(self, key) -> DataFrame | None:
        ops = self.ops(key, key)
        return None if ops is None else self._live(ops.filter(F.col("k") == key))

    def find(self, requests: DataFrame) -> DataFrame | None:
        ops = self.ops()
        return None if ops is None else find(self._live(ops).withColumn("is_delete", F.lit(False)), requests, "k")

    def scan(self, start=None, end=None, limit: int = 0, start_included: bool = True, end_included: bool = False, descending: bool = False) -> DataFrame | None:
        """Live rows of a key range in key order. The bounds reach every run's scan, and runs outside them aren't read."""
        ops = self.ops(start, end)
        if ops is None:
            return None
        return ordered(self._live(bounded(ops, "k", start, end, start_included, end_included)), "k", limit, descending)

    def block_map(self) -> list[dict]:
        """The runs, newest level first."""
        return list(self.manifest.runs)
