"""Near-duplicate documents: b-bit MinHash, banded candidates, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.common import by_size, forget, release, small_batches, text_or_empty, written
from siltbed.llm.shingles import hashed_words, mixed, shingled_rows

#: 48 bands of 6 minima: a pair of similarity 0.8 shares no band once in two million pairs.
BANDS, ROWS, BITS = 48, 6, 4
HASHES = BANDS * ROWS
#: Estimates are let through down to four standard deviations under the threshold.
SLACK = 4.0
#: Members, and shingles of their sets, that one side of a comparison tile is planned for.
TILE, TILE_SHINGLES = 1024, 1 << 20
#: First documents that a document is compared with at once, and rounds of likely links before all others are compared.
TRIES, LIKELY = 8, 2

_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (_MULTIPLY[:, None] * x[None, at : at + 2048] + _ADD[:, None]).min(axis=1), out=out)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """Rows of minima as rows of 64-bit words, each with the low BITS bits of 16 minima."""
    v = least.astype(np.uint64)
    v = mixed(v) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    v = v.reshape(len(least), HASHES // per, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(v, axis=2)


def banded(least: np.ndarray) -> np.ndarray:
    v = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(_BAND, v.shape[:2]).copy()
    for r in range(ROWS):
        out = mixed(out + v[:, :, r])
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, bits; the last three are null without words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            sizes, keys, least, at = [], [], [], []
            hashes, to = shingled_rows(*hashed_words(b.column(1)), n)
            for i in range(b.num_rows):
                own = np.unique(hashes[to[i] : to[i + 1]])
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                if len(own):
                    at.append(i)
                    least.append(minima(own))
            m = np.array(least, dtype=np.uint32).reshape(-1, HASHES)
            bands, bits = [None] * len(sizes), [None] * len(sizes)
            for i, x, y in zip(at, banded(m).view(np.int64), packed(m).view(np.int64), strict=True):
                bands[i], bits[i] = x, y
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, longs), pa.array(bits, longs)],
                names=["doc_id", "n_shingles", "set_key", "bands", "bits"],
            )

    types = "doc_id long, n_shingles long, set_key binary, bands array<long>, bits array<long>"
    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, types)


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """id and set (the distinct shingle hashes) of each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            hashes, to = shingled_rows(*hashed_words(b.column(1)), n)
            sets = [np.unique(hashes[to[i] : to[i + 1]]).view(np.int64) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "id long, set array<long>")


def alike(x: Column, y: Column) -> Column:
    """The similarity that two signatures' differing bit groups estimate, corrected for groups that agree by chance."""
    low = (1 << 64) // ((1 << BITS) - 1)  # the lowest bit of each group

    def differ(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        any_bit = d
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(any_bit.bitwiseAND(F.lit(low)))

    missed = F.aggregate(F.zip_with(x, y, differ), F.lit(0), lambda s, v: s + v)
    chance = 2.0**-BITS
    return ((1 - missed / HASHES) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    j = percent / 100
    chance = 2.0**-BITS
    agree = j + (1 - j) * chance
    return j - SLACK * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns id, component (the smallest id reachable) of every id that has an edge.

    Each round takes the least label of the neighbours, summed before the shuffle, and then the label's own label,
    which halves the way that is left; it ends when no label changes.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        step = written(labels.join(near, "id").select("id", F.least("label", "_near").alias("label"), F.col("label").alias("was")), "step")
        own = step.select(F.col("id").alias("label"), F.col("label").alias("_own"))
        after = written(step.join(own, "label").select("id", F.least("label", "_own").alias("label"), "was"), "labels")
        forget(labels, step)
        labels = after
        if not after.filter("label <> was").limit(1).count():
            forget(both)
            return labels.select("id", F.col("label").alias("component"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are alike enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.filter(100 * shared >= percent * (F.size("_a") + F.size("_b") - shared)).select("a", "b").distinct()


def _differing(d: np.ndarray) -> np.ndarray:
    """Of each row of differing bits, how many groups differ."""
    g = d.copy()
    for k in range(1, BITS):
        g |= d >> np.uint64(k)
    return np.bitwise_count(g & np.uint64((1 << 64) // ((1 << BITS) - 1))).sum(axis=1)


def _dealt(members: DataFrame) -> DataFrame:
    """members: key, id, component, n_shingles and more. Adds own, i and j: members whose i and j agree meet in one task.

    Of each bucket, the members of its largest component need only meet the others, so both are dealt to blocks of about
    TILE members, the largest component's with negative numbers, and each two blocks that have something to compare are
    one tile, however large the bucket is. A member is repeated for each block that it meets: members of the largest
    component for those of the few others.
    """
    counted = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    sized = counted.groupBy("key").agg(F.max(F.struct("n", "component", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = [
        F.greatest(F.ceil(n / TILE), F.ceil(w / TILE_SHINGLES), F.lit(1)).cast("int").alias(c)
        for n, w, c in ((F.col("main.n"), F.col("main.w"), "large"), (F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w"), "small"))
    ]
    sized = written(sized.select("key", F.col("main.component").alias("main"), *blocks), "sized")
    dealt = members.join(by_size(sized), "key")
    inside, dice = F.col("component") == F.col("main"), F.xxhash64("id")
    own = F.when(inside, -1 - F.pmod(dice, F.col("large"))).otherwise(F.pmod(dice, F.col("small"))).cast("int")
    others = F.sequence(F.when(inside, 0).otherwise(-F.col("large")), F.col("small") - 1)
    dealt = dealt.withColumn("own", own).withColumn("_other", F.explode(others))
    return dealt.withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_other", "main", "large", "small")


class _Tile:
    """Two blocks of a bucket's members, or one with itself, and the pairs of them that may be alike."""

    def __init__(self, t: pa.Table, least: float):
        self.ids, self.label, own = (t.column(c).to_numpy().copy() for c in ("id", "component", "own"))
        self.bits, bands = (np.stack(t.column(c).to_numpy()).view(np.uint64) for c in ("bits", "bands"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        self.rows, self.columns, self.same = np.flatnonzero(own == i), np.flatnonzero(own == j), i == j
        band = int(np.flatnonzero(bands[0] == np.uint64(t.column("key")[0].as_py() & (1 << 64) - 1))[0])
        self.before, self.least = bands[:, :band], least

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """A row and others, likeliest first, that are in other components by now, seem alike, and share no earlier band.

        Two members that share an earlier band meet in that bucket.
        """
        chance = 2.0**-BITS
        for r in self.rows.tolist():
            others = self.columns[self.columns > r] if self.same else self.columns
            others = others[(self.label[others] != self.label[r]) & (self.ids[others] != self.ids[r])]
            if not len(others):
                continue
            estimate = ((1 - _differing(self.bits[others] ^ self.bits[r]) / HASHES) - chance) / (1 - chance)
            order = np.argsort(-estimate, kind="stable")
            others = others[order[estimate[order] >= self.least]]
            others = others[~(self.before[others] == self.before[r]).any(axis=1)]
            if len(others):
                yield r, others

    def join(self, r: int, other: int) -> tuple[int, int]:
        self.label[self.label == self.label[other]] = self.label[r]
        return tuple(sorted((int(self.ids[r]), int(self.ids[other]))))


def _pairs(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def _likely(dealt: DataFrame, least: float) -> DataFrame:
    """Pairs that would join all members that seem alike: fewer than a tile has members."""

    def compare(t: pa.Table) -> pa.Table:
        release()
        tile, out = _Tile(t, least), []
        for r, others in tile.candidates():
            for w in others.tolist():
                if tile.label[w] != tile.label[r]:
                    out.append(tile.join(r, w))
        return _pairs(out)

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _open(dealt: DataFrame, least: float) -> DataFrame:
    """key, id of members that seem alike to one of another component."""

    def compare(t: pa.Table) -> pa.Table:
        release()
        tile, out = _Tile(t, least), set()
        for r, others in tile.candidates():
            out.update((r, *others.tolist()))
        at = np.array(sorted(out), dtype=np.int64)
        return pa.table({"key": t.column("key").take(pa.array(at)), "id": pa.array(tile.ids[at], pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "key long, id long").distinct()


def _confirmed_in_tiles(dealt: DataFrame, least: float, percent: int) -> DataFrame:
    """Links between different components, each confirmed on full sets in its tile: fewer than a tile has members.

    dealt has `set` too. Every pair that seems alike is compared unless links join its two members already.
    """

    def compare(t: pa.Table) -> pa.Table:
        release()
        tile, out = _Tile(t, least), []
        sets = t.column("set").combine_chunks()
        values, at = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
        for r, others in tile.candidates():
            own = values[at[r] : at[r + 1]]
            for low in range(0, len(others), 64):
                part = others[low : low + 64]
                part = part[tile.label[part] != tile.label[r]]
                if not len(part):
                    continue
                both = np.concatenate([values[at[w] : at[w + 1]] for w in part])
                sizes = at[part + 1] - at[part]
                found = own[np.minimum(np.searchsorted(own, both), len(own) - 1)] == both
                shared = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
                for w in part[100 * shared >= percent * (len(own) + sizes - shared)].tolist():
                    if tile.label[w] != tile.label[r]:
                        out.append(tile.join(r, w))
        return _pairs(out)

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (id, component) after more links (a, b); ids without a label are components of their own."""
    named = links
    for c in ("a", "b"):
        named = named.join(label.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    moved = written(components(named.filter("a <> b")), "moved")
    after = label.join(moved.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    out = written(after.union(moved.join(label.select("id"), "id", "left_anti").select("id", "component")), "label")
    forget(moved)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    docs: doc_id and text; other columns are ignored. Two documents are linked when 100 times their shared shingles are
    at least `percent` times all of theirs; a component is what links reach, named by its smallest doc_id, whose document
    is kept. A document whose text is null, empty or without words is linked with nothing. Rows that repeat a doc_id are
    one document. A row without doc_id has no component and is kept. No documents: no rows.

    Equal sets are one class from the start, summed before the shuffle, and only a class's first document goes on. In
    each bucket of a band its members meet the first one, and the TRIES likeliest for each document are confirmed on full
    sets. Then members of a bucket that are in different components still meet each other, in tiles of bounded size:
    first for links that would join all that seem alike, confirmed with a join, and at last all pairs that seem alike are
    compared on full sets in their tile, unless they are joined by then. So every two documents that share a band are
    either in one component or compared, no group is gathered in one task, and no step gives more rows than it has
    members: pairs themselves leave a tile only as links that join two components.
    """
    least = least_estimate(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(signatures(docs, n), "signatures")
    some = found.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(some.groupBy("set_key").agg(F.min("doc_id").alias("first")), "classes")
    firsts = some.join(classes.select("set_key", F.col("first").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    one = [F.first(c).alias(c) for c in ("n_shingles", "bits", "bands")]
    signs = written(firsts.groupBy(F.col("doc_id").alias("id")).agg(*one, F.count(F.lit(1)).alias("rows")), "signs")
    if signs.filter("rows > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id"])
    bits = signs.select("id", "bits")
    keys = signs.select("id", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("_last")).filter("pivot < _last").select("key", "pivot"), "shared")
    live = written(keys.join(shared, "key"), "live")

    pairs = live.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    est = pairs.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("_a")), "a").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("_b")), "b")
    est = est.select("a", "b", alike(F.col("_a"), F.col("_b")).alias("est")).filter(F.col("est") >= least)
    best = Window.partitionBy("b").orderBy(F.desc("est"), "a")
    tried = written(est.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= TRIES).select("a", "b").distinct(), "tried")

    def sets_for(ids: DataFrame) -> DataFrame:
        asked = written(ids.select("id").distinct(), "asked")
        out = written(sets_of(texts.join(by_size(asked.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi"), n), "sets")
        forget(asked)
        return out

    def linked(pairs: DataFrame) -> DataFrame:
        sets = sets_for(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        out = written(confirmed(pairs, sets, percent), "links")
        forget(sets)
        return out

    def apart(label: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component, in tiles."""
        placed = written(live.select("key", "id").join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")), "placed")
        several = placed.groupBy("key").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).filter("_x < _y").select("key")
        several = written(several, "several")
        rest = written(placed.join(by_size(several), "key", "left_semi").join(signs.drop("rows"), "id"), "rest")
        forget(placed, several)
        return rest

    links = linked(tried)
    label = written(components(links), "label")
    forget(tried, links)
    for _ in range(LIKELY):
        rest = apart(label)
        likely = written(_likely(_dealt(rest), least), "likely")
        links = linked(likely)
        forget(rest, likely)
        if not links.limit(1).count():
            break
        label = _joined(label, links)
        forget(links)
    rest = apart(label)
    open_ = written(_open(_dealt(rest), least), "open")
    if open_.limit(1).count():
        last = written(rest.join(by_size(open_), ["key", "id"], "left_semi"), "last")
        sets = sets_for(open_)
        links = written(_confirmed_in_tiles(_dealt(last).join(sets, "id"), least, percent), "links")
        label = _joined(label, links)
        forget(last, sets, links)
    forget(live, shared, signs, rest, open_)
    named = classes.join(label, classes["first"] == label["id"], "left").select("set_key", F.coalesce("component", "first").alias("component_id"))
    named = written(named, "named")
    forget(classes, label)
    slim = found.select("doc_id", "n_shingles", "set_key")
    one = slim.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull()).join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    rest = slim.filter(F.col("set_key").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return one.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
