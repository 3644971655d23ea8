"""Passages that repeat across documents: compact windows of token min-hashes, verified on the shingles themselves."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import among, by_size, forget, release, sliced, small_batches, text_or_empty, written, written_parts
from siltbed.llm.shingles import hashed_words, mixed, shingled, shingled_rows

#: Words of a shingle and of the shortest passage; hash functions, and how many have to agree on a passage.
SHINGLE, PASSAGE, HASHES, AGREE = 5, 50, 5, 2
PERCENT = 80
#: Shingles of a block beside a window's least one, and where the blocks begin from there: candidates share a block too.
BLOCK, BLOCKS = 12, (-24, -12, 1, 13)
#: Members of one side of a comparison tile, and shortest passages to either side of a least shingle that are verified then.
TILE, SPAN = 1024, 4
#: Tiles' worth of rows of small keys that are compared in one task, bits of a set of shingles, sources that a row is held against at a time, and pairs.
TOGETHER, BITS, AT_ONCE, PAIRS = 4, 2048, 64, 4096
#: Rows of spans up to which they go to the texts rather than the texts to them.
SPAN_ROWS = 200_000

#: Bytes of a shingle's hash that verification compares.
KEPT = 6
_SEEDS = mixed(np.arange(101, 101 + HASHES, dtype=np.uint64))
_LOW = np.uint64(0xFFFFFFFF)
#: A place times ODD is the order in which equal values are taken; times BACK it is the place again.
_ODD, _BACK = np.uint64(0x9E3779B1), np.uint64(pow(0x9E3779B1, -1, 1 << 32))


def _trees(order: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """row, l, c, r of the nodes that span `width` places or more, of the Cartesian tree of each row order[at[i]:at[i + 1]].

    The upper half of `order` has the values, the lower half the places in the row times ODD. All trees grow a level at
    a time, so a batch of texts takes as many steps as its deepest tree.
    """
    order = np.append(order, ~np.uint64(0))
    row = np.flatnonzero(np.diff(at) >= width)
    low, high = at[row], at[row + 1] - 1
    out = [(row[:0],) * 4]
    while len(row):
        least = np.minimum.reduceat(order, np.stack([low, high + 1], axis=1).ravel())[::2]
        c = at[row] + ((least & _LOW) * _BACK & _LOW).astype(np.int64)
        out.append((row, low - at[row], c - at[row], high - at[row]))
        wide = np.stack([c - low >= width, high - c >= width], axis=1).ravel()
        row, low, high = np.repeat(row, 2)[wide], np.stack([low, c + 1], axis=1).ravel()[wide], np.stack([c - 1, high], axis=1).ravel()[wide]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def compact_windows(values: np.ndarray, width: int) -> np.ndarray:
    """(l, c, r) for each node of the values' Cartesian tree that spans `width` positions or more.

    Every subsequence [i, j] with l <= i <= c <= j <= r has its least value at c, and each subsequence of `width` or more
    lies in exactly one of the windows. Values that repeat are told apart by their place's hash, which keeps the tree
    flat on repeated words.
    """
    rank = np.unique(values, return_inverse=True)[1].astype(np.uint64)
    place = np.arange(len(values), dtype=np.uint64) * _ODD & _LOW
    return np.stack(_trees(rank << np.uint64(32) | place, np.array([0, len(values)]), width)[1:], axis=1)


WINDOWS = "key long, doc_id long, h int, l int, c int, r int, blocks long, first boolean"


def windows(docs: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """A row for each compact window of each hash function, of every whole text.

    key is the hash function and the window's least value; blocks has 16 bits for each of the BLOCKS of words beside it,
    0 where the text has none; first marks a key's first row of its document.
    """
    small_batches(docs.sparkSession)
    width = passage - SHINGLE + 1
    types = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int32()), ("l", pa.int32()), ("c", pa.int32()), ("r", pa.int32()), ("blocks", pa.int64()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            of_words, at = hashed_words(b.column(1))
            own, to = shingled_rows(of_words, at, SHINGLE)
            blocks, begins = shingled_rows(of_words, at, BLOCK + SHINGLE - 1)
            n, doc = np.diff(to), b.column(0).to_numpy()
            place = (np.arange(len(own)) - np.repeat(to[:-1], n)).astype(np.uint64) * _ODD & _LOW
            for h in range(HASHES):
                values = mixed(own ^ _SEEDS[h])
                row, low, c, high = _trees(values & ~_LOW | place, to, width)
                key = mixed(values[to[row] + c] + np.uint64(h))
                beside = np.zeros(len(row), dtype=np.uint64)
                for k, off in enumerate(BLOCKS):
                    there = (c + off >= 0) & (c + off + BLOCK <= n[row])
                    value = blocks[np.where(there, begins[row] + c + off, 0)] >> np.uint64(48) if len(blocks) else beside
                    beside |= np.where(there, np.maximum(value, np.uint64(1)), np.uint64(0)) << np.uint64(16 * k)
                first = np.zeros(len(row), dtype=bool)
                first[np.unique(mixed(key) + row.astype(np.uint64), return_index=True)[1]] = True
                columns = (key.view(np.int64), doc[row], np.full(len(row), h), low, c, high, beside.view(np.int64), first)
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(columns, types, strict=True)], schema=types)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, WINDOWS)


def matched(a: np.ndarray, b: np.ndarray, anchors: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(start, end, source start, source end, similarity), in shingles, of b's passages that stand in a too.

    a, b: shingle hashes of whole texts. anchors: rows (h, l, r in a; l, r in b). Where windows of b overlap, their span
    is searched for stretches that stand in the span of all their windows in a, so it doesn't matter how often or in
    which order a holds them.
    """
    out: list[tuple[int, int, int, int, float]] = []
    anchors = anchors[np.argsort(anchors[:, 3], kind="stable")]
    reach = np.maximum.accumulate(anchors[:, 4])
    for spans in np.split(anchors, np.flatnonzero(anchors[1:, 3] > reach[:-1]) + 1):
        la, ra, lb, rb = int(spans[:, 1].min()), int(spans[:, 2].max()), int(spans[:, 3].min()), int(spans[:, 4].max())
        out += [(lb + s, lb + e, la + x, la + y, like) for s, e, x, y, like in stretches(a[la : ra + 1], b[lb : rb + 1], width, percent)]
    return out


def stretches(one: np.ndarray, two: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(start, end, start in one, end in one, similarity) of two's stretches of `width` or more that stand in one, alike enough as sets.

    A stretch runs from the first to the last of some runs that the two have in common, over any gaps, as long as the
    whole is alike; those that lie in another are left out. One that is shorter than `width` on either side is filled up
    with its neighbours on both, if it is alike with them. Runs that no alike stretch can hold begin none.
    """
    found, stands = _common(one, two)
    if not len(found):
        return []
    starts, froms, size = found.T
    ends, tos = starts + size, froms + size
    if len(found) == 1 and size[0] >= width:
        return [(int(starts[0]), int(ends[0]), int(froms[0]), int(tos[0]), 1.0)]
    alike, at_most, earlier_two, earlier_one, stands_one = _alikeness(one, two)
    most = int(np.count_nonzero(stands & (earlier_two < 0)))
    begins = np.flatnonzero(_hopeful(stands, earlier_two, most, width, percent)[starts])
    if len(begins):
        begins = begins[_hopeful(stands_one, earlier_one, most, width, percent)[froms[begins]]]
    if not len(begins):
        return []
    hits = np.concatenate([[0], np.cumsum(stands)])
    upto = np.maximum.accumulate(np.concatenate([[0], ends]))
    lows, highs = np.where(size >= HULL, froms, len(one)), np.where(size >= HULL, tos, 0)
    joint = np.cumsum(np.maximum(0, ends - np.maximum(starts, upto[:-1])))  # places of two in runs so far
    out: list[tuple[int, int, int, int, float]] = []
    short, reach, filled = [], 0, {}

    def fill(s: int, e: int, x: int, y: int, more: int) -> tuple[int, float] | None:
        """How many of `more` neighbours are those to the left, so that both sides are alike, and how much."""
        left = np.arange(more + 1)
        left = left[(left <= min(s, x)) & (e + more - left <= len(two)) & (y + more - left <= len(one))]
        if len(left):
            # What stands in two alone counts at least as often as it does so for the first time since the leftmost start.
            start = s - int(left[-1])
            low, high = s - left - start, e + more - left - start
            missing = np.concatenate([[0], np.cumsum(~stands[start : e + more] & (earlier_two[start : e + more] < start))])
            most = hits[start + high] - hits[start + low]
            left = left[100 * most >= percent * (most + missing[high] - missing[low])]
        if len(left) > FEW:
            left = left[100 * at_most(s - left, e + more - left, x - left, y + more - left) >= percent]
        for k in left.tolist():
            like = alike(s - k, e + more - k, x - k, y + more - k)
            if 100 * like >= percent:
                return k, like
        return None

    def proposed(own: np.ndarray) -> Iterator[list[tuple[int, int, int, int]]]:
        """For each of the runs `own` the stretches that begin with it and may be alike, by their ends, last first."""
        rows, i = len(own), int(own[0])
        own, later = own[:, None], np.arange(i, len(found))
        begun = later >= own
        fits = begun & (ends[later] >= ends[own])
        # In one the runs stand in the same order, or anyhow between the first and the last of them.
        low = np.minimum.accumulate(np.where(begun, np.minimum(froms[own], lows[later]), froms[own]), axis=1)
        high = np.maximum.accumulate(np.where(begun, np.maximum(tos[own], highs[later]), tos[own]), axis=1)
        n, shared = ends[later] - starts[own] + tos[later] - froms[own], joint[later] - joint[own] + size[own]
        chained = fits & (froms[later] >= froms[own]) & (tos[later] >= tos[own]) & (100 * shared >= (percent - MARGIN) * (n - shared))
        n, shared = ends[later] - starts[own] + high - low, hits[ends[later]] - hits[starts[own]]
        within = fits & (size[later] >= HULL) & ((low < froms[own]) | (high > tos[later])) & (100 * shared >= percent * (n - shared))
        (one_row, one_at), (other_row, other_at) = np.nonzero(chained), np.nonzero(within)
        row, at = np.concatenate([one_row, other_row]), np.concatenate([one_at, other_at]) + i
        back, y = np.concatenate([froms[own[one_row, 0]], low[other_row, other_at]]), np.concatenate([tos[one_at + i], high[other_row, other_at]])
        order = np.lexsort((-ends[at], row))
        each = list(zip(*(v[order].tolist() for v in (starts[own[row, 0]], ends[at], back, y)), strict=True))
        bounds = np.searchsorted(row[order], np.arange(rows + 1)).tolist()
        for k in range(rows):
            yield each[bounds[k] : bounds[k + 1]]

    i = 0
    while i < len(begins):
        rows = max(1, CELLS // (len(found) - int(begins[i])))
        for stretch in proposed(begins[i : i + rows]):
            for s, e, x, y in stretch:
                if e <= reach:
                    break
                if min(e - s, y - x) < width:
                    short.append((s, e, x, y))
                    break
                like = alike(s, e, x, y)
                if 100 * like >= percent:
                    out.append((s, e, x, y, like))
                    reach = e
                    break
        i += rows
    for s, e, x, y in short:
        if any(o[0] <= s and e <= o[1] for o in out):
            continue
        more = width - min(e - s, y - x)
        # A text of few lines again and again has the same stretch beside the same neighbours many times.
        key = (two[max(0, s - more) : e + more].tobytes(), min(s, more), e - s, x, y)
        if key not in filled:
            filled[key] = fill(s, e, x, y, more)
        if filled[key]:
            k, like = filled[key]
            out.append((s - k, e + more - k, x - k, y + more - k, like))
    return out


def _hopeful(stands: np.ndarray, earlier: np.ndarray, most: int, width: int, percent: int) -> np.ndarray:
    """Which places lie in a stretch of `width` or more that may be alike to something in the other text; none that does is left out.

    stands: which places' values the other text has; earlier: as of _before(); most: how many different values both have.
    A stretch lacks the values that any `width` places in it lack, and shares `most` at best; and those that stand for the
    first time count for it in any case.
    """
    n = len(stands)
    if n < width:
        return np.zeros(n, dtype=bool)
    place = np.arange(n)
    lacking = np.flatnonzero(~stands)
    since = np.maximum(earlier[lacking], lacking - width) + 1
    missing = np.cumsum(np.bincount(since, minlength=n + 1) - np.bincount(lacking + 1, minlength=n + 1))[: n - width + 1]
    good = np.flatnonzero(percent * (most + missing) <= 100 * most)
    near = np.zeros(n, dtype=np.int64)
    near[good] = good + width
    upto = np.concatenate([[0], np.cumsum(np.where(stands, 100 - percent, np.where(earlier < 0, -percent, 0)))])
    last = np.searchsorted(-np.maximum.accumulate(upto[::-1])[::-1], -upto[:-1], side="right") - 1
    far = np.where(last - place >= width, last, 0)
    return (np.maximum.accumulate(near) > place) & (np.maximum.accumulate(far) > place)


def _alikeness(one: np.ndarray, two: np.ndarray):
    """Two functions of (s, e, x, y); for each place of two, and of one, the place before it with the same value; and which of one stand in two.

    The first gives the similarity of two[s:e] and one[x:y] as sets; the second, of arrays whose stretches are of one
    length on either side and lie together, what it is at most: anything that stands in any of the others counts as shared.
    """
    ids = np.unique(np.concatenate([one, two]), return_inverse=True)[1]
    one, two = ids[: len(one)], ids[len(one) :]
    earlier_one, earlier_two = _before(one), _before(two)
    marked = np.zeros(len(ids), dtype=bool)

    def alike(s: int, e: int, x: int, y: int) -> float:
        own = one[x:y]
        marked[own] = True
        new = earlier_two[s:e] < s
        shared = int(np.count_nonzero(marked[two[s:e]] & new))
        marked[own] = False
        # Both sums are whole numbers, so the quotient is right at the threshold.
        return shared / (int(np.count_nonzero(new)) + int(np.count_nonzero(earlier_one[x:y] < x)) - shared)

    def at_most(s: np.ndarray, e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s_low, x_low = s.min(), x.min()
        near_two, near_one = two[s_low : e.max()], one[x_low : y.max()]
        marked[near_one] = True
        in_one = marked[near_two]
        marked[near_one] = False
        marked[near_two] = True
        in_two = marked[near_one]
        marked[near_two] = False
        of_two, of_one = s[:, None] + np.arange(e[0] - s[0]), x[:, None] + np.arange(y[0] - x[0])
        new_two, new_one = earlier_two[of_two] < s[:, None], earlier_one[of_one] < x[:, None]
        shared = np.minimum((new_two & in_one[of_two - s_low]).sum(axis=1), (new_one & in_two[of_one - x_low]).sum(axis=1))
        return shared / (new_two.sum(axis=1) + new_one.sum(axis=1) - shared)

    marked[two] = True
    stands_one = marked[one]
    marked[two] = False
    return alike, at_most, earlier_two, earlier_one, stands_one


def _before(values: np.ndarray) -> np.ndarray:
    """For each place, the place before it that holds the same value, or -1."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1, dtype=np.int64)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


#: Shingles of a run that is looked up as a whole, and of one that counts where runs stand in another order; hundredths by which runs alone may seem less alike than all shingles; stretches that are compared one by one without a bound for all, and pairs of runs that are looked at together.
RUN, HULL, MARGIN, FEW, CELLS = 16, 8, 3, 3, 1 << 13


def _common(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (start in two, start in one, length) of runs that stand in both, by their start in two; and which places of two stand in one.

    A run of RUN or more is found where it first stands in one, and followed to both its ends; what is shorter is found
    nearest to where the last run would go on.
    """
    n = len(two)
    if not n or not len(one):
        return np.empty((0, 3), dtype=np.int64), np.zeros(n, dtype=bool)
    order = np.argsort(one, kind="stable")
    values = one[order]
    low = np.searchsorted(values, two)
    stands = values[np.minimum(low, len(one) - 1)] == two
    hit = np.flatnonzero(stands)
    high = np.searchsorted(values, two[hit], side="right")
    long_at = np.full(n, -1, dtype=np.int64)
    upto = np.concatenate([[0], np.cumsum(stands)])
    whole = np.flatnonzero(upto[RUN:] - upto[:-RUN] == RUN) if min(n, len(one)) >= RUN else hit[:0]
    if len(whole):
        rolled = _runs(np.concatenate([one, two]))
        own, mine = rolled[: len(one) - RUN + 1], rolled[len(one) :][whole]
        first = np.argsort(own, kind="stable")
        at = first[np.minimum(np.searchsorted(own, mine, sorter=first), len(own) - 1)]
        long_at[whole] = np.where(own[at] == mine, at, -1)
    out: list[tuple[int, int, int]] = []
    i, shift, k = 0, 0, 0
    while True:
        k = int(hit.searchsorted(i))
        if k == len(hit):
            return np.array(sorted(set(out)), dtype=np.int64).reshape(-1, 3), stands
        i = int(hit[k])
        x, back = int(long_at[i]), 0
        if x < 0:
            places = order[low[i] : high[k]]
            x = int(places[np.abs(places - (i + shift)).argmin()])
        else:
            m = min(i, x)
            back = _differs(two[i - m : i][::-1], one[x - m : x][::-1])
        m = min(n - i, len(one) - x)
        step = RUN
        while (on := _differs(two[i : i + min(step, m)], one[x : x + min(step, m)])) == step < m:
            step *= 4
        out.append((i - back, x - back, on + back))
        i, shift = i + on, x - i


def _differs(one: np.ndarray, two: np.ndarray) -> int:
    """The first place at which they differ, or their length."""
    differ = one != two
    at = int(differ.argmax()) if len(differ) else 0
    return at if len(differ) and differ[at] else len(differ)


def _runs(h: np.ndarray) -> np.ndarray:
    """The hash of each RUN shingles that stand together, from those of half as many."""
    n = 1
    while n < RUN:
        h = mixed(h[:-n]) + h[n:]
        n *= 2
    return h


FOUND = "doc_id long, start int, end int, source_id long, source_start int, source_end int, similarity double"


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs: a, b, anchors (an array of structs h, la, ra, lb, rb). Passages of b that stand in a.

    A pair meets the parts of its two texts' shingles that its anchors span, in joins of written tables, which Spark
    splits by size.
    """
    spans = [f(f"anchors.{c}").alias(f"_{c}") for c, f in (("la", F.array_min), ("ra", F.array_max), ("lb", F.array_min), ("rb", F.array_max))]
    pairs = written(pairs.select("a", "b", "anchors", *spans), "pairs")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "asked")
    shingles = written(_shingles(texts.join(by_size(asked), "doc_id", "left_semi")), "shingles")
    both = pairs
    for c in ("a", "b"):
        part = F.expr(f"substring(hashes, 1 + {KEPT} * _l{c}, {KEPT} * (_r{c} - _l{c} + 1))").alias(f"_part_{c}")
        both = both.join(shingles.select(F.col("id").alias(c), "hashes"), c).select(*both.columns, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
        names = [x.split()[0] for x in FOUND.split(", ")]
        for batch in batches:
            rows = []
            lists = batch.column(2)
            bounds, every = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist(), lists.flatten()
            every = np.stack([every.field(c).to_numpy().astype(np.int64) for c in ("h", "la", "ra", "lb", "rb")], axis=1)
            rest = (x.to_pylist() for x in (batch.column(k) for k in (0, 1, 3, 4, 5, 6)))
            for n, (a, b, la, lb, one, two) in enumerate(zip(*rest, strict=True)):
                marks = every[bounds[n] : bounds[n + 1]] - (0, la, la, lb, lb)
                for s, e, x, y, like in matched(unpacked(one), unpacked(two), marks, width, percent):
                    rows.append((b, lb + s, lb + e + SHINGLE - 1, a, la + x, la + y + SHINGLE - 1, like))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    found = written(both.select("a", "b", "anchors", "_la", "_lb", "_part_a", "_part_b").mapInArrow(run, FOUND), "passages")
    forget(pairs, asked, shingles)
    return found


def _anchored(parts: list[DataFrame]) -> DataFrame:
    """a, b, anchors and hs, a bit for each of their hash functions, from rows (a, ca_low, ca_high, la, ra; b, h, lb, c, rb) in parts, each of which is summed by itself.

    A passage of b lies in its window, so of a's windows what is further from their least shingles than it can reach is
    left out.
    """
    left, right = (F.ceil((F.col(x) - F.col(y)) * 100 / PERCENT).cast("int") for x, y in (("c", "lb"), ("rb", "c")))
    la, ra = F.greatest("la", F.col("ca_low") - left), F.least("ra", F.col("ca_high") + right)
    anchors = F.collect_set(F.struct("h", la.alias("la"), ra.alias("ra"), "lb", "rb")).alias("anchors")
    summed = [rows.groupBy("a", "b").agg(anchors, F.bit_or(F.expr("shiftleft(1, h)")).alias("hs")) for rows in parts]
    if len(summed) == 1:
        return summed[0]
    return written_parts(summed, "anchored").groupBy("a", "b").agg(F.flatten(F.collect_list("anchors")).alias("anchors"), F.bit_or("hs").alias("hs"))


def _unexplained(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """The rows whose least shingle (doc_id, c) lies in no passage that is found."""
    spans = written(passages.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("_spans")), "spans")
    within = F.exists("_spans", lambda s: (s["start"] <= F.col("c")) & (F.col("c") < s["end"]))
    return rows.join(by_size(spans, SPAN_ROWS), "doc_id", "left").filter(~F.coalesce(within, F.lit(False))).select(*rows.columns)


def most_hits(begin: np.ndarray, middle: np.ndarray, table: np.ndarray, bit: np.ndarray, one: np.ndarray, other: np.ndarray, width: int) -> np.ndarray:
    """For each size of `width` to 2 * width - 1 (down) and each pair of rows (across), the most hits of a stretch up to that size.

    A row one has the places begin[one] to begin[one + 1], at most `width` - 1 to either side of its place `middle`,
    which its stretches hold; a place whose bit stands in the other row of `table` is a hit. No stretch of a size: less than 0.
    """
    # All middles stand beneath each other; a stretch that leaves its row has less than no hits.
    at = np.arange(1 - width, width)[:, None] + middle[one]
    inside = (at >= 0) & (at < begin[one + 1] - begin[one])
    value = np.where(inside, table[other, bit[np.where(inside, at + begin[one], 0)]], -2 * width)
    upto = np.concatenate([np.zeros((1, len(one)), dtype=np.int32), np.cumsum(value, axis=0, dtype=np.int32)])
    sizes = range(width, 2 * width)
    return np.maximum.accumulate([(upto[n:] - upto[: 2 * width - n])[:width].max(axis=0) for n in sizes], axis=0)


def _sources(members: DataFrame, width: int, percent: int, most: int) -> DataFrame:
    """For each open member the first `most` documents, after `after`, that have much of what surrounds its least shingle.

    members: key, doc_id, h, l, c, r, blocks, around, after; those with `after` are open. Open members and all members are
    dealt to blocks of about TILE, and each two blocks are one task, which gives the rows of `most` documents for an open
    member and no pairs besides. Keys of one block are compared some thousand rows at a time.
    """
    sized = members.groupBy("key").agg(*[F.ceil(F.count(x) / TILE).cast("int").alias(n) for x, n in ((F.lit(1), "_all"), ("after", "_open"))], F.count(F.lit(1)).alias("_n"))
    sized = written(sized.filter("_open > 0"), "sized")
    rows = sized.filter("_all = 1").agg(F.sum("_n")).first()[0] or 0
    dealt = members.join(by_size(sized), "key")
    dice = F.xxhash64("doc_id", "c")
    alone = dealt.filter("_all = 1").select(*members.columns, F.pmod(F.xxhash64("key"), F.lit(rows // (TOGETHER * TILE) + 1)).alias("cell"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.col("after").isNotNull().alias("asks"), F.lit(True).alias("gives"))
    tiled = dealt.filter("_all > 1").withColumn("cell", F.col("key"))
    every = tiled.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_open") - 1))).withColumn("j", F.pmod(dice, F.col("_all")).cast("int")).withColumn("asks", F.lit(False)).withColumn("gives", F.lit(True))
    asks = tiled.filter("after IS NOT NULL").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_all") - 1))).withColumn("i", F.pmod(dice, F.col("_open")).cast("int")).withColumn("asks", F.lit(True)).withColumn("gives", F.lit(False))
    # Two stretches of `width` or more share at least so many; what they share is `percent` of either at least.
    span = SPAN * width
    need = -(-2 * width * percent // (100 + percent))
    out = "key long, a long, ca_low int, ca_high int, la int, ra int, b long, h int, lb int, c int, rb int"
    names = [x.split()[0] for x in out.split(", ")]
    types = [pa.int64() if x.endswith("long") else pa.int32() for x in out.split(", ")]

    def shapes(middle: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size, start and end of each stretch of `width` or more with the place `middle`, of n - 1 places."""
        if (middle, n) not in known:
            i, j = np.arange(middle + 1)[:, None], np.arange(middle + 1, n)[None]
            first, last = np.nonzero(j - i >= width)
            known[middle, n] = last + middle + 1 - first, first, last + middle + 1
        return known[middle, n]

    known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def compare(t: pa.Table) -> pa.Table:
        release()
        t = t.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("c", "ascending")]).combine_chunks()
        key, doc, h, low, c, high, asking, gives = (t.column(x).to_numpy() for x in ("key", "doc_id", "h", "l", "c", "r", "asks", "gives"))
        after = t.column("after").fill_null(-1 << 63).to_numpy()
        blocks = t.column("blocks").to_numpy().view(np.uint16).reshape(-1, len(BLOCKS))
        # near: each row's shingles in order, from begin on; around: row and shingle of each row's set, in order.
        raw = t.column("around").to_pylist()
        begin = np.cumsum([0] + [len(x) // KEPT for x in raw])
        hashes, near = np.unique(unpacked(b"".join(raw)), return_inverse=True)
        around = np.sort(np.repeat(np.arange(len(raw), dtype=np.uint64), np.diff(begin)) << np.uint64(32) | near.astype(np.uint64))
        around = around[np.append(True, around[1:] != around[:-1])]
        at = np.searchsorted(around, np.arange(len(raw) + 1, dtype=np.uint64) << np.uint64(32))
        size = np.diff(at)
        bit = (mixed(hashes) % np.uint64(BITS)).astype(np.int64)[near]
        table = np.zeros((len(raw), BITS), dtype=bool)
        table[np.repeat(np.arange(len(raw)), np.diff(begin)), bit] = True
        bits = np.packbits(table, axis=1).view(np.uint64)
        merged = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        middle, marked = np.minimum(c, width - 1), np.zeros(len(hashes), dtype=bool)
        single = size == np.diff(begin)

        def dense(one: np.ndarray, other: np.ndarray) -> np.ndarray:
            """Whether some stretch about one's least shingle can be alike to one of `width`, by the bits of the other's shingles."""
            n = begin[one + 1] - begin[one]
            starts = np.cumsum(n) - n
            value = np.where(table[np.repeat(other, n), bit[np.arange(n.sum()) + np.repeat(begin[one] - starts, n)]], 100, -percent)
            upto = np.cumsum(value)
            least = np.minimum.reduceat(np.append(upto - value, 0), np.stack([starts, starts + middle[one] + 1], axis=1).ravel())[::2]
            most = np.maximum.reduceat(upto, np.stack([starts, starts + middle[one]], axis=1).ravel())[1::2]
            return most - least >= percent * width

        def fitting(b: np.ndarray, a: np.ndarray) -> np.ndarray:
            """Whether alike() may hold, for all pairs together: by the most places of b's stretches of each size that have a bit of a's, and of a's."""
            most_b, most_a = (most_hits(begin, middle, table, bit, *x, width) * (100 + percent) for x in ((b, a), (a, b)))
            sizes = percent * (2 * width + np.arange(width, dtype=np.int32))[:, None]
            out = np.zeros(len(b), dtype=bool)
            for i in range(width):
                out |= (np.minimum(most_b[i], most_a) >= sizes + percent * i).any(axis=0)
            return out

        def sharing(b: np.ndarray, a: np.ndarray) -> np.ndarray:
            """Which of the rows b and a have `need` shingles in common, and may be alike: those whose bits leave room for both, counted."""
            room = np.bitwise_count(bits[b] & bits[a]).sum(axis=1, dtype=np.int64) + np.minimum(merged[b], merged[a])
            out = np.flatnonzero(room >= need)
            for one, other in ((b, a), (a, b)):
                if len(out):
                    out = out[~single[b[out]] | dense(one[out], other[out])]
            n, first = size[a[out]], at[a[out]]
            if not n.sum():
                return out[:0]
            starts = np.cumsum(n) - n
            own = around[np.arange(n.sum()) + np.repeat(first - starts, n)] & _LOW | np.repeat(b[out].astype(np.uint64) << np.uint64(32), n)
            both = around[np.minimum(np.searchsorted(around, own), len(around) - 1)] == own
            filled = n > 0
            shared = np.zeros(len(out), dtype=np.int64)
            shared[filled] = np.add.reduceat(both, starts[filled], dtype=np.int64)
            out = out[shared >= need]
            return out[~single[b[out]] | fitting(b[out], a[out])]

        def counted(one: int, other: int) -> tuple[np.ndarray, np.ndarray]:
            """Sizes of the stretches of `width` or more about a least shingle, and how many of each are around the other one."""
            marked[near[begin[other] : begin[other + 1]]] = True
            total = np.concatenate([[0], np.cumsum(marked[near[begin[one] : begin[one + 1]]])])
            marked[near[begin[other] : begin[other + 1]]] = False
            sizes, first, last = shapes(int(middle[one]), len(total))
            return sizes, total[last] - total[first]

        def alike(b: int, a: int) -> bool:
            """Whether b has a stretch that is like the shortest one of a which shares as much."""
            size, shared = counted(b, a)
            enough = (shared >= need) & ((100 + percent) * shared >= percent * (size + width))
            size, shared = size[enough], shared[enough]
            if not len(size):
                return False
            least = np.full(2 * width, 4 * width)
            np.minimum.at(least, *counted(a, b)[::-1])
            least = np.minimum.accumulate(least[::-1])[::-1]
            return bool(((100 + percent) * shared >= percent * (size + least[shared])).any())

        # Each asking row goes through its key's sources of smaller documents after `after`, some at a time.
        sources, rows = np.flatnonzero(gives), []
        group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        place = {}
        for n, (k, d) in enumerate(zip(group[sources].tolist(), doc[sources].tolist(), strict=True)):
            place.setdefault(k, ([], n))[0].append(d)
        todo, nexts, ends = [], [], []
        for b in np.flatnonzero(asking).tolist():
            docs, first = place.get(int(group[b]), ([], 0))
            x, y = bisect.bisect_right(docs, after[b]), bisect.bisect_left(docs, doc[b])
            if x < y:
                todo.append(b)
                nexts.append(first + x)
                ends.append(first + y)
        todo, nexts, ends = (np.array(x, dtype=np.int64) for x in (todo, nexts, ends))
        found: dict[int, list[int]] = {}
        while len(todo):
            n = np.minimum(ends - nexts, AT_ONCE)
            b, a = np.repeat(todo, n), sources[np.arange(n.sum()) + np.repeat(nexts - np.cumsum(n) + n, n)]
            same = np.flatnonzero(((blocks[a] == blocks[b]) & (blocks[b] != 0)).any(axis=1))
            b, a = b[same], a[same]
            fit = np.concatenate([b[:0], *(at + sharing(b[at : at + PAIRS], a[at : at + PAIRS]) for at in range(0, len(b), PAIRS))])
            for b, a in zip(b[fit].tolist(), a[fit].tolist(), strict=True):
                own = found.setdefault(b, [])
                if (len(own) < most or doc[a] == own[-1]) and (not single[b] or alike(b, a)):
                    rows.append((key[b], doc[a], c[a], c[a], low[a], high[a], doc[b], h[b], max(low[b], c[b] - span), c[b], min(high[b], c[b] + span)))
                    own += [doc[a]] * (doc[a] not in own[-1:])
            nexts = nexts + n
            goes = nexts < ends
            full = [k for k, b in enumerate(todo.tolist()) if goes[k] and len(found.get(b, ())) == most and doc[sources[nexts[k]]] != found[b][-1]]
            goes[full] = False
            todo, nexts, ends = todo[goes], nexts[goes], ends[goes]
        return pa.table({n: pa.array([r[k] for r in rows], x) for k, (n, x) in enumerate(zip(names, types, strict=True))})

    columns = [*members.columns, "cell", "i", "j", "asks", "gives"]
    return alone.unionByName(every.select(*columns)).unionByName(asks.select(*columns)).groupBy("cell", "i", "j").applyInArrow(compare, out)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, percent: int = PERCENT) -> DataFrame:
    """Passages of `passage` words or more that stand, alike to `percent` as sets of word shingles, in an earlier document.

    docs: doc_id and text; other columns are ignored. Returns doc_id, start, end, source_id, source_start, source_end
    (words from 0, end exclusive), similarity. A copy of a whole text is one passage from its first to its last word,
    with its source the smallest doc_id of that text; copies are found by the texts' hashes, and only a text's first
    document goes on. Texts that are null or shorter than a passage have none; rows without doc_id take no part; rows
    that repeat a doc_id are one document. No documents: no rows.

    Windows are candidates of each other when their least values agree and one of the four blocks of words beside them.
    The documents of such a bucket meet the first of them, so a passage that a third of all documents hold gives as many
    pairs as documents, and pairs in which AGREE hash functions agree are verified. Where that explains a window of a
    later document by no passage, the window meets all of its bucket, in tiles of bounded size, by the shingles around
    it, and goes on with the first documents that share as many of them as the shortest passage does; until none is left. So a passage is missed
    if for all hash functions its least values or all blocks beside them are changed.
    """
    width = passage - SHINGLE + 1
    text = text_or_empty()
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = docs.select("doc_id", F.sha2(text, 256).alias("_hash"), F.octet_length(text).alias("_size")).filter(F.col("_size") >= 2 * passage - 1)
    same = written(marked.groupBy("_hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")).filter("first < _last"), "same")
    copies = written(marked.join(same, "_hash").filter("doc_id <> first").select("doc_id", F.col("first").alias("source_id")).distinct(), "copies")
    copied = written(copies.select("doc_id").distinct(), "copied")
    texts = docs.join(by_size(copied), "doc_id", "left_anti")

    found = written(windows(texts, passage), "windows")
    shared = written(found.groupBy("key").agg(F.sum(F.col("first").cast("int")).alias("_n")).filter("_n > 1").select("key"), "shared")
    rows = among(found.drop("first"), shared, "key", "rows")
    forget(found, shared)
    # A bucket is a key with one of the blocks beside it; those of one block have nothing to do with those of another.
    nears, reaches, met = [], [], []
    for k in range(len(BLOCKS)):
        block = F.shiftrightunsigned("blocks", 16 * k).bitwiseAND(F.lit(0xFFFF))
        each = rows.filter(block != 0).withColumn("bucket", F.xxhash64("key", F.lit(k), block))
        first = each.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("_last")).filter("a < _last").select("bucket", "a")
        first = written(first, "first")
        near = among(each, first, "bucket", "near")
        forget(first)
        reach = near.filter("doc_id = a").groupBy("bucket").agg(*[f(x).alias(n) for f, x, n in ((F.min, "l", "la"), (F.min, "c", "ca_low"), (F.max, "c", "ca_high"), (F.max, "r", "ra"))])
        reach = written(reach, "reach")
        others = near.filter("doc_id <> a").select("bucket", "a", F.col("doc_id").alias("b"), "h", F.col("l").alias("lb"), "c", F.col("r").alias("rb"))
        met += sliced(others, reach, "bucket")
        nears.append(near)
        reaches.append(reach)
    forget(rows)
    near = reduce(DataFrame.union, nears)
    passages = _verified(_anchored(met).filter(F.bit_count("hs") >= AGREE), texts, width, percent)
    forget(*reaches)

    left = written(_unexplained(near.filter("doc_id <> a"), passages).select("bucket").distinct(), "left")
    if left.limit(1).count():
        members = written(near.join(by_size(left), "bucket", "left_semi").drop("bucket", "a").distinct(), "members")
        passages = written(passages.union(_among(members, passages, texts, width, percent)), "passages")
        forget(members)
    forget(*nears, left)
    sources = written(copies.select(F.col("source_id").alias("doc_id")).distinct(), "sources")
    sizes = written(_shingles(texts.join(by_size(sources), "doc_id", "left_semi")).select(F.col("id").alias("source_id"), "n_words").distinct(), "sizes")
    whole = copies.join(by_size(sizes), "source_id").filter(F.col("n_words") >= passage)
    zero, one = F.lit(0), F.lit(1.0)
    whole = whole.select("doc_id", zero.alias("start"), F.col("n_words").alias("end"), "source_id", zero.alias("source_start"), F.col("n_words").alias("source_end"), one.alias("similarity"))
    return passages.dropDuplicates(["doc_id", "start", "end", "source_id"]).union(whole)


def _among(members: DataFrame, explaining: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Passages of members (key, doc_id, h, l, c, r, blocks) that the passages so far don't explain, by what surrounds their least shingles."""
    place = ["key", "doc_id", "c"]
    ids = written(members.select("doc_id").distinct(), "ids")
    shingles = written(_shingles(texts.join(by_size(ids), "doc_id", "left_semi")).select(F.col("id").alias("doc_id"), "hashes"), "shingles")
    low = F.greatest(F.lit(0), F.col("c") - (width - 1))
    around = F.substring(F.col("hashes"), 1 + KEPT * low, KEPT * (F.col("c") + width - low)).alias("around")
    around = written(members.join(shingles, "doc_id").select(*members.columns, around), "around")
    forget(ids, shingles)
    asking = written(_unexplained(members.select(*place).distinct(), explaining).select(*place, F.lit(-1 << 63).cast("long").alias("after")), "asking")
    most, passages = 1, None
    while True:
        keys = written(asking.select("key").distinct(), "keys")
        state = around.join(by_size(keys), "key", "left_semi").join(by_size(asking), place, "left")
        hits = written(_sources(state, width, percent, most), "hits")
        forget(keys)
        if passages is not None and not hits.limit(1).count():
            forget(around, asking, hits)
            return passages
        got = _verified(_anchored([hits]), texts, width, percent)
        passages = got if passages is None else written(passages.union(got), "passages")
        last = hits.groupBy("key", F.col("b").alias("doc_id"), "c").agg(F.max("a").alias("after"))
        forget(asking)
        asking = written(_unexplained(last, got), "asking")
        forget(hits)
        most *= 4


def packed(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEPT, 8), dtype=np.uint8)
    out[:, :KEPT] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, KEPT)
    return out.reshape(-1).view("<u8")


def _shingles(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            of_words, at = hashed_words(b.column(1))
            found, to = shingled_rows(of_words, at, SHINGLE)
            n = np.diff(at)
            hashes = [packed(found[to[i] : to[i + 1]]) if n[i] >= SHINGLE else b"" for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(hashes, pa.binary())], names=["id", "n_words", "hashes"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "id long, n_words int, hashes binary")


_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (start, end exclusive) and the white space between them."""
    if not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= len(places):
            break
        x, y = places[start][0], places[min(end, len(places)) - 1][1]
        if y > at:
            out.append(text[at : max(at, x)])
            at = y
    return "".join([*out, text[at:]]).strip()


def remove_repeated(docs: DataFrame, passage: int = PASSAGE, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) whose texts have lost the passages that an earlier document has.

    The first document with a passage keeps it. Every document stays, with n_chars counted anew where its text has
    changed; one that is all repeated passage stays with what is left, which may be an empty text. Null and empty texts
    and rows without doc_id stay as they are, rows that repeat a doc_id lose the same words each, other columns are left
    out; no documents, no rows.
    """
    small_batches(docs.sparkSession)
    spans = written(repeated_passages(docs, passage, percent).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    types = "doc_id long, text string, lang string, source string, n_chars long"
    cols = [F.col(c).cast(t).alias(c) for c, t in (x.split() for x in types.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts, n = b.column(1).to_pylist(), b.column(4).to_pylist()
            for i, own in enumerate(b.column(5).to_pylist()):
                if own and texts[i] is not None:
                    texts[i] = without(texts[i], [(s["start"], s["end"]) for s in own])
                    n[i] = len(texts[i])
            arrays = [b.column(0), pa.array(texts, pa.string()), b.column(2), b.column(3), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "lang", "source", "n_chars"])

    return docs.select(*cols).join(by_size(spans, SPAN_ROWS), "doc_id", "left").select(*[x.split()[0] for x in types.split(", ")], "spans").mapInArrow(run, types)
