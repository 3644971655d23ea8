"""Sharding by Karmarkar-Karp differencing: groups of equal texts stay whole, shards' bytes come out near equal."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import gapless_rank, text_or_empty, written

#: Partial partitions that one task combines; a level's results are the next level's items.
FAN_IN = 4096


def difference(items: list[tuple[int, ...]]) -> list[list[int]]:
    """For each item (the bytes of its k slots), where its slots go among the k slots of the whole.

    Again and again the two partial partitions with the largest spread are combined, the fullest slot of one with the
    emptiest of the other. The steps are kept as a tree and walked down once at the end. Ties go to the item that
    stands first.
    """
    k = len(items[0])
    if len(items) == 1:
        return [sorted(range(k), key=lambda s: (-items[0][s], s))]
    heap: list[tuple[int, int]] = []
    sums: list[list[int]] = []
    slots: list[list] = []  # of a leaf: its own slots, fullest first; of a step: pairs of its parts' places
    parts: list[tuple[int, int] | None] = []
    for n, item in enumerate(items):
        order = sorted(range(k), key=lambda s: (-item[s], s))
        sums.append([item[s] for s in order])
        slots.append(order)
        parts.append(None)
        heap.append((item[order[-1]] - item[order[0]], n))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        one, two = sums[a], sums[b]
        both = sorted([(one[i] + two[k - 1 - i], i) for i in range(k)], key=lambda x: (-x[0], x[1]))
        sums.append([x for x, _ in both])
        slots.append([(i, k - 1 - i) for _, i in both])
        parts.append((a, b))
        heapq.heappush(heap, (both[-1][0] - both[0][0], len(sums) - 1))
    to: dict[int, list[int]] = {heap[0][1]: list(range(k))}
    out: list[list[int]] = [[] for _ in items]
    for n in range(len(sums) - 1, -1, -1):
        place = to.pop(n)
        if parts[n] is None:
            for i, s in enumerate(slots[n]):
                out[n].append((s, place[i]))
            out[n] = [t for _, t in sorted(out[n])]
        else:
            one, two = [0] * k, [0] * k
            for i, (x, y) in enumerate(slots[n]):
                one[x], two[y] = place[i], place[i]
            to[parts[n][0]], to[parts[n][1]] = one, two
    return out


def _level(items: DataFrame, blocks: int) -> DataFrame:
    """items: item binary, slots array<long>. Returns item, block, goes (for each slot of the item, its slot in the block)."""

    def combine(part: pa.Table) -> pa.Table:
        part = part.sort_by("item")
        goes = difference([tuple(x) for x in part.column("slots").to_pylist()])
        return pa.table({"item": part.column("item").cast(pa.binary()), "block": part.column("block"), "goes": pa.array(goes, pa.list_(pa.int32()))})

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(blocks)), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(combine, "item binary, block int, goes array<int>")


def _beside(groups: DataFrame, sums: list[int], blocks: int) -> DataFrame:
    """Item and shard of groups that fill shards which hold `sums` bytes already.

    Each block is differenced together with its share, by bytes, of what is uneven in the sums, so that all blocks
    leave room where the sums are high.
    """
    k = len(sums)
    uneven = [x - min(sums) for x in sums]
    total = groups.agg(F.sum("bytes")).first()[0] or 1

    def combine(part: pa.Table) -> pa.Table:
        part = part.sort_by("item")
        sizes = part.column("bytes").to_pylist()
        own = sum(sizes)
        goes = difference([tuple(x * own // total for x in uneven), *((x, *[0] * (k - 1)) for x in sizes)])
        shard = [0] * k
        for s, place in enumerate(goes[0]):
            shard[place] = s
        return pa.table({"item": part.column("item").cast(pa.binary()), "slot": pa.array([shard[g[0]] for g in goes[1:]], pa.int32())})

    dealt = groups.select("item", "bytes", F.pmod(F.xxhash64("item", F.lit(blocks)), F.lit(blocks)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInArrow(combine, "item binary, slot int").select("item", F.col("slot").alias("shard"))


def shards_of(groups: DataFrame, shards: int) -> DataFrame:
    """groups: item binary (unique), bytes long. Returns item, shard.

    A block of about FAN_IN groups is differenced in one task; its k sums are one item of the next level, until one
    block is left. A level has a FAN_IN-th of the rows of the one before, and no level comes to the driver. Groups that
    are larger than a block's mean slot, fewer than blocks times shards, are dealt first, and blocks fill up beside them.
    """
    left, total = groups.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    blocks = max(1, -(-left // FAN_IN))
    if blocks > 1:
        size = F.col("bytes") * blocks * shards
        large = written(groups.filter(size > total), "large")
        if large.limit(1).count():
            top = written(shards_of(large, shards), "top")
            sums = {r["shard"]: r["bytes"] for r in top.join(large, "item").groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
            rest = groups.filter(size <= total)
            return top.union(_beside(rest, [sums.get(s, 0) for s in range(shards)], blocks))
    first = F.array(F.col("bytes"), *[F.lit(0).cast("long")] * (shards - 1))
    done = written(_level(groups.select("item", first.alias("slots")), blocks), "level").select("item", "block", F.element_at("goes", 1).alias("slot"))
    sized = done.join(groups, "item")
    while blocks > 1:
        sums = sized.groupBy("block", "slot").agg(F.sum("bytes").alias("bytes"))
        per_slot = [F.coalesce(F.sum(F.when(F.col("slot") == s, F.col("bytes"))), F.lit(0)) for s in range(shards)]
        items = sums.groupBy("block").agg(F.array(*per_slot).alias("slots")).select(F.col("block").cast("string").cast("binary").alias("item"), "slots")
        blocks = max(1, -(-blocks // FAN_IN))
        upper = written(_level(items, blocks), "level").select(F.col("item").cast("string").cast("int").alias("block"), F.col("block").alias("_next"), "goes")
        sized = sized.join(upper, "block").select("item", F.col("_next").alias("block"), F.expr("goes[slot]").alias("slot"), "bytes")
    return sized.select("item", F.col("slot").alias("shard"))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Deals documents into `shards` shards of near equal bytes; equal texts go to one shard together.

    docs: doc_id and text; other columns are ignored. Size is the text's UTF-8 bytes plus 1; a null text counts as
    empty and is in one group with the empty ones. Returns doc_id, size, text_crc32, shard, slot (gapless from 0 within
    the shard). One group larger than a shard's share makes its shard larger, since groups are indivisible; the rest
    still comes out even. Rows are summed to groups before the shuffle, and a hot group's rows meet their group's shard
    in a join that Spark splits by size.
    """
    text = text_or_empty()
    rows = written(
        docs.select(
            F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("item"),
        ),
        "sizes",
    )
    groups = written(rows.groupBy("item").agg(F.sum("size").alias("bytes")), "groups")
    placed = written(rows.join(shards_of(groups, shards), "item").drop("item"), "placed")
    return gapless_rank(placed, "shard", ["doc_id", "text_crc32"], "slot")
