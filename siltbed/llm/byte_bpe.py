"""Byte-level BPE by replaying merges over a whole chunk of the corpus in rank order."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltbed.llm.common import cache, looked_up, small_batches, text_or_empty, uncollected

#: A cached word has at most so many bytes, a worker's cache so many words.
WORD_BYTES, CACHE_WORDS = 48, 500_000

_vocabularies: dict = cache()


class Vocabulary:
    """Ranks of a rank file; a token's id is its rank."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes_of = {n: t for t, n in ranks.items()}
        #: Every pair of tokens that some token is made of; its rank is that token's.
        self.pairs = {(ranks[t[:i]], ranks[t[i:]]): n for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.known: dict[str, bytes] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    if (path, pattern) not in _vocabularies:
        _vocabularies[path, pattern] = Vocabulary(path, pattern)
    return _vocabularies[path, pattern]


def _of_bytes(v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The id of each byte and the rank of each two bytes' pair; -1 where there is none."""
    if not hasattr(v, "of_bytes"):
        one = np.array([v.ranks.get(bytes([i]), -1) for i in range(256)])
        two = [v.pairs.get((a, b), -1) for a in one.tolist() for b in one.tolist()]
        v.of_bytes = one, np.array(two).reshape(256, 256)
    return v.of_bytes


def replay(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The ids of each word."""
    ids, to = _replayed(words, v)
    return [x.tolist() for x in np.split(ids, to[1:-1])] if words else []


def _replayed(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All words' ids in order, and where each word's begin.

    All words' bytes stand in one sequence, linked within each word; a word that is a token stands there as that. An
    inverted index has, for each pair's rank, the positions where the pair stands; the lowest rank that has any is
    applied at all of them, left to right, and only the pairs with the neighbours left and right of a merge are looked
    up anew. Within a word BPE takes the lowest rank of the moment: where a merge gives a neighbour pair of a lower rank
    still, the rest of its word waits until that one is done.
    """
    one, two = _of_bytes(v)
    pair_rank = v.pairs.get
    whole = np.array([v.ranks.get(w, -1) for w in words], dtype=np.int64)
    size = np.where(whole < 0, np.array([len(w) for w in words], dtype=np.int64), 1)
    of_word = np.repeat(np.arange(len(words)), size)
    inside = (whole < 0)[of_word]
    raw = np.zeros(len(of_word), dtype=np.uint8)
    raw[inside] = np.frombuffer(b"".join([w for w, n in zip(words, whole.tolist(), strict=True) if n < 0]), dtype=np.uint8)
    begin = np.where(inside, one[raw], whole[of_word])
    if len(begin) and begin.min() < 0:
        raise KeyError("a byte that is no token")
    ranked = np.full(len(of_word), -1, dtype=np.int64)
    if len(raw) > 1:
        ranked[:-1] = np.where(inside[:-1] & (of_word[:-1] == of_word[1:]), two[raw[:-1], raw[1:]], -1)
    places = np.flatnonzero(ranked >= 0)
    places = places[np.argsort(ranked[places], kind="stable")]
    cuts = np.flatnonzero(np.diff(ranked[places], prepend=-1))
    bounds = [*cuts.tolist(), len(places)]
    index: dict[int, list[int]] = {r: places[x:y].tolist() for r, x, y in zip(ranked[places[cuts]].tolist(), bounds, bounds[1:], strict=False)}
    ids, word, at_rank, end = begin.tolist(), of_word.tolist(), ranked.tolist(), len(begin)
    right, left = list(range(1, end + 1)), list(range(-1, end - 1))
    order = list(index)
    heapq.heapify(order)
    while order:
        rank = heapq.heappop(order)
        places = index.pop(rank, None)
        if not places:
            continue
        places.sort()
        waits = -1
        later: list[int] = []
        for at in places:
            if at_rank[at] != rank:
                continue  # a merge since has taken one side
            own = word[at]
            if own == waits:
                later.append(at)
                continue
            to = right[at]
            after, before = right[to], left[at]
            ids[at], ids[to], right[at], at_rank[at], at_rank[to] = rank, -1, after, -1, -1
            if after < end:
                left[after] = at
                if word[after] == own and (r := pair_rank((rank, ids[after]))) is not None:
                    at_rank[at] = r
                    if r in index:
                        index[r].append(at)
                    else:
                        index[r] = [at]
                        heapq.heappush(order, r)
                    if r < rank:
                        waits = own
            if before >= 0 and word[before] == own:
                r = pair_rank((ids[before], rank))
                if r is None:
                    at_rank[before] = -1
                    continue
                at_rank[before] = r
                if r in index:
                    index[r].append(before)
                else:
                    index[r] = [before]
                    heapq.heappush(order, r)
                if r < rank:
                    waits = own
        if later:
            if rank not in index:
                index[rank] = []
                heapq.heappush(order, rank)
            index[rank] += later
    out = np.array(ids, dtype=np.int64)
    kept = out >= 0
    return out[kept], np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(size)])]


def encode_texts(texts: list[str], v: Vocabulary) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers: one replay over all words the cache hasn't got."""
    known = v.known
    split = [v.find(t) for t in texts]
    if len(known) > CACHE_WORDS:
        known.clear()

    def learn(words: set[str]) -> dict[str, bytes]:
        new = list(words)
        raw = [w.encode() for w in new]
        fresh: dict[str, bytes] = {}
        ids, to = _replayed(raw, v)
        packed, to = ids.astype("<u4").tobytes(), (4 * to).tolist()
        for w, b, x, y in zip(new, raw, to, to[1:], strict=False):
            fresh[w] = packed[x:y]
            if len(b) <= WORD_BYTES:
                known[w] = fresh[w]
        return fresh

    return looked_up(split, known, learn)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every whole text; a null text is empty, and has no ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks, pattern)
        for b in batches:
            with uncollected():
                ids = encode_texts(b.column(1).to_pylist(), v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds `decoded`, the bytes that encode()'s ids stand for; ids that the vocabulary hasn't got are an error."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary(ranks, pattern).bytes_of.__getitem__
        for b in batches:
            raw = [b"".join(map(get, memoryview(x).cast("I"))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
