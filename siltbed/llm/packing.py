"""Best-fit packing of token sequences, planned over the histogram of lengths."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import cache, gapless_rank, looked_up, small_batches, text_or_empty, uncollected, written

#: A worker's cache is emptied beyond so many chunks; longer chunks stay in it for one batch only.
CACHE_CHUNKS, CHUNK_CHARS = 500_000, 48
#: Chunks that one call encodes.
TOGETHER = 2048

_chunks: dict[str, Chunks] = cache()
#: Marks whose run after letters is encoded by itself: no quotes and no "<", which begin tokens of their own.
TAIL = ".,;:!?%#&*$"
#: A chunk, between spaces, that folding leaves as it is.
_PLAIN = re.compile("(?<= )[a-z]+(?= )")


def _le(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Chunks:
    """A tokenizer with the ids of chunks that it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        own = json.loads(self.whole.to_str())
        bare = dict(own, normalizer=None, pre_tokenizer={"type": "WhitespaceSplit"}, added_tokens=[])
        #: The same merges for what normalizing and splitting leave as it is: one run of letters, lower-cased, as byte characters.
        self.merges = Tokenizer.from_str(json.dumps(bare))
        vocabulary = self.merges.get_vocab()
        suffix = own["model"].get("end_of_word_suffix")
        self.folds = bool(suffix) and {n["type"] for n in own["normalizer"].get("normalizers", [])} == {"NFC", "Replace", "Lowercase"}
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte_chars = dict(zip(shown, map(chr, shown), strict=True)) | {b: chr(256 + n) for n, b in enumerate(sorted({*range(256)}.difference(shown)))}

    def runs_of_letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that are letters only, composed and lower-cased, from calls over many at once."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            part = [w if w.isascii() else w.encode().decode("latin-1").translate(self.byte_chars) for w in words[at : at + TOGETHER]]
            ids = np.array(self.merges.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, start = ids.tobytes(), 0
            for end in ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist():
                out.append(raw[start:end])
                start = end
        return out

    def learn(self, new: set[str]) -> None:
        """Adds the chunks' ids to the known ones.

        The tokenizer folds case, and parts letters from a run of marks after them. So a chunk of letters is looked up
        in lower case and without such a tail, and its merges alone are run when it is new; tails and any other chunk go
        through the whole tokenizer.
        """
        known, stems, rest = self.known, {}, []
        plain = set(_PLAIN.findall(f" {' '.join(new)} ")) if self.folds else set()
        for c in new.difference(plain):
            stem = c.rstrip(TAIL)
            low = stem.lower()
            if self.folds and low.isalpha() and (low.isascii() or low.islower() and is_normalized("NFC", stem) and "\u03c2" not in low and "\u0307" not in low):
                stems[c] = (low, c[len(stem) :])
            else:
                rest.append(c)
        ask = list(plain.union([low for low, _ in stems.values()]).difference(known))
        known.update(zip(ask, self.runs_of_letters(ask), strict=True))
        more = list({last for _, last in stems.values()}.union(rest).difference(known))
        for at in range(0, len(more), TOGETHER):
            part = more[at : at + TOGETHER]
            known.update((c, _le(e.ids)) for c, e in zip(part, self.whole.encode_batch_fast(part, add_special_tokens=False), strict=True))
        for c, (low, last) in stems.items():
            known[c] = known[low] + known[last] if last else known[low]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and no rule of it reaches over a space or a line feed, so a text's ids are those
    of the chunks between them; a chunk is encoded once for as long as the worker's cache holds it.
    """
    if path not in _chunks:
        _chunks[path] = Chunks(path)
    chunks = _chunks[path]
    split = [t.replace("\n", " ").split(" ") for t in texts]
    if len(chunks.known) > CACHE_CHUNKS:
        chunks.known.clear()
    known = chunks.known
    long: list[str] = []

    def learn(new: set[str]) -> dict[str, bytes]:
        long.extend([c for c in new if len(c) > CHUNK_CHARS])
        chunks.learn(new)
        return known

    out = looked_up(split, known, learn)
    for c in long:
        del known[c]
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Each document's ids and then the separator, cut into pieces of `capacity` where it is longer.

    docs: doc_id and text; other columns are ignored. A null or empty text is the separator alone. Rows with the same
    doc_id are documents of their own.
    """
    small_batches(docs.sparkSession)
    end = separator.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        step = capacity * 4
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            with uncollected():
                encoded = encode_texts(batch.column(1).to_pylist(), tokenizer)
            for doc, ids in zip(batch.column(0).to_pylist(), encoded, strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for column, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, of counts: (length, first rank, rank after the last, pieces for each sequence, first sequence, offset).

    Sequences with equal room left stand as ranges (first, how many). Pieces of a length go to the range with the
    least room that takes them, as many into each sequence as fit, which is where best fit puts them one by one; new
    sequences are opened when no range has the room. The steps, and so the plan, are bounded by the lengths there are,
    not by the pieces.
    """
    room_left: dict[int, list[tuple[int, int]]] = {}
    opened, out = 0, []

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            room_left.setdefault(room, []).append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r in room_left if r >= length), default=0)
            if room:
                first, many = room_left[room].pop()
                if not room_left[room]:
                    del room_left[room]
            else:
                room, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            each = room // length
            take = min(left, many * each)
            full, rest = divmod(take, each)
            if full:
                out.append((length, rank, rank + full * each, each, first, capacity - room))
                put(room - each * length, first, full)
            if rest:
                out.append((length, rank + full * each, rank + take, rest, first + full, capacity - room))
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), many - full - bool(rest))
            rank, left = rank + take, left - take
    return out


PLAN = "length long, _from long, _to long, _each long, _sequence long, _offset long"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """Packs all documents' pieces into sequences of at most `capacity` tokens.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. The histogram has at
    most `capacity` rows and is all that the driver gets; the plan is bounded by it, so it may be broadcast. Pieces take
    the planned slots by their rank within their length, which gapless_rank() spreads over tasks however frequent a
    length is. Ties are cut by doc_id and piece. No documents: no rows.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, separator), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, capacity), PLAN)
    ranked = gapless_rank(cut, "length", ["doc_id", "piece"], "_rank")
    within = (ranked["length"] == slots["length"]) & (ranked["_rank"] >= slots["_from"]) & (ranked["_rank"] < slots["_to"])
    place = ranked["_rank"] - slots["_from"]
    return ranked.join(F.broadcast(slots), within).select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (slots["_sequence"] + F.floor(place / slots["_each"])).cast("long").alias("sequence_id"),
        (slots["_offset"] + place % slots["_each"] * ranked["length"]).cast("long").alias("offset"),
    )
