"""Byte-level BPE against the tiktoken library, packing against the tokenizers library."""

import base64
import collections
import gc
import hashlib
import random
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from siltbed.llm import byte_bpe, packing
from siltbed.llm.queries import op6_byte_bpe, op9_packing

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, piece string, ids string, _rank int, length string"
ODD = [
    None, "", " ", "\n\n", "a", "aaaaaaaaaaaaaaaaaaaaa", "ab" * 3000, "x" * 20000, "Ünïcödé 日本語 текст 🙂🙂", "it's we'll  they've\t\tend ",
    "<|endoftext|> and <|startoftext|>", "é ́x a b c\x1cd\x85e", "the the the", "the the the", "ΑΣ ΣΑΣ. İi", "1234567 89,000.00 $$$$", "  lead and trail  \r\n",
]


def odd(spark):
    rows = [(n if n else None, t, "p", "i", 3, "l") for n, t in enumerate(ODD)] + [(3, ODD[3], "p", "i", 3, "l")]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def le(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def test_replay_is_the_library(library):
    v = byte_bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("abcde thein,.12'sé日\n ", k=rng.randrange(1, 300))) for _ in range(800)]
    for text, ids in zip(texts, byte_bpe.encode_texts(texts, v), strict=True):
        assert ids == le(library.encode_ordinary(text)), text


def test_a_lower_rank_that_a_merge_makes_goes_first(library):
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 300, b"bc": 301, b"abca": 302, b"bcbc": 303}
    v = object.__new__(byte_bpe.Vocabulary)
    v.ranks = ranks
    v.pairs = {(ranks[t[:i]], ranks[t[i:]]): n for t, n in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    own = tiktoken.Encoding("x", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 30))) for _ in range(500)]
    assert byte_bpe.replay([w.encode() for w in words], v) == [own.encode_ordinary(w) for w in words]


def test_op6(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op6_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(le(ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_odd_rows(spark):
    both = byte_bpe.decode(byte_bpe.encode(odd(spark), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert collections.Counter(bytes(r["decoded"]).decode() for r in both) == collections.Counter([t or "" for t in ODD] + [ODD[3]])
    assert byte_bpe.encode(odd(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def held(texts, rows, capacity):
    """Checks rows of pack() against the library; texts: (doc_id, text)."""
    whole = Tokenizer.from_file(WORDS)
    want = collections.Counter()
    for doc, text in texts:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[doc, k, at, len(part), zlib.crc32(le(part))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(n for *_, n, _ in want.elements()) // capacity)


def test_op9(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = held(texts, op9_packing(spark, sf).collect(), 2048)
    assert used <= least + 1


def test_packing_odd_rows(spark):
    held([(n if n else None, t) for n, t in enumerate(ODD)] + [(3, ODD[3])], packing.pack(odd(spark), WORDS, 16).collect(), 16)
    assert packing.pack(odd(spark).limit(0), WORDS).count() == 0


def test_one_length_for_all(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'the same words again' AS text")
    used, least = held([(n, "the same words again") for n in range(5000)], packing.pack(docs, WORDS, 64).collect(), 64)
    assert used == -(-5000 // (64 // 5)) and least <= used


def test_the_plan_fills_ranks_once():
    rng = random.Random(3)
    for _ in range(50):
        lengths = {rng.randrange(1, 65): rng.randrange(1, 400) for _ in range(rng.randrange(1, 20))}
        used = collections.Counter()
        for length, lo, hi, each, first, offset in packing.plan(lengths, 64):
            for rank in range(lo, hi):
                lengths_at = (first + (rank - lo) // each, offset + (rank - lo) % each * length, length)
                used[lengths_at] += 1
        assert max(used.values()) == 1
        assert collections.Counter(n for *_, n in used) == lengths
        rooms = collections.defaultdict(int)
        for seq, _, n in used:
            rooms[seq] += n
        assert max(rooms.values()) <= 64


def test_marks_after_letters_are_looked_up_once():
    texts = [a + b for a in ("word", "Écrit", "e\u0301", "İx", "ΣΑΣ", "日本", "x1", "don't", "<|endoftext|>") for b in ("%%%", ".***", "$", ",.", "?!'s", "###.")]
    whole = Tokenizer.from_file(WORDS)
    assert packing.encode_texts(texts, WORDS) == [le(whole.encode(t, add_special_tokens=False).ids) for t in texts]
    chunks, asked = packing.Chunks(WORDS), []
    real = chunks.whole

    class Counted:
        def encode_batch_fast(self, part, **how):
            asked.extend(part)
            return real.encode_batch_fast(part, **how)

    chunks.whole = Counted()
    chunks.learn({f"{w}%%%" for w in ("some", "Other", "words")})
    assert asked == ["%%%"]


def test_pairs_of_bytes_are_found_together(library):
    v = byte_bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    asked = 0

    class Counted(dict):
        def get(self, *a):
            nonlocal asked
            asked += 1
            return super().get(*a)

    byte_bpe.replay([b"warm"], v)
    v.pairs = Counted(v.pairs)
    words = [b"thershndx", "größerenthe".encode(), b""]
    assert byte_bpe.replay(words, v) == [library.encode_ordinary(w.decode()) if w else [] for w in words]
    assert asked < sum(map(len, words)) * 2


@pytest.mark.parametrize("module", [packing, byte_bpe])
def test_a_word_of_the_cache_is_looked_up_once(module):
    asked = []

    class Counted(dict):
        def get(self, k, *a):
            asked.append(k)
            return super().get(k, *a)

        def __getitem__(self, k):
            asked.append(k)
            return super().__getitem__(k)

        def __contains__(self, k):
            asked.append(k)
            return super().__contains__(k)

    texts = ["the same words the same words", "", "more of the same"]
    if module is packing:
        packing.encode_texts(texts, WORDS)
        own, encode = packing._chunks[WORDS], lambda: packing.encode_texts(texts, WORDS)
    else:
        own = byte_bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
        encode = lambda: byte_bpe.encode_texts(texts, own)
    want = encode()
    own.known = Counted(own.known)
    asked.clear()
    assert encode() == want
    assert len(asked) <= sum(len(t.split()) for t in texts) + 1


@pytest.mark.parametrize("module", [packing, byte_bpe])
def test_encoding_looks_for_no_cycles(spark, monkeypatch, module):
    """A worker's encoding runs with the collector off, and leaves it on."""
    seen, real = [], module.encode_texts
    monkeypatch.setattr(module, "encode_texts", lambda *a: seen.append(gc.isenabled()) or real(*a))

    docs, ran = spark.createDataFrame([(1, "some text")], "doc_id long, text string"), []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: ran.append(f))
    if module is packing:
        packing.pieces(docs, WORDS)
    else:
        byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert list(ran[0](iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["some text"])], names=["doc_id", "text"])])))
    assert seen == [False] and gc.isenabled()
