"""Repeated passages against all runs of fifty words compared."""

import collections
import random

import numpy as np

from siltbed.llm import substring_dedup
from siltbed.llm.queries import op2_substring_dedup


def verbatim(texts, n=50):
    """doc -> words that lie in a run of n words which an earlier document has; and all documents that share a run."""
    words = {d: (t or "").encode().lower().split() for d, t in texts}
    holders = collections.defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            holders[tuple(w[i : i + n])].add(d)
    need, sharing = collections.defaultdict(set), set()
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            docs = holders[tuple(w[i : i + n])]
            if len(docs) > 1:
                sharing.add(d)
                if d != min(docs):
                    need[d].update(range(i, i + n))
    return need, sharing


def covered(rows):
    got = collections.defaultdict(set)
    for r in rows:
        got[r["doc_id"]].update(range(r["start"], r["end"]))
    return got


def test_op2(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op2_substring_dedup(spark, sf).collect()
    need, _ = verbatim(texts)
    got = covered(rows)
    assert all(need[d] <= got[d] for d in need)
    words = {d: (t or "").encode().lower().split() for d, t in texts}
    for r in rows:
        one, two = words[r["doc_id"]][r["start"] : r["end"]], words[r["source_id"]][r["source_start"] : r["source_end"]]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
        assert r["source_id"] < r["doc_id"] and len(one) == r["end"] - r["start"] >= 50
        assert abs(len(a & b) / len(a | b) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8


def test_planted_passages(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    hot, short, pair = text(60), text(30), text(80)
    near = list(pair)
    for i in (5, 60):
        near[i] = "other"
    texts = [(d, " ".join(text(60) + (hot if d % 2 else short) + text(60))) for d in range(200)]
    texts += [(300, " ".join(text(40) + pair + text(70))), (301, " ".join(text(90) + near + text(20))), (302, " ".join(text(200)))]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(d, t, 1, 2, "k") for d, t in texts], "doc_id long, text string, a int, b int, key string")).collect()
    got = covered(rows)
    assert set(got) == {d for d in range(3, 200, 2)} | {301}
    assert all(got[d] == set(range(60, 120)) for d in range(3, 200, 2))
    assert set(range(96, 150)) <= got[301] <= set(range(90, 170))
    assert len(rows) < 2 * len(got) + 10


def test_compact_windows_hold_each_subsequence_once():
    rng = np.random.default_rng(2)
    for high in (4, 1 << 60):
        values = rng.integers(0, high, 60, dtype=np.uint64)
        windows = substring_dedup.compact_windows(values, 7)
        for i in range(60):
            for j in range(i + 6, 60):
                inside = [c for left, c, r in windows if left <= i <= c <= j <= r]
                assert len(inside) == 1 and values[inside[0]] == values[i : j + 1].min()


def test_odd_rows(spark):
    once = " ".join(f"v{i}" for i in range(70))
    texts = [(None, once), (1, None), (2, ""), (3, "short text"), (4, once), (5, once), (5, once), (6, "x y " * 30_000), (7, "x y " * 30_001), (8, "a " + once.replace(" ", "\n") + " b"), *((n, once) for n in range(20, 80))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "w") for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long, anchors string")
    rows = substring_dedup.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["source_id"]) for r in rows} == {(5, 4), (8, 4), (7, 6)} | {(n, 4) for n in range(20, 80)}
    out = substring_dedup.remove_repeated(docs).collect()
    assert len(out) == len(texts)
    left = collections.defaultdict(list)
    for r in out:
        left[r["doc_id"]].append(r["text"])
    assert left[8] == ["a  b"] and left[4] == [once] and left[5] == ["", ""] and left[1] == [None] and left[None] == [once] and left[20] == [""]
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0 == substring_dedup.remove_repeated(docs.limit(0)).count()


def test_without():
    assert substring_dedup.without(" a b\tc d ", [(1, 3)]) == "a  d"
    assert substring_dedup.without("a b c", [(0, 2), (1, 3)]) == ""
    assert substring_dedup.without("a b c", [(2, 9), (7, 8)]) == "a b"


def test_one_changed_word_anywhere():
    rng = np.random.default_rng(5)
    for n in range(50, 101, 5):
        for at in range(n):
            a, b, passage = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (70, 90, n))
            near = passage.copy()
            near[at] = 1
            one, two = (substring_dedup.shingled(np.concatenate([x[:40], y, x[40:]]), 5) for x, y in ((a, passage), (b, near)))
            anchors = np.array([(h, 0, len(one) - 1, 0, len(two) - 1) for h in (0, 1)])
            got = substring_dedup.matched(one, two, anchors, 46, 80)
            assert all(e - s >= 46 and like >= 0.8 for s, e, _, _, like in got)
            words = {w for s, e, *_ in got for w in range(s - 40, e + 4 - 40)}
            assert set(range(at + 1 if at < 5 else 0, at if at >= n - 5 else n)) <= words <= set(range(-9, n + 9)), (n, at)


def test_source_that_repeats_its_passage(spark):
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, want = [], {}
    for n, times in enumerate((20, 100) * 10):
        passage = text(60)
        texts += [(n, " ".join(w for _ in range(times) for w in passage)), (n + 100, " ".join(text(70) + passage + text(70)))]
        want[n + 100] = set(range(70, 130))
    got = covered(substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert all(want[d] <= got[d] for d in want)


def test_passages_whose_words_other_documents_hold_in_pieces(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    texts, want = [], {}
    for n in range(20):
        passage = text(60)
        pieces = [passage[k : k + 5] for k in range(56)]
        for decoy in range(2):
            rng.shuffle(pieces)
            texts.append((1000 * decoy + n, " ".join(w for p in pieces for w in [*p, *text(2)])))
        texts += [(2000 + n, " ".join(text(50) + passage + text(50))), (3000 + n, " ".join(text(50) + passage + text(50)))]
        want[3000 + n] = set(range(50, 110))
    got = covered(substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert all(want[d] <= got[d] for d in want) and set(got) == set(want)


def test_near_passages_are_found(spark):
    """Of passages alike to 0.8 to 0.95, over nine tenths."""
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    texts, near = [], []
    for n in range(300):
        passage = text(rng.choice((60, 90, 140, 200)))
        other = list(passage)
        for at in rng.sample(range(len(passage)), max(1, len(passage) // 50)):
            other[at] = f"x{n}"
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (passage, other))
        texts += [(n, " ".join(text(40) + passage + text(40))), (n + 1000, " ".join(text(70) + other + text(20)))]
        if len(a & b) >= 0.8 * len(a | b):
            near.append((n + 1000, len(passage)))
    got = covered(substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert len(near) > 200 and sum(len(got[d] & set(range(70, 70 + n))) >= 0.8 * n for d, n in near) >= 0.95 * len(near)


def test_passages_under_a_line_that_many_documents_hold(spark, monkeypatch):
    """The line alone is no passage; what a few documents have of it and beyond is found, whichever come first."""
    monkeypatch.setattr(substring_dedup, "TILE", 16)
    rng = random.Random(13)
    text = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    line, texts, want = text(40), [], {}
    for n in range(120):
        texts.append((n, " ".join(text(60) + line + text(60))))
    for n in range(10):
        more = text(20)
        texts += [(200 + n, " ".join(text(60) + line + more + text(60))), (300 + n, " ".join(text(60) + line + more + text(60)))]
        want[300 + n] = set(range(60, 120))
    got = covered(substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert all(want[d] <= got[d] for d in want) and set(got) == set(want)


def test_sentences_in_another_order():
    rng = np.random.default_rng(8)
    for swap in (20, 30, 40):
        passage = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        one, two = (substring_dedup.shingled(np.concatenate([rng.integers(0, 1 << 63, 30, dtype=np.uint64), x, rng.integers(0, 1 << 63, 30, dtype=np.uint64)]), 5) for x in (passage, np.concatenate([passage[swap:], passage[:swap]])))
        got = substring_dedup.matched(one, two, np.array([(0, 0, len(one) - 1, 0, len(two) - 1)]), 46, 80)
        assert {w for s, e, *_ in got for w in range(s, e)} >= set(range(31, 113))


def test_a_text_of_few_lines_is_held_against_its_source_in_few_steps(monkeypatch):
    """A source's lines again and again, in any order, with words between: thousands of runs, and no passage."""
    rng = np.random.default_rng(21)
    lines = [rng.integers(0, 1 << 63, 9, dtype=np.uint64) for _ in range(12)]
    source = np.concatenate([np.concatenate([x, rng.integers(0, 1 << 63, 6, dtype=np.uint64)]) for x in lines])
    text = np.concatenate([np.concatenate([lines[k], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]) for k in rng.integers(0, 12, 2000)])
    asked, real = [], substring_dedup._alikeness

    def counted(one, two):
        made = real(one, two)
        alike, *rest = made if isinstance(made, tuple) else (made,)
        count = lambda *at: asked.append(at) or alike(*at)
        return (count, *rest) if rest else count

    monkeypatch.setattr(substring_dedup, "_alikeness", counted)
    one, two = (substring_dedup.shingled(x, 5) for x in (source, text))
    assert not substring_dedup.stretches(one, two, 46, 80)
    assert len(asked) < 5000


def test_small_buckets_are_compared_together(spark, monkeypatch):
    """Lines that two documents each share, and no passage: one task takes many of their keys."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    rng = random.Random(17)
    text = lambda n: [f"w{rng.randrange(90000)}" for _ in range(n)]
    texts, cells, real = [], [], PandasGroupedOpsMixin.applyInArrow

    def seen(self, func, schema):
        cells.append(self.count().count())
        return real(self, func, schema)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInArrow", seen)
    for n in range(200):
        line = text(40)
        texts += [(n, " ".join(text(60) + line + text(60))), (n + 500, " ".join(text(60) + line + text(60)))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert not got
    assert cells and cells[0] <= 4


def _dealt_lines(rng, lines: int, size: int, between: int):
    """Shingles of a source of lines, and of a text of the same lines in another order with new words between."""
    own = [rng.integers(0, 1 << 63, size, dtype=np.uint64) for _ in range(lines)]
    new = lambda: rng.integers(0, 1 << 63, between, dtype=np.uint64)
    return [substring_dedup.shingled(np.concatenate([x for k in order for x in (own[k], new())]), 5) for order in (np.arange(lines), rng.permutation(lines))]


def test_lines_in_another_order_are_not_filled_up_one_by_one(monkeypatch):
    """Nearly all of the text stands in the source, but beside no line what stands beside it there."""
    one, two = _dealt_lines(np.random.default_rng(5), 150, 40, 1)
    asked, real = [], substring_dedup._alikeness

    def counted(*texts):
        alike, *rest = real(*texts)
        return (lambda *at: asked.append(at) or alike(*at), *rest)

    monkeypatch.setattr(substring_dedup, "_alikeness", counted)
    substring_dedup.stretches(one, two, 46, 80)
    filled_up = [at for at in asked if min(at[1] - at[0], at[3] - at[2]) == 46]
    assert len(filled_up) < 150


def test_stretches_are_the_same_however_many_are_looked_at_together(monkeypatch):
    rng = np.random.default_rng(6)
    found = 0
    for n in range(60):
        one, two = _dealt_lines(rng, 12, int(rng.integers(8, 60)), int(rng.integers(0, 4)))
        if n % 2:
            two = np.concatenate([two, one[100:300], two[:50], one[120:200]])
            two = np.where(rng.random(len(two)) < 0.02, rng.integers(0, 1 << 63, len(two), dtype=np.uint64), two)
        together = substring_dedup.stretches(one, two, 46, 80)
        with monkeypatch.context() as m:
            m.setattr(substring_dedup, "FEW", 1 << 30)
            m.setattr(substring_dedup, "CELLS", 1)
            assert together == substring_dedup.stretches(one, two, 46, 80)
        found += len(together)
    assert found > 60


def test_texts_that_can_hold_no_alike_stretch_are_not_searched(monkeypatch):
    """A few shingles again and again, among as many that the source hasn't got: no stretch of them is compared."""
    rng = np.random.default_rng(7)
    known, other = rng.integers(0, 1 << 63, 40, dtype=np.uint64), rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    one = rng.choice(known, 130)
    two = np.where(rng.random(1500) < 0.4, rng.choice(known, 1500), rng.choice(other, 1500))
    asked, real = [], substring_dedup._alikeness

    def counted(*texts):
        alike, at_most, *rest = real(*texts)
        return (lambda *at: asked.append(at) or alike(*at), lambda *at: asked.append(at) or at_most(*at), *rest)

    monkeypatch.setattr(substring_dedup, "_alikeness", counted)
    assert not substring_dedup.stretches(one, two, 46, 80)
    assert not asked


def test_stretches_are_the_same_if_every_run_may_begin_one(monkeypatch):
    rng = np.random.default_rng(8)
    found = 0
    for n in range(200):
        few = rng.integers(0, 1 << 63, int(rng.integers(20, 400)), dtype=np.uint64)
        one = rng.choice(few, 150) if n % 2 else few
        two = np.concatenate([one[int(rng.integers(0, 60)) :], rng.choice(few, 80), one[:70]])
        two = np.where(rng.random(len(two)) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 1 << 63, len(two), dtype=np.uint64), two)
        if n % 3 == 0:
            two = np.concatenate([two, rng.choice(two, 200)])
        some = substring_dedup.stretches(one, two, 46, 80)
        with monkeypatch.context() as m:
            m.setattr(substring_dedup, "_hopeful", lambda stands, *rest: np.ones(len(stands), dtype=bool))
            assert some == substring_dedup.stretches(one, two, 46, 80)
        found += len(some)
    assert found > 60


def test_most_hits_of_each_size():
    rng = np.random.default_rng(9)
    width = 5
    sizes = [(int(a), int(b)) for a, b in rng.integers(0, width, (40, 2))]  # places to the left and right of the middle
    begin, middle = np.cumsum([0] + [a + 1 + b for a, b in sizes]), np.array([a for a, _ in sizes])
    bit, table = rng.integers(0, 16, begin[-1]), rng.random((40, 16)) < 0.6
    one, other = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    got = substring_dedup.most_hits(begin, middle, table, bit, one, other, width)
    for k, (x, y) in enumerate(zip(one.tolist(), other.tolist(), strict=True)):
        hits, c = table[y, bit[begin[x] : begin[x + 1]]], middle[x]
        for n in range(width, 2 * width):
            want = [int(hits[i:j].sum()) for i in range(c + 1) for j in range(c + 1, len(hits) + 1) if width <= j - i <= n]
            assert got[n - width, k] == max(want) if want else got[n - width, k] < 0
