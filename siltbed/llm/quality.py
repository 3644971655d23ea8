"""Quality by co-training: a content view and a metadata view label confident documents for each other."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import forget, release, small_batches, written

#: Labelled rows that the views are fitted on at most, every FOLDth of which only calibrates.
LABELLED, FOLD = 20_000, 4
#: Rounds, documents that a view labels in a round for each class, and how sure it has to be.
ROUNDS, CONFIDENT, SURE = 3, 200, 0.95
#: A document is rejected when its combined probability of good quality is lower.
THRESHOLD = 0.5
SOURCES, LANGS = 16, 8
CONTENT, METADATA = 16, 4 + SOURCES + LANGS

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_LETTERS = np.flatnonzero(_LETTER).astype(np.uint8).tobytes()
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*|!@^~<>{}[]\\_=+"]] = True


def content(text: str) -> list[float]:
    """What a whole text looks like: shares of marks, capitals, digits, repeated words and lines."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * CONTENT
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    seen = max(1, int(counts.sum() - counts[32] - counts[9:14].sum()))
    distinct = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    marked = sum(v for c, v in ends.items() if _MARK[c])
    bare = sum(v for w, v in distinct.items() if len(w.translate(None, _LETTERS)) == len(w))
    return [
        marked / n,
        counts[_MARK].sum() / seen,
        counts[_UPPER].sum() / max(1, counts[_LETTER].sum()),
        counts[_DIGIT].sum() / seen,
        counts[_LETTER].sum() / seen,
        bare / n,
        len(distinct) / n,
        distinct.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        1 - len(set(lines)) / len(lines),
        min(seen / n, 40) / 40,
        ends[ord("!")] / n,
        ends[ord(".")] / n,
        ends[ord(",")] / n,
        min(n / len(lines), 200) / 200,
        np.log1p(n) / 12,
    ]


def metadata(lang: str | None, source: str | None, n_chars: int | None, lines: int) -> list[float]:
    """What is known of a page besides its words; a missing value has a place of its own among the hashed ones."""
    out = [0.0] * METADATA
    out[0] = np.log1p(max(0, n_chars or 0)) / 16
    out[1] = float(n_chars is None)
    out[2] = np.log1p(lines) / 10
    out[3] = min((n_chars or 0) / (lines + 1), 2000) / 2000
    out[4 + crc32((source or "").encode()) % SOURCES] = 1.0
    out[4 + SOURCES + crc32((lang or "").encode()) % LANGS] = 1.0
    return out


def views(docs: DataFrame) -> DataFrame:
    """doc_id, content and metadata of every whole text; a null text is as an empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        floats = pa.list_(pa.float64())
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            rest = zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), texts, strict=True)
            one = pa.array([np.asarray(content(t), dtype=np.float64) for t in texts], floats)
            two = pa.array([np.asarray(metadata(*x, t.count("\n")), dtype=np.float64) for *x, t in rest], floats)
            yield pa.RecordBatch.from_arrays([b.column(0), one, two], names=["doc_id", "content", "metadata"])

    cols = [F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long")]
    return docs.select(*cols).mapInArrow(run, "doc_id long, content array<double>, metadata array<double>")


class Logistic:
    """Ridge logistic regression on standardized columns, fitted by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(z.shape[1])
        pull = np.full(len(w), ridge)
        pull[0] = 1e-3
        for _ in range(30):
            p = _sigmoid(z @ w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.w[0] + ((x - self.mean) / self.scale) @ self.w[1:]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make a logit a calibrated one."""
    m = Logistic(logit[:, None], y, ridge=0.1)
    slope = max(0.0, float(m.w[1] / m.scale[0]))
    return slope, float(m.w[0] - slope * m.mean[0]) if slope else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))


class CoTrained:
    """Two calibrated views and how they combine; small enough to go to every task."""

    def __init__(self, models: list[Logistic], platt: list[tuple[float, float]], both: Logistic | None):
        self.models, self.platt, self.both = models, platt, both

    def scores(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [np.clip(s * m.logit(v) + o, -20, 20) for m, (s, o), v in zip(self.models, self.platt, (x, z), strict=True)]
        joint = self.both.logit(np.stack(logits, axis=1)) if self.both else logits[0] + logits[1]
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(joint)


def _scored(features: DataFrame, model: CoTrained) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            x, z = (np.array(b.column(i).to_pylist(), dtype=np.float64).reshape(b.num_rows, n) for i, n in ((1, CONTENT), (2, METADATA)))
            found = model.scores(x, z) if b.num_rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p, pa.float64()) for p in found)], names=[*b.schema.names, "p_content", "p_metadata", "p_quality"])

    return features.mapInArrow(run, "doc_id long, content array<double>, metadata array<double>, p_content double, p_metadata double, p_quality double")


def _fit(rows: list, taught: list[dict]) -> CoTrained:
    """rows: labelled (content, metadata, quality) in a fixed order; taught: for each view, doc_id -> (features, class)."""
    y = np.array([r["quality"] for r in rows], dtype=float)
    held = np.arange(len(rows)) % FOLD == 0
    models, platt = [], []
    for k, name in enumerate(("content", "metadata")):
        x = np.array([r[name] for r in rows], dtype=float)
        more = [taught[k][d] for d in sorted(taught[k])]
        fx = np.concatenate([x[~held], np.array([f for f, _ in more], dtype=float).reshape(-1, x.shape[1])])
        fy = np.concatenate([y[~held], [c for _, c in more]])
        models.append(Logistic(fx, fy))
        platt.append(_platt(models[k].logit(x[held]), y[held]))
    logits = [np.clip(s * m.logit(np.array([r[n] for r in rows], dtype=float)[held]) + o, -20, 20) for m, (s, o), n in zip(models, platt, ("content", "metadata"), strict=True)]
    return CoTrained(models, platt, Logistic(np.stack(logits, axis=1), y[held], ridge=0.1))


def _first(rows: DataFrame, order: list, n: int, *columns: str) -> list:
    """The first n rows, of which alone the driver hears: tasks send theirs to one another."""
    first = written(rows.orderBy(*order).limit(n).select(*columns), "first")
    out = first.collect()
    forget(first)
    return out


def fit(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, labelled: int = LABELLED) -> tuple[DataFrame, CoTrained | None]:
    """The views of all documents, and the model; None without labels of both classes."""
    features = written(views(docs), "views")
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    both = features.join(known, "doc_id").withColumn("_dice", F.xxhash64("doc_id"))
    n = both.count()
    if n > labelled:  # little more than what is asked for is ordered
        both = both.filter(F.col("_dice") < min((1 << 63) - 1, int((1.1 * labelled / n + 100 / n) * (1 << 64)) - (1 << 63)))
    rows = _first(both, ["_dice", "doc_id", "content", "metadata"], labelled, "_dice", "doc_id", "content", "metadata", "quality")
    rows.sort(key=lambda r: (r["_dice"], r["doc_id"], r["content"], r["metadata"]))
    split = Counter((n % FOLD == 0, r["quality"]) for n, r in enumerate(rows))
    if min(split[h, q] for h in (True, False) for q in (0, 1)) < 2:
        return features, None
    free = features.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left_anti")
    taught: list[dict] = [{}, {}]
    model = _fit(rows, taught)
    for _ in range(rounds):
        scored = written(_scored(free, model), "scored")
        for k, (view, other) in enumerate((("p_content", "metadata"), ("p_metadata", "content"))):
            fresh = scored.filter(~F.col("doc_id").isin(sorted(taught[1 - k]))) if taught[1 - k] else scored
            for quality, order, sure in ((1, F.desc(view), F.col(view) >= SURE), (0, F.asc(view), F.col(view) <= 1 - SURE)):
                for r in sorted(_first(fresh.filter(sure), [order, F.xxhash64("doc_id"), other], CONFIDENT, "doc_id", other)):
                    taught[1 - k].setdefault(r["doc_id"], (r[other], quality))
        forget(scored)
        model = _fit(rows, taught)
    return features, model


def score(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, labelled: int = LABELLED) -> DataFrame:
    """doc_id, p_content, p_metadata, p_quality and kept of every document.

    docs: doc_id, text, lang, source, n_chars, any of which may be null, other columns are ignored; labels: doc_id and
    quality (0 or 1; other values and nulls are ignored). The views are fitted on at most `labelled` labelled rows, taken by their id's hash. In each round both views score
    all documents that have no label; the CONFIDENT surest of each class that it has not taught yet, if the view is
    SURE of them, become labels for the other view. A FOLDth of the labelled rows is never fitted on: it calibrates each
    view and the weights of both. Without labels of both classes (two of each at least in each part) nothing can be
    learnt, and every document is kept with a probability of 1. Rows that repeat a doc_id each get the score of their
    own text. No documents: no rows.
    """
    features, model = fit(docs, labels, rounds, labelled)
    if model is None:
        sure = F.lit(1.0)
        return features.select("doc_id", sure.alias("p_content"), sure.alias("p_metadata"), sure.alias("p_quality"), F.lit(True).alias("kept"))
    return _scored(features, model).drop("content", "metadata").withColumn("kept", F.col("p_quality") >= THRESHOLD)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) without those that score() rejects; nulls, repeated rows and empty tables are as there.

    The fitted model is a few hundred numbers, so it goes to the documents where they are read, and no text is shuffled.
    """
    _, model = fit(docs, labels)
    types = "doc_id long, text string, lang string, source string, n_chars long"
    docs = docs.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in types.split(", "))])
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            x = np.array([content(t) for t in texts], dtype=np.float64).reshape(len(texts), CONTENT)
            rest = zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), texts, strict=True)
            z = np.array([metadata(*m, t.count("\n")) for *m, t in rest], dtype=np.float64).reshape(len(texts), METADATA)
            yield b.filter(pa.array(model.scores(x, z)[2] >= THRESHOLD) if len(texts) else pa.array([], pa.bool_()))

    return docs.mapInArrow(run, types)
