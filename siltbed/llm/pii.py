"""Personal data: regular expressions propose, checksums confirm, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import release, small_batches, text_or_empty

#: The kinds that always stay, in the order that breaks ties of start; then those that the score decides on.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
#: Characters before a span that are searched for context words, and the score from which a proposed span counts.
NEAR, ENOUGH = 48, 0.6

# A match never starts inside a run of its first class, since one from the run's start ends the same way. The
# look-behinds and possessive repeats say so, which keeps the search linear on long runs.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"\b(?:token|secret|api[_-]?key|password|passwd)\b\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9_/+-]{16,})", re.I)
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|contact|write to)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|credit|mastercard|payment)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|fax)\b", re.I),
    "iban": re.compile(r"\b(?:iban|bank|account|konto|cuenta|compte)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "secret": re.compile(r"\b(?:token|secret|key|password)\b", re.I),
}
#: What the pattern alone is worth, a checksum that holds, and a context word nearby.
_ALONE = {"email": 0.7, "ip": 0.6, "card": 0.2, "phone": 0.5, "iban": 0.2, "ssn": 0.3, "secret": 0.6}
_CHECKED, _NEARBY = 0.6, 0.3


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if n % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """ISO 7064: the first four characters moved to the end, letters as numbers from 10."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of the base kinds: leftmost and non-overlapping for each kind, failing ones dropped."""
    out = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            at = start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = m.end()
                out.append((start, 0, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return out


def added_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """Proposals of the kinds that the method adds: (start, place in KINDS, end, whether a checksum confirms it)."""
    out = []
    for m in _IBAN.finditer(text):
        if 15 <= len(raw := m[0].replace(" ", "")) <= 34 and mod_97(raw):
            out.append((m.start(), 4, m.end(), True))
    for m in _SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            out.append((m.start(), 5, m.end(), False))
    for m in _SECRET.finditer(text):
        out.append((m.start(1), 6, m.end(1), False))
    return out


def find(text: str) -> list[tuple[int, int, int, float]]:
    """(start, place in KINDS, end, score) by start, then kind. Base spans stay whatever their score is."""
    found = []
    for start, kind, end, checked in [*((*s, s[1] == 2) for s in base_spans(text)), *added_spans(text)]:
        name = KINDS[kind]
        near = bool(_CONTEXT[name].search(text, max(0, start - NEAR), start))
        score = min(1.0, _ALONE[name] + _CHECKED * checked + _NEARBY * near)
        if kind < len(BASE) or score >= ENOUGH:
            found.append((start, kind, end, score))
    found.sort()
    return found


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score; code points, end exclusive) of every whole text; null is empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redacted(text: str) -> str:
    """The text with each span's characters replaced by its kind in angle brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    for start, kind, end, _ in find(text):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with personal data masked and n_chars counted anew; a null text stays null."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            texts = [t if t is None else redacted(t) for t in b.column(1).to_pylist()]
            yield b.set_column(1, "text", pa.array(texts, pa.string())).set_column(4, "n_chars", pa.array([None if t is None else len(t) for t in texts], pa.int64()))

    types = "doc_id long, text string, lang string, source string, n_chars long"
    return docs.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in types.split(", "))]).mapInArrow(run, types)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
