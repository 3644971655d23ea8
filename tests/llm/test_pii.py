"""Personal data against the plain patterns."""

import hashlib
import random
import re
import time

from siltbed.llm import pii
from siltbed.llm.queries import op7_pii


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(s):
    d = digits(s)[::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(m)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}


def plain(text):
    found = []
    for n, (kind, (pattern, good)) in enumerate(PLAIN.items()):
        found += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if good(m[0])]
    return [x for *_, x in sorted(found)]


def test_base_spans_are_the_plain_ones():
    rng = random.Random(4)
    for _ in range(6000):
        text = "".join(rng.choices("0123456789.@+- ()aZ%é_", weights=[3] * 10 + [6, 4, 3, 3, 3, 1, 1, 3, 2, 1, 1, 1], k=rng.randrange(60)))
        got = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(pii.base_spans(text))]
        assert got == plain(text), text


def test_op7(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x.startswith(k) for x in want) for k in PLAIN]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_added_kinds_need_their_checks():
    kinds = lambda t: [pii.KINDS[k] for _, k, _, _ in pii.find(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00.") == []
    assert kinds("his ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == ["secret"]
    near, far = pii.find("my card 4012888888881881")[0], pii.find("4012888888881881")[0]
    assert near[3] > far[3]


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "é a@b.co"), (2, "é a@b.co"), (3, "9" * 200_000), (4, "a" * 200_000 + "@"), (5, "+" + "1 " * 100_000), (6, "1.1." * 50_000)]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, spans string, kind int")
    began = time.time()
    got = pii.find_pii(docs).collect()
    assert time.time() - began < 30
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got)[:4] == [(0, 0), (1, 0), (2, 1), (2, 1)]
    assert [tuple(s)[:3] for r in got if r["doc_id"] == 2 for s in r["spans"]] == [("email", 2, 8)] * 2
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_redacted():
    assert pii.redacted("write to a.b@c.org or +1 (743) 555-3824") == "write to <email> or <phone>"
    assert pii.redacted("nothing here") == "nothing here"


def test_long_secret_is_masked_whole():
    for n in (16, 256, 257, 5000):
        key = ("aB3_" * n)[:n]
        text = f"token = {key} end"
        assert [(s, e) for s, k, e, _ in pii.find(text) if pii.KINDS[k] == "secret"] == [(8, 8 + n)]
        assert pii.redacted(text) == "token = <secret> end"
