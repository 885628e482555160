"""Phrase fingerprints against a parse with slices, and the order of documents against a sorted list."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from wedgeworks.llm import phrases

from .helpers import DOCS, documents, prose


def slow_phrases(text):
    out = set()
    for at in range(0, len(text), phrases.SEGMENT):
        piece, seen, start = text[at : at + phrases.SEGMENT], set(), 0
        for end in range(1, len(piece) + 1):
            if piece[start:end] not in seen:
                seen.add(piece[start:end])
                start = end
        out |= seen
    return out


def slow_signature(text):
    least = phrases.EMPTY
    for p in slow_phrases(text):
        least = np.minimum(least, (phrases.hashes(p, [len(p)])[0] * phrases._A + phrases._B)[:, 0])
    return phrases.mix(least.astype(np.uint64)).astype(">u2") if text else np.zeros(phrases.MINIMA, ">u2")


@pytest.mark.parametrize("segment", [1 << 20, 300, 7])
def test_signatures(monkeypatch, segment):
    monkeypatch.setattr(phrases, "SEGMENT", segment)
    rng = random.Random(1)
    texts = [prose(rng, 150).encode(), "é中a".encode() * 40, b"", b"a", b"ab", b"a" * 900, prose(rng, 9).encode()]
    for a in texts:
        assert (phrases.signature(a) == slow_signature(a)).all()
        own = phrases.Document(1, a)
        for b in texts:
            text, after = a.decode(), b.decode()
            n = len(text)
            end = text[: n - n // 2] + after[: n // 2]
            row = own.row(phrases.Document(2, b), 1)
            assert row[1] == n and [x.hex() for x in row[2:5]] == [hashlib.sha256(end.encode()).hexdigest(), phrases.fingerprint(a), phrases.fingerprint(end.encode())]
            assert row[5] == phrases.likeness(slow_signature(a), slow_signature(end.encode())) and row[6] == phrases.likeness(slow_signature(a), slow_signature(b))


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    errors = []
    for _ in range(30):
        a, b = prose(rng, 200), prose(rng, 200)
        b = a[: rng.randrange(len(a))] + b
        one, two = slow_phrases(a.encode()), slow_phrases(b.encode())
        errors.append(phrases.likeness(phrases.signature(a.encode()), phrases.signature(b.encode())) - len(one & two) / len(one | two))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert phrases.likeness(phrases.signature(b""), phrases.signature(b"")) == 1
    assert phrases.likeness(phrases.signature(b""), phrases.signature(b"x")) == 0


def wanted(rows):
    key = lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest())
    rows = sorted(rows, key=key)
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(text)
        end = (text[: n - n // 2] + after[: n // 2]).encode()
        mine, other = phrases.signature(text.encode()), phrases.signature(end)
        out.append((i, n, hashlib.sha256(end).hexdigest(), mine.tobytes().hex(), other.tobytes().hex(), phrases.likeness(mine, other), phrases.likeness(mine, phrases.signature(after.encode()))))
    return Counter(out)


@pytest.mark.parametrize("case", ["all", "one", "two", "same", "nulls"])
def test_edited(spark, monkeypatch, case):
    monkeypatch.setattr(phrases, "SPREAD", 7)
    rng = random.Random(3)
    every = [(r[0], r[1]) for r in documents(4)]
    rows = {
        "all": [*every, *[(3, every[3][1])] * 40, (3, "other"), (3, None), (-(2**40), "far"), (2**60, "high")],
        "one": [(5, "only one")],
        "two": [(5, "first of two"), (9, "second")],
        "same": [(5, "the same row")] * 30,
        "nulls": [(None, None)] * 3 + [(None, prose(rng, 20)) for _ in range(9)],
    }[case]
    docs = spark.createDataFrame([(*r, "en", None, 0, 3, True) for r in rows], DOCS + ", times int, first boolean").repartition(3)
    got = Counter(tuple(r) for r in phrases.edited(docs).collect())
    assert got == wanted(rows)


def test_nothing(spark):
    assert phrases.edited(spark.createDataFrame([], DOCS)).count() == 0
