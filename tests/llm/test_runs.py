"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from wedgeworks.llm import runs

from .helpers import DOCS, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def slow_runs(words, exponent=4, least=6):
    """Maximal stretches of every period, those with a shorter one left out."""
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(least, exponent * p):
                stretch = words[i - p : j]
                if not any(all(stretch[k] == stretch[k - q] for k in range(q, len(stretch))) for q in range(1, p)):
                    out.append((i - p, j - i + p, p))
            i = j + 1
    return sorted(out)


def sequence(rng):
    words = [b"abcdefgh"[c : c + 1] for c in (rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 50)))]
    for _ in range(rng.randint(0, 2)):
        if words:
            a, p = rng.randrange(len(words)), rng.randint(1, 9)
            piece = words[a : a + p]
            words = words[:a] + piece * rng.randint(1, 7) + words[a : a + rng.randint(0, 30)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(100):
        words = sequence(rng)
        numbers = {}
        ids = [numbers.setdefault(w, len(numbers)) for w in words]
        for exponent, least in ((4, 6), (3, 3), (2, 2)):
            want = slow_runs(words, exponent, least)
            assert runs.find_runs(words, exponent, least) == want
            catcher, at = runs.SquareCatcher(exponent), 0
            while at < len(ids):
                step = rng.choice([1, 1, 2, 9])
                catcher.append(np.array(ids[at : at + step]))
                at += step
            assert catcher.runs(least) == want


def test_online():
    """After every word, what is known equals the runs of the words so far."""
    rng = random.Random(8)
    words = [b"abc"[c : c + 1] for c in (rng.randrange(3) for _ in range(30))] + [b"x", b"y", b"z"] * 6 + [b"x", b"q"]
    catcher = runs.SquareCatcher(2)
    for n, w in enumerate(words, 1):
        catcher.append(np.array([w[0]]))
        assert catcher.runs(2) == slow_runs(words[:n], 2, 2)


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 64)
    rng = random.Random(9)
    words = [str(rng.randrange(50)).encode() for _ in range(300)]
    words = words + words[20:170] * 4 + [b"one"] * 700 + words
    assert runs.find_runs(words) == slow_runs(words) and len(runs.find_runs(words)) == 2


def test_query_rules(spark):
    rng = random.Random(10)
    rewritten = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = {i: prose(rng, rng.choice([0, 1, 2, 5, 30, 200])) for i in rewritten[:40]}
    texts |= {i: " ".join(w.decode() or "w" for w in sequence(rng)) for i in range(5000, 5040)}
    texts |= {6000: None, 6001: "", 6002: " \t\n", 6003: "ab  ab\tab\nab\x0bab\x0cab c", 6004: "é è " * 9, 6005: "tie tie tie tie tie tie x y y y y y y"}
    rows = [(i, t, "en", None, 0, 7, "s") for i, t in texts.items()]
    rows += [rows[0], (None, "a a a a a a a a", None, None, 0, 1, "s"), (None, None, None, None, None, 1, "s")]
    docs = spark.createDataFrame(rows, DOCS + ", start int, runs string").repartition(3)
    got = runs.periodic_runs(docs, reword=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert [tuple(x) for x in r["runs"]] in ([(0, 8, 1)], [])
            continue
        words = WORD.findall((texts[r["doc_id"]] or "").encode())
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        want = slow_runs(words)
        assert r["n_words"] == n and [tuple(x) for x in r["runs"]] == want
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (None if r["best"] is None else want[r["best"]]) == best
        gone = {i for a, m, p in want for i in range(a + p, a + m)}
        assert bytes(r["collapsed"]) == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    text = "b a a a a a a a c " + "p q r " * 5 + "end"
    spark.createDataFrame([(1, text), (2, "none here")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert zlib.crc32(b"1") % 10 and zlib.crc32(b"2") % 10
    got = {r["doc_id"]: r.asDict() for r in runs.op12_dyadic_runs(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1] == {"doc_id": 1, "n_runs": 2, "start": 1, "length": 7, "period": 1, "exponent_milli": 7000, "runs_sha256": sha("1,7,1\n9,15,3\n"), "collapsed_sha256": sha("b a c p q r end")}
    assert got[2] == {"doc_id": 2, "n_runs": 0, "start": None, "length": None, "period": None, "exponent_milli": None, "runs_sha256": sha(""), "collapsed_sha256": sha("none here")}
