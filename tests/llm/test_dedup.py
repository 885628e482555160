"""Operators that find copies: suffix arrays, chunks, MinHash."""

import random

import numpy as np
import pytest

from wedgeworks.llm import chunking, components, minhash, substrings, words
from wedgeworks.llm.suffix_array import suffix_array

from .helpers import DOCS, documents, near_groups, prose, without_repeats


@pytest.mark.parametrize("letters", [1, 2, 4])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(300):
        text = [rng.randrange(letters) for _ in range(rng.randrange(40))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", id string, key int").repartition(3)


def test_substrings_match_brute_force(spark, monkeypatch):
    rows = documents()
    runs = without_repeats([r[1] for r in rows], substrings.LENGTH)
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), str(x)) for r, x in zip(rows, runs, strict=True))
    assert sum(map(len, runs)) > 10
    for hot in (substrings.HOT, 1):  # 1: all contexts go the way of very frequent ones
        monkeypatch.setattr(substrings, "HOT", hot)
        got = substrings.remove_repeats(frame(spark, rows)).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], str([[s["start"], s["end"]] for s in r["spans"]])) for r in got) == want


@pytest.mark.parametrize("module", [substrings, chunking])
def test_lists_do_not_grow_with_repeated_rows(spark, monkeypatch, module):
    rng = random.Random(4)
    row = prose(rng, 500)
    others = [(i, f"{prose(rng, 60)} {row[300:1500]} {prose(rng, 60)}", "en", "src0", 0) for i in range(1, 6)]
    keep, longest = module.stored, {}

    def stored(df, name):
        out = keep(df, name)
        lists = [f.name for f in out.schema if f.dataType.typeName() == "array"]
        if lists:
            longest[name] = out.selectExpr(f"max(size({lists[0]}))").first()[0]
        return out

    monkeypatch.setattr(module, "stored", stored)
    run = module.remove_repeats if module is substrings else module.remove_repeated_chunks
    met = []
    for times in (2, 5000):
        for i in (0, None):  # a null id that repeats counts as one, too
            longest.clear()
            got = run(frame(spark, [*others, *[(i, row, "en", "src0", 0)] * times])).selectExpr("doc_id", "to_json(spans) spans").groupBy("doc_id", "spans").count().collect()
            assert sorted(r["count"] for r in got) == [1, 1, 1, 1, 1, times]
            met.append(({k: v for k, v in longest.items()}, sorted((r["doc_id"] or 0, r["spans"]) for r in got)))
    assert met[0] == met[2] and met[1] == met[3]
    assert max(met[0][0].values()) > 10 and met[0][1][1][1] != "[]"


def test_substrings_without_rows(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def slow_cuts(text):
    table, n = chunking._TABLE, len(text)
    x = [sum(int(table[text[i - j]]) << j for j in range(min(chunking.GEAR, i + 1))) % 2**32 for i in range(n)]
    reach = chunking.REACH
    ends = [i + 1 for i in range(reach, n - 1 - reach) if x[i] > max([0, *x[max(0, i - reach) : i]]) and x[i] >= max(x[i + 1 : i + 1 + reach])]
    return [*ends, n] if n else []


def test_cuts():
    rng = random.Random(1)
    for n in (0, 1, 16, 17, 49, 300, 1200):
        text = bytes(rng.choice(b"abc de") for _ in range(n))
        assert chunking.cuts(np.frombuffer(text, np.uint8)).tolist() == slow_cuts(text)
    assert chunking.cuts(np.frombuffer(b"x" * 9000, np.uint8)).max() == 9000
    assert np.diff(chunking.cuts(np.frombuffer(b"x" * 9000, np.uint8))).max() <= chunking.LONGEST


def test_cuts_resist_insertions():
    text = prose(random.Random(2), 500).encode()
    moved = text[:700] + b"inserted" + text[700:]
    pieces = [{t[a:b] for a, b in zip([0, *e[:-1]], e, strict=True)} for t, e in ((t, chunking.cuts(np.frombuffer(t, np.uint8)).tolist()) for t in (text, moved))]
    assert len(pieces[0] - pieces[1]) <= 4


def test_chunks_match_brute_force(spark):
    rows = [r for r in documents() if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    first, want = {}, {}
    for i, text, *_ in sorted(rows):
        t, a = (text or "").encode(), 0
        for b in chunking.cuts(np.frombuffer(t, np.uint8)).tolist():
            first.setdefault(t[a:b], (i, a))
            a = b
    for i, text, *_ in rows:
        t, a, spans = (text or "").encode(), 0, []
        for b in chunking.cuts(np.frombuffer(t, np.uint8)).tolist():
            if first[t[a:b]] != (i, a):
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            a = b
        want[i] = spans
    got = {r["doc_id"]: [[s["start"], s["end"]] for s in r["spans"]] for r in chunking.remove_repeated_chunks(frame(spark, rows)).collect()}
    assert got == want
    assert sum(map(len, want.values())) > 10


def test_chunks_with_null_ids_and_repeated_rows(spark):
    got = chunking.remove_repeated_chunks(frame(spark, documents())).collect()
    assert len(got) == len(documents())
    assert chunking.remove_repeated_chunks(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_minhash_matches_brute_force(spark, size, percent):
    rows = documents(size)
    want = near_groups(rows, size, percent)
    got = minhash.near_duplicates(frame(spark, rows), size, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert len({c for _, c in want.values()}) < len(want)


def test_minhash_blocks_find_what_leaders_miss(spark, monkeypatch):
    """A chain whose ends are unlike each other is one group, with one leader a bucket and small blocks."""
    rng = random.Random(4)
    chain, at = [], prose(rng, 400).split()
    for _ in range(30):
        chain.append(" ".join(at))
        at = list(at)
        for _ in range(6):
            at[rng.randrange(len(at))] = f"w{rng.randrange(10**6)}"
    rows = [(i, t, None, None, 0) for i, t in enumerate(chain)]
    monkeypatch.setattr(minhash, "LEADERS", 1)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    got = minhash.near_duplicates(frame(spark, rows), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in near_groups(rows, 3, 85).items()}


def test_minhash_links_through_rows_without_id(spark):
    """Near copies of a row with a null id, and two documents that only such a row links, at 0.91."""
    rng = random.Random(6)
    a = prose(rng, 400).split()
    b, c = [*a[20:]], [*a[:-20]]  # a is alike to both, and they are less so to each other
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (a, b, c)]
    near = [100 * len(x & y) >= 91 * len(x | y) for x, y in ((sets[0], sets[1]), (sets[0], sets[2]), (sets[1], sets[2]))]
    assert near == [True, True, False]
    other = prose(rng, 300)
    rows = [(None, " ".join(a), None, None, 0), (1, " ".join(b), None, None, 0), (2, " ".join(c), None, None, 0), (None, other, None, None, 0), (3, f"{other} more", None, None, 0)]
    got = minhash.near_duplicates(frame(spark, rows), 3, 91).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, 1, False), (0, 3, False), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_minhash_without_rows(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert minhash.near_duplicates(spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0)], DOCS)).where("kept").count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, None)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}}


def test_word_hashes_follow_words():
    texts = [b"", b"a b\tc", b" A  b", b"ab", b"b a"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    _, _, h, first = words.words(data, at)
    of = [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [len(x) for x in of] == [0, 3, 2, 1, 2]
    assert of[1][:2] == of[2] and of[4] == of[2][::-1] and of[3][0] not in of[1]
