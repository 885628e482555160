"""Language identification with hyperdimensional profiles.

Every letter of Unicode has a random vector of +1 and -1, seeded by its code point; what lies between letters has one
vector too. A trigram is the product of its letters' vectors, the first moved by two blocks and the second by one; a
text is the sum of its trigrams' vectors; a language is the sum of its texts. A text is given the language
whose prototype has the largest cosine with it.

Vectors are bits: a product of signs is an exclusive or, and a vector is made from its letters when it is
needed, so nothing is kept for what was met before. Tasks add up the vectors of their texts by language, Spark adds up the
tasks, and the driver gets at most ``PARTS`` sums of ``DIMENSION`` numbers a language.

Defined results: null text and text without a letter get ``und`` with score 0; documents of null lang
teach nothing; case is ignored; runs of other characters count as one gap; without any learnt language every text is
``und``; ties go to the alphabetically first language; rows repeat as they come; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .words import chunks, mix

DIMENSION = 1024
BLOCKS = DIMENSION // 64
PARTS = 64
MODULUS, HELD_OUT = 4, 2
UNKNOWN = "und"
_SHIFT = 21  #: bits of a code point
_ROWS, _MOST = 512, 4096  #: texts and trigrams that are multiplied together


@cache
def letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.int64)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            out[i] = ord(c.lower()[0])
    return out


def bits(symbols: np.ndarray) -> np.ndarray:
    """The random bits of each letter: symbols x BLOCKS words of 64."""
    with np.errstate(over="ignore"):
        return mix(mix(symbols.astype(np.uint64)[:, None] * np.uint64(BLOCKS) + np.arange(BLOCKS, dtype=np.uint64)) + np.uint64(0x9E3779B97F4A7C15))


def vectors(codes: np.ndarray) -> np.ndarray:
    """The vector of each trigram, +1 and -1."""
    low = (1 << _SHIFT) - 1
    bound = np.roll(bits(codes >> 2 * _SHIFT), 2, 1) ^ np.roll(bits(codes >> _SHIFT & low), 1, 1) ^ bits(codes & low)
    return np.unpackbits(np.ascontiguousarray(bound).view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def distinct(x: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values below ``end`` in order, and the place of each value among them; by a table if it is not large."""
    if end > 1 << 23:
        return np.unique(x, return_inverse=True)
    met = np.zeros(end, bool)
    met[x] = True
    return np.flatnonzero(met), (np.cumsum(met) - 1)[x]


def trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the trigrams that occur, the place of each occurrence among them and its row, and whether a row has a letter."""
    text = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begins = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
    ends = np.concatenate(([0], begins))[at[1:]] if len(begins) else np.zeros(len(at) - 1, np.int64)
    row = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
    s = letters()[text]
    has = np.bincount(row[s > 0], minlength=len(ends)) > 0
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (row[1:] != row[:-1])
    s, row = s[keep], row[keep]
    inside = row[:-2] == row[2:]
    met, local = distinct(s, 0x110000)  # few, so trigrams of their numbers are small
    code = (local[:-2] * len(met) + local[1:-1]) * len(met) + local[2:]
    code, place = distinct(code[inside], len(met) ** 3)
    first, rest = np.divmod(code, max(1, len(met)) ** 2)
    second, third = np.divmod(rest, max(1, len(met)))
    return met[first] << 2 * _SHIFT | met[second] << _SHIFT | met[third], place, row[:-2][inside], has


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to the sum of each language's texts; the numbers are whole, so their order does not matter."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for first, end, data, at in chunks(batch.column(1)):
            codes, place, row, _ = trigrams(data, at)
            names = sorted(set(langs[first:end]))
            number = np.array([names.index(x) for x in langs[first:end]])
            counts = np.stack([np.bincount(place[number[row] == i], minlength=len(codes)) for i in range(len(names))]).astype(np.float64)
            for k in range(0, len(codes), _MOST):
                for name, total in zip(names, counts[:, k : k + _MOST] @ vectors(codes[k : k + _MOST]), strict=True):
                    totals[name] = totals.get(name, 0) + total
    part = TaskContext.get().partitionId() % PARTS
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([part] * len(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["lang", "part", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the sums of each language and part as they stream by."""
    totals: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for lang, part, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            totals[lang, part] = totals.get((lang, part), 0) + np.frombuffer(blob, np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["lang", "part", "sums"])


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from all documents that may teach."""
    schema = "lang string, part int, sums binary"
    learn = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id"), MODULUS, HELD_OUT))
    sums: dict[str, np.ndarray] = {}
    for r in learn.select("lang", "text").mapInArrow(_summed, schema).repartition("lang", "part").mapInArrow(_added, schema).collect():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["sums"], np.float64)
    names = sorted(sums)
    out = np.zeros((len(names), DIMENSION), np.float32)
    for i, name in enumerate(names):
        out[i] = sums[name] / max(np.linalg.norm(sums[name]), 1e-12)
    return names, out


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, at least 0) of every row."""
    names, known = prototypes(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in chunks(batch.column(1)):
                codes, place, row, has = trigrams(data, at)
                n = end - first
                lang, score = [UNKNOWN] * n, np.zeros(n)
                edge = np.searchsorted(row, np.arange(n + 1))
                for a in range(0, n if names else 0, _ROWS):
                    b = min(n, a + _ROWS)
                    own, texts = slice(edge[a], edge[b]), np.zeros((b - a, DIMENSION), np.float32)
                    which, local = distinct(place[own], len(codes))
                    for k in range(0, len(which), _MOST):
                        used = (local >= k) & (local < k + _MOST)
                        width = min(_MOST, len(which) - k)
                        counts = np.bincount((row[own][used] - a) * width + local[used] - k, minlength=(b - a) * width).reshape(b - a, width)
                        texts += counts.astype(np.float32) @ vectors(codes[which[k : k + width]])
                    cosine = texts @ known.T / np.maximum(np.linalg.norm(texts, axis=1, keepdims=True), 1e-12)
                    best = cosine.argmax(axis=1)
                    for i in np.flatnonzero(has[a:b]):
                        lang[a + i], score[a + i] = names[best[i]], min(1.0, max(0.0, cosine[i, best[i]]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op3_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(table(spark, sf_dir, "documents")).select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "lang_pred", "score")
