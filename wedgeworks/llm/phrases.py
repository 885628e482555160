"""Fingerprints of documents from the phrases that a Lempel-Ziv parse puts into its dictionary.

A text's UTF-8 bytes are parsed from left to right into phrases, each the longest phrase met before and one more byte;
what a text repeats makes long phrases and few of them, and texts that would compress well together share many. The
fingerprint holds, for each of ``MINIMA`` universal hash functions, 16 bits of the least hash of the phrase set,
written in hexadecimal. The share of equal places estimates the Jaccard likeness of two phrase sets. The
dictionary starts anew after every ``SEGMENT`` bytes, so memory stays bounded for a text of any length; the set is that of
all segments.

``edited`` compares every document with a half-edited version of itself, which takes its end from the next document. Rows
are dealt and sorted by ranges once, texts are parsed where they lie, one after the other, and an edited text
continues from the state that the parse of its first half has left. Only the last row of a range
lacks its next document, the first one of the next range: these few rows, with their texts, are joined and parsed afterwards.

Defined results: null text is empty; empty texts have a fingerprint of their own, at likeness 1 with each other and 0
with all others; the order is by falling doc_id, null last, and rows of one id by digest of their text; rows that repeat id
and text follow each other, counted first and parsed once, so that no task gathers them; the only row of a table is its own next document;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored, table
from .words import mix, powers

MINIMA = 128
SEGMENT = 1 << 20  #: bytes after which the dictionary starts anew
SPREAD = 10_000  #: repetitions of one row that a task writes
_U = np.uint64
_RNG = np.random.default_rng(41)
_A, _B = _RNG.integers(0, 2**32, (2, MINIMA, 1), dtype=np.uint32)
_A |= np.uint32(1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_WIDTH = 1024
EMPTY = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)


def hashes(data: bytes, ends: list[int]) -> np.ndarray:
    """A 32-bit hash of each of the adjacent phrases of ``data`` that end at ``ends``."""
    power, inverse = powers(len(data) + 1)
    stops = np.array(ends)
    begins = np.concatenate(([0], stops[:-1]))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * power[: len(data)], out=total[1:])
    return (mix((total[stops] - total[begins]) * inverse[begins] + (stops - begins).astype(_U)) >> _U(32)).astype(np.uint32)


def minima(values: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least of every hash function over values and what it was before."""
    for at in range(0, len(values), _WIDTH):
        least = np.minimum(least, (values[at : at + _WIDTH] * _A + _B).min(axis=1))
    return least


class Parse:
    """A parse under way: a tree of phrases, each a dict from the next byte to the longer phrase; where it is in the
    tree, with the bytes that led there; and the least hashes so far. ``back`` undoes what followed ``mark``."""

    def __init__(self) -> None:
        self.root: dict[int, dict] = {}
        self.node, self.open, self.done, self.least = self.root, b"", 0, EMPTY
        self.made: list[tuple[list[dict], bytes]] = []

    def feed(self, data: bytes) -> Parse:
        """Parse more bytes."""
        for begin, end in self._pieces(len(data)):
            piece = data[begin:end]
            root, node, i, ends, made = self.root, self.node, len(self.open), [], []
            for byte in piece:
                i += 1
                longer = node.get(byte)
                if longer is None:
                    node[byte] = {}
                    ends.append(i)
                    made.append(node)
                    node = root
                else:
                    node = longer
            whole = self.open + piece
            self.made.append((made, bytes(whole[e - 1] for e in ends)))
            if ends:
                self.least = minima(hashes(whole, ends), self.least)
            self.node, self.open, self.done = node, whole[ends[-1] :] if ends else whole, self.done + len(piece)
            if self.done == SEGMENT:
                self.root = self.node = {}
                self.open, self.done = b"", 0
        return self

    def _pieces(self, n: int) -> Iterator[tuple[int, int]]:
        at = 0
        while at < n:
            end = min(n, at + SEGMENT - self.done)
            yield at, end
            at = end

    def mark(self) -> Parse:
        """Remember this state."""
        self.made = []
        self.kept = self.root, self.node, self.open, self.done, self.least
        return self

    def back(self) -> Parse:
        """Return to the state marked."""
        for nodes, last in self.made:
            for node, byte in zip(nodes, last, strict=True):
                del node[byte]
        self.root, self.node, self.open, self.done, self.least = self.kept
        return self.mark()

    def signature(self) -> np.ndarray:
        """16 bits of every least hash; all zero for an empty text."""
        return np.zeros(MINIMA, ">u2") if (self.least == EMPTY).all() else mix(self.least.astype(_U)).astype(">u2")


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Share of equal places of two signatures; an empty text is like empty texts only."""
    empty = not one.any(), not two.any()
    return float(all(empty)) if any(empty) else float(np.mean(one == two))


def signature(text: bytes) -> np.ndarray:
    """The signature of a whole text."""
    return Parse().feed(text).signature()


def fingerprint(text: bytes) -> str:
    """The signature in hexadecimal."""
    return signature(text).tobytes().hex()


def middle(text: bytes) -> tuple[int, int]:
    """A UTF-8 text's code points, and the byte at which its last half (rounded down) begins."""
    begins = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    n = len(begins)
    return n, int(begins[n - n // 2]) if n > 1 else len(text)


def head(text: bytes, points: int) -> bytes:
    """The first ``points`` code points of a UTF-8 text, or all."""
    if points >= len(text):
        return text
    begins = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return text[: begins[points]] if points < len(begins) else text


class Document:
    """A text parsed, with the parse back in its middle."""

    def __init__(self, doc_id: int | None, text: bytes) -> None:
        self.doc_id, self.text = doc_id, text
        self.points, self.cut = middle(text)
        self.parse = Parse().feed(text[: self.cut]).mark()
        self.signature = self.parse.feed(text[self.cut :]).signature()
        self.parse.back()

    def row(self, after: Document, times: int) -> tuple:
        """The result if ``after`` comes next."""
        end = head(after.text, self.points // 2)
        edited = self.parse.feed(end).signature()
        self.parse.back()
        sha = hashlib.sha256(self.text[: self.cut] + end).digest()
        return self.doc_id, self.points, sha, self.signature.tobytes(), edited.tobytes(), likeness(self.signature, edited), likeness(self.signature, after.signature), times


_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("times", pa.int64())]
_ENDS = [*_RESULT, ("part", pa.int32()), ("first", pa.bool_()), ("text", pa.binary())]
RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, times long"


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, times, part) in order to results, and the texts of the range's first and last rows."""
    last: Document | None = None
    nothing = (None,) * len(_RESULT)
    for batch in batches:
        rows = []
        for doc_id, text, times, part in zip(*(c.to_pylist() if i != 1 else c for i, c in enumerate(batch.columns)), strict=True):
            own = Document(doc_id, text.as_py())
            if last is None:
                rows.append((*nothing, part, True, own.text))
            else:
                rows.append((*last.row(own, 1), None, None, None))
            if times > 1:
                rows.append((*own.row(own, times - 1), None, None, None))
            last, where = own, part
        if rows:
            yield _batch(rows, _ENDS)
    if last is not None:
        yield _batch([(last.doc_id, *nothing[1:], where, False, last.text)], _ENDS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, next text) to results."""
    for batch in batches:
        rows = [Document(i.as_py(), text.as_py()).row(Document(None, after.as_py()), 1) for i, text, after in zip(*batch.columns, strict=True)]
        if rows:
            yield _batch(rows, _RESULT)


def _counted(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, text, digest)`` with ``times``, rows that repeat an id and text being one."""
    often = stored(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")), "repeated")
    if often.isEmpty():
        return rows.withColumn("times", F.lit(1).cast("long"))
    known = small(often)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    once = rows.join(known, same, "left_anti").withColumn("times", F.lit(1).cast("long"))
    more = rows.join(known, same, "left_semi").groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    return once.unionByName(more)


def _repeated(results: DataFrame) -> DataFrame:
    """Every result as often as its row occurs."""
    more = results.where("times > 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.expr(f"(times - 1) div {SPREAD}")))).repartition("doc_id", "k")
    count = F.least(F.lit(SPREAD), F.col("times") - F.col("k") * SPREAD).cast("int")
    more = more.withColumn("_", F.explode(F.array_repeat(F.lit(0), count)))
    return results.where("times = 1").drop("times").unionByName(more.drop("times", "k", "_"))


def next_key(doc_id: Column) -> list[Column]:
    """The order of documents: falling ids, null last, then digests."""
    return [doc_id.desc_nulls_last(), F.col("digest").asc()]


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited and near_next of every
    document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    rows = _counted(rows.withColumn("digest", F.unhex(F.md5("text"))))
    key = next_key(F.col("doc_id"))
    ranged = rows.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text", "times", F.spark_partition_id().alias("part"))
    found = stored(ranged.mapInArrow(_in_order, f"{RESULT}, part int, first boolean, text binary"), "parsed")
    # A row a range: which range comes next, round to the first.
    parts = found.where("first").select("part")
    after = F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("after")
    firsts = found.where("first").select(F.col("part").alias("after"), F.col("text").alias("next"))
    ends = found.where("not first").select("doc_id", "text", "part").join(parts.select("part", after), "part").join(firsts, "after").select("doc_id", "text", "next")
    names = [n for n, _ in _RESULT]
    out = _repeated(found.where("first is null").select(names)).unionByName(ends.mapInArrow(_joined, RESULT).drop("times"))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})


def op13_lempel_ziv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their half-edited versions, with likenesses."""
    return edited(table(spark, sf_dir, "documents"))
