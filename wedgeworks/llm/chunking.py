"""Content-defined chunking: repeated pieces of text by chunk digest.

A gear hash rolls over 16 bytes; a chunk ends where the hash is a strict maximum of the 24 bytes before
and not exceeded in the 24 after. Cuts thus depend on nothing but the 63 bytes around them, so an
insertion changes the chunks it touches and no others, and a passage common to two texts is cut the same
in both but for its ends. Chunks are about 49 bytes, and split at 4096; no cut lies within 24 bytes of a
text's ends, so a chunk has 25 bytes at least, or is a whole text.

Of the chunks of one digest (128 bits of BLAKE2b), the first in order of document and position is kept
and all others are removed. Chunks of the whole corpus are counted by the first half of the digest, and only
those met twice travel any further. A text that occurs several times is chunked once, for its smallest
document; its other copies go as a whole.

Defined results: null text is empty and has no chunk; rows with a null doc_id come last in order; rows
that repeat an id and a text share one decision; a short text that repeats goes as a whole, as one chunk; other columns
are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, join_keyed, small, stored, table, utf8
from .words import chunks

GEAR = 16
REACH = 24
LONGEST = 4096
_TABLE = np.random.default_rng(3).integers(0, 2**32, 256, dtype=np.int64).astype(np.uint32)


def cuts(data: np.ndarray) -> np.ndarray:
    """End positions of the chunks of a text."""
    if not len(data):
        return np.zeros(0, np.int64)
    x, n = _TABLE[data], 1
    while n < GEAR:
        x[n:] += x[:-n].copy() << np.uint32(n) if len(x) > n else x[n:]
        n *= 2
    low = np.zeros(REACH, np.uint32)
    padded = np.concatenate((low, x, low))
    most, n = padded, 1
    while 2 * n <= REACH:
        most = np.maximum(most[:-n], most[n:])
        n *= 2
    most = np.maximum(most[: len(most) - (REACH - n)], most[REACH - n :])  # of REACH from each place on
    ends = np.flatnonzero((x > most[: len(x)]) & (x >= most[REACH + 1 : REACH + 1 + len(x)])) + 1
    ends = np.append(ends[(ends > REACH) & (ends < len(data) - REACH)], len(data))
    sizes = np.diff(ends, prepend=0)
    if sizes.max() > LONGEST:
        begins = ends - sizes
        ends = np.concatenate([np.append(np.arange(a + LONGEST, b, LONGEST), b) for a, b in zip(begins, ends, strict=True)])
    return ends


def digests(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends, and two 64-bit halves of each chunk's digest."""
    ends = cuts(data)
    text, a, out = data.tobytes(), 0, []
    for b in ends.tolist():
        out.append(hashlib.blake2b(text[a:b], digest_size=16).digest())
        a = b
    return ends, np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, end, data, at in chunks(column):
        for i in range(end - first):
            yield first + i, data[at[i] : at[i + 1]]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, least, text) to a row for each chunk."""
    names = ["h", "rest", "id", "least", "start"]
    for batch in batches:
        rows, starts, halves, n = [], [], [], 0

        def out(batch=batch) -> pa.RecordBatch:
            h, at = np.concatenate(halves), pa.array(np.concatenate(rows))
            return pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(starts).astype(np.int32))], names)

        for row, data in _texts(batch.column(2)):
            ends, h = digests(data)
            if len(ends):
                rows.append(np.full(len(ends), row)), starts.append(np.concatenate(([0], ends[:-1]))), halves.append(h)
                n += len(ends)
            if n > 100_000:
                yield out()
                rows, starts, halves, n = [], [], [], 0
        if n:
            yield out()


def _runs(ends: np.ndarray, flag: np.ndarray) -> list[tuple[int, int]]:
    """Spans of neighbouring flagged chunks."""
    starts = np.concatenate(([0], ends[:-1]))
    edge = np.diff(np.concatenate(([0], flag.astype(np.int8), [0])))
    return [(int(starts[a]), int(ends[b])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1, strict=True)]


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, copy, chunks) to the result."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        copy, found = batch.column(2).to_pylist(), batch.column(3)
        n, n_chunks, repeated, spans, kept = [], [], [], [], []
        for row, data in _texts(batch.column(1)):
            met, gone, ends = [], [], cuts(data)
            if copy[row] is not None and len(data):
                met = [(0, len(data))]
                gone = met if copy[row] else []
            if found[row].is_valid and len(data) and not gone:
                at = found[row].values
                place = {int(s): (int(r), bool(k)) for s, r, k in zip(at.field("start").to_numpy(), at.field("rest").to_numpy(), at.field("first").to_numpy(zero_copy_only=False), strict=True)}
                ends, h = digests(data)
                of = [place.get(s) for s in [0, *ends[:-1].tolist()]]
                of = [x if x and x[0] == r else None for x, r in zip(of, h[:, 1].tolist(), strict=True)]  # ids may collide
                met = met or _runs(ends, np.array([x is not None for x in of]))
                gone = _runs(ends, np.array([x is not None and not x[1] for x in of]))
            rest, at = [], 0
            for a, b in gone:
                rest.append(data[at:a].tobytes())
                at = b
            n.append(len(data)), n_chunks.append(len(ends)), repeated.append(sum(b - a for a, b in met))
            spans.append([{"start": a, "end": b} for a, b in gone]), kept.append(b"".join([*rest, data[at:].tobytes()]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(n_chunks, pa.int64()), pa.array(repeated, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_chunks", "n_repeated", "spans", "kept"])


def remove_repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_repeated (bytes met elsewhere too), removed spans and kept bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).withColumn("id", F.xxhash64("text"))
    # A copy is known by 128 bits; the 64-bit id only routes rows.
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    several = stored(rows.where("octet_length(text) > 0").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1").select("key", "least"), "copies")
    seen = rows.join(small(several.withColumn("many", F.lit(True))), "key", "left")
    # One row a text, also where rows repeat both id and text, merged within each task before they are shuffled.
    stand_in = seen.where("many and doc_id <=> least").groupBy("key").agg(F.first("id").alias("id"), F.first("least").alias("least"), F.first("text").alias("text"), F.count("*").alias("n"))
    stand_in = stored(stand_in, "stand-ins")
    own = seen.where("many is null").select("id", F.col("doc_id").alias("least"), "text").union(stand_in.select("id", "least", "text"))
    pieces = stored(own.mapInArrow(_digested, "h long, rest long, id long, least long, start int"), "pieces")
    often = stored(pieces.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "often")
    met = stored(join_keyed(pieces, often, ["h"], "n", broadcast=False), "met")
    order = F.struct(F.col("least").isNull().alias("none"), "least", "id", "start")
    several_of = met.groupBy("h", "rest").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where("first <> last")
    first = stored(several_of.select("h", "rest", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"), "n"), "first")
    is_first = ((F.col("id") == F.col("first_id")) & (F.col("start") == F.col("first_start"))).alias("first")
    found = join_keyed(met, first, ["h", "rest"], "n", broadcast=False).select("id", F.struct("start", "rest", is_first).alias("c")).groupBy("id").agg(F.collect_set("c").alias("chunks"))
    repeats = stand_in.groupBy("id").agg(F.sum("n").alias("n"))  # rows that will ask for the text's chunks
    found = stored(found.join(repeats, "id", "left").select("id", "chunks", F.coalesce("n", F.lit(1)).alias("n")), "found")
    forget(pieces, often, met, first)
    seen = seen.withColumn("copy", F.when(F.col("many"), ~F.col("doc_id").eqNullSafe(F.col("least"))))
    gone = seen.where("copy").select("doc_id", "text", "copy", F.lit(None).cast(found.schema["chunks"].dataType).alias("chunks"))
    kept = join_keyed(seen.where("copy is null or not copy").select("id", "doc_id", "text", "copy"), found, ["id"], "n", "left", broadcast=False)
    joined = kept.select("doc_id", "text", "copy", "chunks").union(gone)
    return joined.mapInArrow(_removed, "doc_id long, n_bytes long, n_chunks long, n_repeated long, spans array<struct<start:long,end:long>>, kept binary")


def op4_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated chunks."""
    return remove_repeated_chunks(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_chunks",
        "n_repeated",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
