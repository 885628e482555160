"""Removal of every byte inside a long string that starts more than once in a corpus.

A string of ``LENGTH`` bytes is a *window*. Windows that are equal pick the same anchor (the leftmost
least hash among their k-grams) at the same offset, so equal windows meet under their anchor wherever
they lie. From coarse to fine:

1. Texts that occur more than once are whole repeats; one row stands for them from here on.
2. Anchors are counted over all texts; windows of an anchor met once are unique.
3. Windows of the anchors left are gathered into cells of 32 neighbouring starts. The bytes common to
   all windows of a cell, its core, are digested, and what lies left and right of it (at most 31 bytes
   each) is carried along. A core met in one context only has no repeat; a context met twice is one.
4. The rest is decided by suffix arrays: for each core the differing contexts are laid out as
   left bytes, one symbol for the core, right bytes. Suffixes are sorted by the linear grouping
   construction, and a window repeats if 32 symbols from its start agree with a neighbour in the order.

A core with more than ``HOT`` contexts is not gathered: its windows are counted as keys by Spark, which
is exact too. Digests have 128 bits.

Defined results: null text is empty; texts shorter than a window lose nothing, even if repeated; rows
of one text (repeated ids, null ids) each get a result; matches never cross documents; invalid inputs
do not occur, as Spark strings are UTF-8; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, join_keyed, small, stored, table, utf8
from .suffix_array import suffix_array
from .words import chunks, mix

LENGTH = 400
GRAM = 128  #: a power of two
SPAN = LENGTH - GRAM + 1  #: k-grams of a window
CELL = 32
HOT = 2000
SYMBOLS = 60_000  #: symbols of one suffix array
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3
_BYTE = np.random.default_rng(5).integers(0, 2**63, 256, dtype=np.int64).view(_U) | _U(1)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-gram, and the least hash of every window."""
    x, n = _BYTE[data], 1
    while n < GRAM:
        x = x[:-n] * _U(pow(_BASE, n, 2**64)) + x[n:]
        n *= 2
    x = mix(x)
    least, n = x, 1
    while 2 * n <= SPAN:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    return x, np.minimum(least[: len(least) - (SPAN - n)], least[SPAN - n :]) if n < SPAN else least


def _runs(x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of every run with one least hash."""
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return first, np.concatenate((first[1:], [len(least)])) - 1


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for first, end, data, at in chunks(column):
        for i in range(end - first):
            yield first + i, data[at[i] : at[i + 1]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, anchor, n), n being the positions at which the text has the anchor."""
    for batch in batches:
        rows, anchors, times = [], [], []
        for row, data in _texts(batch.column(1)):
            if len(data) >= LENGTH:
                x, least = _grams(data)
                first, last = _runs(x, least)
                n = np.add.reduceat((x[: len(least)] == least).astype(np.int64), first) + (x[last] != least[last])
                value, inverse = np.unique(least[first], return_inverse=True)
                rows.append(np.full(len(value), row)), anchors.append(value.view(np.int64)), times.append(np.bincount(inverse, n).astype(np.int64))
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(anchors)), pa.array(np.concatenate(times))], ["id", "anchor", "n"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, anchors) to the cells of those anchors: (id, core, lft, rgt, start)."""
    for batch in batches:
        wanted = batch.column(2)
        rows, cores, lefts, rights, starts = [], [], [], [], []
        for row, data in _texts(batch.column(1)):
            if len(data) < LENGTH:
                continue
            x, least = _grams(data)
            first, last = _runs(x, least)
            text = data.tobytes()
            keep = np.isin(least[first], wanted[row].values.to_numpy().view(_U))
            for a, b in zip(first[keep].tolist(), last[keep].tolist(), strict=True):
                value = least[a]
                ends = (np.flatnonzero(x[a : b + 1] == value) + a).tolist()  # windows that begin at their anchor
                parts, s = [], a
                for e in ends:
                    parts.append((s, e, e))
                    s = e + 1
                if s <= b:
                    parts.append((s, b, s + int(np.argmax(x[s : s + SPAN] == value))))
                for s, e, p in parts:
                    for q in range((p - e) // CELL, (p - s) // CELL + 1):
                        low, high = p - CELL * q - CELL + 1, p - CELL * q  # starts of the whole cell
                        here, there = max(s, low), min(e, high)
                        rows.append(row), starts.append(here)
                        cores.append(hashlib.blake2b(text[high : low + LENGTH], digest_size=16, salt=bytes([q])).digest())
                        lefts.append(text[here:high]), rights.append(text[low + LENGTH : there + LENGTH])
            if len(rows) > 50_000:
                yield _cell_batch(batch, rows, cores, lefts, rights, starts)
                rows, cores, lefts, rights, starts = [], [], [], [], []
        if rows:
            yield _cell_batch(batch, rows, cores, lefts, rights, starts)


def _cell_batch(batch: pa.RecordBatch, rows: list, cores: list, lefts: list, rights: list, starts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cores, pa.binary()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array(starts, pa.int32())], ["id", "core", "lft", "rgt", "start"])


def repeated_windows(groups: list[list[tuple[bytes, bytes]]]) -> list[list[int]]:
    """For each group of contexts (left, right) of one core, a mask for each context: bit j is set if the
    window at its j-th start is also a window of another context of the group."""
    text: list[int] = []
    begins = []
    for g, contexts in enumerate(groups):
        for left, right in contexts:
            begins.append(len(text))
            text += [c + 1 for c in left]
            text.append(300 + g)
            text += [c + 1 for c in right]
            text.append(0)
    order = np.array(suffix_array(text))
    padded = np.concatenate((np.array(text, np.int32), np.zeros(CELL, np.int32)))
    view = np.lib.stride_tricks.sliding_window_view(padded, CELL)
    same = np.zeros(len(order), bool)
    for at in range(1, len(order), 20_000):
        part = order[at - 1 : at + 20_000]
        same[at : at + 20_000] = (view[part[1:]] == view[part[:-1]]).all(axis=1)
    repeated = np.zeros(len(order), bool)
    repeated[order[1:][same[1:]]] = True
    repeated[order[:-1][same[1:]]] = True
    out, k = [], 0
    for contexts in groups:
        masks = []
        for left, right in contexts:
            starts = repeated[begins[k] : begins[k] + len(left) + len(right) - CELL + 2]
            masks.append(sum(1 << j for j in np.flatnonzero(starts).tolist()))
            k += 1
        out.append(masks)
    return out


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core, contexts) to (core, lft, rgt, mask) of the contexts that hold a repeated window."""
    for batch in batches:
        waiting: list[tuple[bytes, list]] = []
        n = 0
        for i in range(batch.num_rows):
            contexts = [(c["lft"], c["rgt"]) for c in batch.column(1)[i].as_py()]
            waiting.append((batch.column(0)[i].as_py(), contexts))
            n += sum(len(a) + len(b) + 2 for a, b in contexts)
            if n >= SYMBOLS or i == batch.num_rows - 1:
                found = [(core, *c, m) for (core, cs), ms in zip(waiting, repeated_windows([c for _, c in waiting]), strict=True) for c, m in zip(cs, ms, strict=True) if m]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.binary(), pa.int64()))], ["core", "lft", "rgt", "mask"])
                waiting, n = [], 0


def _hot(contexts: DataFrame) -> DataFrame:
    """The same for cores with very many contexts: windows as keys."""
    each = contexts.withColumn("j", F.explode(F.sequence(F.lit(0), F.octet_length("lft") + F.octet_length("rgt") - (CELL - 1))))
    r = F.octet_length("lft") - F.col("j")
    window = each.select("core", "lft", "rgt", "j", F.expr("substring(lft, j + 1)").alias("l"), F.substring("rgt", F.lit(1), F.lit(CELL - 1) - r).alias("r"))
    often = window.groupBy("core", "l", "r").agg(F.count("*").alias("n")).where("n > 1")
    return window.join(often, ["core", "l", "r"]).groupBy("core", "lft", "rgt").agg(F.bit_or(F.expr("shiftleft(1L, j)")).alias("mask"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, whole, cells) to doc_id, n_bytes, spans and the kept text."""
    for batch in batches:
        n, spans, kept = [], [], []
        cells, whole = batch.column(3), batch.column(2).to_pylist()
        for row, data in _texts(batch.column(1)):
            runs: list[list[int]] = []
            if whole[row] and len(data) >= LENGTH:
                runs = [[0, len(data)]]
            elif cells[row].is_valid:
                at = cells[row].values
                start, mask = at.field("start").to_numpy(), at.field("mask").to_numpy()
                j = np.arange(CELL)
                hit = np.unique((start[:, None] + j)[(mask[:, None] >> j) & 1 == 1])
                for s in hit.tolist():
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = s + LENGTH
                    else:
                        runs.append([s, s + LENGTH])
            rest, at = [], 0
            for a, b in runs:
                rest.append(data[at:a].tobytes())
                at = b
            rest.append(data[at:].tobytes())
            n.append(len(data)), spans.append([{"start": a, "end": b} for a, b in runs]), kept.append(b"".join(rest))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def _of(texts: DataFrame, lists: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Texts with their lists: narrow ids first pick the texts, so that only those are shuffled."""
    ids = stored(lists.select("id"), "ids") if ids is None else ids
    return texts.join(small(ids), "id", "left_semi").join(lists.hint("merge"), "id")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the removed spans and the kept bytes of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).withColumn("id", F.unhex(F.md5("text")))
    copies = rows.where(F.octet_length("text") >= LENGTH).groupBy("id").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    copies = stored(copies.select("id", "least", F.lit(True).alias("whole")), "copies")
    seen = rows.join(small(copies), "id", "left")
    plain = seen.where("whole is null")
    # One row a text, also where rows repeat both id and text, merged within each task before they are shuffled.
    stand_in = seen.where("whole and doc_id <=> least").groupBy("id").agg(F.first("text").alias("text"))
    single = plain.select("id", "text").union(stored(stand_in, "stand-ins"))

    anchors = stored(single.mapInArrow(_anchors, "id binary, anchor long, n long"), "anchors")
    often = stored(anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "often")
    wanted = stored(join_keyed(anchors.select("id", "anchor"), often, ["anchor"], "n", broadcast=False).groupBy("id").agg(F.collect_list("anchor").alias("anchors")), "wanted")
    cells = stored(_of(single, wanted).select("id", "text", "anchors").mapInArrow(_cells, "id binary, core binary, lft binary, rgt binary, start int"), "cells")
    forget(anchors, often, wanted)

    contexts = stored(cells.groupBy("core", "lft", "rgt").agg(F.count("*").alias("n")), "contexts")
    several = stored(contexts.groupBy("core").agg(F.count("*").alias("k")).where("k > 1").select("core", "k", F.col("k").alias("rows")), "cores")
    open_ = join_keyed(contexts, several, ["core"], "rows")
    grouped = open_.where(F.col("k") <= HOT).groupBy("core").agg(F.collect_list(F.struct("lft", "rgt")).alias("contexts"))
    decided = grouped.mapInArrow(_decided, "core binary, lft binary, rgt binary, mask long")
    found = decided.union(_hot(open_.where(F.col("k") > HOT).select("core", "lft", "rgt")))
    whole = contexts.where("n > 1").select("core", "lft", "rgt", F.lit((1 << CELL) - 1).cast("long").alias("mask"), "n")
    masks = stored(found.withColumn("n", F.lit(1)).union(whole).groupBy("core", "lft", "rgt").agg(F.bit_or("mask").alias("mask"), F.max("n").alias("n")), "masks")
    every = F.expr(f"shiftleft(1L, octet_length(lft) + octet_length(rgt) - {CELL - 2}) - 1")  # its own starts only
    partly = cells.join(small(copies.select("id")), "id", "left_anti")  # whole repeats need no spans
    marked = stored(join_keyed(partly, masks, ["core", "lft", "rgt"], "n", broadcast=False).groupBy("id").agg(F.collect_list(F.struct("start", F.col("mask").bitwiseAND(every).alias("mask"))).alias("cells")), "marked")
    forget(cells, contexts, several, masks)
    ids = stored(marked.select("id"), "marked-ids")
    touched = _of(plain, marked, ids).select("doc_id", "text", "whole", "cells")
    others = seen.join(small(ids), "id", "left_anti").select("doc_id", "text", "whole", F.lit(None).cast(marked.schema["cells"].dataType).alias("cells"))
    return touched.union(others).mapInArrow(_removed, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
