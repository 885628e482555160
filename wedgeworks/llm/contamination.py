"""Benchmark decontamination by latent semantic retrieval.

Texts become sequences of benchmark-vocabulary numbers once (0 for any other word), and all later steps read
those. Passages of 32 words hold their words' TF-IDF weights; every word weighs something, however common it
is. Their randomised SVD is distributed: tasks count which words share passages, the counts are shuffled as packed lists, by the
first word, and added up to A'A, and products of that table with a random basis, twice repeated, give the latent directions. Every
window of 32 words, at steps of 16, is projected on them, and so is every benchmark item, in pieces as long
as windows; a window and an item are candidates at a cosine of ``COSINE`` with any piece, or if the stretch
around the window has ``ALONG`` of the piece's length along it (a light item among heavier words has a small
cosine). A stretch is the window and the item's length on either side, or ``WIDE`` times that length. A
candidate is settled on the words of its stretch: the longest common subsequence of the item with it, as a share of the
item, and the same for the item's answer (its last quarter), so that a paraphrase counts that keeps the
answer. In the wide stretch, which finds an item with up to four words put between each two of its own,
only ``LEAKED`` counts. Words are summed up by weight before vectors are made, as that is cheaper: a stretch whose words of
the item weigh less than the lightest words that make up the share needed can hold no such subsequence, so no
leak is lost there.

Frequencies and the SVD cover all documents. Items are taken in blocks of ``ITEMS``, which bounds what is
sent to the tasks (vocabulary x rank numbers) however large the benchmark is; the corpus is read once a
block.

Defined results: null and empty texts match nothing, as do items without words; rows with null doc_id are
searched and reported with null; repeated rows and items are reported each; no documents or items give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, stored, table
from .words import chunks, words

ITEMS = 1000
STEP = 16  #: a window or passage is two steps long
RANK = 192
COSINE = 0.4
ALONG = 0.4  #: share of an item's latent length that a stretch must reach along the item, if the cosine is less
LEAKED, PARAPHRASED, ANSWERED = 0.8, 0.6, 0.75
WIDE = 2  #: item lengths on either side of a window in which a whole item is looked for
_PARTS = 64  #: parts of the pairs of words, or one for _ROWS words, if those are more
_ROWS = 256
_KEYS = 1_000_000  #: pairs of words that a task counts at a time, before they are added up by parts
_SEEN = 8 << 20  #: bytes of words by items that are looked at together
_HEAVIEST = 15  #: weights of words are counted in whole numbers up to this, so that those of a step fit a byte
_CELLS = 4 << 20  #: of steps by items whose sums are held at a time
_PAIRS = 4096  #: candidates whose vectors are compared together


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for first, end, data, at in chunks(pa.array(texts, pa.large_string())):
        _, _, hashed, where = words(data, at)
        out += [hashed[where[i] : where[i + 1]] for i in range(end - first)]
    return out


def _numbered(vocabulary: np.ndarray):
    """(doc_id, text) to (doc_id, ids): a number from 1 for every benchmark word, 0 for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in chunks(batch.column(1)):
                _, _, hashed, where = words(data, at)
                place = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
                ids = np.where(vocabulary[place] == hashed, place + 1, 0).astype(np.int32)
                blobs = [ids[where[i] : where[i + 1]].tobytes() for i in range(end - first)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], pa.array(blobs, pa.binary())], ["doc_id", "ids"])

    return run


def _ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of a batch, each one's step, and for each row its first step (one more at the end).

    Rows are padded to whole steps, so that no step crosses rows.
    """
    rows = [np.frombuffer(b.as_buffer(), np.int32) for b in batch.column(1)]
    n = np.array([len(r) for r in rows], np.int64)
    steps = -(-n // STEP)
    first = np.concatenate(([0], np.cumsum(steps)))
    ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    inside = np.arange(len(ids)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return ids, np.repeat(first[:-1], n) + inside // STEP, first


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys as gaps, and their counts, byte by byte in planes: most planes are zeros and compress away."""
    return np.stack([np.diff(keys, prepend=0), n]).astype("<i8").view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).tobytes()


def _unpacked(blob: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    gaps, n = np.ascontiguousarray(np.frombuffer(blob.as_buffer(), np.uint8).reshape(2, 8, -1).transpose(0, 2, 1)).view("<i8")[..., 0]
    return np.cumsum(gaps), n


def _parts(size: int) -> int:
    """Pairs (i, j) lie in part i % parts, by the key i // parts * size + j."""
    return max(_PARTS, size // _ROWS)


def _dealt(i: np.ndarray, j: np.ndarray, n: np.ndarray, size: int) -> pa.RecordBatch:
    """(part, pairs) of distinct pairs of words in ascending order."""
    parts = _parts(size)
    part = (i % parts).astype(np.min_scalar_type(parts))
    order = np.argsort(part, kind="stable")
    part, key, n = part[order].astype(np.int32), (i // parts * size + j)[order], n[order]
    begin = np.flatnonzero(np.diff(part, prepend=-1))
    blobs = [_packed(k, m) for k, m in zip(np.split(key, begin[1:]), np.split(n, begin[1:]), strict=True)] if len(key) else []
    return pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(blobs, pa.binary())], ["part", "pairs"])


def _pairs_of(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j and count of the pairs of each row of (part, pairs)."""
    for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        key, n = _unpacked(blob)
        yield key // size * _parts(size) + part, key % size, n


def _cooccurrences(size: int):
    """(doc_id, ids) to (part, pairs): the passages that hold words i <= j; a pair may come several times.

    The pair (0, 0) counts all passages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.int32 if size * size < 1 << 31 else np.int64
        waiting: list[np.ndarray] = []

        def counted() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(waiting)
            waiting.clear()
            keys, n = np.unique(keys, return_counts=True)
            out = _dealt(*np.divmod(keys, size), n, size)
            for at in range(0, out.num_rows, 16):
                yield out.slice(at, 16)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                ids, step, first = _ids(batch.slice(at, 128))
                used = np.flatnonzero(ids)
                # Rows begin at even steps here, so that no passage crosses rows.
                even = np.concatenate(([0], np.cumsum((np.diff(first) + 1) // 2 * 2)))
                waiting.append(np.zeros(even[-1] // 2, kind))
                row = np.searchsorted(first, step[used], "right") - 1
                held = np.unique((step[used] - first[row] + even[row]) // 2 * size + ids[used])
                passage, word = held // size, (held % size).astype(kind)
                waiting.append(word * size + word)
                for d in range(1, 2 * STEP):
                    same = np.flatnonzero(passage[d:] == passage[:-d])
                    if not len(same):
                        break
                    waiting.append(word[same] * size + word[same + d])  # words ascend within a passage
                if sum(map(len, waiting)) > _KEYS:
                    yield from counted()
        if waiting:
            yield from counted()

    return run


def _mirrored(size: int):
    """(part, pairs) to the same and the pairs (j, i), so that all pairs of a word lie in its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            for i, j, n in _pairs_of(batch, size):
                other = np.lexsort((i, j))
                other = other[i[other] != j[other]]
                yield _dealt(j[other], i[other], n[other], size)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, pairs) to one row a part, counts of a pair added up as they stream by."""
    total: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[int, int] = {}

    def added(part: int) -> None:
        key, n = (np.concatenate(c) for c in zip(*total[part], strict=True))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        total[part], waiting[part] = [(key[begin], np.add.reduceat(n, begin))], 0

    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            one = _unpacked(blob)
            if len(one[0]):
                total.setdefault(part, []).append(one)
                waiting[part] = waiting.get(part, 0) + len(one[0])
                if waiting[part] > max(_KEYS // _PARTS, len(total[part][0][0])):
                    added(part)
    for part in list(total):
        added(part)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(*total.pop(part)[0])], pa.binary())], ["part", "pairs"])


def _diagonal(size: int):
    """(part, pairs) to (id, passages that hold the word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, n in _pairs_of(batch, size):
                yield pa.RecordBatch.from_arrays([pa.array(i[i == j]), pa.array(n[i == j])], ["id", "n"])

    return run


def together_of(encoded: DataFrame, size: int) -> DataFrame:
    """(part, pairs): of every two words, in both orders, the passages that hold them; all pairs of a word lie in one row."""
    kind, mirrored = "part int, pairs binary", _mirrored(size)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from mirrored(_summed(batches))  # in one call, as each mapInArrow of a stage has a Python worker a core

    upper = encoded.mapInArrow(_cooccurrences(size), kind).repartition("part").mapInArrow(both, kind)
    return upper.repartition("part").mapInArrow(_summed, kind)


def _products(weight: np.ndarray, basis: np.ndarray):
    """(part, pairs) to rows of A'A basis: their ids and values, _ROWS rows at a time and dense."""
    size = len(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, place = basis.astype(np.float64), np.zeros(size, np.int64)
        for batch in batches:
            for i, j, n in _pairs_of(batch, size):
                ids, at = np.unique(i, return_inverse=True)
                value, out = n * weight[i].astype(np.float64) * weight[j], np.empty((len(ids), basis.shape[1]))
                for k in range(0, len(ids), _ROWS):
                    own = slice(*np.searchsorted(at, [k, k + _ROWS]))
                    seen = np.zeros(size, bool)
                    seen[j[own]] = True
                    used = np.flatnonzero(seen)
                    place[used] = np.arange(len(used))
                    dense = np.zeros((min(_ROWS, len(ids) - k), len(used)))
                    dense[at[own] - k, place[j[own]]] = value[own]
                    out[k : k + _ROWS] = dense @ wide[used]
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([out.tobytes()], pa.binary())], ["ids", "rows"])

    return run


def weights(passages: float, held: np.ndarray) -> np.ndarray:
    """Inverse document frequencies, above 0 for every word that occurs."""
    return np.where(held > 0, np.log1p(passages / np.maximum(held, 1)), 0).astype(np.float32)


def directions(together: DataFrame, weight: np.ndarray) -> np.ndarray:
    """Leading right singular directions of the weighted passages: words x rank."""
    rank = min(RANK, max(1, int((weight > 0).sum())))
    basis = np.random.default_rng(1).standard_normal((len(weight), rank)).astype(np.float32)
    for _ in range(3):
        total = np.zeros(basis.shape)
        for r in together.mapInArrow(_products(weight, basis), "ids binary, rows binary").collect():
            total[np.frombuffer(r["ids"], np.int64)] = np.frombuffer(r["rows"]).reshape(-1, rank)
        basis = np.linalg.qr(total)[0].astype(np.float32)
    return basis


def common_length(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, a word of ``text`` at a time on the bits of ``item``."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in text:
        if w in where:
            hit = row & where[w]
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def answer_of(item: list[int]) -> list[int]:
    """The item's answer: its last quarter, three words at least."""
    return item[-max(3, len(item) // 4) :]


def pieces_of(item: list[int]) -> list[list[int]]:
    """An item cut as long as windows are, at the same steps, and once more at its end."""
    last = max(0, len(item) - 2 * STEP)
    return [item[at : at + 2 * STEP] for at in dict.fromkeys([*range(0, last, STEP), last])]


def stretches(length: int) -> tuple[int, int]:
    """Steps on either side of a window that belong to an item's near and to its wide stretch."""
    return -(-length // STEP), -(-WIDE * length // STEP)


def _matches(kind: pa.DataType, weight: np.ndarray, basis: np.ndarray, numbers: list[int | None], items: list[list[int]]):
    numbers, items = zip(*sorted(zip(numbers, items, strict=True), key=lambda i: len(i[1])), strict=True)  # items of one reach lie side by side
    scaled = basis * weight[:, None]
    pieces = [pieces_of(i) for i in items]
    n_pieces = np.array([len(p) for p in pieces])
    of_item = np.concatenate(([0], np.cumsum(n_pieces)))[:-1]
    latent = np.stack([scaled[np.array(piece, np.int64)].sum(axis=0) for parts in pieces for piece in parts])
    length = np.maximum(np.linalg.norm(latent, axis=1), 1e-30)
    latent /= length[:, None]
    # A word of one passage in 400 weighs as much as any rarer one; one that no passage holds weighs most.
    heavy = np.where(weight > 0, np.clip(np.floor(3 * (weight - 1)), 1, _HEAVIEST), _HEAVIEST).astype(np.uint8)
    holds = np.zeros((len(weight), len(items)), np.uint8)
    for k, item in enumerate(items):
        holds[item, k] = heavy[item]
    reach = np.array([stretches(len(i)) for i in items])
    needed = np.array([[np.sort(heavy[item])[: int(np.ceil(share * len(item) - 1e-9))].sum(dtype=np.int64) for item in items] for share in (PARAPHRASED, LEAKED)])
    # A subsequence holds no more of an item than the words that text and item share.
    times = np.zeros(holds.shape, np.min_scalar_type(max(map(len, items))))
    for k, item in enumerate(items):
        np.add.at(times[:, k], item, 1)
    fewest = np.array([int(np.ceil(PARAPHRASED * len(i) - 1e-9)) for i in items])
    parts, begin = [], 0  # columns whose counts are looked at together: fewer where items are long
    for k in range(1, len(items) + 1):
        if k == len(items) or 4 * reach[k].max() * (k + 1 - begin) > _CELLS:
            parts.append((begin, k))
            begin = k

    def able(ids: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows by items: whether the whole row has enough of the item's words, in any order."""
        out = np.zeros((len(first) - 1, len(items)), bool)
        row, word = np.divmod(np.unique(((np.searchsorted(first, step, "right") - 1) * len(weight) + ids)[ids > 0]), len(weight))
        edge = np.append(np.flatnonzero(np.diff(row, prepend=-1)), len(row))
        at = 0
        while at < len(edge) - 1:
            end = max(at + 1, int(np.searchsorted(edge, edge[at] + _SEEN // len(items), "right")) - 1)
            shared = np.add.reduceat(times[word[edge[at] : edge[end]]], edge[at:end] - edge[at], axis=0, dtype=times.dtype)
            out[row[edge[at:end]]] = shared >= fewest
            at = end
        return out

    def candidates(ids: np.ndarray, step: np.ndarray, first: np.ndarray, open_: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows, items, the first step and the end of a stretch, and its window's cosine."""
        steps = int(first[-1])
        grid = np.zeros((steps, STEP), np.int32)
        grid[step, np.arange(len(ids)) - np.searchsorted(step, step)] = ids
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for c, d in parts:
            margin = int(reach[c:d].max())
            yield from of_columns(c, d, margin, max(64, 2 * margin, _SEEN // (STEP * (d - c))), grid, row_of, first, open_)

    def of_columns(c: int, d: int, margin: int, some: int, grid: np.ndarray, row_of: np.ndarray, first: np.ndarray, open_: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        steps = len(grid)
        # Differences of sums that wrap are right as long as a stretch weighs less than the type holds.
        kind_of = np.uint16 if (2 * margin + 2) * STEP * _HEAVIEST < 1 << 16 else np.int64
        least = needed.astype(kind_of)
        for k in range(0, steps, some):
            window = np.arange(k, min(k + some, steps))
            start, end = max(0, k - margin), min(steps, k + some + margin + 2)
            shared = np.zeros((end - start + 1, d - c), kind_of)
            for at in range(start, end, some):
                part = holds[grid[at : min(at + some, end)], c:d].sum(axis=1, dtype=np.uint8)
                np.cumsum(part, axis=0, dtype=kind_of, out=shared[at - start + 1 : at - start + 1 + len(part)])
                shared[at - start + 1 : at - start + 1 + len(part)] += shared[at - start]
            row = row_of[window]
            found = []
            for w in (0, 1):
                for r in np.unique(reach[c:d, w]).tolist():
                    a, b = np.searchsorted(reach[c:d, w], [r, r + 1])
                    lo, hi = np.maximum(window - r, first[row]), np.minimum(window + 2 + r, first[row + 1])
                    one, which = np.nonzero(shared[hi - start, a:b] - shared[lo - start, a:b] >= least[w, c + a : c + b])
                    found.append((one, c + a + which, lo[one], hi[one]))
            one, item, lo, hi = (np.concatenate(f) for f in zip(*found, strict=True))
            held = open_[row[one], item]
            one, item, lo, hi = one[held], item[held], lo[held], hi[held]
            if not len(one):
                continue
            # Latent vectors are summed up over the steps that some candidate stretch covers.
            covered = np.zeros(end - start + 1, np.int64)
            np.add.at(covered, lo - start, 1)
            np.add.at(covered, hi - start, -1)
            at = np.flatnonzero(np.cumsum(covered)[:-1])
            sums = np.zeros((end - start + 1, scaled.shape[1]))
            for a in range(0, len(at), 256):
                sums[at[a : a + 256] + 1] = scaled[grid[at[a : a + 256] + start]].sum(axis=1)
            np.cumsum(sums, axis=0, out=sums)
            cosine, along = np.empty(len(one)), np.empty(len(one))
            for a in range(0, len(one), _PAIRS):
                o, i = one[a : a + _PAIRS], item[a : a + _PAIRS]
                own = sums[np.minimum(window[o] + 2, first[row[o] + 1]) - start] - sums[window[o] - start]
                around = sums[hi[a : a + _PAIRS] - start] - sums[lo[a : a + _PAIRS] - start]
                own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-30)
                best, most = np.full(len(o), -np.inf), np.full(len(o), -np.inf)
                for turn in range(int(n_pieces[i].max())):
                    has = np.flatnonzero(n_pieces[i] > turn)
                    piece = of_item[i[has]] + turn
                    best[has] = np.maximum(best[has], (own[has] * latent[piece]).sum(axis=1))
                    most[has] = np.maximum(most[has], (around[has] * latent[piece]).sum(axis=1) / length[piece])
                cosine[a : a + _PAIRS], along[a : a + _PAIRS] = best, most
            near = (cosine >= COSINE) | (along >= ALONG)
            yield row[one[near]], item[near], lo[near], hi[near], cosine[near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "cosine", "overlap", "answer_overlap"]
        for batch in batches:
            docs, out = batch.column(0).to_pylist(), []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                open_ = able(*_ids(part))
                rows = np.flatnonzero(open_.any(axis=1))
                if not len(rows):
                    continue
                part, open_ = part.take(pa.array(rows)), open_[rows]
                ids, step, first = _ids(part)
                best: dict[tuple[int, int], tuple] = {}
                for hits in candidates(ids, step, first, open_):
                    for r, i, lo, hi, cosine in zip(*(h.tolist() for h in hits), strict=True):
                        text = np.frombuffer(part.column(1)[r].as_buffer(), np.int32)[(lo - first[r]) * STEP : (hi - first[r]) * STEP]
                        near, item = text[text > 0].tolist(), items[i]
                        held = set(near)
                        if sum(w in held for w in item) < PARAPHRASED * len(item):
                            continue  # no subsequence holds more than the words that both have
                        overlap = common_length(item, near) / len(item)
                        if overlap < PARAPHRASED:
                            continue
                        goal = answer_of(item)
                        answer = common_length(goal, near) / len(goal)
                        if overlap >= LEAKED or (answer >= ANSWERED and hi - lo <= 2 + 2 * stretches(len(item))[0]):
                            old = best.get((r, i), (cosine, 0.0, 0.0))
                            best[r, i] = (max(cosine, old[0]), *max((overlap, answer), old[1:]))
                out += [(docs[at + rows[r]], numbers[i], *values) for (r, i), values in best.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((kind, pa.int64(), *[pa.float64()] * 3))], names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, kind: str = "long") -> DataFrame:
    """doc_id, item_id, cosine, overlap and answer_overlap of every document that holds a benchmark item.

    ``kind`` is the type of doc_id, long or string.
    """
    schema = f"doc_id {kind}, item_id long, cosine double, overlap double, answer_overlap double"
    source = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.lower("text").alias("text"))
    queries = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    blocks = -(-queries.count() // ITEMS)
    # Not from an empty list, which Python workers of another kind would read, and these stay.
    out = docs.sparkSession.range(0).selectExpr(*(f"CAST(null AS {of}) AS {name}" for name, of in (c.split() for c in schema.split(", "))))
    for block in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id").collect()
        hashed = _hashes([r["text"] for r in rows])
        vocabulary = np.unique(np.concatenate([*hashed, np.zeros(0, np.uint64)]))
        if not len(vocabulary):
            continue
        items = [(np.searchsorted(vocabulary, h) + 1).tolist() for h in hashed]
        kept = [(r["item_id"], i) for r, i in zip(rows, items, strict=True) if i]
        encoded = stored(source.mapInArrow(_numbered(vocabulary), f"doc_id {kind}, ids binary"), "numbered")
        size = len(vocabulary) + 1
        together = stored(together_of(encoded, size), "together")
        held = np.zeros(size)
        for r in together.mapInArrow(_diagonal(size), "id long, n long").collect():
            held[r[0]] = r[1]
        passages, held[0] = held[0], 0
        weight = weights(passages, held)
        basis = directions(together, weight)
        out = out.union(stored(encoded.mapInArrow(_matches(pa.int64() if kind == "long" else pa.string(), weight, basis, [k for k, _ in kept], [i for _, i in kept]), schema), "leaks"))
        forget(encoded, together)
    return out


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in the documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
