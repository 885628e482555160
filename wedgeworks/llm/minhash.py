"""Near-duplicate groups by MinHash banding, signature and full-set checks, and star components.

A document's set holds its distinct word shingles. ``bands x rows`` universal hash minima sign a set;
documents that agree in a whole band are candidates. Equal sets fall together by a digest first and
count as one *node*, so thousands of copies cost no more than one, and buckets of the same nodes count as one
bucket. No bucket is expanded into pairs: every node is held against a few leaders of its bucket, links are
confirmed on the full sets and merged into components. Buckets that still hold several components and a pair
without a leader are then dealt into blocks, two to a task, with the nodes' full sets. The task compares
signatures of nodes of different components, skips what an earlier common band has compared, confirms the rest on
the sets and gives only the links that join two components: fewer than it has nodes. No link between components is
lost, but for a pair that passes the similarity while no band agrees, with 32 bands of 4 rows below 1e-10 at
0.85 and below 1e-7 at 0.8, or whose signature errs by five standard errors. The time of a bucket whose nodes
stay apart is quadratic in its nodes, spread over tasks, and a node's set goes to a task for every block of its
bucket, so n nodes that stay apart ship n * n / ``BLOCK`` sets.

Defined results: null text, empty text and text without words have an empty set and are linked with
nothing; rows with a null doc_id take part as all others do (a group without any id has a null component_id,
and its rows are kept); repeated rows share a group and a result each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, join_keyed, small, stored, table
from .components import components
from .words import chunks, shingle_sets

BANDS, ROWS = 32, 4
#: Standard errors by which a signature may fall below the similarity and still be checked further.
SLACK = 5
LEADERS = 3  #: of a bucket, against which every node of it is held
#: Nodes and shingles of a block; a bucket is dealt into blocks, and a task compares two of them.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 19
_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).view(np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.int64).view(np.uint64)
_M = _RNG.integers(0, 2**63, ROWS + 1, dtype=np.int64).view(np.uint64) | np.uint64(1)
_WIDTH = 2048


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over a set, 32 high bits."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _WIDTH):
        np.minimum(least, (hashes[None, at : at + _WIDTH] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return least >> np.uint64(32)


def set_key(hashes: np.ndarray) -> int:
    """64-bit digest of a set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.uint64) * _M[ROWS]
        for batch in batches:
            for first, end, data, at in chunks(batch.column(1)):
                n, keys, sigs, shorts, bands = [], [], [], [], []
                for hashes in shingle_sets(data, at, size):
                    n.append(len(hashes))
                    if not len(hashes):
                        keys.append(None), sigs.append(None), shorts.append(None), bands.append(None)
                        continue
                    sig = signature(hashes)
                    band = (sig.reshape(BANDS, ROWS) * _M[:ROWS]).sum(axis=1) + number
                    band ^= band >> np.uint64(29)
                    keys.append(set_key(hashes)), sigs.append(sig.astype(np.uint16).tobytes()), shorts.append(band.astype(np.uint32).tobytes()), bands.append(band.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, pa.binary()), pa.array(shorts, pa.binary()), pa.array(bands, pa.list_(pa.int64())), batch.column(2)[first:end]],
                    ["doc_id", "n_shingles", "key", "sig", "short", "bands", "digest"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for first, _, data, at in chunks(batch.column(1)):
                keys, sets = [], []
                for row, hashes in enumerate(shingle_sets(data, at, size), first):
                    if len(hashes):
                        keys.append(wanted[row]), sets.append(hashes.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "hashes"])

    return run


def _close(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                x, y = (x, y) if len(x) < len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _alike(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    return run


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and where each row's begin (and the last ends)."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), kind), np.cumsum([0, *map(len, blobs)]) // np.dtype(kind).itemsize


def linking(key: np.ndarray, root: np.ndarray, side: np.ndarray, sig: np.ndarray, bands: np.ndarray, sets: tuple[np.ndarray, np.ndarray], no: int, least: int, percent: int) -> list[tuple[int, int]]:
    """Links that join what is still apart among the nodes of a bucket (or of two blocks of it).

    A pair is looked at if its nodes are on different sides (or both on side 2), in different components so far,
    share no band before ``no`` and agree in ``least`` minima; it is a link if its full sets are similar enough.
    """
    values, at = sets
    ids = np.unique(values, return_inverse=True)[1]
    mark = np.zeros(len(values), bool)
    n = np.diff(at)
    part = np.unique(root, return_inverse=True)[1]
    out = []
    for i in range(len(key) - 1):
        far = np.flatnonzero((part[i + 1 :] != part[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2))) + i + 1
        far = far[(sig[far] == sig[i]).sum(axis=1) >= least] if len(far) else far
        far = far[~(bands[far, :no] == bands[i, :no]).any(axis=1)] if len(far) and no else far
        if not len(far):
            continue
        own = ids[at[i] : at[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[np.concatenate([ids[at[j] : at[j + 1]] for j in far])], np.concatenate(([0], np.cumsum(n[far])[:-1])), dtype=np.int64)
        mark[own] = False
        for j in far[100 * common >= percent * (n[i] + n[far] - common)].tolist():
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out.append((int(min(key[i], key[j])), int(max(key[i], key[j]))))
    return out


def _joined(least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                at = batch.column(1)[row].values
                key, root, side = (at.field(k).to_numpy() for k in ("key", "root", "side"))
                sig, bands = (_flat(at.field(k), kind)[0].reshape(len(key), -1) for k, kind in (("sig", np.uint16), ("short", np.uint32)))
                found = linking(key, root, side, sig, bands, _flat(at.field("hashes"), np.uint64), batch.column(0)[row].as_py(), least, percent)
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def digest() -> Column:
    """What a text is known by, next to the id, as ids may be null or repeat with other texts."""
    return F.md5("text").alias("digest")


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    one, two = (values.select(F.col("key").alias(k), F.col(name).alias(f"{name}_{k}")) for k in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", f"{name}_u", f"{name}_v")


class Search:
    """Candidates of one corpus, from buckets to confirmed links."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        similar = percent / 100
        self.least = int((similar - SLACK * (similar * (1 - similar) / (BANDS * ROWS)) ** 0.5) * BANDS * ROWS)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest())
        self.signed = stored(self.docs.mapInArrow(_signed(size), "doc_id long, n_shingles long, key long, sig binary, short binary, bands array<long>, digest string"), "signed")
        in_band = self.signed.select("key", F.posexplode("bands").alias("no", "band"))
        several = stored(in_band.groupBy("band").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("band"), "several")
        members = stored(in_band.join(small(several), "band").select("no", "band", "key").distinct(), "members")
        # Buckets of the same nodes are one, that of the first band; its members are known by two hashes of their keys.
        leader = F.array_distinct(F.array(*(F.min(F.struct(F.xxhash64(F.lit(turn), "key").alias("h"), "key")).getField("key") for turn in range(LEADERS))))
        buckets = members.groupBy("band", "no").agg(leader.alias("leaders"), F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(f"same{k}"), "key")).alias(f"x{k}") for k in (0, 1)))
        first = buckets.groupBy("n", "x0", "x1").agg(F.min(F.struct("no", "band", "leaders")).alias("b"))
        #: (band, no, leaders, n) of every bucket
        self.buckets = stored(first.select("b.band", "b.no", "b.leaders", "n"), "buckets")
        self.members = stored(join_keyed(members.select("band", "key"), self.buckets.select("band", "n"), ["band"], "n"), "bucket-members")
        nodes = small(stored(self.members.select("key").distinct(), "nodes"))
        #: signature and one row, known by id (or none) and digest, of every node that shares a bucket
        self.about = stored(self.signed.join(nodes, "key").groupBy("key").agg(F.max(F.struct("sig", "short", "n_shingles")).alias("m"), F.min(F.struct("digest", "doc_id")).alias("row")).select("key", "m.*", "row"), "about")
        forget(several, members)

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(key, hashes): the full set of every node, read again from one of its rows."""
        nodes = stored(nodes, "wanted-nodes")
        wanted = small(stored(self.about.join(small(nodes), "key").select("key", F.col("row.digest").alias("of"), F.col("row.doc_id").alias("by")), "wanted"))
        texts = self.docs.join(wanted, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("by"))).select("key", "text")
        return stored(texts.mapInArrow(_sets(self.size), "key long, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes")), "sets")

    def led(self) -> DataFrame:
        """Links of nodes with the leaders of their buckets: alike by signature, similar by full sets."""
        each = join_keyed(self.members, self.buckets.select("band", "leaders", "n"), ["band"], "n").select("key", F.explode("leaders").alias("lead")).where("key <> lead")
        pairs = each.select(F.least("key", "lead").alias("u"), F.greatest("key", "lead").alias("v")).distinct()
        pairs = stored(_with_both(pairs, self.about, "sig").mapInArrow(_alike(self.least), "u long, v long"), "alike")
        sets = self.sets(pairs.select(F.col("u").alias("key")).union(pairs.select(F.col("v").alias("key"))).distinct())
        out = stored(_with_both(pairs, sets, "hashes").mapInArrow(_close(self.percent), "u long, v long"), "links")
        forget(sets, pairs)
        return out

    def open(self, roots: DataFrame) -> DataFrame:
        """(band, key, root) of the buckets that hold several components and a pair without a leader."""
        wide = self.buckets.where(F.col("n") >= F.size("leaders") + 2).select("band", "n")
        labelled = join_keyed(self.members, stored(wide, "wide"), ["band"], "n").join(small(roots.withColumnRenamed("node", "key")), "key", "left").select("band", "key", F.coalesce("root", "key").alias("root"))
        labelled = stored(labelled, "labelled")
        mixed = stored(labelled.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where("a <> b").select("band", "n"), "mixed")
        out = stored(join_keyed(labelled, mixed, ["band"], "n"), "open")
        forget(labelled, mixed)
        return out

    def rest(self, members: DataFrame) -> DataFrame:
        """Links between components in one bucket, found and confirmed inside tasks: a bucket is dealt into blocks
        of bounded nodes and shingles, and a task gets two of them with their sets."""
        sets = self.sets(members.select("key").distinct())
        known = stored(self.about.select("key", "sig", "short", "n_shingles").join(sets, "key"), "known")
        sized = members.join(small(known.select("key", "n_shingles")), "key")
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
        counts = stored(sized.groupBy("band").agg(blocks, F.count("*").alias("n")).join(self.buckets.select("band", "no"), "band"), "block-counts")
        dealt = join_keyed(members, counts, ["band"], "n")
        own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
        # Block i meets block j in the task (i, j); a member's side there is 0 or 1, or 2 where i = j.
        dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long").alias("side")
        carried = dealt.select("band", "no", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "root", side).join(known.drop("n_shingles"), "key")
        grouped = carried.groupBy("band", "no", "i", "j").agg(F.collect_list(F.struct("key", "root", "side", "sig", "short", "hashes")).alias("g"))
        out = stored(grouped.select("no", "g").mapInArrow(_joined(self.least, self.percent), "u long, v long").distinct(), "links")
        forget(sets, known, counts)
        return out

    def roots(self) -> DataFrame:
        """(node, root) of every node that is linked."""
        links = self.led()
        roots = stored(components(links), "roots")
        left = self.open(roots)
        if left.isEmpty():
            return roots
        return stored(components(links.union(self.rest(left))), "roots")


def groups(docs: DataFrame, size: int, percent: int, first: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with doc_id, digest, n_shingles, key (of the set; null without words); and (key, first, n) of the sets
    that have several rows, or links: the least ``first`` of the rows' group, and how many rows the set has.

    Sets are named before they are joined to rows, so a group's rows never meet.
    """
    search = Search(docs, size, percent)
    rows = search.signed.select("doc_id", "digest", "n_shingles", "key")
    roots = search.roots().select(F.col("node").alias("key"), "root")
    keys = stored(rows.where("key is not null").groupBy("key").agg(F.min(first).alias("own"), F.count("*").alias("n")), "keys")
    linked = stored(keys.join(small(roots), "key"), "linked")
    by_root = stored(linked.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("m")), "by-root")
    together = join_keyed(linked.select("key", "n", "root"), by_root, ["root"], "m").select("key", "first", "n")
    alone = keys.where("n > 1").join(small(roots), "key", "left_anti").select("key", F.col("own").alias("first"), "n")
    return rows, stored(together.union(alone), "named")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    ``size`` words make a shingle; documents are linked from ``percent`` per cent of Jaccard similarity.
    """
    rows, named = groups(docs, size, percent, F.col("doc_id"))
    out = join_keyed(rows, named, ["key"], "n", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents on three-word shingles at 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
