"""Quality by compression: which of two dictionaries describes a text in fewer bytes.

One zstandard dictionary is trained on good and one on bad labelled texts. A text is cut into blocks,
each block is compressed with either dictionary, and the difference of the summed sizes, normalised to
``(bad - good) / bytes of text``, is turned into a probability by a logistic fit on labelled rows that
trained no dictionary. Blocks keep long texts as sharp as short ones and bound the memory of a task.

The fit uses a bounded sample: ``PER_CLASS`` labelled rows of each class, the lowest hashes of their
ids, of texts up to ``LONGEST`` bytes; the share of good rows comes from all labelled rows. Every text
is scored whole.

Defined results: null and empty texts compress to nothing and get the score of difference zero; rows
with null labels train nothing; a repeated id is scored per row and teaches with the least of its texts; labels of one class only, or none,
give every text the share of good rows (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

PER_CLASS = 2000
LONGEST = 20_000
DICTIONARY = 64 << 10
BLOCK = 512
LEVEL = 3
THRESHOLD = 0.3
MODULUS, HELD_OUT = 5, 0


def sample(docs: DataFrame, labels: DataFrame, learn: bool = True) -> DataFrame:
    """(text, quality, part) of at most PER_CLASS learnable labelled rows of each class."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"), MODULUS, HELD_OUT)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality", F.xxhash64(F.col("doc_id").cast("string")).alias("h"))
    texts = docs.where("text is not null").where(F.octet_length("text").between(1, LONGEST)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fit = texts.select("doc_id").join(known, "doc_id").distinct()  # ids only: lengths come from the scan
    one, two = (fit.where(F.col("quality") == q).orderBy("h", "doc_id").limit(PER_CLASS) for q in (0, 1))
    # One text an id, however often the id repeats, so the rows are bounded as the ids are.
    chosen = texts.join(F.broadcast(one.union(two)), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"), F.first("h").alias("h"))
    return chosen.select("doc_id", "text", "quality", (F.pmod("h", F.lit(4)) == 0).alias("calibrate"))


def blocks(text: bytes) -> list[bytes]:
    """A text in blocks; the last takes a short rest."""
    n = max(1, len(text) // BLOCK)
    cut = [len(text) * i // n for i in range(n + 1)]
    return [text[a:b] for a, b in zip(cut, cut[1:], strict=False)] if text else []


def trained(texts: list[bytes]) -> bytes:
    """A dictionary of about DICTIONARY bytes, or as much as the texts allow."""
    parts = [b for t in texts for b in blocks(t)]
    size = min(DICTIONARY, sum(map(len, parts)) // 10)
    try:
        return zstandard.train_dictionary(size, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(parts)[-DICTIONARY:]


class Compressors:
    """The two compressors of a task."""

    def __init__(self, good: bytes, bad: bytes):
        self.both = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (good, bad)]

    def difference(self, text: bytes) -> float:
        """(bad - good) / bytes of the summed block sizes; 0 without text."""
        good, bad = (sum(len(c.compress(b)) for b in blocks(text)) for c in self.both)
        return (bad - good) / len(text) if text else 0.0


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a lightly damped logistic fit by Newton steps, classes weighing the same."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    design, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 1e-6 * beta
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2), grad)
        beta = beta + np.clip(step, -20, 20)
    return float(beta[0]), float(beta[1])


class Model:
    """Dictionaries and calibration, fitted on the driver from the bounded sample."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        learnable = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id"), MODULUS, HELD_OUT))
        n, ones = learnable.agg(F.count("*"), F.sum("quality")).first()
        self.share = ones / n if n else 0.5
        rows = [(r["text"].encode(), r["quality"], r["calibrate"]) for r in sample(docs, labels).collect()]
        parts = {(q, c): [t for t, quality, cal in rows if (quality, cal) == (q, c)] for q in (0, 1) for c in (False, True)}
        self.dictionaries = None
        if all(parts.values()):
            self.dictionaries = tuple(trained(sorted(parts[q, False])) for q in (1, 0))
            tool = Compressors(*self.dictionaries)
            x = np.array([tool.difference(t) for q in (0, 1) for t in parts[q, True]])
            y = np.array([q for q in (0, 1) for _ in parts[q, True]], float)
            self.beta = logistic(x, y)
            self.prior = float(np.log(self.share / (1 - self.share)))

    def scores(self, docs: DataFrame) -> DataFrame:
        """doc_id, score and difference of every row."""
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        if not self.dictionaries:
            return source.select("doc_id", F.lit(self.share).alias("score"), F.lit(0.0).alias("difference"))
        (good, bad), (b0, b1), prior = self.dictionaries, self.beta, self.prior

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = Compressors(good, bad)
            for batch in batches:
                x = np.array([tool.difference(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1).cast(pa.large_binary())], float)
                score = 1 / (1 + np.exp(-np.clip(b0 + b1 * x + prior, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(x)], ["doc_id", "score", "difference"])

        return source.mapInArrow(run, "doc_id long, score double, difference double")


    def good(self, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """The rows of ``docs``, with all their columns, that score at least ``threshold``; nothing is shuffled."""
        if not self.dictionaries:
            return docs if self.share >= threshold else docs.limit(0)
        (good, bad), (b0, b1), prior, at = self.dictionaries, self.beta, self.prior, docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = Compressors(good, bad)
            for batch in batches:
                x = np.array([tool.difference(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(at).cast(pa.large_binary())], float)
                yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(b0 + b1 * x + prior, -30, 30))) >= threshold, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)


def op1_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return Model(docs, labels).scores(docs).select("doc_id", held_out(F.col("doc_id"), MODULUS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference")
