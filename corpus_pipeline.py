"""A corpus pipeline: bad texts go, near copies go, benchmark leaks go, sources are mixed, and what is
left is dealt into shards.

Every stage takes and, but for the last, returns the columns of ``documents``. The near-duplicate and
benchmark stages know a row by its id and text, and the mix by its number as it is read, so null and repeated ids are
decided like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wedgeworks.llm import contamination, minhash, mixing, quality, sharding
from wedgeworks.llm.common import join_keyed, small, stored, table

#: The mix keeps at most one copy of a document and nine tenths of the tokens.
MIX_SHARE, MIX_EPOCHS = 0.9, 1


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the classifier's threshold."""
    return quality.Model(docs, table(spark, sf_dir, "labels")).good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group on five-word shingles at 0.8: of the smallest id, a null id being the largest."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    rows, named = minhash.groups(docs, 5, 80, first)
    grouped = join_keyed(rows, named, ["key"], "n").select(F.col("doc_id").alias("by"), F.col("digest").alias("of"), "first")
    stays = F.col("by").eqNullSafe(F.col("first.doc_id")) & (F.col("of") == F.col("first.digest"))
    marks = grouped.groupBy("by", "of").agg(F.first(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    marks = stored(marks.select(F.col("by").alias("_by"), F.col("of").alias("_of"), F.col("stays").alias("_stays")), "marks")
    seen = docs.withColumn("_digest", minhash.digest())
    seen = seen.join(small(marks), (F.col("_digest") == F.col("_of")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_by")), "left")
    out = seen.where("_stays is null").select(docs.columns)
    if marks.where("_stays").isEmpty():
        return out
    # Rows that repeat the id and text of the one that stays.
    return out.union(seen.where("_stays").groupBy("_by", "_of").agg(F.first(F.struct(*docs.columns)).alias("_row")).select("_row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, a text being known by its digest."""
    texts = docs.select(minhash.digest().alias("doc_id"), "text")
    found = contamination.leaks(texts, table(spark, sf_dir, "benchmark"), "string").select(F.col("doc_id").alias("_digest")).distinct()
    return docs.withColumn("_digest", minhash.digest()).join(small(found), "_digest", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows selected one by one by the target weights of domains, languages and sources.

    A row's place in the order comes from its id; where that is null or repeated, from id and text digest, and where these
    repeat too, from the row's own number.
    """
    rows = docs.withColumns({"_row": F.monotonically_increasing_id(), "_digest": minhash.digest()})
    keys = rows.groupBy(F.col("doc_id").cast("long").alias("_id"), F.col("_digest").alias("_of")).agg(F.count("*").alias("_n"))
    often = keys.groupBy(F.col("_id").alias("_often")).agg(F.sum("_n").alias("_rows")).where("_rows > 1 or _often is null").select("_often")
    often = stored(often, "repeated-ids")
    if often.isEmpty():
        rows = rows.withColumn("_by", F.col("doc_id").cast("string"))
    else:
        keys = stored(keys.join(small(often), F.col("_id").eqNullSafe(F.col("_often")), "left_semi"), "repeated-keys")
        rows = rows.join(small(keys), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_of")), "left")
        place = F.concat_ws(":", F.col("doc_id").cast("string"), F.hex("_digest"), F.when(F.col("_n") > 1, F.col("_row")).cast("string"))
        rows = rows.withColumn("_by", F.when(F.col("_n").isNull(), F.col("doc_id").cast("string")).otherwise(place))
    chosen = stored(mixing.mix(rows, share=MIX_SHARE, max_epochs=MIX_EPOCHS, row="_row", by="_by").select(F.col("doc_id").alias("_chosen")).distinct(), "chosen")
    return docs.withColumn("_row", F.monotonically_increasing_id()).join(small(chosen), F.col("_row") == F.col("_chosen"), "left_semi").select(docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, virtual slot, shard and position of every document."""
    return sharding.shard_documents(docs).select("doc_id", "size", "text_crc32", "vslot", "shard", "slot")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", deal_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each reading what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
