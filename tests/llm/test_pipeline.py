"""Each stage of the pipeline against a plain version of its decision, on the smallest tables."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from wedgeworks.llm import mixing, quality
from wedgeworks.llm.common import stored

from .helpers import DOCS, near_groups, prose

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), name.replace(" ", "-")))
        if name != "sharding":
            assert kept[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    scores = quality.Model(docs, spark.read.parquet(f"{SF}/labels.parquet")).scores(docs).collect()
    assert ids[1] == {r["doc_id"] for r in scores if r["score"] >= quality.THRESHOLD}
    groups = near_groups([tuple(r) for r in kept[1].select("doc_id", "text").collect()], 5, 80)
    assert ids[2] == {i for i, (_, c) in groups.items() if i == c}
    items = [" ".join(r["text"].lower().split()[1:-1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: " ".join((r["text"] or "").lower().split()) for r in kept[2].collect()}
    assert ids[3] == {i for i, t in texts.items() if not any(x in t for x in items)}
    kept[3].coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    sql = mixing.OP6_SQL.replace(f"* {mixing.SHARE})", f"* {corpus_pipeline.MIX_SHARE})").replace(f"::BIGINT * {mixing.MAX_EPOCHS} AS lim", f"::BIGINT * {corpus_pipeline.MIX_EPOCHS} AS lim").replace(f"range({mixing.MAX_EPOCHS})", f"range({corpus_pipeline.MIX_EPOCHS})")
    assert ids[4] == {r[0] for r in con.sql(sql).fetchall()}
    assert ids[5] == ids[4] and len(ids[4]) < len(ids[3])


def test_null_and_repeated_ids(spark):
    rng = random.Random(5)
    one, two, three, clean, alone = (prose(rng, 120) for _ in range(5))
    leak = f"{prose(rng, 40)} {spark.read.parquet(f'{SF}/benchmark.parquet').orderBy('item_id').first()['text']} {prose(rng, 40)}"
    rows = [(1, one), (None, one), (2, f"{one} more"), (None, two), (None, two), *[(3, three)] * 30, (4, three), (4, clean), (None, alone), (5, None), (5, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], DOCS).repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(1, one), (None, two), (3, three), (4, clean), (None, alone), (5, None), (5, None), (None, None)], key=str)
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in [(None, leak), (7, leak), (7, clean), (None, alone), (8, None)]], DOCS)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_leaks(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(7, clean), (None, alone), (8, None)], key=str)


def test_mix_of_null_and_repeated_ids(spark, monkeypatch):
    """Half of the rows have no id, one row occurs 300 times, and one id has many texts: the budget holds for all alike."""
    monkeypatch.setattr(corpus_pipeline, "MIX_SHARE", 0.5)
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(20, 60)) for _ in range(1500)]
    rows = [(None, t) for t in texts] + list(enumerate(texts)) + [(9999, texts[0])] * 300 + [(8888, prose(rng, 40)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0, {"a": 1}) for i, t in rows], DOCS + ", extra map<string,int>").repartition(3)
    docs = stored(docs, "mix-test")
    size = lambda t: (len(t.encode()) + 3) // 4
    budget = sum(size(t) for _, t in rows) // 2
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    total = sum(size(t) for _, t in got)
    assert budget - 200 < total <= budget
    for some, n in ((None, 1500), (9999, 300), (8888, 200)):
        assert 0.35 * n < sum(i == some for i, _ in got) < 0.65 * n
    assert sorted(got, key=str) == sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()), key=str)
    docs = stored(docs.where("doc_id is null or doc_id > 1499").unionByName(docs.where("doc_id = 9999").limit(5)), "dedup-test")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.where("doc_id = 9999").count() == 1 and kept.columns == docs.columns


def test_stages_of_nothing_and_of_extra_columns(spark):
    rng = random.Random(6)
    extra = ", by long, of string, stays boolean, chosen long, root long, n int, key string"
    rows = [(i, prose(rng, 80) if i % 5 else None, "en", "src1", 0, 1, "x", True, 2, 3, 4, "k") for i in range(20)]
    rows += [rows[1], rows[1]]
    docs = spark.createDataFrame(rows, DOCS + extra)
    for name, stage in corpus_pipeline.STAGES:
        if name != "sharding":
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns and got.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, docs, SF).count() == 20
    assert corpus_pipeline.deal_shards(spark, docs, SF).count() == 22
