"""Files: MatrixMarket text, result tables, side tables."""

import random
import re as python_re

import numpy as np
import pyarrow as pa
import pytest

from wedgeworks.operators import results as re
from wedgeworks.plans import blocks as bl
from wedgeworks.sources import mtx, packed
from wedgeworks.sources import tables as ta

HEAD = "%%MatrixMarket matrix coordinate real symmetric\n% comment\n\n"


def test_read_mtx(spark, tmp_path):
    (tmp_path / "a.mtx").write_text(HEAD + "5 5 3\n1 2 0.5\n% in between\n\n3  1 7 8\n5 5\n")
    (tmp_path / "b.mtx").write_text("40 40 1\n40 1\n")
    rows = {(r["file"].rsplit("/")[-1], r["src"], r["dst"]) for r in mtx.read_mtx(spark, str(tmp_path)).collect()}
    assert rows == {("a.mtx", 0, 1), ("a.mtx", 2, 0), ("a.mtx", 4, 4), ("b.mtx", 39, 0)}


def test_file_over_splits(spark, tmp_path):
    n = 20000
    (tmp_path / "a.mtx").write_text(HEAD + f"{n + 1} {n + 1} {n}\n" + "".join(f"{i + 1} {i + 2}\n" for i in range(n)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = mtx.read_mtx(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 3
        assert sorted((r["src"], r["dst"]) for r in rows.collect()) == [(i, i + 1) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


@pytest.mark.parametrize("line", ["0 1", "6 1", "1 x"])
def test_ids_outside(spark, tmp_path, line):
    (tmp_path / "a.mtx").write_text(f"5 5 1\n{line}\n")
    with pytest.raises(Exception, match="outside the matrix"):
        mtx.read_mtx(spark, str(tmp_path)).collect()


def test_catalog(spark, tmp_path):
    for name, text in {"sq": HEAD + "4 4 2\n", "rect": "4 5 2\n", "two": "4 4\n", "word": "a 4 4\n", "none": "% only\n\n"}.items():
        (tmp_path / f"{name}.mtx").write_text(text)
    catalog = mtx.mtx_catalog(mtx.read_lines(spark, str(tmp_path)))
    got = {r["file"].rsplit("/")[-1][:-4]: tuple(r)[1:] for r in catalog.collect()}
    assert got == {"sq": (True, 4, 4, 2), "rect": (False, 4, 5, 2), "two": (False, -1, -1, -1), "word": (False, -1, -1, -1), "none": (False, -1, -1, -1)}
    with pytest.raises(ValueError, match="4 x 5"):
        mtx.require_square(catalog)


def test_results_round_trip(spark, tmp_path):
    row = ("g", 5, 9, 0.5, 1.5, 64, 3, 7, 2.5, 4, 2.8)
    df = spark.createDataFrame([row], ta.RESULTS["multi"])
    path = str(tmp_path / "results")
    ta.append_results(df, path, "multi")
    ta.append_results(df, path, "multi")
    assert [tuple(r) for r in ta.read_results(spark, path, "multi").collect()] == [row, row]
    with pytest.raises(ValueError, match="columns differ"):
        ta.append_results(df.drop("gpus"), path, "multi")
    ta.results_report(ta.read_results(spark, path, "multi"), str(tmp_path / "report"), ["graph"])
    assert [r[0].split("\t")[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["graph", "g", "g"]


def test_side_tables(spark):
    text = spark.createDataFrame([('{"a": 3, "b": 5}',)], "value string")
    assert sorted(map(tuple, ta.read_partitions(text).collect())) == [("a", 3), ("b", 5)]
    names = spark.createDataFrame([("x",), (" g/y.mtx ",), ("",), ("z/g/w",)], "value string")
    assert sorted(map(tuple, ta.read_names(names).collect()), key=str) == [("g", "w"), ("g", "y"), (None, "x")]


def test_limit_of_zero_is_none(spark):
    names = spark.createDataFrame([("b",), ("a",)], "name string")
    assert re.limit_graphs(names, 0).count() == 2
    assert [r[0] for r in re.limit_graphs(names, 1).collect()] == ["a"]


def test_tasks(spark):
    """Groups stay below the threshold; a block that reaches it opens the next group."""
    matrix = spark.createDataFrame([(1, 0, 4), (2, 0, 5), (3, 0, 20), (4, 0, 1)], "r_block long, c_block long, nnz long")
    plan = bl.plan_tasks(bl.cumulative_block_matrix(matrix, 5), 10)
    zero = [r["high_blocks"] for r in plan.where("mid_block = 0").orderBy("task_id").collect()]
    assert zero == [[0], [1, 2], [3], [4]]
    assert [r["mid_block"] for r in plan.orderBy("task_id").collect()][:5] == [4, 3, 2, 1, 0]


def test_one_block_at_least():
    assert bl.block_size(2000, 8) == 256
    assert bl.block_size(20000, 8) == 2528
    assert bl.block_size(3, 64) == 32


# ---- compressed successor lists


def test_varints():
    rng = random.Random(1)
    values = [0, 1, 127, 128, 16383, 16384, 2**62, 2**63 - 1] + [rng.randrange(2 ** rng.randint(1, 63)) for _ in range(2000)]
    assert packed.numbers(packed.varints(np.array(values))).tolist() == values
    assert packed.varints(np.array([300])) == b"\xac\x02" and packed.varints(np.zeros(0, int)) == b""


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_packed(spark, tmp_path, block):
    rng = random.Random(2)
    rows = [(rng.randrange(50), rng.randrange(-(2**40), 2**60)) for _ in range(300)] + [(7, k) for k in range(100)] + [(7, 5)] * 3 + [(-(2**50), 3), (2**61, 2**61), (2**61, -4)]
    edges = spark.createDataFrame([*rows, (None, 1), (1, None)], "src long, dst long").repartition(3)
    path = str(tmp_path / "packed")
    packed.write_packed(edges, path, block)
    assert sorted(map(tuple, packed.read_packed(spark, path).collect())) == sorted(rows)
    assert sorted(map(tuple, packed.read_packed(spark, path, 5, 9).collect())) == sorted(r for r in rows if 5 <= r[0] <= 9)
    assert tuple(packed.packed_size(spark, path).first()) == (len({a for a, _ in rows}), len(rows))


def test_a_range_reads_its_blocks(spark, tmp_path):
    path = str(tmp_path / "packed")
    packed.write_packed(spark.range(10_000).selectExpr("id AS src", "id + 1 AS dst"), path, 50)
    assert packed.packed_blocks(spark, path).count() >= 200
    assert packed.packed_blocks(spark, path, 4000, 4099).count() <= 4
    plan = packed.read_packed(spark, path, 4000, 4099)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(last), IsNotNull(first), GreaterThanOrEqual(last,4000), LessThanOrEqual(first,4099)]" in plan
    assert "lists" not in packed.packed_size(spark, path)._jdf.queryExecution().executedPlan().toString()
    lists = packed.packed_blocks(spark, path).selectExpr("sum(octet_length(lists))").first()[0]
    assert lists < 5 * 10_000  # an edge to the next vertex takes four bytes or so, not sixteen


def test_nothing_packed(spark, tmp_path):
    path = str(tmp_path / "packed")
    packed.write_packed(spark.createDataFrame([], "src long, dst long"), path)
    assert packed.read_packed(spark, path).count() == 0 and tuple(packed.packed_size(spark, path).first()) == (0, 0)


# ---- all or nothing


def test_a_failed_append_leaves_nothing(spark, tmp_path):
    row = ("g", 5, 9, 0.5, 1.5, 64, 3, 7, 2.5, 4, 2.8)
    df, path = spark.createDataFrame([row] * 8, ta.RESULTS["multi"]), str(tmp_path / "results")
    assert ta.read_results(spark, path, "multi").count() == 0
    assert ta.append_results(df, path, "multi", "run-1")

    def broken(batches):
        for k, batch in enumerate(batches):
            yield batch
            if pa.types.is_string(batch.column(0).type) and batch.column(0)[0].as_py() == "bad":
                raise RuntimeError("lost")

    half = df.union(spark.createDataFrame([("bad", *row[1:])], ta.RESULTS["multi"])).mapInArrow(broken, ta.RESULTS["multi"])
    with pytest.raises(Exception, match="lost"):
        ta.append_results(half, path, "multi", "run-2")
    assert ta.read_results(spark, path, "multi").count() == 8
    assert ta.append_results(df.limit(2), path, "multi", "run-2")  # the same batch, repeated as a whole
    assert not ta.append_results(df.limit(2), path, "multi", "run-2")
    assert not ta.append_results(df, path, "multi", "run-1")
    assert ta.read_results(spark, path, "multi").count() == 10
    with pytest.raises(ValueError, match="no name"):
        ta.append_results(df, path, "multi", "../x")


# ---- denied names


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [("abc", "abc"), ("^web-.*graph$", "graph"), (r"a\.bcd", "a.bcd"), ("abcd*e", "abc"), ("abcd+efg", "abcd"), ("colou?r", "colo"), ("(xyz)abc", "abc"), ("[abc]defg", "defg"), ("[^]a]bcd", "bcd"), ("abc|def", ""), ("(?i)abc", ""), (r"\d+abc\w", "abc"), ("a{2}bcd", "bcd"), ("ab{0,3}", "a"), (r"\Qa.b\E", ""), (r"\x41bcd", ""), (r"(a)bcd\1", ""), (".", ""), ("", ""), (r"a\\bc", r"a\bc"), ("(a(bcd)e)fgh", "fgh")],
)
def test_required_literal(pattern, literal):
    assert re.required_literal(pattern) == literal


def test_deny_filter(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abc./-") for _ in range(rng.randint(0, 9))) for _ in range(400)] + ["", "ab", "é中abc"]
    patterns = ["^ab", r"c\.a", "a/b+c", "abc?a", "-b-c", "[ab]c-", "bca$", "zzz", "(ab)+cab", "b.c/a", "ccc|aaa"]
    table = spark.createDataFrame([(n, k) for k, n in enumerate([*names, *names[:50], None])], "name string, gram int")
    for some in (patterns, patterns[1:4], patterns[7:8], ["a"], []):
        got = re.deny_filter(table, spark.createDataFrame([(p,) for p in [*some, *some, None]], "pattern string"))
        want = [n for n in [*names, *names[:50]] if not any(python_re.search(p, n) for p in some)]
        assert got.columns == table.columns
        assert sorted(r["name"] or "" for r in got.collect()) == sorted([*want, ""])


def test_very_many_patterns(spark):
    patterns = spark.range(50_000).selectExpr("concat('name', id, '[.]x') AS pattern")
    names = spark.range(0, 4_000).selectExpr("concat('name', id * 25, if(id % 2 = 0, '.x', '.y')) AS name")
    got = re.deny_filter(names, patterns)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 4_000 - 1_000
    with pytest.raises(ValueError, match="without three"):
        re.deny_filter(names, spark.range(10_001).selectExpr("concat('(', id, ')') AS pattern"))
