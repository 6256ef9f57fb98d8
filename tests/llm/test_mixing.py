import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from detframe.llm import mixing
from detframe.llm.common import documents

SCHEMA = T.StructType([T.StructField("p", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("size", T.StringType())])


def brute_targets(sizes):
    """Round after round: cap, share the excess by weight."""
    names = sorted((s for s in sizes if s is not None), key=str) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        each = left / sum(weight[s] for s in free)
        over = [s for s in free if each * weight[s] > 3 * sizes[s]]
        for s in over or free:
            target[s] = 3.0 * sizes[s] if over else each * weight[s]
        left -= sum(target[s] for s in over)
        free = free - set(over) if over else set()
    return target


def check(rows, sizes, largest):
    want = brute_targets(sizes)
    taken = {}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 * want[s]


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def table(data):
    sizes, largest = {}, {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + words(t)
        largest[s] = max(largest.get(s, 0), words(t))
    return sizes, largest


@pytest.mark.parametrize("block", [4, 128])
def test_targets_are_met(spark, block):
    data = [(i, "w " * (i * 37 % 91 + 1), s) for i in range(400) for s in [["hot", "hot", "b", None, "tiny"][i % 5] if i % 5 != 4 or i < 20 else "é"]]
    data += [(900, None, "b"), (901, "", "hot"), (902, " \n", "only empty"), (903, "x", None), (7, "w w", "hot"), (7, "w w", "hot"), (None, "z z z", "hot")]
    df = spark.createDataFrame([("x", i, t, s, "y") for i, t, s in data], SCHEMA).repartition(3)
    first = mixing.mixed(df, block=block).collect()
    check(first, *table(data))
    again = mixing.mixed(df.repartition(7), block=block).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken, str(r.source))
    assert sorted(map(key, first)) == sorted(map(key, again)) and len(first) == len(data)


def test_whole_table_and_stage(spark, sf):
    docs = documents(spark, sf)
    rows = mixing.mixed(docs).collect()
    check(rows, *table([(r.doc_id, r.text, r.source) for r in docs.collect()]))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in rows if r.copies}


def test_expectation_is_kept(spark):
    df = spark.createDataFrame([("x", i, "w " * (1 + i % 4), "a" if i % 2 else "b", "") for i in range(60)], SCHEMA)
    share = [mixing.mixed(df, seed=s, block=8).where("source = 'a'").agg(F.sum(F.when(F.col("doc_id") < 30, F.col("copies")))).first()[0] for s in range(6)]
    goal = brute_targets(table([(i, "w " * (1 + i % 4), "a" if i % 2 else "b") for i in range(60)])[0])
    mean = 15 * goal["a"] / sum(1 + i % 4 for i in range(1, 60, 2))
    assert abs(sum(share) / 6 - mean) < 4


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).columns == empty.columns
    assert mixing.mix(empty).count() == 0


def test_many_equal_rows(spark):
    rows = spark.range(100_000).select(F.lit("x").alias("p"), F.lit(5).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.lit("a").alias("source"), F.lit("_at").alias("_at"))
    docs = rows.unionByName(spark.createDataFrame([("x", i, "w " * 50, "b", "y") for i in range(100, 500)], "p string, doc_id long, text string, source string, _at string"))
    taken = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("goal"), F.count("*").alias("rows")).collect()
    assert {r.source: r.rows for r in taken} == {"a": 100_000, "b": 400} and all(abs(r.n - r.goal) <= 50 for r in taken)
    assert mixing.mix(docs).columns == docs.columns
