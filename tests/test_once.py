import numpy as np
from pyspark.sql import functions as F

from detframe.plans.once import once, rounded
from detframe.queries import records


def test_rounding_many_columns_at_once_equals_round(spark):
    rng = np.random.default_rng(4)
    values = [0.0, -0.0, 2.5e-6, 1.0000005, -1.0000005, 0.1234565, 1e300, -1e15, float("nan"), float("inf"), None, 1e-320,
              *map(float, rng.normal(size=300)), *[k / 2e6 for k in range(-150, 150)], *[int(k) + 0.5 for k in rng.integers(-9, 9, 20)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    got = rounded(df.select("id", F.col("x").alias("y")), {"a": F.col("y"), "b": F.col("y") * 3}, 6).orderBy("id").collect()
    want = df.select("id", F.round("x", 6).alias("a"), F.round(F.col("x") * 3, 6).alias("b")).orderBy("id").collect()
    assert [(repr(r.a), repr(r.b)) for r in got] == [(repr(r.a), repr(r.b)) for r in want]


def _written(df, word):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count(word)


def test_deltas_are_rounded_in_one_pass(spark, sf):
    assert _written(records.box_deltas(spark, sf), " round(") == 0


def test_once_replaces_and_adds(spark):
    df = once(spark.createDataFrame([(1, 2.0)], "a int, b double"), {"b": F.col("b") + 1, "c": F.lit("x")})
    assert df.columns == ["a", "b", "c"] and tuple(df.first()) == (1, 3.0, "x")
