import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from detframe.functions import polygons as P
from detframe.operators import segments as S
from detframe.queries import layouts as Q

LONGS = pa.list_(pa.int64())


def test_strings_of_a_batch_read_back_with_nulls_and_slices():
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 10 ** int(rng.integers(1, 7)), int(n)).tolist() for n in rng.integers(0, 60, 300)] + [[], None, [2**40, 0, 5], [0]]
    text = P.encode_rle.func(pa.array(lists, LONGS))
    assert P.decode_rle.func(text).to_pylist() == lists
    assert P.decode_rle.func(text.slice(290, 13)).to_pylist() == lists[290:303]
    assert P.encode_rle.func(pa.array(lists, LONGS).slice(290, 13)).to_pylist() == text.to_pylist()[290:303]
    assert P.decode_rle.func(pa.array(["", None], pa.string())).to_pylist() == [[], None]
    assert P.encode_rle.func(pa.array([[], None], LONGS)).to_pylist() == ["", None]
    # as published: 5, 3 and 9 fit one character, later counts are differences to the one two before
    assert P.encode_rle.func(pa.array([[5, 3, 9, 3, 9]], LONGS)).to_pylist() == ["53900"]


def test_columns_of_boxes_equal_the_list_function(spark):
    rows = [(0.0, 0.0, 3.0, 2.0), (5.0, 4.0, 5.0, 9.0), (7.0, 9.0, 9.0, 9.0), (9.0, 1.0, 2.0, 5.0), (2.7, 1.2, 6.9, 3.9)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double").withColumn("height", F.lit(10).cast("long"))
    for r in df.select(P.box_columns("x1", "y1", "x2", "y2", "height").alias("a"), S.box_run_list().alias("b")).collect():
        assert r.a == r.b
    nothing = spark.createDataFrame([(None, 0.0, 3.0, 2.0)], "x1 double, y1 double, x2 double, y2 double").withColumn("height", F.lit(10).cast("long"))
    assert nothing.select(P.box_columns("x1", "y1", "x2", "y2", "height").alias("a")).first().a == []


def test_run_lists_of_mask_results_stay_out_of_the_plan(spark, sf):
    plan = Q.coco_mask_results(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and plan.count("decode_rle(") == 1
