import pytest
from pyspark.sql import functions as F

from detframe.functions import polygons as P
from detframe.queries import convert


def test_polygons_of_a_batch_are_measured_and_cut_apart(spark):
    rows = [(0, [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0]), (1, []), (2, None), (3, [9.0, 9.0, 10.0, 9.0, 10.0, 10.0]),
            (4, [1.0, 1.0, 5.0, 1.0, 1.0, 5.0, 7.0]), (5, [0.0, 0.0, 6.0, 0.0, 6.0, 6.0, 3.0, 2.0, 0.0, 6.0]), (6, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, p array<double>").coalesce(1)
    cut = P.crop(F.col("p"), F.lit(1), F.lit(1), F.lit(3), F.lit(4))
    got = df.select("id", P.area(F.col("p")).alias("area"), P.parts_area(F.array("p", "p")).alias("parts"), F.array(*P.bbox(F.col("p"))).alias("box"),
                    cut.alias("cut"), P.area(cut).alias("cut_area")).orderBy("id").collect()
    assert [r.area for r in got] == [16.0, 0.0, 0.0, 0.5, 8.0, 24.0, 0.0]
    assert [r.parts for r in got] == [2 * r.area for r in got]
    assert got[0].box == [0.0, 0.0, 4.0, 4.0] and got[2].box == [None] * 4 and got[4].box == [1.0, 1.0, 7.0, 5.0]
    assert sorted(zip(got[0].cut[::2], got[0].cut[1::2])) == [(0.0, 0.0), (0.0, 3.0), (2.0, 0.0), (2.0, 3.0)]
    assert all(got[i].cut == [0.0] * 6 for i in (1, 2, 3, 6))
    assert got[4].cut_area == pytest.approx(5.5) and [got[0].cut_area, got[3].cut_area] == [6.0, 0.0]


def test_measures_walk_no_list_of_a_cut_row_by_row(spark, sf):
    plan = convert.polygon_measures(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan.lower() and "zipwith" not in plan.lower()
