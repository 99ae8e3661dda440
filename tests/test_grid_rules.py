"""Column rules on hand-computed rows, with NULL and the bounds of every range."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from thermagrid.functions import calendar, projections, radiometry


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_dekads_at_their_edges(spark):
    days = [dt.date(2019, 1, 10), dt.date(2019, 1, 11), dt.date(2019, 1, 20), dt.date(2019, 1, 21), dt.date(2019, 2, 28), dt.date(2020, 2, 29), dt.date(2019, 12, 31), None]
    got = values(spark, [(d,) for d in days], "d date", n=calendar.dekad_num(F.col("d")), e=calendar.dekad_end(F.col("d")))
    assert [g[0] for g in got] == [1, 2, 2, 3, 6, 6, 36, None]
    assert got[3][1] == dt.date(2019, 1, 31) and got[4][1] == dt.date(2019, 2, 28) and got[5][1] == dt.date(2020, 2, 29) and got[7][1] is None


def test_date_in_file_name(spark):
    got = values(spark, [("/a/20190230/x_20190228_y.tif",), ("/a/none.tif",), ("/a/20191345.tif",)], "p string", d=calendar.file_date(F.col("p")))
    assert got == [(dt.date(2019, 2, 28),), (None,), (None,)]


@pytest.mark.parametrize(
    ("use", "kept"),
    [("impute_train", [220.01, 330.0, 330.01, 349.99, 350.0]), ("cdf_train", [220.01, 330.0, 330.01, 349.99]), ("cdf_keep", [220.0, 220.01, 330.0, 330.01, 349.99, 350.0]), ("fused", [220.0, 220.01, 330.0])],
)
def test_ranges(spark, use, kept):
    rows = [(x,) for x in (219.99, 220.0, 220.01, 330.0, 330.01, 349.99, 350.0, 350.01, None)]
    df = spark.createDataFrame(rows, "v double")
    assert [r.v for r in df.where(radiometry.within(F.col("v"), use)).collect()] == kept


def test_missing_values_become_null(spark):
    rows = [(1.0,), (float("nan"),), (float("inf"),), (-9999.0,), (0.0,), (None,)]
    assert [v for (v,) in values(spark, rows, "v double", v=radiometry.clean(F.col("v"), -9999, 0))] == [1.0, None, None, None, None, None]


def test_confidence_weights(spark):
    rows = [(300.0 + d, 300.0) for d in (0, 2.999, 3, 4.25, 8, 8.001)] + [(None, 300.0)]
    got = [w for (w,) in values(spark, rows, "v double, t double", w=radiometry.confidence(F.col("v"), F.col("t")))]
    assert got[:6] == pytest.approx([1, 1, 1, 0.8, 0.2, 0.05]) and got[6] is None


def test_cloud_thresholds_by_surface(spark):
    def clear(diff, dem, ndvi):
        rows = [(300.0 + diff, 300.0, dem, ndvi)]
        return values(spark, rows, "v double, p double, m double, n double", c=radiometry.cloud_free(*map(F.col, "vpmn")))[0][0] is not None

    assert [clear(d, 100.0, 0.5) for d in (-7.9, -8.0, -8.1)] == [True, True, False]
    assert [clear(d, 4001.0, 0.5) for d in (-8.1, -18.0, -18.1)] == [True, True, False]
    assert clear(-10.0, 100.0, 0.04) and not clear(-10.0, None, None)


def test_scaled_short_rounds_half_to_even(spark):
    assert [v for (v,) in values(spark, [(0.5,), (1.5,), (2.5,), (None,)], "v double", v=radiometry.scaled_short(F.col("v"), 1, -1))] == [0, 2, 2, -1]


def test_hammer_there_and_back(spark):
    rows = [(lon * 1.0, lat * 1.0) for lon in (-170, -30, 0, 100) for lat in (-80, 0, 45)]
    x, y = projections.hammer_forward(F.col("lon"), F.col("lat"))
    df = spark.createDataFrame(rows, "lon double, lat double").withColumn("x", x).withColumn("y", y)
    lon, lat = projections.hammer_inverse(F.col("x"), F.col("y"))
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r.a, r.b) == (pytest.approx(r.lon, abs=1e-6), pytest.approx(r.lat, abs=1e-6))


def test_index_beyond_the_edge(spark):
    rows = [(-0.1,), (0.0,), (9.9,), (10.0,)]
    clamp = values(spark, rows, "x double", i=projections.grid_index(F.col("x"), 0.0, 1.0, 10), n=projections.grid_index(F.col("x"), 0.0, 1.0, 10, outside="null"))
    assert clamp == [(9, None), (0, 0), (9, 9), (9, None)]
