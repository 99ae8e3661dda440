"""Operators against dense numpy loops and their invariants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermagrid.operators import cdf, downscale, joins, mosaic, resample, timeseries
from thermagrid.sources import grids

DAY = dt.date(2024, 1, 1)


def pixels(spark, array, day=DAY, name="v"):
    rows = [(day, r, c, None if np.isnan(array[r, c]) else float(array[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, f"d date, r int, c int, {name} double")


def dense(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.r, r.c] = np.nan if r[name] is None else r[name]
    return out


@pytest.mark.parametrize(("method", "expected"), [("max", 5.0), ("min", 0.0), ("mean", 7 / 3), ("first", 2.0), ("last", 0.0)])
def test_mosaic_skips_missing(spark, method, expected):
    rows = [(DAY, 0, 0, "a", None), (DAY, 0, 0, "b", 2.0), (DAY, 0, 0, "c", 5.0), (DAY, 0, 0, "d", 0.0), (DAY, 0, 1, "a", None)]
    got = {(r.r, r.c): r.v for r in mosaic.mosaic(spark.createDataFrame(rows, "d date, r int, c int, scene string, v double"), method).collect()}
    assert got == {(0, 0): pytest.approx(expected), (0, 1): None}


def test_mosaic_rejects_unknown(spark):
    with pytest.raises(ValueError):
        mosaic.mosaic(spark.createDataFrame([(DAY, 0, 0, "a", 1.0)], "d date, r int, c int, scene string, v double"), "median")


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "bspline"])
def test_constant_survives_resizing(spark, method):
    fine = spark.createDataFrame([(r, c) for r in range(6) for c in range(6)], "r int, c int")
    got = dense(resample.resize(pixels(spark, np.full((3, 3), 7.0)), fine, "v", (3, 3), (6, 6), method), "v", (6, 6))
    assert np.allclose(got, 7)


def test_nearest_fill_is_exact_with_ties_to_the_smallest_cell(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((9, 11)) < 0.15, rng.random((9, 11)), np.nan)
    got = dense(resample.nearest_filled(pixels(spark, a), "v"), "v", a.shape)
    ok = [(r, c) for r in range(9) for c in range(11) if not np.isnan(a[r, c])]
    for r in range(9):
        for c in range(11):
            assert got[r, c] == a[min(ok, key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p))]


def test_nearest_fill_without_any_value(spark):
    assert np.isnan(dense(resample.nearest_filled(pixels(spark, np.full((2, 2), np.nan)), "v"), "v", (2, 2))).all()


def test_savgol_equals_padded_convolution(spark):
    x = np.random.default_rng(1).random(30)
    rows = [(DAY + dt.timedelta(i), 0, 0, float(v)) for i, v in enumerate(x)]
    got = [r.v for r in timeseries.smoothed(spark.createDataFrame(rows, "d date, r int, c int, v double"), "v").orderBy("d").collect()]
    for w in (timeseries.WIDE, *[timeseries.NARROW] * 3):
        h = len(w) // 2
        x = np.convolve(np.pad(x, h, mode="edge"), w[::-1], "valid")
    assert np.allclose(got, x)


def test_spline_recovers_a_parabola_and_its_sites():
    x = np.array([0, 1, 3, 4, 7, 9, 10], float)
    y = 2 * x * x - 3 * x + 1
    at = np.linspace(0, 10, 41)
    both = timeseries.quadratic_spline(np.stack([x, x]), np.stack([y, 2 * y]), np.stack([at, at]))
    assert np.allclose(both, [2 * at * at - 3 * at + 1, 2 * (2 * at * at - 3 * at + 1)])


def test_ssa_keeps_valid_values_and_gates(spark):
    t = np.arange(40)
    v = 280 + 5 * np.sin(t / 3)
    gone = np.isin(t, [5, 6, 20])
    rows = [(DAY + dt.timedelta(int(i)), 0, 0, None if g else float(x)) for i, x, g in zip(t, v, gone)]
    rows += [(DAY + dt.timedelta(int(i)), 1, 0, 280.0 if i < 4 else None) for i in t] + [(DAY + dt.timedelta(int(i)), 2, 0, 0.0) for i in t]
    got = {(r.r, (r.d - DAY).days): r.v for r in timeseries.ssa_filled(spark.createDataFrame(rows, "d date, r int, c int, v double"), "v").collect()}
    assert all(got[0, i] == pytest.approx(v[i], abs=0 if not gone[i] else 0.5) for i in t)
    assert got[1, 3] == 280 and got[1, 10] is None and got[2, 0] is None


def test_cdf_map_is_identity_on_itself_and_extends(spark):
    x = np.sort(np.random.default_rng(2).normal(290, 10, 300))
    df = spark.createDataFrame([(DAY, float(v), float(v) + 2) for v in x], "d date, tar double, ref double")
    knots = cdf.knots(df, n_quantiles=12, least=1)
    got = df.join(knots.withColumnsRenamed({"tar": "kt", "ref": "kr"}), "d").select(F.col("tar"), cdf.mapped(F.col("tar") - 5, F.col("kt"), F.col("kr")).alias("m")).collect()
    assert np.allclose([r.m - r.tar + 5 for r in got], 2)
    with pytest.raises(ValueError):
        cdf.knots(df)


def test_plane_recovers_coefficients_and_ignores_a_zero_layer(spark):
    rng = np.random.default_rng(4)
    rows = [(DAY, float(a), float(b), 2 * float(a) + 0.001 * float(b) + 270) for a, b in zip(rng.random(50), rng.random(50) * 5000)]
    fit = downscale.plane(spark.createDataFrame(rows, "d date, ndvi double, dem double, lst double")).first()
    assert (fit.a, fit.b, fit.k) == (pytest.approx(2), pytest.approx(0.001), pytest.approx(270))
    flat = spark.createDataFrame([(d, 0.0, b, 0.002 * b + 1) for d, _, b, _ in rows], "d date, ndvi double, dem double, lst double")
    fit = downscale.plane(flat).first()
    assert (fit.a, fit.b, fit.k) == (0, pytest.approx(0.002), pytest.approx(1))


def test_spine_pending_and_complete(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(3)], "d date")
    found = spark.createDataFrame([(DAY, 1), (DAY, 2), (DAY + dt.timedelta(2), 1)], "d date, x int")
    assert [(r.n, r.status) for r in joins.spined(days, found).orderBy("d").collect()] == [(2, "ok"), (0, "missing"), (1, "ok")]
    assert [r.d for r in joins.pending(days, found).collect()] == [DAY + dt.timedelta(1)]
    assert joins.complete(days, found).count() == 2


def test_tiles_hold_the_pixels_whatever_their_size(spark):
    a = np.where(np.random.default_rng(5).random((7, 9)) < 0.8, 1.5, np.nan)
    for tile in (2, 4, 16):
        assert np.array_equal(dense(grids.untiled(grids.tiled(pixels(spark, a), "v", tile), "v", tile), "v", a.shape), a, equal_nan=True)


def test_listing_and_daily_write(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, size in (("x_20240105.HDF", 2000), (".hidden_20240105", 2000), ("y_20240106.HDF", 10)):
        (tmp_path / "in" / name).write_bytes(b"0" * size)
    got = grids.listing(spark, str(tmp_path / "in"), least_bytes=1024).select("name", "d", grids.output_name(F.col("name"), "LST").alias("o")).collect()
    assert [tuple(r) for r in got] == [("x_20240105.HDF", dt.date(2024, 1, 5), "x_20240105_LST.tif")]
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    grids.write_daily(pixels(spark, np.ones((1, 2))), out)
    grids.write_daily(pixels(spark, np.ones((1, 2)), DAY + dt.timedelta(1)), out)
    assert spark.read.parquet(out).count() == 4
