"""Composed operators against plain numpy loops: ranks, warps, series chains, fusion and status."""

import datetime as dt

import numpy as np
import pytest

from thermagrid.operators import cdf, joins, metrics, models, mosaic, resample, timeseries
from thermagrid.plans import queries
from thermagrid.sources import derived

DAY = dt.date(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def table(spark, array, name="v", day=DAY):
    rows = [(day, r, c, None if np.isnan(array[r, c]) else float(array[r, c])) for r in range(array.shape[0]) for c in range(array.shape[1])]
    return spark.createDataFrame(rows, f"d date, r int, c int, {name} double")


def dense(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.r, r.c] = np.nan if r[name] is None else r[name]
    return out


def test_ranks_and_percentiles_with_ties_and_constants(spark):
    rng = np.random.default_rng(1)
    days = {DAY: rng.normal(280, 9, 500).round(0), DAY + dt.timedelta(1): np.full(7, 5.0), DAY + dt.timedelta(2): np.array([3.0])}
    rows = [(d, k, 0, float(v)) for d, x in days.items() for k, v in enumerate(x)] + [(DAY, 900, 0, None)]
    df = spark.createDataFrame(rows, "d date, r int, c int, v double")
    got = cdf.ranked(df, "v", ("r", "c")).collect()
    for d, x in days.items():
        order = sorted(range(len(x)), key=lambda k: (x[k], k))
        assert [r.r for r in sorted((r for r in got if r.d == d), key=lambda r: r["rank"])] == order
    wanted = spark.createDataFrame([(d, k, p) for d in days for k, p in enumerate((0.0, 0.123, 0.5, 0.99, 1.0))], "d date, k int, p double")
    for r in cdf.percentiles(df, "v", wanted).collect():
        assert r.q == pytest.approx(np.quantile(days[r.d], r.p))


@pytest.mark.parametrize(("low", "high"), [((3, 4), (7, 9)), ((5, 5), (6, 17)), ((2, 2), (8, 8))])
def test_area_weights_of_any_ratio(spark, low, high):
    a = np.random.default_rng(2).random(high)
    a[1, 2] = np.nan
    got = dense(resample.area_resized(table(spark, a), "v", high, low), "v", low)
    for r in range(low[0]):
        for c in range(low[1]):
            top = weight = 0.0
            for i in range(high[0]):
                for j in range(high[1]):
                    h = min((i + 1) * low[0] / high[0], r + 1) - max(i * low[0] / high[0], r)
                    w = min((j + 1) * low[1] / high[1], c + 1) - max(j * low[1] / high[1], c)
                    if h > 1e-12 and w > 1e-12 and not np.isnan(a[i, j]):
                        top, weight = top + h * w * a[i, j], weight + h * w
            assert got[r, c] == pytest.approx(top / weight)


@pytest.mark.parametrize("method", ["bilinear", "cubic", "bspline", "lanczos", "average", "nearest"])
def test_warps_keep_a_constant_and_stay_in_the_box(spark, method):
    source, target = resample.Grid.of(0, 10, 1, 1, 10, 10), resample.Grid.of(-2, 9, 0.75, 0.5, 24, 12)
    a = np.full((10, 10), 4.0)
    a[5, 5] = np.nan
    got = resample.warp(table(spark, a), "v", source, target, method).collect()
    inside = {(r, c) for r in range(24) for c in range(12) if 0 < -2 + (c + 0.5) * 0.75 < 10 and 0 < 9 - (r + 0.5) * 0.5 < 10}
    if method == "average":
        assert inside <= {(r.r, r.c) for r in got}
    else:
        assert {(r.r, r.c) for r in got} == inside
    assert all(r.v is None or r.v == pytest.approx(4) for r in got) and sum(r.v is None for r in got) <= 4


@pytest.mark.parametrize("count", [1, 2, 12])
def test_a_day_with_one_value_takes_the_least_polynomial(spark, count):
    ref = np.linspace(280, 300, count)
    coeffs = np.polyfit(np.full(count, 270.0), ref, min(2, count - 1))
    rows = [(DAY, [270.0], [float(ref.mean())], min(3, count), x) for x in (250.0, 270.0, 291.5)]
    df = spark.createDataFrame(rows, "d date, tar array<double>, ref array<double>, terms int, x double")
    got = df.select("x", cdf.mapped(df.x, df.tar, df.ref, df.terms).alias("m")).collect()
    assert [r.m for r in got] == pytest.approx([float(np.polyval(coeffs, r.x)) for r in got])
    flat = spark.createDataFrame([(DAY, 270.0, float(v)) for v in np.linspace(280, 300, 50)], "d date, tar double, ref double")
    k = cdf.knots(flat, n_quantiles=12, least=1).first()
    assert (k.tar, k.ref, k.terms) == ([270.0], [pytest.approx(290)], 3)


def test_warp_rejects_an_unknown_method(spark):
    with pytest.raises(ValueError):
        resample.warp(table(spark, np.ones((2, 2))), "v", resample.Grid.index((2, 2)), resample.Grid.index((4, 4)), "median")


def test_nearest_fill_of_several_days_and_a_wide_gap(spark):
    rng = np.random.default_rng(4)
    layers = {DAY + dt.timedelta(k): np.where(rng.random((14, 9)) < share, rng.random((14, 9)), np.nan) for k, share in enumerate((0.02, 0.5, 0.0))}
    df = None
    for d, a in layers.items():
        df = table(spark, a, day=d) if df is None else df.union(table(spark, a, day=d))
    got = {(r.d, r.r, r.c): r.v for r in resample.nearest_filled(df, "v").collect()}
    assert len(got) == 3 * 14 * 9
    for d, a in layers.items():
        there = [tuple(p) for p in np.argwhere(~np.isnan(a))]
        for r in range(14):
            for c in range(9):
                best = min(there, key=lambda p: ((p[0] - r) ** 2 + (p[1] - c) ** 2, p), default=None)
                assert got[d, r, c] == (None if best is None else a[best])


def naive_spline(x, y, at):
    """Degree-2 interpolation by a least-squares-free collocation with truncated powers, for one series."""
    knots = ((x[1:] + x[:-1]) / 2)[1:-1]

    def basis(t):
        t = np.asarray(t, float)
        return np.stack([np.ones_like(t), t, t * t, *[np.where(t > k, (t - k) ** 2, 0) for k in knots]], -1)

    return basis(at) @ np.linalg.solve(basis(x), y)


def test_series_fills_against_one_series_at_a_time(spark):
    rows = {}
    for r in queries._dense(spark, SF).collect():
        rows.setdefault((r.r, r.c), {})[r.d] = r.lst
    spline = {(r.r, r.c, r.d): r.lst for r in queries.QUERIES["spline_fill"](spark, SF).collect()}
    ssa = {(r.r, r.c, r.d): r.lst for r in queries.QUERIES["ssa_fill"](spark, SF).collect()}
    for (r, c), s in rows.items():
        days = sorted(s)
        t = np.arange(len(days), dtype=float)
        v = np.array([np.nan if s[d] is None else s[d] for d in days])
        ok = ~np.isnan(v)
        want = v.copy()
        if ok.sum() >= 4:
            x, y = t[ok], v[ok]
            want = np.where(t < x[0], y[0], np.where(t > x[-1], y[-1], np.where(ok, v, naive_spline(x, y, np.clip(t, x[0], x[-1])))))
        for d, w in zip(days, want):
            assert spline[r, c, d] == (None if np.isnan(w) else pytest.approx(w, abs=2e-5))
        want = v.copy()
        if ok.sum() >= 5:
            x = np.where(ok, v, v[ok].mean())
            for _ in range(10):
                path = np.stack([x[i : i + len(x) - 9] for i in range(10)])
                u, sv, w = np.linalg.svd(path, full_matrices=False)
                near = (u[:, :3] * sv[:3]) @ w[:3]
                y = np.array([np.mean([near[i, j - i] for i in range(10) if 0 <= j - i < near.shape[1]]) for j in range(len(x))])
                new = np.where(ok, v, y)
                done = np.abs(new - x).max() < 1e-9
                x = new
                if done:
                    break
            want = np.where(ok, v, y)
        for d, w in zip(days, want):
            assert ssa[r, c, d] == (None if np.isnan(w) else pytest.approx(w, abs=2e-5))


def test_vegetation_chain(spark):
    t = np.arange(40)
    v = 0.4 + 0.3 * np.sin(t / 6)
    v[[0, 1, 9, 20, 21, 39]] = np.nan
    series = {(0, 0): v, (0, 1): np.where(t < 3, v, np.nan), (0, 2): v, (1, 0): np.where(t == 12, 1.5, v)}
    rows = [(DAY + dt.timedelta(int(i)), r, c, None if np.isnan(x) else float(x)) for (r, c), s in series.items() for i, x in zip(t, s)]
    region = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (0, 2, 0), (1, 0, 1)], "r int, c int, roi int")
    got = {}
    for r in timeseries.vegetation_smoothed(spark.createDataFrame(rows, "d date, r int, c int, v double"), "v", region).collect():
        got.setdefault((r.r, r.c), {})[(r.d - DAY).days] = r.v
    assert set(got) == {(0, 0), (0, 1), (1, 0)} and set(got[0, 1].values()) == {None}
    for key in ((0, 0), (1, 0)):
        s = np.where(np.abs(series[key]) <= 1, series[key], np.nan)
        ok = ~np.isnan(s)
        x = np.where(ok, s, naive_spline(t[ok].astype(float), s[ok], np.clip(t, t[ok][0], t[ok][-1]).astype(float)))
        for w in (timeseries.WIDE, *[timeseries.NARROW] * 3):
            x = np.convolve(np.pad(x, len(w) // 2, mode="edge"), w[::-1], "valid")
        assert np.allclose([got[key][i] for i in t], x, atol=1e-6)


def test_the_envelope_never_falls_below_the_series(spark):
    t = np.arange(30)
    rows = [(DAY + dt.timedelta(int(i)), 0, 0, float(np.sin(i) + (i == 13) * -3)) for i in t]
    df = spark.createDataFrame(rows, "d date, r int, c int, v double")
    plain = {r.d: r.v for r in timeseries.smoothed(df, "v").collect()}
    raised = {r.d: r.v for r in timeseries.smoothed(df, "v", envelope=True).collect()}
    assert raised != plain and sum(raised.values()) > sum(plain.values())


def test_status_names_gaps_errors_and_empty_days(spark):
    days = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(4)], "d date")
    found = spark.createDataFrame([(DAY, 0, 0, 1.0), (DAY, 0, 1, None), (DAY + dt.timedelta(2), 0, 0, None)], "d date, r int, c int, lst double")
    failed = spark.createDataFrame([(DAY + dt.timedelta(1),)], "d date")
    assert [r.status for r in joins.spined(days, found, failed).orderBy("d").collect()] == ["ok", "error", "ok", "missing"]
    assert [r.d.day for r in joins.pending(days, found.where("d <> date'2024-01-03'")).orderBy("d").collect()] == [2, 3, 4]
    got = {(r.d.day, r.stage): (r.n, r.status) for r in joins.run_status(days, {"a": found, "b": found.where("lst is not null")}).collect()}
    assert len(got) == 8 and got[1, "a"] == (1, "ok") and got[3, "a"] == (0, "empty") and got[3, "b"] == (0, "missing") and got[4, "a"] == (0, "missing")


def test_overlaps_of_extents_and_tiles(spark):
    got = mosaic.overlaps(spark.createDataFrame([("s", 3, 9, 0, 3)], "name string, min_r int, max_r int, min_c int, max_c int"), 4).collect()
    assert sorted((r.tile_r, r.tile_c, r.r0, r.r1, r.c0, r.c1) for r in got) == [(0, 0, 3, 3, 0, 3), (1, 0, 4, 7, 0, 3), (2, 0, 8, 9, 0, 3)]


def test_a_model_beats_the_mean_and_survives_its_file(spark, tmp_path):
    rows = derived.era5(spark, SF).join(derived.static(spark, SF), ["r", "c"])
    rows = rows.selectExpr("d", "r", "c", "t", "ndvi", "dem", "case when c <> 3 then t end as x", "t * 0.9 + 20 * ndvi as y")
    features = ["x", "ndvi", "dem"]
    model = models.fitted(rows.where(models.is_training()), features, "y", trees=60, depth=4)
    score = models.held_out(model, rows, features, "y").first()
    assert score.r2 > 0.5
    models.saved(spark, model, f"{tmp_path}/m")
    done, again = (models.predicted(m, rows, features).orderBy("d", "r", "c").collect() for m in (model, models.loaded(spark, f"{tmp_path}/m")))
    assert done == again and len(done) == rows.count() and all((r.predicted is None) == (r.c == 3) for r in done)
    for name in ("one", "two"):
        models.logged(f"{tmp_path}/log", name, model, metrics.regression(models.predicted(model, rows, features), "predicted", "y"))
    log = spark.read.parquet(f"{tmp_path}/log").collect()
    assert {r.model for r in log} == {"one", "two"} and all('"trees": 60' in r.parameters and r.r2 > 0.5 for r in log)


def test_imputation_fills_the_region_and_keeps_raw_values(spark):
    rows = [(DAY + dt.timedelta(k), r, c, None if (r + c + k) % 5 == 0 else 280.0 + r, 280.0 + r, 0.5, int(c != 2)) for k in range(12) for r in range(8) for c in range(4)]
    df = spark.createDataFrame(rows, "d date, r int, c int, lst double, t double, ndvi double, roi int")
    got = {(r.d, r.r, r.c): r.lst for r in models.imputed(df, ["t", "ndvi"], least=5, trees=60, depth=4).collect()}
    for d, r, c, lst, t, _, roi in rows:
        want = lst if lst is not None else pytest.approx(t, abs=1.5) if roi else None
        assert got[d, r, c] == want


def test_the_fine_fusion_adds_the_coarse_residual(spark):
    coarse = [(DAY, r, c, 290.0 if (r, c) != (1, 1) else None, 288.0, 0.5, 100.0, 286.0) for r in range(3) for c in range(3)]
    scored = spark.createDataFrame(coarse, "d date, r int, c int, virr double, pmw double, ndvi double, dem double, predicted double")
    residual = models.coarse_residual(scored)
    assert {(r.r, r.c): r.residual for r in residual.collect()} == {(r, c): 0.0 if (r, c) == (1, 1) else 4.0 for r in range(3) for c in range(3)}
    fine = [(DAY, r, c, 291.0 if r == 0 else None, 288.0, 0.5, 100.0, None if (r, c) == (5, 5) else 286.0) for r in range(6) for c in range(6)]
    out = models.fused_fine(spark.createDataFrame(fine, scored.schema), residual.where("r < 2 or c < 2"), (3, 3), (6, 6))
    got = {(r.r, r.c): r.lst for r in out.collect()}
    assert got[0, 3] == 291 and got[5, 0] == pytest.approx(290, abs=0.3) and got[5, 5] is None and 286 < got[2, 2] < 290
