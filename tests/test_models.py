"""Boosted-tree operators on small grids."""

import datetime as dt

import numpy as np
import pytest

from thermagrid.operators import boosting, models

DAY = dt.date(2024, 1, 1)


def test_fusion_fills_pixels_without_a_thermal_value(spark):
    pairs = [(DAY, r, c, 280.0 + r, 280.0 + r, 0.5, 100.0, 1, 1.0) for r in range(10) for c in range(10)]
    odd = [
        (DAY, 20, 0, None, 285.0, 0.5, 100.0, 1, None),  # microwave only
        (DAY, 20, 1, 290.0, None, 0.5, 100.0, 1, 1.0),  # thermal only
        (DAY, 20, 2, 250.0, 285.0, 0.5, 100.0, 1, 0.05),  # cloud
        (DAY, 20, 3, None, 285.0, None, 100.0, 1, None),  # no vegetation to predict from
    ]
    rows = spark.createDataFrame(pairs + odd, "d date, r int, c int, virr double, pmw double, ndvi double, dem double, roi int, w double")
    got = {(r.r, r.c): r.lst for r in models.fused(rows, ["pmw", "ndvi", "dem"], trees=40, depth=4).collect()}
    assert len(got) == 104 and got[20, 1] == 290
    assert got[20, 0] == pytest.approx(285, abs=3) and got[20, 2] == got[20, 0] and got[20, 3] is None


def test_fusion_query_has_every_pixel_of_either_sensor(spark, monkeypatch):
    from thermagrid.plans import queries
    from thermagrid.sources import derived

    sf, fitted = "/root/testdata/sf0.001", models.fitted
    monkeypatch.setattr(models, "fitted", lambda rows, features, label, weight=None, **how: fitted(rows, features, label, weight, trees=2, depth=2))
    keys = {tuple(r)[:3] for layer in (derived.virr, derived.pmw) for r in layer(spark, sf).select("d", "r", "c").collect()}
    got = [tuple(r)[:3] for r in queries.QUERIES["gbt_fusion"](spark, sf).collect()]
    assert set(got) == keys and len(got) == len(keys)


def test_model_queries_search_as_the_reference_does(spark, monkeypatch):
    from thermagrid.plans import queries

    fitted, asked = models.fitted, []

    def small(rows, features, label, weight=None, **how):
        asked.append(how)
        return fitted(rows, features, label, weight, trees=1, depth=1)

    monkeypatch.setattr(models, "fitted", small)
    queries.QUERIES["gbt_impute"](spark, "/root/testdata/sf0.001")
    assert asked and all(how == {"space": models.IMPUTE_SPACE, "tries": 25, "folds": 5, "metric": "r2"} for how in asked)
    asked.clear()
    queries.QUERIES["gbt_fusion"](spark, "/root/testdata/sf0.001")
    assert asked == [{"space": models.FUSION_SPACE, "tries": 20, "folds": 3, "metric": "rmse"}]


def test_random_search_returns_its_best_draw(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 2))
    rows = spark.createDataFrame([(float(a), float(b), float(10 * a + np.sin(6 * b)), 1.0) for a, b in x], "x double, z double, y double, w double")
    space = {"trees": (2, 60), "depth": (1, 4), "step": (0.05, 0.3), "rows": (0.7, 1.0), "columns": (0.5, 1.0), "gain": (0.0, 0.1), "weight": (1, 4)}
    best, scores = boosting.searched(rows, ["x", "z"], "y", "w", space, 6, 3, "rmse", 1000)
    assert [p for p, _ in scores] == boosting.draws(space, 6) and best.params == max(scores, key=lambda s: s[1])[0]
    assert models.fitted(rows, ["x", "z"], "y", weight="w", space=space, tries=6, folds=3, metric="rmse").params == best.params
    few, _ = boosting.searched(rows, ["x", "z"], "y", None, {"trees": (5, 6)}, 1, 2, "r2", 50)
    assert few.params.trees == 5


def slow_tree(x, y, w, depth, ridge, least):
    """One regression tree by trying every split between neighbouring values."""
    value = float((w * y).sum() / (w.sum() + ridge))
    best = (1e-12, None, None)
    if depth:
        own = (w * y).sum() ** 2 / (w.sum() + ridge)
        for j in range(x.shape[1]):
            for cut in np.unique(x[:, j])[:-1]:
                a = x[:, j] <= cut
                if w[a].sum() < least or w[~a].sum() < least:
                    continue
                gain = 0.5 * ((w * y)[a].sum() ** 2 / (w[a].sum() + ridge) + (w * y)[~a].sum() ** 2 / (w[~a].sum() + ridge) - own)
                if gain > best[0] + 1e-12:
                    best = (gain, j, cut)
    if best[1] is None:
        return lambda z: np.full(len(z), value)
    a = x[:, best[1]] <= best[2]
    low, high = slow_tree(x[a], y[a], w[a], depth - 1, ridge, least), slow_tree(x[~a], y[~a], w[~a], depth - 1, ridge, least)
    return lambda z: np.where(z[:, best[1]] <= best[2], low(z), high(z))


def test_trees_against_every_split():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (80, 2)).astype(float)
    y, w = np.sin(x[:, 0]) * 5 + x[:, 1], rng.random(80) + 0.2
    model = boosting.fit(x, y, w, boosting.Params(trees=4, depth=3, step=0.5, weight=1.5))
    at = np.full(80, np.average(y, weights=w))
    for _ in range(4):
        at = at + 0.5 * slow_tree(x, y - at, w, 3, boosting.RIDGE, 1.5)(x)
    assert np.allclose(model.predict(x), at)
    flat = boosting.fit(np.ones((5, 1)), np.full(5, 3.0))
    assert np.allclose(flat.predict(np.array([[7.0]])), 3)
    assert boosting.score(np.zeros(3), np.zeros(3), "r2") == 0
    with pytest.raises(ValueError):
        boosting.score(y, y, "mae")
