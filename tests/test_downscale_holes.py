"""Downscaling of a coarse grid with holes."""

import datetime as dt

import pytest

from thermagrid.operators import downscale

DAY = dt.date(2024, 1, 1)


def test_a_hole_costs_its_own_fine_cells_only(spark):
    hole = {(0, 0), (2, 1)}
    coarse = spark.createDataFrame([(DAY, r, c, None if (r, c) in hole else 280.0) for r in range(4) for c in range(4)], "d date, r int, c int, lst double")
    fine = spark.createDataFrame([(r, c, float(r * c % 5), None if (r, c) == (7, 7) else float(r + c * c)) for r in range(8) for c in range(8)], "r int, c int, ndvi double, dem double")
    got = {(r.r, r.c): r.lst for r in downscale.filled_downscaled(coarse, fine, (4, 4), (8, 8)).collect()}
    assert set(got) == {(r, c) for r in range(8) for c in range(8) if (r // 2, c // 2) not in hole} - {(7, 7)}
    assert all(v == pytest.approx(280) for v in got.values())
