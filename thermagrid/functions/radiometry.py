"""Missing values, valid ranges and per-pixel rules.  NULL is the only missing value inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Valid ranges (low, low included, high, high included) of each use.
RANGES = {
    "impute_train": (220.0, False, 350.0, True),
    "cdf_train": (220.0, False, 350.0, False),
    "cdf_keep": (220.0, True, 350.0, True),
    "model": (220.0, False, 350.0, False),
    "fused": (220.0, True, 330.0, True),
}


def clean(v: Column, *nodata: float) -> Column:
    """NaN, infinity and the nodata codes become NULL."""
    bad = F.isnan(v) | (F.abs(v) == float("inf"))
    for code in nodata:
        bad = bad | (v == code)
    return F.when(~bad, v)


def within(v: Column, use: str) -> Column:
    low, low_in, high, high_in = RANGES[use]
    return ((v >= low) if low_in else (v > low)) & ((v <= high) if high_in else (v < high))


def dequantise(dn: Column, slope: float, intercept: float, low: float, high: float, fill: float) -> Column:
    return F.when(dn.between(low, high) & (dn != fill), dn * slope + intercept)


def scaled_short(v: Column, scale: float, fill: int) -> Column:
    """Rounded half to even, as 16 bits."""
    return F.coalesce(F.bround(v * scale).cast("short"), F.lit(fill).cast("short"))


def positive(v: Column) -> Column:
    return F.when(v > 0, v)


def valid_ndvi(v: Column) -> Column:
    return F.when(v.between(-1, 1), v)


def icy(era5: Column, ndvi: Column) -> Column:
    return F.coalesce((era5 < 273.15) & (ndvi < 0.05), F.lit(False))


def confidence(virr: Column, era5: Column, threshold: float = 8.0) -> Column:
    """1 below 3 K of difference, falling to 0.2 at the threshold, 0.05 above it."""
    d = F.abs(virr - era5)
    return F.when(d < 3, F.lit(1.0)).when(d <= threshold, 1 - (d - 3) / (threshold - 3) * 0.8).when(d > threshold, F.lit(0.05))


def cloud_free(virr: Column, pmw: Column, dem: Column, ndvi: Column, base: float = -8.0, glacier: float = -18.0) -> Column:
    """virr, or NULL where it is colder than pmw by more than the threshold of its surface."""
    limit = F.when((dem > 4000) | (ndvi < 0.05), glacier).otherwise(base)
    return F.when(~F.coalesce(virr - pmw < limit, F.lit(False)), virr)


def clamped(residual: Column, most: float = 20.0) -> Column:
    return F.coalesce(F.when((residual > -most) & (residual < most), residual), F.lit(0.0))


def swapped(value: Column, reference: Column, most: float = 20.0) -> Column:
    return F.when(F.abs(value - reference) > most, reference).otherwise(value)


#: The raster type codes of the format and what holds them at rest; other codes are float.
STORED = {1: "short", 2: "int", 3: "short", 4: "long", 5: "int", 6: "float", 7: "double"}


def stored_type(code: int) -> str:
    """The column type for a raster type code; complex types are pairs of their parts."""
    if 8 <= code <= 11:
        part = {8: "short", 9: "int", 10: "float", 11: "double"}[code]
        return f"struct<re: {part}, im: {part}>"
    return STORED.get(code, "float")
