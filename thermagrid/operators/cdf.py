"""Daily distribution matching: quantile or breakpoint knots and a piecewise linear map, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.radiometry import swapped, within
from ..sources.storage import stored


#: Equal bins of a key's range that are ranked apart.
BINS = 64


def ranked(df: DataFrame, value: str, order: tuple[str, ...] = (), keys: tuple[str, ...] = ("d",), bins: int = BINS) -> DataFrame:
    """df's rows with a value, with rank (from 0, by value and then ``order``) and n, the number of them, for each key.

    A key's range is cut into equal bins, which are ranked apart and shifted by what the bins below hold, so no
    task sorts a whole day unless its values are all alike.  What is joined is a few numbers for each key."""
    there = df.where(F.col(value).isNotNull())
    ends = there.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    share = (F.col(value) - F.col("__lo")) / F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo"))
    binned = there.join(F.broadcast(ends), list(keys)).withColumn("__bin", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__k"))
    whole = Window.partitionBy(*keys)
    below = F.coalesce(F.sum("__k").over(whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*keys, "__bin", below.alias("__below"), F.sum("__k").over(whole).alias("n"))
    local = F.row_number().over(Window.partitionBy(*keys, "__bin").orderBy(value, *order)) - 1
    rows = binned.withColumn("__local", local).join(F.broadcast(shifts), [*keys, "__bin"])
    return rows.select(*df.columns, (F.col("__local") + F.col("__below")).alias("rank"), "n")


def empirical(df: DataFrame, value: str, order: tuple[str, ...] = ("r", "c"), keys: tuple[str, ...] = ("d",)) -> DataFrame:
    """df with p, the percentage of its key's values up to this one; equal values take steps of their own."""
    return ranked(df, value, order, keys).select(*df.columns, ((F.col("rank") + 1) / F.col("n") * 100).alias("p"))


def percentiles(df: DataFrame, value: str, wanted: DataFrame, keys: tuple[str, ...] = ("d",), bins: int = BINS) -> DataFrame:
    """wanted (keys, k, p from 0 to 1) with q, the linearly interpolated percentile of value there."""
    rows = ranked(df.select(*keys, value), value, keys=keys, bins=bins)
    spots = F.broadcast(df.groupBy(*keys).agg(F.count(value).alias("__n")).join(wanted, list(keys)))
    spot = F.col("p") * (F.col("__n") - 1)
    places = spots.select(*keys, "k", "p", (spot - F.floor(spot)).alias("__part"), F.explode(F.array(F.floor(spot), F.least(F.floor(spot) + 1, F.col("__n") - 1))).alias("rank"))
    met = F.broadcast(places).join(rows.select(*keys, "rank", F.col(value).alias("__v")), [*keys, "rank"])
    found = met.groupBy(*keys, "k", "p", "__part").agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    return found.select(*keys, "k", "p", (F.col("__low") + F.col("__part") * (F.col("__high") - F.col("__low"))).alias("q"))


def medians(df: DataFrame, value: str, keys: tuple[str, ...] = ("d",), bins: int = BINS) -> DataFrame:
    """(keys, median) of the keys that have a value."""
    wanted = df.where(F.col(value).isNotNull()).select(*keys).distinct().select(*keys, F.lit(0).alias("k"), F.lit(0.5).alias("p"))
    return percentiles(df, value, wanted, keys, bins).select(*keys, F.col("q").alias("median"))


def knots(pairs: DataFrame, n_quantiles: int | None = None, breakpoints: list[float] | None = None, least: int = 1000) -> DataFrame:
    """(d, n, tar, ref, terms): for each day with at least ``least`` pairs (d, tar, ref), ascending knots of the map.

    Either n_quantiles evenly spaced percentiles of both, or the breakpoints of ref strictly inside its range, with its
    ends, each sent to the percentile of tar at its strict percentile score in ref.  Of equal tar knots the first stays;
    where all are equal, one knot with the mean of ref, and in terms how many a polynomial through them has, 3 at most.
    """
    if (n_quantiles is None) == (breakpoints is None):
        raise ValueError("give either n_quantiles or breakpoints")
    # read several times over: three columns, written once
    both = stored("pairs", pairs.select("d", "tar", "ref").where(F.col("tar").isNotNull() & F.col("ref").isNotNull()))
    ends = both.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.min("ref").alias("lo"), F.max("ref").alias("hi")).where(F.col("n") >= least)
    if n_quantiles:
        at = F.array(*[F.lit(i / (n_quantiles - 1)) for i in range(n_quantiles)])
        # both layers are ranked in one pass, as keys of their own
        pair = F.explode(F.array(*[F.struct(F.lit(x).alias("of"), F.col(x).alias("v")) for x in ("tar", "ref")])).alias("e")
        either = F.explode(F.array(F.lit("tar"), F.lit("ref"))).alias("of")
        wanted = ends.select("d", either).select("d", "of", F.posexplode(at).alias("k", "p"))
        found = percentiles(both.select("d", pair).select("d", "e.of", "e.v"), "v", wanted, ("d", "of"))
        days = found.groupBy("d", "k").agg(*[F.max(F.when(F.col("of") == x, F.col("q"))).alias(y) for x, y in (("tar", "t"), ("ref", "r"))])
    else:
        inner = F.array(*[F.lit(float(b)) for b in sorted(breakpoints)])
        spots = F.array_sort(F.array_distinct(F.concat(F.array("lo"), F.filter(inner, lambda b: (b > F.col("lo")) & (b < F.col("hi"))), F.array("hi"))))
        one = ends.select("d", F.posexplode(spots).alias("k", "r"))
        scored = both.join(F.broadcast(one), "d").groupBy("d", "k", "r").agg((F.count(F.when(F.col("ref") < F.col("r"), 1)) / F.count(F.lit(1))).alias("p"))
        days = percentiles(both, "tar", scored.select("d", "k", "p")).join(one, ["d", "k"]).select("d", "k", F.col("q").alias("t"), "r")
    lists = days.groupBy("d").agg(F.array_sort(F.collect_list("t")).alias("t"), F.array_sort(F.collect_list("r")).alias("r"))
    zipped = lists.join(ends.select("d", "n"), "d").withColumn("z", F.arrays_zip("t", "r"))
    fresh = F.filter("z", lambda e, i: (i == 0) | (e["t"] > F.get(F.col("z"), F.greatest(i - 1, F.lit(0)))["t"]))
    mean = F.aggregate("r", F.lit(0.0), lambda a, x: a + x) / F.size("r")
    tar, ref = F.transform("z", lambda e: e["t"]), F.transform("z", lambda e: e["r"])
    ref = F.when(F.size("z") == 1, F.array(mean)).otherwise(ref)
    return zipped.withColumn("z", fresh).select("d", "n", tar.alias("tar"), ref.alias("ref"), F.least(F.size("t"), F.lit(3)).alias("terms"))


def mapped(x: Column, tar: Column, ref: Column, terms: Column | None = None) -> Column:
    """The piecewise linear map at x, its end segments extended.

    A single knot gives the least polynomial through it, with so many terms of equal size there; without terms, the
    knot's value."""
    m = F.size(tar)
    i = F.greatest(F.least(F.size(F.filter(tar, lambda t: t <= x)) - 1, m - 2), F.lit(0))
    t0, t1, r0, r1 = F.get(tar, i), F.get(tar, i + 1), F.get(ref, i), F.get(ref, i + 1)
    alone = r0
    if terms is not None:
        share = x / t0
        alone = r0 / terms * F.when(terms == 1, 1.0).when(terms == 2, 1 + share).otherwise(1 + share + share * share)
    return F.when(m >= 2, r0 + (x - t0) * (r1 - r0) / (t1 - t0)).otherwise(alone)


def corrected(imputed: DataFrame, reference: DataFrame, roi: DataFrame, least: int = 1000, swap: bool = True, **how) -> DataFrame:
    """(d, r, c, lst): imputed (d, r, c, lst) mapped day by day to the distribution of reference (d, r, c, t).

    Fitted on pixels of the ROI where both are in range; values off the reference by more than 20 K take it; what
    leaves the kept range or the ROI is NULL.  Knots are a few numbers a day and join as such."""
    pixels = imputed.join(reference, ["d", "r", "c"]).join(roi.where("roi = 1").select("r", "c"), ["r", "c"])
    fit = pixels.where(within(F.col("lst"), "cdf_train") & within(F.col("t"), "cdf_train"))
    found = knots(fit.select("d", F.col("lst").alias("tar"), F.col("t").alias("ref")), least=least, **how)
    value = mapped(F.col("lst"), F.col("tar"), F.col("ref"), F.col("terms"))
    value = swapped(value, F.col("t")) if swap else value
    rows = pixels.join(F.broadcast(found), "d").select("d", "r", "c", value.alias("lst"))
    return rows.withColumn("lst", F.when(within(F.col("lst"), "cdf_keep"), F.col("lst")))


def strict_score(df: DataFrame, value: str, at: float, keys: tuple[str, ...] = ("d",)) -> DataFrame:
    return df.groupBy(*keys).agg((100 * F.count(F.when(F.col(value) < at, 1)) / F.count(value)).alias("score"))


def histogram(df: DataFrame, value: str, bins: int, keys: tuple[str, ...] = ("d",)) -> DataFrame:
    """(keys, bin, density): equal bins over each key's range; the top edge belongs to the last bin."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    which = F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(value).isNotNull()).join(ends, list(keys)).withColumn("bin", which)
    return rows.groupBy(*keys, "bin", "n", width.alias("width")).agg(F.count(F.lit(1)).alias("k")).select(*keys, "bin", (F.col("k") / (F.col("n") * F.col("width"))).alias("density"))
