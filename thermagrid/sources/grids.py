"""Listing and validity of files, pixel and tile layouts, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import file_date
from ..functions.radiometry import clean

TILE = 256


def listing(spark: SparkSession, folder: str, glob: str = "*", contains: str = "", least_bytes: int = 0) -> DataFrame:
    """path, name, d and bytes of the files of a folder, by path, without reading them; hidden files are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return (
        found.select("path", name.alias("name"), file_date(F.col("path")).alias("d"), F.col("length").alias("bytes"))
        .where(~F.col("name").startswith(".") & F.col("name").contains(contains) & (F.col("bytes") >= least_bytes))
        .orderBy("path")
    )


def output_name(name, prefix: str):
    return F.regexp_replace(name, r"\.HDF$", f"_{prefix}.tif")


def pixels(df: DataFrame, value: str, *nodata: float) -> DataFrame:
    """df with value normalised: every encoding of missing becomes NULL."""
    return df.withColumn(value, clean(F.col(value), *nodata))


def tiled(df: DataFrame, value: str, tile: int = TILE, kind: str = "float") -> DataFrame:
    """(d, r, c, value) to (d, tile_r, tile_c, values): one array of cells for each tile, at rest a tenth of the size.

    Cells are placed row by row of a tile, so a look-up walks along one row at most.  Of a repeated pixel the smallest
    value stays, NULL only where there is no other.  kind is the type of the cells at rest."""
    cells = df.select("d", "r", F.expr(f"c div {tile}").cast("int").alias("tile_c"), (F.col("c") % tile).alias("x"), F.col(value).cast(kind).alias("v"))
    found = F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("x", "v"))))
    rows = cells.groupBy("d", "r", "tile_c").agg(found.alias("e"))
    xs, vs = F.transform("e", lambda e: e["x"]), F.transform("e", lambda e: e["v"])
    rows = rows.withColumn("xs", xs).withColumn("vs", vs)
    line = F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda i: F.get("vs", (F.array_position("xs", i) - 1).cast("int")))
    rows = rows.select("d", F.expr(f"r div {tile}").cast("int").alias("tile_r"), "tile_c", F.struct((F.col("r") % tile).alias("y"), line.alias("line")).alias("l"))
    whole = rows.groupBy("d", "tile_r", "tile_c").agg(F.collect_list("l").alias("l"))
    ys, lines = F.transform("l", lambda e: e["y"]), F.transform("l", lambda e: e["line"])
    whole = whole.withColumn("ys", ys).withColumn("lines", lines)
    empty = F.array_repeat(F.lit(None).cast(kind), tile)
    stack = F.transform(F.sequence(F.lit(0), F.lit(tile - 1)), lambda i: F.coalesce(F.get("lines", (F.array_position("ys", i) - 1).cast("int")), empty))
    return whole.select("d", "tile_r", "tile_c", F.flatten(stack).alias("values"))


def untiled(df: DataFrame, value: str, tile: int = TILE) -> DataFrame:
    cells = df.select("d", "tile_r", "tile_c", F.posexplode("values").alias("at", value)).where(F.col(value).isNotNull())
    return cells.select(
        "d",
        (F.col("tile_r") * tile + F.expr(f"at div {tile}")).cast("int").alias("r"),
        (F.col("tile_c") * tile + F.col("at") % tile).cast("int").alias("c"),
        F.col(value).cast("double").alias(value),
    )


def extent(df: DataFrame) -> DataFrame:
    return df.agg(F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("c").alias("min_c"), F.max("c").alias("max_c"))


def write_daily(df: DataFrame, path: str) -> None:
    """One atomic write partitioned by day; only the days in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("d").parquet(path)


def exported(df: DataFrame, value: str, fill: float = -9999.0) -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def write_report(df: DataFrame, path: str) -> None:
    """A small table (one row a day) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_tiles(df: DataFrame, path: str) -> None:
    """Tiles (d, tile_r, tile_c, values) by day, sorted inside it, so that a window reads only its row groups."""
    ordered = df.repartition("d").sortWithinPartitions("d", "tile_r", "tile_c")
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("d").parquet(path)


def window_read(spark: SparkSession, path: str, value: str, rows: tuple[int, int], cols: tuple[int, int], days: tuple[str, str] | None = None, tile: int = TILE) -> DataFrame:
    """Pixels of a window, ends excluded, from written tiles: days prune folders and tile keys are pushed to the scan."""
    tiles = spark.read.parquet(path)
    if days:
        tiles = tiles.where(F.col("d").between(F.lit(days[0]).cast("date"), F.lit(days[1]).cast("date")))
    for key, (low, high) in (("tile_r", rows), ("tile_c", cols)):
        tiles = tiles.where((F.col(key) >= low // tile) & (F.col(key) <= (high - 1) // tile))
    inside = (F.col("r") >= rows[0]) & (F.col("r") < rows[1]) & (F.col("c") >= cols[0]) & (F.col("c") < cols[1])
    return untiled(tiles, value, tile).where(inside)


def masked(df: DataFrame, value: str, mask: DataFrame, by: str) -> DataFrame:
    """df (d, r, c, value) with NULL where the mask (r, c, by) has none, as it is written."""
    kept = df.join(mask.where(F.col(by).isNotNull()).select("r", "c", F.lit(True).alias("__kept")), ["r", "c"], "left")
    return kept.select("d", "r", "c", F.when(F.col("__kept"), F.col(value)).alias(value))


def empty(spark: SparkSession, rows: int, cols: int, value: str) -> DataFrame:
    """(r, c, value): a grid without any value."""
    cells = spark.range(rows * cols)
    return cells.select(F.expr(f"cast(id div {cols} as int)").alias("r"), F.expr(f"cast(id % {cols} as int)").alias("c"), F.lit(None).cast("double").alias(value))


#: Fixed value: the reference system of a grid that has none.
DEFAULT_CRS = "EPSG:4326"


def bounds(grids: DataFrame) -> DataFrame:
    """grids (name, x0, y0, dx, dy, rows, cols, crs) with min_x, max_y, max_x and min_y; a missing crs is DEFAULT_CRS, and
    a missing origin or cell size that of a grid over the whole globe."""
    dx, dy = F.coalesce("dx", 360.0 / F.col("cols")), F.coalesce("dy", 180.0 / F.col("rows"))
    x0, y0 = F.coalesce("x0", F.lit(-180.0)), F.coalesce("y0", F.lit(90.0))
    return grids.select(
        "name", F.coalesce("crs", F.lit(DEFAULT_CRS)).alias("crs"), "rows", "cols", dx.alias("dx"), dy.alias("dy"),
        x0.alias("min_x"), y0.alias("max_y"), (x0 + dx * F.col("cols")).alias("max_x"), (y0 - dy * F.col("rows")).alias("min_y"),
    )


def same_grid(grids: DataFrame) -> DataFrame:
    """(name, as_name): for every grid the first one, by name, whose cells are its own.  Places and sizes are the same to
    nine decimals."""
    cells = bounds(grids)
    place = [F.round(c, 9) for c in ("dx", "dy", "min_x", "max_y")]
    return cells.select("name", F.min("name").over(Window.partitionBy("crs", "rows", "cols", *place)).alias("as_name"))


def enough(df: DataFrame, value: str, roi: DataFrame, places: list[tuple[float, float]], tile: int, least: int) -> DataFrame:
    """(r0, c0, n, ok): blocks of ``tile`` cells at shares of the grid, and whether each has ``least`` valid values inside
    the ROI; a quick check before a long run."""
    ends = roi.agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w")).first()
    spots = [(int(y * ends.h) // tile * tile, int(x * ends.w) // tile * tile) for y, x in places]
    inside = df.join(roi.where("roi = 1").select("r", "c"), ["r", "c"])
    key = [F.expr(f"cast({x} div {tile} * {tile} as int)").alias(f"{x}0") for x in "rc"]
    counts = inside.where(F.col(value).isNotNull()).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    wanted = df.sparkSession.createDataFrame(sorted(set(spots)), "r0 int, c0 int")
    found = F.broadcast(wanted).join(counts, ["r0", "c0"], "left").select("r0", "c0", F.coalesce("n", F.lit(0)).alias("n"))
    return found.withColumn("ok", F.col("n") >= least)
