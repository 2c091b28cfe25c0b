"""Height planes: regions without steps, specks that no region holds, and their filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import components, label_components, saved
from .zonal import FRAME

PIXEL = [*FRAME, "y", "x"]


def smooth_regions(heights: DataFrame) -> DataFrame:
    """heights(stack_id, frame, y, x, height) with (ry, rx), the first pixel in raster order of its region: pixels joined by sides at which heights differ by 1 at most.

    Pixels of a row are joined into runs first, and only pairs of runs go on to be joined. Pixels without a height are in no region.
    """
    own = heights.where("height is not null").select(*PIXEL, "height")
    row = W.partitionBy(*FRAME, "y").orderBy("x")
    goes_on = (F.lag("x").over(row) == F.col("x") - 1) & (F.abs(F.lag("height").over(row) - F.col("height")) <= 1)
    runs = own.withColumn("_begin", F.when(F.coalesce(goes_on, F.lit(False)), F.lit(None)).otherwise(F.col("x")))
    runs = saved(runs.withColumn("run", F.struct(*FRAME, "y", F.last("_begin", ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, 0)).alias("x"))).drop("_begin"))
    below = runs.select(*FRAME, (F.col("y") - 1).alias("y"), "x", F.col("height").alias("_height"), F.col("run").alias("b"))
    links = runs.join(below, PIXEL).where(F.abs(F.col("height") - F.col("_height")) <= 1).select(F.col("run").alias("a"), "b").distinct()
    found = components(links).withColumnRenamed("node", "run")
    first = F.coalesce("component", "run")
    return runs.join(found, "run", "left").select(*PIXEL, "height", first["y"].alias("ry"), first["x"].alias("rx"))


def outliers(heights: DataFrame, least: int = 1000) -> DataFrame:
    """heights with `outlier`: whether the pixel's region has fewer than `least` pixels. A region's pixels are counted in each task before they are shuffled."""
    placed = smooth_regions(heights)
    region = [*FRAME, "ry", "rx"]
    small = placed.groupBy(*region).agg(F.count("*").alias("n")).where(F.col("n") < least).select(*region, F.lit(True).alias("outlier"))
    return placed.join(small, region, "left").select(*PIXEL, "height", F.coalesce("outlier", F.lit(False)).alias("outlier"))


def without_outliers(heights: DataFrame, least: int = 1000) -> DataFrame:
    """heights(stack_id, frame, y, x, height) with each connected patch of outliers at the mean height, cut to an integer, of the pixels at its sides; -1 where it has none.

    A pixel counts once a patch, however many of its sides touch. Missing pixels and those without a height are no neighbours and stay out.
    An empty table gives an empty one.
    """
    marked = saved(outliers(heights, least))
    patches = saved(label_components(marked.where("outlier").select(*PIXEL, F.lit(1).alias("label"))).select(*PIXEL, "cy", "cx"))
    step = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))))).alias("d")
    around = patches.select(*FRAME, "cy", "cx", "y", "x", step).select(*FRAME, "cy", "cx", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()
    mean = around.join(marked.where("not outlier").select(*PIXEL, "height"), PIXEL).groupBy(*FRAME, "cy", "cx").agg(F.avg("height").cast("int").alias("_mean"))
    filled = patches.join(mean, [*FRAME, "cy", "cx"], "left").select(*PIXEL, F.coalesce("_mean", F.lit(-1)).alias("_new"))
    kind = dict(heights.dtypes)["height"]
    return marked.join(filled, PIXEL, "left").select(*PIXEL, F.when(F.col("outlier"), F.col("_new")).otherwise(F.col("height")).cast(kind).alias("height"))
