"""Zonal aggregates of pixels(stack_id, frame, y, x, label, channels) by label, and lookups on pixels. Label 0 is background."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FRAME = ["stack_id", "frame"]
CELL = [*FRAME, "label"]


def cells(pixels: DataFrame) -> DataFrame:
    return pixels.where("label <> 0")


def areas(pixels: DataFrame, scale: float = 1.0) -> DataFrame:
    return cells(pixels).groupBy(*CELL).agg((F.count("*") * scale**2).alias("area"))


def density(pixels: DataFrame) -> DataFrame:
    """Mean area, characteristic length and cells per million area units of each frame."""
    mean = areas(pixels).groupBy(*FRAME).agg(F.avg("area").alias("mean_area"))
    return mean.withColumn("length", F.sqrt("mean_area")).withColumn("density", 1e6 / F.col("mean_area"))


def label_check(pixels: DataFrame) -> DataFrame:
    """Number of cells, and whether labels run from 1 without gaps."""
    n = cells(pixels).groupBy(*FRAME).agg(F.count_distinct("label").alias("n_cells"), F.max("label").alias("top"))
    return n.select(*FRAME, "n_cells", (F.col("n_cells") == F.col("top")).alias("contiguous"))


def intensity(pixels: DataFrame, channel: str, percentile: float = 0.9) -> DataFrame:
    """Percentile of a channel in each cell, cut to an integer."""
    return cells(pixels).groupBy(*CELL).agg(F.percentile(channel, F.lit(percentile)).cast("int").alias("value"))


def fraction_above(pixels: DataFrame, channel: str, threshold: float) -> DataFrame:
    return cells(pixels).groupBy(*CELL).agg(F.avg((F.col(channel) > threshold).cast("double")).alias("fraction"))


def volumes(pixels: DataFrame, scale: float = 1.0, z_scale: float = 1.0) -> DataFrame:
    """Volume and mean height of each cell; a NaN height makes them NaN."""
    h = F.col("height") * z_scale
    return cells(pixels).groupBy(*CELL).agg((F.sum(h) * scale**2).alias("volume"), F.avg(h).alias("mean_height"))


def bounding_boxes(pixels: DataFrame) -> DataFrame:
    """Half-open boxes of the cells."""
    return cells(pixels).groupBy(*CELL).agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


def contrast(pixels: DataFrame, channel: str) -> DataFrame:
    """1st and 99th percentile of the non-zero values of a frame."""
    q = F.percentile(F.when(F.col(channel) != 0, F.col(channel)), F.array(F.lit(0.01), F.lit(0.99)))
    return pixels.groupBy(*FRAME).agg(q.alias("q")).select(*FRAME, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def normalise(pixels: DataFrame, channel: str) -> DataFrame:
    """A channel clipped to its frame's 1st and 99th percentile and brought to 0..1; 0 where these are equal."""
    q = F.percentile(channel, F.array(F.lit(0.01), F.lit(0.99)))
    bounds = pixels.groupBy(*FRAME).agg(q.alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    value = F.when(hi > lo, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(channel) - lo) / (hi - lo)))).otherwise(0.0)
    return pixels.join(bounds, FRAME).select(*FRAME, "y", "x", value.alias("value"))


def z_profile(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("stack_id", "z").agg(F.avg("value").alias("mean"))


def peak_heights(voxels: DataFrame, prominence: float) -> DataFrame:
    """Last inner z of each column at which the value is above both neighbours, by `prominence` above the lower one; 0 without."""
    column = W.partitionBy(*FRAME, "y", "x").orderBy("z")
    before, after, v = F.col("_b"), F.col("_a"), F.col("value")
    near = voxels.withColumns({"_b": F.lag("value").over(column), "_a": F.lead("value").over(column)})
    peak = (v > before) & (v > after) & (v - F.least(before, after) >= prominence)
    return near.groupBy(*FRAME, "y", "x").agg(F.coalesce(F.max(F.when(peak, F.col("z"))), F.lit(0)).alias("height"))


def filled(heights: DataFrame) -> DataFrame:
    """A row for each voxel below the height of its pixel."""
    z = F.when(F.col("height") > 0, F.sequence(F.lit(0), (F.col("height") - 1).cast("int")))
    return heights.select(*FRAME, "y", "x", F.explode(z).alias("z"))


def pool(pixels: DataFrame, channel: str, size: int) -> DataFrame:
    """Mean of a channel over blocks of size x size pixels."""
    block = lambda c: F.floor(F.col(c) / size).cast("int").alias(c)
    return pixels.groupBy(*FRAME, block("y"), block("x")).agg(F.avg(channel).alias("mean"))


def combine_nuclear(pixels: DataFrame, red: str, green: str) -> DataFrame:
    """Red plus half of green, each brought to 0..1 in its frame."""
    q = lambda c: F.percentile(c, F.array(F.lit(0.01), F.lit(0.99))).alias(f"_{c}")
    bounds = pixels.groupBy(*FRAME).agg(q(red), q(green))
    unit = lambda c: F.when(F.col(f"_{c}")[1] > F.col(f"_{c}")[0], F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - F.col(f"_{c}")[0]) / (F.col(f"_{c}")[1] - F.col(f"_{c}")[0])))).otherwise(0.0)
    return pixels.join(bounds, FRAME).select(*FRAME, "y", "x", (unit(red) + unit(green) / 2).alias("value"))


def top_surface(voxels: DataFrame, empty: float) -> DataFrame:
    """First z of a column that holds the empty value; 0 if none does."""
    first = F.coalesce(F.min(F.when(F.col("value") == empty, F.col("z"))), F.lit(0))
    return voxels.groupBy(*FRAME, "y", "x").agg(first.alias("top"))


def edge_cells(pixels: DataFrame, height: int, width: int, margin: int) -> DataFrame:
    near = (F.col("y") < margin) | (F.col("x") < margin) | (F.col("y") >= height - margin) | (F.col("x") >= width - margin)
    return cells(pixels).where(near).select(*CELL).distinct()


def remove_cells(pixels: DataFrame, gone: DataFrame) -> DataFrame:
    """Without some cells; the others' labels close up in order. Labels are numbered in the table of cells and joined back."""
    left = cells(pixels).select(*CELL).distinct().join(gone.select(*CELL), CELL, "left_anti")
    new = left.withColumn("new_label", F.row_number().over(W.partitionBy(*FRAME).orderBy("label")))
    return pixels.join(new, CELL).withColumn("label", F.col("new_label")).drop("new_label")


def raster_order(pixels: DataFrame) -> DataFrame:
    """(label, new_label): cells numbered by their first pixel, row by row."""
    first = cells(pixels).groupBy(*CELL).agg(F.min(F.struct("y", "x")).alias("first"))
    return first.select(*CELL, F.row_number().over(W.partitionBy(*FRAME).orderBy("first")).alias("new_label"))


def rotate(pixels: DataFrame, height: int, width: int, turns: int) -> DataFrame:
    """Quarter turns anticlockwise."""
    y, x = F.col("y"), F.col("x")
    new = {0: (y, x), 1: (width - 1 - x, y), 2: (height - 1 - y, width - 1 - x), 3: (x, height - 1 - y)}[turns % 4]
    return pixels.select(*FRAME, new[0].alias("y"), new[1].alias("x"), "label")


def rotate_points(points: DataFrame, height: int, width: int, turns: int) -> DataFrame:
    """points(stack_id, frame, y, x, ...), such as centroids or outlines, after the quarter turns of their planes; nulls stay null."""
    y, x = F.col("y"), F.col("x")
    new = {0: (y, x), 1: (width - 1 - x, y), 2: (height - 1 - y, width - 1 - x), 3: (x, height - 1 - y)}[turns % 4]
    return points.withColumns({"y": new[0], "x": new[1]})


def rotate_drift(drift: DataFrame, turns: int) -> DataFrame:
    """drift(stack_id, frame, dx, dy, ...) after quarter turns anticlockwise: directions turn, places do not matter."""
    dy, dx = F.col("dy"), F.col("dx")
    new = {0: (dy, dx), 1: (-dx, dy), 2: (-dy, -dx), 3: (dx, -dy)}[turns % 4]
    return drift.withColumns({"dy": new[0], "dx": new[1]})


def match_nuclei(nuclei: DataFrame, pixels: DataFrame) -> DataFrame:
    """The cell under each nucleus's centre, rounded half to even; of several nuclei the first keeps the cell."""
    at = nuclei.select(*FRAME, "nuc", F.bround("cy").cast("int").alias("y"), F.bround("cx").cast("int").alias("x"))
    hit = at.join(cells(pixels).select(*FRAME, "y", "x", "label"), [*FRAME, "y", "x"])
    return hit.groupBy(*CELL).agg(F.min("nuc").alias("nuc"))


def unmatched(nuclei: DataFrame, pixels: DataFrame) -> DataFrame:
    """(stack_id, frame, kind, id) of what match_nuclei leaves alone: nuclei without a cell of their own, cells without a nucleus."""
    pairs = match_nuclei(nuclei, pixels)
    alone = nuclei.select(*FRAME, "nuc").distinct().join(pairs, [*FRAME, "nuc"], "left_anti").select(*FRAME, F.lit("nucleus").alias("kind"), F.col("nuc").cast("long").alias("id"))
    empty = cells(pixels).select(*CELL).distinct().join(pairs, CELL, "left_anti").select(*FRAME, F.lit("cell").alias("kind"), F.col("label").cast("long").alias("id"))
    return alone.union(empty)


def with_labels(pixels: DataFrame, labels: DataFrame, inside: bool = True) -> DataFrame:
    """Pixels of the listed cells (stack_id, frame, label), or of all others."""
    return pixels.join(labels.select(*CELL).distinct(), CELL, "left_semi" if inside else "left_anti")


def tile_edge_cells(pixels: DataFrame, channel: str, height: int, width: int, radius: int = 2) -> DataFrame:
    """Cells at the image's edge or within `radius` pixels, in either direction, of a pixel whose channel is 0, as between stitched tiles."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    seams = pixels.where(F.col(channel) == 0).select(*FRAME, "y", "x", F.explode(steps).alias("_dy")).select(*FRAME, (F.col("y") + F.col("_dy")).alias("y"), "x", F.explode(steps).alias("_dx"))
    seams = seams.select(*FRAME, "y", (F.col("x") + F.col("_dx")).alias("x"))
    beside = cells(pixels).join(seams.distinct(), [*FRAME, "y", "x"], "left_semi").select(*CELL)
    return beside.union(edge_cells(pixels, height, width, 1).select(*CELL)).distinct()


def merge_cells(pixels: DataFrame, merges: DataFrame) -> DataFrame:
    """The pixels of cell `second` go to cell `first` (merges: stack_id, frame, first, second); the labels close up. Background goes."""
    moved = merges.select(*FRAME, F.col("second").alias("label"), "first")
    joined = pixels.join(moved, CELL, "left").withColumn("label", F.coalesce("first", "label")).drop("first")
    return remove_cells(joined, joined.select(*CELL).limit(0))
