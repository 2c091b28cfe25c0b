"""Edits and filters of whole planes: new cells, filling from the nearest pixel, Gaussian blur, outlines as text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import label_components, saved
from .spatial import grid_join
from .zonal import CELL, FRAME, areas, intensity

PIXEL = [*FRAME, "y", "x"]


def blank(pixels: DataFrame) -> DataFrame:
    """The planes without any cell."""
    return pixels.withColumn("label", F.lit(0))


def add_cells(pixels: DataFrame, drawn: DataFrame, least: int = 5) -> DataFrame:
    """Pixels with the cells of drawn(stack_id, frame, y, x, cell) after the frame's last label, in order of `cell`.

    Only background is drawn on, by the smallest `cell` where several meet, and a cell with fewer than `least` pixels left is not added.
    """
    free = drawn.groupBy(*PIXEL).agg(F.min("cell").alias("cell")).join(pixels.where("label = 0").select(*PIXEL), PIXEL, "left_semi")
    sizes = free.groupBy(*FRAME, "cell").count().where(F.col("count") >= least)
    top = pixels.groupBy(*FRAME).agg(F.max("label").alias("top"))
    place = F.row_number().over(W.partitionBy(*FRAME).orderBy("cell"))
    labels = sizes.join(top, FRAME).select(*FRAME, "cell", (F.col("top") + place).alias("_new"))
    placed = free.join(labels, [*FRAME, "cell"]).select(*PIXEL, "_new")
    return pixels.join(placed, PIXEL, "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def nearest_labels(pixels: DataFrame, radius: float = 4.0) -> DataFrame:
    """(stack_id, frame, y, x, label) of each background pixel: the label of the nearest labelled one, ties by y and x.

    Searched within a radius that doubles for the pixels still without one, up to the planes' diagonal; frames without a label leave none.
    """
    holes = pixels.where("label = 0").select(*FRAME, F.col("y").alias("ly"), F.col("x").alias("lx"))
    inside = pixels.where("label <> 0").select(*FRAME, "label", F.col("y").alias("ry"), F.col("x").alias("rx"))
    holes = holes.join(inside.select(*FRAME).distinct(), FRAME, "left_semi")
    height, width = pixels.agg(F.max("y") - F.min("y"), F.max("x") - F.min("x")).first()
    farthest = math.hypot(height or 0, width or 0)
    found = None
    while True:
        near = grid_join(holes, inside, FRAME, radius).groupBy(*FRAME, "ly", "lx").agg(F.min_by("label", F.struct("distance", "ry", "rx")).alias("label"))
        near = saved(near)
        found = near if found is None else found.union(near)
        holes = saved(holes.join(near, [*FRAME, "ly", "lx"], "left_anti"))
        if radius > farthest or holes.isEmpty():
            return found.select(*FRAME, F.col("ly").alias("y"), F.col("lx").alias("x"), "label")
        radius *= 2


def mend_gaps(pixels: DataFrame, largest: float | None = None) -> DataFrame:
    """pixels with each connected part of the background (by sides) that has fewer than `largest` pixels filled: every pixel takes the label of the nearest pixel outside such parts, ties by y and x.

    Without `largest`, half the mean area of the frame's cells. A frame that is one small part stays as it is. Other columns stay; an empty table gives an empty one.
    """
    empty = pixels.where("label = 0").select(*PIXEL, "label")
    parts = saved(label_components(empty).select(*PIXEL, "cy", "cx"))
    sizes = parts.groupBy(*FRAME, "cy", "cx").agg(F.count("*").alias("n"))
    half = areas(pixels).groupBy(*FRAME).agg((F.avg("area") / 2).alias("bound")) if largest is None else sizes.select(*FRAME).distinct().withColumn("bound", F.lit(float(largest)))
    small = sizes.join(half, FRAME).where("n < bound").select(*FRAME, "cy", "cx")
    gaps = saved(parts.join(small, [*FRAME, "cy", "cx"], "left_semi").select(*PIXEL, F.lit(True).alias("_gap")))
    # the rest of the background is as near as any cell
    marked = pixels.select(*PIXEL, "label").join(gaps, PIXEL, "left")
    sources = marked.select(*PIXEL, F.when(F.col("_gap"), 0).when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("label"))
    near = nearest_labels(sources).select(*PIXEL, F.greatest("label", F.lit(0)).alias("_new"))
    kind = dict(pixels.dtypes)["label"]
    return pixels.join(near, PIXEL, "left").withColumn("label", F.coalesce("_new", "label").cast(kind)).drop("_new")


def blur(pixels: DataFrame, channel: str, height: int, width: int | None, sigma: float) -> DataFrame:
    """A channel under a Gaussian cut at four sigma, edges reflected: one weighted sum along y and, unless width is None, one along x.

    The weights broadcast are a row for each place on a side and each offset. Pixels that are missing count as 0.
    """
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    spark, total, out = pixels.sparkSession, sum(raw), pixels.select(*PIXEL, F.col(channel).alias("value"))
    for axis, size in (("y", height), ("x", width))[: 1 if width is None else 2]:
        at, weight = F.pmod(F.col("t") + F.col("d"), F.lit(2 * size)), F.element_at(F.array(*(F.lit(w / total) for w in raw)), (F.col("d") + reach + 1).cast("int"))
        steps = spark.range(size).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("d"))
        weights = steps.select("t", F.least(at, 2 * size - 1 - at).alias("src"), weight.alias("w")).groupBy("t", "src").agg(F.sum("w").alias("w"))
        joined = out.join(F.broadcast(weights), F.col(axis) == F.col("src"))
        other = "x" if axis == "y" else "y"
        out = joined.groupBy(*FRAME, other, "t").agg(F.sum(F.col("value") * F.col("w")).alias("value")).withColumnRenamed("t", axis)
    return out.select(*FRAME, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value")


def background_subtracted(pixels: DataFrame, channel: str, height: int, width: int, bin_size: int = 100, sigma: float = 2) -> DataFrame:
    """A channel less its background, plus the standard deviation of its frame, blurred (unless sigma is 0) and at least 0.

    The background is known where label is 0: the mean of such pixels in each block of bin_size by bin_size, brought to every pixel by bilinear
    interpolation between the blocks' centres, level beyond the outermost ones. Blocks without such pixels take the mean of the frame's; a frame
    without any has background 0. A frame's blocks, ceil(height / bin_size) * ceil(width / bin_size) at most, are one map. Nulls do not count as
    background and stay null without blur. An empty table gives an empty one.
    """
    bins = {"y": -(-height // bin_size), "x": -(-width // bin_size)}
    place = lambda y, x: (y * bins["x"] + x).cast("int")
    block = place(F.floor(F.col("y") / bin_size), F.floor(F.col("x") / bin_size))
    empty = pixels.where(F.col("label") == 0).groupBy(*FRAME, block.alias("block")).agg(F.avg(channel).alias("mean")).where("mean is not null")
    grids = empty.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("block", "mean"))).alias("_grid"))
    frames = pixels.groupBy(*FRAME).agg(F.stddev_pop(channel).alias("_spread"), F.avg(F.when(F.col("label") == 0, F.col(channel))).alias("_level"))
    frames = frames.join(grids, FRAME, "left")
    at = {c: F.least(F.greatest((F.col(c) + 0.5) / bin_size - 0.5, F.lit(0.0)), F.lit(float(n - 1))) for c, n in bins.items()}
    rows = pixels.select(*PIXEL, F.col(channel).cast("double").alias("value"), *(a.alias(f"_{c}") for c, a in at.items())).join(frames, FRAME)

    def corner(dy: int, dx: int) -> Column:
        y, x = (F.least(F.floor(f"_{c}") + d, F.lit(bins[c] - 1)) for c, d in (("y", dy), ("x", dx)))
        wy, wx = (F.col(f"_{c}") - F.floor(f"_{c}") if d else 1 - F.col(f"_{c}") + F.floor(f"_{c}") for c, d in (("y", dy), ("x", dx)))
        return wy * wx * F.coalesce(F.try_element_at("_grid", place(y, x)), "_level", F.lit(0.0))

    back = corner(0, 0) + corner(0, 1) + corner(1, 0) + corner(1, 1)
    less = rows.select(*PIXEL, (F.col("value") - back + F.col("_spread")).alias("value"))
    calm = blur(less, "value", height, width, sigma) if sigma > 0 else less
    return calm.withColumn("value", F.when(F.col("value") < 0, 0.0).otherwise(F.col("value")))


def blurred_intensity(pixels: DataFrame, channel: str, height: int, width: int, sigma: float, percentile: float = 0.9) -> DataFrame:
    """Percentile of a blurred channel in each cell, cut to an integer."""
    calm = blur(pixels, channel, height, width, sigma).withColumn("value", F.round("value", 6))
    return intensity(pixels.select(*PIXEL, "label").join(calm, PIXEL), "value", percentile)


def outline_text(vertices: DataFrame) -> DataFrame:
    """Each cell's outline (vertices in order of k) as a closed WKT polygon; null with fewer than three vertices."""
    points = vertices.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("k", "px", "py"))).alias("p"))
    text = F.transform("p", lambda v: F.concat_ws(" ", v["px"].cast("string"), v["py"].cast("string")))
    ring = F.array_join(F.concat(text, F.slice(text, 1, 1)), ", ")
    return points.select(*CELL, F.when(F.size("p") >= 3, F.concat(F.lit("POLYGON (("), ring, F.lit("))"))).alias("outline"))


def quadratic_surface(pixels: DataFrame, value: str) -> DataFrame:
    """Least-squares surface a (x^2 + y^2) + b x + c y + d of each plane, null values left out: coefficients and number of pixels.

    Sums of monomials are aggregated by plane; the 4 x 4 system is then solved by elimination for one row a plane.
    """
    basis = [F.col("x") * F.col("x") + F.col("y") * F.col("y"), F.col("x"), F.col("y"), F.lit(1)]
    basis = [b.cast("double") for b in basis]
    known = pixels.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sums = [F.sum(basis[i] * basis[j]).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)] + [F.sum(b * F.col(value)).alias(f"v{i}") for i, b in enumerate(basis)]
    table = known.groupBy(*FRAME).agg(F.count("*").alias("n"), *sums)
    for k in range(4):
        steps = {}
        for i in range(k + 1, 4):
            ratio = F.try_divide(F.col(f"m{k}{i}"), F.col(f"m{k}{k}"))
            steps |= {f"m{i}{j}": F.col(f"m{i}{j}") - ratio * F.col(f"m{k}{j}") for j in range(i, 4)}
            steps[f"v{i}"] = F.col(f"v{i}") - ratio * F.col(f"v{k}")
        table = table.withColumns(steps) if steps else table
    for k, name in reversed(list(enumerate("abcd"))):
        rest = F.col(f"v{k}")
        for j in range(k + 1, 4):
            rest = rest - F.col(f"m{k}{j}") * F.col("abcd"[j])
        table = table.withColumn(name, F.try_divide(rest, F.col(f"m{k}{k}")))
    return table.select(*FRAME, "a", "b", "c", "d", "n")
