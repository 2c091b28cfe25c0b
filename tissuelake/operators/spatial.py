"""Neighbourhoods: adjacency and junctions of label images, and a grid join for points within a radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .zonal import FRAME, cells


def _moved(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """A row for each pixel and offset, at the place that the offset leads to."""
    step = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets)))
    moved = pixels.select(*FRAME, "y", "x", F.col("label"), step.alias("d"))
    return moved.select(*FRAME, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), "label")


def adjacency(pixels: DataFrame) -> DataFrame:
    """Pairs a < b of cells that touch at a side or corner. Half of the eight directions see every pair once."""
    own = cells(pixels)
    other = _moved(own, [(0, 1), (1, 0), (1, 1), (1, -1)]).withColumnRenamed("label", "other")
    pairs = own.join(other, [*FRAME, "y", "x"]).where("label <> other")
    return pairs.select(*FRAME, F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()


def junctions(pixels: DataFrame) -> DataFrame:
    """Corners of four pixels at which three cells or more meet, with the cells."""
    corners = _moved(cells(pixels), [(0, 0), (0, 1), (1, 0), (1, 1)]).groupBy(*FRAME, "y", "x")
    met = corners.agg(F.count("*").alias("n"), F.sort_array(F.collect_set("label")).alias("cells"))
    return met.where("n = 4 and size(cells) >= 3").select(*FRAME, "y", "x", "cells")


_SIDES = [(0, 1), (1, 0), (0, -1), (-1, 0)]


def outline(pixels: DataFrame) -> DataFrame:
    """Pixels of cells with a side at another cell, the background or the image's edge."""
    own = cells(pixels).select(*FRAME, "y", "x", "label")
    same = own.join(_moved(own, _SIDES), [*FRAME, "y", "x", "label"], "inner").groupBy(*FRAME, "y", "x", "label").count().where("count = 4")
    return own.join(same, [*FRAME, "y", "x", "label"], "left_anti")


def good_cells(pixels: DataFrame, least: int = 3) -> DataFrame:
    """Cells of which no pixel has a side at the background or the image's edge, with `least` junctions or more."""
    own = cells(pixels).select(*FRAME, "y", "x", "label")
    beside = _moved(own, _SIDES).drop("label")
    open_ = own.join(beside.groupBy(*FRAME, "y", "x").count().where("count = 4"), [*FRAME, "y", "x"], "left_anti").select(*FRAME, "label").distinct()
    met = junctions(pixels).select(*FRAME, F.explode("cells").alias("label")).groupBy(*FRAME, "label").agg(F.count("*").alias("n_junctions")).where(F.col("n_junctions") >= least)
    return met.join(open_, [*FRAME, "label"], "left_anti")


def cell_vertices(pixels: DataFrame, least: int = 3) -> DataFrame:
    """Vertices (k, px, py) of the good cells: their junctions, numbered row by row."""
    at = junctions(pixels).select(*FRAME, F.col("x").alias("px"), F.col("y").alias("py"), F.explode("cells").alias("label"))
    own = at.join(good_cells(pixels, least).select(*FRAME, "label"), [*FRAME, "label"], "left_semi")
    return own.withColumn("k", F.row_number().over(W.partitionBy(*FRAME, "label").orderBy("py", "px")) - 1)


#: A little more than 1: so much wider than the radius are grid cells, and what is kept before roots decide, so that rounding loses no pair.
WIDER = 1 + 2.0**-40


def grid_join(left: DataFrame, right: DataFrame, keys: list[str], radius: Column | float, by_root: bool = False) -> DataFrame:
    """Pairs within a radius on equal keys. Each left point meets the right points of its own and the eight cells around, of the radius's size.

    left has (lx, ly), right (rx, ry); a point is in one grid cell, so that no pair comes twice. Both sides are shuffled by cell: by the size of its
    files one of them might be broadcast, nine rows a point, and pairs be made by as few tasks as there are frames. A pair at the radius is told by
    squares, or with by_root by the rounded distance, which takes squares a last digit over the radius's as well.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    bucket = lambda c: F.floor(F.col(c) / (r * WIDER)).cast("long")
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    spread = left.withColumn("_n", near).withColumn("_gx", bucket("lx") + F.col("_n.i")).withColumn("_gy", bucket("ly") + F.col("_n.j")).drop("_n")
    placed = right.withColumn("_gx", bucket("rx")).withColumn("_gy", bucket("ry"))
    dx, dy = F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")
    square = dx * dx + dy * dy  # two in three pairs of the cells are too far apart: squares tell it, roots are for the rest
    found = spread.join(placed.hint("merge"), [*keys, "_gx", "_gy"]).where(square <= (r * r * WIDER if by_root else r * r)).withColumn("distance", F.sqrt(square)).drop("_gx", "_gy")
    return found.where(F.col("distance") <= r) if by_root else found


def division_radius(areas: DataFrame, factor: float) -> float:
    """The radius for division candidates by the size of cells: factor times the mean over frames of the root of the 90th percentile of areas(stack_id, frame, area)."""
    sizes = areas.groupBy(*FRAME).agg(F.sqrt(F.percentile("area", F.lit(0.9))).alias("size"))
    return factor * (sizes.agg(F.avg("size")).first()[0] or 0.0)


def division_candidates(tracks: DataFrame, radius: float, persistence: int = 0) -> DataFrame:
    """Tracks that end with two or more tracks that begin in the next frame nearer than the radius: mother, daughter, frame, distance. Tracks of `persistence` points or fewer do not count."""
    point = F.struct("frame", "x", "y")
    ends = tracks.groupBy("stack_id", "particle").agg(F.max_by(point, "frame").alias("last"), F.min_by(point, "frame").alias("first"), F.count("*").alias("n")).where(F.col("n") > persistence)
    mothers = ends.select("stack_id", (F.col("last.frame") + 1).alias("frame"), F.col("particle").alias("mother"), F.col("last.x").alias("lx"), F.col("last.y").alias("ly"))
    daughters = ends.where("first.frame > 0").select("stack_id", "first.frame", F.col("particle").alias("daughter"), F.col("first.x").alias("rx"), F.col("first.y").alias("ry"))
    found = grid_join(mothers, daughters, ["stack_id", "frame"], radius).where(F.col("distance") < radius)
    enough = found.groupBy("stack_id", "mother").count().where("count >= 2").select("stack_id", "mother")
    return found.join(enough, ["stack_id", "mother"], "left_semi").select("stack_id", "mother", "daughter", "frame", "distance")
