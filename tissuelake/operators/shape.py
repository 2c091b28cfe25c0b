"""Polygon geometry from vertices(stack_id, frame, label, k, px, py) in order of k, closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .zonal import CELL


def _edges(vertices: DataFrame) -> DataFrame:
    """Vertices with the next one, (nx, ny); the first follows the last."""
    order = W.partitionBy(*CELL).orderBy("k")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return vertices.withColumns({f"n{c}": F.coalesce(F.lead(f"p{c}").over(order), F.first(f"p{c}").over(every)) for c in "xy"})


def polygons(vertices: DataFrame) -> DataFrame:
    """Area, perimeter, circularity, centroid (by signed area) and spherical volume of each polygon: one sort a polygon, one aggregation."""
    edges = _edges(vertices).withColumn("cross", F.col("px") * F.col("ny") - F.col("nx") * F.col("py"))
    sums = edges.groupBy(*CELL).agg(
        (F.sum("cross") / 2).alias("signed"),
        F.sum(F.hypot(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))).alias("perimeter"),
        *(F.sum((F.col(f"p{c}") + F.col(f"n{c}")) * F.col("cross")).alias(f"s{c}") for c in "xy"),
    )
    area = F.abs("signed")
    return sums.select(
        *CELL,
        area.alias("area"),
        "perimeter",
        (4 * F.pi() * area / F.pow("perimeter", F.lit(2))).alias("circularity"),
        *((F.col(f"s{c}") / (6 * F.col("signed"))).alias(f"c{c}") for c in "xy"),
        (4 / 3 * F.pi() * F.pow(area / F.pi(), F.lit(1.5))).alias("spherical_volume"),
    )


def _axis(xx: Column, xy: Column, yy: Column) -> list[Column]:
    """Angle of the major axis of a scatter matrix, and the smaller eigenvalue by the larger. Off-diagonals of rounding size count as none."""
    xy = F.round(xy, 9) + 0.0
    spread, middle = F.hypot((xx - yy) / 2, xy), (xx + yy) / 2
    return [(F.atan2(2 * xy, F.round(xx - yy, 9) + 0.0) / 2).alias("theta"), F.try_divide(middle - spread, middle + spread).alias("ratio")]


def vertex_axis(vertices: DataFrame) -> DataFrame:
    """Axis of each polygon's vertices: theta and ratio, from their scatter about the mean."""
    m = vertices.groupBy(*CELL).agg(F.var_pop("px").alias("xx"), F.covar_pop("px", "py").alias("xy"), F.var_pop("py").alias("yy"))
    return m.select(*CELL, *_axis(F.col("xx"), F.col("xy"), F.col("yy")))


def perimeter_axis(vertices: DataFrame) -> DataFrame:
    """Axis of each polygon's sides, weighed by their length: theta and ratio, from the scatter of the closed line about its centre of mass."""
    sides = _edges(vertices).withColumn("l", F.hypot(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")))
    centre = sides.groupBy(*CELL).agg(*((F.sum((F.col(f"p{c}") + F.col(f"n{c}")) / 2 * F.col("l")) / F.sum("l")).alias(f"c{c}") for c in "xy"))
    moved = sides.join(centre, CELL).select(*CELL, "l", *((F.col(f"{v}{c}") - F.col(f"c{c}")).alias(f"{v}{c}") for v in "pn" for c in "xy"))
    part = lambda a, b: F.sum(F.col("l") * ((F.col(f"n{a}") * F.col(f"n{b}") + F.col(f"p{a}") * F.col(f"p{b}")) / 3 + (F.col(f"n{a}") * F.col(f"p{b}") + F.col(f"p{a}") * F.col(f"n{b}")) / 6))
    m = moved.groupBy(*CELL).agg(part("x", "x").alias("xx"), part("x", "y").alias("xy"), part("y", "y").alias("yy"))
    return m.select(*CELL, *_axis(F.col("xx"), F.col("xy"), F.col("yy")))


def sort_vertices(vertices: DataFrame) -> DataFrame:
    """Vertices numbered anew by their angle about the mean, from -pi on; ties by y, x."""
    mean = vertices.groupBy(*CELL).agg(F.avg("px").alias("_cx"), F.avg("py").alias("_cy"))
    turned = vertices.join(mean, CELL).withColumn("_a", F.round(F.atan2(F.col("py") - F.col("_cy"), F.col("px") - F.col("_cx")), 9))
    return turned.withColumn("k", F.row_number().over(W.partitionBy(*CELL).orderBy("_a", "py", "px")) - 1).drop("_a", "_cx", "_cy")


def shape_parameters(vertices: DataFrame) -> DataFrame:
    """Area and perimeter of each polygon, its vertices sorted by angle, and q, the perimeter by the area's root."""
    return polygons(sort_vertices(vertices)).select(*CELL, "area", "perimeter", F.try_divide(F.col("perimeter"), F.sqrt("area")).alias("q"))
