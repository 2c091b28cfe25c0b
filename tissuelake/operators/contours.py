"""Outlines of cells as ordered points, polygons filled with pixels, ellipses through outlines.

A contour is found by list ranking and not by walking: every side of a pixel at which its cell ends is a directed edge that knows the edge after
it, and pointers along the edges are doubled until each knows how far it is from its loop's first edge. No task holds a cell or a plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import dropped, saved
from .zonal import CELL, FRAME, cells

_EDGE = [*FRAME, "code"]


def _beside(own: DataFrame) -> DataFrame:
    """Cells' pixels with a flag for each of the eight places around that the same cell has: n, s, w, e and the corners.

    One window along each of the four directions; each sees a line of one cell, so gaps between pixels may have any width.
    """
    x, y = F.col("x"), F.col("y")
    lines = [("w", "e", y, "x"), ("n", "s", x, "y"), ("nw", "se", x - y, "y"), ("ne", "sw", x + y, "y")]
    out = own
    for before, after, line, along in lines:
        w = W.partitionBy(*FRAME, "label", "_line").orderBy(along)
        out = out.withColumn("_line", line)
        out = out.withColumns({before: F.coalesce(F.lag(along).over(w) == F.col(along) - 1, F.lit(False)), after: F.coalesce(F.lead(along).over(w) == F.col(along) + 1, F.lit(False))})
    return out.drop("_line")


#: Sides of a pixel in the order of the walk, cell on the left hand: the flag of the place beyond it, and steps (dy, dx) to the pixel straight on and to the one across.
_WALK = [("w", "s", (1, 0), "sw", (1, -1)), ("s", "e", (0, 1), "se", (1, 1)), ("e", "n", (-1, 0), "ne", (-1, 1)), ("n", "w", (0, -1), "nw", (-1, -1))]


def _code(y: Column, x: Column, side: int) -> Column:
    """A side as one number, in raster order."""
    return (y.cast("long") * (1 << 22) + x * 4 + side).cast("long")


def edges(pixels: DataFrame) -> DataFrame:
    """Sides at which cells end: (stack_id, frame, code, label, y, x, next, turns, part): the code of the side after it, whether that is another pixel's, and its share of twice the loop's area.

    Corners that touch belong together, so the walk crosses to the pixel across a corner before it goes straight on or turns.
    """
    y, x = F.col("y"), F.col("x")
    sides = []
    for k, (out, straight, (sy, sx), across, (ay, ax)) in enumerate(_WALK):
        following = F.when(F.col(across), _code(y + ay, x + ax, (k + 3) % 4)).when(F.col(straight), _code(y + sy, x + sx, k)).otherwise(_code(y, x, (k + 1) % 4))
        area = {0: -x, 2: x + 1}.get(k, F.lit(0))
        sides.append(F.when(~F.col(out), F.struct(_code(y, x, k).alias("code"), following.alias("next"), (F.col(across) | F.col(straight)).alias("turns"), area.cast("long").alias("part"))))
    found = _beside(cells(pixels).select(*FRAME, "y", "x", "label")).select(*FRAME, "label", "y", "x", F.explode(F.array_compact(F.array(*sides))).alias("e"))
    return found.select(*FRAME, "e.code", "label", "y", "x", "e.next", "e.turns", "e.part")


def loops(sides: DataFrame) -> DataFrame:
    """edges() with `first` (the smallest code of its loop) and `left` (points of the contour from this edge to the loop's end, itself included).

    A doubling round joins each edge to the one that its pointer has reached. Rounds end when no edge learns of a smaller code: after about log2
    of the longest loop. A round's table is dropped once the next is written.
    """
    one = F.col("turns").cast("long")
    # best: smallest code within reach and the points before it; points: those within reach
    state = saved(sides.select(*_EDGE, "next", one.alias("points"), F.col("code").alias("first"), F.lit(0).cast("long").alias("left")))
    while True:
        ahead = state.select(*FRAME, F.col("code").alias("next"), F.col("next").alias("_next"), F.col("points").alias("_points"), F.col("first").alias("_first"), F.col("left").alias("_left"))
        nearer = F.col("_first") < F.col("first")
        step = state.join(ahead, [*FRAME, "next"]).select(
            *_EDGE, F.col("_next").alias("next"), (F.col("points") + F.col("_points")).alias("points"), F.when(nearer, F.col("_first")).otherwise(F.col("first")).alias("first"),
            F.when(nearer, F.col("points") + F.col("_left")).otherwise(F.col("left")).alias("left"), nearer.alias("learned"),
        )
        step = saved(step)
        dropped(state)
        state = step.drop("learned")
        if step.where("learned").isEmpty():
            return sides.drop("next").join(state.select(*_EDGE, "first", "left"), _EDGE)


def contours(pixels: DataFrame, least: int = 5) -> DataFrame:
    """(stack_id, frame, label, k, y, x): the outer contour of each cell from its first pixel in raster order, down its left side first.

    Corners that touch belong together; pixels that are passed twice come twice; holes have no contour. Of a cell in several parts the longest
    contour counts (of equal ones the first in raster order), and contours of fewer than `least` points are left out. Background (label 0) has
    none. Pixels that are missing count as background; an empty table gives an empty one.
    """
    placed = saved(loops(edges(pixels)))
    whole = placed.groupBy(*CELL, "first").agg(F.sum(F.col("turns").cast("long")).alias("n"), F.sum("part").alias("area"))
    # a single pixel turns nowhere; inner loops have the cell outside and a negative area
    longest = whole.where("area > 0").groupBy(*CELL).agg(F.max_by(F.struct("first", "n"), F.struct("n", -F.col("first"))).alias("best")).where(F.col("best.n") >= least)
    points = placed.where("turns").join(longest.select(*CELL, F.col("best.first").alias("first"), F.col("best.n").alias("n")), [*CELL, "first"])
    # the loop's first edge is reached again after all points: `left` is 0 there, where it stands for all n
    left = F.when((F.col("code") == F.col("first")), F.col("n")).otherwise(F.col("left"))
    return points.select(*CELL, (F.col("n") - left).cast("int").alias("k"), "y", "x")


def fill(vertices: DataFrame) -> DataFrame:
    """(stack_id, frame, label, y, x): pixels within or on the closed outlines of vertices(stack_id, frame, label, k, py, px), k in order.

    Rows of pixels are cut at the outline's crossings; between two of them pixels belong to it if the outline winds around them, so that outlines
    may cross themselves. Pixels that lie on an edge belong too. An outline of two vertices is a line, of one a point; nulls are left out.
    """
    known = vertices.where("py is not null and px is not null").select(*CELL, "k", F.col("py").cast("double").alias("y0"), F.col("px").cast("double").alias("x0"))
    order = W.partitionBy(*CELL).orderBy("k")
    first = {c: F.first(c).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) for c in ("y0", "x0")}
    sides = known.withColumns({"y1": F.coalesce(F.lead("y0").over(order), first["y0"]), "x1": F.coalesce(F.lead("x0").over(order), first["x0"])})
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    bounds = sides.withColumns({"_a": F.ceil(lo).cast("int"), "_b": F.floor(hi).cast("int"), "_hi": hi}).where("_a <= _b")
    at = bounds.withColumn("y", F.explode(F.sequence("_a", "_b")))
    cross = F.when(F.col("y0") == F.col("y1"), F.col("x0")).otherwise(F.round(F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")), 9))
    at = at.withColumn("cross", cross)
    flat = F.col("y0") == F.col("y1")
    # pixels on edges: where an edge meets a row, and all along level edges
    ends = F.when(flat, F.struct(F.ceil(F.least("x0", "x1")).alias("a"), F.floor(F.greatest("x0", "x1")).alias("b"))).otherwise(F.struct(F.ceil("cross").alias("a"), F.floor("cross").alias("b")))
    on = at.select(*CELL, "y", ends.alias("s"))
    # an edge counts in the rows from its upper end to before its lower one
    passed = at.where(~flat & (F.col("y") < F.col("_hi"))).select(*CELL, "y", "cross", F.when(F.col("y1") > F.col("y0"), 1).otherwise(-1).alias("way"))
    row = W.partitionBy(*CELL, "y").orderBy("cross", "way")
    turns = F.sum("way").over(row.rowsBetween(W.unboundedPreceding, 0))
    within = passed.withColumns({"turns": turns, "upto": F.lead("cross").over(row)}).where("turns <> 0 and upto is not null")
    within = within.select(*CELL, "y", F.struct(F.ceil("cross").alias("a"), F.floor("upto").alias("b")).alias("s"))
    spans = within.unionByName(on).where("s.a <= s.b")
    return spans.select(*CELL, "y", F.explode(F.sequence(F.col("s.a").cast("int"), F.col("s.b").cast("int"))).alias("x")).distinct()


_POWERS = [(i, j) for i in range(5) for j in range(5 - i)]
_AXES = "cx double, cy double, major double, minor double, aspect double, theta double"


def _conics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ellipses from sums of monomials: the conic of least algebraic distance among those with 4ac - b^2 = 1."""
    for rows in batches:
        s = {p: rows[f"m{p[0]}{p[1]}"].to_numpy(float) for p in _POWERS}
        square, line = [(2, 0), (1, 1), (0, 2)], [(1, 0), (0, 1), (0, 0)]
        block = lambda left, right: np.stack([np.stack([s[a[0] + b[0], a[1] + b[1]] for b in right], -1) for a in left], -2)
        out = pd.DataFrame(np.full((len(rows), 6), np.nan), columns=["cx", "cy", "major", "minor", "aspect", "theta"])
        inner = block(line, line)
        fit = np.flatnonzero((rows["n"].to_numpy() >= 5) & (np.abs(np.linalg.det(inner)) > 1e-9))
        if len(fit):
            rest = -np.linalg.solve(inner[fit], np.swapaxes(block(square, line)[fit], 1, 2))
            reduced = block(square, square)[fit] + block(square, line)[fit] @ rest
            bound = np.array([[0, 0, 0.5], [0, -1, 0], [0.5, 0, 0]])  # inverse of the matrix of 4ac - b^2
            _, vectors = np.linalg.eig(bound @ reduced)
            vectors = np.real(vectors)
            inside = 4 * vectors[:, 0] * vectors[:, 2] - vectors[:, 1] ** 2
            best = inside.argmax(axis=1)
            at = np.arange(len(fit))
            a, b, c = vectors[at, :, best].T
            d, e, f = np.einsum("nij,nj->ni", rest, np.stack([a, b, c], -1)).T
            good = inside[at, best] > 1e-12
            det = np.where(good, 4 * a * c - b * b, 1.0)
            x, y = (b * e - 2 * c * d) / det, (b * d - 2 * a * e) / det
            level = -(f + (d * x + e * y) / 2)
            middle, spread = (a + c) / 2, np.hypot((a - c) / 2, b / 2)
            with np.errstate(all="ignore"):
                radii = np.sqrt(np.stack([level / (middle - spread), level / (middle + spread)]))
            # along the longer axis the form is smallest in size
            turn = 0.5 * np.arctan2(-b * np.sign(middle), (c - a) * np.sign(middle))
            values = np.stack([x + rows["ox"].to_numpy()[fit], y + rows["oy"].to_numpy()[fit], radii.max(0), radii.min(0), radii.max(0) / radii.min(0), np.mod(turn, np.pi)], -1)
            out.iloc[fit] = np.where(good[:, None], values, np.nan)
        yield pd.concat([rows[CELL].reset_index(drop=True), out], axis=1)


def ellipses(points: DataFrame) -> DataFrame:
    """Ellipse through the outline of each cell: centre, half axes, aspect (1 or more) and theta (of the longer axis, from x towards y, in [0, pi)).

    points has (stack_id, frame, label, x, y). Sums of monomials about the cell's first point are all that is gathered; null where points are fewer
    than five or on a line.
    """
    own = points.select(*CELL, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null")
    origin = own.groupBy(*CELL).agg(F.floor(F.avg("x")).cast("double").alias("ox"), F.floor(F.avg("y")).cast("double").alias("oy"))
    moved = own.join(origin, CELL).withColumns({"x": F.col("x") - F.col("ox"), "y": F.col("y") - F.col("oy")})
    power = lambda c, n: F.lit(1.0) if n == 0 else F.col(c) if n == 1 else F.pow(c, F.lit(float(n)))
    sums = moved.groupBy(*CELL).agg(F.count("*").alias("n"), F.first("ox").alias("ox"), F.first("oy").alias("oy"), *(F.sum(power("x", i) * power("y", j)).alias(f"m{i}{j}") for i, j in _POWERS))
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in CELL)
    return sums.mapInPandas(_conics, f"{kinds}, {_AXES}")
