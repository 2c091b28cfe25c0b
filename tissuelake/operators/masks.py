"""Edits of label planes that tracks and divisions follow: cells cut by lines, merged, deleted; frames taken out.

Tracks have (stack_id, frame, particle, cell_number, y, x, ...), where cell_number is the label less 1; divisions have (stack_id, frame, mother, daughter1, daughter2, ...).
Each function takes whole tables of edits and works on all frames at once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import components, label_components, saved
from .edits import ROLES
from .zonal import CELL, FRAME, cells

PIXEL = [*FRAME, "y", "x"]
PART = [*CELL, "cy", "cx"]
_SIDES = [(0, 1), (1, 0), (0, -1), (-1, 0)]
_CORNERS = [(1, 1), (1, -1), (-1, 1), (-1, -1)]


def drawn_lines(vertices: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x): pixels of the open polylines through vertices(by, k, y, x) in order of k, whole numbers. A line of one vertex is a pixel.

    A side takes one pixel for each step of its longer direction; halves of the other direction are rounded up.
    """
    order = W.partitionBy(*by).orderBy("k")
    sides = vertices.where("y is not null and x is not null").select(*by, F.col("y").alias("y0"), F.col("x").alias("x0"), F.lead("y").over(order).alias("y1"), F.lead("x").over(order).alias("x1"))
    sides = sides.withColumns({"_dy": F.coalesce(F.col("y1") - F.col("y0"), F.lit(0)), "_dx": F.coalesce(F.col("x1") - F.col("x0"), F.lit(0))})
    sides = sides.withColumn("_n", F.greatest(F.abs("_dy"), F.abs("_dx"))).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"))))
    at = lambda c: (F.col(f"{c}0") + F.when(F.col("_n") > 0, F.floor((2 * F.col("_i") * F.col(f"_d{c}") + F.col("_n")) / (2 * F.col("_n")))).otherwise(0)).cast("int").alias(c)
    return sides.select(*by, at("y"), at("x")).distinct()


def _beside(places: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """places with (ny, nx) of their neighbours and the neighbour's place in the list of steps."""
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(steps)))).alias("_d")
    return places.select("*", step).withColumns({"ny": F.col("y") + F.col("_d.dy"), "nx": F.col("x") + F.col("_d.dx"), "_step": F.col("_d.i")}).drop("_d")


def _parts(own: DataFrame) -> DataFrame:
    """own(stack_id, frame, label, y, x, line) with the part (cy, cx) that each pixel of a cell is in; null for line pixels that no part reaches.

    Parts are what is left of a cell between the lines. A pixel of a line joins a part at its sides, else at its corners, of several the largest one
    (of equal ones the first in raster order); where lines are thick this goes on from pixel to pixel.
    """
    placed = saved(label_components(own.where("not line").select(*PIXEL, "label")))
    sizes = saved(placed.groupBy(*PART).agg(F.count("*").alias("n")))
    left = saved(own.where("line").select(*PIXEL, "label"))
    while True:
        at = placed.select(*CELL, F.col("y").alias("ny"), F.col("x").alias("nx"), "cy", "cx").join(sizes, PART)
        near = _beside(left, _SIDES + _CORNERS).join(at, [*CELL, "ny", "nx"])
        rank = F.struct((F.col("_step") >= 4).alias("corner"), -F.col("n"), "cy", "cx")
        near = saved(near.groupBy(*PIXEL, "label").agg(F.min_by(F.struct("cy", "cx"), rank).alias("p")).select(*PIXEL, "label", "p.cy", "p.cx"))
        if near.isEmpty():
            return placed.unionByName(left.withColumns({"cy": F.lit(None).cast("int"), "cx": F.lit(None).cast("int")}))
        placed = saved(placed.unionByName(near))
        left = saved(left.join(near, [*PIXEL, "label"], "left_anti"))


def _joined(least: int):
    """Small parts of one cell, the largest first, go to the large part with which they share most sides; those that share none wait for others, then go to the nearest centre."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = rows[rows["kind"] == 0].sort_values(["n", "cy", "cx"], ascending=[False, True, True]).reset_index(drop=True)
        place = {(r.cy, r.cx): i for i, r in enumerate(parts.itertuples())}
        shared: dict[int, dict[int, int]] = {i: {} for i in place.values()}
        for r in rows[rows["kind"] == 1].itertuples():
            shared[place[r.cy, r.cx]][place[int(r.oy), int(r.ox)]] = int(r.n)
        size = parts["n"].to_list()
        home = {i: i for i in shared if size[i] >= least}
        waiting = [i for i in shared if i not in home]
        while waiting and home:
            best = None
            for i in waiting:
                sides: dict[int, int] = {}
                for j, n in shared[i].items():
                    if j in home:
                        sides[home[j]] = sides.get(home[j], 0) + n
                if sides:
                    best = i, max(sides, key=lambda j: (sides[j], -j))
                    break
            if best is None:
                i = waiting[0]
                apart = (parts["my"] - parts["my"][i]) ** 2 + (parts["mx"] - parts["mx"][i]) ** 2
                best = i, min(set(home.values()), key=lambda j: (apart[j], j))
            home[best[0]] = best[1]
            waiting.remove(best[0])
        total = [0] * len(size)
        for i in shared:
            home.setdefault(i, 0)
            total[home[i]] += size[i]
        heads = sorted((j for j in set(home.values())), key=lambda j: (-total[j], j))
        rank = {j: k for k, j in enumerate(heads)}
        out = parts[["stack_id", "frame", "label", "cy", "cx"]].copy()
        out["place"] = [rank[home[i]] for i in range(len(parts))]
        return out

    return run


def split_cells(pixels: DataFrame, cuts: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """pixels with the cells that lines cut in parts, and made(stack_id, frame, label, parent): the cells that are new.

    cuts(stack_id, frame, cut, k, y, x) are polylines through whole pixels, vertices in order of k; all lines of a frame cut at once. The largest part
    keeps the label, the others are numbered after the frame's last label, by parent and size. Parts of fewer than `least` pixels join the part with
    the longest shared border; if all parts are small, the cell stays whole. A line that ends within a cell leaves it whole, and so does one that
    covers it. Background is not cut; vertices without a place are left out; empty tables leave pixels as they are.
    """
    line = drawn_lines(cuts, [*FRAME, "cut"]).select(*PIXEL).distinct().withColumn("line", F.lit(True))
    marked = cells(pixels).select(*PIXEL, "label").join(line, PIXEL, "left").withColumn("line", F.coalesce("line", F.lit(False)))
    hit = marked.where("line").select(*CELL).distinct()
    parts = saved(_parts(saved(marked.join(hit, CELL, "left_semi"))))
    known = parts.where("cy is not null")
    none = lambda t: F.lit(None).cast(t)
    sizes = known.groupBy(*PART).agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"))
    other = known.select(*CELL, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("cy").alias("oy"), F.col("cx").alias("ox"))
    sides = _beside(known, _SIDES).join(other, [*CELL, "ny", "nx"]).where("cy <> oy or cx <> ox").groupBy(*PART, "oy", "ox").agg(F.count("*").alias("n"))
    rows = sizes.select(*PART, F.lit(0).alias("kind"), none("int").alias("oy"), none("int").alias("ox"), "n", "my", "mx").unionByName(sides.select(*PART, F.lit(1).alias("kind"), "oy", "ox", "n", none("double").alias("my"), none("double").alias("mx")))
    kinds = {c: t for c, t in parts.dtypes}
    joined = saved(rows.groupBy(*CELL).applyInPandas(_joined(least), ", ".join(f"{c} {kinds[c]}" for c in PART) + ", place int"))
    top = pixels.groupBy(*FRAME).agg(F.max("label").alias("top"))
    fresh = joined.where("place > 0").select(*CELL, "place").distinct().withColumn("_n", F.row_number().over(W.partitionBy(*FRAME).orderBy("label", "place")))
    made = saved(fresh.join(top, FRAME).select(*CELL, "place", (F.col("top") + F.col("_n")).cast(kinds["label"]).alias("_new")))
    moved = known.join(joined, PART).join(made, [*CELL, "place"]).select(*PIXEL, "_new")
    after = pixels.join(moved, PIXEL, "left").withColumn("label", F.coalesce("_new", "label")).select(*pixels.columns)
    return after, made.select(*FRAME, F.col("_new").alias("label"), F.col("label").alias("parent"))


def _centres(pixels: DataFrame) -> DataFrame:
    return cells(pixels).groupBy(*CELL).agg(F.avg("y").alias("_y"), F.avg("x").alias("_x"))


def _recentred(tracks: DataFrame, pixels: DataFrame, changed: DataFrame) -> DataFrame:
    """Tracks with the centres (means of pixels) of the cells of changed(stack_id, frame, label)."""
    moved = _centres(pixels.join(changed.select(*CELL).distinct(), CELL, "left_semi")).withColumn("cell_number", F.col("label") - 1).drop("label")
    return tracks.join(moved, [*FRAME, "cell_number"], "left").withColumns({"y": F.coalesce("_y", "y"), "x": F.coalesce("_x", "x")}).select(*tracks.columns)


def split_tracks(tracks: DataFrame, pixels: DataFrame, made: DataFrame) -> DataFrame:
    """Tracks after split_cells: the largest part goes on as its cell's track, each new cell is a track of its own.

    New ids follow the stack's largest one, by frame and label; their other columns are null. Centres of all parts are means of pixels.
    """
    kinds = dict(tracks.dtypes)
    kept = _recentred(tracks, pixels, made.select(*FRAME, F.col("parent").alias("label")))
    top = tracks.groupBy("stack_id").agg(F.max("particle").alias("top"))
    new = made.join(top, "stack_id", "left").join(_centres(pixels), CELL)
    place = F.row_number().over(W.partitionBy("stack_id").orderBy("frame", "label"))
    values = {"particle": F.coalesce("top", F.lit(-1)) + place, "cell_number": F.col("label") - 1, "y": F.col("_y"), "x": F.col("_x"), "stack_id": F.col("stack_id"), "frame": F.col("frame")}
    return kept.union(new.select(*(values.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in tracks.columns)))


def _closed_up(pixels: DataFrame, tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels without gaps in their order, cell numbers with them. A track's cell without pixels keeps its number."""
    new = saved(cells(pixels).select(*CELL).distinct().withColumn("_new", F.row_number().over(W.partitionBy(*FRAME).orderBy("label"))))
    kinds = dict(pixels.dtypes), dict(tracks.dtypes)
    planes = pixels.join(new, CELL, "left").withColumn("label", F.coalesce("_new", "label").cast(kinds[0]["label"])).select(*pixels.columns)
    numbers = new.select(*FRAME, (F.col("label") - 1).alias("cell_number"), (F.col("_new") - 1).alias("_number"))
    return planes, tracks.join(numbers, [*FRAME, "cell_number"], "left").withColumn("cell_number", F.coalesce("_number", "cell_number").cast(kinds[1]["cell_number"])).select(*tracks.columns)


def _with_members(divisions: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Without the divisions of which a member has lost its last point."""
    ids = lambda t: t.select("stack_id", "particle").distinct()
    lost = saved(ids(before).join(ids(after), ["stack_id", "particle"], "left_anti"))
    for r in ROLES:
        divisions = divisions.join(lost.withColumnRenamed("particle", r), ["stack_id", r], "left_anti").select(*divisions.columns)
    return divisions


def delete_cells(pixels: DataFrame, tracks: DataFrame, divisions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels, tracks and divisions without the cells of gone(stack_id, frame, label): they become background, labels close up.

    Their points leave the tracks, and divisions of tracks without any point left go. Cells that are not there change nothing.
    """
    out = gone.select(*CELL).distinct()
    planes = pixels.join(out.withColumn("_gone", F.lit(True)), CELL, "left").withColumn("label", F.when(F.col("_gone"), 0).otherwise(F.col("label"))).select(*pixels.columns)
    left = tracks.join(out.select(*FRAME, (F.col("label") - 1).alias("cell_number")), [*FRAME, "cell_number"], "left_anti").select(*tracks.columns)
    return *_closed_up(planes, left), _with_members(divisions, tracks, left)


def _keepers(merges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, second, first): for merges that hang together, the name that all take: the smallest that is only ever `first`, else the smallest."""
    pairs = saved(merges.where("first is not null and second is not null and first <> second").select(*keys, "first", "second").distinct())
    name = lambda c: F.struct(*keys, F.col(c).alias("id"))
    groups = components(pairs.select(name("first").alias("a"), name("second").alias("b")))
    named = groups.select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.id").alias("second"), "component")
    named = saved(named.join(pairs.select(*keys, "second", F.lit(True).alias("_taken")).distinct(), [*keys, "second"], "left"))
    keeper = named.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("_taken").isNull(), F.col("second"))), F.min("second")).alias("first"))
    return named.join(keeper, "component").where("first <> second").select(*keys, "second", "first")


def merge_cells(pixels: DataFrame, tracks: DataFrame, divisions: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels, tracks and divisions after merges(stack_id, frame, first, second): the pixels of cell `second` go to cell `first`, labels close up.

    Merges that share cells make one cell. Its track is that of the cell that stays, its centre the mean of all pixels; the points of the others go,
    and with them divisions of tracks without any point left. A cell that is not in its frame takes what is merged into it.
    """
    into = saved(_keepers(merges, FRAME))
    moved = into.select(*FRAME, F.col("second").alias("label"), F.col("first").alias("_first"))
    planes = saved(pixels.join(moved, CELL, "left").withColumn("label", F.coalesce("_first", "label").cast(dict(pixels.dtypes)["label"])).select(*pixels.columns))
    left = tracks.join(into.select(*FRAME, (F.col("second") - 1).alias("cell_number")), [*FRAME, "cell_number"], "left_anti").select(*tracks.columns)
    centred = saved(_recentred(left, planes, into.select(*FRAME, F.col("first").alias("label"))))
    return *_closed_up(planes, centred), _with_members(divisions, tracks, left)


def merge_track_masks(pixels: DataFrame, tracks: DataFrame, divisions: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pixels, tracks and divisions after merges(stack_id, first, second) of tracks: in frames that have both their cells become one, elsewhere the cells of `second` go to `first`.

    Of tracks that merges tie together one stays (the smallest that is only ever `first`); in a frame without it the cell of the smallest one stays.
    Divisions that name a merged track name the one that stays.
    """
    into = saved(_keepers(merges, ["stack_id"]))
    names = into.select("stack_id", F.col("second").alias("particle"), F.col("first").alias("_first"))
    kind = dict(tracks.dtypes)["particle"]
    owned = saved(tracks.join(names, ["stack_id", "particle"], "left").withColumn("_owner", F.coalesce("_first", "particle").cast(kind)).drop("_first"))
    stays = F.min_by("cell_number", F.struct(F.col("particle") != F.col("_owner"), "particle")).over(W.partitionBy(*FRAME, "_owner"))
    met = owned.withColumn("_stays", stays).where("cell_number <> _stays").select(*FRAME, (F.col("_stays") + 1).alias("first"), (F.col("cell_number") + 1).alias("second"))
    named = owned.withColumn("particle", F.col("_owner")).select(*tracks.columns)
    for r in ROLES:
        new = names.select("stack_id", F.col("particle").alias(r), "_first")
        divisions = divisions.join(new, ["stack_id", r], "left").withColumn(r, F.coalesce("_first", r).cast(dict(divisions.dtypes)[r])).select(*divisions.columns)
    return merge_cells(pixels, named, divisions, met)


def delete_frames(tracks: DataFrame, divisions: DataFrame, drift: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tracks, divisions and drift(stack_id, frame, ...) without the frames of gone(stack_id, frame); later frames move up.

    A division in a frame that goes is one of the frame that takes its place; divisions of tracks without any point left go. What is gathered is a
    stack's list of frames to delete.
    """
    lists = saved(gone.where("frame is not null").groupBy("stack_id").agg(F.collect_set("frame").alias("_gone")))

    def moved(rows: DataFrame, keep: bool) -> DataFrame:
        joined = rows.join(lists, "stack_id", "left")
        if not keep:
            joined = joined.where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("frame")))
        before = F.coalesce(F.size(F.filter("_gone", lambda g: g < F.col("frame"))), F.lit(0))
        return joined.withColumn("frame", F.when(F.col("_gone").isNull(), F.col("frame")).otherwise(F.col("frame") - before).cast(dict(rows.dtypes)["frame"])).select(*rows.columns)

    left = moved(tracks, False)
    return left, moved(_with_members(divisions, tracks, left), True), moved(drift, False)
