"""Lookups by cell, particle and frame, values brought along tracks and onto pixels, and plane-wise rescaling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .spatial import grid_join
from .tracks import TRACK
from .zonal import CELL, FRAME, cells

#: Counts of a full-scale voxel and the scales of its two channels.
NORI_COUNTS, NORI_PROTEIN, NORI_LIPID = 8192.0, 1.364256, 1.010101

#: Lines of pixels that go to a task as one group, and voxels that a task packs at once.
LINES, AT_ONCE = 8, 1 << 18

#: Numbers of a run of indices that are expanded at once, as a power of 2.
SPAN = 16


def unique_lookup(tracks: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key and how many different ones there are; null if more than one."""
    found = tracks.groupBy("stack_id", *keys).agg(F.min(value).alias(value), F.count_distinct(value).alias("n"))
    return found.withColumn(value, F.when(F.col("n") == 1, F.col(value)))


def trajectories(tracks: DataFrame) -> DataFrame:
    """A row a track with its points (frame, cell_number) in order. A track has at most a point a frame."""
    return tracks.groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.struct("frame", "cell_number"))).alias("points"))


def along_tracks(tracks: DataFrame, values: DataFrame, attribute: str, fill: float) -> DataFrame:
    """Tracks with an attribute of their cells, values(stack_id, frame, label, attribute); `fill` where a cell has none. Labels are cell numbers + 1."""
    keyed = values.select(*FRAME, (F.col("label") - 1).alias("cell_number"), attribute)
    return tracks.join(keyed, [*FRAME, "cell_number"], "left").withColumn(attribute, F.coalesce(attribute, F.lit(fill)))


def paint(pixels: DataFrame, values: DataFrame, attribute: str) -> DataFrame:
    """Pixels with an attribute of their cells; null on background."""
    return pixels.join(values.where("label <> 0").select(*CELL, attribute), CELL, "left")


def highlights(tracks: DataFrame, divisions: DataFrame, tail: int = 5) -> DataFrame:
    """Cells to mark near divisions (mother, daughter, frame): mothers up to `tail` frames before, daughters after, with a weight that fades."""
    mothers = divisions.select("stack_id", F.col("mother").alias("particle"), "frame", F.lit(-1).alias("way"))
    daughters = divisions.select("stack_id", F.col("daughter").alias("particle"), "frame", F.lit(1).alias("way"))
    marks = mothers.union(daughters).distinct().withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(tail))))
    marks = marks.select(*TRACK, (F.col("frame") + F.col("way") * F.col("d")).alias("frame"), "way", (1 - (F.col("d") + 1) / (tail + 1)).alias("weight"))
    return marks.join(tracks.select(*TRACK, "frame"), [*TRACK, "frame"], "left_semi")


def lifetimes(tracks: DataFrame) -> DataFrame:
    """Birth, death and number of points of each track, whether it begins after frame 0, and whether another begins with it.

    Births are counted by frame and joined back, so that no window holds all tracks of a frame.
    """
    life = tracks.groupBy(*TRACK).agg(F.min("frame").alias("birth"), F.max("frame").alias("death"), F.count("*").alias("n"))
    together = life.groupBy("stack_id", "birth").agg((F.count("*") > 1).alias("together"))
    return life.join(together, ["stack_id", "birth"]).select(*TRACK, "birth", "death", "n", (F.col("birth") != 0).alias("born"), "together")


def link_candidates(tracks: DataFrame, radius: float) -> DataFrame:
    """Points of one frame with the next frame's points within the radius: frame, a, b, distance."""
    here = tracks.select("stack_id", "frame", F.col("cell_number").alias("a"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    after = tracks.select("stack_id", (F.col("frame") - 1).alias("frame"), F.col("cell_number").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return grid_join(here, after, FRAME, radius).select(*FRAME, "a", "b", "distance")


def clear_frames(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Without the rows of frames(stack_id, frame)."""
    return rows.join(frames, FRAME, "left_anti")


def expand_ranges(specs: DataFrame, spec: str, name: str = "index") -> DataFrame:
    """A row for each index of a selection such as '1-10, 15, 18-17', as often as it has it, in no order.

    Runs are cut into spans of 2**SPAN numbers, which are dealt over the tasks: few bytes of a selection may be many rows, and a task buffers the rows
    that it makes of one row until it has them all.
    """
    ends = lambda part: F.split(F.trim(part), "-").cast("array<bigint>")
    runs = F.transform(F.split(F.col(spec), ","), lambda part: F.struct(ends(part)[0].alias("first"), F.element_at(ends(part), -1).alias("last")))
    spans = F.sequence(F.shiftright("_run.first", SPAN), F.shiftright("_run.last", SPAN))
    cut = specs.withColumn("_run", F.explode(runs)).withColumn("_span", F.explode(spans))
    dealt = cut.repartition(int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a number that is given is not coalesced
    low, high = F.shiftleft("_span", SPAN), F.shiftleft("_span", SPAN) + ((1 << SPAN) - 1)
    within = lambda end: F.greatest(low, F.least(high, F.col(f"_run.{end}")))
    return dealt.withColumn(name, F.explode(F.sequence(within("first"), within("last")))).drop("_run", "_span")


def rescale(pixels: DataFrame, channel: str, top: float = 65535.0) -> DataFrame:
    """A channel brought to 0..top between its plane's extremes; 0 on a constant plane. Extremes are a row a plane."""
    ends = pixels.groupBy(*FRAME).agg(F.min(channel).alias("_lo"), F.max(channel).alias("_hi"))
    value = F.when(F.col("_hi") > F.col("_lo"), (F.col(channel) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * top).otherwise(0.0)
    return pixels.join(ends, FRAME).withColumn(channel, value).drop("_lo", "_hi")


def scaled_heights(pixels: DataFrame, coverslip: float, z_scale: float, zero_to_nan: bool = True) -> DataFrame:
    """Heights over the coverslip; with zero_to_nan those under -2 are NaN and other negative ones 0."""
    h = (F.col("height") - coverslip) * z_scale
    return pixels.withColumn("height", F.when(h < -2, F.lit(float("nan"))).when(h < 0, F.lit(0.0)).otherwise(h) if zero_to_nan else h)


def nori_densities(voxels: DataFrame, pixels: DataFrame, empty: float, factor: float = NORI_PROTEIN, scale: float = 1.0, z_scale: float = 1.0) -> DataFrame:
    """Mean, population deviation and mass of a channel's density over the filled voxels of each cell."""
    filled = voxels.where(F.col("value") != empty).select(*FRAME, "y", "x", (F.col("value") / NORI_COUNTS * factor).alias("v"))
    joined = filled.join(cells(pixels).select(*CELL, "y", "x"), [*FRAME, "y", "x"])
    return joined.groupBy(*CELL).agg(F.avg("v").alias("density"), F.stddev_pop("v").alias("deviation"), (F.sum("v") * scale**2 * z_scale).alias("mass"))


def nuclear_ratio(pixels: DataFrame, channel: str) -> DataFrame:
    """Median of a channel in each label by the 95th percentile of its frame's background."""
    back = pixels.where("label = 0").groupBy(*FRAME).agg(F.percentile(channel, F.lit(0.95)).alias("back"))
    inside = cells(pixels).groupBy(*CELL).agg(F.median(channel).alias("inside"))
    return inside.join(back, FRAME).select(*CELL, F.try_divide("inside", "back").alias("ratio"))


def gradient(voxels: DataFrame) -> DataFrame:
    """Central differences along z, one-sided at the ends of a column."""
    column = W.partitionBy(*FRAME, "y", "x").orderBy("z")
    before, after = F.lag("value").over(column), F.lead("value").over(column)
    central = F.coalesce((after - before) / 2, after - F.col("value"), F.col("value") - before)
    return voxels.withColumn("gradient", central)


def in_blocks(voxels: DataFrame, line: str) -> DataFrame:
    """voxels(stack_id, frame, z, y, x, value) as (stack_id, frame, block, y, x, z, value, known): arrays of the voxels of LINES lines (`line` y or x), any number of rows a block.

    Tasks pack what they have before it is shuffled, so that few rows are sorted. Null values are 0 with known false.
    """
    own = F.floor(F.col(line) / LINES).cast("int").alias("block")
    rows = voxels.select(*FRAME, own, "y", "x", "z", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"), F.col("value").isNotNull().alias("known"))

    def packed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        arrays = ("y", "x", "z", "value", "known")
        out = pa.Table.from_batches(held).group_by([*FRAME, "block"], use_threads=False).aggregate([(c, "list") for c in arrays])
        return out.select([*FRAME, "block", *(f"{c}_list" for c in arrays)]).rename_columns([*FRAME, "block", *arrays]).to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= AT_ONCE:
                yield from packed(held)
                held = []
        if held:
            yield from packed(held)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(pack, ", ".join([*(f"{c} {kinds[c]}" for c in (*FRAME, "block")), *(f"{c} array<{kinds[c]}>" for c in ("y", "x", "z", "value", "known"))]))


def slopes(column: np.ndarray, value: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """gradient() of voxels in order of column and z, and where it is not null."""
    same = column[1:] == column[:-1]
    before, after = np.append(False, same & known[:-1])[: len(column)], np.append(same & known[1:], False)[: len(column)]
    last, following = np.append(0.0, value[:-1])[: len(column)], np.append(value[1:], 0.0)[: len(column)]
    cases = [before & after, after & known, before & known]
    return np.select(cases, [(following - last) / 2, following - value, value - last], 0.0), cases[0] | cases[1] | cases[2]


def lowest(column: np.ndarray, z: np.ndarray, slope: np.ndarray, known: np.ndarray, round_to: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Columns, and the z of each at which the slope is least, the lowest of several; a null slope is the least."""
    slope = np.where(known, slope if round_to is None else np.round(slope, round_to), -np.inf)
    order = np.lexsort((z, slope, column))
    column = column[order]
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1])[: len(column)])
    return column[first], z[order][first]


def steepest_descent(voxels: DataFrame) -> DataFrame:
    """The z of each column at which the value falls most; the lowest of several. A task gets the voxels of LINES lines at once."""

    def seek(key: tuple, rows: pa.Table) -> pa.Table:
        y, x, z, value, known = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("y", "x", "z", "value", "known"))
        order = np.lexsort((z, x, y))
        y, x, z = y[order], x[order], z[order]
        column = np.cumsum(np.append(True, (y[1:] != y[:-1]) | (x[1:] != x[:-1]))[: len(y)]) - 1
        found, surface = lowest(column, z, *slopes(column, value[order], known[order]))
        lead = np.searchsorted(column, found)
        columns = [pa.array([k.as_py()] * len(found), rows.schema.field(c).type) for k, c in zip(key[:2], FRAME, strict=True)]
        columns += [pa.array(v, rows.schema.field(c).type.value_type) for v, c in ((y[lead], "y"), (x[lead], "x"), (surface, "z"))]
        return pa.Table.from_arrays(columns, [*FRAME, "y", "x", "surface"])

    kinds = dict(voxels.dtypes)
    names = {**{c: c for c in (*FRAME, "y", "x")}, "surface": "z"}
    return in_blocks(voxels, "y").groupBy(*FRAME, "block").applyInArrow(seek, ", ".join(f"{c} {kinds[k]}" for c, k in names.items()))


def counts(tracks: DataFrame) -> DataFrame:
    """Number of tracks and of cells of each stack."""
    return tracks.groupBy("stack_id").agg(F.count_distinct("particle").alias("n_particles"), F.count("*").alias("n_cells"))


def rows_at(tracks: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The tracking rows of wanted(stack_id, keys): by frame and cell, or frame and particle."""
    return tracks.join(wanted.select("stack_id", *keys).distinct(), ["stack_id", *keys], "left_semi")


def set_stage(tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Stages set by hand, edits(stack_id, particle, frame, stage): each holds for its track from its frame on, until the next one."""
    by_time = W.partitionBy(*TRACK).orderBy("frame")
    spans = edits.select(*TRACK, F.col("frame").alias("_from"), F.lead("frame").over(by_time).alias("_to"), F.col("stage").alias("_stage"))
    held = (F.col("frame") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("frame") < F.col("_to")))
    hits = tracks.select(*TRACK, "frame").join(spans, TRACK).where(held).select(*TRACK, "frame", "_stage")
    return tracks.join(hits, [*TRACK, "frame"], "left").withColumn("cycle_stage", F.coalesce("_stage", "cycle_stage")).drop("_stage")


def set_along(tracks: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """tracks with `column` set to the `value` of values(stack_id, particle, frame, value), one a point at most; other points keep theirs, and values without a point change nothing.

    A value of null is set as well. Two values for a point are an error.
    """
    key = [*TRACK, "frame"]
    twice = values.groupBy(*key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"several values for {[tuple(r)[:3] for r in twice]}")
    given = values.select(*key, F.struct("value").alias("_given"))
    old = F.col(column) if column in tracks.columns else F.lit(None)
    return tracks.join(given, key, "left").withColumn(column, F.when(F.col("_given").isNotNull(), F.col("_given.value")).otherwise(old)).drop("_given")


def reorder_channels(pixels: DataFrame, order: list[str]) -> DataFrame:
    """Channels ch0, ch1, ... anew, each from the column that `order` names."""
    return pixels.withColumns({f"ch{i}": F.col(c) for i, c in enumerate(order)})


def labels_at(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """points(stack_id, frame, y, x, ...) with the label there; null outside of the image."""
    return points.join(pixels.select(*FRAME, "y", "x", "label"), [*FRAME, "y", "x"], "left")


def untracked(cells_: DataFrame, tracks: DataFrame) -> DataFrame:
    """Cells (stack_id, frame, label) that no track has."""
    return cells_.select(*CELL).distinct().join(tracks.select(*FRAME, (F.col("cell_number") + 1).alias("label")), CELL, "left_anti")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in order."""
    first = F.min_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(first).select(*keys, "_r.*")


def division_frames(tracks: DataFrame) -> DataFrame:
    """Frames in which a track begins and before which one ends."""
    life = lifetimes(tracks)
    return life.select("stack_id", F.col("birth").alias("frame")).intersect(life.select("stack_id", (F.col("death") + 1).alias("frame")))


def attach(tracks: DataFrame, values: DataFrame) -> DataFrame:
    """Tracks with the columns that values(stack_id, frame, label, ...) has for their cells, by key; cell numbers begin at 0, labels at 1."""
    own = values.withColumn("cell_number", F.col("label") - 1).drop("label")
    return tracks.join(own, ["stack_id", "frame", "cell_number"], "left")
