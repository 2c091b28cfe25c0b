"""Cubic splines along z, the coverslip's place in a profile, and height maps from stacks end to end.

A spline's values are fixed weights of the samples, the same for all columns of one length: a task makes the weights once and multiplies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import saved
from .heights import without_outliers
from .lookups import LINES, in_blocks, lowest, slopes
from .planes import quadratic_surface
from .zonal import FRAME, pool

PIXEL = [*FRAME, "y", "x"]


def _bends(n: int) -> np.ndarray:
    """Second derivatives of the spline through n samples at distance 1, as weights: the outer two pieces of each end are one cubic."""
    if n < 3:
        return np.zeros((n, n))
    differences = np.zeros((n, n))
    rows = np.arange(1, n - 1)
    for step, w in ((-1, 1.0), (0, -2.0), (1, 1.0)):
        differences[rows, rows + step] = w
    if n == 3:
        return np.repeat(differences[1:2], 3, axis=0)
    system = np.zeros((n, n))
    for step, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
        system[rows, rows + step] = w
    system[0, :3] = system[-1, -3:] = 1.0, -2.0, 1.0
    return np.linalg.solve(system, differences)


def spline_weights(n: int, at: np.ndarray) -> np.ndarray:
    """Weights of n samples at 0, 1, 2, ... for the values of their cubic spline at other places; beyond the ends its last piece goes on."""
    if n == 1:
        return np.ones((len(at), 1))
    left = np.clip(np.floor(at).astype(int), 0, n - 2)
    b = at - left
    a = 1 - b
    bends, eye = _bends(n), np.eye(n)
    return a[:, None] * eye[left] + b[:, None] * eye[left + 1] + ((a**3 - a)[:, None] * bends[left] + (b**3 - b)[:, None] * bends[left + 1]) / 6


def interpolate_z(voxels: DataFrame, fold: int, repeat_ends: bool = True) -> DataFrame:
    """voxels(stack_id, frame, z, y, x, value) with `fold` planes for each plane: the cubic spline of each column at z = 0, 1/fold, 2/fold, ....

    z is numbered anew. Columns are taken in order of z whatever its gaps; null values are left out. With repeat_ends, 12 copies of the outer samples
    go before and after a column; else the spline's last piece goes on beyond the last plane. An empty table gives an empty one.
    """
    pad = 12 if repeat_ends else 0
    columns = voxels.where("value is not null").groupBy(*PIXEL).agg(F.transform(F.sort_array(F.collect_list(F.struct("z", "value"))), lambda v: v["value"].cast("double")).alias("v"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for rows in batches:
            out = np.empty(len(rows), object)
            lengths = rows["v"].map(len).to_numpy()
            for n in np.unique(lengths).tolist():
                if n not in known:
                    known[n] = spline_weights(n + 2 * pad, pad + np.arange(n * fold) / fold)
                which = np.flatnonzero(lengths == n)
                samples = np.pad(np.stack(rows["v"].to_numpy()[which]), ((0, 0), (pad, pad)), mode="edge")
                for i, values in zip(which, samples @ known[n].T, strict=True):
                    out[i] = values
            yield rows.drop(columns="v").assign(v=out)

    kinds = ", ".join(f"{c} {t}" for c, t in columns.dtypes)
    return columns.mapInPandas(spread, kinds).select(*PIXEL, F.posexplode("v").alias("z", "value"))


def first_prominent(v: np.ndarray, prominence: float) -> int:
    """Place of the first inner peak (of a level one the middle) that stands `prominence` above the higher of the lowest points on both sides, up to where values are higher; -1 without one."""
    i = 1
    while i < len(v) - 1:
        if v[i] > v[i - 1]:
            end = i
            while end + 1 < len(v) and v[end + 1] == v[i]:
                end += 1
            if end < len(v) - 1 and v[end + 1] < v[i]:
                before, after = np.flatnonzero(v[:i] > v[i]), np.flatnonzero(v[end + 1 :] > v[i])
                left = v[before[-1] + 1 if len(before) else 0 : i + 1].min()
                right = v[i : end + 1 + after[0] if len(after) else len(v)].min()
                if v[i] - max(left, right) >= prominence:
                    return (i + end) // 2
            i = end
        i += 1
    return -1


def coverslip_z(profiles: DataFrame, by: list[str], scale: float = 1.0, precision: float = 0.125, prominence: float = 0.01) -> DataFrame:
    """(by, coverslip): the height at which each profile(by, z, mean) first rises steeply.

    The profile's cubic spline is evaluated at steps of `precision`; its gradient's first peak with `prominence` of the gradient's whole range is the
    place. Null where there is none or fewer than two samples. Null samples are left out, z only gives the order. One row a profile goes to a task.
    """
    lists = profiles.where("mean is not null").groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("z", "mean"))), lambda v: v["mean"].cast("double")).alias("v"))

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            places = []
            for v in rows["v"]:
                fine = np.arange(0, len(v) * scale, precision)
                place = -1
                if len(v) > 1 and len(fine) > 2:
                    steep = np.gradient(spline_weights(len(v), fine / scale) @ np.asarray(v, float), precision)
                    place = first_prominent(steep, prominence * (steep.max() - steep.min()))
                places.append(None if place < 0 else float(fine[place]))
            yield rows.drop(columns="v").assign(coverslip=pd.Series(places, dtype="Float64", index=rows.index))

    kinds = ", ".join(f"{c} {t}" for c, t in lists.dtypes if c != "v")
    return lists.mapInPandas(found, f"{kinds}, coverslip double")


def _gaussian(n: int, sigma: float) -> np.ndarray:
    """Weights of n places in a row for their values under a Gaussian cut at four sigma, ends reflected."""
    if sigma <= 0:
        return np.eye(n)
    reach, weights = int(4 * sigma + 0.5), np.zeros((n, n))
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    for t in range(n):
        for d, w in zip(range(-reach, reach + 1), raw, strict=True):
            at = (t + d) % (2 * n)
            weights[t, min(at, 2 * n - 1 - at)] += w / sum(raw)
    return weights


def _along_columns(voxels: DataFrame, height: int, width: int, depth: int, sigma: float, z_sigma: float, name: str, seek: Callable) -> DataFrame:
    """(stack_id, frame, y, x, name): what seek(column, z, value, known) finds in each column of voxels blurred along y, x and z.

    seek gets the voxels of some columns in order of column and z, and whether a value is not null, and returns (columns, results). Missing and null voxels count as 0;
    a blurred voxel is there if one within reach is, and null if all within reach are. Blocks of a few x with all y and z are blurred along y, then
    blocks of a few y with all x and z along x and z: two exchanges, of arrays.
    """
    down, across, deep = _gaussian(height, sigma), _gaussian(width, sigma), _gaussian(depth, z_sigma)
    wide = -(-width // LINES) * LINES
    reach = lambda m, w: (w > 0).astype(np.float32) @ m.astype(np.float32) > 0

    def upright(key: tuple, rows: pa.Table) -> pa.Table:
        y, x, z, value, known = (rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("y", "x", "z", "value", "known"))
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width) & (z >= 0) & (z < depth)
        at = ((y * LINES + x % LINES).astype(np.int64) * depth + z)[inside]
        n = height * LINES * depth
        cube = down @ np.bincount(at, value[inside], n).reshape(height, -1)
        there = reach(np.bincount(at, minlength=n).reshape(height, -1) > 0, down).astype(np.int8)
        there += reach(np.bincount(at, known[inside], n).reshape(height, -1) > 0, down)
        parts = [k for k in range(0, height, LINES) if there[k : k + LINES].any()]
        columns = [pa.array([k.as_py()] * len(parts), rows.schema.field(c).type) for k, c in zip(key[:2], FRAME, strict=True)]
        columns += [pa.array([k // LINES for k in parts], pa.int32()), pa.array([key[2].as_py()] * len(parts), pa.int32())]
        columns += [pa.array([m[k : k + LINES].ravel() for k in parts], pa.list_(kind)) for m, kind in ((cube, pa.float64()), (there, pa.int8()))]
        return pa.Table.from_arrays(columns, [*FRAME, "block", "part", "value", "there"])

    def level(key: tuple, rows: pa.Table) -> pa.Table:
        cube, there = np.zeros((LINES, wide, depth)), np.zeros((LINES, wide, depth), np.int8)
        parts = rows["part"].to_numpy() * LINES
        for part, *both in zip(parts.tolist(), rows["value"], rows["there"], strict=True):
            for whole, own in zip((cube, there), both, strict=True):
                own = own.values.to_numpy().reshape(-1, LINES, depth)
                whole[: len(own), part : part + LINES] = own
        cube, there = across @ cube[:, :width] @ deep.T, there[:, :width]
        present, known = (np.swapaxes(reach(np.swapaxes(reach(there > k, across), 1, 2), deep), 1, 2) for k in (0, 1))
        row, x, z = np.nonzero(present)
        column, found = seek(row * width + x, z, cube[row, x, z], known[row, x, z])
        columns = [pa.array([k.as_py()] * len(column), rows.schema.field(c).type) for k, c in zip(key[:2], FRAME, strict=True)]
        columns += [pa.array(v, pa.int32()) for v in (key[2].as_py() * LINES + column // width, column % width, found)]
        return pa.Table.from_arrays(columns, [*PIXEL, name])

    frame = ", ".join(f"{c} {dict(voxels.dtypes)[c]}" for c in FRAME)
    halves = in_blocks(voxels, "x").groupBy(*FRAME, "block").applyInArrow(upright, f"{frame}, block int, part int, value array<double>, there array<tinyint>")
    return halves.groupBy(*FRAME, "block").applyInArrow(level, f"{frame}, y int, x int, {name} int")


def _last_peaks(prominence: float, round_to: int | None) -> Callable:
    """Last inner z of each column at which the fall is above both neighbours, by `prominence` above the lower one; 0 without."""

    def seek(column: np.ndarray, z: np.ndarray, value: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slope, known = slopes(column, value, known)
        fall = -slope if round_to is None else np.round(-slope, round_to)
        inner = np.flatnonzero((column[1:-1] == column[:-2]) & (column[1:-1] == column[2:]) & known[1:-1] & known[:-2] & known[2:]) + 1
        before, after, own = fall[inner - 1], fall[inner + 1], fall[inner]
        peaks = inner[(own > before) & (own > after) & (own - np.minimum(before, after) >= prominence)]
        columns, place = np.unique(column, return_inverse=True)
        height = np.zeros(len(columns), int)
        np.maximum.at(height, place[peaks], z[peaks])
        return columns, height

    return seek


def _steepest(column: np.ndarray, z: np.ndarray, value: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lowest(column, z, *slopes(column, value, known), 9)


def height_map(voxels: DataFrame, height: int, width: int, depth: int, scale: float = 0.325, z_scale: float = 1.0, prominence: float = 0.01, sigma: float | None = None, z_sigma: float | None = None, least: float | None = None, fold: int = 1, reverse: bool = False, round_to: int | None = 9) -> DataFrame:
    """(stack_id, frame, y, x, height) of cells' tops in voxels(stack_id, frame, z, y, x, value), z from 0 to depth - 1 over the whole plane.

    The stack is brought to 0..1 between the 1st and 99th percentile of its values (not clipped; 0 where these are equal), blurred, and its steepest fall along z is sought: the last z at which the falling gradient has a peak of `prominence`.
    Regions of fewer than `least` pixels are filled from what is around them. With fold > 1 planes are first interpolated along z, and heights are
    given in planes of the input. With `reverse` heights are sought from the top downwards (a coverslip's underside) and counted from the bottom.

    By scale: sigma 2 / scale pixels, least 100 / scale^2 (4 and 200 with reverse), z_sigma 1 / z_scale planes. Values are rounded to `round_to`
    places before peaks are sought, so that equal values stay equal in any order of summing.
    """
    wide = 2 if reverse else 1
    sigma = 2 * wide / scale if sigma is None else sigma
    least = 100 * wide / scale**2 if least is None else least
    z_sigma = (1 / z_scale if z_sigma is None else z_sigma) * fold
    planes = interpolate_z(voxels, fold) if fold > 1 else voxels
    depth *= fold
    planes = planes.withColumn("z", depth - 1 - F.col("z")) if reverse else planes
    q = planes.groupBy(*FRAME).agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    lo, hi = F.col("q")[0], F.col("q")[1]
    # percentiles are a row a frame
    unit = planes.join(F.broadcast(q), FRAME).select(*PIXEL, "z", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(0.0).alias("value"))
    found = without_outliers(saved(_along_columns(unit, height, width, depth, sigma, z_sigma, "height", _last_peaks(prominence, round_to))), least)
    at = F.when(F.col("height") < 0, F.col("height")).otherwise(depth - 1 - F.col("height")) if reverse else F.col("height")
    return found.select(*PIXEL, (at / fold if fold > 1 else at).alias("height"))


def fitted_surface(voxels: DataFrame, height: int, width: int, depth: int, block: int = 16, fold: int = 8, scale: float = 0.65, z_scale: float = 1.0, sigma: float | None = None, z_sigma: float | None = None) -> DataFrame:
    """(stack_id, frame, y, x, height): the smooth surface of steepest fall along z in voxels(stack_id, frame, z, y, x, value), such as a coverslip.

    Blocks of `block` x `block` pixels are averaged (at the edges of what pixels they have), interpolated to `fold` planes a plane and blurred. The z at
    which each block falls most, the lowest of several, gives the points of a least-squares surface a (x^2 + y^2) + b x + c y + d, evaluated at every
    pixel. By scale: sigma 42 / block / scale blocks, z_sigma fold / z_scale fine planes. Heights are null where a frame has too few blocks for a surface.
    """
    sigma = 42 / block / scale if sigma is None else sigma
    z_sigma = fold / z_scale if z_sigma is None else z_sigma
    blocks = pool(voxels.withColumn("frame", F.struct("frame", "z")), "value", block)
    blocks = blocks.select("stack_id", F.col("frame.frame").alias("frame"), F.col("frame.z").alias("z"), "y", "x", F.col("mean").alias("value"))
    steepest = _along_columns(interpolate_z(blocks, fold, repeat_ends=False), -(-height // block), -(-width // block), depth * fold, sigma, z_sigma, "surface", _steepest)
    fits = quadratic_surface(steepest, "surface")
    x, y = F.col("x") / block, F.col("y") / block
    at = (F.col("a") * (x * x + y * y) + F.col("b") * x + F.col("c") * y + F.col("d")) / fold
    return voxels.select(*PIXEL).distinct().join(F.broadcast(fits), FRAME, "left").select(*PIXEL, at.alias("height"))
