"""Sums over all pairs of points within a radius by bin of their distance, without a row for each pair."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import WIDER

#: Points that a tile has on average at least, unless it is as small as the radius allows, and that one task takes of a tile as either end of pairs.
TILE, MOST = 4096, 1 << 17

#: Relative error that squares and roots, computed in doubles, surely stay within.
SLACK = 1e-12

#: Pairs that are told one by one at once, and pairs of some points with those of a strip that are all told so.
PAIRS_AT_ONCE, FEW = 1 << 19, 120_000

_SUMS = "bin long, n long, m long, p double, pp double"


class _Strips:
    """Points (x, y, weights) in strips by rising y, each by x, with running sums of their weights. A strip is one y where points share few of them, as pixels do."""

    def __init__(self, x: np.ndarray, y: np.ndarray, v: np.ndarray, radius: float):
        strip = y
        if len(x):
            # thin strips leave fewer pairs to be told one by one, thick ones have fewer bounds to search
            height = min(2.0 * np.sqrt(max(np.ptp(x), radius) * max(np.ptp(y), radius) / len(x)), radius)
            strip = np.floor((y - y.min()) / height)
            if len(np.unique(y)) <= 3 * len(np.unique(strip)):
                strip = y
        order = np.lexsort((x, strip))
        self.x, self.y, self.v = x[order], y[order], v[order]
        self.columns = np.ascontiguousarray(self.v.T)
        begins = np.flatnonzero(np.append(True, np.diff(strip[order]) != 0)) if len(x) else np.empty(0, int)
        self.start = np.append(begins, len(x))
        self.low, self.high = (f.reduceat(self.y, begins) if len(x) else self.y for f in (np.minimum, np.maximum))
        self.running = [np.append(0.0, np.cumsum(w)) for w in self.v.T]


def _told(a: _Strips, b: _Strips, i: np.ndarray, start: np.ndarray, stop: np.ndarray, near: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums of products of weights over pairs of a's points i with b's from start to stop whose distances are near."""
    some = np.flatnonzero(stop > start)
    i, start, length = i[some], start[some], (stop - start)[some]
    ends = np.cumsum(length)
    sums, at = np.zeros(a.v.shape[1]), 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = length[at:to]
        left = np.repeat(i[at:to], n)
        right = np.arange(len(left)) + np.repeat(start[at:to] - np.cumsum(n) + n, n)
        dx, dy = a.x[left] - b.x[right], a.y[left] - b.y[right]
        kept = np.flatnonzero(near(np.sqrt(dx * dx + dy * dy)))
        sums += np.einsum("ic,ic->c", a.v[left[kept]], b.v[right[kept]])
        at = to
    return sums


def _met(a: _Strips, s: int, e: int, b: _Strips, m: int, edge: np.ndarray, width: float) -> np.ndarray:
    """For each bin the sums of products of weights over pairs of points of a's strips s to e with those of b's strip m whose distances are in bins up to it."""
    bins, radius = len(edge), edge[-1]
    upto = np.zeros((bins, a.v.shape[1]))
    own, theirs = slice(a.start[s], a.start[e]), slice(b.start[m], b.start[m + 1])
    first, bx = b.start[m], b.x[theirs]
    if (own.stop - own.start) * len(bx) <= FEW:
        dx, dy = a.x[own, None] - bx, a.y[own, None] - b.y[theirs]
        distance = np.sqrt(dx * dx + dy * dy)
        bin_ = np.where(distance <= radius, np.minimum(np.floor(distance / width), bins - 1), bins).astype(int).ravel()
        for c in range(upto.shape[1]):
            upto[:, c] = np.cumsum(np.bincount(bin_, np.outer(a.columns[c, own], b.columns[c, theirs]).ravel(), bins + 1)[:bins])
        return upto
    nearest = np.maximum(np.maximum(b.low[m] - a.high[s:e], a.low[s:e] - b.high[m]), 0.0)
    farthest = np.maximum(b.high[m] - a.low[s:e], a.high[s:e] - b.low[m])
    fuzz = SLACK * (max(np.abs(a.x[own]).max(), abs(bx[0]), abs(bx[-1])) + radius)
    padded = np.concatenate([[-np.inf], bx, [np.inf]])
    for k, far in enumerate(edge):
        most = far**2 * (1 + SLACK) - nearest**2 * (1 - SLACK)
        some = np.flatnonzero(most >= 0)
        if not len(some):
            continue
        some = slice(some[0], some[-1] + 1)
        sizes = np.diff(a.start[s + some.start : s + some.stop + 1])
        at = np.arange(a.start[s + some.start], a.start[s + some.stop])
        x, v = a.x[at[0] : at[-1] + 1], a.columns[:, at[0] : at[-1] + 1]
        most = np.repeat(np.sqrt(most[some]) * (1 + SLACK) + fuzz, sizes)
        reach = np.sqrt(np.maximum(far**2 * (1 - SLACK) - farthest[some] ** 2, 0.0)) * (1 - SLACK) - fuzz
        reach = np.repeat(np.maximum(reach, 0.0), sizes)
        begin, end = np.searchsorted(bx, x - reach, "left"), np.searchsorted(bx, x + reach, "right")
        end = np.where(reach > 0, end, begin)  # nothing is sure where the strips are too high
        for c, running in enumerate(b.running):
            running = running[theirs.start : theirs.stop + 1]
            upto[k, c] = np.einsum("i,i", running.take(end) - running.take(begin), v[c])  # @ would start threads in every task
        # what is neither surely within nor surely outside
        open_ = np.flatnonzero((padded.take(begin) >= x - most) | (padded.take(end + 1) <= x + most))
        if len(open_):
            near = (lambda d: d <= radius) if k == bins - 1 else lambda d, k=k: d / width < k + 1
            x, most, begin, end = x[open_], most[open_], begin[open_], end[open_]
            before, after = np.searchsorted(bx, x - most, "left"), np.searchsorted(bx, x + most, "right")
            i = at[open_]
            upto[k] += _told(a, b, np.concatenate([i, i]), first + np.concatenate([before, end]), first + np.concatenate([begin, after]), near)
    return upto


def sums_by_bin(left: tuple, right: tuple | None, radius: float, bins: int) -> np.ndarray:
    """For each bin of distances the sums of products of weights, column by column, over pairs of points (x, y, weights) of left and right; the last bin is closed. Without right, over pairs of left's points in either order and of each with itself.

    Points within a distance of one point lie, in a strip, between two places. What is surely between them is summed by differences of running sums;
    pairs about the places, by the strips' heights and by rounding, are told one by one by their distance as doubles have it.
    """
    width = radius / bins
    edge = np.append(np.arange(1, bins) * width, radius)
    a = _Strips(*left, radius)
    b = a if right is None else _Strips(*right, radius)
    upto = np.zeros((bins, left[2].shape[1]))
    for m in range(len(b.low)):
        s, e = int(np.searchsorted(a.high, b.low[m] - radius * WIDER, "left")), int(np.searchsorted(a.low, b.high[m] + radius * WIDER, "right"))
        if right is not None:
            upto += _met(a, s, e, b, m, edge, width) if e > s else 0
        else:
            upto += _met(a, m, m + 1, b, m, edge, width) + (2 * _met(a, s, m, b, m, edge, width) if m > s else 0)
    return np.diff(upto, axis=0, prepend=0.0)


def _of_tile(radius: float, bins: int) -> Callable[[pa.Table], pa.Table]:
    def sums(rows: pa.Table) -> pa.Table:
        """Sums of one tile's part: its own points among themselves, where each pair is met from both ends, and with those of its other parts and of later tiles."""
        role, x, y, w, c = (rows[n].to_numpy() for n in ("role", "x", "y", "w", "c"))
        known = ~rows["c"].is_null().to_numpy()
        c = np.where(known, c, 0.0)
        v = np.column_stack([w, w * known, w * c, w * c * c]).astype(float)
        some = lambda which: (x[which], y[which], v[which])
        alone = role == 3
        left = some(alone | (role == 1))
        twice = sums_by_bin(some(alone), None, radius, bins) + 2 * sums_by_bin(left, some((role == 2) | (role == 4)), radius, bins)
        # a point is no pair with itself
        twice[0] -= [w[alone].sum(), (w * known)[alone].sum(), (w * c * c)[alone].sum(), (w * c**4)[alone].sum()]
        found = np.flatnonzero(twice[:, 0])
        columns = [pa.array([rows["stack_id"][0].as_py()] * len(found), rows["stack_id"].type), pa.array(found, pa.int64()), *(pa.array(np.rint(twice[found, i]), pa.int64()) for i in (0, 1)), *(pa.array(twice[found, i] / 2) for i in (2, 3))]
        return pa.Table.from_arrays(columns, ["stack_id", "bin", "n", "m", "p", "pp"])

    return sums


def pair_sums(points: DataFrame, keys: list[str], radius: float, bins: int) -> DataFrame:
    """Per stack and bin of distances: number of pairs of points(keys, x, y, c) with equal keys within the radius, of those with a product of c, and sums of products and of their squares. The last bin is closed.

    Points alike in all are counted first. Keys are divided into square tiles, of twice the radius at least; a tile gets its own points and those of
    later tiles within the radius. Where a tile has more than MOST points they are dealt into parts, and every two parts are met by one task, so that no
    task holds more whatever the crowd. Tasks return a row for each bin.
    """
    finite = lambda c: F.abs(F.col(c)) < float("inf")  # noqa: E731  (NaN is greater)
    # squares of whole numbers might overflow
    points = points.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "c")})
    places = points.where(finite("x") & finite("y")).groupBy(*keys, "x", "y", "c").agg(F.count("*").alias("w"))
    span = lambda c: F.max(c) - F.min(c)
    frames = places.groupBy(*keys).agg(F.greatest(F.lit(2.002 * radius), F.sqrt(span("x") * span("y") * TILE / F.count("*"))).alias("_side"))
    tile = lambda c: F.floor(F.col(c) / F.col("_side")).cast("long")
    placed = places.join(F.broadcast(frames), keys).withColumns({"_tx": tile("x"), "_ty": tile("y")})
    parts = placed.groupBy(*keys, "_tx", "_ty").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.ceil(F.max("_n") / MOST).cast("int").alias("_parts"))
    placed = placed.join(F.broadcast(parts), keys).withColumn("_h", F.pmod(F.xxhash64("x", "y", "c"), F.col("_parts")).cast("int"))
    # part h of a tile's own points meets itself (role 3), as left part (1) the later parts, sent as right ones (2), and all parts of later tiles (4)
    near = lambda c, side: (F.abs(F.col(c) - F.col(f"_t{c}") * F.col("_side")) if side < 0 else F.abs((F.col(f"_t{c}") + 1) * F.col("_side") - F.col(c))) <= 1.0005 * radius
    at = lambda dx, dy, a, b, role: F.struct((F.col("_tx") + dx).alias("tx"), (F.col("_ty") + dy).alias("ty"), a.alias("a"), b.alias("b"), F.lit(role).alias("role"))
    every, h = F.sequence(F.lit(0), F.col("_parts") - 1), F.col("_h")
    others = F.filter(every, lambda i: i != h)
    none = F.filter(every, lambda i: F.lit(False))
    later = lambda when, dx, dy: F.transform(F.when(when, every).otherwise(none), lambda i: at(dx, dy, i, h, 4))
    goes = F.concat(
        F.array(at(0, 0, h, h, 3)),
        F.transform(others, lambda i: at(0, 0, h, i, 1)),
        F.transform(F.filter(every, lambda i: i < h), lambda i: at(0, 0, i, h, 2)),
        later(near("x", -1), -1, 0),
        later(near("y", -1), 0, -1),
        later(near("x", -1) & near("y", -1), -1, -1),
        later(near("x", 1) & near("y", -1), 1, -1),
    )
    group = [*keys, "tx", "ty", "a", "b"]
    sent = placed.select(*keys, "x", "y", "c", "w", F.explode(goes).alias("to")).select(*keys, "x", "y", "c", "w", "to.*")
    dealt = sent.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)  # a number that is given is not coalesced
    sums = dealt.groupBy(*group).applyInArrow(_of_tile(radius, bins), f"stack_id {dict(points.dtypes)['stack_id']}, {_SUMS}").groupBy("stack_id", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "m", "p", "pp")))
    return sums.withColumns({c: F.expr(f"{c} div 2") for c in ("n", "m")})
