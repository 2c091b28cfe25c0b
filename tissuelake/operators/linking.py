"""Tracks from points: least-cost links between frames, chains of links as tracks, two passes with the drift between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import ONE_TASK, components, dropped, saved
from .spatial import grid_join
from .tracks import add_drift, drift, drop_stubs, search_range, subtract_drift

_LINK = "stack_id int, frame int, a long, b long"
#: Side, in search radii, of the squares whose links one task chains, and their frames.
TILE, FRAMES = 64, 64


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the greatest sum of gains, each row and column once at most; only gains of 0 or more are taken (NaN: not allowed).

    Rows are added one by one along the cheapest alternating path. A free column of no gain for each row stands for leaving it out.
    """
    n, m = gain.shape
    cost = np.hstack([np.where(np.isnan(gain), np.inf, -gain), np.full((n, n), np.inf)])
    cost[np.arange(n), m + np.arange(n)] = 1e-9  # a link of no gain is better than none
    owner = np.full(m + n, -1)
    row_price, price = np.zeros(n), np.zeros(m + n)
    for new in range(n):
        least, before, done = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, dtype=bool)
        reached = [(new, -1)]
        row, so_far = new, 0.0
        while True:
            offer = so_far + cost[row] - row_price[row] - price
            better = ~done & (offer < least)
            least[better], before[better] = offer[better], row
            column = int(np.where(done, np.inf, least).argmin())
            so_far = least[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = int(owner[column])
            reached.append((row, column))
        for r, c in reached:
            row_price[r] += so_far - (least[c] if c >= 0 else 0.0)
        price[done] -= so_far - least[done]
        column_of = {int(owner[c]): c for c in np.flatnonzero(owner >= 0)}
        while True:
            row = int(before[column])
            owner[column] = row
            if row == new:
                break
            column = column_of[row]
    return [(int(owner[c]), c) for c in range(m) if owner[c] >= 0]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the connected groups of candidates, which come group by group."""
    held: list[pa.RecordBatch] = []

    def solved(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
        """Links of all groups but, if more is to come, the last one, which is held back."""
        cluster, a, b, gain = (rows[c].to_numpy() for c in ("cluster", "a", "b", "gain"))
        frame = rows["frame"].to_numpy()
        lead = np.flatnonzero(np.append(True, (cluster[1:] != cluster[:-1]) | (frame[1:] != frame[:-1])))
        ends = [*lead[1:].tolist(), *([len(a)] if last else [])]
        won: list[tuple[int, int, int]] = []
        for s, e in zip(lead.tolist(), ends, strict=False):
            sources, row = np.unique(a[s:e], return_inverse=True)
            targets, column = np.unique(b[s:e], return_inverse=True)
            table = np.full((len(sources), len(targets)), np.nan)
            table[row, column] = gain[s:e]
            won += [(s, sources[i], targets[j]) for i, j in assign(table)]
        at = pa.array([s for s, _, _ in won], pa.int64())
        columns = [rows["stack_id"].take(at).combine_chunks(), rows["frame"].take(at).combine_chunks(), pa.array([x for _, x, _ in won], pa.int64()), pa.array([x for _, _, x in won], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["stack_id", "frame", "a", "b"]), [] if last else rows.slice(int(lead[-1])).to_batches()

    for batch in batches:
        if batch.num_rows:
            out, held = solved(pa.Table.from_batches([*held, batch]), False)
            yield out
    if held:
        yield solved(pa.Table.from_batches(held), True)[0]


def least_cost_links(pairs: DataFrame, radius: float, most: int = 30, step: float | None = None, stop: float = 0.0) -> DataFrame:
    """Links (stack_id, frame, a, b) among candidates pairs(stack_id, frame, a, b, distance): each point in one link at most, the sum of squared distances, with radius^2 for each source left out, as small as it can be.

    A pair that meets no other is a link. Others are solved exactly by connected group. A group of more than `most` sources or targets is searched
    again within radius * step, and so on down to `stop`; without step, or at stop, it is an error. So no task gets more than most^2 candidates.
    """
    found, r = None, radius
    rest = saved(pairs.where(F.col("distance") < r))
    while True:
        met = lambda c: F.count("*").over(W.partitionBy("stack_id", "frame", c))
        counted = saved(rest.withColumn("alone", (met("a") == 1) & (met("b") == 1)))
        lone, close = counted.where("alone").select("stack_id", "frame", "a", "b"), counted.where("not alone").drop("alone")
        found = lone if found is None else found.union(lone)
        if close.isEmpty():
            return found
        node = lambda c: F.struct("stack_id", "frame", F.lit(c).alias("side"), F.col(c).alias("id"))
        groups = components(close.select(node("a").alias("a"), node("b").alias("b"))).where("node.side = 'a'").select("node.stack_id", "node.frame", F.col("node.id").alias("a"), F.col("component").alias("cluster"))
        close = saved(close.join(groups, ["stack_id", "frame", "a"]))
        sizes = close.groupBy("cluster").agg(F.greatest(F.count_distinct("a"), F.count_distinct("b")).alias("size"))
        large = saved(sizes.where(F.col("size") > most).select("cluster"))
        ready = close.join(large, "cluster", "left_anti").select("stack_id", "frame", "a", "b", (F.lit(r * r) - F.col("distance") * F.col("distance")).alias("gain"), F.col("cluster.id").alias("cluster"))
        # a group's first node is a source of one frame, so (frame, cluster) names the group
        found = found.union(ready.repartition("stack_id", "frame", "cluster").sortWithinPartitions("stack_id", "frame", "cluster", "a", "b").mapInArrow(_solve, _LINK))
        if large.isEmpty():
            return found
        if step is None or r * step < stop:
            raise ValueError(f"more than {most} points compete within {r}: take a smaller search range or a step")
        r *= step
        rest = saved(close.join(large, "cluster", "left_semi").drop("cluster").where(F.col("distance") < r))


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node `id` of one partition's links with the first node of its chain there. A node has one link to it at most."""
    up: dict[int, int] = {}
    for batch in batches:
        up.update(zip(batch["id"].to_pylist(), batch["begin"].to_pylist(), strict=True))
    for x in up:
        trail = []
        while x in up:
            trail.append(x)
            x = up[x]
        up.update(dict.fromkeys(trail, x))
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(list(up.values()), pa.int64())], ["id", "begin"])


def beginnings(links: DataFrame, places: list[str]) -> DataFrame:
    """links(id, begin, ...), in which begin comes before id and each id and begin is met once, to (id, begin): each id with the first node of its chain.

    Links of equal `places` are chained in one task. Only the ends of such parts that go on elsewhere are then joined, ONE_TASK of them by
    one task, more by doubling their steps, so that rounds see few rows for each chain and not all its nodes.
    """
    parts = saved(links.repartition(*places).select("id", "begin").mapInArrow(_chains, "id long, begin long"))
    ends = saved(parts.join(parts.select(F.col("begin").alias("id")).distinct(), "id", "left_semi"))
    if ends.count() <= ONE_TASK:
        first = ends.coalesce(1).mapInArrow(_chains, "id long, begin long")
    else:
        first, on = ends, True
        while on:
            ahead = first.select(F.col("id").alias("begin"), F.col("begin").alias("next"))
            jumped = saved(first.join(ahead, "begin", "left").select("id", F.coalesce("next", "begin").alias("begin"), F.col("next").isNotNull().alias("on")))
            dropped(first)
            on = not jumped.where("on").isEmpty()
            first = jumped.select("id", "begin")
    return parts.join(first.select(F.col("id").alias("begin"), F.col("begin").alias("first")).hint("merge"), "begin", "left").select("id", F.coalesce("first", "begin").alias("begin"))


def link(points: DataFrame, radius: float, memory: int = 0, most: int = 30, step: float | None = None, stop: float = 0.0) -> DataFrame:
    """points(stack_id, frame, cell_number, x, y, ...) with `particle`: tracks of least-cost links within `radius` (exclusive).

    A point without a link may still be linked from up to `memory` frames later. Which points are lost depends on earlier links, so all frames are linked
    anew with the points lost by the last round until nothing changes: each round settles one more frame at least, mostly all. Ids run from 0
    by first frame and cell number. Points without a position, and repeated cell numbers of a frame but one, have no place in a track and go.
    An empty table gives an empty one.
    """
    own = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").dropDuplicates(["stack_id", "frame", "cell_number"])
    own = saved(own.withColumns({"stack_id": F.col("stack_id").cast("int"), "frame": F.col("frame").cast("int"), "id": F.monotonically_increasing_id()}))
    left = own.select("stack_id", "frame", F.explode(F.sequence(F.lit(1), F.lit(memory + 1))).alias("gap"), F.col("id").alias("a"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    left = left.withColumn("frame", F.col("frame") + F.col("gap"))
    right = own.select("stack_id", "frame", F.col("id").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    pairs = saved(grid_join(left, right, ["stack_id", "frame"], radius).select("stack_id", "frame", "gap", "a", "b", "distance"))
    links = saved(least_cost_links(pairs.where("gap = 1").drop("gap"), radius, most, step, stop))
    while memory:
        taken = links.groupBy("a").agg(F.min("frame").alias("until"))
        alive = pairs.join(taken, "a", "left").where("gap = 1 or until is null or frame <= until")
        again = saved(least_cost_links(alive.select("stack_id", "frame", "a", "b", "distance"), radius, most, step, stop))
        # a point linked in two frames stays in the first of them only, which the next round sees
        same = again.exceptAll(links).isEmpty() and links.exceptAll(again).isEmpty()
        dropped(links)
        links = again
        if same:
            break
    first = W.partitionBy("a").orderBy("frame")
    links = links.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("a", "b")
    side = lambda c: F.floor(F.col(c) / F.lit(float(TILE * radius)))
    at = own.select(F.col("id").alias("a"), "stack_id", F.floor(F.col("frame") / FRAMES).alias("_f"), side("x").alias("_x"), side("y").alias("_y"))
    chained = links.join(at, "a").select(F.col("b").alias("id"), F.col("a").alias("begin"), "stack_id", "_f", "_x", "_y")
    begun = beginnings(chained, ["stack_id", "_f", "_x", "_y"]).withColumnRenamed("begin", "begin_id")
    placed = saved(own.join(begun, "id", "left").withColumn("begin_id", F.coalesce("begin_id", "id")))
    begins = placed.where("begin_id = id").select("begin_id", "stack_id", "frame", "cell_number")
    counts = begins.groupBy("stack_id", "frame").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("stack_id").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("stack_id", "frame").orderBy("cell_number")) - 1
    ids = begins.withColumn("place", place).join(counts.withColumn("before", before).drop("n"), ["stack_id", "frame"]).select("begin_id", (F.col("before") + F.col("place")).cast("long").alias("particle"))
    return placed.join(ids, "begin_id").drop("begin_id", "id")


def track(points: DataFrame, first_radius: float, radius: float | None = None, memory: int = 0, quantile: float = 0.97, least: int = 0, keep_drift: bool = True, most: int = 30) -> DataFrame:
    """points as tracks in two passes: links within the wide first_radius, whose mean steps are the drift; then links of the drift-free points within `radius`, or the quantile of their first speeds.

    Crowds of the first pass are searched within ever smaller radii, in steps of 0.96 down to 2. Positions come back with the drift, or
    (keep_drift false) without it and without that of the second pass. least drops tracks of fewer points. The quantile is the largest of the stacks'.
    """
    wide = saved(link(points, first_radius, 0, most, 0.96, 2.0))
    shift = saved(drift(wide))
    level = saved(subtract_drift(wide, shift))
    if radius is None:
        radius = search_range(level, quantile).agg(F.max("search_range")).first()[0] or first_radius
    tight = link(level.drop("particle"), radius, memory, most)
    if least:
        tight = drop_stubs(tight, least)
    if keep_drift:
        return add_drift(tight, shift)
    tight = saved(tight)
    return subtract_drift(tight, drift(tight))
