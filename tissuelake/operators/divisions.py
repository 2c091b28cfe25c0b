"""Divisions from candidates(stack_id, mother, daughter, frame, distance): pairs of daughters and their conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import components, saved
from .networks import heaviest
from .tracks import TRACK

DIVISION = ["stack_id", "mother", "daughter1", "daughter2"]


def daughter_pairs(candidates: DataFrame) -> DataFrame:
    """Each two daughters of a mother, the smaller id first."""
    one = candidates.select("stack_id", "mother", "frame", F.col("daughter").alias("daughter1"))
    two = candidates.select("stack_id", "mother", F.col("daughter").alias("daughter2"))
    return one.join(two, ["stack_id", "mother"]).where("daughter1 < daughter2").select(*DIVISION, "frame")


def conflicts(divisions: DataFrame) -> DataFrame:
    """Pairs of divisions with the same mother or a daughter in common. Each division meets others by its three members, not by an OR."""
    member = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("id"))
    keyed = divisions.select("stack_id", F.struct(*DIVISION[1:]).alias("division"), F.explode(F.array(member("m", "mother"), member("d", "daughter1"), member("d", "daughter2"))).alias("member"))
    pairs = keyed.join(keyed.withColumnRenamed("division", "other"), ["stack_id", "member"]).where("division < other").select("stack_id", "division", "other").distinct()
    return pairs.select("stack_id", "division.*", *(F.col(f"other.{c}").alias(f"other_{c}") for c in DIVISION[1:]))


#: Features of a division in the order of WEIGHTS and BIASES.
FEATURES = ["mother_circ", "daughter_circ", "daughter_distance", "distance_diff", "angle", "com_displacement"]
#: Default weights and biases of a score.
WEIGHTS = (40.79220969, 8.12982495, 2.0, 0.20812352, 2.54951311, 32.51929981)
BIASES = (0.1, 0.1, 0.0, 0.0, 0.0, 0.0)


def ends(points: DataFrame) -> DataFrame:
    """First and last point of each track, and how far from a circle it stays in its first two points (first_circ) and its last three (last_circ).

    points has (stack_id, particle, frame, x, y, area, circularity).
    """
    near = lambda order, n: 1 - F.max(F.when(F.col(order) <= n, F.col("circularity")))
    track = W.partitionBy(*TRACK)
    placed = points.withColumns({"_a": F.row_number().over(track.orderBy("frame")), "_z": F.row_number().over(track.orderBy(F.desc("frame")))})
    return placed.groupBy(*TRACK).agg(F.min_by(F.struct("x", "y", "area"), "frame").alias("first"), F.max_by(F.struct("x", "y"), "frame").alias("last"), near("_a", 2).alias("first_circ"), near("_z", 3).alias("last_circ"))


def features(divisions: DataFrame, points: DataFrame) -> DataFrame:
    """divisions with FEATURES: lengths are in units of the root of the mother's first area, the angle is 0 where she lies between her daughters."""
    seen = ends(points)
    role = lambda key, name: seen.select("stack_id", F.col("particle").alias(key), F.struct("first", "last", "first_circ", "last_circ").alias(name))
    rows = divisions.select(*DIVISION, "frame")
    for key, name in (("mother", "m"), ("daughter1", "d"), ("daughter2", "e")):
        rows = rows.join(role(key, name), ["stack_id", key])
    at = lambda name, c: F.col(f"{name}.first.{c}") - F.col(f"m.last.{c}")
    size, far = F.sqrt("m.first.area"), {n: F.hypot(at(n, "x"), at(n, "y")) for n in "de"}
    turn = (F.atan2(at("e", "y"), at("e", "x")) - F.atan2(at("d", "y"), at("d", "x"))) / F.pi()
    middle = {c: (at("d", c) * F.col("d.first.area") + at("e", c) * F.col("e.first.area")) / (F.col("d.first.area") + F.col("e.first.area")) for c in "xy"}
    values = [
        F.col("m.last_circ"),
        (F.col("d.first_circ") + F.col("e.first_circ")) / 2,
        F.abs(1 - F.hypot(at("e", "x") - at("d", "x"), at("e", "y") - at("d", "y")) / size),
        F.abs(far["e"] - far["d"]) / size,
        F.abs(F.pmod(turn, F.lit(2.0)) - 1),
        F.hypot(middle["x"], middle["y"]) / size,
    ]
    return rows.select(*DIVISION, "frame", *(v.alias(n) for n, v in zip(FEATURES, values, strict=True)))


def score(weights: tuple[float, ...] = (1, 1, 1, 1, 1, 1), biases: tuple[float, ...] = BIASES) -> Column:
    """Weighted squares of the features' distance to the biases; lower is likelier. Other weights need no new features."""
    terms = [F.pow(F.col(f) - b, F.lit(2)) * (w * d) for f, w, d, b in zip(FEATURES, weights, WEIGHTS, biases, strict=True)]
    return sum(terms[1:], terms[0])


def _heaviest(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one cluster of conflicts that have the greatest sum of weights without a conflict: one of each mother, no daughter twice."""
    rows = rows.sort_values(["mother", "daughter1", "daughter2"]).reset_index(drop=True)
    by_mother = [list(i) for i in rows.groupby("mother", sort=True).indices.values()]
    options = [[(float(rows["weight"][i]), frozenset((rows["daughter1"][i], rows["daughter2"][i]))) for i in some] for some in by_mother]
    return rows.iloc[sorted(by_mother[m][k] for m, k in heaviest(options))]


def choose(scored: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """Divisions with a score under the cutoff, or none (null or NaN: set by hand, counts as 0), so that no two conflict and the sum of (greatest score + 1 - score) is greatest.

    Divisions without a conflict stay as they are. The others are solved exactly, one cluster of conflicts at a time (a mother's neighbourhood, not a whole movie), mother by mother, so that rows of mothers of any length end soon. An empty table gives an empty one.
    """
    by_hand = F.col("score").isNull() | F.isnan("score")
    good = saved(scored.where((F.col("score") < cutoff) | by_hand).withColumn("_s", F.when(by_hand, 0.0).otherwise(F.col("score"))))
    node = F.struct(*DIVISION)
    pairs = conflicts(good)
    links = pairs.select(node.alias("a"), F.struct("stack_id", *(F.col(f"other_{c}").alias(c) for c in DIVISION[1:])).alias("b"))
    clusters = components(links).select("node.*", F.col("component").alias("cluster"))
    top = good.agg((F.max("_s") + 1).alias("_top"))
    met = good.crossJoin(F.broadcast(top)).select(*DIVISION, (F.col("_top") - F.col("_s")).alias("weight")).join(clusters, DIVISION)
    won = met.groupBy("cluster").applyInPandas(lambda rows: _heaviest(rows)[[*DIVISION, "weight"]], met.select(*DIVISION, "weight").schema)
    free = good.join(clusters, DIVISION, "left_anti").select(*scored.columns)
    return free.unionByName(good.join(won.select(*DIVISION), DIVISION, "left_semi").select(*scored.columns))
