"""Cell-cycle stage sequences (0 none, 1 G1, 2 S, 3 G2) along tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tracks import TRACK, by_frame
from .zonal import CELL, cells

STAGE = "cycle_stage"


def flags(rows: DataFrame) -> DataFrame:
    """Green and red flags of a stage code: stage = green + 2 * red."""
    return rows.withColumn("green", F.col(STAGE).bitwiseAND(1) == 1).withColumn("red", F.col(STAGE).bitwiseAND(2) == 2)


def propagate(tracks: DataFrame) -> DataFrame:
    """Running maximum of the stage along each track."""
    return tracks.withColumn(STAGE, F.max(STAGE).over(by_frame().rowsBetween(W.unboundedPreceding, 0)))


def impute(tracks: DataFrame, limit: int = 6) -> DataFrame:
    """Fill zeros from up to `limit` points before, then from up to as many after."""
    known = F.when(F.col(STAGE) != 0, F.col(STAGE))
    forward = tracks.withColumn("_s", F.last(known, ignorenulls=True).over(by_frame().rowsBetween(-limit, 0)))
    filled = F.first("_s", ignorenulls=True).over(by_frame().rowsBetween(0, limit))
    return forward.withColumn(STAGE, F.coalesce(filled, F.lit(0))).drop("_s")


def smooth(tracks: DataFrame) -> DataFrame:
    """Majority of each point and its two neighbours; ties go to the smallest stage."""
    near = by_frame().rowsBetween(-1, 1)
    votes = F.array(*(F.struct(F.count_if(F.col(STAGE) == s).over(near).alias("n"), F.lit(-s).alias("s")) for s in range(4)))
    return tracks.withColumn(STAGE, -F.array_max(votes)["s"])


def _numbered(tracks: DataFrame) -> DataFrame:
    step = F.when(F.col(STAGE) != F.lag(STAGE).over(by_frame()), 1).otherwise(0)
    return tracks.withColumn("_step", step).withColumn("run", F.sum("_step").over(by_frame().rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def runs(tracks: DataFrame) -> DataFrame:
    """Runs of one stage: run number, stage, length and first frame."""
    return _numbered(tracks).groupBy(*TRACK, "run").agg(F.first(STAGE).alias(STAGE), F.count("*").alias("length"), F.min("frame").alias("first_frame"))


def _with_fixes(tracks: DataFrame, fixes: DataFrame) -> DataFrame:
    """Rows with the stage that fixes(track, run, fixed) gives to their run."""
    return _numbered(tracks).join(fixes, [*TRACK, "run"], "left").withColumn(STAGE, F.coalesce("fixed", STAGE)).drop("fixed", "run")


def mother_g2(tracks: DataFrame, limit: int = 6) -> DataFrame:
    """A last run of stage 2, of `limit` points at most and after stage 3, becomes stage 3."""
    order = W.partitionBy(*TRACK).orderBy("run")
    found = runs(tracks).withColumns({"before": F.lag(STAGE).over(order), "after": F.lead(STAGE).over(order)})
    found = found.where((F.col(STAGE) == 2) & (F.col("before") == 3) & F.col("after").isNull() & (F.col("length") <= limit))
    return _with_fixes(tracks, found.select(*TRACK, "run", F.lit(3).alias("fixed")))


def daughter_g1(tracks: DataFrame, least: int = 4) -> DataFrame:
    """A start in stages 2 or 3, of `least` points or more and before stage 1, becomes stage 1."""
    merged = tracks.withColumn(STAGE, F.when(F.col(STAGE) == 2, 3).otherwise(F.col(STAGE)))
    found = runs(merged).withColumn("after", F.lead(STAGE).over(W.partitionBy(*TRACK).orderBy("run")))
    found = found.where((F.col("run") == 0) & (F.col(STAGE) == 3) & (F.col("after") == 1) & (F.col("length") >= least))
    starts = found.select(*TRACK, F.col("length").alias("_n"))
    place = F.row_number().over(by_frame())
    return tracks.withColumn("_place", place).join(starts, TRACK, "left").withColumn(STAGE, F.when(F.col("_place") <= F.col("_n"), 1).otherwise(F.col(STAGE))).drop("_place", "_n")


def remove_sandwiched(tracks: DataFrame, stages: tuple[int, int, int]) -> DataFrame:
    """One pass: of three runs of the given stages, an inner one shorter than the outer two together takes the last one's stage."""
    order = W.partitionBy(*TRACK).orderBy("run")
    found = runs(tracks)
    found = found.withColumns({f"{n}_{c}": f(c).over(order) for n, f in (("before", F.lag), ("after", F.lead)) for c in (STAGE, "length")})
    a, b, c = stages
    inner = (F.col(f"before_{STAGE}") == a) & (F.col(STAGE) == b) & (F.col(f"after_{STAGE}") == c)
    found = found.where(inner & (F.col("before_length") + F.col("after_length") > F.col("length")))
    return _with_fixes(tracks, found.select(*TRACK, "run", F.lit(c).alias("fixed")))


def subsequence(tracks: DataFrame, stages: list[int]) -> DataFrame:
    """Runs at which the given stages follow each other."""
    order = W.partitionBy(*TRACK).orderBy("run")
    found = runs(tracks).withColumns({f"_{i}": F.lead(STAGE, i).over(order) for i in range(len(stages))})
    for i, s in enumerate(stages):
        found = found.where(F.col(f"_{i}") == s)
    return found.select(*TRACK, "run", "first_frame")


def problematic(tracks: DataFrame) -> DataFrame:
    """Tracks with a step between stages other than 0 or +1."""
    step = F.lead(STAGE).over(by_frame()) - F.col(STAGE)
    return tracks.select(*TRACK, step.alias("s")).where("s not in (0, 1)").select(*TRACK).distinct()


def occupancy(rows: DataFrame, condition: str, stage: str) -> DataFrame:
    """Share of each stage among the rows of a condition."""
    n = rows.groupBy(condition, stage).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(condition)))


#: Runs of stages that cannot be, in the order in which they are mended; the last stage takes the inner run.
FLICKERS = ((1, 3, 1), (3, 2, 3), (1, 3, 2), (1, 0, 2), (2, 3, 2))


def _steady(stages: np.ndarray, pattern: tuple[int, int, int]) -> np.ndarray:
    """remove_sandwiched on one track until nothing changes."""
    while True:
        starts = np.flatnonzero(np.append(True, np.diff(stages) != 0))
        length = np.diff(np.append(starts, len(stages)))
        inner = [i for i in range(1, len(starts) - 1) if tuple(stages[starts[i - 1 : i + 2]]) == pattern and length[i - 1] + length[i + 1] > length[i]]
        if not inner:
            return stages
        for i in inner:
            stages[starts[i] : starts[i + 1]] = pattern[2]


def remove_flickers(tracks: DataFrame, patterns: tuple[tuple[int, int, int], ...] = FLICKERS) -> DataFrame:
    """remove_sandwiched for each pattern in turn, each until its track is stable. Other columns stay; a track is one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        stages = rows[STAGE].to_numpy(copy=True)
        for pattern in patterns:
            stages = _steady(stages, pattern)
        return rows.assign(**{STAGE: stages})

    return tracks.groupBy(*TRACK).applyInPandas(run, tracks.schema)


def interpretable(tracks: DataFrame, impute_zeros: bool = True, zero_remainder: bool = True) -> DataFrame:
    """Tracks with a step that cannot be are mended: zeros filled, single points smoothed, ends before and after divisions, then flickers.

    Tracks without such a step stay as they are; those that still have one lose their stages if zero_remainder. Stages are integers without nulls.
    """
    tracks = tracks.withColumn(STAGE, F.col(STAGE).cast("int"))
    odd = problematic(tracks)
    bad = tracks.join(odd, TRACK, "left_semi")
    bad = impute(bad) if impute_zeros else bad
    mended = remove_flickers(daughter_g1(mother_g2(smooth(bad))).select(*tracks.columns))
    if zero_remainder:
        still = problematic(mended).withColumn("_still", F.lit(True))
        mended = mended.join(still, TRACK, "left").withColumn(STAGE, F.when(F.col("_still"), 0).otherwise(F.col(STAGE))).select(*tracks.columns)
    return tracks.join(odd, TRACK, "left_anti").unionByName(mended)


def snapshot(pixels: DataFrame, red: str, green: str, red_above: float, green_above: float, brightness: float = 1.5, share: float = 0.15, orange_share: float | None = None) -> DataFrame:
    """Stage of each cell by the shares of its pixels that are green, red and orange (red above red_above * brightness and green).

    Orange at more than orange_share (share, if not given) is 3; else green alone is 1 and red alone 2, and of both the larger share counts, red if equal.
    """
    is_green, is_red = F.col(green) > green_above, F.col(red) > red_above
    is_orange = (F.col(red) > red_above * brightness) & is_green
    part = lambda c: F.avg(c.cast("double"))
    parts = cells(pixels).groupBy(*CELL).agg(part(is_green).alias("g"), part(is_red).alias("r"), part(is_orange).alias("o"))
    g, r = F.col("g"), F.col("r")
    stage = F.when(F.col("o") > (share if orange_share is None else orange_share), 3).when((g > share) & (~(r > share) | (g > r)), 1).when(r > share, 2).otherwise(0)
    return parts.select(*CELL, stage.alias(STAGE))


def from_nuclei(green: DataFrame, red: DataFrame, green_above: float, red_above: float) -> DataFrame:
    """Stage of each cell by its nucleus's ratios (stack_id, frame, label, ratio): 1 if green is high, plus 2 if red is."""
    both = green.withColumnRenamed("ratio", "g").join(red.withColumnRenamed("ratio", "r"), CELL)
    high = lambda c, t: F.coalesce((F.col(c) > t).cast("int"), F.lit(0))
    return both.select(*CELL, (high("g", green_above) + 2 * high("r", red_above)).alias(STAGE))


def _centred_mean(v: np.ndarray, reach: int) -> np.ndarray:
    """Mean of each value with those up to `reach` places away; fewer at the ends."""
    total = np.concatenate([[0.0], np.cumsum(v)])
    at = np.arange(len(v))
    lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach + 1, len(v))
    return (total[hi] - total[lo]) / (hi - lo)


def most_prominent(v: np.ndarray) -> tuple[int, float]:
    """The inner local maximum of the greatest prominence (the first of equals) and that prominence; (-1, 0) without one. A level top counts once, at its middle.

    Prominence is how far one has to come down before a higher value is reached, on the side where that is less; a stack of falling values finds
    the next higher one on either side.
    """
    lead = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, int)
    level, last = v[lead], np.append(lead[1:], len(v)) - 1

    def drop(values: np.ndarray) -> np.ndarray:
        """Lowest value since the last higher one."""
        out, open_ = np.empty(len(values)), []
        for i, x in enumerate(values):
            low = x
            while open_ and open_[-1][0] <= x:
                low = min(low, open_.pop()[1])
            out[i] = low
            open_.append((x, low))
        return out

    height = level - np.maximum(drop(level), drop(level[::-1])[::-1])
    tops = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    if not len(tops):
        return -1, 0.0
    best = tops[int(height[tops].argmax())]
    return int((lead[best] + last[best]) // 2), float(height[best])


def transitions(green: np.ndarray, red: np.ndarray, threshold: float = -10.0, prominence: float = 0.005) -> tuple[int, int]:
    """Places in a track at which G1 ends and at which G2 begins, -1 where it does not.

    G1 ends after the first steep fall of green (gradient at the threshold or below, or near the steepest fall if that is steeper still; not in the last three
    places). G2 begins at the deepest dip of smoothed green over smoothed red, five places after G1's end at the earliest.
    """
    slope = np.gradient(green)
    falls = np.flatnonzero(slope[:-3] <= min(threshold, 0.9 * slope.min()))
    g1 = int(falls[0]) + 1 if len(falls) else -1
    parts = [green[:g1], green[g1:]] if g1 > 0 else [green]
    calm = np.concatenate([_centred_mean(p, 2) if len(p) > 5 else p for p in parts])
    with np.errstate(all="ignore"):
        ratio = calm / _centred_mean(red, 3)
    start = g1 + 5 if g1 > 0 else 0
    dip, depth = most_prominent(-ratio[start:])
    return g1, dip + start if dip >= 0 and depth >= prominence else -1


def stages_by_transitions(points: DataFrame, threshold: float = -10.0, prominence: float = 0.005, least: int = 15) -> DataFrame:
    """points(stack_id, particle, frame, green, red, cycle_stage, ...) with the stages that transitions() of each track give: 1 before G1's end, 3 from G2's begin, 2 between.

    Tracks of fewer than `least` points, with a null or NaN intensity, or without a transition keep their stages. A task gets the two series of
    one track at a time, a movie's length at most. An empty table gives an empty one.
    """
    series = points.groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.struct("frame", F.col("green").cast("double").alias("g"), F.col("red").cast("double").alias("r")))).alias("s"), F.count("*").alias("n")).where(F.col("n") >= least)
    series = series.where(~F.exists("s", lambda x: x["g"].isNull() | x["r"].isNull() | F.isnan(x["g"]) | F.isnan(x["r"])))

    @F.pandas_udf("g1 int, g2 int")
    def found(greens: pd.Series, reds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([transitions(np.asarray(g, float), np.asarray(r, float), threshold, prominence) for g, r in zip(greens, reds, strict=True)], columns=["g1", "g2"])

    marks = series.select(*TRACK, "s", found(F.transform("s", lambda x: x["g"]), F.transform("s", lambda x: x["r"])).alias("t")).where("t.g1 > 0 or t.g2 >= 0")
    frame = lambda c: F.when(F.col(f"t.{c}") >= 0, F.element_at("s", F.col(f"t.{c}") + 1)["frame"])
    marks = marks.select(*TRACK, frame("g1").alias("_g1"), frame("g2").alias("_g2"), F.lit(True).alias("_set"))
    stage = F.when(F.col("_set").isNull(), F.col("cycle_stage")).when(F.col("frame") >= F.col("_g2"), 3).when(F.col("frame") < F.col("_g1"), 1).otherwise(2)
    return points.join(marks, TRACK, "left").withColumn("cycle_stage", stage).drop("_g1", "_g2", "_set")
