"""Track algebra on tracks(stack_id, particle, frame, cell_number, x, y): windows by track, aggregates by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TRACK = ["stack_id", "particle"]


def by_frame():
    """Points of a track in order of time."""
    return W.partitionBy(*TRACK).orderBy("frame")


def velocities(tracks: DataFrame) -> DataFrame:
    """Forward difference to a track's next point by its time: dx, dy, dt, v, theta; null on its last point."""
    step = tracks.withColumn("dt", F.lead("frame").over(by_frame()) - F.col("frame"))
    step = step.withColumn("dx", (F.lead("x").over(by_frame()) - F.col("x")) / F.col("dt")).withColumn("dy", (F.lead("y").over(by_frame()) - F.col("y")) / F.col("dt"))
    return step.withColumn("v", F.hypot("dx", "dy")).withColumn("theta", F.atan2("dy", "dx"))


def frame_quartiles(rows: DataFrame, value: str) -> DataFrame:
    """Quartiles of a column and its number of values by frame; NaN does not count."""
    v = F.when(~F.isnan(value), F.col(value))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy("stack_id", "frame").agg(q.alias("q"), F.count(v).alias("n")).select("stack_id", "frame", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))), "n")


def drift(tracks: DataFrame) -> DataFrame:
    """Mean step of tracks seen in consecutive frames, summed over frames. One row a frame, so the running sum is over few rows a stack."""
    step = tracks.select("stack_id", "frame", (F.col("frame") - F.lag("frame").over(by_frame())).alias("dt"), *((F.col(c) - F.lag(c).over(by_frame())).alias(f"d{c}") for c in "xy"))
    mean = step.where("dt = 1").groupBy("stack_id", "frame").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    run = W.partitionBy("stack_id").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)
    return mean.select("stack_id", "frame", F.sum("dx").over(run).alias("dx"), F.sum("dy").over(run).alias("dy"))


def subtract_drift(tracks: DataFrame, shift: DataFrame) -> DataFrame:
    """Positions less their frame's drift; frames without one stay."""
    joined = tracks.join(shift, ["stack_id", "frame"], "left")
    return joined.withColumns({c: F.col(c) - F.coalesce(f"d{c}", F.lit(0.0)) for c in "xy"}).drop("dx", "dy")


def search_range(tracks: DataFrame, quantile: float = 0.97) -> DataFrame:
    """The quantile of step speeds of each stack."""
    return velocities(tracks).where("v is not null").groupBy("stack_id").agg(F.percentile("v", F.lit(quantile)).alias("search_range"))


#: Particle ids that one task numbers.
_SPAN = 1 << 16


def new_ids(tracks: DataFrame) -> DataFrame:
    """(stack_id, particle, new_particle): ids without gaps from 0 in each stack, in their order. Ids are numbered span by span and moved on by the spans before."""
    ids = tracks.select(*TRACK).distinct().withColumn("_span", F.floor(F.col("particle") / _SPAN).cast("long"))
    counts = ids.groupBy("stack_id", "_span").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("stack_id").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = ids.withColumn("_place", F.row_number().over(W.partitionBy("stack_id", "_span").orderBy("particle"))).join(counts.withColumn("_before", before), ["stack_id", "_span"])
    return placed.select(*TRACK, (F.col("_before") + F.col("_place") - 1).cast("long").alias("new_particle"))


def renumber(tracks: DataFrame) -> DataFrame:
    """Particle ids without gaps from 0 in each stack."""
    return tracks.join(new_ids(tracks), TRACK).withColumn("particle", F.col("new_particle")).drop("new_particle")


def drop_stubs(tracks: DataFrame, least: int) -> DataFrame:
    """Tracks of `least` points or more, renumbered."""
    return renumber(tracks.withColumn("_n", F.count("*").over(W.partitionBy(*TRACK))).where(F.col("_n") >= least).drop("_n"))


def ordered(tracks: DataFrame, by_particle: bool = False) -> DataFrame:
    """tracks sorted over all tasks by frame and particle, or by particle and frame, with `place`, the row's number in its stack from 0.

    Numbers are given within frames (or tracks) and moved on by the rows before, so that no task numbers a stack.
    """
    first, second = ("particle", "frame") if by_particle else ("frame", "particle")
    counts = tracks.groupBy("stack_id", first).agg(F.count("*").alias("_n"))
    span = counts.withColumn("_span", F.floor(F.col(first) / _SPAN).cast("long"))
    spans = span.groupBy("stack_id", "_span").agg(F.sum("_n").alias("_n"))
    earlier = lambda keys, order: F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("stack_id", "_span", earlier(["stack_id"], "_span").alias("_spans"))
    starts = span.withColumn("_before", earlier(["stack_id", "_span"], first)).join(spans, ["stack_id", "_span"]).select("stack_id", first, (F.col("_before") + F.col("_spans")).alias("_start"))
    own = F.row_number().over(W.partitionBy("stack_id", first).orderBy(second)) - 1
    placed = tracks.withColumn("place", own).join(starts, ["stack_id", first]).withColumn("place", F.col("place") + F.col("_start")).drop("_start")
    return placed.orderBy("stack_id", "place").select(*tracks.columns, "place")


def segments(tracks: DataFrame) -> DataFrame:
    """Each point with its track's next, where that is in the next frame."""
    nxt = {f"next_{c}": F.lead(c).over(by_frame()) for c in ("frame", "x", "y")}
    return tracks.withColumns(nxt).where("next_frame = frame + 1").drop("next_frame")


def trails(tracks: DataFrame, length: int) -> DataFrame:
    """The last `length` points of the track up to each point, as an array."""
    return tracks.withColumn("trail", F.collect_list(F.struct("frame", "x", "y")).over(by_frame().rowsBetween(-(length - 1), 0)))


def track_ends(tracks: DataFrame) -> DataFrame:
    """First and last frame and points of each track; births are not in the stack's first frame nor deaths in its last."""
    ends = tracks.groupBy(*TRACK).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n"))
    span = tracks.groupBy("stack_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    return ends.join(span, "stack_id").select(*TRACK, "first_frame", "last_frame", "n", (F.col("first_frame") > F.col("lo")).alias("born"), (F.col("last_frame") < F.col("hi")).alias("died"))


def drop_frame(tracks: DataFrame, frame: int) -> DataFrame:
    """Without a frame; later ones move down."""
    return tracks.where(F.col("frame") != frame).withColumn("frame", F.when(F.col("frame") > frame, F.col("frame") - 1).otherwise(F.col("frame")))


def substack(tracks: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames listed in frames(stack_id, frame, place), renumbered by place."""
    return tracks.join(frames, ["stack_id", "frame"]).withColumn("frame", F.col("place")).drop("place")


def delete_parts(tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Without heads (to a frame) or tails (from a frame) of tracks, by edits(stack_id, op, particle, frame) of delete_head and delete_tail."""
    bounds = edits.groupBy(*TRACK).agg(F.max(F.when(F.col("op") == "delete_head", F.col("frame"))).alias("head"), F.min(F.when(F.col("op") == "delete_tail", F.col("frame"))).alias("tail"))
    joined = tracks.join(bounds, TRACK, "left").where("(head is null or frame > head) and (tail is null or frame < tail)")
    return joined.drop("head", "tail")


def _once(moves: DataFrame) -> DataFrame:
    """moves(stack_id, particle, ...), an error if a track is in two: those have to be taken in order, by edits.applied."""
    several = F.count("*").over(W.partitionBy(*TRACK)) > 1
    return moves.withColumn("at", F.when(several, F.raise_error(F.lit("a track in two edits: use edits.applied")).cast("int")).otherwise(F.col("at")))


def split(tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Split tracks at frames, by edits(stack_id, particle, frame), one a track (else an error): the part from the frame on gets a new id, unless nothing comes before it."""
    top = tracks.groupBy("stack_id").agg(F.max("particle").alias("top"))
    begun = tracks.groupBy(*TRACK).agg(F.min("frame").alias("begin"))
    cuts = edits.select(*TRACK, F.col("frame").alias("at")).join(begun, TRACK).where("begin < at")
    cuts = cuts.withColumn("k", F.row_number().over(W.partitionBy("stack_id").orderBy("particle"))).join(top, "stack_id").select(*TRACK, "at", (F.col("top") + F.col("k")).alias("new_id"))
    joined = tracks.join(_once(cuts), TRACK, "left")
    return joined.withColumn("particle", F.when(F.col("frame") >= F.col("at"), F.col("new_id")).otherwise(F.col("particle"))).drop("at", "new_id")


def add_drift(tracks: DataFrame, shift: DataFrame) -> DataFrame:
    """Positions with their frame's drift added back; frames without one stay."""
    joined = tracks.join(shift, ["stack_id", "frame"], "left")
    return joined.withColumns({c: F.col(c) + F.coalesce(f"d{c}", F.lit(0.0)) for c in "xy"}).drop("dx", "dy")


def merge(tracks: DataFrame, merges: DataFrame) -> DataFrame:
    """Merge tracks by merges(stack_id, first, second, frame): from the frame on, `second` goes on as `first`, and what `first` had there becomes a new track.

    A track is in one merge at most (else an error). What `second` had before the frame stays. Ids are contiguous after it.
    """
    top = tracks.groupBy("stack_id").agg(F.max("particle").alias("top"))
    k = F.row_number().over(W.partitionBy("stack_id").orderBy("first"))
    found = merges.withColumn("k", k).join(top, "stack_id").select("stack_id", "first", "second", F.col("frame").alias("at"), (F.col("top") + F.col("k")).alias("tail"))
    moves = found.select("stack_id", F.col("first").alias("particle"), "at", F.col("tail").alias("to")).union(found.select("stack_id", "second", "at", "first"))
    joined = tracks.join(_once(moves), TRACK, "left").withColumn("particle", F.when(F.col("frame") >= F.col("at"), F.col("to")).otherwise(F.col("particle")))
    return renumber(joined.drop("at", "to"))


def reconcile(tracks: DataFrame, cells: DataFrame) -> DataFrame:
    """Tracks of cells(stack_id, frame, label) alone: rows without a cell go, cells without a row become tracks of their own; ids are contiguous. Labels are cell numbers + 1.

    New ids are numbered within frames and moved on by the frames' counts, so that no task sees all new cells.
    """
    key = ["stack_id", "frame", "cell_number"]
    own = cells.select("stack_id", "frame", (F.col("label") - 1).alias("cell_number")).distinct()
    kept = tracks.select(*TRACK, "frame", "cell_number").join(own, key, "left_semi")
    missing = own.join(kept, key, "left_anti")
    counts = missing.groupBy("stack_id", "frame").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("stack_id").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("stack_id", "frame").orderBy("cell_number"))
    top = tracks.groupBy("stack_id").agg(F.max("particle").alias("top"))
    new = missing.withColumn("place", place).join(counts.withColumn("before", before).drop("n"), ["stack_id", "frame"]).join(top, "stack_id", "left")
    new = new.select("stack_id", (F.coalesce("top", F.lit(-1)) + F.col("before") + F.col("place")).alias("particle"), "frame", "cell_number")
    return renumber(kept.unionByName(new))


def shared_frames(tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs(stack_id, first, second): frames of `second`, and whether `first` is there too."""
    second = pairs.join(tracks.select("stack_id", F.col("particle").alias("second"), "frame"), ["stack_id", "second"])
    first = tracks.select("stack_id", F.col("particle").alias("first"), "frame", F.lit(True).alias("both")).distinct()
    return second.join(first, ["stack_id", "first", "frame"], "left").withColumn("both", F.coalesce("both", F.lit(False)))


def shown(tracks: DataFrame, frame: int, before: bool | None = None, particle: int | None = None) -> DataFrame:
    """Points of the tracks before a frame, or from it on, or (None) all; of one particle if it is named."""
    own = tracks if particle is None else tracks.where(F.col("particle") == particle)
    return own if before is None else own.where(F.col("frame") < frame if before else F.col("frame") >= frame)
