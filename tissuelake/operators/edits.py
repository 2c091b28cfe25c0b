"""An ordered log of edits of tracks, with divisions that follow.

Edits are folded in order for each connected group of tracks that they name; all other tracks are left where they are. What a task gets is the points
of one group (frame and track only), so its size is that of the tracks which edits tie together, not of the stack.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .components import components, saved
from .tracks import TRACK

ROLES = ["mother", "daughter1", "daughter2"]
_ROWS = "stack_id int, kind int, seq long, op string, particle long, other long, frame int, ref long, role string"
_FOLDED = "stack_id int, kind int, particle long, frame int, ref long, role string, owner long"


def _fold(rows: pa.Table) -> pa.Table:
    """Whose each point and each part in a division is after all edits of a group; null: deleted. Groups are small and many, so plain arrays do."""
    kind = rows["kind"].to_numpy()
    places = {c: pc.fill_null(rows[c].cast(pa.int64()), np.iinfo(np.int64).min).to_numpy() for c in ("particle", "frame")}
    points, parts = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
    owner, frame = places["particle"][points], places["frame"][points]
    member, when = places["particle"][parts], places["frame"][parts]
    alive, emptied = np.ones(len(owner), dtype=bool), set()

    def cut(track: int, at: int, new: int) -> bool:
        """Give what a track has from a frame on to a new one; nothing happens if it has nothing before."""
        if not (alive & (owner == track) & (frame < at)).any():
            return False
        owner[alive & (owner == track) & (frame >= at)] = new
        member[(member == track) & (when >= at)] = new
        return True

    for e in rows.filter(pa.array(kind == 0)).select(["op", "seq", "particle", "other", "frame"]).sort_by("seq").to_pylist():
        op, seq, track, at = e["op"], e["seq"], e["particle"], e["frame"]
        if op == "split":
            cut(track, at, -seq)
        elif op == "merge":
            second, passing = int(e["other"]), np.iinfo(np.int64).min
            if (alive & (owner == track) & (frame >= at)).any():
                cut(track, at, -seq)
            if cut(second, at, passing):
                second = passing
            owner[owner == second] = track
            member[member == second] = track
        elif op in ("delete_head", "delete_tail", "delete"):
            gone = alive & (owner == track)
            gone &= frame <= at if op == "delete_head" else frame >= at if op == "delete_tail" else True
            alive &= ~gone
            if gone.any() and not (alive & (owner == track)).any():
                emptied.add(track)
    emptied -= set(owner[alive].tolist())
    lost = np.isin(member, list(emptied)) if emptied else np.zeros(len(member), dtype=bool)
    # a point that comes twice is one
    first = np.sort(np.unique(np.stack([places["particle"][points], frame], 1), axis=0, return_index=True)[1]) if len(points) else points
    out = rows.select(["stack_id", "kind", "particle", "frame", "ref", "role"]).take(pa.array(np.concatenate([points[first], parts])))
    return out.append_column("owner", pa.array(np.concatenate([owner[first], member]), pa.int64(), mask=np.concatenate([~alive[first], lost])))


def applied(tracks: DataFrame, divisions: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tracks(stack_id, particle, frame, ...) and divisions(stack_id, mother, daughter1, daughter2, frame, ...) after the edits of log(stack_id, seq, op, particle, other, frame).

    seq is 1 or more, each once a stack; edits are taken in its order, any number of them a track. Ops: `split` (what particle has from frame on is a
    new track, unless nothing comes before), `merge` (from frame on, `other` goes on as particle, whose own rest becomes a new track), `delete_head`
    (to frame), `delete_tail` (from frame), `delete`. Other ops, and edits without a particle, do nothing. A later edit calls the track that edit s
    made -s. New ids follow the stack's largest one, in order of seq.

    Divisions follow: from a split's frame on they name the new track, and after a merge the merged one. A division of which a member lost its
    last point by a deletion goes. Empty tables give empty ones.
    """
    kinds = {c: t for c, t in tracks.dtypes}
    log = saved(log.where("particle is not null").select(F.col("stack_id").cast("int").alias("stack_id"), F.col("seq").cast("long").alias("seq"), "op", *(F.col(c).cast("long").alias(c) for c in ("particle", "other")), F.col("frame").cast("int").alias("frame")))
    name = lambda c: F.struct("stack_id", c.alias("id"))
    ties = log.select(name(F.col("particle")).alias("a"), F.explode(F.array(name(F.col("particle")), name(F.coalesce("other", "particle")), name(-F.col("seq")))).alias("b"))
    groups = saved(components(ties).select("node.stack_id", F.col("node.id").alias("particle"), F.col("component").alias("cluster")))
    marked = saved(divisions.withColumn("_ref", F.monotonically_increasing_id()))
    none = lambda t: F.lit(None).cast(t)
    edits = log.select("stack_id", F.lit(0).alias("kind"), "seq", "op", "particle", "other", "frame", none("long").alias("ref"), none("string").alias("role"))
    points = tracks.select(F.col("stack_id").cast("int").alias("stack_id"), F.lit(1), none("long"), none("string"), F.col("particle").cast("long"), none("long"), F.col("frame").cast("int"), none("long"), none("string"))
    role = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).cast("long").alias("id")) for r in ROLES))).alias("r")
    parts = marked.select("stack_id", "frame", "_ref", role).select(F.col("stack_id").cast("int"), F.lit(2), none("long"), none("string"), "r.id", none("long"), F.col("frame").cast("int"), "_ref", "r.role")
    rows = edits.union(points).union(parts).join(groups, TRACK)
    folded = saved(rows.groupBy("cluster").applyInArrow(lambda g: _fold(g), _FOLDED))
    top = tracks.groupBy("stack_id").agg(F.max("particle").cast("long").alias("top"))
    made = folded.where("owner < 0").select("stack_id", "owner").distinct().join(top, "stack_id")
    made = made.select("stack_id", "owner", (F.col("top") + F.row_number().over(W.partitionBy("stack_id").orderBy(F.desc("owner")))).alias("new_id"))
    named = saved(folded.join(made, ["stack_id", "owner"], "left").withColumn("owner", F.coalesce("new_id", "owner")).drop("new_id"))
    moved = named.where("kind = 1").select("stack_id", "particle", "frame", F.col("owner").alias("_owner"), F.lit(True).alias("_seen"))
    after = tracks.join(moved, [*TRACK, "frame"], "left").where("_seen is null or _owner is not null")
    after = after.withColumn("particle", F.coalesce("_owner", "particle").cast(kinds["particle"])).select(*tracks.columns)
    roles = named.where("kind = 2").groupBy(F.col("ref").alias("_ref")).agg(F.bool_or(F.col("owner").isNull()).alias("_lost"), *(F.max(F.when(F.col("role") == r, F.col("owner"))).alias(f"_{r}") for r in ROLES))
    followed = marked.join(roles, "_ref", "left").where("_lost is null or not _lost")
    followed = followed.withColumns({r: F.coalesce(f"_{r}", r).cast(dict(divisions.dtypes)[r]) for r in ROLES}).select(*divisions.columns)
    return after, followed


def renumbered(tracks: DataFrame, divisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids without gaps from 0 in each stack, in their order, for tracks and divisions; a division's member without a track keeps its id."""
    from .tracks import new_ids

    ids = saved(new_ids(tracks))
    after = tracks.join(ids, TRACK).withColumn("particle", F.col("new_particle")).select(*tracks.columns)
    out = divisions
    for r in ROLES:
        out = out.join(ids.select("stack_id", F.col("particle").alias(r), F.col("new_particle").alias("_new")), ["stack_id", r], "left").withColumn(r, F.coalesce("_new", r)).drop("_new")
    return after, out.select(*divisions.columns)
