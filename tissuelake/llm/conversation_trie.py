"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns. Nodes are named by prefix sums of turn hashes, so that a conversation of any length is spread over
tasks. Each node has an enter and an exit arc; the tour enters a node, then tours its children one after another, then exits. The tour is
list-ranked: tasks first shorten the stretches that lie within their own part of the arcs, then pointers are doubled between the parts. The sums
from each arc to the tour's end give a subtree's sums as the difference of a node's two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialise
from .graph import hot_degree, spread_join

KEY = ["depth", "h1", "h2"]


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with the running sum of each of `sums` over its group (no nulls) in the given order, null first; rows alike in all of it take any order.

    Rows are sorted over all tasks, so a group may lie in several; sums within a part are then moved on by those of the group's earlier parts.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *group, *order, "_tie").sortWithinPartitions(*group, *order, "_tie")
    placed = materialise(tied.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*group, "_part").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*group, "_part", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    own = W.partitionBy(*group, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumns({name: F.sum(c).over(own) for name, c in sums.items()}).join(parts, [*group, "_part"])
    return summed.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop("_at", "_part", *(f"_{name}" for name in sums))


def rebuilt(conversations: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, role, text, length) of every rebuilt conversation, depth from 1, and all conversations (conv_id, length), those without turns too.

    A conversation takes the first `head` turns of conversation `base` and then its own ones after its first `head`; both are of conv_id, head is
    5 at most.
    """
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    turns = materialise(running(rows, ["conv_id"], ["turn", "role", "text"], {"place": F.lit(1)}))
    known = turns.groupBy("conv_id").agg(F.count("*").alias("degree")).withColumns({"base": base, "head": head})
    known = known.join(known.select(F.col("conv_id").alias("base"), F.col("degree").alias("_base")), "base", "left")
    taken = F.least("head", F.coalesce("_base", F.lit(0)))
    known = materialise(known.select("conv_id", "degree", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("degree") - F.col("head"), F.lit(0))).alias("length")))
    total = turns.count()
    own = spread_join(turns, known, ["conv_id"], hot_degree(total)).where("place > head").select("conv_id", (F.col("taken") + F.col("place") - F.col("head")).alias("depth"), "role", "text", "length")
    heads = turns.where("place <= 5").select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "role", "text")
    heads = known.join(heads, "base").where("depth <= head").select("conv_id", "depth", "role", "text", "length")
    return own.unionByName(heads).withColumn("depth", F.col("depth").cast("long")), known.select("conv_id", F.col("length").cast("long").alias("length"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's conv_ids, which come sorted and are read as a stream: a digest needs all of them in order."""
    key, digest, seen = None, None, ""
    done: list = []

    def out(rows: list) -> pa.RecordBatch:
        columns = [pa.array([k[0] for k, _ in rows], pa.int64()), *(pa.array([k[i] for k, _ in rows], pa.string()) for i in (1, 2)), pa.array([d for _, d in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*KEY, "ends_sha256"])

    for batch in batches:
        columns = [batch[c].to_pylist() for c in (*KEY, "conv_id")]
        for depth, h1, h2, conv in zip(*columns, strict=True):
            if (depth, h1, h2) != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest, seen = (depth, h1, h2), hashlib.sha256(), ""
            digest.update(f"{seen}{conv}".encode())
            seen = ","
        if len(done) > 10_000:
            yield out(done)
            done = []
    if key is not None:
        done.append((key, digest.hexdigest()))
    yield out(done)


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arcs of one part: each with the first arc after it that lies in another part, and the sums up to there."""
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    table = pa.Table.from_batches(own).combine_chunks().sort_by("arc")
    arc, leaves, saved = (table[c].to_numpy() for c in ("arc", "leaves", "saved"))
    target = table["next"].fill_null(-1).to_numpy()
    leaves, saved = leaves.copy(), saved.copy()
    at = np.minimum(np.searchsorted(arc, target), len(arc) - 1)
    here = arc[at] == target
    step = np.where(here, at, np.arange(len(arc)))
    going = here.copy()
    end = np.arange(len(arc))  # the last arc of the stretch walked so far
    while going.any():
        i = np.flatnonzero(going)
        j = step[i]
        leaves[i], saved[i], end[i], step[i], going[i] = leaves[i] + leaves[j], saved[i] + saved[j], end[j], step[j], going[j]
    out = target[end]
    yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(out, mask=out < 0), pa.array(leaves), pa.array(saved)], ["arc", "next", "leaves", "saved"])


def list_rank(arcs: DataFrame) -> DataFrame:
    """arcs(arc, next, leaves, saved, part) with the sums of leaves and saved from each arc, itself included, to the list's end: (arc, leaves, saved)."""
    fields = "arc long, next long, leaves long, saved long"
    short = materialise(arcs.repartition("part").select("arc", "next", "leaves", "saved").mapInArrow(_shorten, fields))
    # only arcs that another part leads to are ranked by doubling
    jumps = short.join(short.select(F.col("next").alias("arc")).where("arc is not null").distinct(), "arc", "left_semi")
    jumps = materialise(jumps)
    while not jumps.where("next is not null").isEmpty():
        ahead = jumps.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
        added = lambda c: (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c)
        jumps = materialise(jumps.join(ahead, "next", "left").select("arc", F.col("_next").alias("next"), added("leaves"), added("saved")))
    rest = jumps.select(F.col("arc").alias("next"), F.col("leaves").alias("_leaves"), F.col("saved").alias("_saved"))
    return short.join(rest, "next", "left").select("arc", *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")))


def trie(conversations: DataFrame, base: Column, head: Column) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations, from the textless root of depth 0.

    conversations has (conv_id, turn, role, text) and any other columns. Turns are ordered by turn, null first, ties by role and text; null role or
    text is empty. Rows without conv_id belong to no conversation and are left out; a row given twice is two turns. An empty table gives an
    empty one.

    Per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves (childless nodes of the
    subtree, itself included), saved_tokens (over the subtree, each node's (n_convs - 1) times the code points of its last text), ends_sha256
    (of the sorted ids of the members that end here).
    """
    turns, known = rebuilt(conversations, base, head)
    # a turn's hash in two numbers of 60 bits, whose sums are exact decimals
    digest = F.md5(F.concat_ws(":", F.col("depth").cast("string"), F.length("role").cast("string"), F.concat("role", "text")))
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")
    hashed = turns.select("conv_id", "depth", "length", F.length("text").cast("long").alias("chars"), half(1).alias("t1"), half(16).alias("t2"))
    members = running(hashed, ["conv_id"], ["depth"], {"h1": F.col("t1"), "h2": F.col("t2")})
    name = lambda c: c.cast("decimal(38,0)").cast("string")
    members = members.select("conv_id", "depth", "length", "chars", name(F.col("h1")).alias("h1"), name(F.col("h2")).alias("h2"), name(F.col("h1") - F.col("t1")).alias("p1"), name(F.col("h2") - F.col("t2")).alias("p2"))
    root = known.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(0).cast("long").alias("chars"), *(F.lit("0").alias(c) for c in ("h1", "h2")), *(F.lit(None).cast("string").alias(c) for c in ("p1", "p2")))
    members = materialise(members.unionByName(root))

    ends = members.where("depth = length").select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    ends = ends.mapInArrow(_digests, "depth long, h1 string, h2 string, ends_sha256 string")

    nodes = members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # nodes of one conversation are neighbours, so most arcs lead on within their own part
    nodes = nodes.repartitionByRange(n, "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()))
    parent_key = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")]
    below = nodes.where("depth > 0")
    counts = below.groupBy(*parent_key).agg(F.count("*").alias("degree"))
    parents = nodes.join(counts, KEY).select(*KEY, "degree", F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    up = spread_join(below.select("node", *parent_key), parents, KEY, hot_degree(nodes.count())).select("node", "parent", "parent_conv_id", "degree")
    up = materialise(running(up, ["parent"], ["node"], {"place": F.lit(1)}))
    after = up.select(F.col("node").alias("sibling"), "parent", (F.col("place") - 1).alias("place"))
    linked = up.select("node", "parent", "parent_conv_id", "place").join(after, ["parent", "place"], "left")
    first = up.where("place = 1").select(F.col("parent").alias("node"), F.col("node").alias("first"), F.col("degree").alias("n_children"))
    tree = nodes.join(linked.select("node", "parent", "parent_conv_id", "sibling"), "node", "left").join(first, "node", "left")
    tree = materialise(tree.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")))

    enter, leave = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
    zero = F.lit(0).cast("long")
    arc = lambda a, following, leaves, saved: F.struct(a.alias("arc"), following.alias("next"), leaves.alias("leaves"), saved.alias("saved"))
    into = arc(enter("node"), F.coalesce(enter("first"), leave("node")), (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars"))
    out = arc(leave("node"), F.coalesce(enter("sibling"), leave("parent")), zero, zero)
    arcs = tree.select(F.shiftright("node", 33).alias("part"), F.explode(F.array(into, out)).alias("a")).select("a.*", "part")
    way = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    within = list_rank(arcs).groupBy(F.shiftright("arc", 1).alias("node")).agg(F.sum(F.col("leaves") * way).alias("n_leaves"), F.sum(F.col("saved") * way).alias("saved_tokens"))
    done = tree.join(within, "node").join(ends, KEY, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
