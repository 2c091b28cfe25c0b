"""Connected components of a link table: in one task while its links are few, by alternating large-star and small-star rounds beyond."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Number of keys at most that spread_join broadcasts.
HUBS = 1024
#: Links between tasks' own stars that one task joins at most; more go through rounds.
ONE_TASK = 1 << 17


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a batch by stars with the same components, so that long chains shrink before the first shuffle."""
    for batch in batches:
        yield from _forest([batch])


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of all batches as stars: each node (u) with the smallest one that it reaches by them (v)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    leaves = [(x, root(x)) for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in leaves], pa.int64()), pa.array([r for _, r in leaves], pa.int64())], ["u", "v"])


def hot_degree(total: int) -> int:
    """Keys with more rows than this are HUBS at most, among so many rows."""
    return max(64, total // HUBS)


def spread_join(rows: DataFrame, sides: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """rows joined with sides, which has each key once and its number of rows as `degree`.

    Keys with more than `limit` rows, HUBS at most if that is hot_degree(number of rows), are broadcast, and their rows stay where they are. The
    others are shuffled. No task so gets more than its share of a hot key.
    """
    hubs = F.broadcast(sides.where(F.col("degree") > limit))
    rest = rows.join(F.broadcast(sides.where(F.col("degree") > limit).select(*keys)), keys, "left_anti")
    return rows.join(hubs, keys).unionByName(rest.join(sides.where(F.col("degree") <= limit), keys))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, component): each linked node with the smallest node it reaches. A component's smallest node has no row.

    Null ends and self-links are ignored; an empty table gives an empty one. Each batch first makes stars of its own links; ONE_TASK of these or fewer
    are joined by one task, since a round costs a dozen shuffles however few its links are. More go through rounds, which end when each node has one root and no root has one itself.
    Every round is written to the shared folder, so a lost executor costs one round at most. A hub is never gathered: minima are aggregated
    before they are shuffled, and in joins the rows of hubs, HUBS nodes at most, are dealt by a salt.
    """
    stars = materialise(links.where("a <> b").select("a", "b").mapInArrow(_local_forest, "u long, v long").distinct())
    if stars.count() <= ONE_TASK:
        return materialise(stars.coalesce(1).mapInArrow(_forest, "u long, v long")).select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = both.groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("roots"), F.count("*").alias("degree"))
        leaf, root = F.col("roots") > 0, F.col("roots") < F.col("degree")
        state = nodes.agg(F.coalesce(F.max("roots"), F.lit(0)).alias("roots"), F.coalesce(F.bool_or(leaf & root), F.lit(False)).alias("both"), F.coalesce(F.sum("degree"), F.lit(0)).alias("total"), F.max("degree").alias("degree")).first()
        if state["roots"] <= 1 and not state["both"]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
        limit = hot_degree(state["total"])
        hubs = nodes.where(F.col("degree") > limit).select("u").toArrow()["u"].to_pylist() if state["degree"] > limit else []  # HUBS at most
        is_hub, salts = F.col("u").isin(hubs), -(-state["degree"] // limit)

        def joined(rows: DataFrame, sides: DataFrame) -> DataFrame:
            if not hubs:
                return rows.join(sides, "u")
            salted = rows.withColumn("salt", F.when(is_hub, F.pmod(F.xxhash64("v"), F.lit(salts))).otherwise(0).cast("int"))
            every = F.when(is_hub, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
            return salted.join(sides.withColumn("salt", F.explode(every)), ["u", "salt"])

        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, first).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(first.select("u", F.col("m").alias("v")))
        stars = materialise(small.distinct())
