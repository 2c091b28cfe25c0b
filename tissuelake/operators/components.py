"""Connected components of link tables and of label images."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .zonal import FRAME


#: Links between tasks' own stars that one task joins at most.
ONE_TASK = 1 << 18


def saved(df: DataFrame) -> DataFrame:
    """df written as a table to the folder that spark.checkpoint.dir names and read again; local mode without that setting takes a folder of its own.

    checkpoint() would compute df twice. Such tables compress so well that by the size of their files joins would gather them in the driver to broadcast
    them, a hundred times as large; the hint keeps joins on equal keys to sorted shuffles (a broadcast that is asked for stays one).
    """
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/cells-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def dropped(table: DataFrame) -> None:
    """Delete the files of a table that saved() wrote and nothing reads any more."""
    sc = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("cells-"):
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars of the same parts: each number with the smallest one that it reaches here."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    leaves = [(x, root(x)) for x in up if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in leaves], pa.int64()), pa.array([r for _, r in leaves], pa.int64())], ["a", "b"])


def _rounds(stars: DataFrame) -> DataFrame:
    """(a, b): each number of links (a, b) with the smallest that it reaches.

    A round takes the least name among neighbours, then the name of that node's own name, which halves the way to the smallest one. Minima
    are aggregated before they are shuffled; each round is saved, so that a lost executor costs one round at most, and its table goes once the next is there.
    """
    both = saved(stars.union(stars.select("b", "a")).distinct())
    names = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("c")))
    while True:
        near = both.join(names, both.b == names.node).groupBy("a").agg(F.min("c").alias("near"))
        least = saved(names.join(near, names.node == near.a).select("node", F.col("c").alias("before"), F.least("c", "near").alias("c")))
        jumped = saved(least.join(least.select(F.col("node").alias("c"), F.col("c").alias("next")), "c").select("node", "before", F.least("c", "next").alias("c")))
        dropped(names)
        dropped(least)
        names = jumped.select("node", "c")
        if jumped.where("c <> before").isEmpty():
            return names.select(F.col("node").alias("a"), F.col("c").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of any sortable type to (node, component): each linked node with the smallest one that it reaches.

    Nodes are numbered, and every task first makes stars of its own links, so that few links leave it. ONE_TASK of them or fewer are joined by one task, more
    of them in rounds over all tasks. Null ends are ignored, a self-link is a node of its own; an empty table gives an empty one.
    """
    ends = saved(links.where("a is not null and b is not null").select("a", "b"))
    nodes = saved(ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct().withColumn("id", F.monotonically_increasing_id()))
    number = lambda c: nodes.select(F.col("node").alias(c), F.col("id").alias(f"n{c}"))
    numbers = ends.where("a <> b").join(number("a"), "a").join(number("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    stars = saved(numbers.mapInArrow(_forest, "a long, b long"))
    whole = stars.coalesce(1).mapInArrow(_forest, "a long, b long") if stars.count() <= ONE_TASK else _rounds(stars)
    placed = nodes.join(whole.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    placed = saved(placed)
    # a join is no longer a saved table, so the hint is given again
    return placed.join(placed.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component").hint("merge")


def label_components(pixels: DataFrame) -> DataFrame:
    """Pixels (stack_id, frame, y, x, label) with (cy, cx), the first pixel in raster order of the 4-connected part of equal label that they are in.

    Pixels of a row are joined into runs before any link is made, so rounds see runs and not pixels. Background (label 0) has parts too.
    """
    row = W.partitionBy(*FRAME, "y", "label").orderBy("x")
    runs = pixels.select(*FRAME, "y", "x", "label", (F.col("x") - F.row_number().over(row)).alias("_g"))
    runs = runs.withColumn("run", F.struct(*FRAME, "y", F.min("x").over(W.partitionBy(*FRAME, "y", "label", "_g")).alias("x"))).drop("_g")
    below = runs.select(*FRAME, (F.col("y") - 1).alias("y"), "x", "label", F.col("run").alias("b"))
    links = runs.join(below.hint("merge"), [*FRAME, "y", "x", "label"]).select(F.col("run").alias("a"), "b").distinct()
    found = components(links).withColumnRenamed("node", "run")
    first = F.coalesce("component", "run")
    return runs.join(found, "run", "left").select(*FRAME, "y", "x", "label", first["y"].alias("cy"), first["x"].alias("cx"))
