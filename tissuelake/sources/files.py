"""Stacks as lists of files: natural order, roles of files, numbering of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

_DIGITS = 20


def natural_key(path: Column) -> Column:
    """A string that sorts paths with their numbers by value: runs of up to 20 digits are padded with zeros."""
    parts = F.regexp_extract_all(path, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda t: F.when(t.rlike(r"^\d{1,20}$"), F.lpad(t, _DIGITS, "0")).otherwise(t)), "")


def _ordinal() -> Column:
    """Place in the natural order of a stack, from 0. The window holds the file names of one stack."""
    return F.row_number().over(W.partitionBy("stack_id").orderBy(natural_key(F.col("path")), "path")) - 1


def stack_frames(files: DataFrame, every: int = 1) -> DataFrame:
    """One file (stack_id, path) of each `every` of a stack, in natural order, with frames numbered from 0 after thinning."""
    placed = files.withColumn("frame", _ordinal())
    return placed.where(F.col("frame") % every == 0).withColumn("frame", (F.col("frame") / every).cast("int"))


def route(files: DataFrame) -> DataFrame:
    """Files with their kind (seg, image, tracking or null) and whether a stack uses them.

    Segmentations are used where there are any, images only where there are none, and of tracking files the last in natural order.
    """
    path = F.col("path")
    kind = F.when(path.endswith("seg.npy"), "seg").when(F.lower(path).rlike("(tif|tiff|nd2)$"), "image").when(path.endswith("tracking.csv"), "tracking")
    stacks = files.withColumn("kind", kind).withColumn("_key", F.struct(natural_key(path), path))
    found = stacks.groupBy("stack_id").agg(F.bool_or(F.coalesce(F.col("kind") == "seg", F.lit(False))).alias("_seg"), F.max(F.when(F.col("kind") == "tracking", F.col("_key"))).alias("_last"))
    used = F.when(F.col("kind") == "seg", True).when(F.col("kind") == "image", ~F.col("_seg")).when(F.col("kind") == "tracking", F.col("_key") == F.col("_last")).otherwise(False)
    return stacks.join(found, "stack_id").withColumn("used", used).drop("_key", "_seg", "_last")


def attach_images(frames: DataFrame, images: DataFrame) -> DataFrame:
    """Frames (stack_id, frame) with the image file that has the same place in its stack; null beyond the last image."""
    place = F.row_number().over(W.partitionBy("stack_id").orderBy("frame")) - 1
    return frames.withColumn("_at", place).join(images.select("stack_id", F.col("path").alias("image"), _ordinal().alias("_at")), ["stack_id", "_at"], "left").drop("_at")
