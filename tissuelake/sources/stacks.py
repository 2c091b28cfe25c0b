"""Whole stacks in and out: planes with chosen cell attributes, heights, and density volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lookups import NORI_COUNTS, NORI_LIPID, NORI_PROTEIN

FRAME = ["stack_id", "frame"]


def write_segmentation(path: str, pixels: DataFrame, cells: DataFrame, attributes: list[str] | None = None, channels: list[str] | None = None) -> None:
    """Planes (labels, and channels of the image where they are named) and cells (stack_id, frame, label and the listed attributes, else all), a folder for each frame."""
    planes = pixels.select(*FRAME, "y", "x", "label", *(channels or []))
    kept = cells if attributes is None else cells.select(*FRAME, "label", *attributes)
    for name, table in (("planes", planes), ("cells", kept)):
        table.write.partitionBy(*FRAME).parquet(f"{path}/{name}")


def read_segmentation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, cells) as write_segmentation left them."""
    planes, cells = (spark.read.parquet(f"{path}/{name}") for name in ("planes", "cells"))
    return planes, cells


def write_heights(path: str, heights: DataFrame, scales: DataFrame) -> None:
    """heights(stack_id, frame, y, x, height, ...) and scales(stack_id, frame, z_scale, ...), such as the coverslip's height."""
    heights.write.partitionBy("stack_id").parquet(f"{path}/heights")
    scales.write.parquet(f"{path}/scales")


def read_heights(spark: SparkSession, path: str, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heights, scales) for frames(stack_id, frame): a stack with one plane has it in each of its frames, else it needs a plane for each; other numbers are an error."""
    heights, scales = spark.read.parquet(f"{path}/heights"), spark.read.parquet(f"{path}/scales")
    wanted = frames.select(*FRAME).distinct()
    out = []
    for table in (heights, scales):
        planes = table.select(*FRAME).distinct()
        found = planes.groupBy("stack_id").agg(F.count("*").alias("n"), F.min("frame").alias("_only"))
        met = wanted.join(planes.withColumn("_has", F.lit(1)), FRAME, "left").groupBy("stack_id").agg(F.count("*").alias("frames"), F.count("_has").alias("met"))
        wrong = met.join(found, "stack_id").where("n <> 1 and (n <> frames or met <> n)").limit(5).collect()
        if wrong:
            raise ValueError(f"stacks whose planes do not fit their frames: {[r.stack_id for r in wrong]}")
        single = table.join(found.where("n = 1").select("stack_id"), "stack_id", "left_semi").drop("frame").join(wanted, "stack_id")
        several = table.join(found.where("n > 1").select("stack_id"), "stack_id", "left_semi")
        out.append(several.unionByName(single.select(*several.columns)))
    return out[0], out[1]


def densities(voxels: DataFrame, heights: DataFrame | None = None) -> DataFrame:
    """voxels(stack_id, frame, z, y, x, protein, lipid) as densities; NaN in columns whose height in heights(stack_id, frame, y, x, height) is NaN or null."""
    out = voxels.withColumns({"protein": F.col("protein") / NORI_COUNTS * NORI_PROTEIN, "lipid": F.col("lipid") / NORI_COUNTS * NORI_LIPID})
    if heights is None:
        return out
    key = [*FRAME, "y", "x"]
    empty = heights.where(F.col("height").isNull() | F.isnan(F.col("height").cast("double"))).select(*key, F.lit(True).alias("_empty")).distinct()
    joined, nan = out.join(empty, key, "left"), F.lit(float("nan"))
    return joined.withColumns({c: F.when(F.col("_empty"), nan).otherwise(F.col(c)) for c in ("protein", "lipid")}).select(*voxels.columns)


def set_attributes(cells: DataFrame, values: DataFrame) -> DataFrame:
    """cells(stack_id, frame, label, ...) with the columns of values(stack_id, frame, label, ...), in place of columns of the same name.

    Every cell of a frame that values name needs one row there, as many as there are cells; else it is an error. Frames that values do not name keep
    what they have, or null.
    """
    key = [*FRAME, "label"]
    names = [c for c in values.columns if c not in key]
    counted = values.groupBy(*key).agg(F.count("*").alias("given")).join(cells.select(*key, F.lit(1).alias("own")), key, "full").join(values.select(*FRAME).distinct(), FRAME, "left_semi")
    wrong = counted.where("given is null or given <> 1 or own is null").select(*FRAME).distinct().limit(5).collect()
    if wrong:
        raise ValueError(f"numbers of values and cells differ in frames {[tuple(r) for r in wrong]}")
    given = values.select(*key, F.struct(*names).alias("_given"))
    joined = cells.join(given, key, "left")
    new = {c: F.when(F.col("_given").isNotNull(), F.col(f"_given.{c}")).otherwise(F.col(c) if c in cells.columns else F.lit(None)) for c in names}
    return joined.withColumns(new).drop("_given")


def scalar_attributes(cells: DataFrame) -> list[str]:
    """Names of columns that hold a number or a truth value for each cell, other than its key."""
    return [f.name for f in cells.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in (*FRAME, "label", "cell_number")]
