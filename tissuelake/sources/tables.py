"""Tracking, velocity and division tables as CSV with fixed columns, a folder of part files each; the reader takes single files as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns by kind of table. Ids of divisions may be missing.
SCHEMAS = {
    "tracking": "cell_number int, y double, x double, frame int, particle long",
    "velocities": "cell_number int, y double, x double, frame int, particle long, dx double, dy double, dt int, v double, theta double",
    "divisions": "frame int, mother long, daughter1 long, daughter2 long, score double",
}


def read(spark: SparkSession, kind: str, path: str, stack_id: int = 0) -> DataFrame:
    """A table of one stack, by the names in its header; columns that the file has besides are left out, missing ones are null."""
    wanted = spark.createDataFrame([], SCHEMAS[kind]).schema
    found = spark.read.option("header", True).csv(path)
    columns = [(F.col(f.name) if f.name in found.columns else F.lit(None)).cast("double").cast(f.dataType).alias(f.name) for f in wanted]
    return found.select(F.lit(stack_id).alias("stack_id"), *columns)


def write(table: DataFrame, kind: str, path: str) -> None:
    """The kind's columns of a table, in their order, with a header."""
    names = [f.split()[0] for f in SCHEMAS[kind].split(", ")]
    table.select(*names).write.option("header", True).csv(path)
