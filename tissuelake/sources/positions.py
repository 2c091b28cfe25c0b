"""Stage positions as text: four header lines, then a line of 13 fields for each position. Also sizes of image stacks from their XML description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HEADER = 4
#: Names and types of the 13 fields, in order. Those named by a constant hold it in every known file.
FIELDS = {
    "position": "string", "x": "int", "y": "int", "current_z": "double", "AF_offset": "int", "starting_z": "double",
    "FALSE": "string", "-9999": "string", "TRUE_1": "string", "TRUE_2": "string", "0": "string", "-1": "string", "endline": "string",
}
#: What the constant fields hold.
CONSTANTS = {"FALSE": "FALSE", "-9999": "-9999", "TRUE_1": "TRUE", "TRUE_2": "TRUE", "0": "0", "-1": "-1", "endline": ""}


def parsed(lines: DataFrame) -> DataFrame:
    """lines(file, place, line), place from 0 in each file, to (file, place, position, x, y, ...): places begin at 0 after the header.

    Fields end at a comma and a blank; quotes around the name are taken off. A field that is missing or no number is null; empty lines are left out.
    """
    field = F.split(F.regexp_replace("line", "\r$", ""), ", ?", -1)
    values = {c: F.trim(F.get(field, F.lit(i))).alias(c) for i, c in enumerate(FIELDS)}
    values["position"] = F.regexp_replace(F.get(field, F.lit(0)), '^"|"$', "").alias("position")
    # coordinates may be written as decimals
    kept = lambda c, t: values[c].try_cast("double").cast("int").alias(c) if t == "int" else values[c].try_cast(t).alias(c)
    return lines.where((F.col("place") >= HEADER) & (F.trim("line") != "")).select("file", (F.col("place") - HEADER).alias("place"), *(kept(c, t) for c, t in FIELDS.items()))


def lines(positions: DataFrame) -> DataFrame:
    """positions(file, place, position, x, y, current_z, AF_offset, starting_z, ...) to (file, place, line), without a header. Fields that are not there take their constant, missing numbers 0; z is written to 2 places."""

    def text(c: str, t: str) -> Column:
        own = F.col(f"`{c}`") if c in positions.columns else F.lit(None)
        if c == "position":
            return F.concat(F.lit('"'), F.coalesce(own.cast("string"), F.lit("")), F.lit('"'))
        if t == "double":
            return F.format_string("%.2f", F.coalesce(own.cast("double"), F.lit(0.0)))
        return F.coalesce(own.cast(t).cast("string"), F.lit(CONSTANTS.get(c, "0")))

    return positions.select("file", "place", F.concat_ws(", ", *(text(c, t) for c, t in FIELDS.items())).alias("line"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(header(file, place, line), positions) of the files that a path names. A file is one row at first: lists of positions are short."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("place", "line"))
    return whole.where(F.col("place") < HEADER).withColumn("line", F.regexp_replace("line", "\r$", "")), parsed(whole)


def write(positions: DataFrame, header: DataFrame, path: str) -> None:
    """One text file for each `file`, in a folder file=<name>: header(file, place, line), lacking lines empty, then the positions in order of place."""
    names = positions.select("file").union(header.select("file")).distinct()
    head = names.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(HEADER - 1)))).join(header.select("file", "place", "line"), ["file", "place"], "left")
    body = lines(positions).withColumn("place", F.col("place") + HEADER)
    rows = head.withColumn("line", F.coalesce("line", F.lit(""))).unionByName(body)
    rows.repartition("file").sortWithinPartitions("file", "place").select("file", "line").write.partitionBy("file").text(path)


def tiles(positions: DataFrame, by: list[str], spacing_x: float, spacing_y: float, reorder: bool = True) -> DataFrame:
    """(by, colony, n, x, y, z): centres of tiles over the box of each four positions in a row, at their mean z.

    Tiles lie 1, 2, ... spacings from the box's least corner, ceil(size / spacing) - 1 of them a direction, row after row in order of y; with reorder
    every other row runs backwards. A box without room for a tile has none.
    """
    box = positions.groupBy(*by, F.floor(F.col("place") / 4).alias("colony")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("current_z").alias("z"))
    count = lambda c, s: (F.ceil((F.col(f"{c}1") - F.col(f"{c}0")) / s) - 1).cast("int")
    sized = box.withColumns({"nx": count("x", spacing_x), "ny": count("y", spacing_y)}).where("nx > 0 and ny > 0")
    grid = sized.withColumn("j", F.explode(F.sequence(F.lit(1), "ny"))).withColumn("i", F.explode(F.sequence(F.lit(1), "nx")))
    i = F.when((F.col("j") % 2 == 0) & F.lit(reorder), F.col("nx") + 1 - F.col("i")).otherwise(F.col("i"))
    n = (F.col("j") - 1) * F.col("nx") + F.col("i") - 1
    return grid.select(*by, "colony", n.alias("n"), (F.col("x0") + i * spacing_x).alias("x"), (F.col("y0") + F.col("j") * spacing_y).alias("y"), "z")


def sizes(texts: DataFrame, xml: str) -> DataFrame:
    """texts with (t, z, c, height, width, dimension_order) from an XML description's last image; null where it does not say, or is no XML.

    A text is parsed twice for all six (Java takes no path with as many steps), and texts are dealt over the tasks first, as parsing takes long for the size of their file.
    """
    pixels = '/*[local-name()="OME"]/*[local-name()="Image"][last()]/*[local-name()="Pixels"][last()]/@'
    number = {"t": "SizeT", "z": "SizeZ", "c": "SizeC", "height": "SizeY", "width": "SizeX"}
    names = [*number.values(), "DimensionOrder"]
    # no XML can hold the character between the values
    joined = [F.xpath_string(F.col(xml), F.lit("concat(" + ', "\x01", '.join(f"{pixels}{name}" for name in part) + ")")) for part in (names[:3], names[3:])]
    known = F.col(xml).rlike(r"(?s)^\s*<.*>\s*$")
    dealt = texts.repartition(texts.sparkSession.sparkContext.defaultParallelism * 4)
    read = dealt.withColumn("_read", F.when(known, F.concat(*(F.split(j, "\x01") for j in joined))))
    at = lambda i: F.when(F.get("_read", F.lit(i)) != "", F.get("_read", F.lit(i)))
    found = {c: at(i).try_cast("int") for i, c in enumerate(number)}
    return read.withColumns({**found, "dimension_order": at(len(number))}).drop("_read")


def subset(planes: DataFrame, picked: dict[str, list[int]]) -> DataFrame:
    """Planes of a stack for the listed indices of each dimension (columns such as t, p, z, c), numbered by their place in the list; one that is listed twice comes twice.

    Dimensions of one index stay as columns that hold 0. A dimension that is not listed stays whole; an empty list leaves nothing.
    """
    out = planes
    for c, wanted in picked.items():
        places = F.filter(F.sequence(F.lit(0), F.lit(max(len(wanted) - 1, 0))), lambda i: F.array(*(F.lit(w) for w in wanted))[i] == F.col(c)) if wanted else F.array().cast("array<int>")
        out = out.withColumn(c, F.explode(places))
    return out


def in_order(positions: DataFrame) -> DataFrame:
    """positions with `place` numbered anew from 0 in each file."""
    return positions.withColumn("place", F.row_number().over(W.partitionBy("file").orderBy("place")) - 1)
