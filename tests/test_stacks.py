"""Stage positions, descriptions of stacks, and whole stacks: round trips and plain Python."""

import math

import pytest

from tissuelake.operators import zonal
from tissuelake.plans.fixtures import view
from tissuelake.sources import positions, stacks

SF = "/root/testdata/sf0.001"


def test_positions_round_trip(spark, tmp_path):
    head = ['"Stage Memory List", Version 6.0', "0, 0, 0, 0, 0, 0, 0, \"um\", \"um\"", "0", "2"]
    text = "\n".join([*head, '"Position 1", 100, -20, 3.50, 7, 1.25, FALSE, -9999, TRUE, TRUE, 0, -1, ""', '"B, 2", 5, 6, 0.00, 0, 2.00, FALSE, -9999, TRUE, TRUE, 0, -1, ""', ""])
    text = text.replace('"B, 2"', '"B-2"')
    (tmp_path / "a.STG").write_bytes(text.replace("\n", "\r\n").encode())
    header, rows = positions.read(spark, str(tmp_path / "a.STG"))
    got = rows.orderBy("place").collect()
    assert [(r.place, r.position, r.x, r.y, r.current_z, r.AF_offset, r.starting_z, r.endline) for r in got] == [(0, "Position 1", 100, -20, 3.5, 7, 1.25, '""'), (1, "B-2", 5, 6, 0.0, 0, 2.0, '""')]
    assert [r.line for r in header.orderBy("place").collect()] == head
    name = lambda d: d.withColumn("file", positions.F.lit("a"))
    positions.write(name(rows), name(header), str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "file=a").glob("part-*")
    assert part.read_text() == text


def test_positions_of_customers(spark, tmp_path):
    table = view(spark, SF, "stg").select(positions.F.concat(positions.F.lit("f"), positions.F.pmod("place", positions.F.lit(3))).alias("file"), "place", "x", "y", "current_z")
    table = positions.in_order(table)
    positions.write(table, table.select("file", "place", positions.F.lit("h").alias("line")).where("place < 2"), str(tmp_path / "out"))
    header, back = positions.read(spark, str(tmp_path / "out/*/part-*"))
    key = lambda r: (r.x, r.y, r.current_z)
    per_file = lambda rows: sorted([key(r) for r in sorted(group, key=lambda r: r.place)] for group in rows.values())
    groups = [{}, {}]
    for out, df in zip(groups, (table, back)):
        for r in df.collect():
            out.setdefault(r.file, []).append(r)
    assert per_file(groups[0]) == per_file(groups[1]) and len(groups[1]) == 3
    assert sorted({r.line for r in header.collect()}) == ["", "h"]


def test_odd_lines(spark):
    rows = [("a", i, "head") for i in range(4)] + [("a", 4, '"p", 1.7, x, 2'), ("a", 5, "  "), ("a", 6, "")]
    (r,) = positions.parsed(spark.createDataFrame(rows, "file string, place int, line string")).collect()
    assert (r.position, r.x, r.y, r.current_z, r.endline) == ("p", 1, None, 2.0, None)


def test_sizes_and_subsets(spark):
    xml = '<?xml version="1.0"?><OME xmlns="u"><Image><Pixels DimensionOrder="XYZCT" SizeT="9" SizeZ="9" SizeC="9" SizeY="9" SizeX="9"/></Image><Image ID="1"><Pixels DimensionOrder="XYCZT" SizeT="3" SizeZ="4" SizeC="2" SizeY="48" SizeX="64"/></Image></OME>'
    rows = [(0, xml), (1, "<OME><Image><Pixels SizeT='a'/></Image></OME>"), (2, None), (3, "no xml")]
    got = {r.i: tuple(r)[2:] for r in positions.sizes(spark.createDataFrame(rows, "i int, xml string"), "xml").collect()}
    assert got == {0: (3, 4, 2, 48, 64, "XYCZT"), 1: (None,) * 6, 2: (None,) * 6, 3: (None,) * 6}
    planes = spark.createDataFrame([(t, z) for t in range(4) for z in range(3)], "t int, z int")
    planes = planes.withColumn("was", planes.t * 10 + planes.z)
    assert sorted(map(tuple, positions.subset(planes, {"t": [3, 1, 3], "z": [2]}).collect())) == [(0, 0, 32), (1, 0, 12), (2, 0, 32)]
    assert positions.subset(planes, {"t": []}).count() == 0


def test_segmentation_round_trip(spark, tmp_path):
    pixels = view(spark, SF, "pixg")
    cells = zonal.areas(pixels).withColumn("note", zonal.F.lit("n"))
    stacks.write_segmentation(str(tmp_path / "s"), pixels, cells, ["area"], ["ch0"])
    planes, kept = stacks.read_segmentation(spark, str(tmp_path / "s"))
    columns = ["stack_id", "frame", "y", "x", "label", "ch0"]
    assert sorted(planes.select(columns).collect()) == sorted(pixels.select(columns).collect())
    assert sorted(kept.select("stack_id", "frame", "label", "area").collect()) == sorted(cells.drop("note").collect()) and "note" not in kept.columns


def test_heights_in_and_out(spark, tmp_path):
    schema = "stack_id int, frame int, y int, x int, height double"
    heights = spark.createDataFrame([(0, 0, 0, 0, 1.5), (0, 0, 0, 1, None), (1, 0, 0, 0, 2.0), (1, 1, 0, 0, 3.0)], schema)
    scales = spark.createDataFrame([(0, 0, 0.5), (1, 0, 1.0), (1, 1, 1.0)], "stack_id int, frame int, z_scale double")
    stacks.write_heights(str(tmp_path / "h"), heights, scales)
    frames = spark.createDataFrame([(0, f) for f in range(3)] + [(1, 0), (1, 1)], "stack_id int, frame int")
    got, factor = stacks.read_heights(spark, str(tmp_path / "h"), frames)
    rows = sorted(((r.stack_id, r.frame, r.x, r.height) for r in got.collect()), key=str)
    assert rows == sorted([(0, f, x, (1.5, None)[x]) for f in range(3) for x in range(2)] + [(1, 0, 0, 2.0), (1, 1, 0, 3.0)], key=str)
    assert factor.count() == 5
    for wrong in ([(1, 0), (1, 1), (1, 2)], [(1, 0), (1, 5)]):
        with pytest.raises(ValueError):
            stacks.read_heights(spark, str(tmp_path / "h"), spark.createDataFrame(wrong, "stack_id int, frame int"))


def test_densities(spark):
    voxels = spark.createDataFrame([(0, 0, z, 0, x, 8192.0, 4096.0) for z in range(2) for x in range(3)], "stack_id int, frame int, z int, y int, x int, protein double, lipid double")
    heights = spark.createDataFrame([(0, 0, 0, 0, float("nan")), (0, 0, 0, 1, 2.0), (0, 0, 0, 2, None)], "stack_id int, frame int, y int, x int, height double")
    got = {(r.z, r.x): (r.protein, r.lipid) for r in stacks.densities(voxels, heights).collect()}
    assert all(got[z, 1] == (1.364256, 1.010101 / 2) and math.isnan(got[z, 0][0]) and math.isnan(got[z, 2][1]) for z in range(2))


def test_attributes(spark):
    cells = spark.createDataFrame([(0, 0, 1, 4.0, "a"), (0, 0, 2, 5.0, "b"), (0, 1, 1, 6.0, "c")], "stack_id int, frame int, label int, area double, note string")
    values = spark.createDataFrame([(0, 0, 1, 40.0, True), (0, 0, 2, None, False)], "stack_id int, frame int, label int, area double, good boolean")
    got = stacks.set_attributes(cells, values)
    assert sorted((r.frame, r.label, r.area, r.note, r.good) for r in got.collect()) == [(0, 1, 40.0, "a", True), (0, 2, None, "b", False), (1, 1, 6.0, "c", None)]
    assert stacks.scalar_attributes(got) == ["area", "good"]
    for wrong in (values.where("label = 1"), values.union(values), values.withColumn("label", values.label + 1)):
        with pytest.raises(ValueError):
            stacks.set_attributes(cells, wrong)


def test_set_along_and_histograms(spark):
    from tissuelake.operators import lookups, stats

    points = spark.createDataFrame([(0, 1, 0, 2.0), (0, 1, 1, 3.0)], "stack_id int, particle long, frame int, x double")
    values = spark.createDataFrame([(0, 1, 1, None), (0, 9, 1, 5.0)], "stack_id int, particle long, frame int, value double")
    assert sorted((r.frame, r.x) for r in lookups.set_along(points, "x", values).collect()) == [(0, 2.0), (1, None)]
    assert sorted((r.frame, r.new) for r in lookups.set_along(points, "new", values).collect()) == [(0, None), (1, None)]
    with pytest.raises(ValueError):
        lookups.set_along(points, "x", values.union(values))
    rows = spark.createDataFrame([("flat", 2.0)] * 3 + [("odd", 1.0), ("odd", float("nan")), ("none", None), (None, 4.0), (None, 5.0)], "g string, v double")
    got = {(r.g, r.bin): (r["count"], r.start, r.density) for r in stats.group_histograms(rows, ["g"], "v").collect()}
    assert got["flat", 0] == (3, 1.5, 1.0) and got["odd", 0] == (1, 0.5, 1.0) and {k for k in got if k[0] is None} == {(None, 0), (None, 1)} and len(got) == 4


def test_sizes_are_read_by_many_tasks(spark):
    from tissuelake.sources import positions

    text = '<OME><Image><Pixels SizeX="1"/></Image><Image><Pixels SizeX="7"/><Pixels DimensionOrder="{}" SizeT="{}" SizeZ="x" SizeC=""/></Image></OME>'
    rows = [(i, text.format("XY" * (i % 2), i)) for i in range(40)] + [(40, None), (41, "no")]
    got = positions.sizes(spark.createDataFrame(rows, "i int, xml string").coalesce(1), "xml")
    assert got.rdd.getNumPartitions() > 1 and got._jdf.queryExecution().executedPlan().toString().count("xpath_string") <= 2
    assert sorted(tuple(r)[:1] + tuple(r)[2:] for r in got.collect()) == [(i, i, None, None, None, None, "XY" if i % 2 else None) for i in range(40)] + [(i, *[None] * 6) for i in (40, 41)]
