"""Round trips of tables."""

import pytest

from tissuelake.sources import tables


@pytest.mark.parametrize("kind", list(tables.SCHEMAS))
def test_round_trip(spark, tmp_path, kind):
    schema = "stack_id int, extra string, " + tables.SCHEMAS[kind]
    fields = tables.SCHEMAS[kind].split(", ")
    rows = [(0, "left out", *(float(i + j) + (0.25 if "double" in f else 0) if "double" in f else i + j for j, f in enumerate(fields))) for i in range(5)]
    rows.append((0, None, *([None] * len(fields))))
    table = spark.createDataFrame(rows, schema)
    tables.write(table, kind, str(tmp_path / kind))
    back = tables.read(spark, kind, str(tmp_path / kind))
    key = lambda r: str(r)
    assert sorted(back.collect(), key=key) == sorted(table.drop("extra").select(*back.columns).collect(), key=key)


def test_columns_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("frame,particle,cell_number,x,y,color\n0,1,2,3.5,4.5,red\n")
    assert tables.read(spark, "tracking", str(tmp_path / "t.csv"), stack_id=7).collect() == [(7, 2, 4.5, 3.5, 0, 1)]
