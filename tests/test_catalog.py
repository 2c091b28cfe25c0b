"""Every query of the library's own operators against its SQL twin at sf0.001."""

import duckdb
import pandas as pd
import pytest

from tissuelake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    text = lambda d: d[columns].map(lambda v: "" if v is None or v != v else f"{float(v):.5f}" if not isinstance(v, str) else v)
    rows = lambda d: sorted(map(tuple, text(d).to_numpy().tolist()))
    assert rows(a) == rows(b)


@pytest.mark.parametrize("name", list(catalog.CATALOG))
def test_matches_sql(spark, db, name):
    same(catalog.queries()[name](spark, SF).toPandas(), db.sql(catalog.oracle_sql()[name]).df())


def test_four_quarter_turns_are_none(spark):
    from tissuelake.operators.zonal import rotate

    pixels = spark.createDataFrame([(0, 0, y, x, y * 3 + x) for y in range(2) for x in range(3)], "stack_id int, frame int, y int, x int, label int")
    turned, h, w = pixels, 2, 3
    for _ in range(4):
        turned, h, w = rotate(turned, h, w, 1), w, h
    assert sorted(turned.select("y", "x", "label").collect()) == sorted(pixels.select("y", "x", "label").collect())


def test_start_before_g1_is_g1(spark):
    from tissuelake.operators.stages import daughter_g1

    rows = [(0, p, f, s) for p, track in enumerate(([2, 3, 3, 2, 1, 1], [3, 3, 3, 1], [3, 3, 3, 3, 0, 1])) for f, s in enumerate(track)]
    fixed = daughter_g1(spark.createDataFrame(rows, "stack_id int, particle int, frame int, cycle_stage int")).orderBy("particle", "frame").collect()
    assert [r.cycle_stage for r in fixed] == [1, 1, 1, 1, 1, 1, 3, 3, 3, 1, 3, 3, 3, 3, 0, 1]
