"""Pairs within a radius: at the radius as SQL's squares decide, and by shuffles however small the files are."""

import math
import random

import pytest

from tissuelake.operators import lookups, stats
from tissuelake.plans import catalog


def _points(spark, rows):
    return spark.createDataFrame(rows, "stack_id int, frame int, cell_number int, x double, y double")


def _near_radius():
    """Differences whose squares are over 144 while their hypot is 12."""
    rng, found = random.Random(3), []
    while len(found) < 20:
        a = rng.uniform(0, math.pi / 2)
        x, y = 12 * math.cos(a), 12 * math.sin(a)
        if x * x + y * y > 144 and math.hypot(x, y) <= 12:
            found.append((x, y))
    return found


def test_squares_decide_at_the_radius(spark):
    far = _near_radius()
    rows = [(0, 0, 0, 0.0, 0.0), (0, 1, 100, 12.0, 0.0), (0, 1, 101, -12.0, 0.0), (0, 1, 102, 0.0, 0.0)] + [(0, 1, i, x, y) for i, (x, y) in enumerate(far)]
    found = {(r["a"], r["b"]): r["distance"] for r in lookups.link_candidates(_points(spark, rows), 12.0).collect()}
    assert found == {(0, 100): 12.0, (0, 101): 12.0, (0, 102): 0.0}


def test_small_files_are_not_broadcast(spark, tmp_path):
    _points(spark, [(0, i % 3, i, float(i), 2.0 * i) for i in range(60)]).write.parquet(str(tmp_path / "points"))
    found = lookups.link_candidates(spark.read.parquet(str(tmp_path / "points")), 12.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fast_rounding_is_the_twins(spark):
    rng = random.Random(5)
    values = [0.0, 0.5e-6, 12.0, 1.0000005, *(rng.uniform(0, 12) for _ in range(500))]
    rows = catalog._rounded_fast(spark.createDataFrame([(v, v) for v in values], "v double, r double"), "r").collect()
    assert [r["r"] for r in rows] == [math.floor(r["v"] * 1e6 + 0.5) / 1e6 for r in rows]


@pytest.mark.parametrize("by_frame", [True, False])
def test_autocorrelation_takes_distances_that_round_to_the_radius(spark, by_frame):
    rng, over = random.Random(8), []
    while len(over) < 8:
        a = rng.uniform(0, math.pi / 2)
        x, y = 40 * math.cos(a), 40 * math.sin(a)
        if x * x + y * y > 1600 and math.sqrt(x * x + y * y) <= 40:
            over.append((x, y))
    # one pair a frame; in the last but one the points are 40 apart by doubles and, by exact numbers, in cells with one between
    pairs = [((0.0, 0.0), p) for p in over] + [((40.0, 0.0), (-1e-17, 0.0)), ((0.0, 0.0), (40.00000000000001, 0.0))]
    rows = [(0, f, n, *at, float(n)) for f, pair in enumerate(pairs) for n, at in enumerate(pair)]
    points = spark.createDataFrame(rows, "stack_id int, frame int, particle int, x double, y double, v double")
    found = stats.autocorrelation(points, "v", 40.0, 10, by_frame).collect()
    assert [(r.bin, r.n, round(r.correlation, 9)) for r in found] == [(9, 9, -1.0)]
