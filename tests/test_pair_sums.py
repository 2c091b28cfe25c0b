"""Sums over pairs within a radius by bin of distance, against all pairs one by one."""

import numpy as np
import pytest

from tissuelake.operators import pair_sums, stats


def _one_by_one(left, right, radius, bins):
    sums = np.zeros((bins, left[2].shape[1]))
    for x, y, v in zip(*left, strict=True):
        dx, dy = x - right[0], y - right[1]
        d = np.sqrt(dx * dx + dy * dy)
        near = d <= radius
        at = np.minimum(np.floor(d[near] / (radius / bins)), bins - 1).astype(int)
        for c in range(len(v)):
            sums[:, c] += np.bincount(at, v[c] * right[2][near, c], bins)
    return sums


def _points(kind, n, rng):
    x, y = np.round(rng.exponential(50, n), 2), rng.uniform(0, 150, n)
    if kind == "lines":
        y = np.floor(y)
    if kind == "lattice":  # many distances at a bin's edge
        x, y = np.floor(x / 4) * 4, np.floor(y / 3) * 3
    if kind == "one line":
        y[:] = 3.0
    if kind == "crowd":
        x[::2], y[::2] = 5 + rng.normal(0, 1e-3, len(x[::2])), 7 + rng.normal(0, 1e-3, len(x[::2]))
    if kind == "tiny":
        x, y = x * 1e-9, y * 1e-9
    return x, y, np.column_stack([rng.integers(1, 4, n), rng.integers(0, 2, n), rng.normal(size=n)]).astype(float)


@pytest.mark.parametrize("few", [pair_sums.FEW, 0])
@pytest.mark.parametrize("kind", ["anywhere", "lines", "lattice", "one line", "crowd", "tiny"])
def test_sums_are_those_of_all_pairs(monkeypatch, kind, few):
    monkeypatch.setattr(pair_sums, "FEW", few)
    monkeypatch.setattr(pair_sums, "PAIRS_AT_ONCE", 500)
    rng = np.random.default_rng(4)
    for n in (0, 1, 60, 900):
        right = _points(kind, n, rng)
        left = tuple(a[: n // 2] for a in right)
        for got, other in ((pair_sums.sums_by_bin(left, right, 40.0, 10), left), (pair_sums.sums_by_bin(right, None, 40.0, 10), right)):
            expected = _one_by_one(other, right, 40.0, 10)
            assert (got[:, :2] == expected[:, :2]).all() and np.allclose(got, expected)


@pytest.mark.parametrize(("tile", "most"), [(4096, 1 << 17), (1, 1 << 17), (1, 15)])
def test_tiles_and_their_parts_meet_each_pair_once(spark, monkeypatch, tile, most):
    monkeypatch.setattr(pair_sums, "TILE", tile)
    monkeypatch.setattr(pair_sums, "MOST", most)
    rng = np.random.default_rng(6)
    rows = [(0, f, float(np.round(rng.uniform(-60, 60), 1)), float(rng.integers(-60, 60)), None if rng.random() < 0.1 else float(rng.integers(0, 3))) for f in range(3) for _ in range(200)]
    rows += [*rows[:20], (0, 0, None, 1.0, 1.0), (0, 0, float("nan"), 1.0, 1.0), (0, 0, float("nan"), 1.0, 1.0), (0, 0, float("inf"), 1.0, 1.0), (0, 0, float("inf"), 1.0, 1.0), (1, 7, 0.0, 0.0, 1.0), (1, 7, 0.0, 0.0, 1.0)]
    points = spark.createDataFrame(rows, "stack_id int, frame int, x double, y double, c double")
    got = {(r.stack_id, r.bin): (r.n, r.m, r.p, r.pp) for r in pair_sums.pair_sums(points, ["stack_id", "frame"], 20.0, 5).collect()}
    expected = {(1, 0): (1, 1, 1.0, 1.0)}
    for f in range(3):
        own = [r for r in rows if r[:2] == (0, f) and r[2] is not None and np.isfinite(r[2])]
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                dx, dy = a[2] - b[2], a[3] - b[3]
                d = np.sqrt(dx * dx + dy * dy)
                if d <= 20.0:
                    p = None if None in (a[4], b[4]) else a[4] * b[4]
                    before = expected.get((0, min(int(d / 4.0), 4)), (0, 0, 0.0, 0.0))
                    expected[0, min(int(d / 4.0), 4)] = tuple(s + t for s, t in zip(before, (1, 0, 0, 0) if p is None else (1, 1, p, p * p), strict=True))
    assert got == expected


def test_a_dense_frame_has_no_row_for_each_pair(spark):
    # 1.1e10 pairs, of different places all: a row for each would not end here
    points = spark.range(150_000).selectExpr("0 AS stack_id", "0 AS frame", "id AS particle", "id % 1000 / 50D AS x", "CAST(id div 1000 AS DOUBLE) / 10 AS y", "id % 2 AS v")
    got = stats.autocorrelation(points, "v", 40.0, 10).collect()
    assert sum(r.n for r in got) == 150_000 * 149_999 // 2


def test_no_task_gets_a_whole_stack(spark, monkeypatch):
    plans, real = [], stats.saved
    monkeypatch.setattr(stats, "saved", lambda table: [plans.append(table._jdf.queryExecution().executedPlan().toString()), real(table)][1])
    points = spark.range(300).selectExpr("id % 2 AS stack_id", "id % 3 AS frame", "id AS particle", "id / 10D AS x", "0D AS y", "id % 5 AS v")
    assert stats.autocorrelation(points, "v", 2.0, 4, by_frame=False).count() == 6
    assert any("BroadcastHashJoin" in p for p in plans) and not any("SortMergeJoin" in p for p in plans)


def test_whole_numbers_do_not_overflow(spark):
    points = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 0, 100_000, 0, 1.0), (0, 0, 0, 65_536, 1.0)], "stack_id int, frame int, x int, y int, c double")
    got = {r.bin: r.n for r in pair_sums.pair_sums(points, ["stack_id", "frame"], 100_000.0, 10).collect()}
    assert got == {6: 1, 9: 1}
