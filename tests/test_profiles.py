"""Splines, the coverslip's place and height maps against plain numpy."""

import numpy as np
import pytest

from test_heights import _filled
from tissuelake.operators import profiles
from tissuelake.plans import catalog
from tissuelake.plans.fixtures import view

SF = "/root/testdata/sf0.001"
VOX = "stack_id int, frame int, z int, y int, x int, value double"


def _spline(v, at):
    """One cubic for each piece, all coefficients from one system."""
    n = len(v)
    if n < 4:
        return np.polyval(np.polyfit(np.arange(n), v, n - 1), at)
    rows, right = [], []

    def add(value, *terms):
        row = np.zeros(4 * (n - 1))
        for piece, powers in terms:
            row[4 * piece : 4 * piece + 4] = powers
        rows.append(row)
        right.append(value)

    for i in range(n - 1):
        add(v[i], (i, [1, 0, 0, 0]))
        add(v[i + 1], (i, [1, 1, 1, 1]))
    for i in range(n - 2):
        add(0, (i, [0, 1, 2, 3]), (i + 1, [0, -1, 0, 0]))
        add(0, (i, [0, 0, 2, 6]), (i + 1, [0, 0, -2, 0]))
    for i in (0, n - 3):
        add(0, (i, [0, 0, 0, 6]), (i + 1, [0, 0, 0, -6]))
    c = np.linalg.solve(np.array(rows), np.array(right, float)).reshape(n - 1, 4)
    piece = np.clip(np.floor(at).astype(int), 0, n - 2)
    t = at - piece
    return (c[piece] * np.stack([t**0, t, t**2, t**3], 1)).sum(1)


def _coverslip(v, scale, precision, prominence):
    fine = np.arange(0, len(v) * scale, precision)
    g = np.gradient(_spline(v, fine / scale), fine)
    for i in range(1, len(g) - 1):
        if g[i] > g[i - 1] and g[i] > g[i + 1]:
            lows = []
            for side in (range(i, -1, -1), range(i, len(g))):
                low = g[i]
                for j in side:
                    if g[j] > g[i]:
                        break
                    low = min(low, g[j])
                lows.append(low)
            if g[i] - max(lows) >= prominence * (g.max() - g.min()):
                return fine[i]
    return None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 11])
def test_splines(n):
    rng = np.random.default_rng(n)
    v, at = rng.normal(size=n), np.linspace(-0.5, n + 0.4, 37)
    want = np.full(37, v[0]) if n == 1 else _spline(v, at)
    np.testing.assert_allclose(profiles.spline_weights(n, at) @ v, want, atol=1e-8)


def test_first_prominent():
    assert profiles.first_prominent(np.array([0, 1, 0, 5, 5, 1, 9.0]), 2) == 3
    assert profiles.first_prominent(np.array([0, 1, 0, 5, 5, 1, 9.0]), 1) == 1
    assert profiles.first_prominent(np.array([3, 2, 1.0]), 0) == -1 and profiles.first_prominent(np.array([]), 0) == -1
    assert profiles.first_prominent(np.array([0, 4, 4.0]), 0) == -1


def test_planted_coverslips(spark):
    z = np.arange(24)
    curves = [100 / (1 + np.exp(-(z - p) * 1.5)) * np.exp(-z / 30) + np.sin(z) * noise for p, noise in ((5.3, 0), (12.6, 0.2), (17.1, 1.0))] + [np.zeros(24), np.array([2.0])]
    rows = [(i, int(k), float(v)) for i, c in enumerate(curves) for k, v in zip(z, c)] + [(0, 99, None)]
    df = spark.createDataFrame(rows, "stack_id int, z int, mean double")
    for scale, precision in ((1.0, 0.125), (0.5, 0.1)):
        got = {r.stack_id: r.coverslip for r in profiles.coverslip_z(df, ["stack_id"], scale, precision, 0.05).collect()}
        want = {i: None if i > 2 else _coverslip(c, scale, precision, 0.05) for i, c in enumerate(curves)}
        assert {i: v is None for i, v in got.items()} == {i: v is None for i, v in want.items()}
        assert all(abs(got[i] - want[i]) < 1e-9 for i in range(3)) and abs(got[0] - 5.3 * scale) < scale / 2
    assert profiles.coverslip_z(df.limit(0), ["stack_id"]).count() == 0


def _blur(a, axis, sigma):
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = a.shape[axis]
    at = np.mod(np.arange(n)[:, None] + np.arange(-reach, reach + 1), 2 * n)
    at = np.minimum(at, 2 * n - 1 - at)
    return np.moveaxis((np.moveaxis(a, axis, -1)[..., at] * (w / w.sum())).sum(-1), -1, axis)


def _heights(stack, known, prominence, sigma, z_sigma, least, reverse=False):
    """stack by z, y, x; known: pixels with values."""
    lo, hi = np.percentile(stack[:, known], [1, 99])
    v = np.where(known, (stack - lo) / (hi - lo), 0.0)
    v = v[::-1] if reverse else v
    for axis, s in ((1, sigma), (2, sigma), (0, z_sigma)):
        v = _blur(v, axis, s)
    reached = known.astype(float)
    for axis in (0, 1):
        reached = _blur(reached, axis, sigma)
    g = np.round(-np.gradient(v, axis=0), 9)
    plane = {}
    for y, x in zip(*np.nonzero(reached > 0)):
        c, last = g[:, y, x], 0
        for i in range(1, len(c) - 1):
            if c[i] > c[i - 1] and c[i] > c[i + 1] and c[i] - min(c[i - 1], c[i + 1]) >= prominence:
                last = i
        plane[y, x] = last
    out = _filled(plane, least)
    return {p: len(stack) - 1 - h if reverse and h >= 0 else h for p, h in out.items()}


def _close(got, want):
    assert {p for p in got.keys() | want.keys() if got.get(p) != want.get(p)} == set()


def test_planted_tops(spark):
    y, x = np.mgrid[:14, :18]
    tops = 5 + np.round(2 * np.sin(x / 5) + y / 6).astype(int)
    z = np.arange(16)[:, None, None]
    stack = np.where(z <= tops, 100.0, 5.0) + np.random.default_rng(2).normal(size=(16, 14, 18))
    df = spark.createDataFrame([(0, 0, int(k), int(j), int(i), float(v)) for (k, j, i), v in np.ndenumerate(stack)], VOX)
    known = np.ones((14, 18), bool)
    for reverse in (False, True):
        data = df if not reverse else df.withColumn("z", 15 - df.z)
        flipped = stack if not reverse else stack[::-1]
        got = {(r.y, r.x): r.height for r in profiles.height_map(data, 14, 18, 16, prominence=0.01, sigma=1.0, z_sigma=0.8, least=10, reverse=reverse).collect()}
        _close(got, _heights(flipped, known, 0.01, 1.0, 0.8, 10, reverse))
        truth = {p: tops[p] if not reverse else 15 - tops[p] for p in got}
        assert np.mean([abs(got[p] - truth[p]) for p in got]) < 1
    fine = {(r.y, r.x): r.height for r in profiles.height_map(df, 14, 18, 16, prominence=0.002, sigma=1.0, z_sigma=0.8, least=10, fold=4).collect()}
    padded = np.pad(stack, ((12, 12), (0, 0), (0, 0)), mode="edge").reshape(40, -1)
    dense = np.stack([_spline(c, 12 + np.arange(64) / 4) for c in padded.T], 1).reshape(64, 14, 18)
    _close(fine, {p: h / 4 for p, h in _heights(dense, known, 0.002, 1.0, 3.2, 10).items()})
    assert np.mean([abs(fine[p] - tops[p] - 0.5) for p in fine]) < 0.75
    assert profiles.height_map(df.limit(0), 14, 18, 16, sigma=1.0, least=10).count() == 0


def test_whole_queries(spark):
    stacks = {}
    for r in view(spark, SF, "stk").collect():
        stacks.setdefault(r.frame, np.full((16, 48, 64), np.nan))[r.z, r.y, r.x] = r.value
    q = catalog.queries()
    got = {r.frame: r.coverslip for r in q["e20_coverslip_z"](spark, SF).collect()}
    assert got == {f: _coverslip(np.nanmean(s, axis=(1, 2)), 0.5, 0.125, 0.01) for f, s in stacks.items()}
    got = {}
    for r in q["i05_interpolated"](spark, SF).collect():
        got.setdefault((r.frame, r.y, r.x), {})[r.z] = r.value
    assert len(got) == sum((~np.isnan(s[0])).sum() for s in stacks.values())
    for (f, y, x), values in list(got.items())[::50]:
        want = _spline(np.pad(stacks[f][:, y, x], 12, mode="edge"), 12 + np.arange(32) / 2)
        assert all(abs(values[k] - w) < 1e-5 for k, w in enumerate(want)) and len(values) == 32
    for name, reverse in (("i06_height_map", False), ("i07_coverslip_map", True)):
        got = {}
        for r in q[name](spark, SF).collect():
            got.setdefault(r.frame, {})[r.y, r.x] = r.height
        for f, s in stacks.items():
            _close(got[f], _heights(s, ~np.isnan(s[0]), 0.01, 0.8, 0.8, 12, reverse))


def _surface(stack, block, fold, sigma, z_sigma):
    depth, h, w = stack.shape
    rows, cols = -(-h // block), -(-w // block)
    small = np.array([[[np.nanmean(stack[k, i * block : (i + 1) * block, j * block : (j + 1) * block]) for j in range(cols)] for i in range(rows)] for k in range(depth)])
    fine = np.stack([_spline(c, np.arange(depth * fold) / fold) for c in small.reshape(depth, -1).T], 1).reshape(-1, rows, cols)
    for axis, s in ((1, sigma), (2, sigma), (0, z_sigma)):
        fine = _blur(fine, axis, s)
    low = np.round(np.gradient(fine, axis=0), 9).argmin(axis=0)
    y, x = np.mgrid[:rows, :cols]
    basis = lambda y, x: np.stack([x * x + y * y, x, y, np.ones_like(x)], -1)
    fit = np.linalg.lstsq(basis(y, x).reshape(-1, 4).astype(float), low.ravel().astype(float), rcond=None)[0]
    y, x = np.mgrid[:h, :w]
    return basis(y / block, x / block) @ fit / fold


def test_planted_bowl(spark):
    y, x = np.mgrid[:25, :31]
    bowl = 5 + 0.012 * ((x - 12) ** 2 + (y - 9) ** 2) + 0.05 * x
    z = np.arange(18)[:, None, None]
    stack = 100 / (1 + np.exp((z - bowl) * 2)) + np.random.default_rng(1).normal(size=(18, 25, 31))
    df = spark.createDataFrame([(0, 3, int(k), int(j), int(i), float(v)) for (k, j, i), v in np.ndenumerate(stack)], VOX)
    got = np.full((25, 31), np.nan)
    for r in profiles.fitted_surface(df, 25, 31, 18, block=5, fold=4, sigma=0.6, z_sigma=2.0).collect():
        got[r.y, r.x] = r.height
    np.testing.assert_allclose(got, _surface(stack, 5, 4, 0.6, 2.0), atol=1e-6)
    assert np.abs(got[2:-5, 2:-5] - bowl[4:-3, 4:-3]).mean() < 0.5
    assert profiles.fitted_surface(df.limit(0), 25, 31, 18, sigma=1.0).count() == 0
    few = profiles.fitted_surface(df.where("y < 5 and x < 5"), 25, 31, 18, block=5, fold=2, sigma=0.1, z_sigma=1.0).select("height").distinct().collect()
    assert [r.height for r in few] == [None]


def test_whole_query_of_surfaces(spark):
    sf, stacks, got = SF.replace("sf0.001", "sf0.01"), {}, {}
    for r in view(spark, sf, "stk").toPandas().itertuples():
        stacks.setdefault(r.frame, np.full((16, 48, 64), np.nan))[r.z, r.y, r.x] = r.value
    for r in catalog.queries()["e23_fitted_surface"](spark, sf).collect():
        got.setdefault(r.frame, {})[r.y, r.x] = r.height
    whole = [f for f, s in stacks.items() if not np.isnan(s).any()]
    assert len(whole) >= 3 and set(got) == set(stacks)
    for f in whole:
        want = _surface(stacks[f], 8, 4, 0.6, 2.0)
        assert len(got[f]) == 48 * 64 and all(abs(h - want[p]) < 1e-5 for p, h in got[f].items())


def test_columns_are_shuffled_as_arrays(spark):
    from tissuelake.operators import lookups

    df = spark.createDataFrame([(0, 0, z, y, x, float(z * y + x)) for z in range(4) for y in range(9) for x in range(10)], VOX)
    for out, exchanges in ((lookups.steepest_descent(df), 1), (profiles._along_columns(df, 9, 10, 4, 1.0, 1.0, "surface", profiles._steepest), 2)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == exchanges and "Window" not in plan and "BroadcastExchange" not in plan
    assert "Window" not in profiles.fitted_surface(df, 9, 10, 4, block=2, fold=2, sigma=1.0)._jdf.queryExecution().executedPlan().toString()


def test_steepest_descent_with_gaps_and_nulls(spark):
    from tissuelake.operators import lookups

    rng, rows, want = np.random.default_rng(5), [], {}
    for y in range(20):
        for x in range(11):
            column = [(z, None if rng.random() < 0.1 else float(rng.integers(0, 4))) for z in sorted(rng.choice(9, rng.integers(1, 8), replace=False).tolist())]
            rows += [(0, y % 2, z, y, x, v) for z, v in column]
            slopes = []
            for i, (z, v) in enumerate(column):
                before, after = (column[i - 1][1] if i else None), (column[i + 1][1] if i + 1 < len(column) else None)
                g = (after - before) / 2 if None not in (before, after) else after - v if None not in (after, v) else v - before if None not in (before, v) else -np.inf
                slopes.append((g, z))
            want[y % 2, y, x] = min(slopes)[1]
    rng.shuffle(rows)
    got = {(int(r.frame), r.y, r.x): r.surface for r in lookups.steepest_descent(spark.createDataFrame([(int(s), int(f), int(z), int(y), int(x), v) for s, f, z, y, x, v in rows], VOX).repartition(3)).collect()}
    assert got == want
    assert lookups.steepest_descent(spark.createDataFrame([], VOX)).count() == 0
