"""Contours, filled outlines, ellipses, links of points and colours against plain Python."""

import math
import random
from itertools import combinations, permutations

import numpy as np
import pytest

from tissuelake.operators import contours, divisions, linking, networks
from tissuelake.plans import catalog
from tissuelake.plans.fixtures import view

SF = "/root/testdata/sf0.001"
_PIXELS = "stack_id int, frame int, y int, x int, label int"
_OUT, _ON, _OVER = [(0, -1), (1, 0), (0, 1), (-1, 0)], [(1, 0), (0, 1), (-1, 0), (0, -1)], [(1, -1), (1, 1), (-1, 1), (-1, -1)]


def _contours(own):
    """Outer contours of a set of (y, x), walked along pixel sides."""
    seen, out = set(), []
    add = lambda p, d: (p[0] + d[0], p[1] + d[1])
    for pixel in sorted(own):
        for side in range(4):
            at, walk = (pixel, side), []
            if add(pixel, _OUT[side]) in own:
                continue
            while at not in seen:
                seen.add(at)
                walk.append(at)
                p, k = at
                at = (add(p, _OVER[k]), (k + 3) % 4) if add(p, _OVER[k]) in own else (add(p, _ON[k]), k) if add(p, _ON[k]) in own else (p, (k + 1) % 4)
            if sum({0: -p[1], 2: p[1] + 1}.get(k, 0) for p, k in walk) > 0:
                points = [p for i, (p, _) in enumerate(walk) if i == 0 or walk[i - 1][0] != p]
                out.append(points[:-1] if len(points) > 1 and points[-1] == points[0] else points)
    return out


def _planes():
    rng = np.random.default_rng(1)
    ring = np.zeros((10, 10), int)
    ring[1:8, 1:8], ring[3:5, 3:5], ring[9, 9], ring[8, 0:4] = 1, 0, 2, 3
    return [rng.integers(0, 3, (9, 11)), ring, (rng.random((12, 12)) > 0.45).astype(int), np.zeros((3, 3), int)]


def _by_cell(rows):
    out = {}
    for r in rows:
        out.setdefault((r.frame, r.label), []).append((r.k, (r.y, r.x)))
    return {c: [p for _, p in sorted(v)] for c, v in out.items()}


def test_contours_are_a_tracers(spark):
    planes = _planes()
    rows = [(0, f, y, x, int(p[y, x])) for f, p in enumerate(planes) for y in range(p.shape[0]) for x in range(p.shape[1])]
    rows += [(1, 0, y, x, 5) for y, x in [(7, 7), (0, 3), (1, 2), (1, 4), (2, 3)]]  # a table of cells alone, with a hole and a speck
    got = contours.contours(spark.createDataFrame(rows, _PIXELS), least=2)
    expected = {}
    for f, p in enumerate(planes):
        for label in set(p.ravel().tolist()) - {0}:
            best = max(_contours({(y, x) for y, x in zip(*np.nonzero(p == label), strict=True)}), key=lambda c: (len(c), -c[0][0], -c[0][1]))
            if len(best) >= 2:
                expected[f, label] = best
    assert _by_cell(got.where("stack_id = 0").collect()) == expected
    assert _by_cell(got.where("stack_id = 1").collect()) == {(0, 5): [(0, 3), (1, 2), (2, 3), (1, 4)]}
    assert contours.contours(spark.createDataFrame([], _PIXELS)).count() == 0


def test_contours_of_the_fixture_and_their_filling(spark):
    pixels = view(spark, SF, "pixg")
    own = {}
    for r in pixels.where("label <> 0").collect():
        own.setdefault((r.frame, r.label), set()).add((r.y, r.x))
    found = catalog.queries()["i01_contours"](spark, SF)
    expected = {c: max(_contours(p), key=lambda q: (len(q), -q[0][0], -q[0][1])) for c, p in own.items()}
    assert _by_cell(found.collect()) == {c: p for c, p in expected.items() if len(p) >= 5}
    # a filled contour is its part of the cell without holes
    from pyspark.sql import functions as F

    filled = contours.fill(found.select(F.lit(0).alias("stack_id"), "frame", "label", "k", F.col("y").alias("py"), F.col("x").alias("px")))
    got = {}
    for r in filled.collect():
        got.setdefault((r.frame, r.label), set()).add((r.y, r.x))
    for c, p in got.items():
        edge = set(expected[c])
        assert edge <= p
        inside = p - edge
        part = {q for q in own[c] if q in p}
        holes = inside - own[c]
        assert part | holes == p and all((y + d, x + e) in p for y, x in holes for d, e in _OUT)
        assert len(_contours(own[c])) > 1 or own[c] <= p


def test_outlines_that_cross_themselves(spark):
    star = [(round(9 * math.sin(4 * math.pi * i / 5), 3), round(9 * math.cos(4 * math.pi * i / 5), 3)) for i in range(5)]
    shapes = {1: star, 2: [(0, 0), (6, 6), (0, 6), (6, 0)], 3: [(2, 3)], 4: [(1, 1), (1, 5)], 5: [(0.5, 0.5), (0.5, 3.5), (3.5, 3.5), (3.5, 0.5)]}
    rows = [(0, 0, label, k, float(y), float(x)) for label, s in shapes.items() for k, (y, x) in enumerate(s)]
    got = {}
    for r in contours.fill(spark.createDataFrame(rows, "stack_id int, frame int, label int, k int, py double, px double")).collect():
        got.setdefault(r.label, set()).add((r.y, r.x))

    def inside(s, y, x):
        turns = 0
        for (ay, ax), (by, bx) in zip(s, s[1:] + s[:1], strict=True):
            side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if abs(side) < 1e-9 and min(ay, by) <= y <= max(ay, by) and min(ax, bx) <= x <= max(ax, bx):
                return True
            turns += (ay <= y < by) * (side < 0) - (by <= y < ay) * (side > 0)
        return turns != 0

    for label, s in shapes.items():
        assert got.get(label, set()) == {(y, x) for y in range(-10, 11) for x in range(-10, 11) if inside(s, y, x)}, label


def test_ellipses(spark):
    planted = [(9, 4, 0.3), (12, 3, 2.5), (7, 6.5, 1.6), (8, 2, 0.0)]
    turn = lambda i, a, b, t, u: (i * 1000 + a * math.cos(u) * math.cos(t) - b * math.sin(u) * math.sin(t), a * math.cos(u) * math.sin(t) + b * math.sin(u) * math.cos(t) - 7)
    rows = [(0, 0, i, *turn(i, a, b, t, k / 3)) for i, (a, b, t) in enumerate(planted) for k in range(19)] + [(0, 0, 9, float(k), 2.0 * k) for k in range(6)] + [(0, 0, 8, 1.0, 1.0)]
    got = {r.label: r for r in contours.ellipses(spark.createDataFrame(rows, "stack_id int, frame int, label int, x double, y double")).collect()}
    for i, (a, b, t) in enumerate(planted):
        r = got[i]
        assert np.allclose([r.cx, r.cy, r.major, r.minor, r.aspect], [i * 1000, -7, a, b, a / b]) and abs(math.sin(r.theta - t)) < 1e-6 and 0 <= r.theta < math.pi
    assert got[8].aspect is None and got[9].aspect is None
    # contours of cells: no conic with 4ac - b^2 = 1 is nearer
    found = catalog.queries()["d13_ellipses"](spark, SF).collect()
    assert found and all(r.aspect >= 1 and r.minor <= r.major for r in found if r.aspect is not None)


def _least(cost, rows, columns, out):
    best = None
    for n in range(min(rows, columns) + 1):
        for some in combinations(range(rows), n):
            for others in permutations(range(columns), n):
                if all((i, j) in cost for i, j in zip(some, others, strict=True)):
                    total = sum(cost[i, j] for i, j in zip(some, others, strict=True)) + (rows - n) * out
                    best = total if best is None else min(best, total)
    return best


def test_assignment_is_cheapest():
    rng = random.Random(1)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        cost = {(i, j): rng.choice([rng.random(), 0.5, 1.0]) for i in range(n) for j in range(m) if rng.random() < 0.7}
        gain = np.full((n, m), np.nan)
        for (i, j), c in cost.items():
            gain[i, j] = 1 - c
        won = linking.assign(gain)
        assert len({i for i, _ in won}) == len({j for _, j in won}) == len(won) and all(p in cost for p in won)
        assert abs(sum(cost[p] for p in won) + (n - len(won)) - _least(cost, n, m, 1.0)) < 1e-6


_POINTS = "stack_id int, frame int, cell_number int, x double, y double"


def _sequential(points, radius, memory):
    """Links frame by frame with lost points carried along; cheapest over whole frames by brute force."""
    links, lost = [], {}
    for f in range(max(p[0] for p in points) + 1):
        now = [p for p in points if p[0] == f]
        old = sorted(lost)
        near = {(i, j): (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 for i, a in enumerate(old) for j, b in enumerate(now) if math.hypot(a[2] - b[2], a[3] - b[3]) < radius}
        gain = np.full((len(old), max(1, len(now))), np.nan)
        for k, c in near.items():
            gain[k] = radius**2 - c
        won = linking.assign(gain) if old else []
        for i, j in won:
            links.append((old[i][:2], now[j][:2]))
            del lost[old[i]]
        lost = {p: 1 for p in lost if p[0] >= f - memory}
        lost.update({p: 1 for p in now})
    return set(links)


@pytest.mark.parametrize("memory", [0, 2])
def test_links_are_those_of_frame_after_frame(spark, memory):
    rng = random.Random(7)
    points = [(f, c, 10 * c + rng.gauss(0, 4), rng.gauss(0, 4)) for f in range(7) for c in range(8) if rng.random() < 0.75]
    rows = [(s, *p) for s in (0, 3) for p in points] + [(0, 2, 90, None, 1.0), (0, 2, 91, float("nan"), 1.0)]
    got = linking.link(spark.createDataFrame(rows, _POINTS), 9.0, memory, most=50).collect()
    assert len(got) == 2 * len(points)
    for s in (0, 3):
        tracks = {}
        for r in sorted((r for r in got if r.stack_id == s), key=lambda r: r.frame):
            tracks.setdefault(r.particle, []).append((r.frame, r.cell_number))
        assert {(a, b) for t in tracks.values() for a, b in zip(t, t[1:], strict=False)} == _sequential(points, 9.0, memory)
        assert sorted(tracks) == list(range(len(tracks))) and [tracks[i][0] for i in sorted(tracks)] == sorted(t[0] for t in tracks.values())
        assert all(len({f for f, _ in t}) == len(t) for t in tracks.values())


def test_crowds_shrink_their_radius_or_are_an_error(spark):
    rows = [(0, f, c, 3.0 * c + f, 0.0) for f in range(2) for c in range(40)]
    points = spark.createDataFrame(rows, _POINTS)
    with pytest.raises(ValueError, match="compete"):
        linking.link(points, 4.5, most=10).count()
    got = linking.link(points, 4.5, most=10, step=0.8, stop=1.1).collect()
    assert sorted((r.particle, r.frame, r.cell_number) for r in got) == sorted((c, f, c) for f in range(2) for c in range(40))
    assert linking.link(spark.createDataFrame([], _POINTS), 3.0).count() == 0


def test_two_passes_recover_a_planted_drift(spark):
    rng = random.Random(3)
    place = {c: (rng.uniform(0, 300), rng.uniform(0, 300)) for c in range(40)}
    rows = [(0, f, c, x + 2.5 * f + rng.gauss(0, 0.2), y - 1.5 * f + rng.gauss(0, 0.2)) for f in range(8) for c, (x, y) in place.items()]
    points = spark.createDataFrame(rows, _POINTS)
    with_drift = linking.track(points, 4.0, 1.5, least=3).collect()
    assert sorted((r.particle, r.frame, r.cell_number, round(r.x, 6)) for r in with_drift) == sorted((c, f, c, round(x, 6)) for _, f, c, x, _ in rows)
    still = linking.track(points, 4.0, keep_drift=False).collect()
    assert max(abs(r.x - place[r.cell_number][0]) + abs(r.y - place[r.cell_number][1]) for r in still) < 2.0


def _greedy(nodes, links):
    near = {n: {b if a == n else a for a, b in links if n in (a, b) and a != b} for n in nodes}
    out = {}
    for n in sorted(nodes, key=lambda n: (-len(near[n]), n)):
        taken = {out[m] for m in near[n] if m in out}
        out[n] = next(c for c in range(len(nodes)) if c not in taken)
    return out


def test_colours_are_the_greedy_ones(spark):
    rng = random.Random(2)
    links = [(rng.randrange(30), rng.randrange(30)) for _ in range(90)] + [(3, 3), (None, 4), (5, None)]
    nodes = spark.createDataFrame([(0, i) for i in range(32)], "stack_id int, id int")
    got = networks.colours(nodes, spark.createDataFrame([(0, *p) for p in links], "stack_id int, a int, b int"), ["stack_id"]).collect()
    assert {r.id: r.colour for r in got} == _greedy(range(32), {p for p in links if None not in p})
    pairs = {}
    for r in catalog.queries()["c09_adjacency"](spark, SF).collect():
        pairs.setdefault(r.frame, set()).add((r.a, r.b))
    found = {}
    for r in catalog.queries()["h15_colours"](spark, SF).collect():
        found.setdefault(r.frame, {})[r.id] = r.colour
    assert found == {f: _greedy(sorted(c), pairs.get(f, set())) for f, c in found.items()}


def test_heaviest_without_conflicts():
    rng = random.Random(5)
    for _ in range(150):
        options = [[(rng.choice([1.0, 2.0, rng.random() * 3]), frozenset(rng.sample(range(7), 2))) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 5))]
        flat = [(i, k) for i, o in enumerate(options) for k in range(len(o))]
        clash = lambda p, q: p[0] == q[0] or options[p[0]][p[1]][1] & options[q[0]][q[1]][1]
        free = [c for n in range(len(flat) + 1) for c in combinations(flat, n) if not any(clash(p, q) for p, q in combinations(c, 2))]
        weight = lambda c: sum(options[i][k][0] for i, k in c)
        won = networks.heaviest(options)
        assert tuple(sorted(won)) in {tuple(sorted(c)) for c in free} and abs(weight(won) - max(map(weight, free))) < 1e-9


def test_sixty_mothers_in_a_row(spark):
    """Each mother shares two daughters with the next."""
    rows = [(0, m, 1000 + 2 * m + a, 1000 + 2 * m + b, (m * 7 + a * 3 + b) % 10 / 10) for m in range(60) for a, b in combinations(range(4), 2)]
    import time

    options = [[(2 - r[4], frozenset(r[2:4])) for r in rows if r[1] == m] for m in range(60)]
    began = time.time()
    won = networks.heaviest(options)
    assert time.time() - began < 2 and len({m for m, _ in won}) == len(won) == 60
    chosen = divisions.choose(spark.createDataFrame(rows, "stack_id int, mother int, daughter1 int, daughter2 int, score double")).collect()
    assert abs(sum(1.9 - r.score for r in chosen) - sum(options[m][k][0] - 0.1 for m, k in won)) < 1e-6
    assert len({d for r in chosen for d in (r.daughter1, r.daughter2)}) == 2 * len(chosen)


def test_densities_need_no_exchange_by_group(spark):
    from tissuelake.operators import stats

    rows = spark.createDataFrame([(g, float(v % 50)) for g in ("a", "b", None) for v in range(300)], "g string, v double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = stats.kernel_density(rows, ["g"], "v", 5, 0.0, 49.0)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # values are summed at all points in their task, before they are shuffled
    assert "SortMergeJoin" not in plan and plan.index("Generate") < plan.index("BroadcastHashJoin") and out.count() == 15


def test_exact_quantiles_of_skewed_values(spark):
    from tissuelake.operators import stats

    rng = np.random.default_rng(3)
    for values in ([*rng.normal(size=3000), 1e300, -1e300], [1.0] * 900 + [2.0, 3.0], [5.0], [1.0, 2.0], list(range(1, 8)), [None, 4.0, 8.0]):
        rows = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
        known = [v for v in values if v is not None]
        np.testing.assert_allclose(stats.quantiles(rows, "v", [0.25, 0.75]), np.percentile(known, [25, 75]), rtol=1e-12)
        plan = stats.histogram(rows, "v")._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan
    assert stats.quantiles(rows.limit(0), "v", [0.5]) is None and stats.histogram(rows.limit(0), "v").count() == 0
