"""Component counts of all thresholds and the automatic threshold against labelling each threshold from scratch."""

import numpy as np
import pytest

from tissuelake.operators import thresholds
from tissuelake.plans import catalog
from tissuelake.plans.fixtures import view

SF = "/root/testdata/sf0.001"
_SIDES = ((0, 1), (1, 0), (0, -1), (-1, 0))


def _sizes(plane, threshold):
    left, out = {p for p, v in plane.items() if v > threshold}, []
    while left:
        open_, n = [left.pop()], 0
        while open_:
            y, x = open_.pop()
            n += 1
            for q in ((y + d, x + e) for d, e in _SIDES):
                if q in left:
                    left.remove(q)
                    open_.append(q)
        out.append(n)
    return out


def _sweep(plane, least):
    out, before = {}, (0, 0)
    for t in (-np.inf, *sorted(set(plane.values()))):
        sizes = _sizes(plane, t)
        now = len(sizes), sum(n > least for n in sizes)
        if now != before:
            out[t] = now
        before = now
    return out


def _best(plane, least, noise, percentiles):
    low, high = np.percentile(list(plane.values()), percentiles)
    tried = [low, *(v for v in sorted(set(plane.values())) if low < v <= high)]
    scores = [(round(sum(n > least for n in s) - noise * len(s), 9), -t) for t in tried for s in [_sizes(plane, t)]]
    score, t = max(scores)
    return -t, score


def _planes(df, value):
    out = {}
    for r in df.collect():
        out.setdefault(r.frame, {})[r.y, r.x] = float(r[value])
    return out


@pytest.mark.parametrize("strip", [1, 30, 1 << 17])
def test_every_level(spark, strip):
    rng = np.random.default_rng(8)
    noise = {(y, x): float(v) for (y, x), v in np.ndenumerate(rng.integers(0, 7, (19, 15)))}
    hills = {(y, x): float(np.round(9 * np.sin(y / 2) * np.cos(x / 3), 1)) for y in range(23) for x in range(15)}
    holes = {p: v for p, v in noise.items() if sum(p) % 7}
    planes = [noise, hills, holes, {(0, 0): 4.0}, {(y, 3): float(y) for y in range(20)}]
    rows = [(0, f, y, x, v, "kept") for f, p in enumerate(planes) for (y, x), v in p.items()] + [(0, 0, 40, 2, None, ""), (0, 1, 40, 2, float("nan"), ""), (0, 3, 0, 0, 4.0, "again")]
    df = spark.createDataFrame(rows, "stack_id int, frame int, y int, x int, ch0 double, value string")
    got = {}
    for r in thresholds.levels(df, "ch0", 3, strip, joined=2).collect():
        got.setdefault(r.frame, {})[r.level] = (r.n_parts, r.n_large)
    assert got == {f: _sweep(p, 3) for f, p in enumerate(planes)}
    assert thresholds.levels(spark.createDataFrame([], df.schema), "ch0", 3).count() == 0


def test_planted_spots(spark):
    # nuclei of two brightnesses on uneven ground, specks brighter than any of them
    ground = {(y, x): float(10 + 2 * (y % 2) * (x % 2)) for y in range(30) for x in range(30)}
    for i, (y, x) in enumerate([(4, 4), (4, 14), (4, 24), (15, 5), (15, 20)]):
        ground.update({(y + d, x + e): 60.0 + 20 * (i % 2) for d in range(4) for e in range(4)})
    ground.update({(25, x): 200.0 for x in range(0, 30, 3)})
    df = spark.createDataFrame([(0, 0, y, x, v) for (y, x), v in ground.items()], "stack_id int, frame int, y int, x int, ch0 double")
    (row,) = thresholds.automatic(df, "ch0", 10, percentiles=(0, 100), strip=60).collect()
    assert (row.threshold, row.score) == _best(ground, 10, 0.02, (0, 100)) and 12 <= row.threshold < 60 and row.score == round(5 - 0.02 * 15, 9)


def test_whole_query(spark):
    planes = _planes(view(spark, SF, "pix"), "ch0")
    got = {r.frame: (round(r.threshold, 6), r.score) for r in catalog.queries()["d20_automatic_threshold"](spark, SF).collect()}
    want = {f: _best(p, 12, 0.02, (5, 95)) for f, p in planes.items()}
    assert got == {f: (round(t, 6), s) for f, (t, s) in want.items()}
