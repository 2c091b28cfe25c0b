"""Specks of height planes and gaps between cells against a plain flood fill."""

import numpy as np

from tissuelake.operators import heights, planes
from tissuelake.plans import catalog
from tissuelake.plans.fixtures import view

SF = "/root/testdata/sf0.001"
_SIDES = ((0, 1), (1, 0), (0, -1), (-1, 0))


def _flood(places, near):
    seen, out = set(), []
    for p in sorted(places):
        if p not in seen:
            part, open_ = {p}, [p]
            while open_:
                y, x = open_.pop()
                for q in ((y + d, x + e) for d, e in _SIDES):
                    if q in places and q not in part and near((y, x), q):
                        part.add(q)
                        open_.append(q)
            seen |= part
            out.append(part)
    return out


def _filled(plane, least):
    small = {p for part in _flood(plane, lambda p, q: abs(plane[p] - plane[q]) <= 1) if len(part) < least for p in part}
    out = dict(plane)
    for part in _flood(small, lambda p, q: True):
        ring = {(y + d, x + e) for y, x in part for d, e in _SIDES} - part
        values = [plane[q] for q in ring if q in plane]
        out.update({p: int(np.mean(values)) if values else -1 for p in part})
    return out


def test_planted_steps_and_specks(spark):
    slope = {(y, x): y // 3 + x // 4 for y in range(12) for x in range(16)}
    speck = {**slope, (4, 4): 30, (4, 5): 31, (5, 5): 29, (0, 0): 50, (11, 15): 0, (8, 8): 40}
    del speck[8, 9]
    step = {(y, x): 0 if x < 8 else 9 for y in range(10) for x in range(16)}
    planes = [speck, step, {(0, 0): 3, (0, 1): 4}]
    rows = [(0, f, y, x, h) for f, p in enumerate(planes) for (y, x), h in p.items()] + [(0, 0, 20, 20, None)]
    df = spark.createDataFrame(rows, "stack_id int, frame int, y int, x int, height int")
    got = {}
    for r in heights.without_outliers(df, 10).collect():
        got.setdefault(r.frame, {})[r.y, r.x] = r.height
    assert got == {f: _filled(p, 10) for f, p in enumerate(planes)}
    assert got[1] == step and got[2] == {(0, 0): -1, (0, 1): -1} and got[0][4, 4] < 5
    assert heights.without_outliers(spark.createDataFrame([], df.schema)).count() == 0


def test_whole_query(spark):
    planes = {}
    for r in view(spark, SF, "pix").collect():
        planes.setdefault(r.frame, {})[r.y, r.x] = int(r.ch0 // 60)
    got = {}
    for r in catalog.queries()["h03_height_outliers"](spark, SF).collect():
        got.setdefault(r.frame, {})[r.y, r.x] = r.height
    assert got == {f: _filled(p, 12) for f, p in planes.items()}


def _mended(plane, largest=None):
    if largest is None:
        sizes = [list(plane.values()).count(label) for label in set(plane.values()) - {0}]
        largest = sum(sizes) / len(sizes) / 2 if sizes else 0
    gaps = {p for part in _flood({p for p, v in plane.items() if v == 0}, lambda p, q: True) if len(part) < largest for p in part}
    rest = sorted(set(plane) - gaps)
    near = lambda p: min(rest, key=lambda q: ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, q))
    return {p: plane[near(p)] if p in gaps and rest else v for p, v in plane.items()}


def test_gaps_are_mended(spark):
    rng = np.random.default_rng(4)
    noise = {(y, x): int(v) for (y, x), v in np.ndenumerate(rng.integers(0, 4, (11, 13)))}
    wide = {(y, x): 0 if 3 <= y < 8 and 3 <= x < 8 or x == 12 else 1 + (x > 6) for y in range(11) for x in range(13)}
    planes_ = [noise, wide, {(0, 0): 0, (0, 1): 0}]
    rows = [(0, f, y, x, v, "kept") for f, p in enumerate(planes_) for (y, x), v in p.items()]
    df = spark.createDataFrame(rows, "stack_id int, frame int, y int, x int, label int, note string")
    for largest in (6, 20):
        got = {}
        for r in planes.mend_gaps(df, largest).collect():
            assert r.note == "kept"
            got.setdefault(r.frame, {})[r.y, r.x] = r.label
        assert got == {f: _mended(p, largest) for f, p in enumerate(planes_)}
    assert planes.mend_gaps(spark.createDataFrame([], df.schema)).count() == 0


def test_whole_query_of_gaps(spark):
    planes_, got = {}, {}
    for r in view(spark, SF, "pixg").collect():
        planes_.setdefault(r.frame, {})[r.y, r.x] = r.label
    for r in catalog.queries()["h02_mended_gaps"](spark, SF).collect():
        got.setdefault(r.frame, {})[r.y, r.x] = r.label
    assert got == {f: _mended(p) for f, p in planes_.items()}
