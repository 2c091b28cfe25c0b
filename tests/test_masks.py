"""Cuts, merges and deletions of cells against plain Python, with tracks and divisions that follow."""

import numpy as np

from tissuelake.operators import masks
from tissuelake.plans import catalog
from tissuelake.plans.fixtures import view

SF = "/root/testdata/sf0.001"
_SIDES = ((0, 1), (1, 0), (0, -1), (-1, 0))
_CORNERS = ((1, 1), (1, -1), (-1, 1), (-1, -1))
PIX = "stack_id int, frame int, y int, x int, label int"
CUT = "stack_id int, frame int, cut int, k int, y int, x int"
TRK = "stack_id int, particle long, frame int, cell_number int, x double, y double, cycle_stage int"
DIV = "stack_id int, mother long, daughter1 long, daughter2 long, frame int, score double"


def _line(points):
    out = set(points[-1:])
    for (y, x), (v, u) in zip(points, points[1:]):
        n = max(abs(v - y), abs(u - x))
        out |= {(y + (2 * i * (v - y) + n) // (2 * n), x + (2 * i * (u - x) + n) // (2 * n)) for i in range(n + 1)} if n else {(y, x)}
    return out


def _flood(places):
    left, out = set(places), []
    for p in sorted(places):
        if p in left:
            left.remove(p)
            part, open_ = [p], [p]
            while open_:
                y, x = open_.pop()
                for q in ((y + d, x + e) for d, e in _SIDES):
                    if q in left:
                        left.remove(q)
                        part.append(q)
                        open_.append(q)
            out.append(part)
    return out


def _split(plane, lines, least):
    line = set().union(*map(_line, lines)) if lines else set()
    out, top, parents = dict(plane), max(plane.values()), {}
    for label in sorted({plane[p] for p in line if plane.get(p)}):
        own = {p for p, v in plane.items() if v == label}
        found = _flood(own - line)
        size = [len(f) for f in found]
        at = {p: i for i, f in enumerate(found) for p in f}
        todo = own & line
        while True:
            near = {}
            for y, x in todo:
                for steps in (_SIDES, _CORNERS):
                    seen = {at[q] for q in ((y + d, x + e) for d, e in steps) if q in at}
                    if seen and (y, x) not in near:
                        near[y, x] = min(seen, key=lambda i: (-size[i], i))
            if not near:
                break
            at.update(near)
            todo -= set(near)
        parts = [[p for p, i in at.items() if i == k] for k in range(len(found))]
        order = sorted(range(len(parts)), key=lambda i: (-len(parts[i]), found[i][0]))
        home = {i: i for i in order if len(parts[i]) >= least}
        if not home:
            continue
        waiting = [i for i in order if i not in home]
        while waiting:
            for i in waiting:
                shared = {}
                for y, x in parts[i]:
                    for q in ((y + d, x + e) for d, e in _SIDES):
                        if q in at and at[q] != i and at[q] in home:
                            shared[home[at[q]]] = shared.get(home[at[q]], 0) + 1
                if shared:
                    home[i] = max(shared, key=lambda j: (shared[j], -order.index(j)))
                    break
            else:
                i = waiting[0]
                mid = lambda k: np.mean(parts[k], axis=0)
                home[i] = min(set(home.values()), key=lambda j: (((mid(i) - mid(j)) ** 2).sum(), order.index(j)))
            waiting.remove(i)
        whole = {j: sum(len(parts[i]) for i in home if home[i] == j) for j in set(home.values())}
        for j in sorted(whole, key=lambda j: (-whole[j], order.index(j)))[1:]:
            top += 1
            parents[top] = label
            out.update({p: top for i in home if home[i] == j for p in parts[i]})
    return out, parents


def _planes(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.frame, {})[r.y, r.x] = r.label
    return out


def _rows(planes):
    return [(0, f, y, x, v) for f, p in enumerate(planes) for (y, x), v in p.items()]


def test_cuts(spark):
    square = {(y, x): 1 if 2 <= y < 12 and 2 <= x < 12 else 2 if 2 <= y < 12 and 13 <= x < 20 else 0 for y in range(15) for x in range(22)}
    rng = np.random.default_rng(5)
    blocks = {(y, x): 1 + y // 7 * 3 + x // 8 for y in range(21) for x in range(24)}
    planes = [square, square, square, square, blocks, blocks]
    cuts = {
        0: [[(0, 5), (14, 5)]],  # one straight cut
        1: [[(0, 5), (7, 5)], [(7, 15)]],  # ends within a cell; a single pixel
        2: [[(3, 0), (3, 21)], [(0, 11), (14, 11)]],  # a strip of one row, small corners
        3: [[(2 + i % 10, 2 + 9 * (i // 10 % 2) + i // 20) for i in range(40)]],  # a scribble
        4: [[tuple(map(int, rng.integers(0, 21, 2))) for _ in range(6)] for _ in range(3)],
        5: [],
    }
    df = spark.createDataFrame(_rows(planes), PIX)
    drawn = spark.createDataFrame([(0, f, c, k, y, x) for f, lines in cuts.items() for c, line in enumerate(lines) for k, (y, x) in enumerate(line)] + [(0, 0, 0, 9, None, 4), (0, 77, 0, 0, 1, 1)], CUT)
    for least in (1, 5, 30):
        after, made = masks.split_cells(df, drawn, least)
        want = {f: _split(p, cuts[f], least) for f, p in enumerate(planes)}
        assert _planes(after) == {f: w[0] for f, w in want.items()}
        assert {(r.frame, r.label): r.parent for r in made.collect()} == {(f, k): v for f, w in want.items() for k, v in w[1].items()}
    assert want[0][1] == {3: 1} and want[1][1] == {}
    after, made = masks.split_cells(df, drawn, 5)
    tracks = spark.createDataFrame([(0, 10 + v, f, v - 1, 0.0, 0.0, 2) for f, p in enumerate(planes) for v in sorted(set(p.values()) - {0})], TRK)
    got = {(r.frame, r.cell_number): r for r in masks.split_tracks(tracks, after, made).collect()}
    new = got[0, 2]
    assert new.particle == 20 and new.cycle_stage is None and (new.y, new.x) == (6.5, 3.0 if got[0, 0].x > 6 else 9.0)
    assert got[0, 0].particle == 11 and got[0, 0].cycle_stage == 2 and got[0, 1].x == 0.0
    none = masks.split_cells(df, spark.createDataFrame([], CUT))
    assert _planes(none[0]) == dict(enumerate(planes)) and none[1].count() == 0


def test_whole_query_of_cuts(spark):
    got = _planes(catalog.queries()["h10_split_cells"](spark, SF))
    planes = _planes(view(spark, SF, "pixg"))
    assert got == {f: _split(p, [[(0, 5 + f % 7), (20, 30), (47, 40 + f % 11)], [(f % 48, 0), (30, 63)]], 5)[0] for f, p in planes.items()}


def _small(spark):
    # particle 1 has cells in frames 0 and 1, 2 in 0, 3 in 1 and 2; labels 1 to 3
    planes = [{(0, x): (1, 1, 2, 2, 3, 3)[x] for x in range(6)}, {(0, x): (1, 1, 2, 2, 0, 3)[x] for x in range(6)}, {(0, x): (0, 1, 1, 2, 2, 2)[x] for x in range(6)}]
    tracks = [(0, 1, 0, 0, 0.5, 0.0, 1), (0, 2, 0, 1, 2.5, 0.0, 1), (0, 4, 0, 2, 4.5, 0.0, 1), (0, 1, 1, 0, 0.5, 0.0, 1), (0, 3, 1, 1, 2.5, 0.0, 1), (0, 4, 1, 2, 5.0, 0.0, 1), (0, 3, 2, 0, 1.5, 0.0, 1), (0, 4, 2, 1, 4.0, 0.0, 1)]
    divisions = [(0, 2, 1, 3, 1, 0.5), (0, 4, 1, 3, 2, None)]
    return spark.createDataFrame(_rows(planes), PIX), spark.createDataFrame(tracks, TRK), spark.createDataFrame(divisions, DIV)


def _after(result):
    pixels, tracks, divisions = result
    return {f: [p[k] for k in sorted(p)] for f, p in _planes(pixels).items()}, sorted((r.frame, r.particle, r.cell_number, r.x) for r in tracks.collect()), sorted((r.mother, r.daughter1, r.daughter2, r.frame) for r in divisions.collect())


def test_deleted_cells(spark):
    got = _after(masks.delete_cells(*_small(spark), spark.createDataFrame([(0, 0, 2), (0, 0, 2), (0, 1, 1), (0, 9, 1)], "stack_id int, frame int, label int")))
    assert got[0] == {0: [1, 1, 0, 0, 2, 2], 1: [0, 0, 1, 1, 0, 2], 2: [0, 1, 1, 2, 2, 2]}
    assert got[1] == [(0, 1, 0, 0.5), (0, 4, 1, 4.5), (1, 3, 0, 2.5), (1, 4, 1, 5.0), (2, 3, 0, 1.5), (2, 4, 1, 4.0)]
    assert got[2] == [(4, 1, 3, 2)]


def test_merged_cells(spark):
    got = _after(masks.merge_cells(*_small(spark), spark.createDataFrame([(0, 0, 1, 2), (0, 1, 1, 2), (0, 1, 2, 3), (0, 2, 1, 1)], "stack_id int, frame int, first int, second int")))
    assert got[0] == {0: [1, 1, 1, 1, 2, 2], 1: [1, 1, 1, 1, 0, 1], 2: [0, 1, 1, 2, 2, 2]}
    assert got[1] == [(0, 1, 0, 1.5), (0, 4, 1, 4.5), (1, 1, 0, 2.2), (2, 3, 0, 1.5), (2, 4, 1, 4.0)]
    assert got[2] == [(4, 1, 3, 2)]


def test_merged_tracks(spark):
    got = _after(masks.merge_track_masks(*_small(spark), spark.createDataFrame([(0, 2, 3), (0, 2, 4)], "stack_id int, first long, second long")))
    assert got[0] == {0: [1, 1, 2, 2, 2, 2], 1: [1, 1, 2, 2, 0, 2], 2: [0, 1, 1, 1, 1, 1]}
    assert got[1] == [(0, 1, 0, 0.5), (0, 2, 1, 3.5), (1, 1, 0, 0.5), (1, 2, 1, 10 / 3), (2, 2, 0, 3.0)]
    assert got[2] == [(2, 1, 2, 1), (2, 1, 2, 2)]


def test_deleted_frames(spark):
    pixels, tracks, divisions = _small(spark)
    drift = spark.createDataFrame([(0, 1, 0.5, 0.0), (0, 2, 0.75, 0.0)], "stack_id int, frame int, dx double, dy double")
    left, parts, moved = masks.delete_frames(tracks, divisions, drift, spark.createDataFrame([(0, 1), (0, 1), (1, 0)], "stack_id int, frame int"))
    assert sorted((r.frame, r.particle) for r in left.collect()) == [(0, 1), (0, 2), (0, 4), (1, 3), (1, 4)]
    assert sorted((r.mother, r.frame) for r in parts.collect()) == [(2, 1), (4, 1)] and [(r.frame, r.dx) for r in moved.collect()] == [(1, 0.75)]
    left, parts, _ = masks.delete_frames(tracks, divisions, drift, spark.createDataFrame([(0, 0)], "stack_id int, frame int"))
    assert sorted((r.mother, r.frame) for r in parts.collect()) == [(4, 1)] and left.agg({"frame": "max"}).first()[0] == 1
