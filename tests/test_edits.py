"""Logs of edits, stages by transitions and histograms of awkward values against plain Python."""

import math
import random

import numpy as np
import pytest

from tissuelake.operators import divisions, edits, spatial, stages, stats, tracks
from tissuelake.plans import catalog
from tissuelake.plans.fixtures import view

SF = "/root/testdata/sf0.001"


def _apply(points, parts, log):
    """points {(particle, frame): id}, parts [[mother, d1, d2, frame]], edits in order, one after another over everything."""
    now = {k: k[0] for k in points}
    parts = [list(p) for p in parts]
    made, gone = [], set()

    def cut(track, at, new):
        if not any(o == track and f < at for (_, f), o in now.items()):
            return False
        for k in [k for k, o in now.items() if o == track and k[1] >= at]:
            now[k] = new
        for p in parts:
            if p[3] >= at:
                p[:3] = [new if m == track else m for m in p[:3]]
        return True

    for seq, op, a, b, at in sorted(log):
        if op == "split":
            cut(a, at, -seq)
        elif op == "merge":
            if any(o == a and f >= at for (_, f), o in now.items()):
                cut(a, at, -seq)
            second = "moving" if cut(b, at, "moving") else b
            now.update({k: a for k, o in now.items() if o == second})
            for p in parts:
                p[:3] = [a if m == second else m for m in p[:3]]
        else:
            some = [k for k, o in now.items() if o == a and (op == "delete" or (k[1] <= at if op == "delete_head" else k[1] >= at))]
            for k in some:
                del now[k]
            if some and a not in now.values():
                gone.add(a)
    gone -= set(now.values())
    used = sorted({o for o in [*now.values(), *(m for p in parts for m in p[:3])] if o < 0}, reverse=True)
    top = max(k[0] for k in points)
    made = {o: top + i + 1 for i, o in enumerate(used)}
    return {k: made.get(o, o) for k, o in now.items()}, [[*(made.get(m, m) for m in p[:3]), p[3]] for p in parts if not set(p[:3]) & gone]


def test_edits_in_order_several_a_track(spark):
    rng = random.Random(8)
    points = {(p, f) for p in range(24) for f in range(rng.randint(0, 5), rng.randint(6, 14))}
    parts = [(p, (p + 1) % 24, (p + 2) % 24, rng.randint(0, 13)) for p in range(0, 24, 2)]
    log = []
    for seq in range(1, 40):
        track = rng.choice([rng.randrange(20), -rng.randint(1, seq)])
        log.append((seq, rng.choice(["split", "split", "merge", "delete_head", "delete_tail", "delete"] if seq % 4 == 0 else ["split", "merge"]), track, rng.choice([x for x in range(20) if x != track]), rng.randint(1, 12)))
    t = spark.createDataFrame([(0, p, f, p * 100 + f) for p, f in sorted(points)] + [(1, 0, 0, 5)], "stack_id int, particle long, frame int, mark int")
    d = spark.createDataFrame([(0, *p) for p in parts] + [(1, 0, 1, 2, 3)], "stack_id int, mother long, daughter1 long, daughter2 long, frame int")
    after, followed = edits.applied(t, d, spark.createDataFrame([(0, *e) for e in log] + [(0, 99, "split", None, None, 1)], "stack_id int, seq long, op string, particle long, other long, frame int"))
    now, left = _apply(points, parts, log)
    assert {(r.mark // 100, r.mark % 100): r.particle for r in after.where("stack_id = 0").collect()} == now
    assert after.count() == len(now) + 1
    assert sorted([r.mother, r.daughter1, r.daughter2, r.frame] for r in followed.where("stack_id = 0").collect()) == sorted(left)
    assert followed.where("stack_id = 1").count() == 1
    empty = [spark.createDataFrame([], x.schema) for x in (t, d)]
    assert [x.count() for x in edits.applied(*empty, spark.createDataFrame([(0, 1, "split", 1, 2, 3)], "stack_id int, seq long, op string, particle long, other long, frame int"))] == [0, 0]


def test_whole_queries_of_edits(spark):
    t = view(spark, SF, "div")
    points = {(r.particle, r.frame): r.x for r in t.collect()}
    pairs = [tuple(r) for r in divisions.daughter_pairs(spatial.division_candidates(t, 20.0)).select("mother", "daughter1", "daughter2", "frame").collect()]
    log = [(r.seq, r.op, r.particle, r.other, r.frame) for r in catalog._log(spark, SF).where("op <> 'set_stage'").collect()]
    now, left = _apply(set(points), pairs, log)
    number = {o: i for i, o in enumerate(sorted(set(now.values())))}
    assert sorted((r.particle, r.frame, r.x) for r in catalog.queries()["h05_edited_tracks"](spark, SF).collect()) == sorted((number[o], f, points[p, f]) for (p, f), o in now.items())
    got = catalog.queries()["h14_edited_divisions"](spark, SF).collect()
    assert sorted((r.mother, r.daughter1, r.daughter2, r.frame) for r in got) == sorted((*(number.get(m, m) for m in p[:3]), p[3]) for p in left)


def test_a_track_in_two_plain_edits_is_an_error(spark):
    t = spark.createDataFrame([(0, 1, f, 0) for f in range(12)] + [(0, 2, f, 0) for f in range(12)], "stack_id int, particle long, frame int, cell_number int")
    twice = spark.createDataFrame([(0, 1, 4), (0, 1, 8)], "stack_id int, particle long, frame int")
    with pytest.raises(Exception, match="two edits"):
        tracks.split(t, twice).collect()
    with pytest.raises(Exception, match="two edits"):
        tracks.merge(t, spark.createDataFrame([(0, 1, 2, 4), (0, 1, 3, 6)], "stack_id int, first long, second long, frame int")).collect()


def test_ids_over_several_spans(spark, monkeypatch):
    monkeypatch.setattr(tracks, "_SPAN", 4)
    rows = [(s, p, f) for s in (0, 1) for p in (0, 3, 4, 9, 11, 30, 31) for f in range(2)]
    got = tracks.renumber(spark.createDataFrame(rows, "stack_id int, particle long, frame int")).collect()
    assert sorted((r.stack_id, r.particle, r.frame) for r in got) == [(s, p, f) for s in (0, 1) for p in range(7) for f in range(2)]


def test_order_over_several_spans(spark, monkeypatch):
    monkeypatch.setattr(tracks, "_SPAN", 3)
    rows = [(s, p, f) for s in (0, 1) for p in range(9) for f in range(p % 4, 10)]
    t = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "stack_id int, particle long, frame int")
    for by_particle, key in ((False, lambda r: (r[0], r[2], r[1])), (True, lambda r: r)):
        got = [tuple(r) for r in tracks.ordered(t, by_particle).collect()]
        assert [r[:3] for r in got] == sorted(rows, key=key)
        assert [r[3] for r in got if r[0] == 1] == list(range(len(rows) // 2))


def _stages(green, red, before):
    n = len(green)
    if n < 15:
        return before
    slope = [green[1] - green[0], *((green[i + 1] - green[i - 1]) / 2 for i in range(1, n - 1)), green[-1] - green[-2]]
    falls = [i for i in range(n - 3) if slope[i] <= min(-10.0, 0.9 * min(slope))]
    g1 = falls[0] + 1 if falls else None
    mean = lambda v, h: [sum(v[max(0, i - h) : i + h + 1]) / len(v[max(0, i - h) : i + h + 1]) for i in range(len(v))]
    calm = lambda v: mean(v, 2) if len(v) > 5 else list(v)
    smooth = calm(green[:g1]) + calm(green[g1:]) if g1 else calm(green)
    start = g1 + 5 if g1 else 0
    v = [-a / b for a, b in zip(smooth, mean(red, 3), strict=True)][start:]
    best = (-1, 0.0)
    for i in range(1, len(v) - 1):
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j + 1 < len(v) and v[j + 1] < v[i]:
            left = next((k for k in range(i - 1, -1, -1) if v[k] > v[i]), -1)
            right = next((k for k in range(j + 1, len(v)) if v[k] > v[i]), len(v))
            height = v[i] - max(min(v[left + 1 : i + 1]), min(v[j:right]))
            if height > best[1]:
                best = ((i + j) // 2, height)
    g2 = best[0] + start if best[0] >= 0 and best[1] >= 0.005 else None
    if g1 is None and g2 is None:
        return before
    return [3 if g2 is not None and i >= g2 else 1 if g1 is not None and i < g1 else 2 for i in range(n)]


def test_stages_by_transitions(spark):
    rng = random.Random(6)
    series = {}
    for p in range(40):
        n = rng.randint(10, 60)
        g1, g2 = rng.randint(3, n), rng.randint(3, n)
        green = [100.0 + rng.gauss(0, 3) if i < g1 else 20 + abs(i - g2) * 1.5 + rng.gauss(0, 1) for i in range(n)]
        series[p] = (green, [50.0 + 2 * i + rng.gauss(0, 1) for i in range(n)], [rng.randrange(4) for _ in range(n)])
    series[40] = ([10.0] * 20, [10.0] * 20, [1] * 20)
    rows = [(0, p, 3 + 2 * i, g, r, s) for p, v in series.items() for i, (g, r, s) in enumerate(zip(*v, strict=True))]
    rows += [(0, 50, i, None if i == 4 else 9.0 - i, 1.0, 2) for i in range(20)]
    got = {}
    for r in stages.stages_by_transitions(spark.createDataFrame(rows, "stack_id int, particle int, frame int, green double, red double, cycle_stage int")).orderBy("particle", "frame").collect():
        got.setdefault(r.particle, []).append(r.cycle_stage)
    assert got == {**{p: _stages(*v) for p, v in series.items()}, 50: [2] * 20}
    assert sum(v != series[p][2] for p, v in got.items() if p in series) > 10


def test_whole_query_of_transitions(spark):
    own = {}
    for r in view(spark, SF, "trk").orderBy("particle", "frame").collect():
        own.setdefault(r.particle, []).append((r.x, r.y + 1, r.cycle_stage))
    got = {}
    for r in catalog.queries()["e17_stages_by_transitions"](spark, SF).orderBy("particle", "frame").collect():
        got.setdefault(r.particle, []).append(r.cycle_stage)
    assert got == {p: _stages(*map(list, zip(*v, strict=True))) for p, v in own.items()}


def test_prominence():
    assert stages.most_prominent(np.array([0.0, 3, 1, 5, 5, 5, 2, 4, 0])) == (4, 5.0)
    assert stages.most_prominent(np.array([5.0, 4, 3])) == (-1, 0.0) and stages.most_prominent(np.zeros(0)) == (-1, 0.0)


def test_histograms_of_awkward_values(spark):
    nan = float("nan")
    rows = lambda v: stats.histogram(spark.createDataFrame([(None if x is None else float(x),) for x in v], "v double"), "v").orderBy("bin").collect()
    values = [1.0, 2, 3, 4, 5, 6, 7, 20]
    assert rows([*values, nan, None, nan]) == rows(values) and sum(r["count"] for r in rows(values)) == 8
    assert [(r.bin, r["count"], r.start, r.density) for r in rows([4.0] * 5)] == [(0, 5, 3.5, 1.0)]
    assert [(r.bin, r["count"], r.start) for r in rows([1.0, 4, 4, 4, 4, 4, 9])] == [(0, 7, 1.0)]
    assert rows([]) == [] and rows([nan]) == []
    shares = stats.weighted_histogram(spark.createDataFrame([("a", 1.0), ("a", nan), ("a", 3.0)], "g string, v double"), ["g"], "v", 2, 0.0, 4.0).collect()
    assert math.isclose(sum(r.share for r in shares), 1.0)


def test_fold_of_one_group_takes_arrow():
    import pyarrow as pa

    from tissuelake.operators.edits import _fold

    kinds = {"stack_id": pa.int32(), "kind": pa.int32(), "seq": pa.int64(), "op": pa.string(), "particle": pa.int64(), "other": pa.int64(), "frame": pa.int32(), "ref": pa.int64(), "role": pa.string()}
    rows = [(0, 1, None, None, 7, None, f, None, None) for f in (0, 1, 1, 2)] + [(0, 2, None, None, 7, None, 2, 5, "mother"), (0, 0, 2, "delete_head", 7, None, 0, None, None), (0, 0, 1, "split", 7, None, 2, None, None)]
    got = _fold(pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})).to_pylist()
    assert [(r["kind"], r["frame"], r["owner"]) for r in got] == [(1, 0, None), (1, 1, 7), (1, 2, -1), (2, 2, -1)]
