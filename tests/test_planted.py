"""Operators without SQL twins, and cases that the given tables do not hold, against plain Python."""

from itertools import combinations

import pytest

from pyspark.sql import functions as F

from tissuelake.operators import components, divisions, linking, lookups, stages, stats
from tissuelake.plans import catalog

SF = "/root/testdata/sf0.001"
_TRACK = "stack_id int, particle int, frame int, cycle_stage int"


def _runs(track):
    out = []
    for i, s in enumerate(track):
        if out and out[-1][0] == s:
            out[-1][2] = i + 1
        else:
            out.append([s, i, i + 1])
    return out


def _stable(track, pattern):
    track = list(track)
    while True:
        runs, changed = _runs(track), False
        for a, b, c in zip(runs, runs[1:], runs[2:], strict=False):
            if (a[0], b[0], c[0]) == pattern and a[2] - a[1] + c[2] - c[1] > b[2] - b[1]:
                track[b[1] : b[2]] = [c[0]] * (b[2] - b[1])
                changed = True
        if not changed:
            return track


def _odd(track):
    return any(b - a not in (0, 1) for a, b in zip(track, track[1:], strict=False))


def _mended(track, zero=True):
    if not _odd(track):
        return track
    n = len(track)
    fill = [next((track[j] for j in range(i, max(-1, i - 7), -1) if track[j]), 0) for i in range(n)]
    fill = [next((fill[j] for j in range(i, min(n, i + 7)) if fill[j]), 0) for i in range(n)]
    smooth = [max(range(4), key=lambda s: (fill[max(0, i - 1) : i + 2].count(s), -s)) for i in range(n)]
    runs = _runs(smooth)
    if [r[0] for r in runs[-2:]] == [3, 2] and runs[-1][2] - runs[-1][1] <= 6:
        smooth[runs[-1][1] :] = [3] * (n - runs[-1][1])
    runs = _runs([3 if s == 2 else s for s in smooth])
    if [r[0] for r in runs[:2]] == [3, 1] and runs[0][2] >= 4:
        smooth[: runs[0][2]] = [1] * runs[0][2]
    for pattern in ((1, 3, 1), (3, 2, 3), (1, 3, 2), (1, 0, 2), (2, 3, 2)):
        smooth = _stable(smooth, pattern)
    return [0] * n if zero and _odd(smooth) else smooth


def _tracks(df):
    out = {}
    for r in df.orderBy("particle", "frame").collect():
        out.setdefault(r.particle, []).append(r.cycle_stage)
    return out


def test_stages_against_python(spark):
    before = _tracks(catalog.view(spark, SF, "trk"))
    assert _tracks(catalog.queries()["e14_stable"](spark, SF)) == {p: _stable(t, (1, 3, 1)) for p, t in before.items()}
    assert _tracks(catalog.queries()["e16_interpretable"](spark, SF)) == {p: _mended(t, zero=False) for p, t in before.items()}


def test_planted_stages(spark):
    tracks = [[1, 1, 1, 3, 1, 1, 2, 2, 2, 3, 3], [1, 1, 3, 3, 2, 2, 2, 3, 3, 3], [3, 3, 3, 3, 3, 1, 1, 1, 2, 2], [1, 2, 2, 2, 3, 3, 3, 2, 2], [2, 2, 1, 1, 2, 2, 3, 3], [0, 0, 0], [1], [3, 2, 1, 3, 2, 1, 0, 2]]
    rows = [(0, p, f, s) for p, t in enumerate(tracks) for f, s in enumerate(t)]
    assert _tracks(stages.interpretable(spark.createDataFrame(rows, _TRACK))) == {p: _mended(t) for p, t in enumerate(tracks)}
    assert stages.interpretable(spark.createDataFrame([], _TRACK)).count() == 0


def _clash(a, b):
    return a[0] == b[0] or bool(set(a[1:3]) & set(b[1:3]))


def test_best_divisions_over_chains(spark):
    rows = [(1, 10, 11, 0.9), (1, 10, 12, 0.2), (1, 11, 12, 0.5), (2, 12, 13, 0.1), (2, 13, 14, 0.3), (3, 14, 15, 0.4), (4, 20, 21, 0.7), (5, 22, 23, 1.5), (6, 24, 25, None), (6, 24, 26, float("nan")), (7, 26, 27, 0.95)]
    good = [(*r[:3], 0.0 if r[3] is None or r[3] != r[3] else r[3]) for r in rows if r[3] is None or r[3] != r[3] or r[3] < 1]
    top = max(r[3] for r in good) + 1
    free = [c for n in range(len(good) + 1) for c in combinations(good, n) if not any(_clash(a, b) for a, b in combinations(c, 2))]
    weight = lambda c: sum(top - r[3] for r in c)
    schema = "stack_id int, mother int, daughter1 int, daughter2 int, score double"
    chosen = divisions.choose(spark.createDataFrame([(0, *r) for r in rows], schema)).collect()
    chosen = [(r.mother, r.daughter1, r.daughter2, 0.0 if r.score is None or r.score != r.score else r.score) for r in chosen]
    assert not any(_clash(a, b) for a, b in combinations(chosen, 2))
    assert abs(weight(chosen) - max(map(weight, free))) < 1e-9
    assert divisions.choose(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 0])
def test_components_of_a_chain_a_star_and_a_ring(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    links = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(None, 5), (300, 300)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(9)}, 300: 300}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_quadratic_surface_is_least_squares(spark):
    import numpy as np

    from tissuelake.plans import catalog

    fits = {r.frame: r for r in catalog.queries()["d37_quadratic_surface"](spark, "/root/testdata/sf0.001").collect()}
    from tissuelake.plans.fixtures import view

    pixels = view(spark, "/root/testdata/sf0.001", "pix").toPandas()
    for frame, p in pixels.groupby("frame"):
        basis = np.stack([p.x**2 + p.y**2, p.x, p.y, p.x * 0 + 1], axis=1).astype(float)
        best = np.linalg.lstsq(basis, p.ch0.to_numpy(), rcond=None)[0]
        f = fits[frame]
        assert f.n == len(p) and np.allclose(basis @ best, basis @ [f.a, f.b, f.c, f.d], atol=1e-5)


def test_nearest_label_is_found_far_away_or_not_at_all(spark):
    from tissuelake.operators.planes import nearest_labels

    rows = [(0, 0, 0, x, 7 if x == 40 else 0) for x in range(41)] + [(0, 1, 0, x, 0) for x in range(3)]
    found = nearest_labels(spark.createDataFrame(rows, "stack_id int, frame int, y int, x int, label int"), 2.0).collect()
    assert sorted(r.x for r in found) == list(range(40)) and {r.label for r in found} == {7} and {r.frame for r in found} == {0}


def test_saved_tables_are_not_broadcast(spark):
    table = components.saved(spark.range(1000).withColumn("a", F.col("id") * 2))
    counts = table.where("a > 4").groupBy("a").count()
    for how in ("inner", "left", "left_anti"):
        plan = spark.range(5000).withColumnRenamed("id", "a").join(counts, "a", how)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_autocorrelation_counts_points_of_one_place_together(spark):
    rows = [(0, f, p if p % 11 else None, float(p % 3), float(p % 2), (p % 3 + f) % 4) for f in range(2) for p in range(60)]
    rows += [(0, 0, 7, 1.0, 1.0, 1), (0, 0, 7, 0.0, 1.0, 2), (0, 1, 8, None, 0.0, 2), (0, 1, 9, 2.0, 0.0, None)]
    points = spark.createDataFrame(rows, "stack_id int, frame int, particle int, x double, y double, v int")
    values = {f: [r[5] for r in rows if r[1] == f and r[5] is not None] for f in (0, 1)}
    means = {f: sum(v) / len(v) for f, v in values.items()}
    variance = sum(sum((x - means[f]) ** 2 for x in v) / len(v) for f, v in values.items()) / 2
    bins = {}
    for a, b in combinations(rows, 2):
        if a[1] == b[1] and None not in (a[2], b[2], a[3], b[3]) and a[2] != b[2] and (d := ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5) <= 2:
            bins.setdefault(min(int(d / 0.5), 3), []).append(None if None in (a[5], b[5]) else (a[5] - means[a[1]]) * (b[5] - means[b[1]]))
    got = {r.bin: (r.n, r.correlation, r.error) for r in stats.autocorrelation(points, "v", 2.0, 4).collect()}
    assert set(got) == set(bins)
    for b, products in bins.items():
        known = [p for p in products if p is not None]
        mean = sum(known) / len(known)
        dev = (sum((p - mean) ** 2 for p in known) / len(known)) ** 0.5
        assert got[b] == (len(products), pytest.approx(mean / variance), pytest.approx(dev / len(products) ** 0.5 / variance))


def test_autocorrelation_of_a_crowd_at_one_place(spark):
    crowd = spark.range(400_000).selectExpr("0 AS stack_id", "0 AS frame", "id AS particle", "CAST(id % 2 AS DOUBLE) AS x", "0D AS y", "id % 2 AS v")
    half = 200_000
    got = {r.bin: (r.n, r.correlation) for r in stats.autocorrelation(crowd, "v", 2.0, 4).collect()}
    assert got == {0: (half * (half - 1), pytest.approx(1.0)), 2: (half * half, pytest.approx(-1.0))}


def test_only_the_ends_of_chains_are_joined_in_rounds(spark, monkeypatch):
    # chains 0..2 of 40 points, each link's place its own kind: all in one place, a new place every fifth point, a new one at each point
    rows = [(100 * c + k + 1, 100 * c + k, c, (0, k // 5, k)[c]) for c in range(3) for k in range(39)]
    links = spark.createDataFrame(rows, "id long, begin long, stack_id int, place int").repartition(7)
    expected = {(i, i // 100 * 100) for i, *_ in rows}
    for most in (linking.ONE_TASK, 0):
        monkeypatch.setattr(linking, "ONE_TASK", most)
        assert {tuple(r) for r in linking.beginnings(links, ["stack_id", "place"]).collect()} == expected
    assert linking.beginnings(links.where("false"), ["stack_id", "place"]).count() == 0

    def refuse(stars):
        raise AssertionError("all points went through rounds")

    # more points than one task joins, all of them in one place: no rounds over points
    monkeypatch.setattr(components, "ONE_TASK", 8)
    monkeypatch.setattr(components, "_rounds", refuse)
    points = spark.createDataFrame([(0, f, n, n * 50.0 + f, 5.0) for f in range(12) for n in range(3)], "stack_id int, frame int, cell_number int, x double, y double")
    found = linking.link(points, 2.0).collect()
    assert len(found) == 36 and all(r.particle == r.cell_number for r in found)


def test_ranges_are_expanded_by_many_tasks(spark):
    specs = spark.range(40).select("id", F.concat("id", F.lit("-3, 7")).alias("spec")).groupBy("id", "spec").count().coalesce(1)
    got = lookups.expand_ranges(specs, "spec", "k").select("id", "k", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in got}) > 1
    assert sorted((r.id, r.k) for r in got) == sorted((i, k) for i in range(40) for k in [*range(min(i, 3), max(i, 3) + 1), 7])


def test_long_runs_are_expanded_by_spans(spark):
    runs = ["70000-3, 5-70000", "65536, 65535-131072", "7-7,0", "0-300000"]
    specs = spark.createDataFrame(list(enumerate(runs)), "id int, spec string")
    got = lookups.expand_ranges(specs, "spec", "k").select("id", "k", F.spark_partition_id().alias("task")).collect()
    expected = [(i, k) for i, spec in enumerate(runs) for part in spec.split(",") for a, *b in [list(map(int, part.split("-")))] for k in range(min(a, *b, a), max(a, *b, a) + 1)]
    assert sorted((r.id, r.k) for r in got) == sorted(expected)
    assert len({r.task for r in got if r.id == 3}) > 1
    # an array of this run would be over any array's size
    long = specs.select(F.lit("9000000000-1").alias("spec")).limit(1)
    assert all(1 <= r.k <= 9_000_000_000 for r in lookups.expand_ranges(long, "spec", "k").limit(3).collect())
