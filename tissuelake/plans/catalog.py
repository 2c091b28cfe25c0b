"""Registered queries of the library's own operators, each with its SQL twin. Names begin with the operator's number in the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, contours, divisions, edits, heights, linking, lookups, masks, networks, planes, profiles, shape, spatial, stages, stats, thresholds, tracks, zonal
from ..sources import files, positions, stacks
from .fixtures import oracle, view

_WT = "(PARTITION BY particle ORDER BY frame)"
_STEP = f"SELECT *, lead(frame) OVER {_WT} - frame AS dt, lead(x) OVER {_WT} - x AS ex, lead(y) OVER {_WT} - y AS ey FROM trk"
_SPEED = f"SELECT frame, particle, sqrt(ex / dt * (ex / dt) + ey / dt * (ey / dt)) AS v FROM ({_STEP}) s WHERE dt IS NOT NULL"
_RUNS = f"""SELECT particle, run, any_value(cycle_stage) AS cycle_stage, count(*) AS length, min(frame) AS first_frame FROM (
SELECT *, sum(CASE WHEN cycle_stage <> before THEN 1 ELSE 0 END) OVER (PARTITION BY particle ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run
FROM (SELECT *, lag(cycle_stage) OVER {_WT} AS before FROM trk) a) b GROUP BY particle, run"""
_DRIFT = f"""SELECT frame, sum(mx) OVER (ORDER BY frame) AS dx, sum(my) OVER (ORDER BY frame) AS dy FROM (SELECT frame, avg(ex) AS mx, avg(ey) AS my FROM (
SELECT frame, frame - lag(frame) OVER {_WT} AS dt, x - lag(x) OVER {_WT} AS ex, y - lag(y) OVER {_WT} AS ey FROM trk) a WHERE dt = 1 GROUP BY frame) m"""
_QUART = ", ".join(f"quantile_cont({{0}}, 0.{p}) AS q{p}" for p in (25, 50, 75))
_TILE = "CAST(greatest(0, ceil((max({0}) - min({0})) / 400.0) - 1) AS BIGINT)"

_CANDIDATES = """, ends AS (SELECT particle, max(frame) AS f, arg_max(x, frame) AS x, arg_max(y, frame) AS y FROM div GROUP BY particle), begins AS (SELECT particle, min(frame) AS f, arg_min(x, frame) AS x, arg_min(y, frame) AS y FROM div GROUP BY particle),
found AS (SELECT e.particle AS mother, b.particle AS daughter, b.f AS frame FROM ends e JOIN begins b ON b.f = e.f + 1 WHERE sqrt((e.x - b.x) * (e.x - b.x) + (e.y - b.y) * (e.y - b.y)) < 20)"""
_PAIRS = ", pairs AS (SELECT a.mother, a.daughter AS daughter1, b.daughter AS daughter2, a.frame FROM found a JOIN found b ON a.mother = b.mother AND a.daughter < b.daughter)"

_GOOD = """, own AS (SELECT frame, y, x, label FROM pixg WHERE label <> 0), s(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
full_ AS (SELECT o.frame, o.y, o.x FROM own o CROSS JOIN s JOIN own q ON q.frame = o.frame AND q.y = o.y + dy AND q.x = o.x + dx GROUP BY 1, 2, 3 HAVING count(*) = 4),
bad AS (SELECT DISTINCT frame, label FROM own ANTI JOIN full_ USING (frame, y, x)),
corners AS (SELECT frame, y + dy AS y, x + dx AS x, label FROM own CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dy, dx)),
met AS (SELECT frame, y, x FROM corners GROUP BY 1, 2, 3 HAVING count(*) = 4 AND count(DISTINCT label) >= 3),
vert AS (SELECT frame, label, x AS px, y AS py FROM (SELECT DISTINCT frame, y, x, label FROM corners JOIN met USING (frame, y, x)) d ANTI JOIN bad USING (frame, label) QUALIFY count(*) OVER (PARTITION BY frame, label) >= 3)"""
_FEATURES = _CANDIDATES.replace("FROM div", "FROM divc") + _PAIRS + """, p AS (SELECT *, row_number() OVER (PARTITION BY particle ORDER BY frame) AS a, row_number() OVER (PARTITION BY particle ORDER BY frame DESC) AS z FROM divc),
t AS (SELECT particle, max(CASE WHEN a = 1 THEN x END) AS x0, max(CASE WHEN a = 1 THEN y END) AS y0, max(CASE WHEN a = 1 THEN area END) AS a0, max(CASE WHEN z = 1 THEN x END) AS x1, max(CASE WHEN z = 1 THEN y END) AS y1,
1 - max(CASE WHEN a <= 2 THEN circularity END) AS c0, 1 - max(CASE WHEN z <= 3 THEN circularity END) AS c1 FROM p GROUP BY particle),
j AS (SELECT mother, daughter1, daughter2, pairs.frame, sqrt(m.a0) AS size, m.c1 AS mother_circ, (d.c0 + e.c0) / 2 AS daughter_circ, d.x0 - m.x1 AS dx, d.y0 - m.y1 AS dy, e.x0 - m.x1 AS ex, e.y0 - m.y1 AS ey, d.a0 AS da, e.a0 AS ea
FROM pairs JOIN t m ON m.particle = mother JOIN t d ON d.particle = daughter1 JOIN t e ON e.particle = daughter2),
k AS (SELECT *, (atan2(ey, ex) - atan2(dy, dx)) / pi() AS turn FROM j),
f AS (SELECT mother, daughter1, daughter2, frame, mother_circ, daughter_circ, abs(1 - sqrt((ex - dx) * (ex - dx) + (ey - dy) * (ey - dy)) / size) AS daughter_distance,
abs(sqrt(ex * ex + ey * ey) - sqrt(dx * dx + dy * dy)) / size AS distance_diff, abs(turn - 2 * floor(turn / 2) - 1) AS angle,
sqrt(pow((dx * da + ex * ea) / (da + ea), 2) + pow((dy * da + ey * ea) / (da + ea), 2)) / size AS com_displacement FROM k),
sc AS (SELECT *, 40.79220969::DOUBLE * pow(mother_circ - 0.1::DOUBLE, 2) + 8.12982495::DOUBLE * pow(daughter_circ - 0.1::DOUBLE, 2) + 2 * pow(daughter_distance, 2) + 0.20812352::DOUBLE * pow(distance_diff, 2) + 2.54951311::DOUBLE * pow(angle, 2) + 32.51929981::DOUBLE * pow(com_displacement, 2) AS score FROM f)"""
_SNAPSHOT = """SELECT frame, label, CASE WHEN o > {0} THEN 3 WHEN g > 0.15 AND (r <= 0.15 OR g > r) THEN 1 WHEN r > 0.15 THEN 2 ELSE 0 END AS cycle_stage
FROM (SELECT frame, label, avg(CAST(ch1 > 160 AS INT)) AS g, avg(CAST(ch0 > 60 AS INT)) AS r, avg(CAST(ch0 > 90 AND ch1 > 160 AS INT)) AS o FROM pixg WHERE label <> 0 GROUP BY frame, label) p"""

_KEY = r"array_to_string(list_transform(regexp_extract_all(path, '\d+|\D+'), lambda t: CASE WHEN regexp_full_match(t, '\d{1,20}') THEN lpad(t, 20, '0') ELSE t END), '')"
_PLACED = f", placed AS (SELECT *, {_KEY} AS k, row_number() OVER (PARTITION BY stack_id ORDER BY {_KEY}, path) - 1 AS n FROM files)"
_BLUR = """, steps AS (SELECT t.t, d.d, exp(-0.5 * d.d * d.d / (0.8 * 0.8)) AS w FROM (SELECT unnest(range(64)) AS t) t CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) d),
wy AS (SELECT t, CASE WHEN t + d < 0 THEN -1 - t - d WHEN t + d > 47 THEN 95 - t - d ELSE t + d END AS src, w / sum(w) OVER (PARTITION BY t) AS w FROM steps WHERE t < 48),
wx AS (SELECT t, CASE WHEN t + d < 0 THEN -1 - t - d WHEN t + d > 63 THEN 127 - t - d ELSE t + d END AS src, w / sum(w) OVER (PARTITION BY t) AS w FROM steps)
SELECT frame, CAST(wy.t AS INT) AS y, CAST(wx.t AS INT) AS x, round(sum(ch0 * wy.w * wx.w), 6) AS value FROM pix JOIN wy ON wy.src = y JOIN wx ON wx.src = x GROUP BY frame, wy.t, wx.t"""

_BLUR_STEPS, _BLUR_SUM = _BLUR.split("\nSELECT", 1)

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(view(spark, sf_dir, name))


def _on2(a: str, b: str, build: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(view(spark, sf_dir, a), view(spark, sf_dir, b))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _rounded_fast(df: DataFrame, *columns: str) -> DataFrame:
    """_rounded for values of 0 to 1e9: round() makes a decimal number of every value, which is most of the work where rows are many."""
    return df.withColumns({c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in columns})


def _edits(edits: DataFrame, *ops: str) -> DataFrame:
    return edits.where(F.col("op").isin(*ops))


def _scored(t: DataFrame) -> DataFrame:
    return divisions.features(divisions.daughter_pairs(spatial.division_candidates(t, 20.0)), t).withColumn("score", divisions.score())


def _moving(t: DataFrame, step: float) -> DataFrame:
    """Points whose cell numbers are the planted tracks, under a drift of `step` a frame along x."""
    return t.select("stack_id", "frame", F.col("particle").alias("cell_number"), (F.col("x") + F.col("frame") * step).alias("x"), "y")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of each mother of `div`, the later one on what the first may have moved."""
    e, u = view(spark, sf_dir, "edit"), F.col("particle")
    first = e.select("stack_id", (u + 1).alias("seq"), "op", (u * 4).alias("particle"), (u * 4 + 1).alias("other"), (F.col("frame") / 3).cast("int").alias("frame"))
    return first.union(e.select("stack_id", u + 10_000_000, F.when(u % 3 == 0, "merge").when(u % 3 == 1, "split").otherwise("delete"), u * 4, u * 4 + 2, (F.col("frame") / 4).cast("int")))


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = view(spark, sf_dir, "div")
    return edits.renumbered(*edits.applied(t, divisions.daughter_pairs(spatial.division_candidates(t, 20.0)), _log(spark, sf_dir)))


#: name: (query, oracle). All read their whole tables.
CATALOG: dict[str, tuple[Query, str]] = {
    "b08_stage_flags": (_on("trk", lambda t: stages.flags(t).select("particle", "frame", "green", "red")), oracle("trk", "SELECT particle, frame, cycle_stage IN (1, 3) AS green, cycle_stage IN (2, 3) AS red FROM trk")),
    "b10_delete_frame": (_on("trk", lambda t: tracks.drop_frame(t, 20).select("particle", "frame", "x")), oracle("trk", "SELECT particle, CASE WHEN frame > 20 THEN frame - 1 ELSE frame END AS frame, x FROM trk WHERE frame <> 20")),
    "b12_delete_parts": (
        _on2("trk", "edit", lambda t, e: tracks.delete_parts(t, e).select("particle", "frame", "x")),
        oracle("trk edit", "SELECT particle, frame, x FROM trk t WHERE NOT EXISTS (SELECT 1 FROM edit e WHERE e.particle = t.particle AND (op = 'delete_head' AND t.frame <= e.frame OR op = 'delete_tail' AND t.frame >= e.frame))"),
    ),
    "b14_delete_cells": (
        _on("pix", lambda p: zonal.remove_cells(p, zonal.edge_cells(p, 48, 64, 1)).select("frame", "y", "x", "label")),
        oracle("pix", "SELECT frame, y, x, dense_rank() OVER (PARTITION BY frame ORDER BY label) AS label FROM pix WHERE (frame, label) NOT IN (SELECT frame, label FROM pix WHERE y < 1 OR x < 1 OR y >= 47 OR x >= 63)"),
    ),
    "b16_edge_cells": (_on("pix", lambda p: zonal.edge_cells(p, 48, 64, 3).select("frame", "label")), oracle("pix", "SELECT DISTINCT frame, label FROM pix WHERE y < 3 OR x < 3 OR y >= 45 OR x >= 61")),
    "b18_rotate": (_on("pix", lambda p: zonal.rotate(p, 48, 64, 1).select("frame", "y", "x", "label")), oracle("pix", "SELECT frame, 63 - x AS y, y AS x, label FROM pix")),
    "b21_track_ends": (
        _on("trk", lambda t: tracks.track_ends(t).drop("stack_id")),
        oracle("trk", "SELECT particle, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, min(frame) > (SELECT min(frame) FROM trk) AS born, max(frame) < (SELECT max(frame) FROM trk) AS died FROM trk GROUP BY particle"),
    ),
    "b24_drift_corrected": (
        _on("trk", lambda t: _rounded(tracks.subtract_drift(t, tracks.drift(t)).select("particle", "frame", "x", "y"), "x", "y")),
        oracle("trk", f"SELECT particle, t.frame, round(x - coalesce(dx, 0), 6) AS x, round(y - coalesce(dy, 0), 6) AS y FROM trk t LEFT JOIN ({_DRIFT}) d USING (frame)"),
    ),
    "b26_normalise": (
        _on("pix", lambda p: _rounded(zonal.normalise(p, "ch0").drop("stack_id"), "value")),
        oracle("pix", "SELECT frame, y, x, round(CASE WHEN hi > lo THEN least(1.0, greatest(0.0, (ch0 - lo) / (hi - lo))) ELSE 0.0 END, 6) AS value FROM pix JOIN (SELECT frame, quantile_cont(ch0, 0.01) AS lo, quantile_cont(ch0, 0.99) AS hi FROM pix GROUP BY frame) q USING (frame)"),
    ),
    "c03_nuclei_to_cells": (
        _on2("nuc", "pixg", lambda n, p: zonal.match_nuclei(n, p).drop("stack_id")),
        oracle("nuc pixg", "SELECT n.frame, p.label, min(n.nuc) AS nuc FROM nuc n JOIN pixg p ON p.frame = n.frame AND p.y = CAST(round_even(cy, 0) AS INT) AND p.x = CAST(round_even(cx, 0) AS INT) WHERE p.label <> 0 GROUP BY n.frame, p.label"),
    ),
    "c04_division_candidates": (
        _on("div", lambda t: _rounded(spatial.division_candidates(t, 20.0).drop("stack_id"), "distance")),
        oracle(
            "div",
            """, ends AS (SELECT particle, max(frame) AS f, arg_max(x, frame) AS x, arg_max(y, frame) AS y FROM div GROUP BY particle), begins AS (SELECT particle, min(frame) AS f, arg_min(x, frame) AS x, arg_min(y, frame) AS y FROM div GROUP BY particle),
found AS (SELECT e.particle AS mother, b.particle AS daughter, b.f AS frame, sqrt((e.x - b.x) * (e.x - b.x) + (e.y - b.y) * (e.y - b.y)) AS distance FROM ends e JOIN begins b ON b.f = e.f + 1)
SELECT mother, daughter, frame, round(distance, 6) AS distance FROM found WHERE distance < 20 QUALIFY count(*) OVER (PARTITION BY mother) >= 2""",
        ),
    ),
    "c09_adjacency": (
        _on("pixg", lambda p: spatial.adjacency(p).drop("stack_id")),
        oracle("pixg", "SELECT DISTINCT p.frame, p.label AS a, q.label AS b FROM pixg p JOIN (SELECT * FROM pixg CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx)) q ON p.frame = q.frame AND p.y = q.y + dy AND p.x = q.x + dx WHERE p.label < q.label AND p.label <> 0"),
    ),
    "d01_areas": (_on("pixg", lambda p: zonal.areas(p).drop("stack_id")), oracle("pixg", "SELECT frame, label, CAST(count(*) AS DOUBLE) AS area FROM pixg WHERE label <> 0 GROUP BY frame, label")),
    "d02_density": (
        _on("pixg", lambda p: _rounded(zonal.density(p).drop("stack_id"), "mean_area", "length", "density")),
        oracle("pixg", "SELECT frame, round(avg(a), 6) AS mean_area, round(sqrt(avg(a)), 6) AS length, round(1e6 / avg(a), 6) AS density FROM (SELECT frame, count(*) AS a FROM pixg WHERE label <> 0 GROUP BY frame, label) t GROUP BY frame"),
    ),
    "d03_label_check": (_on("pixg", lambda p: zonal.label_check(p).drop("stack_id")), oracle("pixg", "SELECT frame, count(DISTINCT label) AS n_cells, count(DISTINCT label) = max(label) AS contiguous FROM pixg WHERE label <> 0 GROUP BY frame")),
    "d04_polygons": (
        _on("poly", lambda v: _rounded(shape.polygons(v).drop("stack_id"), "area", "perimeter", "circularity", "cx", "cy", "spherical_volume")),
        oracle(
            "poly",
            """, e AS (SELECT a.frame, a.label, a.px, a.py, b.px AS nx, b.py AS ny, a.px * b.py - b.px * a.py AS c FROM poly a JOIN poly b ON a.frame = b.frame AND a.label = b.label AND b.k = (a.k + 1) % 6),
s AS (SELECT frame, label, sum(c) / 2 AS a, sum(sqrt((nx - px) * (nx - px) + (ny - py) * (ny - py))) AS p, sum((px + nx) * c) AS sx, sum((py + ny) * c) AS sy FROM e GROUP BY frame, label)
SELECT frame, label, round(abs(a), 6) AS area, round(p, 6) AS perimeter, round(4 * pi() * abs(a) / (p * p), 6) AS circularity, round(sx / (6 * a), 6) AS cx, round(sy / (6 * a), 6) AS cy, round(4.0 / 3 * pi() * pow(abs(a) / pi(), 1.5), 6) AS spherical_volume FROM s""",
        ),
    ),
    "d14_intensity_percentile": (_on("pixg", lambda p: zonal.intensity(p, "ch0").drop("stack_id")), oracle("pixg", "SELECT frame, label, CAST(trunc(quantile_cont(ch0, 0.9)) AS INT) AS value FROM pixg WHERE label <> 0 GROUP BY frame, label")),
    "d15_fraction_above": (
        _on("pixg", lambda p: _rounded(zonal.fraction_above(p, "ch1", 128.0).drop("stack_id"), "fraction")),
        oracle("pixg", "SELECT frame, label, round(avg(CASE WHEN ch1 > 128 THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM pixg WHERE label <> 0 GROUP BY frame, label"),
    ),
    "d21_volumes": (
        _on("pixg", lambda p: _rounded(zonal.volumes(p, 0.5, 2.0).drop("stack_id"), "volume", "mean_height")),
        oracle("pixg", "SELECT frame, label, round(sum(height * 2.0::DOUBLE) * 0.25, 6) AS volume, round(avg(height * 2.0::DOUBLE), 6) AS mean_height FROM pixg WHERE label <> 0 GROUP BY frame, label"),
    ),
    "d24_z_profile": (_on("vox", lambda v: _rounded(zonal.z_profile(v).drop("stack_id"), "mean")), oracle("vox", "SELECT z, round(avg(value), 6) AS mean FROM vox GROUP BY z")),
    "a12_top_surface": (_on("vox", lambda v: zonal.top_surface(v, 10.0).drop("stack_id")), oracle("vox", "SELECT frame, y, x, coalesce(min(CASE WHEN value = 10 THEN z END), 0) AS top FROM vox GROUP BY frame, y, x")),
    "d25_contrast": (
        _on("pix", lambda p: _rounded(zonal.contrast(p, "ch0").drop("stack_id"), "low", "high")),
        oracle("pix", "SELECT frame, round(quantile_cont(ch0, 0.01), 6) AS low, round(quantile_cont(ch0, 0.99), 6) AS high FROM pix WHERE ch0 <> 0 GROUP BY frame"),
    ),
    "d26_speed_quartiles": (
        _on("trk", lambda t: _rounded(tracks.frame_quartiles(tracks.velocities(t), "v").where("n > 0").drop("stack_id"), "q25", "q50", "q75")),
        oracle("trk", f"SELECT frame, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, count(*) AS n FROM ({_SPEED}) s GROUP BY frame"),
    ),
    "d27_histogram": (
        _on("li", lambda r: _rounded(stats.histogram(r, "volume"), "start", "density")),
        oracle(
            "li",
            """, q AS (SELECT min(volume) AS lo, max(volume) AS hi, count(*) AS n, 2 * (quantile_cont(volume, 0.75) - quantile_cont(volume, 0.25)) / pow(count(*), 1.0 / 3) AS w FROM li), b AS (SELECT lo, n, ceil((hi - lo) / w) AS bins, (hi - lo) / ceil((hi - lo) / w) AS width FROM q)
SELECT CAST(least(floor((volume - lo) / width), bins - 1) AS BIGINT) AS bin, count(*) AS count, round(any_value(lo) + CAST(least(floor((volume - lo) / width), bins - 1) AS BIGINT) * any_value(width), 6) AS start, round(count(*) / (any_value(n) * any_value(width)), 6) AS density FROM li CROSS JOIN b GROUP BY 1""",
        ),
    ),
    "d30_boxes": (
        _on("li", lambda r: _rounded(stats.boxes(r, ["cond", "stage"], "volume"), "low", "q25", "q50", "q75", "high")),
        oracle("li", "SELECT cond, stage, count(volume) AS n, round(min(volume), 6) AS low, round(quantile_cont(volume, 0.25), 6) AS q25, round(quantile_cont(volume, 0.5), 6) AS q50, round(quantile_cont(volume, 0.75), 6) AS q75, round(max(volume), 6) AS high FROM li GROUP BY cond, stage"),
    ),
    "d31_occupancy": (
        _on("li", lambda r: _rounded(stages.occupancy(r, "cond", "stage"), "share")),
        oracle("li", "SELECT cond, stage, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY cond), 6) AS share FROM li GROUP BY cond, stage"),
    ),
    "d34_bounding_boxes": (_on("pixg", lambda p: zonal.bounding_boxes(p).drop("stack_id")), oracle("pixg", "SELECT frame, label, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM pixg WHERE label <> 0 GROUP BY frame, label")),
    "d36_tiles": (
        _on("stg", lambda s: _rounded(stats.tiles(s, 400.0), "z")),
        oracle("stg", f"SELECT CAST(floor(place / 4) AS BIGINT) AS colony, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(current_z), 6) AS z, {_TILE.format('x')} AS nx, {_TILE.format('y')} AS ny FROM stg GROUP BY 1"),
    ),
    "e01_velocity": (
        _on("trk", lambda t: _rounded(tracks.velocities(t).where("dt is not null").select("particle", "frame", "dx", "dy", "dt", "v", "theta"), "dx", "dy", "v", "theta")),
        oracle("trk", f"SELECT particle, frame, round(ex / dt, 6) AS dx, round(ey / dt, 6) AS dy, dt, round(sqrt(ex / dt * (ex / dt) + ey / dt * (ey / dt)), 6) AS v, round(atan2(ey / dt, ex / dt), 6) AS theta FROM ({_STEP}) s WHERE dt IS NOT NULL"),
    ),
    "e02_drift": (_on("trk", lambda t: _rounded(tracks.drift(t).drop("stack_id"), "dx", "dy")), oracle("trk", f"SELECT frame, round(dx, 6) AS dx, round(dy, 6) AS dy FROM ({_DRIFT}) d")),
    "e03_search_range": (_on("trk", lambda t: _rounded(tracks.search_range(t).drop("stack_id"), "search_range")), oracle("trk", f"SELECT round(quantile_cont(v, 0.97), 6) AS search_range FROM ({_SPEED}) s")),
    "e04_drop_stubs": (
        _on("trk", lambda t: tracks.drop_stubs(t, 55).select("particle", "frame", "x")),
        oracle("trk", "SELECT dense_rank() OVER (ORDER BY particle) - 1 AS particle, frame, x FROM (SELECT * FROM trk QUALIFY count(*) OVER (PARTITION BY particle) >= 55) t"),
    ),
    "e05_segments": (
        _on("trk", lambda t: tracks.segments(t).select("particle", "frame", "next_x", "next_y")),
        oracle("trk", f"SELECT particle, frame, nx AS next_x, ny AS next_y FROM (SELECT *, lead(x) OVER {_WT} AS nx, lead(y) OVER {_WT} AS ny, lead(frame) OVER {_WT} AS nf FROM trk) t WHERE nf = frame + 1"),
    ),
    "e06_trails": (
        _on("trk", lambda t: tracks.trails(t, 5).select("particle", "frame", F.size("trail").cast("long").alias("n"), F.col("trail")[0]["frame"].alias("oldest"))),
        oracle("trk", "SELECT particle, frame, count(*) OVER w AS n, first_value(frame) OVER w AS oldest FROM trk WINDOW w AS (PARTITION BY particle ORDER BY frame ROWS 4 PRECEDING)"),
    ),
    "e07_propagate": (_on("trk", lambda t: stages.propagate(t).select("particle", "frame", "cycle_stage")), oracle("trk", "SELECT particle, frame, max(cycle_stage) OVER (PARTITION BY particle ORDER BY frame ROWS UNBOUNDED PRECEDING) AS cycle_stage FROM trk")),
    "e08_impute": (
        _on("trk", lambda t: stages.impute(t).select("particle", "frame", "cycle_stage")),
        oracle(
            "trk",
            """SELECT particle, frame, coalesce(first_value(s IGNORE NULLS) OVER (PARTITION BY particle ORDER BY frame ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING), 0) AS cycle_stage
FROM (SELECT particle, frame, last_value(nullif(cycle_stage, 0) IGNORE NULLS) OVER (PARTITION BY particle ORDER BY frame ROWS 6 PRECEDING) AS s FROM trk) t""",
        ),
    ),
    "e09_smooth": (
        _on("trk", lambda t: stages.smooth(t).select("particle", "frame", "cycle_stage")),
        oracle(
            "trk",
            """SELECT particle, frame, CASE WHEN n0 >= greatest(n1, n2, n3) THEN 0 WHEN n1 >= greatest(n2, n3) THEN 1 WHEN n2 >= n3 THEN 2 ELSE 3 END AS cycle_stage FROM (
SELECT particle, frame, count(*) FILTER (cycle_stage = 0) OVER w AS n0, count(*) FILTER (cycle_stage = 1) OVER w AS n1, count(*) FILTER (cycle_stage = 2) OVER w AS n2, count(*) FILTER (cycle_stage = 3) OVER w AS n3
FROM trk WINDOW w AS (PARTITION BY particle ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) t""",
        ),
    ),
    "e10_runs": (_on("trk", lambda t: stages.runs(t).drop("stack_id")), oracle("trk", _RUNS.replace("SELECT particle, run,", "SELECT particle, CAST(run AS BIGINT) AS run,", 1))),
    "e13_subsequence": (
        _on("trk", lambda t: stages.subsequence(t, [1, 2, 3]).select("particle", "first_frame")),
        oracle("trk", f"SELECT particle, first_frame FROM (SELECT *, lead(cycle_stage) OVER (PARTITION BY particle ORDER BY run) AS s2, lead(cycle_stage, 2) OVER (PARTITION BY particle ORDER BY run) AS s3 FROM ({_RUNS}) r) t WHERE cycle_stage = 1 AND s2 = 2 AND s3 = 3"),
    ),
    "e15_problematic": (
        _on("trk", lambda t: stages.problematic(t).select("particle")),
        oracle("trk", f"SELECT DISTINCT particle FROM (SELECT particle, lead(cycle_stage) OVER {_WT} - cycle_stage AS s FROM trk) t WHERE s NOT IN (0, 1)"),
    ),
    "h05_split_tracks": (
        _on2("trk", "edit", lambda t, e: tracks.split(t, _edits(e, "split")).select("particle", "frame", "x")),
        oracle(
            "trk edit",
            """, cuts AS (SELECT e.particle, e.frame AS cut_at, row_number() OVER (ORDER BY e.particle) + (SELECT max(particle) FROM trk) AS new_id FROM edit e JOIN (SELECT particle, min(frame) AS f FROM trk GROUP BY particle) b ON b.particle = e.particle AND b.f < e.frame WHERE op = 'split')
SELECT CASE WHEN frame >= cut_at THEN new_id ELSE t.particle END AS particle, frame, x FROM trk t LEFT JOIN cuts c ON c.particle = t.particle""",
        ),
    ),
    "h07_renumber": (_on("trk", lambda t: tracks.renumber(t).select("particle", "frame", "x")), oracle("trk", "SELECT dense_rank() OVER (ORDER BY particle) - 1 AS particle, frame, x FROM trk")),
    "h11_raster_order": (
        _on("pixg", lambda p: zonal.raster_order(p).drop("stack_id")),
        oracle("pixg", "SELECT frame, label, row_number() OVER (PARTITION BY frame ORDER BY min(y * 64 + x)) AS new_label FROM pixg WHERE label <> 0 GROUP BY frame, label"),
    ),
    "h16_junctions": (
        _on("pix", lambda p: spatial.junctions(p).select("frame", "y", "x", F.size("cells").cast("long").alias("n_cells"))),
        oracle("pix", "SELECT frame, y + dy AS y, x + dx AS x, count(DISTINCT label) AS n_cells FROM pix CROSS JOIN (SELECT unnest([0, 1]) AS dy) CROSS JOIN (SELECT unnest([0, 1]) AS dx) GROUP BY 1, 2, 3 HAVING count(*) = 4 AND count(DISTINCT label) >= 3"),
    ),
    "a06_rescale": (
        _on("pix", lambda p: _rounded(lookups.rescale(p, "ch0").select("frame", "y", "x", "ch0"), "ch0")),
        oracle("pix", "SELECT frame, y, x, round(CASE WHEN hi > lo THEN (ch0 - lo) / (hi - lo) * 65535.0 ELSE 0.0 END, 6) AS ch0 FROM (SELECT *, min(ch0) OVER (PARTITION BY frame) AS lo, max(ch0) OVER (PARTITION BY frame) AS hi FROM pix) p"),
    ),
    "a07_ranges": (
        _on("edit", lambda e: lookups.expand_ranges(e.withColumn("spec", F.concat_ws("", "particle", F.lit("-"), "frame", F.lit(", "), F.col("frame") + 100)), "spec").select("particle", "index")),
        oracle("edit", "SELECT particle, unnest(CASE WHEN particle <= frame THEN range(particle, frame + 1) ELSE range(particle, frame - 1, -1) END) AS index FROM edit UNION ALL SELECT particle, frame + 100 FROM edit"),
    ),
    "b01_particle_of_cell": (
        _on("trk", lambda t: lookups.unique_lookup(t, ["frame", "cell_number"], "particle").drop("stack_id")),
        oracle("trk", "SELECT frame, cell_number, CASE WHEN count(DISTINCT particle) = 1 THEN min(particle) END AS particle, count(DISTINCT particle) AS n FROM trk GROUP BY frame, cell_number"),
    ),
    "b03_trajectories": (
        _on("trk", lambda t: lookups.trajectories(t).select("particle", F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["frame"], p["cell_number"])), ",").alias("path"))),
        oracle("trk", "SELECT particle, string_agg(frame || ':' || cell_number, ',' ORDER BY frame) AS path FROM trk GROUP BY particle"),
    ),
    "b04_along_tracks": (
        _on2("trk", "pixg", lambda t, p: lookups.along_tracks(t, zonal.areas(p), "area", -1.0).select("particle", "frame", "area")),
        oracle("trk pixg", "SELECT particle, t.frame, coalesce(area, -1.0) AS area FROM trk t LEFT JOIN (SELECT frame, label - 1 AS cell_number, CAST(count(*) AS DOUBLE) AS area FROM pixg WHERE label <> 0 GROUP BY ALL) a USING (frame, cell_number)"),
    ),
    "b13_clear_frames": (
        _on2("trk", "edit", lambda t, e: lookups.clear_frames(t, e.select("stack_id", "frame")).select("particle", "frame")),
        oracle("trk edit", "SELECT particle, frame FROM trk WHERE frame NOT IN (SELECT frame FROM edit)"),
    ),
    "b22_highlights": (
        _on("div", lambda t: _rounded(lookups.highlights(t, spatial.division_candidates(t, 20.0)).drop("stack_id"), "weight")),
        oracle(
            "div",
            """, ends AS (SELECT particle, max(frame) AS f, arg_max(x, frame) AS x, arg_max(y, frame) AS y FROM div GROUP BY particle), begins AS (SELECT particle, min(frame) AS f, arg_min(x, frame) AS x, arg_min(y, frame) AS y FROM div GROUP BY particle),
near AS (SELECT e.particle AS mother, b.particle AS daughter, b.f AS frame FROM ends e JOIN begins b ON b.f = e.f + 1 AND (e.x - b.x) * (e.x - b.x) + (e.y - b.y) * (e.y - b.y) < 400),
found AS (SELECT * FROM near QUALIFY count(*) OVER (PARTITION BY mother) >= 2),
marks AS (SELECT mother AS particle, frame, -1 AS way FROM found UNION SELECT daughter, frame, 1 FROM found)
SELECT m.particle, m.frame + way * d AS frame, way, round(1 - (d + 1) / 6.0::DOUBLE, 6) AS weight FROM marks m CROSS JOIN range(6) r(d) WHERE EXISTS (SELECT 1 FROM div t WHERE t.particle = m.particle AND t.frame = m.frame + way * d)""",
        ),
    ),
    "b25_scaled_heights": (
        _on("pix", lambda p: lookups.scaled_heights(p, 4.0, 1.5).select("frame", "y", "x", F.isnan("height").alias("missing"), F.nanvl("height", F.lit(-1.0)).alias("height"))),
        oracle("pix", "SELECT frame, y, x, h < -2 AS missing, CASE WHEN h < -2 THEN -1.0 WHEN h < 0 THEN 0.0 ELSE h END AS height FROM (SELECT frame, y, x, (height - 4.0::DOUBLE) * 1.5 AS h FROM pix) p"),
    ),
    "b28_paint": (
        _on("pixg", lambda p: lookups.paint(p, zonal.areas(p), "area").select("frame", "y", "x", "area")),
        oracle("pixg", "SELECT frame, y, x, CASE WHEN label <> 0 THEN CAST(count(*) OVER (PARTITION BY frame, label) AS DOUBLE) END AS area FROM pixg"),
    ),
    "c10_link_candidates": (
        _on("trk", lambda t: _rounded_fast(lookups.link_candidates(t, 12.0).drop("stack_id"), "distance")),
        oracle("trk", "SELECT frame, a, b, round(sqrt(d), 6) AS distance FROM (SELECT t.frame, t.cell_number AS a, u.cell_number AS b, (t.x - u.x) * (t.x - u.x) + (t.y - u.y) * (t.y - u.y) AS d FROM trk t JOIN trk u ON u.frame = t.frame + 1) p WHERE d <= 144"),
    ),
    "d16_nuclear_ratio": (
        _on("pixg", lambda p: _rounded(lookups.nuclear_ratio(p, "ch1").drop("stack_id"), "ratio")),
        oracle("pixg", "SELECT frame, label, round(median(ch1) / any_value(back), 6) AS ratio FROM pixg JOIN (SELECT frame, quantile_cont(ch1, 0.95) AS back FROM pixg WHERE label = 0 GROUP BY frame) b USING (frame) WHERE label <> 0 GROUP BY frame, label"),
    ),
    "d23_nori_density": (
        _on2("vox", "pixg", lambda v, p: _rounded(lookups.nori_densities(v, p, 10.0, scale=0.5, z_scale=2.0).drop("stack_id"), "density", "deviation", "mass")),
        oracle("vox pixg", "SELECT frame, label, round(avg(v), 6) AS density, round(stddev_pop(v), 6) AS deviation, round(sum(v) * 0.5, 6) AS mass FROM (SELECT p.frame, p.label, value / 8192.0 * 1.364256::DOUBLE AS v FROM vox JOIN pixg p USING (frame, y, x) WHERE value <> 10 AND p.label <> 0) t GROUP BY frame, label"),
    ),
    "d35_counts": (_on("trk", lambda t: lookups.counts(t).drop("stack_id")), oracle("trk", "SELECT count(DISTINCT particle) AS n_particles, count(*) AS n_cells FROM trk")),
    "e18_steepest_descent": (
        _on("vox", lambda v: lookups.steepest_descent(v).drop("stack_id")),
        oracle(
            "vox",
            """SELECT frame, y, x, min(z) AS surface FROM (SELECT *, min(g) OVER (PARTITION BY frame, y, x) AS least FROM (
SELECT frame, y, x, z, coalesce((lead(value) OVER w - lag(value) OVER w) / 2, lead(value) OVER w - value, value - lag(value) OVER w) AS g FROM vox WINDOW w AS (PARTITION BY frame, y, x ORDER BY z)) a) b WHERE g = least GROUP BY frame, y, x""",
        ),
    ),
    "e21_lifetimes": (
        _on("div", lambda t: lookups.lifetimes(t).drop("stack_id")),
        oracle("div", "SELECT particle, birth, death, n, birth <> 0 AS born, count(*) OVER (PARTITION BY birth) > 1 AS together FROM (SELECT particle, min(frame) AS birth, max(frame) AS death, count(*) AS n FROM div GROUP BY particle) t"),
    ),
    "b11_every_third_frame": (
        _on("trk", lambda t: tracks.substack(t, t.where("frame % 3 = 0").select("stack_id", "frame", (F.col("frame") / 3).cast("int").alias("place")).distinct()).select("particle", "frame", "x")),
        oracle("trk", "SELECT particle, frame // 3 AS frame, x FROM trk WHERE frame % 3 = 0"),
    ),
    "b27_combine_nuclear": (
        _on("pix", lambda p: _rounded(zonal.combine_nuclear(p, "ch1", "ch0").drop("stack_id"), "value")),
        oracle(
            "pix",
            """SELECT frame, y, x, round(CASE WHEN r1 > r0 THEN least(1.0, greatest(0.0, (ch1 - r0) / (r1 - r0))) ELSE 0 END + CASE WHEN g1 > g0 THEN least(1.0, greatest(0.0, (ch0 - g0) / (g1 - g0))) ELSE 0 END / 2, 6) AS value
FROM pix JOIN (SELECT frame, quantile_cont(ch1, 0.01) AS r0, quantile_cont(ch1, 0.99) AS r1, quantile_cont(ch0, 0.01) AS g0, quantile_cont(ch0, 0.99) AS g1 FROM pix GROUP BY frame) q USING (frame)""",
        ),
    ),
    "c05_daughter_pairs": (
        _on("div", lambda t: divisions.daughter_pairs(spatial.division_candidates(t, 20.0)).drop("stack_id")),
        oracle("div", f"{_CANDIDATES} {_PAIRS} SELECT mother, daughter1, daughter2, frame FROM pairs"),
    ),
    "c07_conflicts": (
        _on("div", lambda t: divisions.conflicts(divisions.daughter_pairs(spatial.division_candidates(t, 20.0))).drop("stack_id")),
        oracle(
            "div",
            f"""{_CANDIDATES} {_PAIRS} SELECT a.mother, a.daughter1, a.daughter2, b.mother AS other_mother, b.daughter1 AS other_daughter1, b.daughter2 AS other_daughter2
FROM pairs a JOIN pairs b ON (a.mother, a.daughter1, a.daughter2) < (b.mother, b.daughter1, b.daughter2)
AND (a.mother = b.mother OR a.daughter1 IN (b.daughter1, b.daughter2) OR a.daughter2 IN (b.daughter1, b.daughter2))""",
        ),
    ),
    "d28_weighted_histogram": (
        _on("li", lambda r: _rounded(stats.weighted_histogram(r, ["cond"], "volume", 30, 0.0, 120000.0), "share")),
        oracle(
            "li",
            """, b AS (SELECT cond, CAST(CASE WHEN volume = 120000 THEN 29 ELSE floor(volume / 4000) END AS BIGINT) AS bin, count(*) AS c FROM li WHERE volume BETWEEN 0 AND 120000 GROUP BY 1, 2),
m AS (SELECT cond, count(volume) AS n, quantile_cont(volume, 0.5) AS med FROM li GROUP BY cond) SELECT cond, bin, round(c / n, 6) AS share, floor(med / 4000) = bin AS has_median FROM b JOIN m USING (cond)""",
        ),
    ),
    "d29_kernel_density": (
        _on("li", lambda r: stats.kernel_density(r, ["cond"], "volume", 30, 0.0, 116000.0).select("cond", "i", F.round(F.col("density") * 1e4, 6).alias("density"))),
        oracle(
            "li",
            """, m AS (SELECT cond, count(*) AS n, stddev_samp(volume) * pow(count(*), -0.2) AS h FROM li GROUP BY cond)
SELECT cond, i, round(1e4 * sum(exp(-pow((i * 4000.0::DOUBLE - volume) / h, 2) / 2)) / any_value(n) / any_value(h) / sqrt(2 * pi()), 6) AS density FROM li JOIN m USING (cond) CROSS JOIN (SELECT CAST(range AS INT) AS i FROM range(30)) g GROUP BY cond, i""",
        ),
    ),
    "e11_mother_g2": (
        _on("trk", lambda t: stages.mother_g2(t).select("particle", "frame", "cycle_stage")),
        oracle(
            "trk",
            f"""SELECT t.particle, t.frame, CASE WHEN t.frame >= f.first_frame THEN 3 ELSE t.cycle_stage END AS cycle_stage FROM trk t LEFT JOIN (
SELECT particle, first_frame FROM (SELECT *, lag(cycle_stage) OVER (PARTITION BY particle ORDER BY run) AS before, lead(run) OVER (PARTITION BY particle ORDER BY run) AS nxt FROM ({_RUNS}) r) s
WHERE nxt IS NULL AND before = 3 AND cycle_stage = 2 AND length <= 6) f USING (particle)""",
        ),
    ),
    "e12_daughter_g1": (
        _on("trk", lambda t: stages.daughter_g1(t, 2).select("particle", "frame", "cycle_stage")),
        oracle(
            "trk",
            """, p AS (SELECT *, row_number() OVER (PARTITION BY particle ORDER BY frame) AS place FROM trk),
s AS (SELECT particle, min(place) AS stop, arg_min(cycle_stage, place) AS stage FROM p WHERE cycle_stage NOT IN (2, 3) GROUP BY particle)
SELECT particle, frame, CASE WHEN stage = 1 AND stop > 2 AND place < stop THEN 1 ELSE cycle_stage END AS cycle_stage FROM p LEFT JOIN s USING (particle)""",
        ),
    ),
    "e14_remove_sandwiched": (
        _on("trk", lambda t: stages.remove_sandwiched(t, (1, 3, 1)).select("particle", "frame", "cycle_stage")),
        oracle(
            "trk",
            f"""SELECT t.particle, t.frame, CASE WHEN f.particle IS NOT NULL THEN 1 ELSE t.cycle_stage END AS cycle_stage FROM trk t LEFT JOIN (SELECT particle, first_frame, stop FROM (
SELECT *, lag(cycle_stage) OVER w AS a, lead(cycle_stage) OVER w AS c, lag(length) OVER w + lead(length) OVER w AS outside, lead(first_frame) OVER w AS stop FROM ({_RUNS}) r WINDOW w AS (PARTITION BY particle ORDER BY run)) s
WHERE a = 1 AND cycle_stage = 3 AND c = 1 AND outside > length) f ON f.particle = t.particle AND t.frame >= f.first_frame AND t.frame < f.stop""",
        ),
    ),
    "e19_peak_heights": (
        _on("vox", lambda v: zonal.peak_heights(v.withColumn("value", (F.col("z") * 7 + F.col("y") * 3 + F.col("x") * 5) % 11 + F.lit(0.0)), 4.0).drop("stack_id")),
        oracle(
            "vox",
            """, v AS (SELECT frame, y, x, z, CAST((z * 7 + y * 3 + x * 5) % 11 AS DOUBLE) AS value FROM vox), n AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM v WINDOW w AS (PARTITION BY frame, y, x ORDER BY z))
SELECT frame, y, x, coalesce(max(CASE WHEN value > a AND value > b AND value - least(a, b) >= 4 THEN z END), 0) AS height FROM n GROUP BY frame, y, x""",
        ),
    ),
    "h17_good_cells": (
        _on("pixg", lambda p: spatial.good_cells(p).drop("stack_id")),
        oracle(
            "pixg",
            """, own AS (SELECT frame, y, x, label FROM pixg WHERE label <> 0), s(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
full_ AS (SELECT o.frame, o.y, o.x FROM own o CROSS JOIN s JOIN own q ON q.frame = o.frame AND q.y = o.y + dy AND q.x = o.x + dx GROUP BY 1, 2, 3 HAVING count(*) = 4),
bad AS (SELECT DISTINCT frame, label FROM own ANTI JOIN full_ USING (frame, y, x)),
corners AS (SELECT frame, y + dy AS y, x + dx AS x, label FROM own CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dy, dx)),
met AS (SELECT frame, y, x FROM corners GROUP BY 1, 2, 3 HAVING count(*) = 4 AND count(DISTINCT label) >= 3)
SELECT frame, label, n_junctions FROM (SELECT frame, label, count(*) AS n_junctions FROM (SELECT DISTINCT frame, y, x, label FROM corners JOIN met USING (frame, y, x)) d GROUP BY 1, 2 HAVING count(*) >= 3) g ANTI JOIN bad USING (frame, label)""",
        ),
    ),
    "i01_outline": (
        _on("pixg", lambda p: spatial.outline(p).drop("stack_id")),
        oracle(
            "pixg",
            """, s(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)),
inside AS (SELECT p.frame, p.y, p.x FROM pixg p CROSS JOIN s JOIN pixg q ON q.frame = p.frame AND q.y = p.y + dy AND q.x = p.x + dx AND q.label = p.label GROUP BY 1, 2, 3 HAVING count(*) = 4)
SELECT frame, y, x, label FROM pixg ANTI JOIN inside USING (frame, y, x) WHERE label <> 0""",
        ),
    ),
    "i05_pool": (_on("pix", lambda p: _rounded(zonal.pool(p, "ch0", 5).drop("stack_id"), "mean")), oracle("pix", "SELECT frame, y // 5 AS y, x // 5 AS x, round(avg(ch0), 6) AS mean FROM pix GROUP BY 1, 2, 3")),
    "i09_filled": (_on("pix", lambda p: zonal.filled(p).drop("stack_id")), oracle("vox", "SELECT frame, y, x, z FROM pix JOIN zs ON z < height")),
    "b02_cell_of_particle": (
        _on("trk", lambda t: lookups.unique_lookup(t, ["frame", "particle"], "cell_number").drop("stack_id")),
        oracle("trk", "SELECT frame, particle, CASE WHEN count(DISTINCT cell_number) = 1 THEN min(cell_number) END AS cell_number, count(DISTINCT cell_number) AS n FROM trk GROUP BY frame, particle"),
    ),
    "b05_tracking_rows": (_on2("trk", "edit", lambda t, e: lookups.rows_at(t, e, ["frame", "particle"]).select("particle", "frame", "x")), oracle("trk edit", "SELECT particle, frame, x FROM trk SEMI JOIN edit USING (particle, frame)")),
    "b09_set_stage": (
        _on2("trk", "edit", lambda t, e: lookups.set_stage(t, e.withColumn("stage", F.col("frame") % 3 + 1)).select("particle", "frame", "cycle_stage")),
        oracle("trk edit", "SELECT particle, t.frame, CASE WHEN t.frame >= e.frame THEN e.frame % 3 + 1 ELSE cycle_stage END AS cycle_stage FROM trk t LEFT JOIN edit e USING (particle)"),
    ),
    "b19_reorder_channels": (_on("pix", lambda p: lookups.reorder_channels(p, ["ch1", "ch0"]).select("frame", "y", "x", "ch0", "ch1")), oracle("pix", "SELECT frame, y, x, ch1 AS ch0, ch0 AS ch1 FROM pix")),
    "b20_labels_at": (
        _on2("trk", "pixg", lambda t, p: lookups.labels_at(t.select("stack_id", "particle", F.lit(0).alias("frame"), F.floor(F.col("y") / 10).cast("int").alias("y"), F.floor(F.col("x") / 8).cast("int").alias("x")), p).drop("stack_id")),
        oracle("trk pixg", "SELECT particle, 0 AS frame, t.y, t.x, label FROM (SELECT particle, CAST(floor(y / 10) AS INT) AS y, CAST(floor(x / 8) AS INT) AS x FROM trk) t LEFT JOIN (SELECT y, x, label FROM pixg WHERE frame = 0) p ON p.y = t.y AND p.x = t.x"),
    ),
    "c01_reconcile": (
        _on2("trk", "pixg", lambda t, p: tracks.reconcile(t, zonal.cells(p)).drop("stack_id")),
        oracle(
            "trk pixg",
            """, own AS (SELECT DISTINCT frame, label - 1 AS cell_number FROM pixg WHERE label <> 0), kept AS (SELECT particle, frame, cell_number FROM trk SEMI JOIN own USING (frame, cell_number)),
new AS (SELECT (SELECT max(particle) FROM trk) + row_number() OVER (ORDER BY frame, cell_number) AS particle, frame, cell_number FROM own ANTI JOIN kept USING (frame, cell_number))
SELECT dense_rank() OVER (ORDER BY particle) - 1 AS particle, frame, cell_number FROM (SELECT * FROM kept UNION ALL SELECT * FROM new) u""",
        ),
    ),
    "c02_drift_and_back": (_on("trk", lambda t: _rounded(tracks.add_drift(tracks.subtract_drift(t, tracks.drift(t)), tracks.drift(t)).select("particle", "frame", "x", "y"), "x", "y")), oracle("trk", "SELECT particle, frame, round(x, 6) AS x, round(y, 6) AS y FROM trk")),
    "d09_vertex_axis": (
        _on("poly", lambda v: _rounded(shape.vertex_axis(v).drop("stack_id"), "theta", "ratio")),
        oracle(
            "poly",
            """, m AS (SELECT frame, label, var_pop(px) AS xx, round(covar_pop(px, py), 9) + 0.0 AS xy, var_pop(py) AS yy FROM poly GROUP BY frame, label), s AS (SELECT *, sqrt((xx - yy) / 2 * ((xx - yy) / 2) + xy * xy) AS d, (xx + yy) / 2 AS h FROM m)
SELECT frame, label, round(atan2(2 * xy, round(xx - yy, 9) + 0.0) / 2, 6) AS theta, round(CASE WHEN h + d <> 0 THEN (h - d) / (h + d) END, 6) AS ratio FROM s""",
        ),
    ),
    "d10_perimeter_axis": (
        _on("poly", lambda v: _rounded(shape.perimeter_axis(v).drop("stack_id"), "theta", "ratio")),
        oracle(
            "poly",
            """, e AS (SELECT a.frame, a.label, a.px, a.py, b.px AS nx, b.py AS ny, sqrt((b.px - a.px) * (b.px - a.px) + (b.py - a.py) * (b.py - a.py)) AS l FROM poly a JOIN poly b ON a.frame = b.frame AND a.label = b.label AND b.k = (a.k + 1) % 6),
c AS (SELECT frame, label, sum((px + nx) / 2 * l) / sum(l) AS cx, sum((py + ny) / 2 * l) / sum(l) AS cy FROM e GROUP BY frame, label), z AS (SELECT e.frame, e.label, l, px - cx AS px, py - cy AS py, nx - cx AS nx, ny - cy AS ny FROM e JOIN c USING (frame, label)),
m AS (SELECT frame, label, sum(l * (nx * nx + px * px + nx * px) / 3) AS xx, round(sum(l * ((nx * ny + px * py) / 3 + (nx * py + px * ny) / 6)), 9) + 0.0 AS xy, sum(l * (ny * ny + py * py + ny * py) / 3) AS yy FROM z GROUP BY frame, label),
s AS (SELECT *, sqrt((xx - yy) / 2 * ((xx - yy) / 2) + xy * xy) AS d, (xx + yy) / 2 AS h FROM m) SELECT frame, label, round(atan2(2 * xy, round(xx - yy, 9) + 0.0) / 2, 6) AS theta, round(CASE WHEN h + d <> 0 THEN (h - d) / (h + d) END, 6) AS ratio FROM s""",
        ),
    ),
    "d32_range_parameters": (
        _on("li", lambda r: _rounded(stats.range_parameters(r, "volume"), "lo", "hi", "step")),
        oracle("li", "SELECT round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(min(g), 6) AS step FROM (SELECT volume AS v, volume - lag(volume) OVER (ORDER BY volume) AS g FROM (SELECT DISTINCT volume FROM li) d) t"),
    ),
    "d33_autocorrelation": (
        _on("trk", lambda t: _rounded(stats.autocorrelation(t, "cycle_stage", 40.0, 10).drop("stack_id"), "correlation", "error")),
        oracle(
            "trk",
            """, m AS (SELECT *, cycle_stage - avg(cycle_stage) OVER (PARTITION BY frame) AS c FROM trk), v AS (SELECT avg(vp) AS v FROM (SELECT var_pop(cycle_stage) AS vp FROM trk GROUP BY frame) t),
p AS (SELECT a.c * b.c AS c, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM m a JOIN m b ON a.frame = b.frame AND a.particle < b.particle)
SELECT CAST(least(floor(d / 4.0), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(c) / any_value(v), 6) AS correlation, round(stddev_pop(c) / sqrt(count(*)) / any_value(v), 6) AS error FROM p CROSS JOIN v WHERE d <= 40 GROUP BY 1""",
        ),
    ),
    "f02_sorted_vertices": (
        _on("poly", lambda v: shape.sort_vertices(v).select("frame", "label", F.col("k").cast("long").alias("k"), "px", "py")),
        oracle(
            "poly",
            "SELECT frame, label, row_number() OVER (PARTITION BY frame, label ORDER BY round(atan2(py - cy, px - cx), 9), py, px) - 1 AS k, px, py FROM (SELECT *, avg(px) OVER (PARTITION BY frame, label) AS cx, avg(py) OVER (PARTITION BY frame, label) AS cy FROM poly) p",
        ),
    ),
    "f05_keep_first": (_on("trk", lambda t: lookups.keep_first(t.select("frame", "cycle_stage", "particle", "x"), ["frame", "cycle_stage"], ["particle"])), oracle("trk", "SELECT frame, cycle_stage, min(particle) AS particle, arg_min(x, particle) AS x FROM trk GROUP BY frame, cycle_stage")),
    "g01_all_frames": (_on2("trk", "div", lambda t, d: t.select("particle", "frame", "x").unionByName(d.select("particle", "frame", "x"))), oracle("trk div", "SELECT particle, frame, x FROM trk UNION ALL SELECT particle, frame, x FROM div")),
    "g02_division_frames": (_on("div", lambda t: lookups.division_frames(t).select("frame")), oracle("div", "SELECT min(frame) AS frame FROM div GROUP BY particle INTERSECT SELECT max(frame) + 1 FROM div GROUP BY particle")),
    "g03_untracked_cells": (_on2("pixg", "trk", lambda p, t: lookups.untracked(zonal.cells(p), t).drop("stack_id")), oracle("pixg trk", "SELECT DISTINCT frame, label FROM pixg ANTI JOIN (SELECT frame, cell_number + 1 AS label FROM trk) t USING (frame, label) WHERE label <> 0")),
    "g04_shared_frames": (
        _on2("trk", "edit", lambda t, e: tracks.shared_frames(t, e.select("stack_id", F.col("particle").alias("first"), (F.col("particle") + 1).alias("second"))).drop("stack_id")),
        oracle("trk edit", "SELECT e.particle AS first, b.particle AS second, b.frame, a.particle IS NOT NULL AS both FROM edit e JOIN trk b ON b.particle = e.particle + 1 LEFT JOIN trk a ON a.particle = e.particle AND a.frame = b.frame"),
    ),
    "g05_label_counts": (_on("pixg", lambda p: p.groupBy("label").agg(F.count("*").alias("n"))), oracle("pixg", "SELECT label, count(*) AS n FROM pixg GROUP BY label")),
    "h06_merge_tracks": (
        _on2("trk", "edit", lambda t, e: tracks.merge(t, _edits(e, "merge").select("stack_id", F.col("particle").alias("first"), (F.col("particle") + 1).alias("second"), "frame")).select("particle", "frame", "x")),
        oracle(
            "trk edit",
            """, m AS (SELECT particle AS a, particle + 1 AS b, frame AS f, (SELECT max(particle) FROM trk) + row_number() OVER (ORDER BY particle) AS tail FROM edit WHERE op = 'merge')
SELECT dense_rank() OVER (ORDER BY p) - 1 AS particle, frame, x FROM (SELECT CASE WHEN t.particle = m.a AND t.frame >= m.f THEN m.tail WHEN n.b IS NOT NULL AND t.frame >= n.f THEN n.a ELSE t.particle END AS p, t.frame, x FROM trk t LEFT JOIN m ON m.a = t.particle LEFT JOIN m n ON n.b = t.particle) u""",
        ),
    ),
    "b17_tile_edges": (
        _on("pix", lambda p: zonal.remove_cells(p, zonal.tile_edge_cells(p, "ch1", 48, 64, 1)).select("frame", "y", "x", "label")),
        oracle(
            "pix",
            """, gone AS (SELECT DISTINCT p.frame, p.label FROM pix p LEFT JOIN (SELECT DISTINCT frame, y + dy AS y, x + dx AS x FROM pix CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) WHERE ch1 = 0) z USING (frame, y, x)
WHERE z.frame IS NOT NULL OR y IN (0, 47) OR x IN (0, 63)) SELECT frame, y, x, dense_rank() OVER (PARTITION BY frame ORDER BY label) AS label FROM pix ANTI JOIN gone USING (frame, label)""",
        ),
    ),
    "c06_division_features": (
        _on("divc", lambda t: _rounded(divisions.features(divisions.daughter_pairs(spatial.division_candidates(t, 20.0)), t).drop("stack_id"), *divisions.FEATURES)),
        oracle("divc", f"{_FEATURES} SELECT mother, daughter1, daughter2, frame, {', '.join(f'round({c}, 6) AS {c}' for c in divisions.FEATURES)} FROM f"),
    ),
    "c12_attached": (
        _on2("trk", "pixg", lambda t, p: _rounded(lookups.attach(t, zonal.areas(p).join(zonal.fraction_above(p, "ch1", 128.0), zonal.CELL)).select("particle", "frame", "area", "fraction"), "fraction")),
        oracle("trk pixg", "SELECT particle, t.frame, area, round(fraction, 6) AS fraction FROM trk t LEFT JOIN (SELECT frame, label - 1 AS cell_number, CAST(count(*) AS DOUBLE) AS area, avg(CAST(ch1 > 128 AS INT)) AS fraction FROM pixg WHERE label <> 0 GROUP BY ALL) a USING (frame, cell_number)"),
    ),
    "c14_other_labels": (
        _on("pixg", lambda p: zonal.with_labels(zonal.cells(p), zonal.edge_cells(p, 48, 64, 2), inside=False).select("frame", "y", "x", "label")),
        oracle("pixg", "SELECT frame, y, x, label FROM pixg WHERE label <> 0 AND (frame, label) NOT IN (SELECT frame, label FROM pixg WHERE y < 2 OR x < 2 OR y >= 46 OR x >= 62)"),
    ),
    "c15_cell_vertices": (_on("pixg", lambda p: spatial.cell_vertices(p).select("frame", "label", "px", "py")), oracle("pixg", f"{_GOOD} SELECT frame, label, px, py FROM vert")),
    "d11_junction_axis": (
        _on("pixg", lambda p: _rounded(shape.vertex_axis(spatial.cell_vertices(p)).drop("stack_id"), "theta", "ratio")),
        oracle(
            "pixg",
            f"""{_GOOD}, m AS (SELECT frame, label, var_pop(px) AS xx, round(covar_pop(px, py), 9) + 0.0 AS xy, var_pop(py) AS yy FROM vert GROUP BY frame, label), a AS (SELECT *, sqrt((xx - yy) / 2 * ((xx - yy) / 2) + xy * xy) AS d, (xx + yy) / 2 AS h FROM m)
SELECT frame, label, round(atan2(2 * xy, round(xx - yy, 9) + 0.0) / 2, 6) AS theta, round(CASE WHEN h + d <> 0 THEN (h - d) / (h + d) END, 6) AS ratio FROM a""",
        ),
    ),
    "d12_shape_parameters": (
        _on("pixg", lambda p: _rounded(shape.shape_parameters(spatial.cell_vertices(p)).drop("stack_id"), "area", "perimeter", "q")),
        oracle(
            "pixg",
            f"""{_GOOD}, m AS (SELECT *, avg(px) OVER (PARTITION BY frame, label) AS cx, avg(py) OVER (PARTITION BY frame, label) AS cy FROM vert), o AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY frame, label) AS n FROM m WINDOW w AS (PARTITION BY frame, label ORDER BY round(atan2(py - cy, px - cx), 9), py, px)),
g AS (SELECT a.frame, a.label, abs(sum(a.px * b.py - b.px * a.py)) / 2 AS area, sum(sqrt((b.px - a.px) * (b.px - a.px) + (b.py - a.py) * (b.py - a.py))) AS perimeter FROM o a JOIN o b ON a.frame = b.frame AND a.label = b.label AND b.k = a.k % a.n + 1 GROUP BY 1, 2)
SELECT frame, label, round(area, 6) AS area, round(perimeter, 6) AS perimeter, round(CASE WHEN area <> 0 THEN perimeter / sqrt(area) END, 6) AS q FROM g""",
        ),
    ),
    "d17_snapshot_stages": (_on("pixg", lambda p: stages.snapshot(p, "ch0", "ch1", 60.0, 160.0).drop("stack_id")), oracle("pixg", _SNAPSHOT.format(0.15))),
    "d18_batch_stages": (_on("pixg", lambda p: stages.snapshot(p, "ch0", "ch1", 60.0, 160.0, orange_share=0.225).drop("stack_id")), oracle("pixg", _SNAPSHOT.format(0.225))),
    "d19_nuclear_stages": (
        _on("pixg", lambda p: stages.from_nuclei(lookups.nuclear_ratio(p, "ch0"), lookups.nuclear_ratio(p, "ch1"), 0.5, 0.6).drop("stack_id")),
        oracle(
            "pixg",
            "SELECT frame, label, CASE WHEN median(ch0) / any_value(b0) > 0.5 THEN 1 ELSE 0 END + CASE WHEN median(ch1) / any_value(b1) > 0.6 THEN 2 ELSE 0 END AS cycle_stage FROM pixg JOIN (SELECT frame, quantile_cont(ch0, 0.95) AS b0, quantile_cont(ch1, 0.95) AS b1 FROM pixg WHERE label = 0 GROUP BY frame) b USING (frame) WHERE label <> 0 GROUP BY frame, label",
        ),
    ),
    "f06_correlation_length": (
        _on("trk", lambda t: stats.first_below(stats.autocorrelation(t, "cycle_stage", 40.0, 10), "correlation", 0.0, ["stack_id"]).drop("stack_id")),
        oracle(
            "trk",
            """, m AS (SELECT *, cycle_stage - avg(cycle_stage) OVER (PARTITION BY frame) AS c FROM trk), v AS (SELECT avg(vp) AS v FROM (SELECT var_pop(cycle_stage) AS vp FROM trk GROUP BY frame) t),
p AS (SELECT a.c * b.c AS c, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM m a JOIN m b ON a.frame = b.frame AND a.particle < b.particle),
h AS (SELECT CAST(least(floor(d / 4.0), 9) AS BIGINT) AS bin, avg(c) / any_value(v) AS r FROM p CROSS JOIN v WHERE d <= 40 GROUP BY 1) SELECT min(CASE WHEN r < 0 THEN bin END) AS first_below, arg_max(bin, r) AS peak FROM h""",
        ),
    ),
    "h01_components": (
        _on("pixg", lambda p: components.label_components(p).select("frame", "y", "x", (F.col("cy") * 64 + F.col("cx")).alias("first"))),
        oracle(
            "pixg",
            """, s(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)), e AS MATERIALIZED (SELECT p.frame, p.y * 64 + p.x AS a, q.y * 64 + q.x AS b FROM pixg p CROSS JOIN s JOIN pixg q ON q.frame = p.frame AND q.y = p.y + dy AND q.x = p.x + dx AND q.label = p.label),
r AS (SELECT frame, y * 64 + x AS n, y * 64 + x AS c FROM pixg UNION SELECT r.frame, e.b, r.c FROM r JOIN e ON e.frame = r.frame AND e.a = r.n WHERE r.c < e.b) SELECT frame, CAST(n // 64 AS INT) AS y, CAST(n % 64 AS INT) AS x, min(c) AS first FROM r GROUP BY frame, n""",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
    ),
    "h08_merge_cells": (
        _on("pix", lambda p: zonal.merge_cells(p, p.select("stack_id", "frame", (F.col("frame") % 20 + 1).alias("first"), (F.col("frame") % 20 + 2).alias("second")).distinct()).select("frame", "y", "x", "label")),
        oracle("pix", "SELECT frame, y, x, dense_rank() OVER (PARTITION BY frame ORDER BY CASE WHEN label = frame % 20 + 2 THEN frame % 20 + 1 ELSE label END) AS label FROM pix"),
    ),
    "h13_scores": (
        _on("divc", lambda t: _rounded(_scored(t).select("mother", "daughter1", "daughter2", "score"), "score")),
        oracle("divc", f"{_FEATURES} SELECT mother, daughter1, daughter2, round(score, 6) AS score FROM sc"),
    ),
    # in these tables only pairs of one mother conflict, so that the best choice is the best pair of each
    "h14_divisions": (
        _on("divc", lambda t: _rounded(divisions.choose(_scored(t), 12.0).select("mother", "daughter1", "daughter2", "frame", "score"), "score")),
        oracle("divc", f"{_FEATURES} SELECT mother, daughter1, daughter2, frame, round(score, 6) AS score FROM sc WHERE score < 12 QUALIFY row_number() OVER (PARTITION BY mother ORDER BY score, daughter1, daughter2) = 1"),
    ),
    "a01_stack_frames": (_on("files", lambda f: files.stack_frames(f, 3)), oracle("files", f"{_PLACED} SELECT stack_id, path, CAST(n // 3 AS INT) AS frame FROM placed WHERE n % 3 = 0")),
    "a15_export": (
        _on("trk", lambda t: _rounded(t.join(tracks.velocities(t).select("stack_id", "particle", "frame", "v"), ["stack_id", "particle", "frame"], "left").select("particle", "frame", "cell_number", "x", "y", "cycle_stage", "v"), "v")),
        oracle("trk", f"SELECT particle, frame, cell_number, x, y, cycle_stage, round(sqrt(ex / dt * (ex / dt) + ey / dt * (ey / dt)), 6) AS v FROM ({_STEP}) s"),
    ),
    "a17_outline_text": (
        _on("poly", lambda v: planes.outline_text(v).drop("stack_id")),
        oracle("poly", "SELECT frame, label, 'POLYGON ((' || string_agg(px || ' ' || py, ', ' ORDER BY k) || ', ' || min_by(px || ' ' || py, k) || '))' AS outline FROM poly GROUP BY frame, label"),
    ),
    "a18_blank": (_on("pix", lambda p: planes.blank(p).select("frame", "y", "x", "label")), oracle("pix", "SELECT frame, y, x, 0 AS label FROM pix")),
    "a19_attach_images": (
        _on("files", lambda f: files.attach_images(files.stack_frames(f, 4).select("stack_id", "frame"), f.where("lower(path) like '%tif'"))),
        oracle("files", f"{_PLACED}, tifs AS (SELECT stack_id, path, row_number() OVER (PARTITION BY stack_id ORDER BY k, path) - 1 AS i FROM placed WHERE path ILIKE '%tif') SELECT p.stack_id, CAST(n // 4 AS INT) AS frame, t.path AS image FROM placed p LEFT JOIN tifs t ON t.stack_id = p.stack_id AND t.i = n // 4 WHERE n % 4 = 0"),
    ),
    "a20_route": (
        _on("files", files.route),
        oracle(
            "files",
            f"""{_PLACED}, kinds AS (SELECT *, CASE WHEN path LIKE '%seg.npy' THEN 'seg' WHEN regexp_matches(lower(path), '(tif|tiff|nd2)$') THEN 'image' WHEN path LIKE '%tracking.csv' THEN 'tracking' END AS kind FROM placed)
SELECT stack_id, path, kind, CASE kind WHEN 'seg' THEN true WHEN 'image' THEN count(*) FILTER (WHERE kind = 'seg') OVER (PARTITION BY stack_id) = 0 WHEN 'tracking' THEN path = arg_max(CASE WHEN kind = 'tracking' THEN path END, CASE WHEN kind = 'tracking' THEN n END) OVER (PARTITION BY stack_id) ELSE false END AS used FROM kinds""",
        ),
    ),
    "b15_add_cells": (
        _on2("pixg", "drawn", lambda p, d: planes.add_cells(p, d, 5).select("frame", "y", "x", "label")),
        oracle(
            "pixg drawn",
            """, free AS (SELECT frame, y, x, min(cell) AS cell FROM drawn SEMI JOIN (SELECT frame, y, x FROM pixg WHERE label = 0) b USING (frame, y, x) GROUP BY frame, y, x),
sizes AS (SELECT frame, cell, row_number() OVER (PARTITION BY frame ORDER BY cell) AS place FROM free GROUP BY frame, cell HAVING count(*) >= 5), top AS (SELECT frame, max(label) AS top FROM pixg GROUP BY frame)
SELECT frame, y, x, coalesce(top + place, label) AS label FROM pixg LEFT JOIN free USING (frame, y, x) LEFT JOIN sizes USING (frame, cell) LEFT JOIN top USING (frame)""",
        ),
    ),
    "b23_before_and_after": (
        _on("trk", lambda t: tracks.shown(t, 25, before=True).select("particle", "frame", "x").withColumn("part", F.lit("before")).union(tracks.shown(t, 25, before=False).select("particle", "frame", "x").withColumn("part", F.lit("after")))),
        oracle("trk", "SELECT particle, frame, x, CASE WHEN frame < 25 THEN 'before' ELSE 'after' END AS part FROM trk"),
    ),
    "c11_nearest": (
        _on("pixg", lambda p: planes.nearest_labels(p).drop("stack_id")),
        oracle("pixg", """SELECT h.frame, h.y, h.x, arg_min(p.label, ((p.y - h.y) * (p.y - h.y) + (p.x - h.x) * (p.x - h.x)) * 10000 + p.y * 100 + p.x) AS label
FROM pixg h JOIN pixg p ON p.frame = h.frame WHERE h.label = 0 AND p.label <> 0 GROUP BY h.frame, h.y, h.x"""),
    ),
    "f01_natural_key": (_on("files", lambda f: f.select("path", files.natural_key(F.col("path")).alias("key"))), oracle("files", f"SELECT path, {_KEY} AS key FROM files")),
    "d14_blurred_percentile": (
        _on("pixg", lambda p: planes.blurred_intensity(p, "ch0", 48, 64, 0.8).drop("stack_id")),
        oracle("pixg", f"{_BLUR_STEPS}, blurred AS (SELECT{_BLUR_SUM}) SELECT frame, label, CAST(trunc(quantile_cont(value, 0.9)) AS INT) AS value FROM blurred JOIN pixg USING (frame, y, x) WHERE label <> 0 GROUP BY frame, label"),
    ),
    "f03_ordered": (
        _on("trk", lambda t: tracks.ordered(t).select("particle", "frame", "place").join(tracks.ordered(t, by_particle=True).select("particle", "frame", F.col("place").alias("place_by_particle")), ["particle", "frame"])),
        oracle("trk", "SELECT particle, frame, row_number() OVER (ORDER BY frame, particle) - 1 AS place, row_number() OVER (ORDER BY particle, frame) - 1 AS place_by_particle FROM trk"),
    ),
    "h04_linked": (
        _on("div", lambda t: _rounded(linking.track(_moving(t, 1.0), 3.0, 1.5).select("particle", "frame", "cell_number", "x"), "x")),
        oracle("div", "SELECT dense_rank() OVER (ORDER BY begin, cell_number) - 1 AS particle, frame, cell_number, round(x, 6) AS x FROM (SELECT particle AS cell_number, frame, x + frame AS x, min(frame) OVER (PARTITION BY particle) AS begin FROM div) t"),
    ),
    "h04_linked_over_gaps": (
        _on("div", lambda t: linking.link(_moving(t, 0.0).where("(frame + cell_number) % 7 <> 0"), 1.2, memory=1).select("particle", "frame", "cell_number")),
        oracle("div", "SELECT dense_rank() OVER (ORDER BY begin, cell_number) - 1 AS particle, frame, cell_number FROM (SELECT particle AS cell_number, frame, min(frame) OVER (PARTITION BY particle) AS begin FROM div WHERE (frame + particle) % 7 <> 0) t"),
    ),
    "i02_filled_outlines": (
        _on("poly", lambda v: contours.fill(v).drop("stack_id")),
        oracle(
            "poly",
            """, e AS (SELECT a.frame, a.label, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM poly a JOIN poly b ON a.frame = b.frame AND a.label = b.label AND b.k = (a.k + 1) % 6),
s AS (SELECT frame, label, CAST(min(px) AS INT) AS x0, CAST(max(px) AS INT) AS x1, CAST(min(py) AS INT) AS y0, CAST(max(py) AS INT) AS y1 FROM poly GROUP BY frame, label),
g AS (SELECT frame, label, y, unnest(range(x0, x1 + 1)) AS x FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM s) r)
SELECT frame, label, y, x FROM g JOIN e USING (frame, label) GROUP BY frame, label, y, x HAVING min((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) >= 0""",
        ),
    ),
    "i04_background_subtracted": (
        _on("pixg", lambda p: _rounded(planes.background_subtracted(p, "ch0", 48, 64, bin_size=16, sigma=0).drop("stack_id"), "value")),
        oracle(
            "pixg",
            """, blocks AS (SELECT frame, y // 16 AS gy, x // 16 AS gx, avg(ch0) AS mean FROM pixg WHERE label = 0 GROUP BY ALL),
            frames AS (SELECT frame, stddev_pop(ch0) AS spread, coalesce(avg(ch0) FILTER (label = 0), 0) AS level FROM pixg GROUP BY frame),
            placed AS (SELECT *, CAST(floor(fy) AS INT) AS y0, CAST(floor(fx) AS INT) AS x0 FROM (
              SELECT frame, y, x, ch0, least(greatest((y + 0.5) / 16 - 0.5, 0), 2) AS fy, least(greatest((x + 0.5) / 16 - 0.5, 0), 3) AS fx FROM pixg)),
            corners AS (SELECT frame, y, x, sum((CASE dy WHEN 1 THEN fy - y0 ELSE 1 - fy + y0 END) * (CASE dx WHEN 1 THEN fx - x0 ELSE 1 - fx + x0 END) * coalesce(mean, level)) AS back
              FROM placed CROSS JOIN range(2) a(dy) CROSS JOIN range(2) b(dx) JOIN frames USING (frame)
              LEFT JOIN blocks ON blocks.frame = placed.frame AND gy = least(y0 + dy, 2) AND gx = least(x0 + dx, 3) GROUP BY ALL)
            SELECT frame, y, x, round(greatest(ch0 - back + spread, 0), 6) AS value FROM pixg JOIN corners USING (frame, y, x) JOIN frames USING (frame)""",
        ),
    ),
    "i03_blur": (_on("pix", lambda p: _rounded(planes.blur(p, "ch0", 48, 64, 0.8).drop("stack_id"), "value")), oracle("pix", _BLUR)),
}


def _owned(pixels: DataFrame) -> DataFrame:
    """Each label as a track."""
    return zonal.cells(pixels).groupBy("stack_id", "frame", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y")).select("stack_id", "frame", F.col("label").cast("long").alias("particle"), (F.col("label") - 1).alias("cell_number"), "x", "y")


def _families(tracks_: DataFrame) -> DataFrame:
    """A division of each track number divisible by 5, from the two that follow."""
    return tracks_.where("particle % 5 = 0").groupBy("stack_id", F.col("particle").alias("mother")).agg(F.min("frame").alias("frame")).select("stack_id", "mother", (F.col("mother") + 1).alias("daughter1"), (F.col("mother") + 2).alias("daughter2"), "frame")


def _gappy(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("label", F.when((F.col("label") % 4 == 1) & (F.col("frame") % 3 == 0), 0).otherwise(F.col("label")))


def _deleted_cells(pixels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = zonal.cells(pixels).where("label % 5 = frame % 5 or label = 12").select("stack_id", "frame", "label").distinct()
    return masks.delete_cells(pixels, _owned(pixels), _families(_owned(pixels)), gone)


def _merged_tracks(pixels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gappy = _gappy(pixels)
    pairs = gappy.where("label % 4 = 1").select("stack_id", F.col("label").cast("long").alias("first"), (F.col("label") + 1).cast("long").alias("second")).distinct()
    return masks.merge_track_masks(gappy, _owned(gappy), _families(_owned(gappy)), pairs)


def _without_frames(t: DataFrame, part: int) -> DataFrame:
    gone = t.where("frame % 10 = 3").select("stack_id", "frame").distinct()
    return masks.delete_frames(t, _families(t), tracks.drift(t), gone)[part].drop("stack_id")


def _cuts(pixels: DataFrame) -> DataFrame:
    """Two lines over each frame."""
    f = F.col("frame")
    vertex = lambda cut, k, y, x: F.struct(F.lit(cut).alias("cut"), F.lit(k).alias("k"), y.cast("int").alias("y"), x.cast("int").alias("x"))
    lines = F.array(vertex(0, 0, F.lit(0), 5 + f % 7), vertex(0, 1, F.lit(20), F.lit(30)), vertex(0, 2, F.lit(47), 40 + f % 11), vertex(1, 0, f % 48, F.lit(0)), vertex(1, 1, F.lit(30), F.lit(63)))
    return pixels.select("stack_id", "frame").distinct().select("stack_id", "frame", F.explode(lines).alias("v")).select("stack_id", "frame", "v.*")


def _xml(stg: DataFrame) -> DataFrame:
    """A description of a stack for each place."""
    size = lambda name, c, m: F.concat(F.lit(f' {name}="'), (F.col(c) % m + 1).cast("string"), F.lit('"'))
    inner = F.concat(F.lit('<Pixels DimensionOrder="XYCZT"'), size("SizeT", "place", 7), size("SizeZ", "x", 5), F.lit(' SizeC="2"'), size("SizeY", "y", 64), size("SizeX", "x", 48), F.lit("/>"))
    return stg.select("place", F.concat(F.lit('<?xml version="1.0"?><OME xmlns="u"><Image><Pixels SizeT="99"/></Image><Image>'), inner, F.lit("</Image></OME>")).alias("xml"))


def _stage_file(stg: DataFrame) -> DataFrame:
    """Positions written as lines under a header, and read back."""
    written = positions.lines(stg.withColumns({"file": F.lit("a"), "position": F.concat(F.lit("P"), "place")})).withColumn("place", F.col("place") + positions.HEADER + 1)
    return positions.parsed(written).select((F.col("place") - 1).alias("place"), "position", "x", "y", F.col("current_z"), "AF_offset", "starting_z", F.col("TRUE_1").alias("flag"))


_SHIFTED = "frame - (SELECT count(*) FROM (SELECT DISTINCT frame AS g FROM trk WHERE frame % 10 = 3) d WHERE g < {0}.frame)"
_FAMILY = "SELECT particle AS mother, min(frame) AS frame, particle + 1 AS daughter1, particle + 2 AS daughter2 FROM {0} WHERE particle % 5 = 0 GROUP BY particle"
CATALOG |= {
    "b14_deleted_cells_tracks": (
        _on("pix", lambda p: _rounded(_deleted_cells(p)[1].drop("stack_id"), "x", "y")),
        oracle("pix", """SELECT frame, CAST(label AS BIGINT) AS particle, row_number() OVER (PARTITION BY frame ORDER BY label) - 1 AS cell_number, round(avg(x), 6) AS x, round(avg(y), 6) AS y
FROM pix WHERE NOT (label % 5 = frame % 5 OR label = 12) GROUP BY frame, label"""),
    ),
    "b14_deleted_cells_divisions": (
        _on("pix", lambda p: _deleted_cells(p)[2].drop("stack_id")),
        oracle("pix", f""", own AS (SELECT DISTINCT frame, CAST(label AS BIGINT) AS particle FROM pix), kept AS (SELECT DISTINCT particle FROM own WHERE NOT (particle % 5 = frame % 5 OR particle = 12)), lost AS (SELECT DISTINCT particle FROM own ANTI JOIN kept USING (particle))
SELECT * FROM ({_FAMILY.format("own")}) f WHERE mother NOT IN (FROM lost) AND daughter1 NOT IN (FROM lost) AND daughter2 NOT IN (FROM lost)"""),
    ),
    "h09_merged_track_masks": (
        _on("pix", lambda p: _merged_tracks(p)[0].select("frame", "y", "x", "label")),
        oracle("pix", """, gappy AS (SELECT frame, y, x, CASE WHEN label % 4 = 1 AND frame % 3 = 0 THEN 0 ELSE label END AS label FROM pix), firsts AS (SELECT DISTINCT label FROM gappy WHERE label % 4 = 1),
merged AS (SELECT g.frame, y, x, CASE WHEN g.label % 4 = 2 AND EXISTS (SELECT 1 FROM gappy o WHERE o.frame = g.frame AND o.label = g.label - 1) THEN g.label - 1 ELSE g.label END AS label FROM gappy g)
SELECT frame, y, x, CASE WHEN label = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY frame, label = 0 ORDER BY label) END AS label FROM merged"""),
    ),
    "h09_merged_tracks": (
        _on("pix", lambda p: _rounded(_merged_tracks(p)[1].drop("stack_id"), "x", "y")),
        oracle("pix", """, gappy AS (SELECT * FROM pix WHERE NOT (label % 4 = 1 AND frame % 3 = 0)), firsts AS (SELECT DISTINCT label FROM gappy WHERE label % 4 = 1),
owned AS (SELECT frame, y, x, label, CASE WHEN label % 4 = 2 AND label - 1 IN (FROM firsts) THEN label - 1 ELSE label END AS particle FROM gappy)
SELECT frame, CAST(particle AS BIGINT) AS particle, row_number() OVER (PARTITION BY frame ORDER BY min(label)) - 1 AS cell_number, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM owned GROUP BY frame, particle"""),
    ),
    "a05_sizes": (
        _on("stg", lambda s: positions.sizes(_xml(s), "xml").drop("xml")),
        oracle("stg", "SELECT place, CAST(place % 7 + 1 AS INT) AS t, CAST(x % 5 + 1 AS INT) AS z, 2 AS c, CAST(y % 64 + 1 AS INT) AS height, CAST(x % 48 + 1 AS INT) AS width, 'XYCZT' AS dimension_order FROM stg"),
    ),
    "a06_subset": (
        _on("vox", lambda v: positions.subset(v, {"frame": [1, 0], "z": [4, 2, 4]}).drop("stack_id")),
        oracle("vox", "SELECT t.i AS frame, s.i AS z, y, x, value FROM vox JOIN (VALUES (0, 1), (1, 0)) t(i, was) ON frame = t.was JOIN (VALUES (0, 4), (1, 2), (2, 4)) s(i, was) ON z = s.was"),
    ),
    "a13_densities": (
        _on2("stk", "pixg", lambda v, p: _rounded(stacks.densities(v.select("stack_id", "frame", "z", "y", "x", F.col("value").alias("protein"), (F.col("value") * 2).alias("lipid")), p.select("stack_id", "frame", "y", "x", F.when(F.col("label") == 0, F.lit(float("nan"))).otherwise(F.col("height")).alias("height"))).drop("stack_id"), "protein", "lipid").where("not isnan(protein)")),
        oracle("stk pixg", "SELECT frame, z, y, x, round(value / 8192 * 1.364256::DOUBLE, 6) AS protein, round(value * 2 / 8192 * 1.010101::DOUBLE, 6) AS lipid FROM stk SEMI JOIN (SELECT frame, y, x FROM pixg WHERE label <> 0) p USING (frame, y, x)"),
    ),
    "a21_positions": (
        _on("stg", _stage_file),
        oracle("stg", "SELECT place, concat('P', place) AS position, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(current_z, 2) AS current_z, 0 AS \"AF_offset\", 0.0::DOUBLE AS starting_z, 'TRUE' AS flag FROM stg"),
    ),
    "b06_set_attributes": (
        _on("pixg", lambda p: stacks.set_attributes(zonal.areas(p), zonal.volumes(p.where("frame % 2 = 0")).select("stack_id", "frame", "label", F.col("mean_height").alias("area"), "volume")).drop("stack_id")),
        oracle("pixg", "SELECT frame, label, CASE WHEN frame % 2 = 0 THEN avg(height) ELSE count(*) END AS area, CASE WHEN frame % 2 = 0 THEN CAST(sum(height) AS DOUBLE) END AS volume FROM pixg WHERE label <> 0 GROUP BY frame, label"),
    ),
    "d36_tile_positions": (
        _on("stg", lambda s: _rounded(positions.tiles(s, [], 400.0, 500.0), "z")),
        oracle("stg", """, box AS (SELECT CAST(floor(place / 4) AS BIGINT) AS colony, min(x) AS x0, min(y) AS y0, avg(current_z) AS z, CAST(ceil((max(x) - min(x)) / 400.0) - 1 AS INT) AS nx, CAST(ceil((max(y) - min(y)) / 500.0) - 1 AS INT) AS ny FROM stg GROUP BY 1),
g AS (SELECT *, unnest(range(1, nx + 1)) AS i FROM (SELECT *, unnest(range(1, ny + 1)) AS j FROM box) b)
SELECT colony, row_number() OVER (PARTITION BY colony ORDER BY j, CASE WHEN j % 2 = 0 THEN -i ELSE i END) - 1 AS n, x0 + i * 400.0::DOUBLE AS x, y0 + j * 500.0::DOUBLE AS y, round(z, 6) AS z FROM g"""),
    ),
    "d27_frame_histograms": (
        _on("pix", lambda p: _rounded(stats.group_histograms(p, ["stack_id", "frame"], "ch0").drop("stack_id"), "start", "density")),
        oracle(
            "pix",
            """, q AS (SELECT frame, min(ch0) AS lo, max(ch0) AS hi, count(*) AS n, 2 * (quantile_cont(ch0, 0.75) - quantile_cont(ch0, 0.25)) / pow(count(*), 1.0 / 3) AS w FROM pix GROUP BY frame), b AS (SELECT frame, lo, n, ceil((hi - lo) / w) AS bins, (hi - lo) / ceil((hi - lo) / w) AS width FROM q)
SELECT frame, CAST(least(floor((ch0 - lo) / width), bins - 1) AS BIGINT) AS bin, count(*) AS count, round(any_value(lo) + CAST(least(floor((ch0 - lo) / width), bins - 1) AS BIGINT) * any_value(width), 6) AS start, round(count(*) / (any_value(n) * any_value(width)), 6) AS density FROM pix JOIN b USING (frame) GROUP BY 1, 2""",
        ),
    ),
    "d33_stack_autocorrelation": (
        _on("trk", lambda t: _rounded(stats.autocorrelation(t, "cycle_stage", 40.0, 10, by_frame=False).drop("stack_id"), "correlation", "error")),
        oracle(
            "trk",
            """, m AS (SELECT *, cycle_stage - avg(cycle_stage) OVER () AS c FROM trk), v AS (SELECT var_pop(cycle_stage) AS v FROM trk),
p AS (SELECT a.c * b.c AS c, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM m a JOIN m b ON a.frame = b.frame AND a.particle < b.particle)
SELECT CAST(least(floor(d / 4.0), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(c) / any_value(v), 6) AS correlation, round(stddev_pop(c) / sqrt(count(*)) / any_value(v), 6) AS error FROM p CROSS JOIN v WHERE d <= 40 GROUP BY 1""",
        ),
    ),
    "b04_set_along": (
        _on("trk", lambda t: lookups.set_along(t, "x", t.where("(particle + frame) % 6 = 0").select("stack_id", "particle", "frame", F.when(F.col("frame") % 4 != 0, F.col("y")).alias("value"))).select("particle", "frame", "x")),
        oracle("trk", "SELECT particle, frame, CASE WHEN (particle + frame) % 6 <> 0 THEN x WHEN frame % 4 <> 0 THEN y END AS x FROM trk"),
    ),
    "b18_rotated_points": (
        _on("trk", lambda t: zonal.rotate_points(t, 500, 400, 1).select("particle", "frame", "x", "y").withColumn("turns", F.lit(1)).union(zonal.rotate_points(t, 500, 400, 3).select("particle", "frame", "x", "y").withColumn("turns", F.lit(3)))),
        oracle("trk", "SELECT particle, frame, y AS x, 399 - x AS y, 1 AS turns FROM trk UNION ALL SELECT particle, frame, 499 - y AS x, x AS y, 3 AS turns FROM trk"),
    ),
    "b18_rotated_drift": (
        _on("trk", lambda t: _rounded(zonal.rotate_drift(tracks.drift(t), 1).select("frame", "dx", "dy"), "dx", "dy")),
        oracle("trk", f"SELECT frame, round(dy, 6) AS dx, round(-dx, 6) AS dy FROM ({_DRIFT}) d"),
    ),
    "c03_unmatched": (
        _on2("nuc", "pixg", lambda n, p: zonal.unmatched(n, p).drop("stack_id")),
        oracle("nuc pixg", """, hit AS (SELECT n.frame, label, min(nuc) AS nuc FROM nuc n JOIN pixg p ON p.frame = n.frame AND p.y = round_even(cy, 0) AND p.x = round_even(cx, 0) WHERE label <> 0 GROUP BY n.frame, label)
SELECT frame, 'nucleus' AS kind, CAST(nuc AS BIGINT) AS id FROM nuc ANTI JOIN hit USING (frame, nuc) UNION ALL SELECT frame, 'cell', CAST(label AS BIGINT) FROM (SELECT DISTINCT frame, label FROM pixg WHERE label <> 0) c ANTI JOIN hit USING (frame, label)"""),
    ),
    "b10_deleted_frames": (
        _on("trk", lambda t: _without_frames(t, 0).select("particle", "frame", "x")),
        oracle("trk", f"SELECT particle, {_SHIFTED.format('t')} AS frame, x FROM trk t WHERE frame % 10 <> 3"),
    ),
    "b10_deleted_frames_divisions": (
        _on("trk", lambda t: _without_frames(t, 1)),
        oracle("trk", f""", lost AS (SELECT particle FROM trk GROUP BY particle HAVING bool_and(frame % 10 = 3)), f AS ({_FAMILY.format("trk")})
SELECT mother, daughter1, daughter2, {_SHIFTED.format('f')} AS frame FROM f WHERE mother NOT IN (FROM lost) AND daughter1 NOT IN (FROM lost) AND daughter2 NOT IN (FROM lost)"""),
    ),
}

#: Queries that SQL cannot express, each with a brute-force version in the tests.
UNTWINNED: dict[str, Query] = {
    "d13_ellipses": _on("pixg", lambda p: _rounded(contours.ellipses(contours.contours(p)).drop("stack_id"), "cx", "cy", "major", "minor", "aspect", "theta")),
    "d20_automatic_threshold": _on("pix", lambda p: _rounded(thresholds.automatic(p, "ch0", 12, percentiles=(5, 95)).drop("stack_id"), "threshold")),
    "e20_coverslip_z": _on("stk", lambda v: profiles.coverslip_z(v.groupBy("stack_id", "frame", "z").agg(F.avg("value").alias("mean")), ["stack_id", "frame"], 0.5).drop("stack_id")),
    "e23_fitted_surface": _on("stk", lambda v: _rounded(profiles.fitted_surface(v, 48, 64, 16, 8, 4, sigma=0.6, z_sigma=2.0).drop("stack_id"), "height")),
    "i05_interpolated": _on("stk", lambda v: _rounded(profiles.interpolate_z(v, 2).drop("stack_id"), "value")),
    "i06_height_map": _on("stk", lambda v: profiles.height_map(v, 48, 64, 16, sigma=0.8, z_sigma=0.8, least=12).drop("stack_id")),
    "i07_coverslip_map": _on("stk", lambda v: profiles.height_map(v, 48, 64, 16, sigma=0.8, z_sigma=0.8, least=12, reverse=True).drop("stack_id")),
    "h02_mended_gaps": _on("pixg", lambda p: planes.mend_gaps(p).select("frame", "y", "x", "label")),
    "h03_height_outliers": _on("pix", lambda p: heights.without_outliers(p.withColumn("height", F.floor(F.col("ch0") / 60).cast("int")), 12).drop("stack_id")),
    "h10_split_cells": _on("pixg", lambda p: masks.split_cells(p, _cuts(p))[0].select("frame", "y", "x", "label")),
    "h15_colours": _on("pixg", lambda p: networks.colours(zonal.areas(p).select("stack_id", "frame", F.col("label").alias("id")), spatial.adjacency(p), ["stack_id", "frame"]).drop("stack_id")),
    "i01_contours": _on("pixg", lambda p: contours.contours(p).drop("stack_id")),
    "d37_quadratic_surface": _on("pix", lambda p: planes.quadratic_surface(p, "ch0")),
    "e17_stages_by_transitions": _on("trk", lambda t: stages.stages_by_transitions(t.withColumns({"green": F.col("x"), "red": F.col("y") + 1})).select("particle", "frame", "cycle_stage")),
    "h05_edited_tracks": lambda spark, sf_dir: _edited(spark, sf_dir)[0].select("particle", "frame", "x"),
    "h14_edited_divisions": lambda spark, sf_dir: _edited(spark, sf_dir)[1].drop("stack_id"),
    "e14_stable": _on("trk", lambda t: stages.remove_flickers(t, ((1, 3, 1),)).select("particle", "frame", "cycle_stage")),
    "e16_interpretable": _on("trk", lambda t: stages.interpretable(t, zero_remainder=False).select("particle", "frame", "cycle_stage")),
}


def queries() -> dict[str, Query]:
    return {**{name: query for name, (query, _) in CATALOG.items()}, **UNTWINNED}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items()}
