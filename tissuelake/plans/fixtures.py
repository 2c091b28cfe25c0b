"""Cell tables derived from the given tables, as SQL that both engines run: the same text fills Spark views and the oracle's CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HELPERS = {
    "spark": {"ks": "SELECT CAST(id AS INT) AS k FROM range(40)", "zs": "SELECT CAST(id AS INT) AS z FROM range(16)"},
    "duckdb": {"ks": "SELECT CAST(range AS INT) AS k FROM range(40)", "zs": "SELECT CAST(range AS INT) AS z FROM range(16)"},
}

TABLES = ("events", "lineitem", "customer")

#: In order of use.
VIEWS = {
    "trk": """SELECT 0 AS stack_id, particle, frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY particle) - 1 AS INT) AS cell_number, x, y, cycle_stage
FROM (SELECT user_id AS particle, event_id, CAST(n + floor(n / 10.0) + user_id % 5 AS INT) AS frame,
  value AS x, CAST((event_id * 37) % 500 AS DOUBLE) AS y,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS cycle_stage
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) n) e""",
    "users": "SELECT DISTINCT user_id AS u FROM events",
    "div": """SELECT 0 AS stack_id, particle, frame, x, y FROM (
SELECT 4 * u AS particle, f.k AS frame, CAST(u % 12 * 40 AS DOUBLE) + f.k * CAST(0.25 AS DOUBLE) AS x, CAST(floor(u / 12.0) * 40 AS DOUBLE) AS y FROM users CROSS JOIN ks f WHERE f.k <= 10 + u % 20
UNION ALL
SELECT 4 * u + 1 + d.k, f.k, CAST(u % 12 * 40 AS DOUBLE) + f.k * CAST(0.25 AS DOUBLE) + (d.k - CAST(0.5 AS DOUBLE)) * (4 + u % 5), CAST(floor(u / 12.0) * 40 AS DOUBLE) + d.k
FROM users CROSS JOIN ks f CROSS JOIN ks d WHERE f.k > 10 + u % 20 AND d.k < CASE WHEN u % 10 = 0 THEN 3 ELSE 2 END) t""",
    "divc": """SELECT stack_id, particle, frame, x, y, CAST(40 + (floor(v) + frame) % 17 AS DOUBLE) AS area, CAST((floor(v) * 7 + particle * 3 + frame) % 10 AS DOUBLE) / 20 + CAST(0.5 AS DOUBLE) AS circularity
FROM div JOIN (SELECT user_id, max(value) AS v FROM events GROUP BY user_id) w ON user_id = CAST(floor(particle / 4.0) AS BIGINT)""",
    "pix": """SELECT 0 AS stack_id, frame, y, x, r * 9 + c + 1 AS label, ch0, ch1,
  CAST(floor((x + y) / 16.0) AS INT) + (r * 9 + c + 1) % 3 AS height
FROM (SELECT frame, y, x, ch0, ch1, CAST(floor(y / 8.0) AS INT) AS r, CAST(floor((x + (CAST(floor(y / 8.0) AS INT) % 2) * 4) / 8.0) AS INT) AS c
FROM (SELECT CAST(floor(event_id / 3072.0) AS INT) AS frame, CAST(floor(event_id % 3072 / 64.0) AS INT) AS y, CAST(event_id % 64 AS INT) AS x, value AS ch0, CAST(user_id * 17 % 256 AS DOUBLE) AS ch1 FROM events) e) g""",
    "pixg": "SELECT stack_id, frame, y, x, CASE WHEN (y * 64 + x + frame) % 97 = 0 OR (y < 12 AND x < 12) THEN 0 ELSE label END AS label, ch0, ch1, height FROM pix",
    "nuc": "SELECT stack_id, frame, label * 10 AS nuc, avg(y) AS cy, avg(x) AS cx FROM pix GROUP BY stack_id, frame, label",
    "poly": """SELECT 0 AS stack_id, frame, label, k, CAST(CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x1 + 2 WHEN 3 THEN x1 WHEN 4 THEN x0 ELSE x0 - 2 END AS DOUBLE) AS px,
  CASE WHEN k < 2 THEN CAST(y0 AS DOUBLE) WHEN k = 2 OR k = 5 THEN (y0 + y1) / CAST(2 AS DOUBLE) ELSE CAST(y1 AS DOUBLE) END AS py
FROM (SELECT frame, label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pix GROUP BY frame, label) b CROSS JOIN ks WHERE k < 6""",
    "vox": "SELECT stack_id, frame, z, y, x, CASE WHEN z <= height THEN CAST(200 - z AS DOUBLE) ELSE CAST(10 AS DOUBLE) END AS value FROM pix CROSS JOIN zs",
    # measured stacks: bright up to the height, on a coverslip that rises over the first planes
    "stk": """SELECT stack_id, frame, z, y, x, CASE WHEN z <= 1 THEN 20 * z WHEN z <= 5 + height THEN 120 + ch0 / 8 - z ELSE 10 + ch0 / 32 END AS value FROM pix CROSS JOIN zs""",
    "li": "SELECT l_linestatus AS cond, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS stage, l_extendedprice AS volume FROM lineitem",
    "stg": "SELECT c_custkey - 1 AS place, (c_custkey * 613) % 5000 AS x, (c_custkey * 331) % 4000 AS y, CAST(c_nationkey AS DOUBLE) AS current_z FROM customer",
    "edit": """SELECT 0 AS stack_id, CASE u % 5 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' WHEN 2 THEN 'delete_head' WHEN 3 THEN 'delete_tail' ELSE 'set_stage' END AS op,
  u AS particle, CAST(20 + u % 25 AS INT) AS frame FROM users""",
    "files": """SELECT user_id AS stack_id, concat('u', user_id, '/', event_type, event_id % 1000, CASE WHEN event_id % 7 = 0 THEN '_tracking.csv' WHEN event_id % 7 = 1 THEN '.TIF' WHEN event_id % 7 = 2 THEN '.txt'
  WHEN user_id % 3 = 0 THEN '.nd2' ELSE '_seg.npy' END) AS path FROM (SELECT DISTINCT user_id, event_id, event_type FROM events) e""",
    "drawn": "SELECT stack_id, frame, y, x, CAST(floor(y / 5.0) * 3 + floor((x + frame) / 5.0) AS INT) AS cell FROM pix WHERE y < 14 AND x < 15",
}
_NEEDS = {"trk": (), "users": (), "div": ("ks", "users"), "divc": ("ks", "users", "div"), "pix": (), "pixg": ("pix",), "nuc": ("pix",), "poly": ("pix", "ks"), "vox": ("pix", "zs"), "stk": ("pix", "zs"), "li": (), "stg": (), "edit": ("users",), "files": (), "drawn": ("pix",)}


def _ctes(views: tuple[str, ...], engine: str) -> str:
    wanted = {x for v in views for x in (*_NEEDS[v], v)}
    texts = {**_HELPERS[engine], **VIEWS}
    return ", ".join(f"{name} AS ({texts[name]})" for name in texts if name in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in _ctes((name,), "spark")}
    return spark.sql(f"WITH {_ctes((name,), 'spark')} SELECT * FROM {name}".replace("FROM events", "FROM {events}").replace("FROM lineitem", "FROM {lineitem}").replace("FROM customer", "FROM {customer}"), **tables)


def oracle(views: str, sql: str) -> str:
    """An oracle query over the named views."""
    return f"WITH {_ctes(tuple(views.split()), 'duckdb')} {sql}"
