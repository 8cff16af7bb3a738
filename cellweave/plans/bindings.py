"""The driver's tables seen as scans, odometry and graphs; each view beside the SQL that defines the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions import se2
from cellweave.operators import trajectory, voxel

SIZE = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c, name: str | None = None):
    """Rounded to six digits, without a negative zero."""
    out = F.round(c, 6) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else ""))


#: Means of few points fall on exact halves of the last digit, which engines round differently; this moves them off.
OFF_HALF = 3.1e-8


def off_half(c: str):
    return (F.round(F.col(c) + F.lit(OFF_HALF), 6) + F.lit(0.0)).alias(c)


def scan_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_quantity") - 25.5) / 20.0, (F.col("l_extendedprice") % 1000.0) / 400.0 - 1.25
    return t.select(F.col("l_suppkey").alias("scan_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).cast("long").alias("pt_idx"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))


SP = "sp AS (SELECT l_suppkey AS scan_id, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey)::BIGINT AS pt_idx, (l_quantity - 25.5) / 20.0 AS x, (l_extendedprice % 1000.0) / 400.0 - 1.25 AS y, 0.0::DOUBLE AS z FROM lineitem)"


def key_sql(x: str, y: str, size: float) -> str:
    return f"floor(({x} + {size / 2}) / {size})::BIGINT AS cx, floor(({size / 2} - {y}) / {size})::BIGINT AS cy"


def cells_sql(name: str, source: str, keys: str, size: float = SIZE) -> str:
    """CTE of the cells of a point table, unrounded; keys like 'scan_id, ' or ''."""
    return f"""{name}_k AS (SELECT *, {key_sql("x", "y", size)} FROM {source}),
{name}_s AS (SELECT {keys}cx, cy, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM {name}_k GROUP BY {keys}cx, cy),
{name} AS (SELECT {keys}cx, cy, n, mx, my, ((sxx + 1) / n - mx * mx) * ((n - 1) / n) AS cxx, (sxy / n - mx * my) * ((n - 1) / n) AS cxy,
  ((syy + 1) / n - my * my) * ((n - 1) / n) AS cyy, ((n - 1) / n) / n AS czz, greatest(-1.0, least(1.0, n * 0.405465108))::DOUBLE AS occ, n >= 6 AS has_gaussian FROM {name}_s)"""


def cells(spark: SparkSession, sf_dir: str, size: float = SIZE) -> DataFrame:
    """Cells of each scan with mean and covariance rounded, so that no summing order can move them to other cells."""
    rows = voxel.cells(scan_points(spark, sf_dir), ["scan_id"], size)
    return rows.withColumns({c: off_half(c) for c in ("mx", "my", "cxx", "cxy", "cyy", "czz", "occ")})


def rounded_sql(name: str, source: str) -> str:
    return f"{name} AS (SELECT * REPLACE ({', '.join(f'round({c} + {OFF_HALF}, 6) + 0.0 AS {c}' for c in ('mx', 'my', 'cxx', 'cxy', 'cyy', 'czz', 'occ'))}) FROM {source})"


CELLS = f"{SP}, {cells_sql('c0', 'sp', 'scan_id, ')}, {rounded_sql('cells', 'c0')}"

FLOORED = """fl0 AS (SELECT *, (cxx + cyy) / 2 AS half, sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy) AS gap FROM {source}),
fl1 AS (SELECT *, half + gap AS l1, half - gap AS l2, 0.01 * greatest(half + gap, czz) AS least_ev FROM fl0),
fl2 AS (SELECT *, greatest(l1, least_ev) AS f1, greatest(l2, least_ev) AS f2 FROM fl1),
fl3 AS (SELECT *, CASE WHEN gap > 0 THEN (f1 - f2) / (2 * gap) ELSE 0 END AS lift, CASE WHEN gap > 0 THEN f2 ELSE f1 END AS base FROM fl2),
fl4 AS (SELECT * REPLACE (base + lift * (cxx - l2) AS cxx, lift * cxy AS cxy, base + lift * (cyy - l2) AS cyy, greatest(czz, least_ev) AS czz) FROM fl3),
{name} AS (SELECT *, cyy / nullif(cxx * cyy - cxy * cxy, 0) AS ixx, -cxy / nullif(cxx * cyy - cxy * cxy, 0) AS ixy, cxx / nullif(cxx * cyy - cxy * cxy, 0) AS iyy FROM fl4)"""


def odometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events")
    turn = ((F.col("event_id") % 7) - 3) / 10.0
    return t.select(F.col("user_id").alias("robot"), "ts", "event_id", (F.col("value") / 100.0).alias("dx"), F.lit(0.0).alias("dy"), turn.alias("dtheta"), F.to_date("ts").alias("day"))


OD = "od AS (SELECT user_id AS robot, ts, event_id, value / 100.0 AS dx, 0.0::DOUBLE AS dy, ((event_id % 7) - 3) / 10.0 AS dtheta FROM events)"


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odometry with its prefix poses, rounded, and each row's id along its robot's way."""
    rows = trajectory.prefix_poses(odometry(spark, sf_dir), ["robot"], ["ts", "event_id"], "day")
    w = Window.partitionBy("robot").orderBy("ts", "event_id")
    rows = rows.withColumns({c: r6(c) for c in ("x", "y", "theta")})
    return rows.withColumns({"id": (F.row_number().over(w) - 1).cast("long"), "path": r6(F.sum(F.abs("dx")).over(w))}).drop("day")


POSES = f"""{OD}, od1 AS (SELECT *, coalesce(sum(dtheta) OVER (PARTITION BY robot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS t0 FROM od),
poses AS (SELECT robot, ts, event_id, dx, dy, dtheta, round(sum(cos(t0) * dx - sin(t0) * dy) OVER w, 6) + 0.0 AS x, round(sum(sin(t0) * dx + cos(t0) * dy) OVER w, 6) + 0.0 AS y,
  round(atan2(sin(t0 + dtheta), cos(t0 + dtheta)), 6) + 0.0 AS theta, row_number() OVER w - 1 AS id, round(sum(abs(dx)) OVER w, 6) + 0.0 AS path
  FROM od1 WINDOW w AS (PARTITION BY robot ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return graph_of(poses(spark, sf_dir))


def graph_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (robot, id, x, y, theta) of poses, and edges: odometry with a tenth too long steps, and a loop at every tenth node."""
    nodes = rows.select("robot", "id", "x", "y", "theta", F.col("id").alias("frame_id"), "path")
    info = F.array(*[F.lit(v) for v in (500.0, 0.0, 0.0, 0.0, 500.0, 0.0, 0.0, 0.0, 5000.0)])
    steps = rows.filter("id > 0").select("robot", (F.col("id") * 2).alias("id"), (F.col("id") - 1).alias("src"), F.col("id").alias("dst"), F.lit("ODOM").alias("type"), F.lit("ACTIVE").alias("state"), (F.col("dx") * 1.1).alias("dx"), "dy", "dtheta")
    loops = rows.filter("id >= 10 AND id % 10 = 0").select("robot", (F.col("id") * 2 + 1).alias("id"), F.col("id").alias("src"), (F.col("id") - 10).alias("dst"), F.lit("LOOP").alias("type"), F.lit("ACTIVE").alias("state"), F.lit(0.5).alias("dx"), F.lit(-0.25).alias("dy"), F.lit(0.1).alias("dtheta"))
    return nodes, steps.unionByName(loops).withColumn("info", info)


GRAPH = f"""{POSES}, nodes AS (SELECT robot, id, x, y, theta, path FROM poses),
edges AS (SELECT robot, id * 2 AS id, id - 1 AS src, id AS dst, 'ODOM' AS type, dx * 1.1 AS dx, dy, dtheta FROM poses WHERE id > 0
  UNION ALL SELECT robot, id * 2 + 1, id, id - 10, 'LOOP', 0.5::DOUBLE, -0.25::DOUBLE, 0.1::DOUBLE FROM poses WHERE id >= 10 AND id % 10 = 0),
ends AS (SELECT e.*, s.x AS sx, s.y AS sy, s.theta AS st, t.x AS ex, t.y AS ey, t.theta AS et FROM edges e JOIN nodes s ON e.robot = s.robot AND e.src = s.id JOIN nodes t ON e.robot = t.robot AND e.dst = t.id),
rel AS (SELECT *, cos(st) * (ex - sx) + sin(st) * (ey - sy) AS rx, cos(st) * (ey - sy) - sin(st) * (ex - sx) AS ry, atan2(sin(et - st), cos(et - st)) AS rt FROM ends),
res AS (SELECT *, cos(dtheta) * (rx - dx) + sin(dtheta) * (ry - dy) AS e0, cos(dtheta) * (ry - dy) - sin(dtheta) * (rx - dx) AS e1, atan2(sin(rt - dtheta), cos(rt - dtheta)) AS e2 FROM rel)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))


VECTORS = "v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"
