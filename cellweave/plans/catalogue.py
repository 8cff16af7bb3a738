"""Every mapping query by name, with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave import storage
from cellweave.functions import gauss, se2
from cellweave.operators import graph, lookup, occupancy, registration, spatial, trajectory, voxel
from cellweave.plans import bindings as b
from cellweave.plans.bindings import SIZE, r6
from cellweave.schemas import Config
from cellweave.sources import readers, writers
from cellweave.streaming import live

QUERIES: dict = {}
ORACLE: dict = {}
MOVE = (1.5, -0.5, 0.7)  # the transform of the transform queries
NEAR = (0.1, -0.05, 0.1)  # the pose of the score queries


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def lits(t):
    return tuple(F.lit(v) for v in t)


@query(f"WITH {b.SP} SELECT scan_id, count(*) AS n, round(sum(x), 6) + 0.0 AS sum_x FROM sp WHERE NOT (isnan(x) OR isnan(y)) GROUP BY scan_id HAVING count(*) >= 400")
def scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = voxel.large_scans(voxel.without_nan(b.scan_points(spark, sf)), 400)
    return rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("x"), "sum_x"))


@query("""WITH s AS (SELECT s_suppkey AS scan_id, unnest(range(0, 181)) AS pt_idx FROM supplier),
r AS (SELECT scan_id, pt_idx::INTEGER AS pt_idx, ((scan_id * 7 + pt_idx * 13) % 700) / 10.0 AS r, -1.5 + pt_idx * (3.0 / 180) AS a FROM s)
SELECT scan_id, pt_idx, round(r * cos(a), 6) + 0.0 AS x, round(r * sin(a), 6) + 0.0 AS y FROM r WHERE r BETWEEN 0.023 AND 60""")
def laser_projection(spark: SparkSession, sf: str) -> DataFrame:
    ranges = F.transform(F.sequence(F.lit(0), F.lit(180)), lambda i: ((F.col("s_suppkey") * 7 + i * 13) % 700) / 10.0)
    scans = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("scan_id"), F.lit(-1.5).alias("angle_min"), F.lit(3.0 / 180).alias("angle_increment"), F.lit(0.023).alias("range_min"), F.lit(60.0).alias("range_max"), ranges.alias("ranges"))
    return readers.project(scans).select("scan_id", "pt_idx", r6("x"), r6("y"))


_C, _S = math.cos(MOVE[2]), math.sin(MOVE[2])


@query(f"WITH {b.SP} SELECT scan_id, pt_idx, round({_C} * x - {_S} * y + {MOVE[0]}, 6) + 0.0 AS x, round({_S} * x + {_C} * y + {MOVE[1]}, 6) + 0.0 AS y FROM sp")
def se2_transform_points(spark: SparkSession, sf: str) -> DataFrame:
    x, y = se2.apply(lits(MOVE), F.col("x"), F.col("y"))
    return b.scan_points(spark, sf).select("scan_id", "pt_idx", r6(x, "x"), r6(y, "y"))


@query(f"WITH {b.SP} SELECT scan_id, {b.key_sql('x', 'y', SIZE)}, count(*) AS n FROM sp GROUP BY ALL")
def voxel_bin_counts(spark: SparkSession, sf: str) -> DataFrame:
    return voxel.keyed(b.scan_points(spark, sf), SIZE).groupBy("scan_id", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {b.CELLS} SELECT * FROM cells WHERE has_gaussian")
def ndt_cells(spark: SparkSession, sf: str) -> DataFrame:
    return b.cells(spark, sf).filter("has_gaussian")


@query(f"WITH {b.CELLS}, {b.FLOORED.format(source='cells', name='fl')} SELECT scan_id, cx, cy, {', '.join(f'round({c} + {b.OFF_HALF}, 6) + 0.0 AS {c}' for c in ('cxx', 'cxy', 'cyy', 'czz', 'ixx', 'ixy', 'iyy'))} FROM fl WHERE has_gaussian")
def ndt_cells_floored(spark: SparkSession, sf: str) -> DataFrame:
    rows = voxel.floored(b.cells(spark, sf).filter("has_gaussian"))
    return rows.select("scan_id", "cx", "cy", *[b.off_half(c) for c in ("cxx", "cxy", "cyy", "czz", "ixx", "ixy", "iyy")])


EXT = f"""bx AS (SELECT scan_id, least(0.0, min(x)) AS minx, greatest(0.0, max(x)) AS maxx, least(0.0, min(y)) AS miny, greatest(0.0, max(y)) AS maxy FROM sp GROUP BY scan_id),
ext AS (SELECT *, greatest(0, ceil((-minx - {SIZE / 2}) / {SIZE}))::BIGINT AS "left", greatest(0, ceil((maxx - {SIZE / 2}) / {SIZE}))::BIGINT AS "right",
  greatest(0, ceil((maxy - {SIZE / 2}) / {SIZE}))::BIGINT AS up, greatest(0, ceil((-miny - {SIZE / 2}) / {SIZE}))::BIGINT AS down FROM bx)"""


def _extents(spark: SparkSession, sf: str) -> DataFrame:
    return voxel.extents(voxel.bounds(b.scan_points(spark, sf), ["scan_id"]), SIZE)


@query(f"""WITH {b.SP}, {EXT} SELECT scan_id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('minx', 'maxx', 'miny', 'maxy'))}, "left", "right", up, down,
round(("left" + "right" + 1) * {SIZE} + (up + down + 1) * {SIZE} / 4, 6) AS radius, round(("right" - "left") * {SIZE}, 6) + 0.0 AS centroid_x, round((up - down) * {SIZE}, 6) + 0.0 AS centroid_y FROM ext""")
def bounding_box_extents(spark: SparkSession, sf: str) -> DataFrame:
    gx, gy = voxel.centroid(SIZE)
    return _extents(spark, sf).select("scan_id", *[r6(c) for c in ("minx", "maxx", "miny", "maxy")], "left", "right", "up", "down", r6(voxel.radius(SIZE), "radius"), r6(gx, "centroid_x"), r6(gy, "centroid_y"))


_PAIR = f"""WITH {b.SP}, ev AS (SELECT * FROM sp WHERE scan_id % 2 = 0), od_ AS (SELECT * FROM sp WHERE scan_id % 2 = 1),
{b.cells_sql('a0', 'ev', '')}, {b.rounded_sql('a', 'a0')}, {b.cells_sql('b0', 'od_', '')}, {b.rounded_sql('bb', 'b0')},
o AS (SELECT * FROM bb WHERE n > 2 AND has_gaussian),
j AS (SELECT coalesce(a.cx, o.cx) AS cx, coalesce(a.cy, o.cy) AS cy, a.has_gaussian AND o.has_gaussian AS two, o.has_gaussian AS other,
  a.n AS an, a.mx AS amx, a.my AS amy, a.cxx AS axx, a.cxy AS axy, a.cyy AS ayy, a.czz AS azz, a.occ AS ao, a.has_gaussian AS ag,
  o.n AS bn, o.mx AS bmx, o.my AS bmy, o.cxx AS bxx, o.cxy AS bxy, o.cyy AS byy, o.czz AS bzz, o.occ AS bo, o.has_gaussian AS bg,
  (bn / an) * amx * an - bmx * bn AS gx, (bn / an) * amy * an - bmy * bn AS gy, an / (bn * (an + bn)) AS w FROM a FULL JOIN o ON a.cx = o.cx AND a.cy = o.cy),
m AS (SELECT cx, cy, CASE WHEN two THEN an + bn WHEN other THEN bn ELSE an END AS n,
  CASE WHEN two THEN (amx * an + bmx * bn) / (an + bn) WHEN other THEN bmx ELSE amx END AS mx, CASE WHEN two THEN (amy * an + bmy * bn) / (an + bn) WHEN other THEN bmy ELSE amy END AS my,
  CASE WHEN two THEN (axx * (an - 1) + bxx * (bn - 1) + w * gx * gx) / (an + bn - 1) WHEN other THEN bxx ELSE axx END AS cxx,
  CASE WHEN two THEN (axy * (an - 1) + bxy * (bn - 1) + w * gx * gy) / (an + bn - 1) WHEN other THEN bxy ELSE axy END AS cxy,
  CASE WHEN two THEN (ayy * (an - 1) + byy * (bn - 1) + w * gy * gy) / (an + bn - 1) WHEN other THEN byy ELSE ayy END AS cyy,
  CASE WHEN two THEN greatest(-1.0, least(1.0, ao + bn * 0.405465108)) WHEN other THEN bo ELSE ao END AS occ,
  CASE WHEN two THEN greatest(-1.0, least(1.0, ao + bn * 0.405465108)) >= 0 WHEN other THEN bg ELSE ag END AS has_gaussian FROM j)
SELECT cx, cy, n, {', '.join(f'round({c}, 5) + 0.0 AS {c}' for c in ('mx', 'my', 'cxx', 'cxy', 'cyy', 'occ'))}, has_gaussian FROM m"""


@query(_PAIR)
def cell_merge_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    p = b.scan_points(spark, sf)
    half = [voxel.cells(p.filter(F.col("scan_id") % 2 == i), [], SIZE).withColumns({c: b.off_half(c) for c in ("mx", "my", "cxx", "cxy", "cyy", "czz", "occ")}) for i in (0, 1)]
    rows = voxel.merged_pair(half[0], half[1], ["cx", "cy"])
    return rows.select("cx", "cy", "n", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("mx", "my", "cxx", "cxy", "cyy", "occ")], "has_gaussian")


@query(f"""WITH {b.CELLS}, k AS (SELECT scan_id, cx AS fx, cy AS fy, {b.key_sql('mx', 'my', 0.5)}, n, mx, my, cxx, cxy, cyy, czz, occ, has_gaussian FROM cells WHERE has_gaussian)
SELECT scan_id, cx, cy, n, mx, my, cxx, cxy, cyy, czz, occ, has_gaussian FROM k QUALIFY row_number() OVER (PARTITION BY scan_id, cx, cy ORDER BY fy DESC, fx DESC) = 1""")
def coarser_grid_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    return voxel.coarser(b.cells(spark, sf), ["scan_id"], 0.5)


def merge_sums_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, sum(n)::BIGINT AS n, round(sum(n * mx) / sum(n) + {b.OFF_HALF}, 6) + 0.0 AS mx, round(sum(n * my) / sum(n) + {b.OFF_HALF}, 6) + 0.0 AS my,
round((sum((n - 1) * cxx + n * mx * mx) - sum(n) * (sum(n * mx) / sum(n)) * (sum(n * mx) / sum(n))) / (sum(n) - 1) + {b.OFF_HALF}, 6) + 0.0 AS cxx,
round((sum((n - 1) * cxy + n * mx * my) - sum(n) * (sum(n * mx) / sum(n)) * (sum(n * my) / sum(n))) / (sum(n) - 1) + {b.OFF_HALF}, 6) + 0.0 AS cxy,
round((sum((n - 1) * cyy + n * my * my) - sum(n) * (sum(n * my) / sum(n)) * (sum(n * my) / sum(n))) / (sum(n) - 1) + {b.OFF_HALF}, 6) + 0.0 AS cyy FROM {source} GROUP BY {keys}"""


def _merged(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "n", b.off_half("mx"), b.off_half("my"), *[b.off_half(c) for c in ("cxx", "cxy", "cyy")])


@query(f"""WITH {b.CELLS}, k AS (SELECT scan_id, {b.key_sql('mx', 'my', 0.5)}, n, mx, my, cxx, cxy, cyy FROM cells WHERE has_gaussian) {merge_sums_sql('k', 'scan_id, cx, cy')}""")
def coarser_grid_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(voxel.coarser(b.cells(spark, sf), ["scan_id"], 0.5, "merge"), "scan_id", "cx", "cy")


@query(f"WITH {b.CELLS} SELECT cx, cy, scan_id, n, mx, my, has_gaussian FROM cells WHERE has_gaussian QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY scan_id DESC) = 1")
def map_recalculated(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.cells(spark, sf).filter("has_gaussian").select("cx", "cy", "scan_id", "n", "mx", "my", "has_gaussian")
    return voxel.latest(rows, ["cx", "cy"], ["scan_id"])


@query(f"WITH {b.POSES} SELECT robot, event_id, x, y, theta, id, path FROM poses")
def trajectory_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return b.poses(spark, sf).select("robot", "event_id", "x", "y", "theta", "id", "path")


@query(f"""WITH {b.POSES}, l AS (SELECT robot, id, x, y, theta, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(theta) OVER w AS pt FROM poses WINDOW w AS (PARTITION BY robot ORDER BY id))
SELECT robot, id, round(cos(pt) * (x - px) + sin(pt) * (y - py), 5) + 0.0 AS dx, round(cos(pt) * (y - py) - sin(pt) * (x - px), 5) + 0.0 AS dy, round(atan2(sin(theta - pt), cos(theta - pt)), 5) + 0.0 AS dtheta,
round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 5) + 0.0 AS displacement FROM l WHERE px IS NOT NULL""")
def motion_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = trajectory.motions(b.poses(spark, sf).select("robot", "id", "x", "y", "theta"), ["robot"], ["id"])
    r5 = lambda c, n: (F.round(c, 5) + F.lit(0.0)).alias(n)
    return rows.select("robot", "id", *[r5(F.col(c), c) for c in ("dx", "dy", "dtheta")], r5(se2.displacement((F.col("dx"), F.col("dy"), F.col("dtheta"))), "displacement"))


@query(f"""WITH {b.POSES}, o AS (SELECT robot, id, x, y, theta, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(theta) OVER w AS pt FROM poses WINDOW w AS (PARTITION BY robot ORDER BY id))
SELECT robot, id, round(cos(theta) * (px - x) + sin(theta) * (py - y), 6) + 0.0 AS fx, round(cos(theta) * (py - y) - sin(theta) * (px - x), 6) + 0.0 AS fy, round(sin(theta / 2), 6) + 0.0 AS qz, round(cos(theta / 2), 6) + 0.0 AS qw
FROM o WHERE px IS NOT NULL""")
def frame_change(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("robot").orderBy("id")
    rows = b.poses(spark, sf).select("robot", "id", "x", "y", "theta", *[F.lag(c).over(w).alias(f"p{c[0]}") for c in ("x", "y", "theta")]).filter("px IS NOT NULL")
    f = se2.between_frames((F.col("px"), F.col("py"), F.col("pt")), (F.col("x"), F.col("y"), F.col("theta")))
    return writers.pose_messages(rows).select("robot", "id", r6(f[0], "fx"), r6(f[1], "fy"), r6("qz"), r6("qw"))


@query(f"""WITH {b.OD}, l AS (SELECT robot, list({{'xx': 0.0::DOUBLE, 'xy': 0.0::DOUBLE, 'xt': 0.0::DOUBLE, 'yy': 0.0::DOUBLE, 'yt': 0.0::DOUBLE, 'tt': 0.0::DOUBLE,
  'u': -sin(dtheta) * dx - cos(dtheta) * dy, 'v': cos(dtheta) * dx - sin(dtheta) * dy}} ORDER BY ts, event_id) AS s FROM od GROUP BY robot),
f AS (SELECT robot, list_reduce(s, lambda a, e: {{'xx': a.xx + 2 * e.u * a.xt + e.u * e.u * a.tt + 0.01, 'xy': a.xy + e.v * a.xt + e.u * a.yt + e.u * e.v * a.tt, 'xt': a.xt + e.u * a.tt,
  'yy': a.yy + 2 * e.v * a.yt + e.v * e.v * a.tt + 0.01, 'yt': a.yt + e.v * a.tt, 'tt': a.tt + 0.01, 'u': 0.0::DOUBLE, 'v': 0.0::DOUBLE}},
  {{'xx': 1.0::DOUBLE, 'xy': 0.0::DOUBLE, 'xt': 0.0::DOUBLE, 'yy': 1.0::DOUBLE, 'yt': 0.0::DOUBLE, 'tt': 1.0::DOUBLE, 'u': 0.0::DOUBLE, 'v': 0.0::DOUBLE}}) AS c FROM l)
SELECT robot, {', '.join(f'round(c.{k}, 5) + 0.0 AS {k}' for k in ('xx', 'xy', 'xt', 'yy', 'yt', 'tt'))} FROM f""")
def covariance_concat(spark: SparkSession, sf: str) -> DataFrame:
    rows = trajectory.concatenated_covariance(b.odometry(spark, sf), ["robot"], ["ts", "event_id"], 0.01)
    return rows.select("robot", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("xx", "xy", "xt", "yy", "yt", "tt")])


@query(f"WITH {b.CELLS}, p AS (SELECT scan_id, pt_idx, x, y, {b.key_sql('x', 'y', SIZE)} FROM sp) SELECT scan_id, pt_idx, cx, cy, n, round((x - mx) * (x - mx) + (y - my) * (y - my), 6) AS d2 FROM p JOIN cells USING (scan_id, cx, cy) WHERE has_gaussian")
def point_cell_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = spatial.owning_cell(b.scan_points(spark, sf), b.cells(spark, sf).filter("has_gaussian"), ["scan_id"], SIZE)
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2
    return rows.select("scan_id", "pt_idx", "cx", "cy", "n", r6(d2, "d2"))


@query(f"WITH {b.CELLS} SELECT q.scan_id, q.cx AS qcx, q.cy AS qcy, count(*) AS n_cells, sum(c.n)::BIGINT AS n_points FROM cells q JOIN cells c ON q.scan_id = c.scan_id AND abs(q.cx - c.cx) <= 1 AND abs(q.cy - c.cy) <= 1 GROUP BY ALL")
def block_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    c = b.cells(spark, sf).select("scan_id", "cx", "cy", "n")
    q = c.select("scan_id", F.col("cx").alias("qcx"), F.col("cy").alias("qcy"), "cx", "cy")
    return spatial.block_neighbours(q, c, ["scan_id"], 1).groupBy("scan_id", "qcx", "qcy").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_points"))


@query(f"""WITH {b.CELLS}, g AS (SELECT * FROM cells WHERE has_gaussian) SELECT q.scan_id, q.cx AS qid_x, q.cy AS qid_y, count(*) AS n_cells, round(sum((q.mx - c.mx) * (q.mx - c.mx) + (q.my - c.my) * (q.my - c.my)), 6) AS sum_d2
FROM g q JOIN g c ON q.scan_id = c.scan_id AND (q.mx - c.mx) * (q.mx - c.mx) + (q.my - c.my) * (q.my - c.my) <= 0.4 * 0.4 GROUP BY ALL""")
def radius_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    c = b.cells(spark, sf).filter("has_gaussian")
    q = c.select("scan_id", F.col("cx").alias("qid_x"), F.col("cy").alias("qid_y"), F.col("mx").alias("qx"), F.col("my").alias("qy"))
    d2 = (F.col("qx") - F.col("mx")) ** 2 + (F.col("qy") - F.col("my")) ** 2
    return spatial.radius_neighbours(q, c, ["scan_id"], SIZE, 0.4).groupBy("scan_id", "qid_x", "qid_y").agg(F.count(F.lit(1)).alias("n_cells"), r6(F.sum(d2), "sum_d2"))


@query(f"""WITH {b.VECTORS}, d AS (SELECT q.id AS qid, t.id AS tid, (t.x - q.x) ** 2 + (t.y - q.y) ** 2 AS d2 FROM v q, v t)
SELECT qid, tid, round(d2, 6) AS d2, row_number() OVER (PARTITION BY qid ORDER BY d2, tid)::INTEGER AS place FROM d QUALIFY place <= 4""")
def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    v = b.vectors(spark, sf)
    q = v.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    t = v.select(F.col("id").alias("tid"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return spatial.nearest(q, t, [], 4).select("qid", "tid", r6("d2"), F.col("place").cast("int").alias("place"))


def rays_sql(name: str, source: str) -> str:
    """CTE of the cells on rays (…, sx, sy, ex, ey) of a source."""
    return f"""{name}_l AS (SELECT *, greatest(abs(ex - sx), abs(ey - sy)) / {SIZE} AS len FROM {source}),
{name}_i AS (SELECT *, unnest(range(0, CASE WHEN len >= 1 THEN 2 * floor(len)::BIGINT - 1 ELSE 1 END)) AS step FROM {name}_l),
{name}_p AS (SELECT *, CASE WHEN step = 0 THEN sx ELSE sx + step * ((ex - sx) / len / 2) END AS px, CASE WHEN step = 0 THEN sy ELSE sy + step * ((ey - sy) / len / 2) END AS py FROM {name}_i),
{name} AS (SELECT DISTINCT * EXCLUDE (len, step, px, py), {b.key_sql('px', 'py', SIZE)} FROM {name}_p)"""


@query(f"WITH {b.SP}, r AS (SELECT scan_id, pt_idx, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, round(x, 6) AS ex, round(y, 6) AS ey FROM sp), {rays_sql('rc', 'r')} SELECT scan_id, cx, cy, count(*) AS n_rays FROM rc GROUP BY ALL")
def ray_cells(spark: SparkSession, sf: str) -> DataFrame:
    rays = b.scan_points(spark, sf).select("scan_id", "pt_idx", F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.round("x", 6).alias("ex"), F.round("y", 6).alias("ey"))
    return spatial.ray_cells(rays, SIZE).groupBy("scan_id", "cx", "cy").agg(F.count(F.lit(1)).alias("n_rays"))


@query("""SELECT user_id AS robot, round(list_reduce(list((value - 50) / 100 ORDER BY ts, event_id), lambda a, x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, a + x)), 0.0::DOUBLE), 6) + 0.0 AS occ FROM events GROUP BY user_id""")
def occupancy_fold(spark: SparkSession, sf: str) -> DataFrame:
    e = b.table(spark, sf, "events").select(F.col("user_id").alias("robot"), "ts", "event_id", ((F.col("value") - 50) / 100).alias("delta"), F.to_date("ts").alias("day"))
    return occupancy.clamp_fold(e, ["robot"], ["ts", "event_id"], "delta", "day").select("robot", r6("occ"))


_TRACED = f"""WITH {b.CELLS}, rr AS (SELECT scan_id - 1 AS scan_id, cy AS ry, cx AS rx, n AS m, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, mx AS ex, my AS ey FROM cells WHERE has_gaussian), {rays_sql('rc', 'rr')}, {b.FLOORED.format(source='cells', name='fl')},
j AS (SELECT rc.scan_id, rc.cx, rc.cy, ry, rx, m, ex, ey, mx, my, ixx, ixy, iyy, occ, has_gaussian, sqrt(ex * ex + ey * ey) AS nrm FROM rc JOIN fl ON rc.scan_id = fl.scan_id AND rc.cx = fl.cx AND rc.cy = fl.cy),
k AS (SELECT *, ex / nrm AS lx, ey / nrm AS ly, ex - mx AS bx, ey - my AS by_ FROM j),
t AS (SELECT *, -((ixx * lx + ixy * ly) * bx + (ixy * lx + iyy * ly) * by_) / ((ixx * lx + ixy * ly) * lx + (ixy * lx + iyy * ly) * ly) AS t FROM k),
u AS (SELECT *, lx * t + bx AS px, ly * t + by_ AS py FROM t),
w AS (SELECT *, exp(-(px * (ixx * px + ixy * py) + py * (ixy * px + iyy * py)) / 2) AS lik, abs(mx - ex) + abs(my - ey) < 0.01 AS at_end FROM u),
d AS (SELECT *, 0.1 * (lik * (1 - exp(-0.5 * t * t / 0.0001))) + 0.5 AS p FROM w),
l AS (SELECT scan_id, cx, cy, any_value(occ) AS o, any_value(has_gaussian) AS g, count(*) AS n_rays,
  list({{'occ': 0.0::DOUBLE, 'g': at_end, 'm': m::DOUBLE, 'd': CASE WHEN at_end THEN 1.0 ELSE m * ln((1 - p) / p) END}} ORDER BY ry, rx) AS e FROM d GROUP BY ALL),
f AS (SELECT scan_id, cx, cy, n_rays, list_reduce(e, lambda a, x: {{'occ': greatest(-1.0, least(1.0, a.occ + CASE WHEN a.g THEN x.d ELSE -0.2 * x.m END)),
  'g': a.g AND (x.g OR greatest(-1.0, least(1.0, a.occ + CASE WHEN a.g THEN x.d ELSE -0.2 * x.m END)) > 0), 'm': 0.0::DOUBLE, 'd': 0.0::DOUBLE}}, {{'occ': o::DOUBLE, 'g': g, 'm': 0.0::DOUBLE, 'd': 0.0::DOUBLE}}) AS s FROM l)
SELECT scan_id, cx, cy, round(s.occ, 6) + 0.0 AS occ, s.g AS has_gaussian, n_rays FROM f"""


@query(_TRACED)
def ray_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    c = b.cells(spark, sf)
    rays = c.filter("has_gaussian").select((F.col("scan_id") - 1).alias("scan_id"), F.struct("cy", "cx").alias("rid"), F.col("n").alias("m"), F.lit(0.0).alias("sx"), F.lit(0.0).alias("sy"), F.col("mx").alias("ex"), F.col("my").alias("ey"))
    return occupancy.traced(c, rays, ["scan_id"], SIZE).select("scan_id", "cx", "cy", r6("occ"), "has_gaussian", "n_rays")


@query(f"""WITH {b.CELLS}, {EXT}, x AS (SELECT scan_id, up, down, unnest(range(-"left", "right" + 1)) AS cx FROM ext), d AS (SELECT scan_id, cx, unnest(range(-up, down + 1)) AS cy FROM x)
SELECT d.scan_id, d.cx, d.cy, CASE WHEN occ IS NULL THEN -1 WHEN occ > 0.8 THEN 99 ELSE 0 END AS value FROM d LEFT JOIN cells c ON d.scan_id = c.scan_id AND d.cx = c.cx AND d.cy = c.cy""")
def occupancy_raster(spark: SparkSession, sf: str) -> DataFrame:
    return occupancy.raster(b.cells(spark, sf), _extents(spark, sf), ["scan_id"])


@query(f"""WITH {b.CELLS}, {EXT}, m AS (SELECT scan_id, cx - 2 AS cx, cy - 1 AS cy, n, mx - 0.5 AS mx, my - (-0.25) AS my FROM cells)
SELECT m.scan_id, cx, cy, n, round(mx, 6) + 0.0 AS mx, round(my, 6) + 0.0 AS my, 0.1 AS rest_x, -0.05 AS rest_y FROM m JOIN ext e ON m.scan_id = e.scan_id WHERE cx BETWEEN -"left" AND "right" AND cy BETWEEN -up AND down""")
def grid_move(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.cells(spark, sf).select("scan_id", "cx", "cy", "n", "mx", "my").join(_extents(spark, sf), "scan_id")
    out, rx, ry = voxel.moved(rows, 0.6, -0.3, SIZE)
    return out.select("scan_id", "cx", "cy", "n", r6("mx"), r6("my"), F.round(F.lit(rx), 6).alias("rest_x"), F.round(F.lit(ry), 6).alias("rest_y"))


@query(f"""WITH {b.CELLS}, g AS (SELECT scan_id, n, {_C} * mx - {_S} * my AS mx, {_S} * mx + {_C} * my AS my, {_C * _C} * cxx - {2 * _C * _S} * cxy + {_S * _S} * cyy AS cxx,
  {_C * _S} * (cxx - cyy) + {_C * _C - _S * _S} * cxy AS cxy, {_S * _S} * cxx + {2 * _C * _S} * cxy + {_C * _C} * cyy AS cyy, czz FROM cells WHERE has_gaussian),
{b.FLOORED.format(source='g', name='fl')}, k AS (SELECT scan_id, {b.key_sql('mx', 'my', SIZE)}, n, mx, my, cxx, cxy, cyy FROM fl) {merge_sums_sql('k', 'scan_id, cx, cy')}""")
def grid_transform(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(voxel.transformed(b.cells(spark, sf), lits(MOVE), SIZE, ["scan_id"]), "scan_id", "cx", "cy")


def lookup_sql(name: str, step: float) -> str:
    k = lookup.kernel(step, 0.5)
    border = max(r for r, _, _ in k)
    vals = ", ".join(f"({r}, {c}, {v})" for r, c, v in k)
    return f"""{name}_b AS (SELECT scan_id, least(0.0, min(x)) AS minx, greatest(0.0, max(x)) AS maxx, least(0.0, min(y)) AS miny, greatest(0.0, max(y)) AS maxy, count(*) AS n_target FROM sp GROUP BY scan_id),
{name}_f AS (SELECT *, ceil((maxx - minx) / {step})::BIGINT + {1 + 2 * border} AS n_cols, ceil((maxy - miny) / {step})::BIGINT + {1 + 2 * border} AS n_rows FROM {name}_b),
{name}_o AS (SELECT DISTINCT scan_id, floor((x - minx + {step / 2}) / {step})::BIGINT + {border} AS ix, floor((maxy - y + {step / 2}) / {step})::BIGINT + {border} AS iy, n_cols, n_rows
  FROM sp JOIN {name}_f USING (scan_id) WHERE x < maxx AND x > minx AND y < maxy AND y > miny),
{name}_k(r, c, v) AS (VALUES {vals}),
{name} AS (SELECT scan_id, ix + c AS ix, iy + r AS iy, max(v)::BIGINT AS score FROM {name}_o, {name}_k WHERE (ix BETWEEN 1 AND n_cols - 2 AND iy BETWEEN 1 AND n_rows - 2) OR (r = 0 AND c = 0) GROUP BY scan_id, ix + c, iy + r)"""


@query(f"WITH {b.SP}, {lookup_sql('lt', SIZE)} SELECT * FROM lt")
def lookup_table(spark: SparkSession, sf: str) -> DataFrame:
    return lookup.lookup_table(b.scan_points(spark, sf), ["scan_id"], SIZE)


_NC, _NS = math.cos(NEAR[2]), math.sin(NEAR[2])


@query(f"""WITH {b.SP}, {lookup_sql('lt', SIZE)}, m AS (SELECT scan_id, round({_NC} * x - {_NS} * y + {NEAR[0]}, 6) AS x, round({_NS} * x + {_NC} * y + ({NEAR[1]}), 6) AS y FROM sp),
i AS (SELECT scan_id, floor((x - minx + {SIZE / 2}) / {SIZE})::BIGINT + 1 AS ix, floor((maxy - y + {SIZE / 2}) / {SIZE})::BIGINT + 1 AS iy FROM m JOIN lt_f USING (scan_id) WHERE x < maxx AND x > minx AND y < maxy AND y > miny),
s AS (SELECT scan_id, sum(score) AS total FROM i JOIN lt USING (scan_id, ix, iy) GROUP BY scan_id)
SELECT scan_id, round(coalesce(total, 0) / (100 * n_target), 6) AS score FROM lt_f LEFT JOIN s USING (scan_id)""")
def pose_score(spark: SparkSession, sf: str) -> DataFrame:
    p = b.scan_points(spark, sf)
    x, y = se2.apply(lits(NEAR), F.col("x"), F.col("y"))
    source = p.select("scan_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
    return lookup.pose_score(source, p, ["scan_id"], SIZE).select("scan_id", r6("score"))


@query(f"""WITH {b.SP}, {lookup_sql('lt', 0.5)}, th AS (SELECT -1.6 + i * 0.2 AS theta FROM range(0, 16) t(i)),
r AS (SELECT scan_id, theta::DOUBLE AS theta, floor((cos(theta) * x - sin(theta) * y - minx + 0.25) / 0.5)::BIGINT AS ix, floor((maxy - (sin(theta) * x + cos(theta) * y) + 0.25) / 0.5)::BIGINT AS iy FROM sp JOIN lt_f USING (scan_id) CROSS JOIN th),
h AS (SELECT scan_id, theta, ix, iy, count(*) AS points FROM r GROUP BY ALL),
c AS (SELECT h.scan_id, theta, (lt.ix - h.ix) * 0.5::DOUBLE AS dx, (h.iy - lt.iy) * 0.5::DOUBLE AS dy, sum(points * score) AS total FROM h JOIN lt ON lt.scan_id = h.scan_id WHERE lt.ix - h.ix BETWEEN -8 AND 7 AND h.iy - lt.iy BETWEEN -8 AND 7 GROUP BY ALL),
q AS (SELECT scan_id, theta, dx, dy, total / (100 * n_target) AS score FROM c JOIN lt_f USING (scan_id) QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY total DESC, theta, dx, dy) = 1)
SELECT scan_id, round(theta, 6) + 0.0 AS theta, dx, dy, round(score, 6) AS score FROM q""")
def correlative_search(spark: SparkSession, sf: str) -> DataFrame:
    p = b.scan_points(spark, sf)
    return lookup.correlative_best(p, p, ["scan_id"]).select("scan_id", r6("theta"), "dx", "dy", r6("score"))


_D1, _D2 = gauss.fitting(0.7, SIZE)
_E1, _E2 = gauss.fitting(0.55, SIZE)
_H = ("00", "01", "11", "02", "12", "22")


def _p2d_sql() -> str:
    j0, j1 = f"(-x * {_NS} - y * {_NC})", f"(x * {_NC} - y * {_NS})"
    qj = ["q0", "q1", f"(q0 * {j0} + q1 * {j1})"]
    bend = f"(q0 * (-x * {_NC} + y * {_NS}) + q1 * (-x * {_NS} - y * {_NC}))"
    jij = {"00": "ixx", "01": "ixy", "11": "iyy", "02": f"ixx * {j0} + ixy * {j1}", "12": f"ixy * {j0} + iyy * {j1}", "22": f"ixx * {j0} * {j0} + 2 * ixy * {j0} * {j1} + iyy * {j1} * {j1}"}
    ok = f"{_D2} * e BETWEEN 0 AND 1"
    out = [f"round(sum(CASE WHEN {ok} THEN -({_D1}) * e ELSE 0 END), 4) + 0.0 AS value"]
    out += [f"round(sum(CASE WHEN {ok} THEN {_D1 * _D2} * e * {qj[i]} ELSE 0 END), 4) + 0.0 AS g{i}" for i in range(3)]
    out += [f"round(sum(CASE WHEN {ok} THEN {_D1 * _D2} * e * (-{_D2} * {qj[int(k[0])]} * {qj[int(k[1])]} + {'0' if k == '22' else bend} + {v}) ELSE 0 END), 3) + 0.0 AS h{k}" for k, v in jij.items()]
    return f"""WITH {b.CELLS}, gg AS (SELECT * FROM cells WHERE has_gaussian), {b.FLOORED.format(source='gg', name='fl')},
p AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY pt_idx, x, y) AS pt_idx, x, y, round({_NC} * x - {_NS} * y + {NEAR[0]}, 6) AS tx, round({_NS} * x + {_NC} * y + ({NEAR[1]}), 6) AS ty FROM sp),
n AS (SELECT p.*, mx, my, ixx, ixy, iyy FROM p JOIN fl USING (scan_id) QUALIFY row_number() OVER (PARTITION BY scan_id, pt_idx ORDER BY (mx - tx) ** 2 + (my - ty) ** 2, cy * 100000 + cx) <= 4),
q AS (SELECT *, (tx - mx) * ixx + (ty - my) * ixy AS q0, (tx - mx) * ixy + (ty - my) * iyy AS q1 FROM n),
e AS (SELECT *, exp(-{_D2 / 2} * (q0 * (tx - mx) + q1 * (ty - my))) AS e FROM q)
SELECT scan_id, count(*) AS n_terms, {', '.join(out)} FROM e GROUP BY scan_id"""


@query(_p2d_sql())
def p2d_score_terms(spark: SparkSession, sf: str) -> DataFrame:
    g = voxel.floored(b.cells(spark, sf).filter("has_gaussian"))
    g = g.select("scan_id", (F.col("cy") * 100000 + F.col("cx")).alias("tid"), F.col("mx").alias("tx"), F.col("my").alias("ty"), "ixx", "ixy", "iyy")
    x, y = se2.apply(lits(NEAR), F.col("x"), F.col("y"))
    p = b.scan_points(spark, sf).select("scan_id", "x", "y", F.round(x, 6).alias("qx"), F.round(y, 6).alias("qy"))
    rows = spatial.nearest(p, g, ["scan_id"], 4).withColumnsRenamed({"tx": "mx", "ty": "my", "qx": "tx", "qy": "ty"})
    terms = registration.p2d_columns(NEAR[2], _D1, _D2)
    digits = lambda k: 3 if k[0] == "h" else 4
    return rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_terms"), *[(F.round(F.sum(v), digits(k)) + F.lit(0.0)).alias(k) for k, v in terms.items()])


_D2D = f"""WITH {b.CELLS}, gg AS (SELECT * FROM cells WHERE has_gaussian), {b.FLOORED.format(source='gg', name='fl')},
s AS (SELECT scan_id, cy * 100000 + cx AS sid, round({_NC} * mx - {_NS} * my + {NEAR[0]}, 6) AS sx, round({_NS} * mx + {_NC} * my + ({NEAR[1]}), 6) AS sy, {_NC * _NC} * cxx - {2 * _NC * _NS} * cxy + {_NS * _NS} * cyy AS sxx,
  {_NC * _NS} * (cxx - cyy) + {_NC * _NC - _NS * _NS} * cxy AS sxy, {_NS * _NS} * cxx + {2 * _NC * _NS} * cxy + {_NC * _NC} * cyy AS syy FROM fl),
n AS (SELECT s.*, mx, my, cxx, cxy, cyy FROM s JOIN fl USING (scan_id) QUALIFY row_number() OVER (PARTITION BY scan_id, sid ORDER BY (mx - sx) ** 2 + (my - sy) ** 2, cy * 100000 + cx) <= 2),
d AS (SELECT *, sxx + cxx AS xx, sxy + cxy AS xy, syy + cyy AS yy, sx - mx AS dx, sy - my AS dy FROM n),
q AS (SELECT *, (dx * yy - dy * xy) / (xx * yy - xy * xy) AS q0, (dy * xx - dx * xy) / (xx * yy - xy * xy) AS q1 FROM d),
v AS (SELECT *, -({_E1}) * exp(-{_E2 / 2} * (q0 * dx + q1 * dy)) AS value, q0 * q0 * (-2 * sxy) + 2 * q0 * q1 * (sxx - syy) + q1 * q1 * 2 * sxy AS turn FROM q)
SELECT scan_id, count(*) AS n_terms, round(sum(value), 4) + 0.0 AS value, round(sum(-{_E2 / 2} * value * 2 * q0), 4) + 0.0 AS g0, round(sum(-{_E2 / 2} * value * 2 * q1), 4) + 0.0 AS g1,
round(sum(-{_E2 / 2} * value * (2 * (q1 * sx - q0 * sy) - turn)), 4) + 0.0 AS g2 FROM v GROUP BY scan_id"""


@query(_D2D)
def d2d_score_terms(spark: SparkSession, sf: str) -> DataFrame:
    g = voxel.floored(b.cells(spark, sf).filter("has_gaussian")).withColumn("tid", F.col("cy") * 100000 + F.col("cx"))
    x, y = se2.apply(lits(NEAR), F.col("mx"), F.col("my"))
    cov = gauss.rotated(F.lit(NEAR[2]), F.col("cxx"), F.col("cxy"), F.col("cyy"))
    s = g.select("scan_id", F.round(x, 6).alias("qx"), F.round(y, 6).alias("qy"), *[v.alias(k) for k, v in zip(("sxx", "sxy", "syy"), cov)])
    t = g.select("scan_id", "tid", F.col("mx").alias("tx"), F.col("my").alias("ty"), "cxx", "cxy", "cyy")
    rows = spatial.nearest(s, t, ["scan_id"], 2).withColumnsRenamed({"tx": "mx", "ty": "my", "qx": "sx", "qy": "sy"})
    terms = registration.d2d_columns(_E1, _E2)
    return rows.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_terms"), *[(F.round(F.sum(v), 4) + F.lit(0.0)).alias(k) for k, v in terms.items()])


@query(f"WITH {b.GRAPH} SELECT robot, count(*) AS n_edges, round(sum(500 * e0 * e0 + 500 * e1 * e1 + 5000 * e2 * e2), 3) + 0.0 AS chi2 FROM res GROUP BY robot")
def edge_residual_chi2(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = b.graph(spark, sf)
    return graph.residuals(edges, nodes, ("robot",)).groupBy("robot").agg(F.count(F.lit(1)).alias("n_edges"), (F.round(F.sum("chi2"), 3) + F.lit(0.0)).alias("chi2"))


_JAC = "jac AS (SELECT *, cos(dtheta + st) AS c, sin(dtheta + st) AS s, ex - sx AS fx, ey - sy AS fy FROM ends)"
_A = ["-c", "-s", "(c * fy - s * fx)", "s", "-c", "(-(c * fx + s * fy))", "0.0", "0.0", "-1.0"]
_B = ["c", "s", "0.0", "(-s)", "c", "0.0", "0.0", "0.0", "1.0"]


@query(f"WITH {b.GRAPH}, {_JAC} SELECT robot, id, {', '.join(f'round({v}, 6) + 0.0 AS a{i}' for i, v in enumerate(_A))}, {', '.join(f'round({v}, 6) + 0.0 AS b{i}' for i, v in enumerate(_B))} FROM jac")
def edge_jacobians(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = b.graph(spark, sf)
    rows = graph.jacobians(edges, nodes, ("robot",))
    return rows.select("robot", "id", *[r6(f"{k}{i}") for k in "ab" for i in range(9)])


def _blocks_sql() -> str:
    w = (500, 500, 5000)
    entry = lambda p, q, r, c: " + ".join(f"{w[k]} * {p[3 * k + r]} * {q[3 * k + c]}" for k in range(3))
    cols = lambda p, q: ", ".join(f"{entry(p, q, r, c)} AS h{3 * r + c}" for r in range(3) for c in range(3))
    return f"""WITH {b.GRAPH}, {_JAC}, blk AS (SELECT robot, src AS i, src AS j, {cols(_A, _A)} FROM jac UNION ALL SELECT robot, dst, dst, {cols(_B, _B)} FROM jac
UNION ALL SELECT robot, src, dst, {cols(_A, _B)} FROM jac WHERE src < dst UNION ALL SELECT robot, dst, src, {cols(_B, _A)} FROM jac WHERE src > dst)
SELECT robot, i, j, {', '.join(f'round(sum(h{n}) + {b.OFF_HALF}, 5) + 0.0 AS h{n}' for n in range(9))} FROM blk GROUP BY robot, i, j"""


@query(_blocks_sql())
def normal_equation_blocks(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = b.graph(spark, sf)
    rows = graph.normal_blocks(edges, nodes, ("robot",))
    return rows.select("robot", "i", "j", *[(F.round(F.col(f"h{n}") + F.lit(b.OFF_HALF), 5) + F.lit(0.0)).alias(f"h{n}") for n in range(9)])


@query(f"""WITH {b.POSES} SELECT p.robot, p.id AS a, q.id AS b, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) AS distance, round(p.path - q.path, 6) AS path_distance
FROM poses p JOIN poses q ON p.robot = q.robot AND p.id > q.id WHERE sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) < 1.0 AND p.path - q.path >= 5.0""")
def loop_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = graph.loop_candidates(b.poses(spark, sf).select("robot", "id", "x", "y", "path"), ("robot",), 1.0, 5.0)
    return rows.select("robot", "a", "b", r6("distance"), r6("path_distance"))


_REACH = """ls AS (SELECT robot, max(id) AS id FROM nodes GROUP BY robot),
reach(robot, node, hop, distance) AS (SELECT robot, id, 0, CAST(0 AS DOUBLE) FROM ls
  UNION ALL SELECT r.robot, e.src, r.hop + 1, r.distance + abs(e.dx) FROM reach r JOIN edges e ON e.robot = r.robot AND e.dst = r.node WHERE e.type = 'ODOM')"""


@query(f"WITH RECURSIVE {b.GRAPH}, {_REACH} SELECT robot, node, hop, round(distance, 6) AS distance FROM reach")
def backward_reachability(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = b.graph_of(storage.stored(b.poses(spark, sf)))
    return graph.backward_reach(nodes, edges, ("robot",)).select("robot", "node", "hop", r6("distance"))


_SIDES = "l AS (SELECT user_id AS robot, ts, event_id AS id, value FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id AS robot, ts, event_id AS id, value FROM events WHERE event_id % 2 = 1)"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = b.table(spark, sf, "events").select(F.col("user_id").alias("robot"), "ts", F.col("event_id").alias("id"), "value")
    return e.filter("id % 2 = 0"), e.filter("id % 2 = 1")


@query(f"WITH {_SIDES}, p AS (SELECT robot, ts, max(id) AS id, max_by(value, id) AS value FROM r GROUP BY robot, ts) SELECT l.robot, l.id, p.id AS right_id, p.value AS right_value FROM l ASOF JOIN p ON l.robot = p.robot AND l.ts >= p.ts")
def asof_pose(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    one = right.groupBy("robot", "ts").agg(F.max("id").alias("id"), F.max_by("value", "id").alias("value"))
    return trajectory.asof(left, one, ["robot"], "ts", ["id", "value"]).select("robot", "id", "right_id", "right_value")


@query(f"""WITH {_SIDES}, p AS (SELECT robot, ts, max_by(value, id) AS value FROM r GROUP BY robot, ts),
b AS (SELECT l.robot, l.id, l.ts, p.ts AS t0, p.value AS v0 FROM l ASOF JOIN p ON l.robot = p.robot AND l.ts >= p.ts),
f AS (SELECT b.*, p.ts AS t1, p.value AS v1 FROM b ASOF JOIN p ON b.robot = p.robot AND b.ts <= p.ts)
SELECT robot, id, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) END + {b.OFF_HALF}, 6) + 0.0 AS value FROM f""")
def interpolated_pose(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    one = right.groupBy("robot", "ts").agg(F.max_by("value", "id").alias("value"))
    rows = trajectory.interpolated(left.select("robot", "ts", "id"), one, ["robot"], "ts", "value")
    return rows.select("robot", "id", (F.round(F.col("at_value") + F.lit(b.OFF_HALF), 6) + F.lit(0.0)).alias("value"))


@query(f"""WITH {b.POSES}, l AS (SELECT robot, list({{'x': x, 'y': y, 'theta': theta, 'at': id, 'pairs': [id, id]}} ORDER BY id) AS s FROM poses GROUP BY robot),
f AS (SELECT robot, list_reduce(s, lambda a, p: CASE WHEN abs(atan2(sin(p.theta - a.theta), cos(p.theta - a.theta))) > 0.25 AND sqrt((p.x - a.x) ** 2 + (p.y - a.y) ** 2) > 0.4
  THEN {{'x': p.x, 'y': p.y, 'theta': p.theta, 'at': p.at, 'pairs': list_concat(a.pairs, [p.at])}} ELSE a END) AS s FROM l),
c AS (SELECT robot, s.pairs[2:] AS c FROM f) SELECT robot, c[i + 1] AS source, c[i] AS target FROM (SELECT robot, c, unnest(range(1, len(c))) AS i FROM c)""")
def pair_selection(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.pair_selection(b.poses(spark, sf).select("robot", "id", "x", "y", "theta"), ["robot"], "id", 0.25).select("robot", "source", "target")


@query(f"""WITH {b.SP} SELECT scan_id, round(avg(x) + {b.OFF_HALF}, 6) + 0.0 AS centroid_x, round(avg(y) + {b.OFF_HALF}, 6) + 0.0 AS centroid_y,
round(greatest(list_sort(list(abs(x)))[count(*) // 3 * 2 + 1], list_sort(list(abs(y)))[count(*) // 3 * 2 + 1]), 6) AS radius FROM sp GROUP BY scan_id""")
def cloud_size(spark: SparkSession, sf: str) -> DataFrame:
    return voxel.cloud_size(b.scan_points(spark, sf), ["scan_id"]).select("scan_id", b.off_half("centroid_x"), b.off_half("centroid_y"), r6("radius"))


@query(f"""WITH {_SIDES}, p AS (SELECT l.robot, l.id AS left_id, r.id AS right_id, epoch_us(l.ts) AS lt, epoch_us(r.ts) AS rt, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS gap_us FROM l JOIN r ON l.robot = r.robot AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 3600000000),
q AS (SELECT *, row_number() OVER (PARTITION BY robot, left_id ORDER BY gap_us, rt, right_id) AS i, row_number() OVER (PARTITION BY robot, right_id ORDER BY gap_us, lt, left_id) AS j FROM p)
SELECT robot, left_id, right_id, gap_us FROM q WHERE i = 1 AND j = 1""")
def nearest_time_sync(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return trajectory.nearest_in_time(left, right, ["robot"], 3600.0)


@query(f"WITH {b.GRAPH} SELECT robot, id, sx, sy, ex, ey, CASE WHEN type = 'ODOM' THEN 'red' ELSE 'green' END AS colour FROM ends")
def graph_markers(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = b.graph(spark, sf)
    return graph.markers(edges, nodes, ("robot",))


@query(f"""WITH {b.GRAPH} SELECT line FROM (SELECT format('p{{}}->p{{}}', src, dst) AS line FROM edges)""")
def graph_dot(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = b.graph(spark, sf)
    return graph.dot_lines(edges, nodes).filter(F.col("line").contains("->"))


@query(f"""WITH {b.GRAPH}, k AS (SELECT robot, id, -ln(0.9) - 0.5 * ({math.log(500) * 2 + math.log(5000)}) + 0.5 * (500 * e0 * e0 + 500 * e1 * e1 + 5000 * e2 * e2) AS cost0, -ln(0.1) - 0.5 * ({3 * math.log(5e-9)}) + 0.5 * 5e-9 * (e0 * e0 + e1 * e1 + e2 * e2) AS cost1 FROM res)
SELECT robot, id, round(cost0, 3) + 0.0 AS cost0, round(cost1, 3) + 0.0 AS cost1, CASE WHEN cost1 < cost0 THEN 1 ELSE 0 END AS component FROM k""")
def max_mixture_component(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = b.graph(spark, sf)
    rows = graph.max_mixture(graph.residuals(edges, nodes, ("robot",)))
    return rows.select("robot", "id", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("cost0", "cost1")], "component")


@query(f"WITH {b.GRAPH} SELECT robot, id, round(least(1.0, id % 15 / 10) * e0, 5) + 0.0 AS e0, round(least(1.0, id % 15 / 10) * e1, 5) + 0.0 AS e1, round(1 - least(1.0, id % 15 / 10), 6) AS prior FROM res")
def switchable_error(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = b.graph(spark, sf)
    rows = graph.switchable(graph.residuals(edges, nodes, ("robot",)), (F.col("id") % 15) / 10)
    return rows.select("robot", "id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("e0", "e1")], r6("prior"))


@query(f"""WITH {b.CELLS}, {EXT}, x AS (SELECT scan_id, up, down, unnest(range(-"left", "right" + 1)) AS cx FROM ext), d AS (SELECT scan_id, cx, unnest(range(-up, down + 1)) AS cy FROM x)
SELECT d.scan_id, d.cy, string_agg(CASE WHEN has_gaussian THEN 'W' WHEN has_gaussian IS NOT NULL THEN '.' ELSE ' ' END, '' ORDER BY d.cx) AS line FROM d LEFT JOIN cells c ON d.scan_id = c.scan_id AND d.cx = c.cx AND d.cy = c.cy GROUP BY d.scan_id, d.cy""")
def ascii_grid(spark: SparkSession, sf: str) -> DataFrame:
    return writers.ascii_rows(b.cells(spark, sf), _extents(spark, sf), ["scan_id"])


@query(f'WITH {b.CELLS}, {EXT} SELECT e.scan_id, round(("left" + "right" + 1) * {SIZE}, 6) AS x_size, round((up + down + 1) * {SIZE}, 6) AS y_size, count(*) AS n_cells, round(sum(mx), 6) + 0.0 AS sum_mean_x, sum(n)::BIGINT AS sum_n FROM ext e JOIN cells c ON e.scan_id = c.scan_id WHERE has_gaussian GROUP BY ALL')
def ndt_map_message(spark: SparkSession, sf: str) -> DataFrame:
    m = writers.map_messages(b.cells(spark, sf), _extents(spark, sf), ["scan_id"], SIZE)
    mean = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c.mean_x)
    return m.select("scan_id", r6("x_size"), r6("y_size"), F.size("cells").cast("long").alias("n_cells"), r6(mean, "sum_mean_x"), F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c.N).alias("sum_n"))


def _register(spark: SparkSession, sf: str, method: str, **options) -> DataFrame:
    """Every scan against itself moved by a known transform; the result undoes it."""
    p = b.scan_points(spark, sf).select(F.col("scan_id").alias("pair_id"), "x", "y")
    x, y = se2.apply(se2.inverse(lits(NEAR)), F.col("x"), F.col("y"))
    return registration.register_pairs(p.select("pair_id", x.alias("x"), y.alias("y")), p, method, **options)


@query()
def p2d_register(spark: SparkSession, sf: str) -> DataFrame:
    return _register(spark, sf, "p2d")


@query()
def d2d_register(spark: SparkSession, sf: str) -> DataFrame:
    return _register(spark, sf, "d2d")


@query()
def robust_register(spark: SparkSession, sf: str) -> DataFrame:
    return _register(spark, sf, "robust")


@query()
def pose_graph_optimize(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = b.graph_of(storage.stored(b.poses(spark, sf)))
    return graph.optimise_each(nodes, edges)


@query(f"WITH {b.SP}, {b.cells_sql('c0', 'sp', 'scan_id, ')} SELECT scan_id, cx, cy, n, round(mx + {b.OFF_HALF}, 6) + 0.0 AS mx, round(my + {b.OFF_HALF}, 6) + 0.0 AS my, round(occ + {b.OFF_HALF}, 6) + 0.0 AS occ FROM c0")
def stream_map(spark: SparkSession, sf: str) -> DataFrame:
    source = b.table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    landing, out, state = (storage.fresh_path(spark) for _ in range(3))
    source.write.parquet(landing)
    t = spark.readStream.schema(source.schema).parquet(landing)
    x, y = (F.col("l_quantity") - 25.5) / 20.0, (F.col("l_extendedprice") % 1000.0) / 400.0 - 1.25
    points = t.select(F.col("l_suppkey").alias("scan_id"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    live.run_to_end(live.stream_cells(points, SIZE), state, lambda batch, _: batch.write.mode("overwrite").parquet(out), "complete")
    return spark.read.parquet(out).select("scan_id", "cx", "cy", "n", *[b.off_half(c) for c in ("mx", "my", "occ")])


@query()
def stream_slam_state(spark: SparkSession, sf: str) -> DataFrame:
    p = b.scan_points(spark, sf)
    scans = p.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p"))
    scans = scans.select((F.col("scan_id") % 10).alias("robot"), F.col("scan_id").alias("seq"), F.lit(0.25).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.05).alias("dtheta"), F.transform("p", lambda s: s.x).alias("px"), F.transform("p", lambda s: s.y).alias("py"))
    return live.replay(scans, Config(loop_min_distance=4.0))
