"""Trajectories: prefix products of motions, motions between poses, and concatenated covariances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import se2


def _running(rows: DataFrame, value: Column, name: str, keys: Sequence[str], order: Sequence[str], bucket: str | None, before: bool) -> DataFrame:
    """Adds the sum of value over the rows up to this one, or before it. With a bucket no task orders a whole key."""
    end = -1 if before else 0
    inner = Window.partitionBy(*keys, *([bucket] if bucket else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    rows = rows.withColumn("_v", value).withColumn(name, F.coalesce(F.sum("_v").over(inner), F.lit(0.0)))
    if bucket:
        outer = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        base = rows.groupBy(*keys, bucket).agg(F.sum("_v").alias("_s"))
        base = base.select(*keys, bucket, F.coalesce(F.sum("_s").over(outer), F.lit(0.0)).alias("_base"))
        rows = rows.join(base, [*keys, bucket]).withColumn(name, F.col(name) + F.col("_base")).drop("_base")
    return rows.drop("_v")


def prefix_poses(motions: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str | None = None) -> DataFrame:
    """Adds x, y, theta: the motions (dx, dy, dtheta) of each key composed up to and with each row."""
    rows = _running(motions, F.col("dtheta"), "_t", keys, order, bucket, True)
    c, s = F.cos("_t"), F.sin("_t")
    rows = _running(rows, c * F.col("dx") - s * F.col("dy"), "x", keys, order, bucket, False)
    rows = _running(rows, s * F.col("dx") + c * F.col("dy"), "y", keys, order, bucket, False)
    return rows.withColumn("theta", se2.normalize_angle(F.col("_t") + F.col("dtheta"))).drop("_t")


def motions(poses: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """dx, dy, dtheta of each pose seen from the one before; the first of each key has none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = tuple(F.lag(c).over(w) for c in ("x", "y", "theta"))
    step = se2.relative(before, (F.col("x"), F.col("y"), F.col("theta")))
    return poses.withColumns(dict(zip(("dx", "dy", "dtheta"), step))).filter(F.col("dx").isNotNull())


def concatenated_covariance(steps: DataFrame, keys: Sequence[str], order: Sequence[str], noise: float) -> DataFrame:
    """The covariance (six distinct entries) after all steps of a key, from the identity; each step adds noise * identity."""
    seq = F.array_sort(F.collect_list(F.struct(*order, "dx", "dy", "dtheta")))

    def step(s, e):
        c, n = F.cos(e.dtheta), F.sin(e.dtheta)
        u, v = -n * e.dx - c * e.dy, c * e.dx - n * e.dy
        q = F.lit(noise)
        return F.struct(
            (s.xx + 2 * u * s.xt + u * u * s.tt + q).alias("xx"),
            (s.xy + v * s.xt + u * s.yt + u * v * s.tt).alias("xy"),
            (s.xt + u * s.tt).alias("xt"),
            (s.yy + 2 * v * s.yt + v * v * s.tt + q).alias("yy"),
            (s.yt + v * s.tt).alias("yt"),
            (s.tt + q).alias("tt"),
        )

    start = F.struct(*[F.lit(v).alias(k) for k, v in (("xx", 1.0), ("xy", 0.0), ("xt", 0.0), ("yy", 1.0), ("yt", 0.0), ("tt", 1.0))])
    return steps.groupBy(*keys).agg(F.aggregate(seq, start, step).alias("c")).select(*keys, "c.*")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], forward: bool = False) -> DataFrame:
    """Each row of left with the values of the last row of right not after it, or the first not before it if forward; rows
    without one are dropped."""
    marked = left.withColumns({"_r": F.lit(1), **{f"_{v}": F.lit(None).cast(right.schema[v].dataType) for v in values}})
    other = right.select(*keys, ts, *[F.col(v).alias(f"_{v}") for v in values], F.lit(0).alias("_r"))
    rows = marked.unionByName(other, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc(ts) if forward else F.asc(ts), "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_r") == 0, F.struct(*[F.col(f"_{v}").alias(v) for v in values])), ignorenulls=True).over(w)
    return rows.withColumn("_f", found).filter("_r = 1 AND _f IS NOT NULL").select(*left.columns, *[F.col(f"_f.{v}").alias(f"right_{v}") for v in values])


def interpolated(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """Adds value as it lies between the rows of right before and after each row of left; rows not between two are dropped."""
    timed = right.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    before = asof(left, timed, keys, ts, ["_us", value]).withColumnsRenamed({"right__us": "_t0", f"right_{value}": "_v0"})
    both = asof(before, timed, keys, ts, ["_us", value], forward=True)
    span, at = F.col("right__us") - F.col("_t0"), F.unix_micros(F.col(ts).cast("timestamp")) - F.col("_t0")
    between = F.when(span == 0, F.col("_v0")).otherwise(F.col("_v0") + (F.col(f"right_{value}") - F.col("_v0")) * (at / F.nullif(span, F.lit(0))))
    return both.select(*left.columns, between.alias(f"at_{value}"))


def pair_selection(poses: DataFrame, keys: Sequence[str], order: str, least_rotation: float = 0.3, least_distance: float = 0.4) -> DataFrame:
    """source, target: poses far enough, in rotation and distance, from the one chosen last; the first pose is chosen."""
    seq = F.array_sort(F.collect_list(F.struct(order, "x", "y", "theta")))

    def step(s, p):
        turn = F.abs(se2.angle_difference((s.x, s.y, s.theta), (p.x, p.y, p.theta)))
        far = (turn > least_rotation) & (F.sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) > least_distance)
        pair = F.array(F.struct(p[order].alias("source"), s.at.alias("target")))
        chosen = F.struct(p.x.alias("x"), p.y.alias("y"), p.theta.alias("theta"), p[order].alias("at"), F.concat(s.pairs, pair).alias("pairs"))
        return F.when(far, chosen).otherwise(s)

    first = F.get("seq", 0)
    kind = poses.schema[order].dataType.simpleString()
    start = F.struct(first.x.alias("x"), first.y.alias("y"), first.theta.alias("theta"), first[order].alias("at"), F.expr(f"cast(array() as array<struct<source:{kind},target:{kind}>>)").alias("pairs"))
    rows = poses.groupBy(*keys).agg(seq.alias("seq")).withColumn("s", F.aggregate("seq", start, step))
    return rows.select(*keys, F.explode("s.pairs").alias("p")).select(*keys, "p.*")


def nearest_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], tolerance_s: float) -> DataFrame:
    """Pairs (left_id, right_id, gap_us), each row once: mutual nearest within the tolerance, ties to the earlier one.

    Rows meet by time slices as wide as the tolerance, an equi-join on at most three slices.
    """
    wide = int(tolerance_s * 1e6)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    a = left.select(*keys, F.col("id").alias("left_id"), us("ts").alias("lt")).withColumn("slice", F.explode(F.array(*[F.floor(F.col("lt") / wide) + i for i in (-1, 0, 1)])))
    b = right.select(*keys, F.col("id").alias("right_id"), us("ts").alias("rt")).withColumn("slice", F.floor(F.col("rt") / wide))
    pairs = a.join(b, [*keys, "slice"]).withColumn("gap_us", F.abs(F.col("lt") - F.col("rt"))).filter(F.col("gap_us") <= wide)
    by_left = Window.partitionBy(*keys, "left_id").orderBy("gap_us", "rt", "right_id")
    by_right = Window.partitionBy(*keys, "right_id").orderBy("gap_us", "lt", "left_id")
    ranked = pairs.withColumns({"i": F.row_number().over(by_left), "j": F.row_number().over(by_right)})
    return ranked.filter("i = 1 AND j = 1").select(*keys, "left_id", "right_id", "gap_us")
