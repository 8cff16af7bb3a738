"""Occupancy: ordered folds of clamped updates, ray updates and rasters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import gauss
from cellweave.operators import spatial, voxel
from cellweave.schemas import MAX_OCC, MIN_OCC, NO_GAUSSIAN_UPDATE


def clamp_fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str], delta: str, bucket: str | None = None) -> DataFrame:
    """occ: the updates of each key in order, clamped after each, from 0.

    x -> min(hi, max(lo, x + d)) is closed under composition, so with a bucket column (which must agree with the order) each
    bucket folds to one (d, lo, hi) by itself and only those are folded for the key.
    """

    def folded(seq):
        def step(s, e):
            return F.struct(
                (s.d + e.d).alias("d"),
                F.least(e.hi, F.greatest(e.lo, s.lo + e.d)).alias("lo"),
                F.least(e.hi, F.greatest(e.lo, s.hi + e.d)).alias("hi"),
            )

        start = F.struct(F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
        return F.aggregate(seq, start, step)

    one = F.struct(*order, F.col(delta).cast("double").alias("d"), F.lit(MIN_OCC).alias("lo"), F.lit(MAX_OCC).alias("hi"))
    rows = rows.groupBy(*keys, *([bucket] if bucket else [])).agg(folded(F.array_sort(F.collect_list(one))).alias("f"))
    if bucket:
        part = F.struct(bucket, "f.d", "f.lo", "f.hi")
        rows = rows.groupBy(*keys).agg(folded(F.array_sort(F.collect_list(part))).alias("f"))
    return rows.select(*keys, F.least("f.hi", F.greatest("f.lo", "f.d")).alias("occ"))


def traced(cells: DataFrame, rays: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Cells after rays have crossed them: keys, cx, cy, occ, has_gaussian and the number of rays.

    rays: keys, rid (struct or value that orders them), m (points behind the ray), sx, sy, ex, ey. Likelihoods come from one
    join; only the two-field state is folded in order, since a cell that loses its Gaussian keeps losing occupancy.
    """
    crossed = spatial.ray_cells(rays, size)
    rows = crossed.join(voxel.floored(cells), [*keys, "cx", "cy"])
    lik, to_end = gauss.line_likelihood(*[F.col(c) for c in ("sx", "sy", "ex", "ey", "mx", "my", "ixx", "ixy", "iyy")])
    at_end = F.abs(F.col("mx") - F.col("ex")) + F.abs(F.col("my") - F.col("ey")) < 0.01
    delta = F.when(at_end, F.lit(MAX_OCC)).otherwise(gauss.ray_delta(F.col("m"), lik, to_end))
    event = F.struct("rid", F.col("m").cast("double").alias("m"), at_end.alias("end"), delta.alias("d"))
    rows = rows.groupBy(*keys, "cx", "cy").agg(F.array_sort(F.collect_list(event)).alias("e"), F.first("occ").alias("o"), F.first("has_gaussian").alias("g"))

    def step(s, e):
        occ = gauss.clamp_occ(s.occ + F.when(s.g, e.d).otherwise(NO_GAUSSIAN_UPDATE * e.m))
        return F.struct(occ.alias("occ"), (s.g & (e.end | (occ > 0))).alias("g"))

    start = F.struct(F.col("o").cast("double").alias("occ"), F.col("g").alias("g"))
    rows = rows.withColumn("s", F.aggregate("e", start, step))
    return rows.select(*keys, "cx", "cy", F.col("s.occ").alias("occ"), F.col("s.g").alias("has_gaussian"), F.size("e").cast("long").alias("n_rays"))


def raster(cells: DataFrame, extents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """value for every cell within the extents: -1 where there is none, 99 above 0.8, else 0."""
    columns = extents.select(*keys, "up", "down", F.explode(F.sequence(-F.col("left"), F.col("right"))).alias("cx"))
    dense = columns.select(*keys, "cx", F.explode(F.sequence(-F.col("up"), F.col("down"))).alias("cy"))
    rows = dense.join(cells.select(*keys, "cx", "cy", "occ"), [*keys, "cx", "cy"], "left")
    value = F.when(F.col("occ").isNull(), -1).when(F.col("occ") > 0.8, 99).otherwise(0).cast("int")
    return rows.select(*keys, "cx", "cy", value.alias("value"))


def percent(occ):
    """Occupancy in percent, at most 100."""
    return F.least(F.lit(100), F.floor(occ * 100)).cast("int")
