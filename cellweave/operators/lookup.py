"""Look-up tables and the exhaustive correlative search, all as joins and aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators import voxel

OCCUPIED = 100


def kernel(step: float, sigma: float) -> list[tuple[int, int, int]]:
    """(row, column, value) of the smoothing kernel for a table of the given step."""
    res = 1 / step
    sigma = min(max(sigma, 0.5 * res), 10 * res)
    half = math.floor(2 * sigma / res + 0.5)
    value = lambda r, c: math.floor(math.exp(-0.5 * (math.hypot(c * res, r * res) / sigma) ** 2) * OCCUPIED + 0.5)
    return [(r, c, value(r, c)) for r in range(-half, half + 1) for c in range(-half, half + 1)]


def table_frame(points: DataFrame, keys: Sequence[str], step: float, sigma: float = 0.5) -> DataFrame:
    """Bounds of each target with columns and rows of its table and its number of points."""
    border = max(r for r, _, _ in kernel(step, sigma))
    box = voxel.bounds(points, keys)
    size = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_target"))
    count = lambda lo, hi: (F.ceil((F.col(hi) - F.col(lo)) / step) + 1 + 2 * border).cast("long")
    return box.join(size, list(keys)).withColumns({"n_cols": count("minx", "maxx"), "n_rows": count("miny", "maxy")})


def table_index(x: Column, y: Column, step: float, border: int) -> tuple[Column, Column]:
    ix = F.floor((x - F.col("minx") + step / 2) / step) + border
    return ix.cast("long"), (F.floor((F.col("maxy") - y + step / 2) / step) + border).cast("long")


def lookup_table(points: DataFrame, keys: Sequence[str], step: float, sigma: float = 0.5) -> DataFrame:
    """ix, iy, score: occupied cells spread by the kernel, the largest value winning. Cells of score 0 are left out."""
    k = kernel(step, sigma)
    border = max(r for r, _, _ in k)
    rows = points.join(table_frame(points, keys, step, sigma), list(keys))
    strictly = (F.col("x") < F.col("maxx")) & (F.col("x") > F.col("minx")) & (F.col("y") < F.col("maxy")) & (F.col("y") > F.col("miny"))
    ix, iy = table_index(F.col("x"), F.col("y"), step, border)
    taken = rows.filter(strictly).select(*keys, ix.alias("ix"), iy.alias("iy"), "n_cols", "n_rows").distinct()
    inner = F.col("ix").between(1, F.col("n_cols") - 2) & F.col("iy").between(1, F.col("n_rows") - 2)
    shifts = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(r).alias("r"), F.lit(v).alias("v")) for r, c, v in k])
    only = F.array(F.struct(F.lit(0).alias("c"), F.lit(0).alias("r"), F.lit(OCCUPIED).alias("v")))
    spread = taken.withColumn("k", F.explode(F.when(inner, shifts).otherwise(only)))
    return spread.groupBy(*keys, (F.col("ix") + F.col("k.c")).alias("ix"), (F.col("iy") + F.col("k.r")).alias("iy")).agg(F.max("k.v").cast("long").alias("score"))


def candidates(rotation_range: float = 1.6, rotation_step: float = 0.2, shift_range: float = 4.0, shift_step: float = 0.5) -> tuple[Column, int, int]:
    """Rotations as a literal to explode, and the first and last shift in whole cells. The steps are counted, not accumulated."""
    n_rot, n_shift = math.ceil(2 * rotation_range / rotation_step - 1e-9), math.ceil(2 * shift_range / shift_step - 1e-9)
    first = math.floor(-shift_range / shift_step)
    return F.array(*[F.lit(-rotation_range + i * rotation_step) for i in range(n_rot)]), first, first + n_shift - 1


def correlative_scores(source: DataFrame, target: DataFrame, keys: Sequence[str], step: float = 0.5, rotation_range: float = 1.6, rotation_step: float = 0.2, shift_range: float = 4.0, fix_border: bool = False) -> DataFrame:
    """theta, dx, dy, score for every candidate that meets an occupied cell.

    Points fall to table cells and are counted there first. A source cell and an occupied target cell fix one shift, so their
    pairs within a scan are summed by shift; shifts that meet nothing never arise. The range must be a multiple of the step.
    Points are dealt by scan before the rotations multiply them; what follows happens within the scan and is not sent again.
    """
    rotations, first, last = candidates(rotation_range, rotation_step, shift_range, step)
    border = max(r for r, _, _ in kernel(step, 0.5)) if fix_border else 0
    frame = table_frame(target, keys, step)
    rows = source.repartition(*keys).join(frame, list(keys)).withColumn("theta", F.explode(rotations))
    c, s = F.cos("theta"), F.sin("theta")
    rows = rows.withColumns({"rx": c * F.col("x") - s * F.col("y"), "ry": s * F.col("x") + c * F.col("y")})
    ix, iy = table_index(F.col("rx"), F.col("ry"), step, border)
    held = rows.groupBy(*keys, "theta", ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("points"))
    table = lookup_table(target, keys, step).withColumnsRenamed({"ix": "tx", "iy": "ty"})
    pairs = held.join(table, list(keys)).withColumns({"cx": F.col("tx") - F.col("ix"), "cy": F.col("iy") - F.col("ty")})
    pairs = pairs.filter(F.col("cx").between(first, last) & F.col("cy").between(first, last))
    sums = pairs.groupBy(*keys, "theta", "cx", "cy").agg(F.sum(F.col("points") * F.col("score")).alias("total"))
    sums = sums.withColumns({"dx": F.col("cx") * step, "dy": F.col("cy") * step})
    out = sums.join(frame.select(*keys, "n_target"), list(keys))
    return out.select(*keys, "theta", "dx", "dy", (F.col("total") / (OCCUPIED * F.col("n_target"))).alias("score"))


def correlative_best(source: DataFrame, target: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """The candidate of largest score; of equal ones the least rotation, then the least shift."""
    rows = correlative_scores(source, target, keys, **options)
    pick = F.max_by(F.struct("theta", "dx", "dy", "score"), F.struct("score", -F.col("theta"), -F.col("dx"), -F.col("dy")))
    return rows.groupBy(*keys).agg(pick.alias("b")).select(*keys, "b.*")


def pose_score(source: DataFrame, target: DataFrame, keys: Sequence[str], step: float = 0.25) -> DataFrame:
    """The proof score of source points (already moved) on the target's table: their sum over 100 * target points."""
    border = max(r for r, _, _ in kernel(step, 0.5))
    frame = table_frame(target, keys, step)
    rows = source.join(frame, list(keys))
    ix, iy = table_index(F.col("x"), F.col("y"), step, border)
    strictly = (F.col("x") < F.col("maxx")) & (F.col("x") > F.col("minx")) & (F.col("y") < F.col("maxy")) & (F.col("y") > F.col("miny"))
    rows = rows.filter(strictly).groupBy(*keys, ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("points"))
    sums = rows.join(lookup_table(target, keys, step), [*keys, "ix", "iy"]).groupBy(*keys).agg(F.sum(F.col("points") * F.col("score")).alias("total"))
    out = frame.select(*keys, "n_target").join(sums, list(keys), "left")
    return out.select(*keys, (F.coalesce("total", F.lit(0)) / (OCCUPIED * F.col("n_target"))).alias("score"))
