"""Cell Gaussians as Column expressions. z is constant over a scan, so it splits off every 3 x 3 matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.schemas import LOG_LIKE_OCCUPANCY, MAX_OCC, MIN_OCC, SENSOR_NOISE

FLOOR = 0.01  # least eigenvalue, as a share of the largest


def clamp_occ(x: Column) -> Column:
    return F.greatest(F.lit(MIN_OCC), F.least(F.lit(MAX_OCC), x))


def point_occ(n: Column) -> Column:
    return clamp_occ(n * LOG_LIKE_OCCUPANCY)


def seeded_covariance(n: Column, sxx: Column, sxy: Column, syy: Column, mx: Column, my: Column) -> tuple[Column, Column, Column, Column]:
    """cxx, cxy, cyy, czz from sums of products to which the identity has been added, scaled by (n - 1) / n."""
    scale = (n - 1) / n
    return ((sxx + 1) / n - mx * mx) * scale, (sxy / n - mx * my) * scale, ((syy + 1) / n - my * my) * scale, scale / n


def floored(cxx: Column, cxy: Column, cyy: Column, czz: Column) -> dict[str, Column]:
    """Covariance with its eigenvalues raised to FLOOR of the largest, and its inverse, in closed form."""
    half, gap = (cxx + cyy) / 2, F.sqrt((cxx - cyy) * (cxx - cyy) / 4 + cxy * cxy)
    l1, l2 = half + gap, half - gap
    least = FLOOR * F.greatest(l1, czz)
    f1, f2 = F.greatest(l1, least), F.greatest(l2, least)
    lift = F.when(gap > 0, (f1 - f2) / (2 * gap)).otherwise(F.lit(0.0))
    base = F.when(gap > 0, f2).otherwise(f1)
    xx, xy, yy = base + lift * (cxx - l2), lift * cxy, base + lift * (cyy - l2)
    det = F.nullif(xx * yy - xy * xy, F.lit(0.0))  # a cell of one point has no inverse
    return {"cxx": xx, "cxy": xy, "cyy": yy, "czz": F.greatest(czz, least), "ixx": yy / det, "ixy": -xy / det, "iyy": xx / det}


def line_likelihood(sx: Column, sy: Column, ex: Column, ey: Column, mx: Column, my: Column, ixx: Column, ixy: Column, iyy: Column) -> tuple[Column, Column]:
    """Largest likelihood of a Gaussian on the line start-end, and the distance from that place to the end."""
    norm = F.nullif(F.sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)), F.lit(0.0))
    lx, ly = (ex - sx) / norm, (ey - sy) / norm
    ax, ay = ixx * lx + ixy * ly, ixy * lx + iyy * ly
    bx, by = ex - mx, ey - my
    t = -(ax * bx + ay * by) / (ax * lx + ay * ly)
    px, py = lx * t + bx, ly * t + by  # from the mean
    lik = F.exp(-(px * (ixx * px + ixy * py) + py * (ixy * px + iyy * py)) / 2)
    return lik, F.abs(t)


def ray_delta(n: Column, lik: Column, to_end: Column) -> Column:
    """Log-odds that n rays through a Gaussian cell add."""
    near = F.exp(-0.5 * to_end * to_end / SENSOR_NOISE**2)
    p = 0.1 * (lik * (1 - near)) + 0.5
    return n * F.log((1 - p) / p)


def fitting(outlier: float, cell_size: float) -> tuple[float, float]:
    """d1, d2 of the scoring function for an outlier share and a cell size (Magnusson 2009, eq. 6.8)."""
    c1, c2 = 10 * (1 - outlier), outlier * cell_size**2
    d3 = -math.log(c2)
    d1 = -math.log(c1 + c2) - d3
    return d1, -2 * math.log((-math.log(c1 * math.exp(-0.5) + c2) - d3) / d1)


def rotated(theta: Column, cxx: Column, cxy: Column, cyy: Column) -> tuple[Column, Column, Column]:
    c, s = F.cos(theta), F.sin(theta)
    return c * c * cxx - 2 * c * s * cxy + s * s * cyy, c * s * (cxx - cyy) + (c * c - s * s) * cxy, s * s * cxx + 2 * c * s * cxy + c * c * cyy
