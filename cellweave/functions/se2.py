"""Planar pose algebra as Column expressions. A pose or transform is a triple of Columns (x, y, theta)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pose = tuple[Column, Column, Column]


def normalize_angle(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def apply(t: Pose, x: Column, y: Column) -> tuple[Column, Column]:
    """A point moved by a transform: rotated, then shifted."""
    c, s = F.cos(t[2]), F.sin(t[2])
    return c * x - s * y + t[0], s * x + c * y + t[1]


def compose(a: Pose, b: Pose) -> Pose:
    """The transform b first, then a."""
    x, y = apply(a, b[0], b[1])
    return x, y, normalize_angle(a[2] + b[2])


def inverse(t: Pose) -> Pose:
    c, s = F.cos(t[2]), F.sin(t[2])
    return -(c * t[0] + s * t[1]), s * t[0] - c * t[1], normalize_angle(-t[2])


def relative(a: Pose, b: Pose) -> Pose:
    """b seen from a."""
    dx, dy, c, s = b[0] - a[0], b[1] - a[1], F.cos(a[2]), F.sin(a[2])
    return c * dx + s * dy, c * dy - s * dx, normalize_angle(b[2] - a[2])


def component_difference(a: Pose, b: Pose) -> Pose:
    """Difference by component, which is not the relative pose."""
    return b[0] - a[0], b[1] - a[1], normalize_angle(b[2] - a[2])


def component_sum(pose: Pose, step: Pose) -> Pose:
    return pose[0] + step[0], pose[1] + step[1], normalize_angle(pose[2] + step[2])


def between_frames(a: Pose, b: Pose) -> Pose:
    """The transform that takes coordinates of frame a to frame b."""
    dx, dy, c, s = a[0] - b[0], a[1] - b[1], F.cos(b[2]), F.sin(b[2])
    return c * dx + s * dy, c * dy - s * dx, normalize_angle(a[2] - b[2])


def displacement(t: Pose) -> Column:
    return F.sqrt(t[0] * t[0] + t[1] * t[1])


def angle_difference(a: Pose, b: Pose) -> Column:
    return normalize_angle(b[2] - a[2])


def edge_error(xi: Pose, xj: Pose, z: Pose) -> Pose:
    """What a measured transform z leaves of the relative pose of two nodes."""
    return relative(z, relative(xi, xj))


def edge_jacobians(xi: Pose, xj: Pose, z: Pose) -> tuple[list[Column], list[Column]]:
    """Row-major 3 x 3 blocks of the error by the two poses."""
    a, dx, dy = z[2] + xi[2], xj[0] - xi[0], xj[1] - xi[1]
    c, s, zero, one = F.cos(a), F.sin(a), F.lit(0.0), F.lit(1.0)
    left = [-c, -s, c * dy - s * dx, s, -c, -(c * dx + s * dy), zero, zero, -one]
    return left, [c, s, zero, -s, c, zero, zero, zero, one]


def to_quaternion(theta: Column) -> tuple[Column, Column, Column, Column]:
    return F.lit(0.0), F.lit(0.0), F.sin(theta / 2), F.cos(theta / 2)


def planar_covariance(c: Column) -> Column:
    """The x, y, yaw block of a row-major 6 x 6 covariance."""
    return F.array(*[F.get(c, i) for i in (0, 1, 5, 6, 7, 11, 30, 31, 35)])


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def segments_meet(p: tuple[Column, Column], p2: tuple[Column, Column], q: tuple[Column, Column], q2: tuple[Column, Column], collinear: bool = False) -> Column:
    """Whether two segments have a point in common; overlapping collinear ones only if asked for."""
    rx, ry, sx, sy = p2[0] - p[0], p2[1] - p[1], q2[0] - q[0], q2[1] - q[1]
    wx, wy = q[0] - p[0], q[1] - p[1]
    d, across = cross(rx, ry, sx, sy), cross(wx, wy, rx, ry)
    t, u = cross(wx, wy, sx, sy) / d, across / d
    proper = (d != 0) & t.between(0, 1) & u.between(0, 1)
    if not collinear:
        return F.coalesce(proper, F.lit(False))
    from_p, from_q = wx * rx + wy * ry, -(wx * sx + wy * sy)
    on_line = (d == 0) & (across == 0)
    overlap = from_p.between(0, rx * rx + ry * ry) | from_q.between(0, sx * sx + sy * sy)
    return F.coalesce(proper, F.lit(False)) | (on_line & overlap)
