"""Registration of scan pairs: point-to-cell, cell-to-cell and the robust combination, solved in numpy, one pair a task.

A pair holds two scans, which are bounded; pairs are spread over the cluster. The score terms are also there as Columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import gauss
from cellweave.operators import lookup
from cellweave.schemas import MIN_POINTS_GAUSSIAN

RESULT = "pair_id bigint, dx double, dy double, dtheta double, score double, converged boolean, iterations int"


@dataclass
class Grid:
    mean: np.ndarray  # (n, 2)
    cov: np.ndarray  # (n, 2, 2), eigenvalues floored
    icov: np.ndarray


def grid(points: np.ndarray, size: float) -> Grid:
    """Gaussian cells of a scan, as the voxel operators make them, in row-major order."""
    col, row = np.floor((points[:, 0] + size / 2) / size), np.floor((size / 2 - points[:, 1]) / size)
    _, where, n = np.unique(np.stack([row, col], 1), axis=0, return_inverse=True, return_counts=True)
    where = where.ravel()
    mean = np.stack([np.bincount(where, points[:, i]) / n for i in (0, 1)], 1)
    second = np.stack([np.bincount(where, points[:, i] * points[:, j]) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1))], 1).reshape(-1, 2, 2)
    keep = n >= MIN_POINTS_GAUSSIAN
    n, mean, second = n[keep].astype(float), mean[keep], second[keep]
    scale = (n - 1) / n
    cov = ((second + np.eye(2)) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]) * scale[:, None, None]
    values, vectors = np.linalg.eigh(cov) if len(cov) else (np.zeros((0, 2)), np.zeros((0, 2, 2)))
    floor = gauss.FLOOR * np.maximum(values.max(axis=1, initial=-np.inf), scale / n)
    values = np.maximum(values, floor[:, None])
    cov = np.einsum("nij,nj,nkj->nik", vectors, values, vectors)
    return Grid(mean, cov, np.linalg.inv(cov) if len(cov) else cov)


def coarsened(g: Grid, size: float) -> Grid:
    """The last fine cell in row-major order of each coarse cell."""
    if not len(g.mean):
        return g
    key = np.stack([np.floor((size / 2 - g.mean[:, 1]) / size), np.floor((g.mean[:, 0] + size / 2) / size)], 1)
    _, first = np.unique(key[::-1], axis=0, return_index=True)
    pick = np.sort(len(key) - 1 - first)
    return Grid(g.mean[pick], g.cov[pick], g.icov[pick])


def _nearest(g: Grid, at: np.ndarray, k: int) -> np.ndarray:
    """The k nearest cells of each place; of equal distances the first cell. k passes, since k is small and cells are many."""
    k = min(k, len(g.mean))
    out = np.empty((len(at), k), np.int64)
    for lo in range(0, len(at), 1024):
        d2 = (at[lo : lo + 1024, 0, None] - g.mean[None, :, 0]) ** 2 + (at[lo : lo + 1024, 1, None] - g.mean[None, :, 1]) ** 2
        rows = np.arange(len(d2))
        for i in range(k):
            out[lo : lo + 1024, i] = near = d2.argmin(axis=1)
            d2[rows, near] = np.inf
    return out


def _rotation(theta: float) -> tuple[float, float]:
    return (1.0, 0.0) if abs(theta) < 1e-4 else (math.cos(theta), math.sin(theta))


def p2d_terms(g: Grid, points: np.ndarray, pose: np.ndarray, d1: float, d2: float, k: int = 4, hessian: str = "reference") -> tuple[float, np.ndarray, np.ndarray]:
    """Score, gradient and Hessian of points in a grid. The reference form puts the second derivative in all places but the last."""
    if not len(g.mean):
        return 0.0, np.zeros(3), np.zeros((3, 3))
    c, s = math.cos(pose[2]), math.sin(pose[2])
    moved = points @ np.array([[c, s], [-s, c]]) + pose[:2]
    near = _nearest(g, moved, k)
    c, s = _rotation(pose[2])
    x, y = (np.repeat(points[:, i], near.shape[1]) for i in (0, 1))
    cells = near.ravel()
    dx, dy = (np.repeat(moved[:, i], near.shape[1]) - g.mean[cells, i] for i in (0, 1))
    ixx, ixy, iyx, iyy = g.icov.reshape(-1, 4)[cells].T
    q0, q1 = dx * ixx + dy * iyx, dx * ixy + dy * iyy
    e = np.exp(-d2 / 2 * (q0 * dx + q1 * dy))
    e = np.where((d2 * e <= 1) & (d2 * e >= 0), e, 0.0)
    j0, j1 = -x * s - y * c, x * c - y * s
    qj = q0, q1, q0 * j0 + q1 * j1
    w = d1 * d2 * e
    along = q0 * (-x * c + y * s) + q1 * (-x * s - y * c)
    last = j0 * ixx * j0 + j0 * ixy * j1 + j1 * iyx * j0 + j1 * iyy * j1
    jij = ixx, ixy, ixx * j0 + ixy * j1, iyx, iyy, iyx * j0 + iyy * j1, j0 * ixx + j1 * iyx, j0 * ixy + j1 * iyy, last
    h = np.empty((len(x), 9))  # summed row by row, as rounding decides close calls
    for i, v in enumerate(jij):
        bent = along if (i == 8) != (hessian == "reference") else 0.0
        h[:, i] = w * (-d2 * qj[i // 3] * qj[i % 3] + bent + v)
    return float((-d1 * e).sum()), (w[:, None] * np.stack(qj, 1)).sum(axis=0), h.sum(axis=0).reshape(3, 3)


def d2d_terms(target: Grid, source: Grid, pose: np.ndarray, d1: float, d2: float, k: int = 2) -> tuple[float, np.ndarray, np.ndarray]:
    """Score, gradient and Hessian of the Gaussians of one grid in another, by the L2 distance of Gaussians."""
    if not len(target.mean) or not len(source.mean):
        return 0.0, np.zeros(3), np.zeros((3, 3))
    c, s = math.cos(pose[2]), math.sin(pose[2])
    r = np.array([[c, -s], [s, c]])
    mean, cov = source.mean @ r.T + pose[:2], r @ source.cov @ r.T
    near = _nearest(target, mean, k)
    m, cv, cells = np.repeat(mean, near.shape[1], axis=0), np.repeat(cov, near.shape[1], axis=0), near.ravel()
    diff, b = m - target.mean[cells], np.linalg.inv(target.cov[cells] + cv)
    q = np.einsum("ni,nij->nj", diff, b)
    value = -d1 * np.exp(-d2 / 2 * (q * diff).sum(axis=1))
    jac = np.zeros((len(m), 2, 3))
    jac[:, 0, 0] = jac[:, 1, 1] = 1
    jac[:, 0, 2], jac[:, 1, 2] = -m[:, 1], m[:, 0]
    z = np.empty((len(m), 2, 2))
    z[:, 0, 0], z[:, 1, 1] = -2 * cv[:, 0, 1], 2 * cv[:, 0, 1]
    z[:, 0, 1] = z[:, 1, 0] = cv[:, 0, 0] - cv[:, 1, 1]
    zz = np.empty_like(z)
    zz[:, 0, 0], zz[:, 1, 1] = 2 * (cv[:, 1, 1] - cv[:, 0, 0]), 2 * (cv[:, 0, 0] - cv[:, 1, 1])
    zz[:, 0, 1] = zz[:, 1, 0] = -4 * cv[:, 0, 1]
    qzb = np.einsum("ni,nij,njk->nk", q, z, b)
    bend = np.zeros((len(m), 3))
    bend[:, 2] = (qzb * diff).sum(axis=1)
    grad = 2 * np.einsum("ni,nij->nj", q, jac) - bend
    factor = -d2 / 2 * value
    twist = np.zeros((len(m), 3, 3))
    twist[:, :, 2] = np.einsum("ni,nij->nj", qzb, jac)
    last = np.zeros((len(m), 3, 3))
    last[:, 2, 2] = -2 * (q * m).sum(axis=1) - np.einsum("ni,nij,nj->n", q, zz, q) + 2 * np.einsum("ni,nij,njk,nkl,nl->n", q, z, b, z, q)
    h = 2 * np.einsum("nai,nab,nbj->nij", jac, b, jac) + last - 2 * twist - 2 * twist.transpose(0, 2, 1) - d2 / 2 * grad[:, :, None] * grad[:, None, :]
    return float(value.sum()), (factor[:, None] * grad).sum(axis=0), (factor[:, None, None] * h).sum(axis=0)


def _newton(terms, pose: np.ndarray, least: float, most: float, epsilon: float, max_iterations: int, count_first: bool) -> tuple[np.ndarray, float, bool, int]:
    """Newton directions with clamped steps. The step search proper never runs while its interval is open, so a clamp is all."""
    done, value = 0, 0.0
    while True:
        value, gradient, hessian = terms(pose)
        step = -np.linalg.pinv(hessian) @ gradient
        size = float(np.linalg.norm(step))
        if not size > 0:
            return pose, value, size == 0, done
        step /= size
        if step @ gradient < 0:  # the score is to grow: turn round
            step = -step
        size = max(min(size, most), least)
        pose = pose + step * size
        done += count_first
        if done > max_iterations or (done and size < epsilon):
            return pose, value, True, done
        done += not count_first


def p2d(target: np.ndarray, source: np.ndarray, guess=(0.0, 0.0, 0.0), size: float = 0.25, layers: int = 4, step: float = 0.05, outlier: float = 0.3, epsilon: float = 0.1, max_iterations: int = 35):
    """Source points to target cells, coarse to fine."""
    pose, fine = np.array(guess, float), grid(target, size)
    value, ok, total = 0.0, False, 0
    for layer in range(layers - 1, -1, -1):
        cells = size * 2**layer
        g, (d1, d2) = (coarsened(fine, cells) if layer else fine), gauss.fitting(outlier, cells)
        pose, value, ok, n = _newton(lambda p: p2d_terms(g, source, p, d1, d2), pose, epsilon / 2, step, epsilon, max_iterations, False)
        total += n
        if not ok:
            break
    return pose, value / max(1, len(source)), ok, total


def d2d(target: np.ndarray, source: np.ndarray, guess=(0.0, 0.0, 0.0), size: float = 0.25, layers: int = 4, step: float = 0.22, outlier: float = 0.55, epsilon: float = 0.1, max_iterations: int = 35):
    """Source cells to target cells, coarse to fine."""
    pose, a, b = np.array(guess, float), grid(target, size), grid(source, size)
    value, ok, total = 0.0, False, 0
    for layer in range(layers - 1, -1, -1):
        cells = size * 2**layer
        t, s = (coarsened(a, cells), coarsened(b, cells)) if layer else (a, b)
        d1, d2 = gauss.fitting(outlier, cells)
        pose, value, ok, n = _newton(lambda p: d2d_terms(t, s, p, d1, d2), pose, epsilon / 2, step, epsilon, max_iterations, True)
        total += n
        if not ok:
            break
    return pose, value / max(1, len(source)), ok, total


class _Table:
    def __init__(self, target: np.ndarray, step: float) -> None:
        k = lookup.kernel(step, 0.5)
        self.step, self.border, self.n = step, max(r for r, _, _ in k), len(target)
        self.lo, self.hi = np.minimum(target.min(axis=0), 0), np.maximum(target.max(axis=0), 0)
        self.size = (np.ceil((self.hi - self.lo) / step) + 1 + 2 * self.border).astype(int)
        self.score = np.zeros((self.size[1], self.size[0]))
        held = target[((target > self.lo) & (target < self.hi)).all(axis=1)]
        ix, iy = self.index(held, self.border)
        self.score[iy, ix] = lookup.OCCUPIED
        inner = (ix >= 1) & (ix <= self.size[0] - 2) & (iy >= 1) & (iy <= self.size[1] - 2)
        for r, c, v in k:
            np.maximum.at(self.score, (iy[inner] + r, ix[inner] + c), v)

    def index(self, p: np.ndarray, border: int) -> tuple[np.ndarray, np.ndarray]:
        half = self.step / 2
        return np.floor((p[:, 0] - self.lo[0] + half) / self.step).astype(int) + border, np.floor((self.hi[1] - p[:, 1] + half) / self.step).astype(int) + border

    def at(self, ix: np.ndarray, iy: np.ndarray) -> float:
        ok = (ix >= 0) & (iy >= 0) & (ix < self.size[0]) & (iy < self.size[1])
        return float(self.score[iy[ok], ix[ok]].sum()) / (lookup.OCCUPIED * self.n)

    def proof(self, p: np.ndarray) -> float:
        return self.at(*self.index(p[((p > self.lo) & (p < self.hi)).all(axis=1)], self.border))


def moved(points: np.ndarray, pose) -> np.ndarray:
    c, s = math.cos(pose[2]), math.sin(pose[2])
    return points @ np.array([[c, s], [-s, c]]) + np.asarray(pose[:2])


def correlative(target: np.ndarray, source: np.ndarray, guess=(0.0, 0.0, 0.0), step: float = 0.5, shift: float = 4.0, rotation: float = 1.6, rotation_step: float = 0.2, compose_guess: bool = False) -> np.ndarray:
    """The best candidate over all rotations and shifts; without compose_guess the guess is not put back in front of it."""
    table, start, best = _Table(target, step), moved(source, guess), (-1.0, (0.0, 0.0, 0.0))
    n_rot, n_shift = math.ceil(2 * rotation / rotation_step - 1e-9), math.ceil(2 * shift / step - 1e-9)
    for i in range(n_rot):
        theta = -rotation + i * rotation_step
        ix, iy = table.index(moved(start, (0, 0, theta)), 0)
        for j in range(n_shift):
            for k in range(n_shift):
                dx, dy = -shift + j * step, -shift + k * step
                score = table.at(ix + math.floor(dx / step), iy - math.floor(dy / step))
                if score > best[0]:
                    best = score, (dx, dy, theta)
    found = np.array(best[1])
    if compose_guess:
        x, y = moved(np.array([guess[:2]], float), found)[0]
        found = np.array([x, y, found[2] + guess[2]])
    return found


def robust(target: np.ndarray, source: np.ndarray, guess=(0.0, 0.0, 0.0), size: float = 0.25, rejection: float = 0.4, step: float = 0.22, outlier: float = 0.55, rotation: float = 1.6):
    """Cell-to-cell matching, proved on a look-up table; if the proof fails, again from the correlative search's result."""
    if not 0 < rejection < 1:
        raise ValueError("the rejection limit must lie between 0 and 1")
    table = _Table(target, size)
    pose, _, ok, n = d2d(target, source, guess, size, step=step, outlier=outlier, max_iterations=10)
    first, score = pose, table.proof(moved(source, pose))
    if not (ok and score > 0.7):
        start = correlative(target, source, guess, rotation=rotation)
        pose, _, ok, more = d2d(target, source, start, size, step=step, outlier=outlier, max_iterations=10)
        n += more
        if not ok:
            return start, 0.0, False, n
    again = table.proof(moved(source, pose))
    if again >= rejection:
        return pose, again, True, n
    return (first, score, True, n) if score > 0.6 else (pose, score, False, n)


METHODS = {"p2d": p2d, "d2d": d2d, "robust": robust, "correlative": lambda t, s, guess=(0.0, 0.0, 0.0), **o: (correlative(t, s, guess, **o), _Table(t, 0.5).proof(moved(s, correlative(t, s, guess, **o))), True, 0)}


def register_pairs(source: DataFrame, target: DataFrame, method: str = "robust", **options) -> DataFrame:
    """One row for each pair_id of two point tables (pair_id, x, y): the pose of source in target."""
    solve = METHODS[method]

    def pair(key, src: pd.DataFrame, tgt: pd.DataFrame) -> pd.DataFrame:
        if not len(src) or not len(tgt):
            return pd.DataFrame([(key[0], 0.0, 0.0, 0.0, 0.0, False, 0)], columns=[c.split()[0] for c in RESULT.split(", ")])
        in_order = lambda f: f.sort_values(["x", "y"])[["x", "y"]].to_numpy(float)
        pose, score, ok, n = solve(in_order(tgt), in_order(src), **options)
        return pd.DataFrame([(key[0], *map(float, pose), float(score), bool(ok), int(n))], columns=[c.split()[0] for c in RESULT.split(", ")])

    a, b = source.select("pair_id", "x", "y").groupBy("pair_id"), target.select("pair_id", "x", "y").groupBy("pair_id")
    return a.cogroup(b).applyInPandas(pair, RESULT)


def p2d_columns(theta: float, d1: float, d2: float) -> dict[str, Column]:
    """value, gradient and Hessian of one point (x, y; moved to tx, ty) in one cell (mx, my, ixx, ixy, iyy), to be summed."""
    c, s = _rotation(theta)
    x, y, dx, dy = F.col("x"), F.col("y"), F.col("tx") - F.col("mx"), F.col("ty") - F.col("my")
    ixx, ixy, iyy = F.col("ixx"), F.col("ixy"), F.col("iyy")
    q0, q1 = dx * ixx + dy * ixy, dx * ixy + dy * iyy
    e = F.exp(-d2 / 2 * (q0 * dx + q1 * dy))
    ok = (d2 * e).between(0, 1)
    j0, j1 = -x * s - y * c, x * c - y * s
    qj = [q0, q1, q0 * j0 + q1 * j1]
    bend = q0 * (-x * c + y * s) + q1 * (-x * s - y * c)
    jij = {"00": ixx, "01": ixy, "11": iyy, "02": ixx * j0 + ixy * j1, "12": ixy * j0 + iyy * j1, "22": ixx * j0 * j0 + 2 * ixy * j0 * j1 + iyy * j1 * j1}
    zero = lambda v: F.when(ok, v).otherwise(0.0)
    out = {"value": zero(-d1 * e)} | {f"g{i}": zero(d1 * d2 * e * qj[i]) for i in range(3)}
    return out | {f"h{k}": zero(d1 * d2 * e * (-d2 * qj[int(k[0])] * qj[int(k[1])] + (0 if k == "22" else bend) + v)) for k, v in jij.items()}


def d2d_columns(d1: float, d2: float) -> dict[str, Column]:
    """value and gradient of one source Gaussian (sx, sy, sxx, sxy, syy; moved) in one target Gaussian (mx, my, cxx, cxy, cyy)."""
    xx, xy, yy = F.col("sxx") + F.col("cxx"), F.col("sxy") + F.col("cxy"), F.col("syy") + F.col("cyy")
    det = xx * yy - xy * xy
    dx, dy = F.col("sx") - F.col("mx"), F.col("sy") - F.col("my")
    q0, q1 = (dx * yy - dy * xy) / det, (dy * xx - dx * xy) / det
    value = -d1 * F.exp(-d2 / 2 * (q0 * dx + q1 * dy))
    turn = q0 * q0 * (-2 * F.col("sxy")) + 2 * q0 * q1 * (F.col("sxx") - F.col("syy")) + q1 * q1 * 2 * F.col("sxy")
    q = [2 * q0, 2 * q1, 2 * (q1 * F.col("sx") - q0 * F.col("sy")) - turn]
    return {"value": value} | {f"g{i}": -d2 / 2 * value * q[i] for i in range(3)}
