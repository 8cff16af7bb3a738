"""Voxel keys, extents, cells and what is done to whole grids. Cells are centred on multiples of the cell size; cy grows downwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import gauss, se2
from cellweave.schemas import MIN_POINTS_GAUSSIAN

STATS = ("n", "mx", "my", "cxx", "cxy", "cyy", "czz", "occ", "has_gaussian")


def cell_key(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor((x + size / 2) / size).cast("long"), F.floor((size / 2 - y) / size).cast("long")


def cell_centre(cx: Column, cy: Column, size: float) -> tuple[Column, Column]:
    return cx * size, -cy * size


def keyed(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    cx, cy = cell_key(F.col(x), F.col(y), size)
    return points.withColumns({"cx": cx, "cy": cy})


def without_nan(points: DataFrame) -> DataFrame:
    return points.filter(~(F.isnan("x") | F.isnan("y") | F.isnan("z")))


def large_scans(points: DataFrame, least: int = 400, scan: str = "scan_id") -> DataFrame:
    """The points of scans that have enough of them."""
    enough = points.groupBy(scan).count().filter(F.col("count") >= least).select(scan)
    return points.join(enough, scan, "left_semi")


def bounds(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """minx, maxx, miny, maxy by keys; the origin always lies within."""
    zero = F.lit(0.0)
    return points.groupBy(*keys).agg(
        F.least(zero, F.min(x)).alias("minx"), F.greatest(zero, F.max(x)).alias("maxx"), F.least(zero, F.min(y)).alias("miny"), F.greatest(zero, F.max(y)).alias("maxy")
    )


def extents(box: DataFrame, size: float) -> DataFrame:
    """left, right, up, down: cells beyond the origin's on each side that cover the box."""
    side = lambda reach: F.greatest(F.lit(0), F.ceil((reach - size / 2) / size)).cast("long")
    return box.withColumns({"left": side(-F.col("minx")), "right": side(F.col("maxx")), "up": side(F.col("maxy")), "down": side(-F.col("miny"))})


def enlarged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extents that hold both; they never shrink."""
    sides = ("left", "right", "up", "down")
    return old.select(*keys, *sides).unionByName(new.select(*keys, *sides)).groupBy(*keys).agg(*[F.max(s).alias(s) for s in sides])


def inside(cx: Column, cy: Column) -> Column:
    """Within the extents in columns left, right, up and down."""
    return cx.between(-F.col("left"), F.col("right")) & cy.between(-F.col("up"), F.col("down"))


def cells(points: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """The cells of each grid, from sums that combine before the shuffle."""
    rows = keyed(points, size).groupBy(*keys, "cx", "cy")
    rows = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), *[F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy")]
    )
    cov = gauss.seeded_covariance(F.col("n"), F.col("sxx"), F.col("sxy"), F.col("syy"), F.col("mx"), F.col("my"))
    named = dict(zip(("cxx", "cxy", "cyy", "czz"), cov))
    rows = rows.withColumns(named | {"occ": gauss.point_occ(F.col("n")), "has_gaussian": F.col("n") >= MIN_POINTS_GAUSSIAN})
    return rows.select(*keys, "cx", "cy", *STATS)


def floored(rows: DataFrame) -> DataFrame:
    """Adds the inverse covariance and raises small eigenvalues."""
    return rows.withColumns(gauss.floored(*[F.col(c) for c in ("cxx", "cxy", "cyy", "czz")]))


def merged_pair(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of a with those of b merged in, one pair a key. A cell of b without a Gaussian, or of few points, is ignored."""
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in STATS])
    right = b.filter((F.col("n") > 2) & F.col("has_gaussian")).select(*keys, *[F.col(c).alias(f"b_{c}") for c in STATS])
    A, B = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    n1, n2 = A("n"), B("n")
    n = n1 + n2
    w1, w2 = n1 / (n2 * n), n2 / n1
    gap = {c: w2 * A(c) * n1 - B(c) * n2 for c in ("mx", "my")}
    made = {"n": n, "mx": (A("mx") * n1 + B("mx") * n2) / n, "my": (A("my") * n1 + B("my") * n2) / n}
    outer = {"cxx": gap["mx"] * gap["mx"], "cxy": gap["mx"] * gap["my"], "cyy": gap["my"] * gap["my"], "czz": F.lit(0.0)}
    made |= {c: (A(c) * (n1 - 1) + B(c) * (n2 - 1) + w1 * outer[c]) / (n - 1) for c in outer}
    made |= {"occ": gauss.clamp_occ(A("occ") + n2 * gauss.LOG_LIKE_OCCUPANCY)}
    made |= {"has_gaussian": made["occ"] >= 0}
    rows = left.join(right, list(keys), "full")
    both = A("has_gaussian") & B("has_gaussian")
    return rows.select(*keys, *[F.when(both, made[c]).when(B("has_gaussian"), B(c)).otherwise(A(c)).alias(c) for c in STATS])


def merged_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All Gaussian cells of a key merged at once, by the sums form of the pairwise rule."""
    rows = rows.filter(F.col("has_gaussian") & (F.col("n") > 2))
    n, mx, my = F.col("n"), F.col("mx"), F.col("my")
    raw = {"cxx": mx * mx, "cxy": mx * my, "cyy": my * my, "czz": F.lit(0.0)}
    sums = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(n * mx).alias("sx"), F.sum(n * my).alias("sy"), *[F.sum((n - 1) * F.col(c) + n * raw[c]).alias(c) for c in raw], F.sum("occ").alias("occ"))
    mean = {"mx": F.col("sx") / n, "my": F.col("sy") / n}
    of = {"cxx": mean["mx"] * mean["mx"], "cxy": mean["mx"] * mean["my"], "cyy": mean["my"] * mean["my"], "czz": F.lit(0.0)}
    cov = {c: (F.col(c) - n * of[c]) / (n - 1) for c in of}
    return sums.select(*keys, "n", *[v.alias(k) for k, v in (mean | cov).items()], gauss.clamp_occ(F.col("occ")).alias("occ"), F.lit(True).alias("has_gaussian"))


def coarser(rows: DataFrame, keys: Sequence[str], size: float, mode: str = "overwrite") -> DataFrame:
    """Gaussian cells in a grid of larger cells: the last one in row-major order, or all merged."""
    cx, cy = cell_key(F.col("mx"), F.col("my"), size)
    rows = rows.filter("has_gaussian").withColumns({"fx": F.col("cx"), "fy": F.col("cy"), "cx": cx, "cy": cy})
    if mode == "merge":
        return merged_sums(rows, [*keys, "cx", "cy"])
    last = rows.groupBy(*keys, "cx", "cy").agg(F.max_by(F.struct(*STATS), F.struct("fy", "fx")).alias("s"))
    return last.select(*keys, "cx", "cy", "s.*")


def transformed(rows: DataFrame, t: se2.Pose, size: float, keys: Sequence[str] = ()) -> DataFrame:
    """Gaussian cells rotated about the origin, put in new cells and merged there. The shift belongs to the grid's origin."""
    mx, my = se2.apply((F.lit(0.0), F.lit(0.0), t[2]), F.col("mx"), F.col("my"))
    cov = gauss.rotated(t[2], F.col("cxx"), F.col("cxy"), F.col("cyy"))
    rows = floored(rows.filter("has_gaussian").withColumns({"mx": mx, "my": my, "cxx": cov[0], "cxy": cov[1], "cyy": cov[2]}))
    return merged_sums(keyed(rows, size, "mx", "my"), [*keys, "cx", "cy"])


def moved(rows: DataFrame, dx: float, dy: float, size: float) -> tuple[DataFrame, float, float]:
    """The grid moved by whole cells towards zero: cells that leave the extents go. Also the residual shift."""
    steps = [int(d / size) for d in (dx, dy)]
    out = rows.withColumns({"cx": F.col("cx") - steps[0], "cy": F.col("cy") + steps[1]})
    out = out.withColumns({"mx": F.col("mx") - steps[0] * size, "my": F.col("my") - steps[1] * size}).filter(inside(F.col("cx"), F.col("cy")))
    return out, dx - steps[0] * size, dy - steps[1] * size


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of several grids' cells, for each key the one that was added last."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("s")).select(*keys, "s.*")


def radius(size: float) -> Column:
    """A grid's radius from its extents."""
    return (F.col("left") + F.col("right") + 1) * size + (F.col("up") + F.col("down") + 1) * size / 4


def centroid(size: float) -> tuple[Column, Column]:
    return (F.col("right") - F.col("left")) * size, (F.col("up") - F.col("down")) * size


def cloud_size(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """centroid_x, centroid_y and radius of clouds: the larger of the two ranks that leave a third of |x| and |y| out."""
    rank = lambda c: F.get(F.sort_array(F.collect_list(F.abs(F.col(c)))), (F.floor(F.count(F.lit(1)) / 3) * 2).cast("int"))
    return points.groupBy(*keys).agg(F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"), F.greatest(rank("x"), rank("y")).alias("radius"))


def without_cells(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(gone.select(*keys, "cx", "cy"), [*keys, "cx", "cy"], "left_anti")
