"""Sinks: occupancy, cells and means as tables or messages, graphs and grids as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import se2
from cellweave.operators import graph


def cell_messages(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells in wire form: mean, row-major covariance, occupancy and number of points."""
    zero = F.lit(0.0)
    cov = F.array("cxx", "cxy", zero, "cxy", "cyy", zero, zero, zero, "czz")
    return cells.select(*keys, "cx", "cy", F.col("mx").alias("mean_x"), F.col("my").alias("mean_y"), zero.alias("mean_z"), cov.alias("cov_matrix"), F.col("occ").cast("double").alias("occupancy"), F.col("n").alias("N"))


def map_messages(cells: DataFrame, extents: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """One message for each grid with its Gaussian cells; a grid is bounded by its window."""
    rows = cell_messages(cells.filter("has_gaussian"), keys)
    fields = ("mean_x", "mean_y", "mean_z", "cov_matrix", "occupancy", "N")
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cy", "cx", F.struct(*fields).alias("cell")))).alias("s"))
    packed = packed.withColumn("cells", F.transform("s", lambda x: x.cell)).drop("s")
    span = lambda a, b: ((F.col(a) + F.col(b) + 1) * size)
    frame = extents.select(*keys, span("left", "right").alias("x_size"), span("up", "down").alias("y_size"), ((F.col("right") - F.col("left")) * size / 2).alias("x_cen"), ((F.col("up") - F.col("down")) * size / 2).alias("y_cen"))
    return frame.join(packed, list(keys)).withColumns({"z_size": F.lit(0.0), "z_cen": F.lit(0.0), "x_cell_size": F.lit(size), "y_cell_size": F.lit(size), "z_cell_size": F.lit(0.0)})


def means(cells: DataFrame, origin: se2.Pose | None = None) -> DataFrame:
    """Gaussian means, moved by the frame's origin where one is given."""
    rows = cells.filter("has_gaussian")
    if origin is None:
        return rows.withColumns({"x": F.col("mx"), "y": F.col("my")})
    x, y = se2.apply(origin, F.col("mx"), F.col("my"))
    return rows.withColumns({"x": x, "y": y})


def ascii_rows(cells: DataFrame, extents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A text line for each row of a grid: W Gaussian, . other, blank unseen."""
    dense = extents.select(*keys, "up", "down", F.explode(F.sequence(-F.col("left"), F.col("right"))).alias("cx"))
    dense = dense.select(*keys, "cx", F.explode(F.sequence(-F.col("up"), F.col("down"))).alias("cy"))
    mark = F.when(F.col("has_gaussian"), "W").when(F.col("has_gaussian").isNotNull(), ".").otherwise(" ")
    rows = dense.join(cells.select(*keys, "cx", "cy", "has_gaussian"), [*keys, "cx", "cy"], "left").withColumn("m", mark)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "m"))), lambda x: x.m), "")
    return rows.groupBy(*keys, "cy").agg(line.alias("line"))


def write_dot(edges: DataFrame, nodes: DataFrame, path: str) -> None:
    graph.dot_lines(edges, nodes).coalesce(1).write.mode("overwrite").text(path)


def graph_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices and edges as lines of a graph file."""
    text = lambda *cs: F.concat_ws(" ", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cs])
    upper = [F.get("info", i).cast("string") for i in (0, 1, 2, 4, 5, 8)]
    n = nodes.select(text(F.lit("VERTEX_SE2"), "id", "x", "y", "theta").alias("value"))
    return n.unionByName(edges.select(text(F.lit("EDGE_SE2"), "src", "dst", "dx", "dy", "dtheta", *upper).alias("value")))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graph_lines(nodes, edges).coalesce(1).write.mode("overwrite").text(path)


def pose_messages(poses: DataFrame) -> DataFrame:
    """Poses with their rotation as a quaternion."""
    return poses.withColumns(dict(zip(("qx", "qy", "qz", "qw"), se2.to_quaternion(F.col("theta")))))


def map_to_odom(rows: DataFrame) -> DataFrame:
    """The map-to-odometry transform from map poses (x, y, theta) and odometry poses (ox, oy, otheta)."""
    t = se2.compose(tuple(F.col(c) for c in ("x", "y", "theta")), se2.inverse(tuple(F.col(c) for c in ("ox", "oy", "otheta"))))
    return rows.withColumns(dict(zip(("tx", "ty", "ttheta"), t)))
