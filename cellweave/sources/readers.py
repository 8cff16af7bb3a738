"""Readers: scan and pose logs, graph text, raw laser messages and streams of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.schemas import LASER_SCAN

# Fixed values of the log format.
SCAN_RANGE_MIN, SCAN_RANGE_MAX = 0.0230000000447, 60.0


def split_text(text: Column, token: str) -> Column:
    """Pieces between a token taken literally; empty pieces stay."""
    return F.split(text, "\\Q" + token + "\\E", -1)


def project(scans: DataFrame) -> DataFrame:
    """Points of laser scans (angle_min, angle_increment, range_min, range_max, ranges) in the sensor's frame."""
    rows = scans.select("scan_id", "angle_min", "angle_increment", "range_min", "range_max", F.posexplode("ranges").alias("pt_idx", "r"))
    rows = rows.filter(F.col("r").between(F.col("range_min"), F.col("range_max")) & ~F.isnan("r"))
    a = F.col("angle_min") + F.col("pt_idx") * F.col("angle_increment")
    return rows.select("scan_id", "pt_idx", (F.col("r") * F.cos(a)).alias("x"), (F.col("r") * F.sin(a)).alias("y"), F.lit(0.0).alias("z"))


def indexed_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """idx, line of a text log in order; with a limit the first lines only, by index."""
    rows = spark.read.text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0]))
    lines = spark.createDataFrame(rows, "idx bigint, line string")
    return lines if limit is None else lines.filter(F.col("idx") < limit)


def scan_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Scans of a comma-separated log: fields 1 and 2 are the first angle and the increment, from 4 on the ranges."""
    f = split_text(F.col("line"), ",")
    ranges = F.transform(F.slice(f, 5, F.size(f)), lambda x: x.try_cast("double"))
    return indexed_lines(spark, path, limit).select(
        F.col("idx").alias("scan_id"),
        F.get(f, 1).cast("double").alias("angle_min"),
        F.get(f, 2).cast("double").alias("angle_increment"),
        F.lit(SCAN_RANGE_MIN).alias("range_min"),
        F.lit(SCAN_RANGE_MAX).alias("range_max"),
        F.filter(ranges, lambda r: r.isNotNull()).alias("ranges"),
    )


def pose_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="t_us bigint, x double, y double, theta double")


def graph_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of a graph file: VERTEX_SE2, EDGE_SE2 and EDGE_SE2_SWITCHABLE lines. Lines of other tags, mixtures too, are left out."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).withColumn("f", f).withColumn("tag", F.get("f", 0))
    num = lambda i: F.get("f", i).cast("double")
    nodes = lines.filter(F.col("tag") == "VERTEX_SE2").select(F.get("f", 1).cast("long").alias("id"), num(2).alias("x"), num(3).alias("y"), num(4).alias("theta"))
    edges = lines.filter(F.col("tag").isin("EDGE_SE2", "EDGE_SE2_SWITCHABLE")).withColumn("o", F.when(F.col("tag") == "EDGE_SE2_SWITCHABLE", 1).otherwise(0))
    num = lambda i: F.get("f", F.col("o") + i).cast("double")
    info = F.array(*[num(i) for i in (6, 7, 8, 7, 9, 10, 8, 10, 11)])
    switch = F.when(F.col("o") == 1, F.get("f", 3).cast("long"))
    return nodes, edges.select(F.get("f", 1).cast("long").alias("src"), F.get("f", 2).cast("long").alias("dst"), switch.alias("switch"), num(3).alias("dx"), num(4).alias("dy"), num(5).alias("dtheta"), info.alias("info"))


def laser_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Raw scans from JSON lines that keep arriving in a folder. A Kafka source parses to the same columns."""
    return spark.readStream.schema(LASER_SCAN).option("maxFilesPerTrigger", files_per_trigger).json(path)
