"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Defined results: a null text has size 0; a null source is a source of its own, last in order. A source without words has
target 0. Every word of a source is taken floor(target / source size) times; what the target still lacks comes from one
more pass over the source's documents in seeded order, and the document at its end gives its leading words only. Rows
that are equal in id and size are interchangeable in that order, each a row of its own. Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import lean, stored, table

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
BUCKETS = 4096  # by three hex digits of the seeded order


def _sizes(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.array([len(x.split()) if x else 0 for x in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sizes], names=["doc_id", "source", "size"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("binary"))
    return rows.mapInArrow(lean(count), "doc_id long, source string, size long")


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight: the weights repeat over the sources in code-point order, null last."""
    spark = sizes.sparkSession
    ordered = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    rows = ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], weights[x[1] % n]))
    return spark.createDataFrame(rows, "source string, source_size long, weight long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds target: level * weight, at most max_epochs times the source's size, the excess shared by weight again.

    Each round is one aggregate over the sources; the level only rises, so the set of full sources only grows.
    """
    full = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, seen = 0.0, -1
    while True:
        is_full = full < F.lit(level) * F.col("weight")
        row = sources.agg(
            F.count(F.when(is_full, 1)).alias("n"),
            F.sum(F.when(is_full, full)).alias("used"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("open"),
        ).first()
        if row.n == seen or not row.open:
            break
        seen, level = row.n, (total - (row.used or 0)) / row.open
    return sources.withColumn("target", F.when(is_full, full.cast("double")).otherwise(F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats (whole times), partial (further words), taken for each row.

    No source is ordered in one task: sums over seeded buckets find the bucket in which the last pass ends, and only that
    bucket's documents are ordered.
    """
    sizes = stored(_sizes(docs))
    sources = stored(water_fill(stored(weighted_sources(sizes, weights)), max_epochs))
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("repeats", repeats).withColumn(
        "goal", F.floor(F.col("target") - F.col("repeats") * F.col("source_size") + 0.5).cast("long")
    )
    turn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = sizes.withColumn("turn", turn).withColumn("bucket", F.substring("turn", 1, 3))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    buckets = buckets.withColumn("below", F.coalesce(F.sum("held").over(before), F.lit(0)))
    b, p = buckets.alias("b"), plan.alias("p")
    held = b.join(p, F.col("b.source").eqNullSafe(F.col("p.source"))).select(
        F.col("b.source").alias("_source"), F.col("b.bucket").alias("_bucket"), "below", "held", "source_size", "target", "repeats", "goal"
    )
    whole = rows.join(held, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    whole = whole.drop("_source", "_bucket")
    ends = (F.col("below") < F.col("goal")) & (F.col("below") + F.col("held") > F.col("goal"))
    even = whole.filter(~ends).withColumn("partial", F.when(F.col("below") < F.col("goal"), F.col("size")).otherwise(F.lit(0).cast("long")))
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    last = whole.filter(ends).withColumn("_room", F.col("goal") - so_far)
    last = last.withColumn("partial", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_room")))).drop("_room")
    out = even.unionByName(last)
    taken = (F.col("repeats") * F.col("size") + F.col("partial")).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", "partial", taken)


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with docs' columns: each document as often as it is taken, always whole.

    Where a source's last pass ends within a document, that document is taken if half of its words or more are. Documents
    without words come as often as their source is passed through whole. Documents are matched to their share by id and
    source; rows equal in both share alike.
    """
    shares = mix(docs).groupBy("doc_id", "source").agg(*[F.max(c).alias(c) for c in ("repeats", "partial", "size")])
    times = F.col("repeats") + ((F.col("size") > 0) & (2 * F.col("partial") >= F.col("size"))).cast("long")
    shares = shares.select(F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), times.cast("int").alias("_times")).filter("_times > 0")
    own = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & F.col("source").cast("string").eqNullSafe(F.col("_source"))
    rows = docs.join(shares, own).withColumn("_times", F.explode(F.array_repeat("_times", F.col("_times"))))
    return rows.select(*docs.columns)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op5_source_mix": op5_source_mix}
ORACLE = {
    "op5_source_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER ()::BIGINT AS t, sum(weight) OVER ()::BIGINT AS tw,
             coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS used, coalesce(sum(weight) OVER o, 0)::BIGINT AS gone
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by((t - used)::DOUBLE / (tw - gone)::DOUBLE, gone) AS level FROM o
      WHERE 3 * source_size >= (t - used)::DOUBLE / (tw - gone)::DOUBLE * weight),
g AS (SELECT source, source_size, CASE WHEN 3 * source_size < level * weight THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM g),
c AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.repeats, floor(r.target - r.repeats * r.source_size + 0.5)::BIGINT AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS so_far
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (repeats * size + greatest(0, least(size, goal - so_far)))::BIGINT AS taken FROM c"""
}
