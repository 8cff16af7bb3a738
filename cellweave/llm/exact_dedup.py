"""Exact dedup: 128-bit content hashes, a stable keeper for each group, bytes compared inside groups.

Defined results: a null text counts as empty, and all texts of white space are equal. Rows repeated in full are rows of
their own in group_size. Of equal texts the longest original stays, then the smallest doc_id; a null doc_id comes after
all others. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import SPACE_CHARS, lean, stored, table

_DROP = SPACE_CHARS.encode()


def blake128(body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16).digest()


def _keyed(docs: DataFrame, with_body: bool, content_hash: Callable[[bytes], bytes]) -> DataFrame:
    schema = "doc_id long, chars long, h128 binary, text_sha256 string" + ", body binary" * with_body

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            bodies = [x.translate(None, _DROP) for x in raw]
            columns = [
                batch.column(0),
                batch.column(2),
                pa.array([content_hash(x) for x in bodies], pa.binary()),
                pa.array([hashlib.sha256(x).hexdigest() for x in bodies]),
            ]
            if with_body:
                columns.append(pa.array(bodies, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), chars).mapInArrow(lean(keys), schema)


def _groups(keyed: DataFrame) -> DataFrame:
    """One row for each distinct content: grouping by the hash and then the bytes themselves compares them."""
    first = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id")))
    return keyed.groupBy("h128", "body").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))


def exact_dedup(docs: DataFrame, content_hash: Callable[[bytes], bytes] = blake128) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, chars for every row of docs.

    The bytes of all copies meet map-side first, so a group of any size reaches the shuffle as one row from each task.
    Only one small row for each group is joined back; that join's hot keys are dealt anew at run time.
    """
    exact = _groups(_keyed(docs, True, content_hash))
    found = stored(exact.select("h128", "group_size", F.col("first.id").alias("keep_id"), F.sha2("body", 256).alias("sha")))
    collided = found.groupBy("h128").count().filter("count > 1").select("h128")
    rows = _keyed(docs, False, content_hash)
    key = [rows.h128.eqNullSafe(found.h128)]
    if not collided.isEmpty():
        # Different bytes under one hash: the second digest tells them apart, and the bytes tell whether it does.
        if found.groupBy("h128", "sha").count().filter("count > 1").isEmpty():
            key.append(rows.text_sha256 == found.sha)
        else:
            raise ValueError("two contents share a 128-bit hash and a SHA-256")
    joined = rows.join(found, key)
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "chars",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with docs' columns; of rows repeated under one id, one."""
    kept = exact_dedup(docs).filter("kept").groupBy(F.col("doc_id").alias("_kept_id")).agg(F.max("chars").alias("_kept_chars"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id"))
    rows = docs.join(kept, same & (F.coalesce(F.length("text"), F.lit(0)) == F.col("_kept_chars")), "left_semi")
    return rows.dropDuplicates(["doc_id", "text"])


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("chars")


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE = {
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS b FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY b) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(b) AS text_sha256
FROM d WINDOW w AS (PARTITION BY b ORDER BY length(t) DESC, doc_id)"""
}
