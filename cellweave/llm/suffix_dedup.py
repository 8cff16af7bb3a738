"""Suffix-array dedup: passages of LEAST words or more that stand in several documents.

Only suffixes at content-selected places are kept: of every WINDOW successive runs of K words, the start of the run with the
least hash. Equal passages select equal places, and the first place in a passage of LEAST words leaves at least CORE of them
to its right. So each window of LEAST words that stands in several documents holds a place with l words to its left, its
core, and the words to the right that make up LEAST. The kept suffixes are sorted by the hash of their core; those that share
one are grouped, for every l, by the words of that window, which needs no pairs. A core with more than MOST contexts is
grouped by Spark instead of in one task. Windows of neighbouring places overlap in a long passage, so their union is the
passage.

Copies of a place with the same words around it collapse before they are sorted, so a passage that stands in many documents
reaches the sort once. Words are split at white space with A-Z lower-cased and compared by hashes: 64 bits over the core, 16
for each word of the extension.

Defined results: a null text counts as empty; texts of fewer than LEAST words have no passages. A passage that only repeats
within one document is none. Rows with equal ids are documents of their own. An empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import LOWER, SPACE, UPPER, mix64, signed, stored, table, text_batches, window_hashes, word_hashes

LEAST = 50
K = 10
WINDOW = 21
CORE = LEAST - WINDOW + 1
REACH = WINDOW - 1  # words looked at on each side of the core
MOST = 1 << 16  # contexts of a core that a task groups; those of cores with more are dealt by their windows
BITS = 27  # of the table that says which cores may be shared; a fixed size, whose false hits only cost time
CHUNK = 1 << 20


def places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selected places with CORE words to their right, and the hashes of those."""
    if len(words) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = window_hashes(words, K)
    views = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
    at = np.arange(len(views)) + views.argmin(axis=1)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    at = np.unique(at[at + CORE <= len(words)])
    core = np.zeros(len(at), np.uint64)
    for i in range(0, CORE, K):
        core = mix64(core + runs[at + i])
    return at, core


def around(words: np.ndarray, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each place the words before it and after its core, nearest first, 16 bits each, then how many there are."""
    short = (words >> np.uint64(48)).astype(">u2")
    n, step = len(words), np.arange(REACH)
    sides = []
    for index, room in ((at[:, None] - 1 - step, np.minimum(at, REACH)), (at[:, None] + CORE + step, np.minimum(n - at - CORE, REACH))):
        held = np.where(step < room[:, None], short[np.clip(index, 0, n - 1)], 0).astype(">u2")
        packed = np.concatenate((held.view(np.uint8).reshape(len(at), -1), room[:, None].astype(np.uint8)), axis=1)
        sides.append([x.tobytes() for x in packed])
    return sides[0], sides[1]


def _core_counts(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            core, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(core)), pa.array(n)], names=["core", "n"])

        for _, texts in text_batches(batches):
            for text in texts:
                held.append(places(word_hashes(text))[1])
                size += len(held[-1])
            if size >= CHUNK:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return docs.select("text").mapInArrow(count, "core long, n long").groupBy("core").agg(F.sum("n").alias("n"))


def _shared_table(docs: DataFrame) -> np.ndarray:
    """A bit for each value that the first BITS bits of a shared core's hash take."""
    low = F.shiftrightunsigned("core", 64 - BITS)
    rows = _core_counts(docs).filter("n > 1").groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(core, {64 - BITS}) & 63 as int))")).alias("bits"))
    found = rows.toArrow()
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return bits


def _suffixes(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """rid, doc_id, at, core, before, after for each place whose core may be shared."""
    schema = "rid long, doc_id long, at int, core long, before binary, after binary"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, texts in text_batches(batches):
            rids, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for rid, doc_id, text in zip(rids, ids, texts):
                words = word_hashes(text)
                at, core = places(words)
                if not len(at):
                    continue
                low = core >> np.uint64(64 - BITS)
                hit = (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1
                at, core = at[hit], core[hit]
                if len(at):
                    before, after = around(words, at)
                    for held, more in zip(out, ([rid] * len(at), [doc_id] * len(at), at.tolist(), signed(core).tolist(), before, after)):
                        held.extend(more)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(emit, schema)


def _room(c: str) -> Column:
    """How many words a packed side holds."""
    return F.conv(F.hex(F.substring(c, 2 * REACH + 1, 1)), 16, 10).cast("int")


def _grouped(contexts: DataFrame) -> DataFrame:
    """core, before, after, left, right: contexts with a window of LEAST words that stands in several documents.

    A window starts l words before the core, for every l that both sides have room for. Windows of a place all hold its core,
    so their union reaches from the largest l to the least.
    """
    least, most = F.greatest(F.lit(0), REACH - _room("after")), F.least(F.lit(REACH), _room("before"))
    rows = contexts.filter(least <= most).withColumn("l", F.explode(F.sequence(least, most)))
    key = F.xxhash64(F.substring("before", F.lit(1), 2 * F.col("l")), F.substring("after", F.lit(1), 2 * (REACH - F.col("l"))))
    rows = rows.withColumn("key", key)
    window = ["core", "l", "key"]
    shared = rows.groupBy(*window).agg(F.min("least").alias("lo"), F.max("most").alias("hi")).filter("lo < hi").select(*window)
    found = rows.join(shared, window).groupBy("core", "before", "after")
    return found.agg(F.max("l").alias("left"), (REACH - F.min("l")).alias("right"))


def _prefixes(side: np.ndarray) -> np.ndarray:
    """For rows of a packed side, the hash of the first l words in column l."""
    words = side[:, :-1].copy().view(">u2").astype(np.uint64)
    out = np.zeros((len(side), REACH + 1), np.uint64)
    for l in range(REACH):
        out[:, l + 1] = mix64(out[:, l] + words[:, l] + np.uint64(1))
    return out


def _windows(contexts: DataFrame) -> DataFrame:
    """The same rows as _grouped for contexts of which no core has many.

    Each partition is read in order; only the rows of the last core are kept back.
    """
    schema = "core long, before binary, after binary, left int, right int"

    def reaches(batch: pa.RecordBatch) -> pa.RecordBatch:
        core, least, most = (batch.column(i).to_numpy() for i in (0, 3, 4))
        before, after = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(len(core), -1) for i in (1, 2))
        own, lefts, rights = mix64(core.view(np.uint64)), _prefixes(before), _prefixes(after)
        left, right = np.full(len(core), -1, np.int32), np.zeros(len(core), np.int32)
        for l in range(REACH + 1):
            rows = np.flatnonzero((before[:, -1] >= l) & (after[:, -1] >= REACH - l))
            if not len(rows):
                continue
            key = mix64(mix64(own[rows] + lefts[rows, l]) + rights[rows, REACH - l])
            order = np.argsort(key)
            key, rows = key[order], rows[order]
            start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            several = np.minimum.reduceat(least[rows], start) < np.maximum.reduceat(most[rows], start)
            rows = rows[np.repeat(several, np.diff(np.append(start, len(rows))))]
            left[rows] = l
            right[rows] = np.maximum(right[rows], REACH - l)
        at = np.flatnonzero(left >= 0)
        return pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns[:3], pa.array(left[at]), pa.array(right[at])], names=[x.split()[0] for x in schema.split(", ")])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            if not whole.num_rows:
                continue
            batch = whole if last is None else pa.Table.from_batches([last, whole]).combine_chunks().to_batches()[0]
            core = batch.column(0).to_numpy()
            at = int(np.argmax(core == core[-1]))
            if at:
                yield reaches(batch.slice(0, at))
            last = batch.slice(at)
        if last is not None:
            yield reaches(last)

    rows = contexts.repartition("core").sortWithinPartitions("core")
    return rows.select("core", "before", "after", "least", "most").mapInArrow(group, schema)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, end_word, n_words: a row for each repeated passage, as the words from start up to end."""
    shared = docs.sparkSession.sparkContext.broadcast(_shared_table(docs))  # 2^BITS bits
    suffixes = stored(_suffixes(docs, shared))
    context = ["core", "before", "after"]
    contexts = stored(suffixes.groupBy(*context).agg(F.min("rid").alias("least"), F.max("rid").alias("most")))
    crowded = stored(contexts.groupBy("core").count().filter(F.col("count") > MOST).select("core"))
    few, many = contexts.join(crowded, "core", "left_anti"), contexts.join(crowded, "core", "left_semi")
    reach = _windows(few).union(_grouped(many))  # a row for each context at most
    spans = suffixes.join(reach, context)
    spans = spans.select("rid", "doc_id", (F.col("at") - F.col("left")).alias("s"), (F.col("at") + CORE + F.col("right")).alias("e"))
    # overlapping spans of a document become one; a document has as many as it has places at most
    ordered = F.array_sort(F.collect_set(F.struct("s", "e")))

    def joined(done, x):
        last = F.get(done, F.size(done) - 1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last.s.alias("s"), F.greatest(last.e, x.e).alias("e"))))
        return F.when((F.size(done) > 0) & (x.s <= last.e), longer).otherwise(F.concat(done, F.array(F.struct(x.s.alias("s"), x.e.alias("e")))))

    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    merged = spans.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), ordered.alias("x")).select("doc_id", F.explode(F.aggregate("x", none, joined)).alias("p"))
    return merged.select("doc_id", F.col("p.s").cast("long").alias("start_word"), F.col("p.e").cast("long").alias("end_word"), (F.col("p.e") - F.col("p.s")).cast("long").alias("n_words"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLE = {
    "op9_suffix_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{SPACE}]+') AS w FROM documents),
g AS (SELECT rid, doc_id, k, array_to_string(w[k:k + {LEAST - 1}], ' ') AS x FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {LEAST - 2})) AS k FROM d)),
s AS (SELECT rid, doc_id, k FROM (SELECT *, min(rid) OVER (PARTITION BY x) AS lo, max(rid) OVER (PARTITION BY x) AS hi FROM g) WHERE lo < hi),
i AS (SELECT *, sum(CASE WHEN k > before + {LEAST} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY k) AS part FROM (SELECT *, lag(k) OVER (PARTITION BY rid ORDER BY k) AS before FROM s))
SELECT doc_id, (min(k) - 1)::BIGINT AS start_word, (max(k) + {LEAST - 1})::BIGINT AS end_word, (max(k) - min(k) + {LEAST})::BIGINT AS n_words FROM i GROUP BY rid, doc_id, part"""
}
