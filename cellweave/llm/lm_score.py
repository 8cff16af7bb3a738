"""LM scoring: unigram counts of the whole training part, and a causal self-attention model over subword ids.

Counts of words and of subword ids come from every training document (those not held out). So do the attention weights:
documents are dealt into shards of about SHARD ids by hash, every window of every shard trains, and the weights of a round's
shards, all trained from the mean of the round before, are averaged (an id's own by how often a shard saw it). The first
round is one shard; GROWTH tells how fast rounds grow. Tables of less than STEPS batches pass more than once. Scores don't
depend on how rows are dealt to tasks. Ids of a word are made once and kept while a worker reads texts. Frequent words are
looked up in a bounded table that every task has; the rest meet their counts in a shuffle. Words stand as 64-bit hashes (two words of n
would be taken for one with a chance of n^2 / 2^65).

Defined results: a null text counts as empty, has one token (the end) and is scored. Every row gives a row, repeated ones
too; an empty table gives none; extra columns are ignored. Without training documents all counts are 0 and the model is
untrained.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.attention_lm import BATCH, SCORED, STEPS, WIDTH, AttentionModel, Weights, id_classes, initial, mean, model, packed, train_shard
from cellweave.llm.byte_bpe import GPT2_LIKE, default_ranks
from cellweave.llm.common import held_out, signed, stored, table, text_batches, word_hashes
from cellweave.llm.word_ids import END, MARK, TOGETHER, forget, kept

SHARD = 1 << 20  # ids of training documents that a task trains on, about
GROWTH = 16  # times as many shards train in a round as in all rounds before it, about
HEAD = 1 << 18  # words whose counts every task knows
BUCKETS = 20  # bits of a hash that lead to its place in the head


def ended(texts: bytes | np.ndarray) -> np.ndarray:
    """Hashes of the words of texts and their ends, where MARK follows each text."""
    words = word_hashes(texts)
    words[words == _MARKED] = END
    return words


_MARKED = word_hashes(MARK)[0]


def finder(head: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For words: their places in the sorted head, and whether they are there."""
    shift = np.uint64(64 - BUCKETS)
    starts = np.searchsorted(head, np.arange(1 << BUCKETS, dtype=np.uint64) << shift)

    def find(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(head):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        place = np.minimum(starts.take((words >> shift).astype(np.int64)), len(head) - 1)
        there = head.take(place)
        known, rest = there == words, np.flatnonzero((there < words) & (place < len(head) - 1))
        while len(rest):
            place[rest] += 1
            there, own = head.take(place.take(rest)), words.take(rest)
            known[rest] = there == own
            rest = rest[(there < own) & (place.take(rest) < len(head) - 1)]
        return place, known

    return find


def _first_pass(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Rows of kind 0: a document and its subword ids; of kind 1 and 2: a task's counts of words and of ids in training."""
    schema = "kind int, doc_id long, held_out boolean, ids binary, item long, n long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]

    def counted(kind: int, items: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(n), 1 << 16):
            i, k = items[at : at + (1 << 16)], n[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), *[pa.nulls(len(k), x) for x in kinds[1:4]], pa.array(i), pa.array(k)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with kept(ranks, pattern) as known:
            for batch, texts in text_batches(batches):
                raw, n = known.encode(texts, [not x for x in batch.column(1).to_pylist()]), len(texts)
                columns = [np.zeros(n, np.int32), batch.column(0), batch.column(1), raw, None, None]
                yield pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, kinds)], names=names)
                if known.full:
                    words, k = known.take_words()
                    yield from counted(1, signed(words), k)
            words, k = known.take_words()
            yield from counted(1, signed(words), k)
            used = np.flatnonzero(known.pieces)
            yield from counted(2, used, known.pieces[used])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 7, 2).alias("held_out"), "text")
    return rows.mapInArrow(run, schema)


def _model(first: DataFrame, ranks: dict[bytes, int]) -> AttentionModel:
    end = len(ranks)
    counts = np.zeros(end + 1, np.int64)
    for r in first.filter("kind = 2").groupBy("item").agg(F.sum("n").alias("n")).collect():  # a row for each id at most
        counts[r.item] = r.n
    groups = np.ones(end + 1, np.int32)
    for piece, rank in ranks.items():
        groups[rank] = 0 if piece[:1] == b" " else 1
    of, inside = id_classes(counts, groups)
    p, kind = initial(counts, of), np.uint16 if end < 1 << 16 else np.uint32
    shards = max(1, -(-int(counts.sum()) // SHARD))
    passes = max(1, -(-STEPS * BATCH * SCORED // max(1, int(counts.sum()))))
    dealt = first.filter("kind = 0 AND NOT held_out").select(F.expr(f"pmod(xxhash64(doc_id, ids), {shards}L)").alias("shard"), "doc_id", "ids")
    values = [f"v{i}" for i in range(WIDTH)]

    def trained(weights: Weights) -> Callable[[tuple, pa.Table], pa.Table]:
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            forget()
            own = {name: x.copy() for name, x in weights.items()}
            order = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("ids").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            place, n, sums = packed(own, train_shard(own, of, [np.frombuffer(x, kind).astype(np.int32) for _, x in order], end, passes, key[0].as_py()))
            return pa.table([pa.array(place.astype(np.int32)), pa.array(n), *[pa.array(sums[:, i]) for i in range(WIDTH)]], names=["place", "n", *values])

        return run

    low, high = 0, 1
    while low < shards:
        parts = dealt.filter((F.col("shard") >= low) & (F.col("shard") < high)).groupBy("shard")
        sums = parts.applyInArrow(trained(p), ", ".join(f"{x} long" if x != "place" else "place int" for x in ("place", "n", *values))).groupBy("place")
        got = sums.agg(*[F.sum(x).alias(x) for x in ("n", *values)]).toArrow()  # a row for each id, and few others
        p = mean(p, got["place"].to_numpy(), got["n"].to_numpy(), np.stack([got[x].to_numpy() for x in values], axis=1))
        low, high = high, high * GROWTH
    return model(p, of, inside, end)


def _scored(first: DataFrame, ranks: dict[bytes, int], model: AttentionModel, head: np.ndarray, log_head: np.ndarray, total: int, distinct: int) -> DataFrame:
    """Each document with its model score, what the head says of its words, and the words outside the head."""
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, log_sum double, score double, rest array<long>, times array<int>"
    names = [x.split()[0] for x in schema.split(", ")]
    pieces = [b""] * (len(ranks) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    pieces[-1] = MARK
    kind = np.uint16 if len(ranks) < 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, find = pa.array(pieces, pa.binary()), finder(head)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                docs = [np.frombuffer(x, kind) for x in batch.column(2).to_pylist()]
                scores = model.log10(docs)
                text = vocabulary.take(pa.array(np.concatenate(docs)))  # of all documents, one after another
                text_at, text = np.frombuffer(text.buffers()[1], np.int32), np.frombuffer(text.buffers()[2], np.uint8)
                stops = text_at[np.cumsum([len(x) for x in docs])]
                cuts = [0, *stops[TOGETHER - 1 : -1 : TOGETHER].tolist(), int(stops[-1])]
                words = np.concatenate([ended(text[lo:hi]) for lo, hi in zip(cuts, cuts[1:])])
                ends = np.flatnonzero(words == END) + 1
                starts, n = np.append(0, ends[:-1]), np.diff(ends, prepend=0)
                place, known = find(words)
                logs = np.where(known, log_head.take(place), 0.0) if len(head) else np.zeros(len(words))
                where = np.flatnonzero(~known)
                order = np.lexsort((words.take(where), doc := np.searchsorted(ends, where, side="right")))
                rest, doc = words.take(where.take(order)), doc.take(order)
                new = np.flatnonzero(np.concatenate((rest[:1] == rest[:1], (rest[1:] != rest[:-1]) | (doc[1:] != doc[:-1]))))
                at_doc = pa.array(np.searchsorted(doc.take(new), np.arange(len(docs) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at_doc, pa.array(x)) for x in (signed(rest.take(new)), np.diff(new, append=len(rest)).astype(np.int32))]
                sums = [pa.array(x) for x in (n, np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(logs, starts), scores)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sums, *lists], names=names)

    return first.filter("kind = 0").select("doc_id", "held_out", "ids").mapInArrow(run, schema)


def scored(docs: DataFrame, ranks: dict[bytes, int], pattern: str = GPT2_LIKE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    first = stored(_first_pass(docs, ranks, pattern))
    counts = stored(first.filter("kind = 1").groupBy("item").agg(F.sum("n").alias("n")))
    sums = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = int(sums[0] or 0), int(sums[1])
    top = counts.orderBy(F.desc("n"), "item").limit(HEAD).toPandas()
    words = top["item"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    head, log_head = words[order], np.log10(top["n"].to_numpy(dtype=np.float64)[order] + 1)
    least = int(top["n"].iloc[-1]) if len(top) else 0
    rows = stored(_scored(first, ranks, _model(first, ranks), head, log_head, total, distinct).withColumn("row", F.monotonically_increasing_id()))
    rest = rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("row", F.col("w.rest").alias("item"), F.col("w.times").alias("times"))
    found = rest.join(counts.filter(F.col("n") <= least), "item").groupBy("row")
    found = found.agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"))
    each = F.log10(F.lit(float(total + distinct + 1)))
    out = rows.drop("rest", "times").join(found, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("more_log", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        "score",
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), default_ranks())


QUERIES = {"op6_lm_score": op6_lm_score}
ORACLE: dict[str, str] = {}
