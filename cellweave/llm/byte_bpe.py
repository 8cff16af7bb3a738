"""Byte-level BPE: Spark higher-order functions fold ranked merges over the bytes of distinct words.

Consecutive documents of a task form a block of BLOCK characters. Python splits the texts by the vocabulary's pattern; a
block sends its distinct words out in BUCKETS rows, by hash, and keeps where each stands. The blocks of SPAN tasks share a
dictionary: rows of one bucket meet, their words are made distinct, and a Spark projection folds the merges of each word
once, with a literal rank map. The ids then go back to their blocks, which lay them out by document and decode them by
concatenating binary pieces. A bucket holds a fixed share of the words of a fixed number of tasks, a block a fixed amount of
text, so that no task grows with the input; texts are read once and neither they nor their words' places are stored twice.

The fold's state is one array of 64-bit entries, an entry for each piece: the rank of the pair it begins, its place and its
id. Words of more than LONG bytes are merged by a heap in Python, in n log n steps for n bytes, as a fold takes time with the
square of a word's bytes.

Defined results: a null text counts as empty and has no ids. Every row gives a row, repeated ones too; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import lean, release, table
from cellweave.llm.quality import let

BLOCK = 4 << 20  # characters of text
BUCKETS = 256  # rows in which a block sends its words
SPAN = 64  # tasks whose blocks share a dictionary
LONG = 512  # bytes of a word that the fold takes at most

#: An entry of the fold is (rank of the pair) * 2^26 + (place) * 2^16 + (id); from 2^43 on there is no such pair.
ID_BITS, PLACE_BITS, LEFT_BIT = 16, 10, 44
NO_PAIR = 1 << 43
END = (1 << ID_BITS) - 1  # the id that stands for the end of a word
MASK = (1 << ID_BITS) - 1

#: Letters and blanks of texts without other characters; for these the standard matcher splits as the pattern does.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_USUAL = re.compile(rf"[\x00-\x7F{_LETTER}]*")
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\t-\r {_LETTER}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
GPT2_LIKE = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: a base64 piece and its rank on each line."""
    return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, list[tuple[int, int]]]:
    """For each left id, the right ids that make a piece with it, and the piece's rank."""
    pairs: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
            if left is not None and right is not None:
                pairs.setdefault(left, []).append((right, rank))
    return pairs


def rank_map(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(table, starts): the rows of all left ids laid over one another in one table, so that no two pairs share a place.

    table[starts[left] + right] holds left * 2^44 + rank * 2^26 for a pair, and another left or NO_PAIR where there is none.
    """
    pairs = pair_ranks(ranks)
    size = 1 << max(sum(map(len, pairs.values())) * 4, 1).bit_length()
    used, cells, starts = np.zeros(size + END + 1, bool), np.full(size + END + 1, NO_PAIR, np.int64), np.zeros(END + 1, np.int64)
    rng = np.random.default_rng(0)
    for left in sorted(pairs, key=lambda x: -len(pairs[x])):
        right, rank = np.array(pairs[left], np.int64).T
        start = 0
        while used[start + right].any():
            start = int(rng.integers(size))
        used[start + right], cells[start + right], starts[left] = True, (left << LEFT_BIT) | (rank << ID_BITS + PLACE_BITS), start
    return cells.tolist(), starts.tolist()


def encode_words(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """rows with words, an array of binary words of at most LONG bytes each, replaced by an array of their ids.

    The literal rank map is a scalar subquery of one row: of an array among the expressions, Spark would write all entries
    into each text of the plan.
    """
    if max(ranks.values(), default=0) >= END or any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("the ranks must hold every byte and stay below 65535")
    constants = rows.sparkSession.createDataFrame([(*rank_map(ranks), [ranks[bytes([i])] for i in range(256)])], "cells array<bigint>, starts array<int>, single array<bigint>")
    held = rows.select("*", *[constants.select(c).scalar().alias(f"_{c}") for c in constants.columns])
    cells, starts, single = (F.col(f"_{c}") for c in constants.columns)
    pair = lambda left, right: F.get(cells, F.get(starts, left) + right).bitwiseXOR(F.shiftleft(left.cast("long"), LEFT_BIT))
    id_of = lambda entry: entry.bitwiseAND(MASK).cast("int")
    at = lambda i: F.shiftleft(i.cast("long"), ID_BITS)

    def merged(entries: Column, low: Column) -> Column:
        """The entries after the pair of the entry `low` has become one piece."""
        new = F.shiftright(low, ID_BITS + PLACE_BITS).cast("int")  # a piece's rank is its id

        def put(a: Column) -> Column:
            def entry(after: Column, i: Column) -> Column:
                own = F.get(entries, i)
                before = pair(id_of(own), new) + own.bitwiseAND((1 << ID_BITS + PLACE_BITS) - 1)
                return F.when(i > a, after - (1 << ID_BITS)).when(i < a - 1, own).when(i < a, before).otherwise(pair(new, id_of(F.get(entries, a + 2))) + at(i) + new)

            return F.transform(F.slice(entries, 2, F.size(entries)), entry)

        return let(F.shiftright(low, ID_BITS).bitwiseAND((1 << PLACE_BITS) - 1).cast("int"), put)

    def fold(ids: Column) -> Column:
        last = F.size(ids) - 1
        begin = F.transform(ids, lambda x, i: F.when(i < last, pair(x.cast("int"), F.get(ids, i + 1).cast("int"))).otherwise(F.lit(1 << 62)) + at(i) + x)
        step = lambda entries, _: let(F.array_min(entries), lambda low: F.when(low < NO_PAIR, merged(entries, low)).otherwise(entries))
        return F.aggregate(F.slice(ids, 3, F.size(ids)), begin, step, lambda entries: F.transform(F.slice(entries, 1, F.size(entries) - 1), id_of))

    def encode(word: Column) -> Column:
        ids = F.transform(F.split(F.decode(word, "ISO-8859-1"), F.lit("")), lambda c: F.get(single, F.ascii(c)))
        return let(F.concat(ids, F.array(F.lit(END).cast("long"))), fold)

    return held.select(*[F.transform(c, encode).alias(c) if c == "words" else c for c in rows.columns])


def heap_encode(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word: the least pair comes from a heap, the pieces are linked to their neighbours."""
    n = len(word)
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    piece = lambda i, j: ranks.get(word[i:j])
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := piece(i, i + 2)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)  # the pieces i..j and j..k, if they are still there
        if not (alive[i] and stop[i] == j and alive[j] and stop[j] == k):
            continue
        alive[j], stop[i] = False, k
        if k < n:
            before[k] = i
            if (r := piece(i, stop[k])) is not None:
                heapq.heappush(heap, (r, i, k, stop[k]))
        if i and (r := piece(h := before[i], k)) is not None:
            heapq.heappush(heap, (r, h, i, k))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : stop[i]]])
        i = stop[i]
    return out


def split_text(text: str, slow: regex.Pattern) -> list[str]:
    return _FAST.findall(text) if slow.pattern == GPT2_LIKE and _USUAL.fullmatch(text) else slow.findall(text)


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(x.tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _packed_words(words: list[bytes]) -> bytes:
    return _packed(np.fromiter(map(len, words), np.uint16, len(words)), np.frombuffer(b"".join(words), np.uint8))


def _word_array(raw: bytes, n: int) -> pa.Array:
    raw = _unpacked(raw)
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint16, n), dtype=np.int32))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[2 * n :])])


#: A row of a block holds its documents; places are those of each word in the block's words, by bucket, then in long_ids.
#: A row of a bucket holds n words of a block.
_ROWS = "key long, block long, bucket int, n int, words binary, doc_ids array<long>, sizes array<int>, places binary, long_ids array<array<int>>"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.list_(pa.int32())))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _blocks(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The rows of blocks (key: the block, 0 or more) and of their buckets (key: below 0, by bucket and SPAN tasks)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slow = regex.compile(pattern)
        task = TaskContext.get().partitionId()
        ids, sizes, places, known, held, made = [], [], [], {}, 0, 0

        def block() -> pa.RecordBatch:
            words = [w.encode() for w in known]
            long = np.fromiter((len(w) > LONG for w in words), bool, len(words))
            bucket = np.where(long, BUCKETS, np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words)))
            order = np.argsort(bucket, kind="stable")
            counts = np.bincount(bucket, minlength=BUCKETS + 1)
            name = task << 32 | made
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            number = place[np.concatenate(places)] if places else place
            ordered = [words[i] for i in order.tolist()]
            rare = [heap_encode(w, ranks) for w in ordered[len(ordered) - int(counts[BUCKETS]) :]]
            rows = [(name, name, -1, 0, None, ids, sizes, _packed(number.view(np.uint8).reshape(-1, 4).T.copy()), rare)]
            lo = 0
            for b, n in enumerate(counts[:BUCKETS].tolist()):
                if n:
                    rows.append((-1 - (task // SPAN * BUCKETS + b), name, b, n, _packed_words(ordered[lo : lo + n]), None, None, None, None))
                    lo += n
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), _KINDS)], names=_names(_ROWS))

        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split_text(text, slow) if text else []
                for w in set(words).difference(known):
                    known[w] = len(known)
                ids.append(doc_id)
                sizes.append(len(words))
                places.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                held += len(text or "")
                if held >= BLOCK:
                    yield block()
                    pa.default_memory_pool().release_unused()
                    ids, sizes, places, known, held, made = [], [], [], {}, 0, made + 1
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(cut), _ROWS)


_SHARED = "words array<binary>, places binary, blocks array<long>, bucket int, sizes array<int>"


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks' buckets, sorted by key: for each key its distinct words and where those of each block are among them."""
    kinds = (pa.list_(pa.binary()), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()))
    held: list[tuple] = []

    def shared() -> pa.RecordBatch:
        words = pa.concat_arrays([_word_array(raw, n) for _, _, _, n, raw in held]).dictionary_encode()
        values = words.dictionary
        lists = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        rest = (words.indices.to_numpy().astype(np.int32).tobytes(), [h[1] for h in held], held[0][2], [h[3] for h in held])
        return pa.RecordBatch.from_arrays([lists, *[pa.array([c], k) for c, k in zip(rest, kinds[1:])]], names=_names(_SHARED))

    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            if row[0] >= 0:
                continue
            if held and held[0][0] != row[0]:
                yield shared()
                held = []
            held.append(row)
    if held:
        yield shared()


_BACK = "key long, bucket int, n int, ids binary"


def _ids_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of a shared dictionary, the numbers of ids of its words and the ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column(0)[i].values  # lists of ids
            places, blocks, bucket, sizes = (batch.column(k)[i].as_py() for k in range(1, 5))
            out, hi = [], 0
            all_places = np.frombuffer(places, np.int32)
            for n in sizes:
                lo, hi = hi, hi + n
                mine = words.take(pa.array(all_places[lo:hi]))
                each = np.diff(mine.offsets.to_numpy()).astype(np.uint16)
                out.append(_packed(each, mine.flatten().to_numpy().astype(np.uint16)))
            columns = (pa.array(blocks, pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array(sizes, pa.int32()), pa.array(out, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(columns), names=_names(_BACK))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str = GPT2_LIKE, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids for every row of docs."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()))[: 4 + with_ids]
    dealt = _blocks(docs, ranks, pattern).repartition("key")  # used twice, shuffled once
    shared = dealt.sortWithinPartitions("key", "block", "bucket").mapInArrow(lean(_distinct_words), _SHARED)
    back = encode_words(shared, ranks).mapInArrow(lean(_ids_back), _BACK)
    pieces = {rank: piece for piece, rank in ranks.items()}

    def lay_out(blocks: pa.Table, words: pa.Table) -> pa.Table:
        rows = [r for r in blocks.select(["bucket", "doc_ids", "sizes", "places", "long_ids"]).to_pylist() if r["bucket"] < 0]
        out = [[] for _ in kinds]
        for row in rows:
            each, ids = [], []
            for r in sorted(words.to_pylist(), key=lambda r: r["bucket"]):
                raw = np.frombuffer(_unpacked(r["ids"]), np.uint16)
                each.append(raw[: r["n"]])
                ids.append(raw[r["n"] :])
            long = row["long_ids"] or []
            each = np.concatenate([*each, np.array([len(x) for x in long], np.int64)]).astype(np.int64)
            ids = np.concatenate([*ids, *[np.array(x, np.int64) for x in long], np.empty(0, np.int64)]).astype(np.int32)
            stop = np.cumsum(each)
            start = stop - each
            all_ids, bounds = ids.tolist(), list(zip(start.tolist(), stop.tolist()))
            names = {x: str(x) for x in set(all_ids)}
            shown = [names[x] for x in all_ids]
            binary = [pieces[x] for x in all_ids]
            text_of = np.array([" ".join(shown[a:b]) for a, b in bounds] or [""], object)
            bytes_of = np.array([b"".join(binary[a:b]) for a, b in bounds] or [b""], object)
            places = np.frombuffer(_unpacked(row["places"]), np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel()
            for doc_id, at in zip(row["doc_ids"], np.split(places, np.cumsum(row["sizes"])[:-1])):
                found = (
                    doc_id,
                    int(each[at].sum()),
                    hashlib.sha256(" ".join(text_of[at].tolist()).encode()).hexdigest(),
                    hashlib.sha256(b"".join(bytes_of[at].tolist())).hexdigest(),
                )
                if with_ids:
                    lens = each[at]
                    first = np.concatenate(([0], np.cumsum(lens)))
                    found += (ids[np.arange(first[-1]) + np.repeat(start[at] - first[:-1], lens)],)
                for column, value in zip(out, found):
                    column.append(value)
        if rows:  # a block; keys of buckets have none
            release()
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds)], names=_names(schema))

    return dealt.groupBy("key").cogroup(back.groupBy("key")).applyInArrow(lay_out, schema)


def default_ranks() -> dict[bytes, int]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), default_ranks(), with_ids=False)


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLE: dict[str, str] = {}
