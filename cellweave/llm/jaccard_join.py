"""N-gram Jaccard join by a token-group matrix.

Documents become sets of 5-word shingle hashes; equal sets collapse to one. Similar sets are partitioned into groups (equal
minimum hash, then split to a bounded size and into local components, the units). The matrix holds, as rows (token, unit),
each unit's union of prefix tokens. Its columns bound the overlap of a query unit with a unit: pairs below the bound are
never opened, and pairs already connected need not be. An opened pair compares its sets exactly.

A set of n tokens needs an overlap of at least o = ceil(0.8 n) with any partner. Whatever common order the tokens are put
in, two partners share at least min(l, o) tokens, for the larger o, among the first n - o + l of each. Tokens that are
frequent in the table come last in that order.

Defined results: a null text counts as empty; a document without words has no shingles and is linked with nothing. Fewer
than five words make one shingle. Rows with equal ids keep their own sets. An empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import lean, short_batches, signed, sorted_set, stored, table, text_batches, window_hashes, word_hashes
from cellweave.llm.components import components

WIDTH = 5
SIMILARITY = 80  # of 100
OVERLAP = 16  # prefix tokens that two partners share at least, where the sets are large enough
GROUP = 256  # sets in a group, about
FREQUENT = 1 << 17  # tokens whose frequency the order knows; any order gives the same result
LOCAL = 4  # a token is reported by a task that has met it in so many documents
CHUNK = 1 << 20  # tokens that a task counts at once
SALTS = 16  # parts into which the rows of a frequent token are dealt
TURNS = 2  # turns in which units are held against the units that their tokens name, at most
PART = 16  # units of one side that are opened at once
OPENED = 2  # groups, or pairs of groups, that a task holds at once


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    return sorted_set(window_hashes(word_hashes(text), width))


def fingerprint(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 100 * |a and b| >= 80 * |a or b|, of sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < SIMILARITY * len(b):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= SIMILARITY * (len(a) + len(b) - both)


def needed(n: int) -> tuple[int, int]:
    """For a set of n tokens: the overlap any partner has with it at least, and how much of it shows in prefixes."""
    least = -(-SIMILARITY * n // 100)
    return least, min(OVERLAP, least)


def _profiles(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a row for each document, and rows (token, n) of what is frequent within a task's chunk."""
    schema = "doc_id long, n long, fp binary, sid long, key long, need int, token long, often long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(held), return_counts=True)
        tokens, n = tokens[n >= LOCAL], n[n >= LOCAL]
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(n), k) for k in kinds[:6]], pa.array(signed(tokens)), pa.array(n)], names=names)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch, texts in text_batches(batches):
            sets = [shingles(x) for x in texts]
            fps = [fingerprint(t) for t in sets]
            sids = [None if fp is None else int.from_bytes(fp[:8], "big", signed=True) for fp in fps]
            keys = [int(t[0].astype(np.int64)) if len(t) else None for t in sets]
            own = [batch.column(0), [len(t) for t in sets], fps, sids, keys, [needed(len(t))[1] for t in sets]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(own, kinds)], pa.nulls(len(sets), kinds[6]), pa.nulls(len(sets), kinds[7])], names=names)
            for t in sets:
                held.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield frequent(held)
                    held, size = [], 0
        if held:
            yield frequent(held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(profile), schema)


def _own_ids(sets: DataFrame) -> dict[bytes, int]:
    """New ids for the few sets whose 64-bit ids clash (about n^2 / 2^65 of n sets)."""
    clash = sets.join(sets.groupBy("sid").count().filter("count > 1").select("sid"), "sid").select("fp").orderBy("fp").collect()
    new: dict[bytes, int] = {}
    for r in clash:
        for turn in range(1 << 20):
            sid = int.from_bytes(hashlib.blake2b(bytes(r.fp), digest_size=8, salt=str(turn).encode()).digest(), "big", signed=True)
            if sid not in new.values() and sets.filter(F.col("sid") == sid).isEmpty():
                new[bytes(r.fp)] = sid
                break
    return new


def _prefixes(docs: DataFrame, frequent: np.ndarray, own_ids: dict[bytes, int]) -> DataFrame:
    """token, sid, need, salt for the prefix tokens of every document; salt is 0 but for tokens in the frequent list."""
    by_hash = np.argsort(frequent)
    known = frequent[by_hash]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            heads, salts, sids, needs, done = [], [], [], [], set()
            for text in texts:
                t = shingles(text)
                fp = fingerprint(t)
                if fp is None or fp in done:
                    continue
                done.add(fp)
                least, need = needed(len(t))
                rank = np.zeros(len(t), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                    hit = known[at] == t
                    if hit.any():
                        rank = np.where(hit, by_hash[at] + 1, 0)
                        order = np.lexsort((t, rank))
                        t, rank = t[order], rank[order]
                keep = len(t) - least + need
                heads.append(signed(t[:keep]))
                sids.append(own_ids.get(fp, int.from_bytes(fp[:8], "big", signed=True)))
                salts.append(np.where(rank[:keep] > 0, 1 + sids[-1] % SALTS, 0).astype(np.int32))
                needs.append(need)
            if heads:
                each = list(map(len, heads))
                arrays = [np.concatenate(heads), np.repeat(np.array(sids, np.int64), each), np.repeat(np.array(needs, np.int32), each), np.concatenate(salts)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["token", "sid", "need", "salt"])

    return docs.select("text").mapInArrow(lean(emit), "token long, sid long, need int, salt int")


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows (token, sid, need, salt), once each, those whose token has several sids or is frequent.

    Each partition is read in order and never held: only the first row of the token at hand is kept back. A frequent token
    is known to be shared, so its rows need not meet and are dealt out by salt.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sent = None, False  # the last row so far, and whether it has been sent
        for batch in batches:
            c = [batch.column(i).to_numpy() for i in range(4)]
            if not len(c[0]):
                continue
            if last is not None:
                c = [np.concatenate((np.array([x], y.dtype), y)) for x, y in zip(last, c)]
            first = np.concatenate(([True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])))
            c = [x[first] for x in c]
            same = c[0][1:] == c[0][:-1]
            keep = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (c[3] > 0)
            was_sent, last = sent, tuple(x[-1] for x in c)
            sent = bool(keep[-1]) or (len(keep) == 1 and was_sent)
            if was_sent:
                keep[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in c[:3]], names=["token", "sid", "need"])

    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "sid")
    return dealt.select("token", "sid", "need", "salt").mapInArrow(lean(runs), "token long, sid long, need int")


def _joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input: never by broadcast, so it plans alike at every size."""
    return left.join(right.hint("merge"), on, how)


def _tokens(docs: DataFrame) -> DataFrame:
    """Adds tokens to rows (sid, fp, key, part, need, text); a row whose text is another's, under a clashing id, is left out."""
    schema = "sid long, key long, part long, need int, tokens binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            sets = [shingles(x) for x in texts]
            own = [fingerprint(t) == fp for t, fp in zip(sets, batch.column(4).to_pylist())]
            both = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([t.tobytes() for t in sets], pa.binary())], names=[x.split()[0] for x in schema.split(", ")])
            yield both.filter(pa.array(own, pa.bool_()))

    return docs.select("sid", "key", "part", F.col("need").cast("int").alias("need"), "fp", "text").mapInArrow(lean(sign), schema)


_UNITS = "unit long, need int, sids array<long>, sizes array<int>, tokens binary"


def _units(group: pa.Table) -> pa.Table:
    """Local components of a group: a set is compared with the sets of each component until one is similar to it."""
    rows = {r["sid"]: r for r in group.select(["sid", "need", "tokens"]).to_pylist()}  # repeated rows once
    sids, need = list(rows), [r["need"] for r in rows.values()]
    sets = [np.frombuffer(r["tokens"], np.uint64) for r in rows.values()]
    parts: list[list[int]] = []
    for i in sorted(range(len(sids)), key=sids.__getitem__):
        linked = [p for p in parts if any(similar(sets[i], sets[j]) for j in p)]
        parts = [p for p in parts if p not in linked]
        parts.append(sorted({i, *(j for p in linked for j in p)}, key=sids.__getitem__))
    rows = [(sids[p[0]], min(need[i] for i in p), [sids[i] for i in p], [len(sets[i]) for i in p], b"".join(sets[i].tobytes() for i in p)) for p in parts]
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _UNITS.split(", ")])


_MEMBERS = "array<struct<comp:bigint,sizes:array<int>,tokens:binary>>"


def _owners(matrix: DataFrame, units: DataFrame) -> DataFrame:
    """unit, gid, and the sizes (low, high) of the unit's sets. Units whose most widely shared token is the same form a group, split to about GROUP sets."""
    wide = _joined(matrix, matrix.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    key = wide.groupBy("unit").agg(F.max_by("token", F.struct("n", "token")).alias("key"))
    sized = _joined(key, units.select("unit", F.size("sids").alias("sets"), F.array_min("sizes").alias("low"), F.array_max("sizes").alias("high")), "unit")
    parts = sized.groupBy("key").agg(F.ceil(F.sum("sets") / GROUP).alias("parts"))
    return stored(_joined(sized, parts, "key").select("unit", F.xxhash64("key", F.pmod(F.xxhash64("unit"), F.col("parts"))).alias("gid"), "low", "high"))


def _opened(rows: DataFrame) -> DataFrame:
    """a, b: links between components, from rows (members, others): all pairs of sets of members if there are no others, else
    of members with others. Sets of components that are one by then are not compared.
    """

    def sets_of(members: list[dict]) -> list[tuple[int, list[np.ndarray]]]:
        return [(m["comp"], np.split(np.frombuffer(m["tokens"], np.uint64), np.cumsum(m["sizes"])[:-1])) for m in members]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                one, two = (sets_of(batch.column(k)[i].as_py() or []) for k in range(2))
                root: dict[int, int] = {}

                def find(x: int, root: dict[int, int] = root) -> int:
                    while root.setdefault(x, x) != x:
                        x = root[x]
                    return x

                pairs = [(x, y) for x in one for y in two] if two else [(x, y) for j, x in enumerate(one) for y in one[:j]]
                for (ca, xs), (cb, ys) in pairs:
                    a, b = find(ca), find(cb)
                    if a != b and any(similar(p, q) for p in xs for q in ys):
                        root[a] = b
                        links.append((min(a, b), max(a, b)))
            a, b = ([x[k] for x in links] for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.select("members", "others").mapInArrow(lean(check), "a long, b long")


def _stars(matrix: DataFrame, comps: DataFrame, units: DataFrame, turn: int, n: int) -> DataFrame:
    """Rows (members, others) that hold, for each unit, the unit of another component most of its tokens name.

    A token names one unit: of its largest component, the one whose hash is largest in this turn. So there are no more pairs
    than units (n of them), and the units that name the same one are dealt into parts.
    """
    sizes = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    held = stored(_joined(matrix, _joined(comps, sizes, "comp"), "unit"))
    named = held.groupBy("token").agg(F.max_by(F.struct("unit", "comp"), F.struct("size", F.xxhash64("unit", F.lit(turn)))).alias("star"))
    pairs = _joined(held, named.select("token", F.col("star.unit").alias("star"), F.col("star.comp").alias("star_comp")), "token").filter("comp <> star_comp")
    pairs = pairs.groupBy("unit", "comp", "need", "star", "star_comp").agg(F.count(F.lit(1)).alias("shared")).filter("2 * shared >= need")
    best = pairs.groupBy("unit", "comp").agg(F.max_by(F.struct("star", "star_comp"), F.struct("shared", "star")).alias("to"))
    best = stored(best.select("unit", "comp", F.col("to.star").alias("star"), F.col("to.star_comp").alias("star_comp")), rows=n)
    parts = best.groupBy("star", "star_comp").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    sets = units.select("unit", "sizes", "tokens")
    dealt = _joined(_joined(best, parts.drop("star_comp"), "star"), sets, "unit").withColumn("part", F.pmod(F.xxhash64("unit", F.lit(turn)), F.col("parts")))
    others = dealt.groupBy("star", "part").agg(F.collect_list(F.struct("comp", "sizes", "tokens")).alias("others"))
    one = _joined(parts, sets.withColumnRenamed("unit", "star"), "star").select("star", F.array(F.struct(F.col("star_comp").alias("comp"), "sizes", "tokens")).alias("members"))
    return _joined(others, one, "star")


def _connected(matrix: DataFrame, units: DataFrame) -> DataFrame:
    """unit, comp: components of the matrix's units under similarity of any of their sets.

    First every group is opened, and each unit is held against the one most of its tokens name, in turns; that joins most of
    a family in steps that grow with its size. The units of a component are then one column of the matrix, whose union has
    each token once, and units that are still alone share a column by group. Of columns whose unions share enough tokens, a
    query unit qualifies for another column if its own prefix shares enough of them with that column's union. Two columns
    are opened to each other where units of both qualify, with these units only.
    """
    n = units.count()
    comps = stored(matrix.select("unit").distinct().withColumn("comp", F.col("unit")), rows=n)
    owner = _owners(matrix, units)
    sets = units.select("unit", "sizes", "tokens")

    def merge(rows: DataFrame) -> bool:
        """Joins components by what opening the rows finds, if anything."""
        nonlocal comps
        with short_batches(matrix.sparkSession, OPENED):
            links = stored(_opened(rows))
        if links.isEmpty():
            return False
        joined = components(links).select(F.col("node").alias("comp"), "component")
        comps = stored(_joined(comps, joined, "comp", "left").select("unit", F.coalesce("component", "comp").alias("comp")), rows=n)
        return True

    several = owner.groupBy("gid").count().filter("count > 1").select("gid")
    alone = _joined(_joined(owner, several, "gid"), sets, "unit").groupBy("gid").agg(F.collect_list(F.struct(F.col("unit").alias("comp"), "sizes", "tokens")).alias("members"))
    merge(alone.withColumn("others", F.expr(f"cast(array() as {_MEMBERS})")))
    for turn in range(TURNS):
        if not merge(_stars(matrix, comps, units, turn, n)):
            break
    large = comps.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    placed = _joined(_joined(owner, comps, "unit"), large, "comp")
    column = F.when(F.col("size") > 1, F.xxhash64(F.lit("component"), "comp")).otherwise(F.col("gid"))
    own = stored(_joined(matrix, placed.withColumn("gid", column).drop("size"), "unit"))
    union = own.select("token", F.col("gid").alias("to")).distinct()
    union = stored(_joined(union, union.groupBy("token").count().filter("count > 1").select("token"), "token"))
    least = own.groupBy("gid").agg(F.min("need").alias("need"), F.min("low").alias("low"), F.max("high").alias("high"))
    each = _joined(union.withColumnRenamed("to", "gid"), least, "gid")
    side = lambda x: each.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("gid", "need", "low", "high")])
    alike = F.expr(f"100 * high_a >= {SIMILARITY} * low_b AND 100 * high_b >= {SIMILARITY} * low_a")  # the sets' sizes
    common = stored(_joined(side("a"), side("b"), "token").filter(F.expr("gid_a < gid_b") & alike).select("token", "gid_a", "gid_b", F.greatest("need_a", "need_b").alias("need"), "low_a", "high_a", "low_b", "high_b"))
    pairs = common.groupBy("gid_a", "gid_b").agg(F.count(F.lit(1)).alias("shared"), F.max("need").alias("least"))
    common = stored(_joined(common, pairs.filter("shared >= least").select("gid_a", "gid_b"), ["gid_a", "gid_b"]))
    turned = common.select("token", F.col("gid_b").alias("gid"), F.col("gid_a").alias("gid_b"), F.col("low_a").alias("low_b"), F.col("high_a").alias("high_b"))
    targets = common.select("token", F.col("gid_a").alias("gid"), "gid_b", "low_b", "high_b").union(turned)  # what each column shares with its partners
    queries = own.withColumnsRenamed({"low": "low_a", "high": "high_a"})
    bound = _joined(queries, targets, ["token", "gid"]).filter(alike).select("unit", "comp", "gid", F.col("gid_b").alias("to"), "need")
    bound = bound.groupBy("unit", "comp", "gid", "to").agg(F.count(F.lit(1)).alias("shared"), F.max("need").alias("need"))
    able = bound.filter("shared >= need")
    able = stored(able.select("unit", "comp", F.least("gid", "to").alias("a"), F.greatest("gid", "to").alias("b"), (F.col("gid") < F.col("to")).alias("first")))
    both = able.groupBy("a", "b").agg(F.sum(F.col("first").cast("long")).alias("firsts"), F.count(F.lit(1)).alias("n")).filter("firsts > 0 AND firsts < n")
    dealt = _joined(_joined(able, both, ["a", "b"]), sets, "unit")
    parts = F.ceil(F.when(F.col("first"), F.col("firsts")).otherwise(F.col("n") - F.col("firsts")) / PART)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("unit"), parts)).groupBy("a", "b", "first", "part").agg(F.collect_list(F.struct("comp", "sizes", "tokens")).alias("held"))
    dealt = stored(dealt)
    rows = _joined(dealt.filter("first").select("a", "b", F.col("held").alias("members")), dealt.filter("NOT first").select("a", "b", F.col("held").alias("others")), ["a", "b"])
    merge(rows)
    return comps


def _near(docs: DataFrame, profiles: DataFrame, sets: DataFrame) -> DataFrame:
    """sid, need, tokens of the sets that share enough prefix tokens with others to have a partner at all."""
    counts = profiles.filter("token IS NOT NULL").groupBy("token").agg(F.sum("often").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    frequent = top["token"].to_numpy(dtype=np.int64)[::-1].view(np.uint64)
    rows = _shared(_prefixes(docs, frequent, _own_ids(sets)))
    near = rows.groupBy("sid").agg(F.min("need").alias("need"), F.collect_list("token").alias("tokens"))
    return stored(near.filter(F.size("tokens") >= F.col("need")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    profiles = stored(_profiles(docs))
    rows = profiles.filter("token IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "fp", "sid", "key", "need")
    sets = stored(rows.filter("fp IS NOT NULL").groupBy("fp").agg(*[F.min(c).alias(c) for c in ("doc_id", "sid", "key", "need")]))
    near = _near(docs, profiles, sets)
    new = _own_ids(sets)
    if new:
        renamed = docs.sparkSession.createDataFrame([(bytearray(k), v) for k, v in new.items()], "fp binary, new long")
        sets = stored(sets.join(F.broadcast(renamed), "fp", "left").withColumn("sid", F.coalesce("new", "sid")).drop("new"))
    ids = stored(_joined(near.select("sid"), sets, "sid").select("sid", "doc_id", "fp", "key", "need"))
    parts = ids.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    grouped = _joined(ids, parts, "key").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")))
    wanted = grouped.select(F.col("doc_id").alias("_id"), "sid", "fp", "key", "part", "need")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")))
    units = stored(_tokens(texts).groupBy("key", "part").applyInArrow(_units, _UNITS))
    owner = stored(units.select("unit", "need", F.explode("sids").alias("sid")))
    matrix = _joined(near.select("sid", "tokens"), owner, "sid").select(F.explode("tokens").alias("token"), "unit", "need")
    comps = _connected(stored(matrix.distinct()), units)
    label = _joined(_joined(owner, comps, "unit", "left").select("sid", F.coalesce("comp", "unit").alias("comp")), ids.select("sid", "doc_id", "fp"), "sid")
    least = label.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    linked = _joined(label, least, "comp").select("fp", "component_id")
    every = _joined(sets.select("fp", "doc_id"), linked, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = rows.join(every.hint("merge"), F.col("fp") == F.col("_fp"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the least of its component; rows without a shingle all stay."""
    found = jaccard_components(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
ORACLE: dict[str, str] = {}
