"""Toxicity: the nearest labelled examples by exact TF-IDF cosine vote, weighted by their similarity.

Terms are words and leading pieces of words. A document's vector has (1 + ln tf) * idf for each term; its length counts
every word, but only terms that go with the label in the examples (chi squared) can be shared. Document frequencies come
from the whole table; a word held by less than one in RARE documents weighs as if one in RARE held it, unless it is one of the
shared terms. The examples lie in a block-max inverted index: for each term and block of examples the largest weight, so a
block is opened only for the documents of a batch whose bound reaches their k-th best similarity. Skipping never changes
the result. The votes' share is calibrated by a logistic curve, fitted to what the other examples say of each example.

The examples are a bounded sample of labelled rows: for each label the EXAMPLES rows of least hash, equal texts once.

Defined results: a null or empty text has no terms, as has a text without shared terms; it gets the share of label 1
among examples without terms. Labels that are null are no examples; of several labels of one id the largest counts. Equal
similarities rank by the example's doc_id. Without examples every score is 0; with examples of one label only, that label's
share. Repeated rows each give a row; an empty table gives none; extra columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import held_out, lean, stored, table, text_batches

EXAMPLES = 4096  # of each label, at most
PIECES = (4, 5, 6)  # lengths in bytes of the leading pieces that are terms beside the whole word
LEAST_ROWS = 3  # examples that hold a term of the vocabulary, at least
LEAST_CHI2 = 15.0
RARE = 1000
NEIGHBOURS = 15
SMOOTHING = 0.2  # similarity with which the overall share of label 1 votes
CUTOFF = 0.7
BLOCK = 64  # examples in a block
SLICE = 256  # examples that are scored at once to calibrate

_CHARS = bytes(x if 48 <= x < 58 or 97 <= x < 123 or x > 127 else x + 32 if 65 <= x < 91 else 32 for x in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased, and of other characters."""
    return text.translate(_CHARS).split()


def terms_of(word: bytes) -> list[bytes]:
    return [word, *[word[:k] + b"-" for k in PIECES if len(word) > k]]


@dataclass
class Weights:
    """vocabulary: the place of each shared term; idf: its weight; words: the weights of common words beside them."""

    vocabulary: dict[bytes, int]
    idf: np.ndarray
    words: dict[bytes, float]
    rare: float = math.log(RARE) + 1  # the weight of all other words

    def vectors(self) -> Callable[[list[bytes]], np.ndarray]:
        """A function from texts to the rows of their weights of shared terms; words that begin like no shared piece are not looked into."""
        whole = {t for t in self.vocabulary if not t.endswith(b"-")}  # words have no hyphen
        pieces: dict[bytes, list[tuple[bytes, int]]] = {}
        for t, i in self.vocabulary.items():
            if t not in whole:
                pieces.setdefault(t[: PIECES[0]], []).append((t[:-1], i))
        squares = {w: x**2 for w, x in self.words.items()} | dict.fromkeys(whole, 0.0)
        rare = self.rare**2

        def rows(texts: list[bytes]) -> np.ndarray:
            out = np.zeros((len(texts), len(self.idf)))
            for row, text in zip(out, texts):
                held = Counter(words(text))
                counts = {self.vocabulary[w]: held[w] for w in held.keys() & whole}
                for word, alike in [(w, x) for w in held if (x := pieces.get(w[: PIECES[0]]))]:
                    for piece, t in alike:
                        if len(word) > len(piece) and word.startswith(piece):
                            counts[t] = counts.get(t, 0) + held[word]
                if counts:  # else the row stays empty, whatever the text's length
                    ts = np.array(sorted(counts))
                    ws = (1 + np.log(np.fromiter(map(counts.get, ts.tolist()), np.float64, len(ts)))) * self.idf[ts]
                    each = np.fromiter(map(squares.get, held, repeat(rare)), np.float64, len(held))
                    rest = each @ (1 + np.log(np.fromiter(held.values(), np.float64, len(held)))) ** 2
                    row[ts] = ws / math.sqrt(float(ws @ ws + rest))
            return out

        return rows


@dataclass
class Index:
    """The examples' vectors in blocks. bounds[t, b]: the largest weight of term t in block b."""

    ids: np.ndarray
    labels: np.ndarray
    bounds: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # the terms of a block; a weight for each of them and example

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Index:
        order = np.lexsort((ids, vectors.argmax(axis=1)))  # alike examples side by side keep the bounds tight
        blocks, bounds = [], np.zeros((vectors.shape[1], -(-len(ids) // BLOCK)))
        for b in range(bounds.shape[1]):
            part = vectors[order[b * BLOCK : (b + 1) * BLOCK]]
            bounds[:, b] = part.max(axis=0)
            terms = np.flatnonzero(bounds[:, b])
            blocks.append((terms, np.ascontiguousarray(part[:, terms].T)))
        return cls(ids[order].astype(np.int64), labels[order].astype(np.float64), bounds, blocks)

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the places (-1: none) and similarities of the k examples of largest cosine, in that order."""
        places, sims = np.full((len(queries), k), -1), np.zeros((len(queries), k))
        most = queries @ self.bounds * (1 + 1e-9)
        ids = np.append(self.ids, np.iinfo(np.int64).max)  # that of place -1
        for b in np.argsort(-most.max(axis=0, initial=0), kind="stable"):
            open_to = np.flatnonzero((most[:, b] > 0) & (most[:, b] >= sims[:, -1]))
            if not len(open_to):
                continue
            terms, weights = self.blocks[b]
            found = queries[np.ix_(open_to, terms)] @ weights
            at = np.where(found > 0, b * BLOCK + np.arange(found.shape[1]), -1)
            both, where = np.hstack((sims[open_to], found)), np.hstack((places[open_to], at))
            best = np.lexsort((ids[where], -both), axis=1)[:, :k]
            sims[open_to], places[open_to] = np.take_along_axis(both, best, 1), np.take_along_axis(where, best, 1)
        return places, sims


@dataclass
class Model:
    weights: Weights
    index: Index | None
    share: float  # of label 1 among the examples
    no_terms: float  # the same among examples without terms
    curve: tuple[float, float] = (1.0, 0.0)  # of the calibration

    def votes(self, places: np.ndarray, sims: np.ndarray) -> np.ndarray:
        labels = np.append(self.index.labels, 0.0)[places]
        return ((sims * labels).sum(axis=1) + SMOOTHING * self.share) / (sims.sum(axis=1) + SMOOTHING)

    def scorer(self) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A function from texts to scores, and places and similarities of the examples they come from."""
        vectors = self.weights.vectors()

        def score(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            out, places, sims = np.full(len(texts), self.no_terms), np.full((len(texts), NEIGHBOURS), -1), np.zeros((len(texts), NEIGHBOURS))
            if self.index is not None:
                rows = vectors(texts)
                some = np.flatnonzero(rows.any(axis=1))
                if len(some):
                    places[some], sims[some] = self.index.nearest(rows[some], NEIGHBOURS)
                    out[some] = _calibrated(self.votes(places[some], sims[some]), self.curve)
            return np.clip(out, 0.0, 1.0), places, sims

        return score

    def with_curve(self, vectors: np.ndarray) -> Model:
        """The model calibrated by the index's examples, each of which is scored by the others; vectors: in the index's order."""
        votes = np.empty(len(vectors))
        for lo in range(0, len(vectors), SLICE):
            places, sims = self.index.nearest(vectors[lo : lo + SLICE], NEIGHBOURS + 1)
            own = places == np.arange(lo, lo + len(places))[:, None]
            own[:, -1] |= ~own.any(axis=1)  # its own place may be behind equal ones
            shape = (len(places), NEIGHBOURS)
            votes[lo : lo + SLICE] = self.votes(places[~own].reshape(shape), sims[~own].reshape(shape))
        return replace(self, curve=_logistic(votes, self.index.labels))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _calibrated(votes: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-(curve[0] * _logit(votes) + curve[1])))


def _logistic(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the votes' logits, by Newton steps towards Platt's softened targets."""
    n1, n0 = float(labels.sum()), float((1 - labels).sum())
    if not n1 or not n0:
        return 1.0, 0.0
    z, target = np.column_stack((_logit(votes), np.ones(len(votes)))), np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    at = np.array([1.0, 0.0])

    def loss(x: np.ndarray) -> float:
        y = z @ x
        return float((np.logaddexp(0, y) - target * y).sum() + 1e-3 * x @ x)

    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ at)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 2e-3 * np.eye(2), z.T @ (p - target) + 2e-3 * at)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, text of the sample: of equal texts the least id. Rows with crc32(doc_id) mod 3 = 1 are never used."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter(~held_out(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    turn = F.xxhash64("doc_id")
    chosen = own.filter("toxic = 1").orderBy(turn, "doc_id").limit(EXAMPLES).union(own.filter("toxic = 0").orderBy(turn, "doc_id").limit(EXAMPLES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # 2 * EXAMPLES rows of two numbers at most
    return stored(found.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))


def _vocabulary(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Terms that go with the label by a chi squared test, and words of several examples, each in a fixed order."""
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return [], []

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            counts: dict[tuple[bytes, bool], list[int]] = {}
            for text, y in zip(texts, batch.column(1).to_pylist()):
                own = set(words(text))
                for t in {(t, False) for w in own for t in terms_of(w)[1:]} | {(w, True) for w in own}:
                    counts.setdefault(t, [0, 0])[y] += 1
            columns = ([t for t, _ in counts], [w for _, w in counts], [c[1] for c in counts.values()], [c[0] for c in counts.values()])
            kinds = (pa.binary(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["term", "word", "a", "b"])

    counts = sample.select("text", "toxic").mapInArrow(lean(terms), "term binary, word boolean, a long, b long").groupBy("term", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = n1 + n0
    chi2 = F.expr(f"{n}D * pow(a * ({n0}D - b) - b * ({n1}D - a), 2) / ((a + b) * ({n}D - a - b) * {n1}D * {n0}D)")
    shared = (F.col("a") + F.col("b") >= LEAST_ROWS) & (F.col("a") + F.col("b") < n) & (chi2 >= LEAST_CHI2)
    rows = counts.withColumn("shared", shared).filter((F.col("a") + F.col("b") >= 2) & (F.col("word") | F.col("shared"))).orderBy("term").select("term", "word", "shared").collect()
    vocabulary = [bytes(r.term) for r in rows if r.shared]
    return vocabulary, [bytes(r.term) for r in rows if r.word and not r.shared]


def _document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """How many documents of the whole table hold each term, and how many there are; a task sends one row for each term."""
    place = {t: i for i, t in enumerate(terms)}
    heads = {t[:4] for t in terms if t.endswith(b"-")}  # of pieces; words have no hyphen

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(len(terms), np.int64), 0
        for _, texts in text_batches(batches):
            for text in texts:
                own = set(words(text))
                ids = {place[w] for w in own & place.keys()}
                ids.update(place[t] for w in own if w[:4] in heads for t in terms_of(w)[1:] if t in place)
                if ids:
                    held[list(ids)] += 1
                n += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, len(terms))), pa.array(np.append(held[at], n))], names=["term", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    for r in docs.select("text").mapInArrow(lean(tally), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    sample = examples(docs, labels)
    vocabulary, common = _vocabulary(sample)
    held, n = _document_frequencies(docs, vocabulary + common) if vocabulary else (np.zeros(0), 0)
    idf = np.log((1 + n) / (1 + held)) + 1
    rare = Weights.rare
    weights = Weights({t: i for i, t in enumerate(vocabulary)}, idf[: len(vocabulary)], {w: x for w, x in zip(common, idf[len(vocabulary) :].tolist()) if x < rare})

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = weights.vectors()
        for batch, texts in text_batches(batches):
            rows = vectors(texts)
            at = [np.flatnonzero(r) for r in rows]
            lists = [pa.array(at, pa.list_(pa.int32())), pa.array([r[t] for r, t in zip(rows, at)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), *lists], names=["doc_id", "toxic", "terms", "weights"])

    rows = sample.select("text", "doc_id", "toxic").mapInArrow(lean(weighed), "doc_id long, toxic int, terms array<int>, weights array<double>").orderBy("doc_id").collect()
    share = sum(r.toxic for r in rows) / len(rows) if rows else 0.0
    none = [r.toxic for r in rows if not r.terms]
    some = [r for r in rows if r.terms]
    model = Model(weights, None, share, sum(none) / len(none) if none else share)
    if not some:
        return model
    vectors = np.zeros((len(some), len(vocabulary)))
    for row, r in zip(vectors, some):
        row[r.terms] = r.weights
    ids = np.array([r.doc_id for r in some])
    model.index = Index.of(ids, np.array([r.toxic for r in some]), vectors)
    place = {i: k for k, i in enumerate(ids.tolist())}
    return model.with_curve(vectors[[place[i] for i in model.index.ids.tolist()]])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (examples and similarities, nearest first) for every row of docs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        kind = pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())])
        for batch, texts in text_batches(batches):
            scores, places, sims = scorer(texts)
            seen = places >= 0
            ends = np.concatenate(([0], np.cumsum(seen.sum(axis=1)))).astype(np.int32)
            ids = model.index.ids[places[seen]] if model.index is not None else np.empty(0, np.int64)
            evidence = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(sims[seen])], fields=list(kind)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), evidence], names=["doc_id", "held_out", "score", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    out = rows.mapInArrow(lean(score), "doc_id long, held_out boolean, score double, evidence array<struct<doc_id:long,similarity:double>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "evidence")


def unoffensive(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is below the cutoff, with docs' columns; nothing is shuffled."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch, texts in text_batches(batches):
            yield batch.filter(pa.array(scorer(texts)[0] < CUTOFF, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLE: dict[str, str] = {}
