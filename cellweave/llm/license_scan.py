"""License scans: phrases at exact word positions, and an exact containment join of text blocks with license templates.

A block is a line of the text. A template is the set of its words. A block meets a template if it holds at least the given
share of the template's words. Template words are ordered by their document frequency over the whole table, rarest first;
a block is looked at only if it holds a word of some template's prefix, and then passes length and positional filters
before the overlap is counted. Everything happens in the document's own row, so nothing is shuffled.

Defined results: a null text counts as empty, has no words, no label and score 0. Every row gives a row, repeated ones too;
an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import LOWER, UPPER, ascii_lower, stored, table
from cellweave.llm.quality import let

#: Characters between words, once A-Z are lower-cased, and before that.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: The wording in which licenses are usually named.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under creative commons attribution sharealike 4 0 international license",
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "public-domain": "this work has been dedicated to the public domain",
}
THRESHOLD = 0.8


@dataclass(frozen=True)
class _Template:
    label: str
    words: tuple[str, ...]  # rarest first
    need: int

    @property
    def prefix(self) -> tuple[str, ...]:
        return self.words[: len(self.words) - self.need + 1]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _GAP + "+"), lambda w: w != "")


def word_frequencies(docs: DataFrame, words: list[str]) -> DataFrame:
    """word, n_docs over all documents: one row for each of the given words at most."""
    texts = docs.select(F.split(F.lower(F.col("text").cast("string")), _GAP + "+").alias("w"))
    held = F.array_intersect("w", F.array(*map(F.lit, words)))
    return texts.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs"))


def prepared(docs: DataFrame, templates: dict[str, str], threshold: float) -> list[_Template]:
    """The templates with their words in the global order. The driver sees one count for each template word."""
    sets = {label: sorted(set(t.split())) for label, t in templates.items()}
    every = sorted({w for ws in sets.values() for w in ws})
    counts = dict(map(tuple, word_frequencies(docs, every).collect())) if every else {}
    place = {w: i for i, w in enumerate(sorted(every, key=lambda w: (counts.get(w, 0), w)))}
    return [_Template(label, tuple(sorted(ws, key=place.get)), math.ceil(threshold * len(ws) - 1e-9)) for label, ws in sorted(sets.items())]


def _containment(line: Column, templates: list[_Template]) -> Column:
    """For a line, an array of the containment in each template, -1 where a filter or the threshold rules it out."""
    place: dict[str, int] = {}
    for t in templates:
        place |= dict.fromkeys(t.words, 0)
    # one order for all templates: merge of their orders, which agree
    order = _merged([t.words for t in templates])

    def scores(held: Column) -> Column:  # the line's template words, rarest first
        each = []
        for t in templates:
            own, n = F.array(*map(F.lit, t.words)), len(t.words)
            first = F.array_position(own, F.get(F.array_intersect(held, own), 0)).cast("int") - 1  # of the first word in common
            at = F.array_position(held, F.get(own, first)).cast("int") - 1
            long_enough = F.size(held) >= t.need
            in_prefix = F.arrays_overlap(F.array(*map(F.lit, t.prefix)), held)
            enough_left = F.least(n - first, F.size(held) - at) >= t.need
            share = F.size(F.array_intersect(held, own))
            each.append(F.when(long_enough & in_prefix & enough_left & (share >= t.need), share / F.lit(float(n))).otherwise(F.lit(-1.0)))
        return F.array(*each)

    words = F.split(ascii_lower(line), _GAP + "+")
    return let(words, lambda w: let(F.array_intersect(F.array(*map(F.lit, order)), w), scores))


def _merged(orders: list[tuple[str, ...]]) -> list[str]:
    """The common order of all words, from orders that agree with one another."""
    after: dict[str, set[str]] = {}
    for o in orders:
        for i, w in enumerate(o):
            after.setdefault(w, set()).update(o[i + 1 :])
    out: list[str] = []
    while after:
        free = min(w for w in after if not any(w in later for later in after.values()))
        out.append(free)
        del after[free]
    return out


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and blocks (line number, label, containment)."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    ready = prepared(docs, templates, threshold)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    coarse = "(?i)" + "|".join((_GAP_ANY_CASE + "+").join(p.split()) for p in phrases)
    none = F.expr("cast(array() as array<string>)")
    rows = rows.select(
        "doc_id",
        "text",
        F.regexp_count("text", F.lit(_WORD_ANY_CASE + "+")).cast("long").alias("n_words"),
        F.when(F.col("text").rlike(coarse), _words(ascii_lower(F.col("text")))).otherwise(none).alias("words"),
    )

    def places(phrase: str) -> Column:
        p = phrase.split()

        def here(i: Column) -> Column:
            test = F.get(F.col("words"), i) == p[0]
            for k, w in enumerate(p[1:], 1):
                test = test & (F.get(F.col("words"), i + k) == w)
            return test

        n = F.size("words")
        return F.when(n >= len(p), F.filter(F.sequence(F.lit(0), n - len(p)), here)).otherwise(F.expr("cast(array() as array<int>)"))

    labels = sorted(set(phrases.values()))
    rows = rows.select("*", *[places(p).alias(f"at_{i}") for i, p in enumerate(phrases)]).drop("words")
    found = {label: F.lit(False) for label in labels}
    for i, label in enumerate(phrases.values()):
        found[label] = found[label] | (F.size(f"at_{i}") > 0)
    starts = F.concat(*[F.col(f"at_{i}") for i in range(len(phrases))])
    # blocks: the lines with a word of some template's prefix
    anchor = "(?i)" + "|".join(sorted({w for t in ready for w in t.prefix}))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    lines = F.filter(lines, lambda s: s.x.rlike(anchor))
    lines = F.when(F.col("text").rlike(anchor), F.transform(lines, lambda s: F.struct(s.line.alias("line"), _containment(s.x, ready).alias("c"))))
    rows = rows.select("doc_id", "n_words", starts.alias("starts"), F.array_compact(F.array(*[F.when(found[x], F.lit(x)) for x in labels])).alias("base"), lines.alias("lines"))
    names = F.array(*[F.lit(t.label) for t in ready])
    hits = F.flatten(F.transform("lines", lambda s: F.transform(F.filter(F.arrays_zip(names.alias("label"), s.c.alias("share")), lambda z: z.share >= 0), lambda z: F.struct(s.line.alias("line"), z.label.alias("label"), z.share.alias("share")))))
    empty = F.expr("cast(array() as array<struct<line:int,label:string,share:double>>)")
    rows = rows.withColumn("blocks", F.coalesce(hits, empty)).drop("lines")
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b.share)), F.lit(0.0))
    every = F.array_sort(F.array_union("base", F.transform("blocks", lambda b: b.label)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"),
        "blocks",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents")).drop("blocks")


QUERIES = {"op4_license_scan": op4_license_scan}


def _oracle() -> str:
    sets = {label: sorted(set(t.split())) for label, t in TEMPLATES.items()}
    rows = ", ".join(f"('{label}', {ws!r}, {math.ceil(THRESHOLD * len(ws) - 1e-9)})" for label, ws in sets.items())
    phrase_rows = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    gap = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH t(label, words, need) AS (VALUES {rows}), ph(p, label) AS (VALUES {phrase_rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {low} AS x, regexp_extract_all({low}, '{gap}') AS w FROM documents),
s AS (SELECT rid, label, unnest(list_filter(range(0, len(w)), lambda i: w[i+1:i+len(p)] = p)) AS pos FROM d, ph),
b AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, list(DISTINCT label) AS ls FROM s GROUP BY rid),
l AS (SELECT rid, unnest(string_split(x, chr(10))) AS line FROM d),
c AS (SELECT rid, label, len(list_intersect(words, regexp_extract_all(line, '{gap}'))) / len(words)::DOUBLE AS share, len(list_intersect(words, regexp_extract_all(line, '{gap}'))) AS n, need FROM l, t),
m AS (SELECT rid, max(share) AS share, list(DISTINCT label) AS ls FROM c WHERE n >= need GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(m.ls, [])))), ',') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)"""


ORACLE = {"op4_license_scan": _oracle()}
