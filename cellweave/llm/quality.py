"""Quality rules: a table of thresholds compiled into one projection; no user functions, no shuffle.

Defined results: a null text counts as empty; an empty text has no words and fails. A ratio over nothing is 0. Every row
gives a row, repeated ones too; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import SPACE, SPACE_CHARS, table

WINDOW = 8

#: The commonest function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in is that it for with as was on be by this are at or an",
    "de": "der die und das von den des mit ein zu ist im für auf nicht sich dem als auch es",
    "fr": "le la de et les des un une est pour que qui dans par sur au du en pas ne",
    "es": "el la de y los las un una es para que con por del al en se su no lo",
}


@dataclass(frozen=True)
class Rule:
    """A document stays only if low <= metric <= high."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Metrics are SQL over the columns that measured() makes.
RULES = (
    Rule("length", "n_words", 20, 1_000_000),
    Rule("word_length", "word_chars / greatest(n_words, 1)", 2.0, 20.0),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", None, 0.3),
    Rule("stop_words", "n_stop_words / greatest(n_words, 1)", 0.02, None),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", None, 0.3),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", None, 0.3),
)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also within lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort by hash, keep equal neighbours, add up the gaps."""

    def covered(s: Column) -> Column:
        hit = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1).h == x.h, F.lit(False)) | F.coalesce(F.get(s, k + 1).h == x.h, F.lit(False)))
        at = F.sort_array(F.transform(hit, lambda x: x.i))
        gaps = lambda p: F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW)))
        return let(at, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, x: a + x))

    def counted(w: Column) -> Column:
        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(F.sort_array(pairs), covered)).otherwise(F.lit(0))

    return let(windows, counted).cast("long")


def _windows(hashes: Column) -> Column:
    """Hashes of all runs of WINDOW words, from the words' hashes."""
    starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) >= WINDOW, runs).otherwise(F.expr("cast(array() as array<bigint>)"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the metrics of every row. Windows of words are compared by 64-bit hashes of their words' 64-bit hashes."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trimmed = F.btrim(F.col("text"), F.lit(SPACE_CHARS))
    words = F.when(F.length(trimmed) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(trimmed, f"[{SPACE}]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    one = text.select("doc_id", words.alias("words"), F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"))
    two = one.select(
        "doc_id",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
        # bound once even where a later filter moves these expressions below this projection
        let(F.transform("words", lambda w: F.xxhash64(w)), lambda h: _repeat_words(_windows(h))).alias("n_repeat_words"),
    )
    return two


def compiled(rules: tuple[Rule, ...]) -> Column:
    """All rules as one condition."""
    tests = [f"({r.metric}) {op} {limit}D" for r in rules for op, limit in ((">=", r.low), ("<=", r.high)) if limit is not None]
    return F.expr(" AND ".join(tests) or "true")


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the metrics, base_failed and kept for every row of docs."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured(docs).withColumn("base_failed", base).withColumn("kept", ~base & compiled(rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_rules": op10_quality_rules}


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    tests = [f"({r.metric}) {op} {limit}" for r in RULES for op, limit in ((">=", r.low), ("<=", r.high)) if limit is not None]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS l FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
c AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM g) WHERE n > 1),
r AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM c) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""


ORACLE = {"op10_quality_rules": _oracle()}
