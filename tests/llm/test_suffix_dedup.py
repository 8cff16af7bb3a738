"""Repeated passages against brute force over all windows of words."""

import collections
import random

import pytest

from cellweave.llm import suffix_dedup

SCHEMA = "doc_id bigint, text string, core int, at string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def brute_force(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    seen = collections.defaultdict(set)
    for n, w in enumerate(words):
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(n)
    out = collections.Counter()
    for n, w in enumerate(words):
        hit = {k + j for k in range(len(w) - 49) if len(seen[tuple(w[k : k + 50])]) > 1 for j in range(50)}
        out.update((rows[n][0], k) for k in hit)
    return out


def found(spark, rows):
    out = collections.Counter()
    for r in suffix_dedup.repeated_passages(table(spark, rows)).collect():
        assert r.n_words == r.end_word - r.start_word >= 50
        out.update((r.doc_id, k) for k in range(r.start_word, r.end_word))
    return out


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_passages_equal_brute_force(spark):
    rng = random.Random(11)
    passage, other, short = prose(rng, 64), prose(rng, 50), prose(rng, 49)
    rows = [(i, " ".join(prose(rng, rng.randint(0, 60)) + (passage if i % 3 else short) + prose(rng, rng.randint(0, 60)))) for i in range(30)]
    rows += [(100, " ".join(other)), (101, "A b\n" + " ".join(other).upper() + "\tend"), (102, " ".join(other[:49])), (103, None), (104, ""), (None, " ".join(passage))]
    rows += [(200, " ".join(prose(rng, 60) * 3)), (201, " ".join(prose(rng, 5000) + other)), (202, "same " * 200)]
    rows += [(300, "x " * 120), (301, "x " * 75)]
    rows += rows[:1]
    assert found(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 20])
def test_a_core_with_many_contexts_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST", most)
    rng = random.Random(5)
    passage = prose(rng, 42)
    lefts, rights = ([prose(rng, 5) for _ in range(10)] for _ in range(2))
    rows = [(i, " ".join(prose(rng, 30) + rng.choice(lefts) + passage + rng.choice(rights) + prose(rng, 30))) for i in range(300)]
    rows += [(1000 + i, " ".join(prose(rng, i) + lefts[0] + passage + rights[0])) for i in range(3)]
    rows += [(2000 + i, " ".join(lefts[1] + passage + rights[1] + prose(rng, i))) for i in range(3)]
    assert found(spark, rows) == brute_force(rows)


def test_no_rows_no_passages(spark):
    assert not found(spark, [(1, "a b c"), (2, None)])
    assert suffix_dedup.repeated_passages(table(spark, [(1, "a")]).limit(0)).count() == 0
