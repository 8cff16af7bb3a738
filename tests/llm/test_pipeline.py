"""The pipeline over a small table, stage by stage and as a whole."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellweave.llm import byte_bpe


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(5)
    top = tmp_path_factory.mktemp("sf")
    rows, labels = [], []
    for i in range(120):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(20, 80))]
        if i % 6 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vile", "awful"])
        rows.append((i, " ".join(words), "en", f"s{i % 4}"))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(200 + k, rows[1][1] + " " * k, "en", "s1") for k in range(3)] + [(300, rows[2][1] + " more", "en", "s2"), (301, "", "en", None), (302, None, None, "s3")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(spark.createDataFrame(stage(spark, seen[-1], sf_dir).collect(), docs.schema))
        assert seen[-1].columns == docs.columns
    ids = [collections.Counter(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    toxic = set(range(0, 120, 6))
    assert len(toxic & set(ids[1])) <= 3 and len(set(ids[0]) - toxic - set(ids[1])) <= 3
    assert set(ids[1]) - set(ids[2]) == ({1, 200, 201, 202} - {202}) | {302}
    assert set(ids[2]) - set(ids[3]) == {300}
    words = lambda d: d.agg(F.sum(F.size(F.filter(F.split("text", r"[ \t\n]+"), lambda w: w != "")))).first()[0]
    assert abs(words(seen[4]) - words(seen[3])) <= 4 * 80  # a document of each source at most


def test_run_encodes_what_is_left(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    pieces = {i: p for p, i in byte_bpe.default_ranks().items()}
    rows = out.collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    for r in rows:
        decoded = b"".join(pieces[i] for i in r.ids).decode()
        assert texts[r.doc_id] == decoded
