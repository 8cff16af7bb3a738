"""The corpus operators against brute force, on small tables with nulls, ties, repeats, empty and long texts."""

import collections
import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import attention_lm, byte_bpe, common, components, exact_dedup, jaccard_join, license_scan, lm_score, mixture, quality, toxicity, url_filter, word_ids
from cellweave.llm.common import window_hashes, word_hashes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, size int, token int"


def documents(spark, rows):
    """Documents with columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 1, 2, 3) for i, t, s in rows], SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    rows = [(i, t, f"s{i % 5}" if i % 7 else None) for i, t in enumerate(base)]
    for k in range(12):  # near copies in a chain
        words = base[3].split()
        for j in range(0, len(words), 30):
            words[(j + k) % len(words)] = f"x{k}"
        rows.append((100 + k, " ".join(words), "s1"))
    rows += [(200 + k, base[5].upper() if k % 2 else base[5] + " \n", "s2") for k in range(6)]
    rows += [(300, None, None), (301, "", "s0"), (302, " \t\n", "s0"), (303, "one two", "s3"), (304, "One  two", "s3"), (None, "a b c d e f g", "s4"), (305, prose(rng, 9000, 50), "s4")]
    rows += rows[:2]
    return documents(spark, rows)


def collected(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words_of(text):
    return (text or "").encode().split()


# shared hashes


def test_word_hashes_tell_words_apart():
    text = "The cat the CAT\tcat\x0bthe  dog é É".encode()
    h = word_hashes(text)
    w = text.lower().split()
    assert len(h) == len(w) and all((h[i] == h[j]) == (w[i] == w[j]) for i in range(len(w)) for j in range(len(w)))
    assert len(word_hashes(b"")) == 0 and len(window_hashes(h[:3], 5)) == 1 and len(window_hashes(h, 5)) == len(w) - 4


# toxicity


def test_nearest_examples_equal_brute_force():
    rng = np.random.default_rng(0)
    unit = np.where(rng.random((500, 40)) < 0.1, rng.uniform(1, 5, (500, 40)), 0)
    unit[400:] = unit[:100]  # ties
    unit /= 1 + np.linalg.norm(unit, axis=1, keepdims=True)
    ids = rng.permutation(500)
    index = toxicity.Index.of(ids, ids % 2, unit)
    queries = np.where(rng.random((30, 40)) < 0.15, rng.uniform(0, 1, (30, 40)), 0)
    places, sims = index.nearest(queries, 15)
    for q, at, got in zip(queries, places, sims):
        all_sims = unit @ q
        want = sorted(((-round(s, 12), i) for s, i in zip(all_sims.tolist(), ids.tolist()) if s > 0))[:15]
        assert [(-round(s, 12), int(index.ids[k])) for s, k in zip(got, at) if k >= 0] == want


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(160):
        w = [f"w{rng.randrange(30)}" for _ in range(25)] + ["vilest"] * rng.choice([0, 0, 1, 3])
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int("vilest" in w and rng.random() < 0.8)))
    rows += [(500, rows[3][1], "s"), (501, None, "s"), (502, "vilest " * 5000, "s"), (502, "vilest " * 5000, "s")]
    d, lab = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fitted(d, lab)
    terms = lambda t: collections.Counter(x for w in (t or "").encode().split() for x in toxicity.terms_of(w))
    n = len(rows)
    df = collections.Counter(x for _, t, _ in rows for x in terms(t))
    idf = lambda t: math.log((1 + n) / (1 + df[t])) + 1
    voc = model.weights.vocabulary

    def vector(text):
        c, w = terms(text), {x for x in (text or "").encode().split()}
        own = {t: (1 + math.log(k)) * idf(t) for t, k in c.items() if t in voc}
        rest = sum(((1 + math.log(c[x])) * (idf(x) if x in model.weights.words else model.weights.rare)) ** 2 for x in w if x not in voc)
        size = math.sqrt(sum(x * x for x in own.values()) + rest)
        return {t: x / size for t, x in own.items()}

    train, seen = [], set()
    for (i, t, _), (_, _, y) in zip(rows, labels):
        if zlib.crc32(str(i).encode()) % 3 != 1 and t not in seen:
            seen.add(t)
            train.append((i, vector(t), y))
    share = sum(y for _, _, y in train) / len(train)
    none = [y for _, v, y in train if not v]
    for r in toxicity.scored(d, model).collect():
        q = vector({i: t for i, t, _ in rows}[r.doc_id])
        near = sorted((-round(sum(x * v.get(t, 0) for t, x in q.items()), 12), i, y) for i, v, y in train)
        near = [x for x in near if x[0] < 0][: toxicity.NEIGHBOURS]
        if not q:
            assert r.score == pytest.approx(sum(none) / len(none)) and not r.evidence
            continue
        assert [e.doc_id for e in r.evidence] == [i for _, i, _ in near]
        total = -sum(s for s, _, _ in near)
        raw = (-sum(s * y for s, _, y in near) + 0.2 * share) / (total + 0.2)
        slope, offset = model.curve
        assert slope > 0 and r.score == pytest.approx(1 / (1 + math.exp(-(slope * math.log(raw / (1 - raw)) + offset))), abs=1e-9)


def test_calibration_follows_the_rate():
    rng = np.random.default_rng(5)
    votes = rng.uniform(0.01, 0.99, 20_000)
    labels = (rng.random(20_000) < votes**2).astype(float)
    got = toxicity._calibrated(votes, toxicity._logistic(votes, labels))
    for lo in np.arange(0.1, 0.9, 0.2):
        part = (got >= lo) & (got < lo + 0.2)
        assert abs(got[part].mean() - labels[part].mean()) < 0.06
    assert toxicity._logistic(votes, np.zeros(20_000)) == (1.0, 0.0)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    bad = ["vile", "awful", "nasty"]
    rows, labels = [], []
    for i in range(300):
        w = prose(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None, None), (901, "", None), (902, "VILE, awful; nasty!", None), (None, "nice", None)]
    d, lab = documents(spark, rows), spark.createDataFrame([*labels, (900, 1, None), (None, 0, 1), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(d, toxicity.fitted(d, lab)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in held) for i in range(300))
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[902].predicted == 1 and got[902].evidence and got[900].score == got[901].score < 0.7
    kept = toxicity.unoffensive(d, toxicity.fitted(d, lab))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert [r.score for r in toxicity.scored(d, toxicity.fitted(d, lab.limit(0))).select("score").distinct().collect()] == [0.0]
    assert toxicity.scored(d.limit(0), toxicity.fitted(d.limit(0), lab)).count() == 0


def test_a_rare_kind_of_toxicity_keeps_its_terms(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(1200):
        kind = "common" if i % 5 == 0 else "seldom" if i % 50 == 1 else None
        w = prose(rng, 40).split()
        if kind:
            w[rng.randrange(len(w))] = kind
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(kind is not None)))
    d, lab = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fitted(d, lab)
    assert b"common" in model.weights.vocabulary and b"seldom" in model.weights.vocabulary
    caught = {r.doc_id for r in toxicity.scored(d, model).filter("held_out AND predicted = 1").collect()}
    assert caught >= {i for i in range(1, 1200, 50) if zlib.crc32(str(i).encode()) % 3 == 1}


# near copies


def brute_components(rows):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        sets[n] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        least.setdefault(find(n), []).append(i)
    return [(i, len(sets[n]), min((x for x in least[find(n)] if x is not None), default=None)) for n, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("group", "overlap"), [(64, 16), (2, 1), (3, 4)])
def test_jaccard_components_equal_brute_force(docs, monkeypatch, group, overlap):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "OVERLAP", overlap)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()), key=str)
    assert got == sorted(brute_components(collected(docs)), key=str)


def test_large_family_of_near_copies(spark):
    rng = random.Random(3)
    base = prose(rng, 80, 10_000).split()
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    d = documents(spark, rows)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(d).collect()), key=str)
    assert got == sorted(brute_components(collected(d)), key=str)


def test_ids_that_clash_are_replaced(docs):
    sets = jaccard_join._profiles(docs).filter("fp IS NOT NULL").groupBy("fp").agg(F.min("sid").alias("sid")).withColumn("sid", F.pmod("sid", F.lit(5)))
    new = jaccard_join._own_ids(sets)
    assert len(new) == sets.count() and len(set(new.values())) == len(new)


def test_one_of_each(docs):
    kept = jaccard_join.one_of_each(docs)
    want = {i for i, _, c in brute_components(collected(docs)) if i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert jaccard_join.jaccard_components(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (None, 3), (7, None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{1000 + i: 1000 for i in range(60)}}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


# urls


def test_block_decisions_reach_aliases(spark):
    link = '<html><head><link href="{}" rel="canonical"></head></html>'
    move = "<meta http-equiv=refresh content='0; url={}'>"
    pages = [
        (1, "http://shop.org/x", link.format("https://bad.net/es/1")),
        (2, "http://Shop.org/y", move.format("/x")),
        (3, "http://fine.org/", link.format("http://a.com/")),
        (4, "http://mix.org/", link.format("http://fine.org/")),
        (5, "http://mix.org/#top", link.format("https://bad.net/fr/2")),
        (6, "https://bad.net/es/1", None),
        (7, "https://www.example.com/en/3?q", ""),
        (8, "https://m.example.com/en/3", ""),
        (9, None, "canonical"),
        (10, "no scheme", link.format("http://bad.net/es/")),
        (11, "http://other.org/%s" % ("z" * 5000), "<p>refresh</p>"),
        (12, "http://NET/es/", None),
        (12, "http://NET/es/", None),
    ]
    df = spark.createDataFrame([(*p, "h", "v") for p in pages], "page_id bigint, url string, html string, host string, verdict string")
    got = sorted((r.page_id, r.verdict, r.rule) for r in url_filter.judged(df).collect() if r.page_id)
    want = {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "allow", 12: "block"}
    assert {i: v for i, v, _ in got} == want and len(got) == len(pages)
    assert {i: r for i, _, r in got}[7] == "www.example.com/en/" and {i: r for i, _, r in got}[12] == "net/es/" and {i: r for i, _, r in got}[1] is None
    assert url_filter.judged(df.limit(0)).count() == 0 and url_filter.judged(df.drop("html")).count() == len(pages)
    more = spark.createDataFrame([("http://free.org/", "http://bad.net/es/9")], "a string, b string")
    free = spark.createDataFrame([(1, "http://free.org/")], "page_id bigint, url string")
    assert url_filter.judged(free, more).first().verdict == "block"


# licenses


def test_license_blocks_meet_the_threshold(spark):
    rows = [
        (1, "hello\nReleased under the MIT License.\nbye", "s"),
        (2, "x cc-by 4 CC BY, cc\nby xcc by", "s"),
        (3, "Licensed, in part, under Apache: license version 2.0", "s"),
        (4, None, "s"),
        (5, "", "s"),
        (6, "word " * 30000 + "all rights\treserved", "s"),
        (7, "K license mit released", "s"),
        (1, "hello\nReleased under the MIT License.\nbye", "s"),
    ]
    got = {r.doc_id: r for r in license_scan.scanned(documents(spark, rows)).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].n_base, got[1].score) == ("mit", "", 0, 1.0) and got[1].blocks[0].line == 1
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 1, 6, "cc-by")
    assert "apache-2.0" in got[3].labels and 0.8 <= got[3].score < 1
    assert got[4].n_words == got[5].n_words == 0 and got[4].score == 0 and got[4].first_word is None
    assert got[6].n_words == 30003 and got[6].first_word == 30000 and got[6].labels == "reserved"
    for label, text in license_scan.TEMPLATES.items():  # brute force over blocks
        need = math.ceil(0.8 * len(set(text.split())) - 1e-9)
        for i in (1, 3, 7):
            t = dict((a, b) for a, b, _ in rows)[i]
            best = max(len(set(text.split()) & {w.decode(errors="ignore") for w in _license_words(line)}) for line in t.split("\n"))
            assert (label in got[i].labels.split(",")) == (best >= need)
    assert license_scan.scanned(documents(spark, []).limit(0)).count() == 0


def _license_words(line):
    keep = bytes(x + 32 if 65 <= x < 91 else x if 48 <= x < 58 or 97 <= x < 123 or x > 127 else 32 for x in range(256))
    return line.encode().translate(keep).split(b" ")


# mixing


def test_mix_meets_targets(docs):
    rows = mixture.mix(docs).collect()
    assert len(rows) == docs.count()
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in rows:
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(r.source_size == size[r.source] for r in rows)
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and 3 * size[s] < level * weight[s]}
        if not more:
            break
        full |= more
    for s in order:
        assert target[s] == pytest.approx(3 * size[s] if s in full else level * weight[s]) and abs(taken[s] - target[s]) <= 1
    assert sorted(map(str, mixture.mix(docs.repartition(7)).collect())) == sorted(map(str, rows))
    assert mixture.mix(docs.limit(0)).count() == 0


def test_mixed_documents_are_whole(docs):
    one = docs.dropDuplicates(["doc_id"])
    out = mixture.mixed(one)
    want = {}
    for r in mixture.mix(one).collect():
        times = r.repeats + int(r.size > 0 and 2 * r.partial >= r.size)
        if times:
            want[r.doc_id] = times
    texts = dict(collected(one))
    got = collections.Counter()
    for i, t in collected(out):
        assert t == texts[i]
        got[i] += 1
    assert out.columns == docs.columns and dict(got) == want and mixture.mixed(docs.limit(0)).count() == 0


# stored tables


def test_few_rows_go_to_few_files(spark, monkeypatch):
    monkeypatch.setattr(common, "FILE_ROWS", 40)
    df = spark.range(0, 100, 1, 20)
    files = [len(common.stored(df, rows=n).inputFiles()) for n in (None, 100, 10, 0)]
    assert files[0] >= 20 and files[1:] == [3, 1, 1]
    few = spark.createDataFrame([(i, i + 1) for i in range(90)], "a long, b long")
    assert {r.component for r in components.components(few).collect()} == {0}


# memory of workers


def test_stored_gives_free_native_memory_of_the_driver_back(spark):
    jvm = spark._jvm
    status = pathlib.Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) / 1024
    common.stored(spark.range(3))
    before = resident()
    held = [jvm.java.util.zip.Deflater() for _ in range(3000)]  # each has more than 100 kB of native memory in small pieces
    full = resident()
    for i, x in enumerate(held):
        if i % 20:  # the others keep the ends of the arenas in use
            x.end()
    common.stored(spark.range(3))
    assert full - before > 200
    assert resident() - before < 0.5 * (full - before)


def test_lean_functions_give_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    kept = []

    def run(batches):
        for batch in batches:
            pieces = [bytearray(50_000) for _ in range(4000)]
            kept.extend(bytearray(2000) for _ in range(20))  # so that the heap's end stays in use
            yield batch
            del pieces

    before = resident()
    assert list(common.lean(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 60


# language model


def test_base_scores_equal_brute_force(docs, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 37)
    rows = collected(docs)
    out = lm_score.scored(docs, byte_bpe.default_ranks())
    tokens = [(i, words_of((t or "").encode().lower().decode()) + [None]) for i, t in rows]
    training = [w for i, w in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = collections.Counter(x for w in training for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for i, w in tokens)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out.collect())
    assert got == want
    assert all(r.score < 0 for r in out.collect()) and lm_score.scored(docs.limit(0), byte_bpe.default_ranks()).count() == 0


def test_words_of_texts_together_are_those_of_each():
    texts = ["One two", "", "  three\n", "\u00ff \u00ffx", "two", "\t"]
    together = lm_score.ended(b"".join(x.encode() + lm_score.MARK for x in texts))
    assert together.tolist() == [h for x in texts for h in [*word_hashes(x.encode()).tolist(), int(lm_score.END)]]


ODD_CHARS = [" ", " ", "\n", "\t", "\r", "\x0b", "\x0c", "\x00", "\x1c", "\x1f", *map(chr, (0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF)), "a", "B", "é", "1", "'s", "'", chr(0x2019), chr(0x1F600), chr(0x4E2D), "word"]


@pytest.mark.parametrize("pattern", [byte_bpe.GPT2_LIKE, r" ?\S+|\s"])
@pytest.mark.parametrize("most", [30, 1 << 20])
def test_ids_by_words_equal_the_library(monkeypatch, pattern, most):
    monkeypatch.setattr(word_ids, "MOST", most)  # of which few are forgotten again and again
    monkeypatch.setattr(word_ids, "HELD", 50)
    monkeypatch.setattr(word_ids, "SLOTS", 5 if most == 30 else 21)  # too few for some sixteen texts
    rng, ranks = np.random.default_rng(most), byte_bpe.default_ranks()
    usual = [" ".join(rng.choice(["The", "sea", "isn't", "x²", "10km", "\n\nline", "\tend ", "día"], rng.integers(0, 30))) for _ in range(300)]
    texts = [x.encode() for x in ("", " ", "\n", " a", "a ", *("".join(rng.choice(ODD_CHARS, rng.integers(0, 12))) for _ in range(1500)), *usual)]
    counted = [bool(x) for x in rng.integers(0, 2, len(texts))]
    library = word_ids.encoder(ranks, pattern)
    want = [[*library.encode_ordinary(x.decode().translate({i: i + 32 for i in range(65, 91)})), len(ranks)] for x in texts]
    known, got, words = word_ids.WordIds(ranks, pattern), [], collections.Counter()
    for at in range(0, len(texts), 100):
        got += [np.frombuffer(x, np.uint16).tolist() for x in known.encode(texts[at : at + 100], counted[at : at + 100])]
        if known.full or at + 100 >= len(texts):
            words.update(dict(zip(*(x.tolist() for x in known.take_words()))))
    assert got == want
    assert known.pieces.tolist() == np.bincount(np.concatenate([x for x, c in zip(want, counted) if c]), minlength=len(ranks) + 1).tolist()
    assert words == collections.Counter(h for x, c in zip(texts, counted) if c for h in [*word_hashes(x).tolist(), int(word_ids.END)])


def test_words_are_encoded_once_and_stay_known_to_the_worker(monkeypatch):
    ranks, texts, asked = byte_bpe.default_ranks(), [b"The sea and the stone and the sea." * 50] * 300, []
    plain = word_ids.WordIds._encoded
    monkeypatch.setattr(word_ids.WordIds, "_encoded", lambda self, text: asked.append(len(text)) or plain(self, text))
    word_ids.forget()
    got = []
    for _ in range(2):
        with word_ids.kept(ranks, byte_bpe.GPT2_LIKE) as known:
            got.append((known.encode(texts, [True] * 300), [x.tolist() for x in known.take_words()], known.pieces.tolist()))
    assert got[0] == got[1] and sum(asked) < 200
    with pytest.raises(KeyError), word_ids.kept(ranks, byte_bpe.GPT2_LIKE):
        raise KeyError
    assert not word_ids._KEPT


def test_white_space_outside_ascii_is_that_of_the_pattern():
    every = "".join(chr(i) for i in range(128, 0x110000) if not 0xD800 <= i < 0xE000)
    library = word_ids.encoder(byte_bpe.default_ranks(), r"\s")
    assert library.decode(library.encode_ordinary(every)) == "".join(word_ids._BLANK.findall(every)) != ""


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_finder_equals_a_search(n):
    rng = np.random.default_rng(n)
    near = np.uint64(77 << 50) + np.arange(50, dtype=np.uint64)  # in one bucket
    head = np.unique(np.concatenate((rng.integers(0, 2**64, n, dtype=np.uint64), near[: n // 20 : 2], np.array([0, 2**64 - 1][: n], np.uint64))))
    words = np.concatenate((head, rng.integers(0, 2**64, 3000, dtype=np.uint64), near, np.array([0, 1, 2**64 - 2, 2**64 - 1], np.uint64)))
    place, known = lm_score.finder(head)(words)
    assert known.tolist() == np.isin(words, head).tolist()
    assert not n or (head[place[known]] == words[known]).all()


def test_training_equals_plain_gradients():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 50, 40)
    of, _ = attention_lm.id_classes(counts, np.arange(40) % 2)
    xs, ys, _ = attention_lm.windows([rng.integers(0, 40, k) for k in (3, 40, 25, 16)], 39, 40)

    def loss(p):
        total = 0.0
        e, (q, k, v, s) = p["e"], np.split(p["w"], 4, axis=1)
        for x, y in zip(xs, ys):
            for i, target in enumerate(y):
                if target != 40:
                    at = attention_lm.CONTEXT + i
                    seen = [j for j in range(at + 1) if x[j] != 40]
                    a = np.exp([e[x[at]] @ q @ (e[x[j]] @ k) * attention_lm.WIDTH**-0.5 + p["r"][at - j] for j in seen])
                    z = ((a / a.sum()) @ (e[x[seen]] @ v) + e[x[at]] @ s) @ p["u"] + p["b"]
                    total += np.log(np.exp(z).sum()) - z[of[target]]
        return total / (ys != 40).sum()

    start = attention_lm.initial(counts, of)
    p = {name: x.copy() for name, x in start.items()}
    attention_lm.train(p, of, xs, ys, [np.arange(len(xs))])  # the first step of Adam goes by the sign of the gradient
    for name, x in start.items():
        for i in rng.integers(0, x.size, 6):
            both = []
            for by in (1e-4, -1e-4):
                moved = {n: w.astype(np.float64) for n, w in start.items()}
                moved[name].ravel()[i] += by
                both.append(loss(moved))
            slope = (both[0] - both[1]) / 2e-4
            if abs(slope) > 1e-5:
                assert abs((p[name] - x).ravel()[i] + attention_lm.RATE * np.sign(slope)) < 0.02 * attention_lm.RATE


def test_every_training_document_trains_the_weights(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 1500)
    monkeypatch.setattr(lm_score, "STEPS", 20)
    rng = np.random.default_rng(5)
    words = [" a", " of", " day", " sea", " stone", " river", " and"]
    texts = [(None if i == 3 else i, "".join(rng.choice(words, 12)) + (" last" if i % 50 == 0 else "")) for i in range(800)]
    turn = spark.createDataFrame([(i,) for i in range(800)], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) AS t").orderBy("t").collect()
    training = [r.doc_id for r in turn if zlib.crc32(str(r.doc_id).encode()) % 7 != 2 and r.doc_id != 3]
    ranks = byte_bpe.default_ranks()

    def weights(rows, parts=2):
        m = lm_score._model(lm_score._first_pass(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), ranks, byte_bpe.GPT2_LIKE), ranks)
        return np.concatenate((m.key.ravel(), m.out.ravel(), m.relative))

    base = weights(texts)
    assert np.isfinite(base).all() and (weights(texts[::-1], 5) == base).all()
    for odd in (training[0], training[-1], None):  # the same words in another order, so that no count changes
        other = [(i, "".join(f" {w}" for w in reversed(t.split())) if i == odd else t) for i, t in texts]
        assert (weights(other) != base).any()


def test_mean_of_packed_weights():
    p = attention_lm.initial(np.array([3, 4, 5]), np.array([0, 1, 0]))
    q = {name: x + np.float32(1) for name, x in p.items()}
    (at, n, v), (at2, n2, v2) = attention_lm.packed(p, np.array([1, 2, 0, 0])), attention_lm.packed(q, np.array([3, 0, 0, 0]))
    place = np.unique(np.append(at, at2))
    total = lambda a, b: np.array([a[at == i].sum(axis=0) + b[at2 == i].sum(axis=0) for i in place])
    got = attention_lm.mean(p, place, total(n, n2), total(v, v2))
    assert got["e"] - p["e"] == pytest.approx(np.array([0.75, 0, 0, 0])[:, None] * np.ones(attention_lm.WIDTH), abs=1e-4)
    assert all(got[x].shape == p[x].shape and got[x] - p[x] == pytest.approx(0.5, abs=1e-4) for x in p if x != "e")


def test_attention_of_repetitive_text_stays_finite():
    docs = [np.array([1] * 200 + [2], np.int32)] * 50
    m = attention_lm.trained(docs, np.array([1, 10000, 50]), np.zeros(3, np.int64), 2, steps=3000)
    for big in (m.out, m.key, m.query):
        big *= 1000
    assert np.isfinite(m.log10([*docs, np.array([0, 1, 0, 2], np.int32)])).all()


def test_attention_windows_equal_a_plain_model():
    rng = np.random.default_rng(0)
    counts, groups = rng.integers(1, 50, 31), rng.integers(0, 2, 31)
    docs = [np.append(rng.integers(0, 30, n), 30).astype(np.int32) for n in (0, 1, 15, 16, 17, 90)]
    m = attention_lm.trained(docs * 20, counts, groups, 30, steps=5)
    got = m.log10(docs)
    for x, g in zip(docs, got):
        seen, total = [30, *x[:-1].tolist()], 0.0
        for t, y in enumerate(x.tolist()):
            lo = (t // attention_lm.SCORED) * attention_lm.SCORED - attention_lm.CONTEXT
            ctx = list(range(max(lo, 0), t + 1))
            a = np.array([m.query[seen[t]] @ m.key[seen[j]] + m.relative[t - j] for j in ctx], float)
            a = np.exp(a - a.max())
            h = (a / a.sum()) @ np.array([m.value[seen[j]] for j in ctx], float) + m.skip[seen[t]]
            z = h @ m.out + m.out_bias
            total += z[m.of_class[y]] - np.log(np.exp(z).sum()) + m.in_class[y]
        assert g == pytest.approx(total / math.log(10), rel=1e-4)


def test_training_beats_unigrams_on_new_text():
    rng = np.random.default_rng(1)
    step = rng.permutation(40)

    def walk(n):
        x = [int(rng.integers(40))]
        for _ in range(n):
            x.append(int(step[x[-1]]) if rng.random() < 0.9 else int(rng.integers(40)))
        return np.array([*x, 40], np.int32)

    counts = np.full(41, 100)
    m = attention_lm.trained([walk(100) for _ in range(100)], counts, np.zeros(41, np.int64), 40, steps=200)
    new = [walk(100) for _ in range(10)]
    assert m.log10(new).sum() > 0.75 * sum(len(x) for x in new) * math.log10(1 / 41)


def test_probabilities_sum_to_one():
    m = attention_lm.trained([np.array([0, 1, 2, 3], np.int32)] * 5, np.array([5, 5, 5, 5]), np.zeros(4, np.int64), 3, steps=3)
    assert sum(10 ** m.log10([np.array([0, i], np.int32)])[0] for i in range(4)) == pytest.approx(10 ** m.log10([np.array([0], np.int32)])[0], rel=1e-4)


# subwords


def test_byte_bpe_equals_the_library(spark, docs, monkeypatch):
    import tiktoken

    monkeypatch.setattr(byte_bpe, "BLOCK", 3000)
    ranks = byte_bpe.default_ranks()
    enc = tiktoken.Encoding("t", pat_str=byte_bpe.GPT2_LIKE, mergeable_ranks=ranks, special_tokens={})
    odd = ["a" * 700, "".join(random.Random(2).choice("abcdef") for _ in range(3000)), "  \n\n x", "日本語テキスト²½ Ⅷ", "don't I'LL 'tis x  y\x85z", "🙂🙂" * 30, "\x1c\x1d a", "x" + " " * 300 + "y", "<|endoftext|>", "ﬁ́ №5"]
    d = docs.unionByName(documents(spark, [(5000 + i, t, "s") for i, t in enumerate(odd)]))
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in byte_bpe.encoded(d, ranks).collect())
    want = collections.Counter()
    for i, t in collected(d):
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)] += 1
    assert got == want
    assert byte_bpe.encoded(d.limit(0), ranks).count() == 0


def test_long_words_are_merged_in_little_time():
    import time

    import tiktoken

    ranks = byte_bpe.default_ranks()
    enc = tiktoken.Encoding("t", pat_str=byte_bpe.GPT2_LIKE, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH") for _ in range(1 << 20))
    began = time.time()
    ids = byte_bpe.heap_encode(word.encode(), ranks)
    assert time.time() - began < 60 and ids == enc.encode_ordinary(word)
    for w in ("a", "aa", "ab" * 40, "  ", "é" * 9, "the" * 30):
        assert byte_bpe.heap_encode(w.encode(), ranks) == enc._encode_single_piece(w.encode())


def test_every_piece_encodes_to_itself():
    ranks = byte_bpe.default_ranks()
    assert all(byte_bpe.heap_encode(p, ranks) == [r] for p, r in ranks.items())


# exact copies


@pytest.mark.parametrize("content_hash", [exact_dedup.blake128, lambda b: bytes([len(b) % 3])])
def test_exact_dedup_equals_brute_force(docs, content_hash):
    groups = collections.defaultdict(list)
    rows = collected(docs)
    body = lambda t: (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")
    for i, t in rows:
        groups[body(t)].append((-len(t or ""), i is None, i or 0, i))
    want = sorted(str((i, min(groups[body(t)])[3], len(groups[body(t)]), i == min(groups[body(t)])[3], hashlib.sha256(body(t)).hexdigest())) for i, t in rows)
    got = sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.exact_dedup(docs, content_hash).collect())
    assert got == want
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_deduplicated_keeps_one_of_each(docs):
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    bodies = [b"".join(words_of(t)) for _, t in collected(kept)]
    assert len(bodies) == len(set(bodies)) and set(bodies) == {b"".join(words_of(t)) for _, t in collected(docs)}


# quality


def test_quality_metrics_equal_brute_force(spark, docs):
    more = documents(spark, [(7000, "a b c d e f g h " * 6 + "end", "s"), (7001, "x\nx\n \ny\nx", "s"), (7002, "# * the of and to in " * 9, "s")])
    d = docs.unionByName(more)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judged(d).collect())
    want = collections.Counter()
    for i, t in collected(d):
        w = [x.decode() for x in words_of(t)]
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        windows = collections.defaultdict(list)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].append(k)
        hit = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), failed] += 1
    assert got == want
    verdicts = {r.doc_id: r.kept for r in quality.judged(d).collect()}
    assert not verdicts[7000] and not verdicts[300]
    assert quality.judged(d, ()).filter("kept").count() == quality.judged(d).filter("NOT base_failed").count()
    assert quality.judged(d.limit(0)).count() == 0
