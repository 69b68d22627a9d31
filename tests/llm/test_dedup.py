"""Suffix deduplication, the Jaccard join, components and the pipeline, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import components, decontaminate, jaccard, quality, registry, suffixdedup


def brute_spans(rows, depth=50):
    big, first = 2**63 - 1, {}
    key = lambda i: big if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - depth + 1):
            w = b[p : p + depth]
            first[w] = min(first.get(w, big), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if first[b[p : p + depth]] < key(i):
                gone[p : p + depth] = b"\1" * depth
        runs = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def digests(df, chunk):
    out = suffixdedup.dedup_spans(df, chunk)
    rows = out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long"), F.size("spans").cast("long"), F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.fixture(scope="module")
def overlapping():
    r = random.Random(3)
    base = ["".join(r.choice("ab é\n") for _ in range(400)) for _ in range(4)]
    rows = []
    for _ in range(100):
        s = "".join(r.choice("abcdefgh é\n") for _ in range(r.randint(0, 120)))
        for _ in range(r.randint(0, 3)):
            b, a = r.choice(base), r.randint(0, 300)
            s += b[a : a + r.randint(10, 120)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 5)))
        if r.random() < 0.1:
            s += "a" * r.randint(30, 200)
        rows.append((r.randint(0, 60) if r.random() < 0.9 else None, s))
    return [*rows, (3, None), (4, ""), (77, rows[5][1]), (78, rows[5][1]), (78, rows[5][1]), (79, "q" * 5000)]


@pytest.mark.parametrize("chunk", [1 << 20, 3000])
def test_spans_against_brute_force(spark, overlapping, chunk):
    df = spark.createDataFrame([(i, t, 1) for i, t in overlapping], "doc_id long, text string, chunk int")
    assert digests(df, chunk) == brute_spans(overlapping)


def test_op4_on_small_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in registry.QUERIES["op4_suffix_dedup"](spark, sf_dir).collect()), key=str) == brute_spans(docs)


def test_spans_of_nothing(spark):
    assert suffixdedup.dedup_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_radix_groups_are_equal_rows():
    r = np.random.default_rng(2)
    d = r.integers(0, 3, (500, 4)).astype(np.uint64)
    g = r.integers(0, 2, 500)
    got = suffixdedup.radix_groups(d, g)
    rows = [(int(g[i]), *d[i].tolist()) for i in range(500)]
    for i in range(500):
        for j in range(i):
            assert (got[i] == got[j]) == (rows[i] == rows[j])


def brute_classes(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), 2**63), i)
    return sorted(((i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


@pytest.fixture(scope="module")
def copies():
    r = random.Random(5)
    vocabulary = [f"W{i}" for i in range(300)]
    rows, doc = [], 0
    for size, members in ((3, 2), (6, 5), (8, 5), (12, 40), (40, 2), (40, 50), (120, 30), (300, 8), (120, 1), (200, 60)):
        base = [r.choice(vocabulary) for _ in range(size)]
        for _ in range(members):
            w = base[:]
            for _ in range(r.randint(0, max(1, size // 25))):
                w[r.randrange(size)] = r.choice(vocabulary)
            rows.append((doc, " ".join(w)))
            doc += 1
            if r.random() < 0.3:
                base = w  # chains
    rows += [(doc, None), (doc + 1, ""), (doc + 2, "a"), (doc + 3, "A"), (None, rows[3][1]), (0, rows[9][1]), (0, "zz yy xx"), (None, "only null"), (None, "only null")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent", "frequent"), [(4, 85, 256), (5, 80, 256), (4, 85, 2)])
def test_classes_against_brute_force(spark, copies, monkeypatch, n, percent, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    df = spark.createDataFrame([(i, t, 0) for i, t in copies], "doc_id long, text string, key int")
    assert sorted((tuple(r) for r in jaccard.similarity_classes(df, n, percent).collect()), key=str) == brute_classes(copies, n, percent)


def test_classes_of_groups_beyond_a_task(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard, "BUDGET", 4000)
    monkeypatch.setattr(jaccard, "DRAWN", 3000)
    df = spark.createDataFrame(copies, "doc_id long, text string")
    assert sorted((tuple(r) for r in jaccard.similarity_classes(df, 4, 85).collect()), key=str) == brute_classes(copies, 4, 85)


def near_sets(seed, clusters=6, members=60):
    r = np.random.default_rng(seed)
    sets = []
    for _ in range(clusters):
        base = r.integers(0, 2**63, int(r.integers(20, 200)), dtype=np.uint64)
        for _ in range(members):
            own = base[r.random(len(base)) > r.choice([0.01, 0.05, 0.1])]
            sets.append(np.unique(np.concatenate([own, r.integers(0, 2**63, int(r.integers(0, 8)), dtype=np.uint64)])))
            if r.random() < 0.1:
                base = sets[-1]
    return sets


def brute_links(sets, percent):
    classes = jaccard.Classes(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                classes.join(np.array([i]), np.array([j]))
    return classes.of.tolist()


@pytest.mark.parametrize("direct", [4, 30, 192])
def test_voronoi_regions_find_all_links(monkeypatch, direct):
    monkeypatch.setattr(jaccard, "DIRECT", direct)
    for seed in range(3):
        sets = near_sets(seed)
        assert jaccard.Space(sets, 85).links().tolist() == brute_links(sets, 85)


def test_intersections_by_either_way():
    sets = near_sets(9, 3, 40)
    space, rows = jaccard.Space(sets, 85), np.arange(120)
    for pivots in (rows[:2], rows):
        got = space.both(pivots, rows)
        for k, p in enumerate(pivots):
            for j in rows:
                assert p == j or got[k, j] == len(np.intersect1d(sets[p], sets[j]))


@pytest.mark.parametrize(("small", "pairs"), [(32, 1 << 20), (4, 1 << 20), (4, 8)])
def test_region_groups_hold_all_that_agree(monkeypatch, small, pairs):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    r = np.random.default_rng(4)
    for most in (2, 5, 8):
        base = r.integers(0, 6, (5, 12)).astype(np.uint8)
        x = np.where(r.random((150, 12)) < 0.3, r.integers(0, 6, (150, 12)), base[r.integers(0, 5, 150)]).astype(np.uint8)
        least = -(-most * 185 // 30)  # so that two such sets may differ in `most` shingles
        size, key, rid = r.integers(least, least + 2, 150), np.arange(150) - 70, np.sort(r.integers(0, 3, 150)).astype(np.uint64)
        brute = jaccard.Classes(150)
        for i in range(150):
            for j in range(i):
                if rid[i] == rid[j] and 100 * min(size[i], size[j]) >= 85 * max(size[i], size[j]) and (x[i] != x[j]).sum() <= (size[i] + size[j]) * 15 // 185:
                    brute.join(np.array([i]), np.array([j]))
        got = jaccard.Classes(150)
        node, least = jaccard.region_groups(rid, key, size, x, 12 - int((2 * size.max()) * 15 // 185), 85)
        got.join(node + 70, least + 70)
        for i in np.flatnonzero(brute.of != np.arange(150)).tolist():
            assert got.of[i] == got.of[brute.of[i]]


def test_rows_without_an_id_stay_linear(spark):
    r = random.Random(7)
    rows = []
    for k in range(500):
        base = [f"w{r.randint(0, 5000)}" for _ in range(40)]
        for _ in range(2):
            rows.append((None if k % 2 else 7, " ".join([*base, f"x{len(rows)}"])))
    rows += [(None, rows[1][1])] * 300
    join = jaccard.Join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    texts = join.fetched(join.groups())
    assert texts.count() == texts.select("key").distinct().count() <= 1000
    assert sorted((tuple(x) for x in join.classes().collect()), key=str) == brute_classes(rows, 4, 85)


def test_no_classes(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similarity_classes(df).count() == 0


def test_op9_on_small_tables(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in registry.QUERIES["op9_jaccard_join"](spark, sf_dir).collect()), key=str) == brute_classes(docs, 4, 85)


def test_regions_meet_every_link():
    r = np.random.default_rng(6)
    for _ in range(60):
        n = int(r.integers(7, 400))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = a.copy()
        for _ in range(200):
            c = np.unique(np.concatenate([np.delete(b, r.integers(0, len(b))), r.integers(0, 2**63, int(r.integers(0, 2)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, c))
            if 100 * both < 85 * (len(a) + len(c) - both):
                break
            b = c
        rid, who = jaccard.regions(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 85)
        assert (a.tolist() == b.tolist()) or set(rid[who == 0].tolist()) & set(rid[who == 1].tolist())


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randint(-300, 300), r.randint(-300, 300)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1200)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in list(up)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "benchmark_decontamination", "pii_pseudonyms", "vector_packing"]
    stage = dict(corpus_pipeline.STAGES)
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.quality_verdicts(docs, forest).where("kept").collect()}
    one = stage["quality_rules"](spark, docs, sf_dir).cache()
    assert one.columns == names and {r.doc_id for r in one.collect()} == good
    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = stage["jaccard_join"](spark, one, sf_dir).cache()
    assert two.columns == names and {r.doc_id for r in two.collect()} == {c for _, _, c in brute_classes(rows, 5, 80)}
    three = stage["benchmark_decontamination"](spark, two, sf_dir).cache()
    report = decontaminate.leak_report(two, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()
    assert three.columns == names and {r.doc_id for r in three.collect()} == {r.doc_id for r in report if not r.contaminated}
    clean = {r.doc_id for r in report if not r.n_hit}
    text = {r.doc_id: r.text for r in two.collect()}
    assert all(r.text == text[r.doc_id] for r in three.collect() if r.doc_id in clean)
    four = stage["pii_pseudonyms"](spark, three, sf_dir).cache()
    assert four.columns == names and four.count() == three.count()
    assert all(r.n_chars == len(r.text) for r in four.collect())
    five = stage["vector_packing"](spark, four, sf_dir)
    assert five.select("doc_id").distinct().count() == four.count()


def test_pipeline_edges(spark, sf_dir):
    body = " ".join(f"word{i % 97} other{i % 89} third{i}" for i in range(60))
    rows = [(1, body, "en", "s", 1, 7), (1, body, "en", "s", 1, 7), (None, body, None, None, None, 8), (2, None, None, None, None, 9), (3, "", "", "", 0, 1), (None, "few words", None, None, None, None), (None, "few words", None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long")
    kept = corpus_pipeline.jaccard_join(spark, df, sf_dir)
    got = collections.Counter(r.doc_id for r in kept.collect())
    assert kept.columns == df.columns and got == {1: 1, 2: 1, 3: 1, None: 1}
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, df, sf_dir).count()
        assert stage(spark, df.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
