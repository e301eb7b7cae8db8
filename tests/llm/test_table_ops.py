"""Operators that compare rows with each other, and the pipeline, against brute force."""

import importlib.util
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestone.llm")

from lodestone.llm import exact_dedup, mixing, ngram_join  # noqa: E402
from lodestone.llm.components import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, pairs, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in pairs], DOCS)


def corpus(seed=1, n=60):
    """Texts with exact and near copies, and a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    shared = text(30)
    out = []
    for i in range(n):
        t = text(rng.choice([0, 1, 2, 3, 10, 40, 120]))
        if rng.random() < 0.3:
            t = t + shared
        out.append((i, " ".join(t)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            u = list(t)
            for _ in range(rng.randint(0, max(0, len(u) // 8))):
                u[rng.randrange(len(u))] = rng.choice(words)
            out.append((len(out) + 1000, " ".join(u)))
    return out


def grams(text, n=3):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_pairs(pairs, theta):
    sets = [(i, grams(t)) for i, t in pairs if i is not None and t]
    out = {}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and i != j and len(a & b) >= theta * len(a | b) - 1e-12:
                out[min(i, j), max(i, j)] = len(a & b) / len(a | b)
    return out


def found_pairs(df):
    rows = df.collect()
    out = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("theta", [0.5, 0.8])
def test_pairs_equal_brute_force(spark, theta):
    pairs = corpus()
    got, want = found_pairs(ngram_join.similar_documents(make(spark, pairs), theta)), brute_pairs(pairs, theta)
    assert set(got) == set(want) and len(want) > 30 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_frequent_grams_and_cut_clusters(spark):
    """Hundreds of sets share their grams, so that combinations index them, and a cluster is verified in blocks."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    pairs = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randint(0, 12)):
            t[rng.randrange(60)] = f"x{rng.randrange(20)}"
        pairs.append((i, " ".join(t)))
    got = found_pairs(ngram_join.similar_documents(make(spark, pairs), 0.5, cell=20))
    assert set(got) == set(brute_pairs(pairs, 0.5)) and len(got) > 500


def test_pairs_with_odd_rows(spark):
    rows = [(1, "a b c d"), (2, "A b. c D"), (None, "a b c d"), (3, None), (4, ""), (5, "solo"), (6, "solo"), (1, "a b c d"), (7, "..."), (8, "z " * 120_000)]
    df = make(spark, rows).withColumn("hash", F.lit(1)).withColumn("cluster", F.lit("x"))
    assert found_pairs(ngram_join.similar_documents(df)) == {(1, 2): 1.0, (5, 6): 1.0}
    kept = ngram_join.representatives(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1, 3, 4, 5, 7, 8]
    assert ngram_join.similar_documents(df.where("false")).count() == 0


def brute_classes(pairs, theta):
    """doc_id: class and links."""
    links = brute_pairs(pairs, theta)
    low = {i: i for i, _ in pairs if i is not None}
    n = dict.fromkeys(low, 0)
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    for p in links:
        for i in p:
            n[i] += 1
    return {i: (low[i], n[i]) for i in low}


def found_classes(df):
    rows = df.collect()
    out = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("theta", "cell"), [(0.5, 2000), (0.5, 7), (0.8, 3)])
def test_classes_equal_brute_force(spark, theta, cell):
    pairs = corpus()
    got = found_classes(ngram_join.classes(make(spark, pairs), theta, cell=cell))
    assert got == brute_classes(pairs, theta) and len({c for c, n in got.values() if n}) > 10


def test_a_chain_of_links_is_one_class_and_copies_are_one_set(spark):
    """Windows that slide over a text chain into one class, though far ones share nothing; a text's copies each link with all others."""
    words = [f"w{i}" for i in range(400)]
    pairs = [(i, " ".join(words[5 * i : 5 * i + 40])) for i in range(70)] + [(1000 + i, " ".join(words[:40])) for i in range(50)]
    got = found_classes(ngram_join.classes(make(spark, pairs), 0.5, cell=10))
    assert got == brute_classes(pairs, 0.5) and {c for c, _ in got.values()} == {0} and got[1000][1] >= 50


def test_classes_of_odd_rows(spark):
    rows = [(1, "a b c d"), (2, "A b. c D"), (None, "a b c d"), (3, None), (4, ""), (5, "solo"), (6, "solo"), (1, "a b c d"), (7, "..."), (8, "z " * 120_000)]
    df = make(spark, rows).withColumn("hash", F.lit(1)).withColumn("cluster", F.lit("x")).withColumn("class_id", F.lit(0))
    assert found_classes(ngram_join.classes(df)) == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 0), 5: (5, 1), 6: (5, 1), 7: (7, 0), 8: (8, 0)}
    assert ngram_join.classes(df.where("false")).count() == 0


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_components(spark, local):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (9, 9), (3, 1)], "a long, b long")
    assert sorted((r["node"], r["component"]) for r in components(edges, local).collect()) == [(1, 1), (2, 1), (3, 1), (6, 6), (7, 6)]
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in components(path, local).collect()} == {0}
    assert components(edges.where("false"), local).count() == 0


# exact dedup (5)


def test_perfect_hash_round_trip():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    h = exact_dedup.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    again = exact_dedup.PerfectHash.load(*h.dump())
    assert (again.slots(keys) == h.slots(keys)).all()
    assert exact_dedup.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3


ODD = [(5, "same"), (2, "same"), (None, "same"), (2, "same"), (7, ""), (8, ""), (9, None), (10, None), (None, "only"), (3, "Same"), (4, "x" * 300_000), (6, "x" * 300_000)]


@pytest.mark.parametrize("shard", [1 << 17, 2])
def test_exact_dedup(spark, shard):
    df = make(spark, ODD).withColumn("digest", F.lit(1))
    kept = exact_dedup.kept(df, keys_per_shard=shard)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or 0), (r["text"] or "-")[:6]) for r in kept.collect()) == sorted([(2, "same"), (7, "-"), (9, "-"), (10, "-"), (0, "only"), (3, "Same"), (4, "xxxxxx")])
    assert exact_dedup.kept(df.where("false")).count() == 0


def test_history_removes_repeats_and_groups_the_rest(spark):
    history = exact_dedup.history_of(make(spark, [(1, "old"), (2, "older")]), 1)
    new = make(spark, [(10, "old"), (12, "fresh"), (11, "fresh"), (13, "older"), (14, "other")])
    assert sorted(r["doc_id"] for r in exact_dedup.kept(new, history).collect()) == [11, 14]


def test_earlier_sources_are_the_history(spark):
    """a (0cc1...) is an earlier source, b (92eb...) a later one, and so is none (d41d...)."""
    df = make(spark, [(5, "both"), (6, "both"), (9, "a only"), (9, "a only"), (None, "odd"), (7, None), (3, "twice")], "a")
    df = df.unionByName(make(spark, [(1, "both"), (2, "b only"), (4, "b only"), (5, "both"), (8, "odd"), (3, "twice")], "b")).unionByName(make(spark, [(0, "b only"), (11, "")], None))
    for shard in (1 << 17, 1):
        got = exact_dedup.kept(df, keys_per_shard=shard, old=exact_dedup.historic())
        assert sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["text"] or "", r["source"] or "") for r in got.collect()) == [(-1, "odd", "a"), (0, "b only", ""), (3, "twice", "a"), (5, "both", "a"), (7, "", "a"), (9, "a only", "a"), (11, "", "")]


# mixing (8)


def brute_mix(rows, weights, ratio, targets=None, other=0.0):
    """rows: doc_id, source, text."""
    import hashlib
    import math

    tokens = lambda t: len((t or "").split())
    by = defaultdict(list)
    for i, s, t in rows:
        if tokens(t):
            u = (int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            by[s].append((-math.log(u) / weights.get(i, mixing.UNKNOWN), i, tokens(t)))
    total = sum(n for x in by.values() for *_, n in x)
    out = []
    share = {s: 1.0 if targets is None else targets.get(s, other) for s in by}
    for s, x in by.items():
        budget, all_ = math.floor(total * ratio * share[s] / sum(share.values())), sum(n for *_, n in x)
        full, rest = divmod(budget, all_)
        at = 0
        for _, i, n in sorted(x):
            at += n
            out += [(i, s, e) for e in range(full + (at <= rest))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("ratio", [0.4, 1.0, 2.5])
def test_mix_equals_brute_force(spark, ratio):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), " ".join(["t"] * rng.randint(0, 9))) for i in range(200)] + [(500, "a", None)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, s, t in rows], DOCS)
    labels = spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(0, 200, 3)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    w = {i: mixing.TOXIC if i % 7 == 0 else mixing.GOOD if i % 2 else mixing.POOR for i in range(0, 200, 3)}
    got = mixing.mix(df, mixing.label_weights(labels), ratio=ratio, buckets=16)
    assert sorted(((r["doc_id"], r["source"], r["epoch"]) for r in got.collect()), key=repr) == brute_mix(rows, w, ratio)
    assert set(got.columns) == {*df.columns, "epoch"}
    targets = {"a": 0.5, None: 3.0}
    got = mixing.mix(df, mixing.label_weights(labels), ratio=ratio, buckets=16, targets=targets, other=1.5)
    assert sorted(((r["doc_id"], r["source"], r["epoch"]) for r in got.collect()), key=repr) == brute_mix(rows, w, ratio, targets, 1.5)
    of_column = mixing.mix(df.withColumn("n_chars", F.col("doc_id") % 5), F.col("n_chars") / 4, ratio=ratio, buckets=16)
    w = {i: max(i % 5 / 4, mixing.LEAST) for i, *_ in rows}
    assert sorted(((r["doc_id"], r["source"], r["epoch"]) for r in of_column.collect()), key=repr) == brute_mix(rows, w, ratio)


def test_mix_of_repeats_targets_and_nothing(spark):
    labels = mixing.label_weights(spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    df = make(spark, [(1, "a b"), (1, "a b"), (1, "a b"), (None, "c")]).withColumn("epoch", F.lit("old"))
    got = mixing.mix(df, labels)
    assert got.count() == 4 and {r["epoch"] for r in got.collect()} == {0}
    two = make(spark, [(1, "a b")], "x").unionByName(make(spark, [(2, "a b")], "y"))
    assert {r["source"] for r in mixing.mix(two, labels, targets={"x": 1.0}).collect()} == {"x"}
    assert mixing.mix(df.where("false"), labels).count() == 0


# the pipeline

_pipeline = importlib.util.find_spec("corpus_pipeline")


@pytest.mark.skipif(_pipeline is None, reason="no corpus_pipeline")
def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    good, bad = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(400):
        ok = i % 4 > 0
        rows.append((i, " ".join(rng.choice(good if ok else bad) for _ in range(50)), "en", rng.choice(["a", "b"]), 0))
        labels.append((i, int(ok), 0))
    item = "Which distant river carries amber ships home in spring? The long one does."
    rows += [(500, rows[1][1], "en", rows[1][3], 0), (501, rows[2][1].replace("good1 ", "good2 ", 1) + " good3", "en", "a", 0), (502, " ".join(rng.choice(good) for _ in range(40)) + " " + item, "en", "b", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert docs.columns == before.columns
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = {i for i, q, _ in labels if q}
    assert len(seen[0] & clean) >= 0.98 * len(clean) and len(seen[0] - clean - {500, 501, 502}) <= 4
    assert seen[0] - seen[1] == {500} and seen[1] - seen[2] == {501} and seen[2] - seen[3] == {502} and seen[4] <= seen[3]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, docs.collect()))
