"""What is stored: collections by version, word indexes, graphs, inverted files; and what watches keep in step."""

import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.errors import FeatureNotAvailable, IncompatibleVersion
from lodestone.functions.embed import BagEmbedder, HashEmbedder, OnnxEmbedder, pooled
from lodestone.functions.text import tokens, tokens_of
from lodestone.operators import base, bm25, fusion, hnsw, ivfpq, search, sml
from lodestone.schema import Document
from lodestone.sources.collection import Collection, Config
from lodestone.sources.files import skipped, text_files
from lodestone.sources.versions import Versions
from lodestone.streaming.watch import Reindexer, Watcher

TEXTS = ["part time job part time", "time to find a part", "full time position", "", "Part-time: PART time!", "a b a b a", "b a"]


def texts(spark, rows=TEXTS):
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def ids(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def test_readers_keep_their_version_and_a_failure_changes_nothing(spark, tmp_path, monkeypatch):
    c = Collection(spark, str(tmp_path / "c"))
    c.insert([Document("a", "1"), Document("b", "2")])
    held = c.documents()
    c.insert([Document("c", "3")])
    c.delete(["a"])
    c.update([Document("b", "new")])
    assert ids(held) == ["a", "b"] and ids(c.documents()) == ["c", "b"]
    files = lambda: sorted(p.name for p in (tmp_path / "c" / "parts").iterdir())
    before = files()
    c.insert([Document("d", "4")])
    assert set(before) < set(files()) and len(files()) == len(before) + 1  # an insert writes its own part alone
    monkeypatch.setattr(Versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        c.replace(spark.createDataFrame([("d",)], "id string"), [Document("e", "5")])
    monkeypatch.undo()
    assert ids(c.documents()) == ids(Collection(spark, str(tmp_path / "c")).documents()) == ["c", "b", "d"]
    c.vacuum(0)
    assert ids(c.documents()) == ["c", "b", "d"] and len(files()) < len(before) + 3
    c.overwrite([Document("z", "9")])
    assert ids(c.documents()) == ["z"]


@pytest.mark.parametrize("index", ["hnsw", "ivf_pq"])
def test_indexes_are_built_once_for_a_version(spark, tmp_path, monkeypatch, index):
    docs = [Document(f"d{i}", f"word{i} common", [math.cos(i * 0.2), math.sin(i * 0.2)] + [0.0] * 6) for i in range(40)]
    config = Config(index, ivf_pq=ivfpq.Config(4, 8, 4))
    c = Collection(spark, str(tmp_path / index), config)
    c.insert(docs)
    query = docs[7].embedding
    first = [r["id"] for r in c.search(query, 3).collect()]
    assert first[0] == "d7"
    for kind in (hnsw.Hnsw, ivfpq.IvfPq):
        monkeypatch.setattr(kind, "build", None)
    again = Collection(spark, str(tmp_path / index), config)
    assert [r["id"] for r in again.search(query, 3).collect()] == first
    if index == "hnsw":
        assert "FlatMapGroups" not in again.search(query, 3)._jdf.queryExecution().toString()
    found = again.hybrid_search(query, "word9", 3, "production")
    assert {r["id"] for r in found.collect()} >= {"d7", "d9"}


def test_hybrid_counts_the_last_row_of_an_id(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"))
    c.insert([Document("a", "old words", [1.0, 0.0]), Document("b", "other", [0.0, 1.0])])
    c.insert([Document("a", "fresh words", [0.9, 0.1])])
    assert sorted(r["text"] for r in c.hybrid_search([1.0, 0.0], "words", 5).collect()) == ["fresh words", "other"]


def test_stored_word_index_equals_the_texts(spark, tmp_path):
    docs = texts(spark)
    plain, stored = bm25.Bm25(docs), bm25.Bm25(docs).save(str(tmp_path / "w"))
    asked = ['"part time"', '"time part"', '"a b a"', '"b a b a"', '"part"', "part time", "a a b", "", "nothing"]
    rows = lambda x, q: [(r["doc_id"], round(r["score"], 9)) for r in x.search(q, 10).collect()]
    for q in asked:
        assert rows(plain, q) == rows(stored, q)
    assert {i for i, _ in rows(stored, '"part time"')} == {0, 4} and {i for i, _ in rows(stored, '"time part"')} == {4}
    p = {(r["term"], r["doc_id"]): r["positions"] for r in bm25.postings(docs).collect()}
    assert p["part", 0] == [0, 3] and p["b", 5] == [1, 3] and ("part", 2) not in p
    assert {r["term"]: r["df"] for r in bm25.vocabulary(docs).collect()}["time"] == 4
    batch = lambda x: sorted((r["query_id"], r["doc_id"], round(r["score"], 9)) for r in x.search_batch(docs.select(F.col("id").alias("query_id"), "text")).collect())
    assert batch(plain) == batch(stored) and len(batch(plain)) > 5


def test_word_index_cache(spark, tmp_path):
    path = str(tmp_path / "w")
    bm25.Bm25.cached(path, texts(spark))
    first = Versions(spark, path).current()
    bm25.Bm25.cached(path, texts(spark))
    assert Versions(spark, path).current() == first  # as many documents: kept
    assert bm25.Bm25.cached(path, texts(spark, [*TEXTS, "zebra"])).search("zebra", 1).first()["doc_id"] == 7
    now = Versions(spark, path).current()
    for f in (tmp_path / "w" / now.rsplit("/", 1)[-1] / "statistics").iterdir():
        f.unlink()
    assert bm25.Bm25.cached(path, texts(spark)).search('"full time"', 1).first()["doc_id"] == 2
    with pytest.raises(FileNotFoundError):
        bm25.Bm25.load(str(tmp_path / "none"), texts(spark))


def test_tokens_keep_the_marks_of_letters(spark):
    for text in ("हिन्दी भाषा", "Hello, World! Rust-is-safe.", "x_y ½ n°1 d’été"):
        assert list(spark.range(1).select(tokens(F.lit(text))).first()[0]) == tokens_of(text)
    assert tokens_of("भाषा") == ["भाषा"] and tokens_of("Hello, World! Rust-is-safe.") == ["hello", "world", "rust", "is", "safe"]


def vectors(spark, n=200, step=0.0314159, dim=8):
    rows = [(i, [math.cos(i * step), math.sin(i * step)] + [0.0] * (dim - 2)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_graph_over_codes(spark, tmp_path):
    e = vectors(spark)
    config = hnsw.Config(8, 50, 20, codes=True, shard_rows=120)
    index = hnsw.Hnsw.build(e, config).save(str(tmp_path / "g"))
    asked = e.withColumnRenamed("id", "query_id")
    exact = search.batch_knn(asked, e, 10)
    assert search.recall(index.search_batch(asked, 10), exact, 10).agg(F.avg("recall")).first()[0] >= 0.85
    again = hnsw.Hnsw.load(str(tmp_path / "g"), e, config)
    best = again.search([math.cos(0.31), math.sin(0.31)] + [0.0] * 6, 3).collect()
    assert {r["doc_id"] for r in best} <= set(range(7, 13)) and best[0]["score"] == pytest.approx(1.0, abs=1e-3)
    far = hnsw.Graph(np.array([[1.0, 1.0], [1000.0, 1000.0]]), hnsw.Config(metric="euclidean", codes=True))
    assert [n for _, n in far.search(np.array([1.0, 1.0]), 2)] == [0, 1]


def test_inverted_file_log(spark, tmp_path):
    e, path = vectors(spark), str(tmp_path / "i")
    index = ivfpq.IvfPq.build(e, ivfpq.Config(8, 8, 8)).save(path)
    assert index.config == ivfpq.Config(8, 8, 8) and index.codes.count() == 200
    more = e.where("id < 5").select((F.col("id") + 1000).alias("id"), F.col("embedding").alias("v"))
    ivfpq.IvfPq.append(path, ivfpq.encode(more, index.quantizer), spark.createDataFrame([(3,), (4,), (999,)], "id long"))
    again = ivfpq.IvfPq.load(path, e)
    live = {r["id"] for r in again.codes.where("live").collect()}
    assert live == set(range(200)) - {3, 4} | {1000, 1001, 1002, 1003, 1004} and again.dead_ratio() > 0
    assert [r["id"] for r in again.search([1.0] + [0.0] * 7, 300).collect() if r["id"] in (3, 4)] == []
    assert not ivfpq.IvfPq.compact_log(spark, path, 0.9) and ivfpq.IvfPq.compact_log(spark, path, 0.01)
    small = ivfpq.IvfPq.load(path, e)
    assert small.codes.count() == 203 and {r["id"] for r in small.codes.collect()} == live
    (tmp_path / "log.jsonl").write_text('{"id":"a","cluster":1,"code":[1,255]}\n{"id":"b","cluster":0,"code":[0,2]}\nnot json\n{"id":"a","cluster":2,"code":[7,8]}\n{"id":"b","cluster":0,"code":[],"d":1}\n{"cluster":1}\n')
    log, bad = ivfpq.read_jsonl_log(spark, str(tmp_path / "log.jsonl"))
    assert bad == 2 and sorted((r["id"], bytes(r["code"]), r["live"], r["cid"]) for r in log.collect()) == [("a", b"\x07\x08", True, 2), ("b", b"", False, 0)]


def test_inverted_file_counts_what_was_encoded_since_its_training(spark):
    e = vectors(spark, 100)
    index = ivfpq.IvfPq.build(e, ivfpq.Config(4, 8, 4, rebuild_threshold=0.2, batch_rebuild_size=50))
    new = lambda lo, n: e.where(f"id < {n}").select((F.col("id") + lo).alias("id"), "embedding")
    a = index.insert(new(1000, 12))
    b = a.insert(new(2000, 10))
    assert a.stale == 12 and b.stale == 22 and a.quantizer is b.quantizer is index.quantizer
    assert b.insert(new(3000, 10)).stale == 0 and index.insert(new(4000, 60)).quantizer is not index.quantizer


def test_what_an_index_lacks_is_refused(spark, tmp_path):
    class Own(base.Index):
        def search(self, query, k):
            return None

        def search_filtered(self, query, k, where):
            return None

        def delete(self, ids):
            return self

    with pytest.raises(FeatureNotAvailable):
        Own().save("x")
    with pytest.raises(FeatureNotAvailable):
        Own.load("x", None)
    (tmp_path / "other").mkdir()
    with pytest.raises(IncompatibleVersion):
        Collection(spark, str(tmp_path / "other")).documents()


def test_cross_encoders_and_models(spark, tmp_path):
    class Shared(base.CrossEncoder):
        """Shared words."""

        def scores(self, query, texts):
            return [float(len(set(query.split()) & set(t.split()))) for t in texts]

    rows = spark.createDataFrame([(0, "a b c", 0.9), (1, "x y", 0.8), (2, "b y x", 0.7)], "id long, text string, score double")
    got = fusion.CrossReranker(Shared()).scored("x y b", rows).orderBy(F.desc("rerank_score"), "id").collect()
    assert [(r["id"], r["rerank_score"]) for r in got] == [(2, 3.0), (1, 2.0), (0, 1.0)]
    assert {r["id"]: round(r["rerank_score"], 3) for r in fusion.length_scores(rows).collect()} == {0: 0.3, 1: 0.58, 2: 0.3}
    v = pooled(np.array([[[3.0, 0.0], [0.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert v[0] == pytest.approx([0.6, 0.8])
    for kind in (fusion.OnnxCrossEncoder, OnnxEmbedder):
        model = kind(str(tmp_path / "no.onnx"), str(tmp_path / "no.json"))
        with pytest.raises(Exception):  # noqa: B017, PT011 no model is there
            model.scores("q", ["t"]) if kind is fusion.OnnxCrossEncoder else model.embed_batch(["t"])
    assert HashEmbedder(8).embed("x") == list(spark.createDataFrame([("x",)], "t string").select(HashEmbedder(8).column(F.col("t"))).first()[0])


def test_keywords_and_their_cosines():
    assert [len(sml.KEYWORDS[k]) for k in ("flow", "query", "invariant", "type")] == [26, 20, 18, 16]
    s = sml.keyword_cosine(np.array([[1.0, 0.0, 5.0], [0.0, 0.0, 1.0]]), np.array([1.0, 0.0]))
    assert s.tolist() == [1.0, 0.0]


def tree(root):
    root.mkdir()
    (root / "a.md").write_text("alpha words")
    (root / "b.md").write_text("beta words")
    (root / "blank.md").write_text(" \n\t\n")
    (root / "x.png").write_bytes(b"\x89PNG")


def wait_for(true, seconds=60):
    end = time.time() + seconds
    while not true():
        assert time.time() < end
        time.sleep(0.3)


def test_a_running_watch_sees_new_changed_and_removed_files(spark, tmp_path):
    tree(tmp_path / "t")
    c, seen = Collection(spark, str(tmp_path / "c")), []
    q = Watcher(spark, str(tmp_path / "t"), c, ("md",), on_event=seen.append).start(str(tmp_path / "k"), 0.2, deletions=0.5)
    try:
        wait_for(lambda: len(c) == 2)
        (tmp_path / "t" / "c.md").write_text("gamma words")
        wait_for(lambda: len(c) == 3)
        (tmp_path / "t" / "a.md").unlink()
        wait_for(lambda: any(e.kind == "deleted" and e.path == "a.md" for e in seen))
        assert sorted(r["text"] for r in c.documents().collect()) == ["beta words", "gamma words"]
    finally:
        q.stop()
    wait_for(lambda: any(e.kind == "stopped" for e in seen))


def test_a_reindexing_watch_replaces_everything(spark, tmp_path):
    tree(tmp_path / "t")
    c, seen = Collection(spark, str(tmp_path / "c")), []
    w = Reindexer(spark, str(tmp_path / "t"), c, ("md",), BagEmbedder(16), seen.append)
    run = lambda: w.start(str(tmp_path / "k"), None)
    run()
    assert len(c) == 2 and seen[-1].kind == "updated" and c.documents().where(F.size("embedding") == 16).count() == 2
    (tmp_path / "t" / "a.md").unlink()
    run()
    assert [r["text"] for r in c.documents().collect()] == ["beta words"]
    (tmp_path / "t" / "b.md").write_text("")
    assert w.reindex() == 0 and len(c) == 1


def test_directory_commands(spark, tmp_path, capsys):
    tree(tmp_path / "t")
    assert skipped(spark, str(tmp_path / "t")) == 2 and text_files(spark, str(tmp_path / "t")).count() == 2
    path = str(tmp_path / "c")
    cli.main([path, "rag-ingest", str(tmp_path / "t"), "--extensions", "md,png", "--hash", "--dim", "16"], spark)
    cli.main([path, "rag-query", "alpha", "--hash", "--dim", "16", "--hybrid", "-k", "1"], spark)
    cli.main([path, "rag-info"], spark)
    cli.main([str(tmp_path / "w"), "rag-watch", str(tmp_path / "t"), "--once", "--hash"], spark)
    out = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert out[0] == {"chunks": 2, "skipped": 2} and out[1][0]["text"] == "alpha words" and out[2]["dimension"] == 16 and out[-1] == {"chunks": 2} and out[3]["kind"] == "updated"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_where_texts_lie(spark, monkeypatch):
    monkeypatch.setattr(bm25, "WORDS", 5)  # several slices
    docs = texts(spark, [*TEXTS, None])
    assert "Exchange" not in plan_of(bm25.postings(docs))
    got = {(r["term"], r["doc_id"]): (r["positions"], r["tf"]) for r in bm25.postings(docs).collect()}
    want = {}
    for i, t in enumerate(TEXTS):
        for at, w in enumerate(tokens_of(t)):
            want.setdefault((w, i), []).append(at)
    assert got == {key: (at, len(at)) for key, at in want.items()}
    twice = docs.union(spark.createDataFrame([(0, "time part")], "id long, text string"))
    got = {(r["term"], r["doc_id"]): (r["positions"], r["tf"]) for r in bm25.postings(twice).collect()}
    assert got["part", 0] == ([0, 1, 3], 3) and got["time", 0] == ([0, 1, 4], 3) and got["job", 0] == ([2], 1) and len(got) == len(want)


@pytest.mark.parametrize("extra", [[], [(0, "time part part"), (3, "full")]])  # ids with several texts
def test_batch_search_scores_documents_where_they_lie(spark, tmp_path, monkeypatch, extra):
    rows = list(enumerate([*TEXTS, "time " * 3, "zebra", "part time job part time", "zebra a"])) + extra
    docs = spark.createDataFrame(rows, "id long, text string")
    asked = [(7, "part time zebra"), (8, "zebra zebra a"), (9, "nothing"), (10, None), (7, "full time")]
    q = spark.createDataFrame(asked, "query_id long, text string")
    tf, of, total = {}, {}, 0
    for i, t in rows:
        of.setdefault(i, []).append(len(tokens_of(t)))
        total += of[i][-1]
        for w in tokens_of(t):
            tf[w, i] = tf.get((w, i), 0) + 1
    want = {}
    for k, t in asked:
        for w in tokens_of(t or ""):
            df = sum(x == w for x, _ in tf)
            idf = math.log((len(rows) - df + 0.5) / (df + 0.5)) + 1
            for (x, i), n in tf.items():
                if x == w and idf > 0:
                    want[k, i] = want.get((k, i), 0) + sum(idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * d / (total / len(rows)))) for d in of[i])
    monkeypatch.setattr(bm25, "SCORES", 9)  # documents in several parts
    for x in (bm25.Bm25(docs), bm25.Bm25(docs).save(str(tmp_path / "w"))):
        found = x.search_batch(q)
        assert {(r["query_id"], r["doc_id"]): r["score"] for r in found.collect()} == pytest.approx(want)
        assert "SortMergeJoin" not in plan_of(found)
        best = lambda df: sorted((r["query_id"], r["doc_id"], r["rank"]) for r in search.ranked(df.withColumn("score", F.round("score", 9)), 2).collect())
        assert best(x.search_batch(q, k=2)) == best(found) and len(best(found)) == 4
