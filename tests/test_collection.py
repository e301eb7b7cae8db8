import json
import struct

import pytest
from pyspark.sql import functions as F

from lodestone import cli, rag, tools
from lodestone.errors import IncompatibleVersion, InvalidConfig
from lodestone.functions.embed import BagEmbedder
from lodestone.schema import Document, completed
from lodestone.sources import binary
from lodestone.sources.collection import Collection, Config
from lodestone.sources.files import jsonl, text_files
from lodestone.streaming.watch import Watcher, event_counts

ABC = [Document("a", "one", [1.0, 0.0], {"lang": "en"}), Document("b", "two", [0.0, 1.0]), Document("c", "three", [0.5, 0.5])]


def ids(df):
    return [r["id"] for r in df.orderBy("pos").collect()]


def test_crud(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "notes.v"))
    assert c.is_empty() and c.name == "notes" and c.search([1.0, 0.0]).count() == 0
    c.insert(ABC)
    assert ids(c.documents()) == ["a", "b", "c"] and [r["id"] for r in c.search([0.9, 0.1], 2).collect()] == ["a", "c"]
    assert c.delete(["a", "c"]) == 2 and c.delete(["x"]) == 0 and ids(c.documents()) == ["b"]
    c.update([Document("b", "new", [1.0, 1.0]), Document("z", "last", [])])
    again = Collection(spark, str(tmp_path / "notes.v"))
    assert [(r["id"], r["text"]) for r in again.documents().orderBy("pos").collect()] == [("b", "new"), ("z", "last")]
    with pytest.raises(InvalidConfig):
        c.insert([Document("q", "", [1.0])])
    assert len(c) == 2
    c.export_jsonl(str(tmp_path / "out"))
    back = jsonl(spark, str(tmp_path / "out"))
    assert sorted(r["id"] for r in back.collect()) == ["b", "z"]
    (tmp_path / "other").mkdir()
    with pytest.raises(IncompatibleVersion):
        Collection(spark, str(tmp_path / "other")).documents()


def test_indexes_filters_and_text(spark, tmp_path):
    docs = [Document(f"d{i}", f"word{i} common", [float(i), 1.0] + [0.5] * 6, {"lang": "en" if i % 2 else "es"}) for i in range(30)]
    for index in ("bruteforce", "hnsw", "ivf_pq"):
        c = Collection(spark, str(tmp_path / index), Config(index))
        c.insert(docs)
        assert c.search([29.0, 1.0] + [0.5] * 6, 3).count() == 3
        only = c.search([29.0, 1.0] + [0.5] * 6, 3, F.col("metadata")["lang"] == "en").collect()
        assert only and all(r["metadata"]["lang"] == "en" for r in only)
    assert c.keyword_search("word7").first()["id"] == "d7" and c.hybrid_search([1.0] * 8, "word7", 3).count() == 3
    pure = Collection(spark, str(tmp_path / "pure"), Config(symbolic=True, manifest=True))
    pure.insert([Document("a.rs", "fn go() {}")])
    row = pure.documents().first()
    assert row["text"] == "" and "-> go" in row["metadata"]["sml"]


def test_missing_fields(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"text": "first", "id": "x"}\n{"embedding": [0.5], "text": "second", "id": "y"}\n')
    rows = {r["id"]: r for r in jsonl(spark, str(tmp_path / "x.jsonl")).collect()}
    assert rows["x"]["embedding"] == [] and rows["x"]["metadata"] == {} and rows["y"]["embedding"] == [0.5]
    assert completed(spark.createDataFrame([(None,)], "id string")).first()["text"] == ""


def test_binary_files(spark, tmp_path):
    path = str(tmp_path / "x.bin")
    binary.write(path, [("a", "é", [1.0, 2.0], {"k": "v"}), ("b", "", [], {})])
    assert binary.is_binary(path) and binary.header(path)[:2] == (2, 2)
    assert [r[:4] for r in binary.read(path)] == [("a", "é", [1.0, 2.0], {"k": "v"}), ("b", "", [0.0, 0.0], {})]
    binary.register(spark)
    assert spark.read.format("vectorfile").load(path).count() == 2
    assert spark.read.format("vectorfile").option("headerOnly", "true").load(path).first()["count"] == 2
    df = spark.createDataFrame([("q", "t", [3.0], {"a": "b"}, 0)], binary.SCHEMA)
    df.coalesce(1).write.format("vectorfile").mode("append").save(str(tmp_path / "dir"))
    assert spark.read.format("vectorfile").load(str(tmp_path / "dir")).first()["embedding"] == [3.0]
    raw = bytearray((tmp_path / "x.bin").read_bytes())
    (tmp_path / "short.bin").write_bytes(raw[:-4])
    with pytest.raises(EOFError):
        list(binary.read(str(tmp_path / "short.bin")))
    raw[4:8] = struct.pack("<I", 9)
    (tmp_path / "v9.bin").write_bytes(raw)
    with pytest.raises(IncompatibleVersion):
        binary.header(str(tmp_path / "v9.bin"))


def make_tree(root):
    (root / ".git").mkdir(parents=True)
    (root / "sub").mkdir()
    (root / "a.rs").write_text("fn alpha() {}\nfn beta() {}")
    (root / "sub" / "b.md").write_text("notes about alpha rockets")
    (root / "empty.md").write_text("  ")
    (root / ".git" / "c.md").write_text("hidden")
    (root / "x.png").write_bytes(b"\x89PNG")


def test_directories(spark, tmp_path):
    make_tree(tmp_path / "t")
    assert sorted(r["path"] for r in text_files(spark, str(tmp_path / "t"), ("rs", "md")).collect()) == ["a.rs", "sub/b.md"]
    c = Collection(spark, str(tmp_path / "c"))
    assert rag.ingest(c, str(tmp_path / "t"), embedder=BagEmbedder(64)) == 3
    assert rag.query(c, "alpha rockets", 1, embedder=BagEmbedder(64)).first()["metadata"]["source"] == "sub/b.md"
    assert rag.query(c, "rockets", 2, True, BagEmbedder(64)).first()["metadata"]["source"] == "sub/b.md"
    assert tools.info(c)["documents"] == 3


def test_watch(spark, tmp_path):
    make_tree(tmp_path / "t")
    c, seen = Collection(spark, str(tmp_path / "c")), []
    w = Watcher(spark, str(tmp_path / "t"), c, ("rs", "md"), on_event=seen.append)
    run = lambda: w.start(str(tmp_path / "ck"), None).awaitTermination()
    run()
    n = c.documents().where(F.col("metadata")["source"] == "a.rs").count()
    assert n == 2 and {e.kind for e in seen} == {"updated"}
    import os

    (tmp_path / "t" / "a.rs").write_text("fn gamma() {}")
    os.utime(tmp_path / "t" / "a.rs", (2e9, 2e9))
    w.upsert(text_files(spark, str(tmp_path / "t"), ("rs",)))
    assert [r["text"] for r in c.documents().where(F.col("metadata")["source"] == "a.rs").collect()] == ["fn gamma() {}"]
    (tmp_path / "t" / "a.rs").unlink()
    w.remove_missing()
    assert c.documents().where(F.col("metadata")["source"] == "a.rs").count() == 0 and seen[-1].kind == "deleted"


def test_event_windows_as_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.5D value union all select timestamp'2024-01-01 02:00:00', 'a', 2D")
    rows.write.parquet(str(tmp_path / "e"))
    batch = event_counts(rows).orderBy("start").collect()
    assert [r["n"] for r in batch] == [1, 1]
    q = event_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == 1  # the last window is still open


def test_cli_and_tools(spark, tmp_path, capsys):
    path = str(tmp_path / "c")
    assert cli.main([path, "ingest", "--text", "hello"], spark) == 0
    Collection(spark, path).insert([Document("v", "x" * 300, [1.0, 0.0])])
    cli.main([path, "query", "1,0", "-k", "1"], spark)
    cli.main([path, "list"], spark)
    cli.main([path, "info"], spark)
    cli.main([path, "export"], spark)
    cli.main([path, "delete", "v"], spark)
    out = [json.loads(x) for x in capsys.readouterr().out.strip().split("\n")]
    assert out[0] == {"total": 1} and out[1][0]["id"] == "v" and len(out[1][0]["text"]) == 200 and [d["id"] for d in out[2]] == ["doc-1", "v"] and out[3]["documents"] == 2 and out[-1] == {"deleted": 1}
    assert tools.ingest(Collection(spark, path), [{"id": "n"}]) == {"inserted": 1, "total": 2}
