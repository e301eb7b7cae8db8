import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.errors import InvalidConfig
from lodestone.functions.embed import BagEmbedder, HashEmbedder
from lodestone.functions.text import tokens, tokens_of
from lodestone.operators import chunking as C
from lodestone.operators import fusion, sml
from lodestone.operators.bm25 import Bm25, term_counts

CATS = [(0, "the cat sat on the mat"), (1, "the dog chased the cat"), (2, "the bird flew away")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def hits(df):
    return [(r["doc_id"], round(r["score"], 6)) for r in df.collect()]


def test_bm25_golden(spark):
    b = Bm25(docs(spark, CATS))
    assert hits(b.search("cat", 5)) == [(1, 0.489174), (0, 0.452178)]
    assert hits(b.search("cat cat", 5)) == [(1, 0.978349), (0, 0.904356)]
    assert hits(b.search("the", 5)) == [] == hits(b.search("  ", 5)) and hits(b.search("bird", 5)) == [(2, 1.645454)]
    stored = Bm25(docs(spark, CATS), counts=term_counts(docs(spark, CATS)))
    assert hits(stored.search("cat", 5)) == hits(b.search("cat", 5))
    assert hits(Bm25(docs(spark, [])).search("cat", 5)) == [] and len(b) == 3
    batch = b.search_batch(spark.createDataFrame([(7, "cat bird")], "query_id long, text string")).orderBy(F.desc("score")).collect()
    assert [r["doc_id"] for r in batch] == [2, 1, 0]


def test_phrases(spark):
    b = Bm25(docs(spark, [(0, "part time job"), (1, "time to find a part"), (2, "full time position"), (3, None), (4, "")]))
    assert [d for d, _ in hits(b.search('"part time"', 5))] == [0] and hits(b.search('"time part"', 5)) == []
    assert [d for d, _ in hits(b.search('"part"', 5))] == [d for d, _ in hits(b.search("part", 5))]
    assert hits(b.search('""', 5)) == []


def test_tokens(spark):
    text = "Salt, Pepper! Sugar-and-spice. Été 42"
    assert docs(spark, [(0, text)]).select(tokens(F.col("text"))).first()[0] == tokens_of(text) == ["salt", "pepper", "sugar", "and", "spice", "été", "42"]


def test_rrf(spark):
    ranked = lambda ids: spark.createDataFrame([(i, float(-k)) for k, i in enumerate(ids)], "doc_id long, score double")
    assert hits(fusion.rrf([ranked([0, 1, 2]), ranked([1, 3])], 10)) == [(1, 0.032522), (0, 0.016393), (3, 0.016129), (2, 0.015873)]
    assert hits(fusion.rrf([ranked([]), ranked([])], 10)) == [] and len(hits(fusion.rrf([ranked([5, 5])], 10))) == 1


def test_hybrid(spark):
    df = spark.createDataFrame([(0, "fn chunk_batch does parallel chunking", [1.0, 0.0]), (1, "fn bake_cake makes a delicious cake", [0.0, 1.0])], "id long, text string, embedding array<float>")
    for profile in fusion.PROFILES:
        assert fusion.hybrid(df, [1.0, 0.0], "chunk_batch", 1, profile).first()["id"] == 0
    ranked = fusion.hybrid(df, [0.0, 1.0], "cake", 2, "production", fusion.LengthReranker()).collect()
    assert [r["id"] for r in ranked] == [1, 0] and all(0.3 <= r["rerank_score"] <= 1 for r in ranked)
    assert fusion.hybrid(df.where("false"), [1.0, 0.0], "x", 3, "maxspeed").count() == 0


def test_splitter():
    assert C.split_text("") == [""] and C.split_text("abc") == ["abc"]
    text = "a" * 20 + "\n\n" + "b" * 20
    assert C.split_text(text, 30, 0) == ["a" * 20 + "\n\n", "b" * 20]
    assert "".join(C.split_text("é" * 50, 7, 0)) == "é" * 50
    assert all(len(c.encode()) <= 10 for c in C.split_text("x" * 95, 10, 4))
    with pytest.raises(InvalidConfig):
        C.split_text("abc", 0)


def test_windows_fall_between_characters():
    chunks = C.fixed_windows("ñ" * 32, 10, 0)
    assert "".join(c.text for c in chunks) == "ñ" * 32 and all(c.text and len(c.text.encode()) <= 10 for c in chunks)
    assert [c.text for c in C.paragraphs("")] == [""]
    assert [c.text for c in C.paragraphs("aaaa\n\nbbbb\n\ncccc", 8, 0)] == ["aaaa\n\n", "bbbb\n\n", "cccc"]
    long = C.fixed_windows("word " * 500, 100, 20)
    assert all(a.start_line <= b.start_line for a, b in zip(long, long[1:]))


def test_code_chunks():
    c = C.code("use x;\nfn greet() {}\n\nfn run() { greet(); }")
    assert [x.structure for x in c] == ["greet", "run"] and (c[0].start_line, c[0].end_line) == (1, 3)
    assert C.code("use x;\nfn greet() {}", keep_preamble=True)[0].structure is None
    assert [x.structure for x in C.code("async def go():\n  pass\nclass A:\n  pass")] == ["go", "A"]
    assert [x.structure for x in C.code("export function f() {}\nclass B {}")] == ["f", "B"]
    assert [x.structure for x in C.code("func (s *T) Run() {}\ntype T struct {}")] == ["Run", "T"]
    assert len(C.code("fn big() {\n" + "x;\n" * 1000 + "}", 200)) > 5
    assert [C.strategy_of(p) for p in ("a.rs", "b.MD", "c.py", "noext", ".go")] == ["code", "fixed_window", "code", "fixed_window", "fixed_window"]


def test_semantic_chunks():
    text = "Cats purr. Cats purr loudly. Rockets burn fuel. Rockets burn more fuel."
    cut = C.semantic(text, BagEmbedder(256), 40)
    assert [c.text for c in cut] == ["Cats purr. Cats purr loudly. ", "Rockets burn fuel. Rockets burn more fuel."]
    assert C.semantic("One.", BagEmbedder(), 40)[0].text == "One."


def test_chunk_files(spark):
    files = spark.createDataFrame([("a.rs", "fn a() {}\nfn b() {}"), ("d/b.md", "text " * 600), ("c.py", "def x():\n  pass"), ("e.txt", ""), ("f.txt", None)], "path string, text string")
    rows = C.chunk_files(files).collect()
    assert len({r["id"] for r in rows}) == len(rows) >= 7 and all(r["metadata"]["source"] and r["metadata"]["language"] for r in rows)
    assert {r["id"] for r in rows} >= {"a-rs-0", "a-rs-1", "c-py-0", "e-txt-0"}
    split = C.split_documents(docs(spark, [(1, "x" * 1000)]), 512, 64).collect()
    assert [r["id"] for r in split] == ["1-0", "1-1", "1-2"]


def test_embedders(spark):
    e = BagEmbedder(64)
    assert e.embed("a b") == e.embed("A  b!") and e.embed("") == [0.0] * 64
    a, b = docs(spark, [(0, "x"), (1, "x")]).select(HashEmbedder(8).column(F.col("text"))).collect()
    assert a == b and len(a[0]) == 8 and all(0 <= x < 1 for x in a[0])
    col = docs(spark, [(0, "a b"), (1, None)]).select(e.column(F.col("text")).alias("v")).collect()
    assert [round(x, 5) for x in col[0]["v"]] == [round(x, 5) for x in e.embed("a b")] and not any(col[1]["v"])


def test_manifests(spark):
    assert str(sml.Type("Config")) == "type Config\n"
    full = sml.Type("UserAccount", "User identity entity", [sml.Attr("username", "str", True), sml.Attr("email", "str")], ["Profile"], [sml.Invariant("@role:ADMIN", "grant_full_access")])
    assert str(full).split("\n") == ["type UserAccount", '> "User identity entity"', "@username:str!", "@email:str", "*Profile", "! @role:ADMIN >> -> grant_full_access", ""]
    flow = sml.Flow("process_data", [sml.Attr("input", "", True), sml.Attr("config", "", optional=True)], [sml.Step(["validate", "transform"], "input.valid"), sml.Step(["store"])])
    assert str(flow) == "-> process_data(input!, config?) :\n   ? input.valid >> -> validate >> -> transform\n   -> store\n"
    c = sml.Compiler()
    rust = c.manifest("/// Who\npub struct UserAccount {\n    pub name: String,\n    age: u32,\n}\n", "user.rs")
    assert "type UserAccount" in rust and "@name:str" in rust and "@age:int" in rust and '> "Who"' in rust
    assert "DataProcessor" in c.manifest("class DataProcessor:\n    pass\n", "processor.py")
    assert c.manifest("  ", "x.rs") is None and c.manifest(None, None) is None
    assert [sml.map_type(t) for t in ("&'a str", "Vec<u8>", "Option<X>", "HashMap<a,b>", "Odd")] == ["str", "List", "T?", "Map", "Odd"]
    assert sml.name_of("pub struct A<T>") == "A" and sml.name_of("fn go(x)") == "go"
    df = spark.createDataFrame([("a.rs", "fn f(x: u8) {\n return x;\n}", {"k": "v"}), ("b", " ", {})], "id string, text string, metadata map<string,string>")
    got = {r["id"]: r["metadata"] for r in sml.enrich(df).collect()}
    assert got["a.rs"]["sml"] == "-> f(x) :\n   -> x\n" and got["a.rs"]["k"] == "v" and "sml" not in got["b"]


def test_chunks_are_cut_a_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(C, "BYTES", 100)
    texts = ["", "a" * 90, "b" * 30 + "\n\n" + "c" * 80, None, "é" * 200, "d"] * 3
    b = pa.RecordBatch.from_pydict({"_text": pa.array(texts, pa.string())})
    pieces = list(C._pieces(b, "_text"))
    assert [t for p in pieces for t in p.column(0).to_pylist()] == texts and len(pieces) > 8
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= 100 for p in pieces)
    rows = [(None if i == 4 else i, t, {"k": str(i)}, None if i % 2 else [i]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string, m map<string,string>, a array<int>")
    found = C.split_documents(docs, 64, 8)
    assert found.columns == ["id", "text", "m", "a"] and found.schema["m"].dataType == docs.schema["m"].dataType
    want = [(f"{i}-{n}" if i is not None else str(n), c, m, a) for i, t, m, a in rows for n, c in enumerate(C.split_text(t or "", 64, 8))]
    assert sorted(map(str, ((r["id"], r["text"], r["m"], r["a"]) for r in found.collect()))) == sorted(map(str, want))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    files = docs.select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), "text").where("path is not null")
    got = C.chunk_files(files, 64, 8)
    assert got.count() == sum(len(C.fixed_windows(t or "", 64, 8)) for i, t, *_ in rows if i is not None)
