"""Every registered query, and the pipeline, over tables with nulls in any column, empty and very long texts, ties, repeated rows and clashing columns, and over empty tables; licences against brute force."""

import importlib.util
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestone.llm")

from lodestone.llm import licences  # noqa: E402
from lodestone.llm.queries import QUERIES  # noqa: E402

KEY = "ghp_" + "a1B2" * 9
ITEM = "Which distant river carries amber ships home in spring? The long one does."
GPL = "released under the GNU General Public License version 3"
CLASH = {c: "'own'" for c in "licence position rule match item_id score probability digest n_copies epoch class_id n_links hash cluster batch part host words tokens _lds_row _lds_id".split()}


def tables(spark, path, empty=False):
    rng = random.Random(5)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(good if i % 3 else bad, 30), "en", rng.choice(["a", "b", "src0", None]), 0) for i in range(90)]
    docs += [(100, None, None, None, None), (101, "", "en", "a", 0), (None, "lonely words without an id", "en", "a", 0), (None, None, None, None, None), (102, "  \n\t ", None, "b", 0)]
    docs += [(103, f"token = \"{KEY}\" {GPL} {text(good, 20)}", "en", "a", 0)] * 2 + [(104, docs[1][1], "en", "b", 0), (105, docs[1][1] + " tail", "en", None, 0), (106, f"{text(good, 40)} {ITEM}", "en", "a", 0)]
    docs += [(107, text(good, 60_000), "en", "b", 0), (108, "x" * 300_000, "en", "b", 0)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, 1), (4, 1, None), (5, 1, 0), (5, 0, 1), (999, 1, 0)]
    bench = [(1, ITEM), (1, ITEM), (None, ITEM), (2, None), (3, "")]
    pages = [(1, "http://Shop.example.com/a", "<title>t</title><p>one two three</p>"), (1, "http://shop.example.com/a", "<p>one two three</p>"), (None, None, None), (2, "", ""), (3, "not a url", "<p>" + text(good, 20_000)), (4, "http://" + "x" * 200 + ".org/" + "y" * 5000, "<p>z</p>")]
    chat = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "assistant", "x"), (2, 1, "user", '[{"type":"text","text":"a"},{"type":"image","url":"u","width":10,"height":10}]'), (3, 1, "user", "y " * 60_000), (4, 5, "user", "")]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string"),
        ("pages", pages, "page_id long, url string, html string"), ("conversations", chat, "conv_id long, turn long, role string, text string"),
    ):
        df = spark.createDataFrame([] if empty else rows, schema)
        df = df.withColumns({c: F.expr(v) for c, v in CLASH.items() if c not in df.columns})
        df.coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return docs, pages, chat


def test_queries_over_odd_tables(spark, tmp_path):
    docs, pages, chat = tables(spark, str(tmp_path))
    got = {n: [r.asDict() for r in f(spark, str(tmp_path)).collect()] for n, f in QUERIES.items()}
    ids = {i for i, *_ in docs if i is not None}
    classes = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got["op1_ngram_join"]}
    assert set(classes) == ids and len(got["op1_ngram_join"]) == len(ids)
    assert classes[1] == classes[104] == classes[105] == (1, 2) and classes[100] == (100, 0)
    assert sorted((r["doc_id"], r["licence"]) for r in got["op2_licences"]) == [(103, "GPL-3.0")] * 2
    assert [(r["doc_id"], r["rule"]) for r in got["op3_secrets"] if r["match"] == KEY] == [(103, "github_token")] * 2
    assert len(got["op4_page_texts"]) == len(got["op10_url_filter"]) == len(pages) and not any(r["blocked"] for r in got["op10_url_filter"] if r["page_id"] is None)
    assert len(got["op5_exact_dedup"]) == len({t for _, t, *_ in docs if t is not None}) and sum(r["n_copies"] for r in got["op5_exact_dedup"]) == sum(t is not None for _, t, *_ in docs)
    assert {r["conv_id"] for r in got["op6_chat"]} == {i for i, *_ in chat} and len(got["op6_chat"]) == 5
    kept = {r["doc_id"] for r in got["op7_quality"]}
    assert len([i for i in range(90) if (i in kept) == (i % 3 > 0)]) >= 85
    drawn = {r["doc_id"] for r in got["op8_mix"]}
    assert drawn <= ids | {None} and not drawn & {100, 101, 102}
    assert sorted(((r["doc_id"], r["item_id"] or 0) for r in got["op9_decontaminate"])) == [(106, 0), (106, 1), (106, 1)]


def test_queries_over_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), True)
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no corpus_pipeline")
@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_over_odd_tables(spark, tmp_path, empty):
    import corpus_pipeline

    docs, *_ = tables(spark, str(tmp_path), empty)
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert set(rows.columns) == set(before.columns)  # epoch is among them
    left = {r["doc_id"] for r in rows.collect()}
    assert not left if empty else (left <= {i for i, *_ in docs} and not left & {100, 101, 102, 106} and len(left & {1, 104, 105}) <= 1 and len(left) > 20)


def brute_licences(text):
    """At every place of a text: the anchors that stand where the template has them, give or take DRIFT; then the phrases. Over words, without an index."""
    t = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", x.lower()) for _, x, _ in licences.TEMPLATES]
    df = Counter(w for x in t for w in set(x))
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
    at = lambda x, p: [i for i in range(len(x) - len(p) + 1) if x[i : i + len(p)] == p]
    found = set()
    for (name, _, phrases), x in zip(licences.TEMPLATES, t):
        idf = [math.log(1 + len(t) / df[v]) for v in x]
        phrases = [p.split() for p in phrases]
        spans = [range(at(x, p)[0], at(x, p)[0] + len(p)) for p in phrases]
        top = max(idf[i] for s in spans for i in s)
        anchors = sorted({i for s in spans for i in s if idf[i] >= licences.ANCHOR * top})
        least = licences.MINIMUM * max(sum(idf[i] for i in anchors if i in s) for s in spans) - 1e-9
        for place in range(-len(x), len(w)):
            near = [(i - p, p) for p in anchors for i in range(max(0, place + p), min(len(w), place + p + licences.DRIFT + 1)) if w[i] == x[p]]
            if not any(s == place for s, _ in near) or sum(idf[p] for p in {p for _, p in near}) < least:
                continue
            window = w[max(0, place) : max(s for s, _ in near) + len(x) + licences.DRIFT]
            if all(at(window, p) for p in phrases):
                found.add(name)
    return found


def test_licences_equal_brute_force():
    rng = random.Random(7)
    words = [v for _, x, _ in licences.TEMPLATES for v in x.split()] + [f"w{i}" for i in range(40)]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [filler(rng.randint(0, 120)) for _ in range(60)]
    for _, x, _ in licences.TEMPLATES:
        t = x.split()
        for _ in range(3):
            u = [v for v in t if rng.random() > 0.1]
            for _ in range(rng.randint(0, 2)):
                u.insert(rng.randrange(len(u) + 1), rng.choice(words))
            texts.append(f"{filler(rng.randint(0, 30))} {' '.join(u)} {filler(rng.randint(0, 30))}")
    got = [{name for name, *_ in found} for found in licences.Scanner(licences.build()).scan(pa.array(texts))]
    assert got == [brute_licences(t) for t in texts] and sum(map(bool, got)) > 20
