"""Page texts of hosts some of whose runs only few pages share."""

import random

import numpy as np
import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import html_text  # noqa: E402

SCHEMA = "page_id long, url string, html string"


def brute(pages, n, share):
    out = {}
    wins = [{tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for _, t in pages]
    for k, (host, tokens) in enumerate(pages):
        own = [j for j, (h, _) in enumerate(pages) if h == host]
        gone = [False] * len(tokens)
        for i in range(len(tokens) - n + 1):
            on = [j for j in own if tuple(tokens[i : i + n]) in wins[j]]
            if len(on) > 1 and (len(on) >= html_text.support(len(own), share) or on[0] != k):
                gone[i : i + n] = [True] * n
        out[k] = " ".join(t for t, g in zip(tokens, gone) if not g)
    return out


@pytest.mark.parametrize("limit", [1 << 24, 10])
def test_runs_of_few_pages_stay_on_the_first(spark, limit):
    rng = random.Random(8)
    pages = [(rng.choice("ab"), [rng.choice("uvwx") for _ in range(rng.randint(0, 25))]) for _ in range(30)]
    df = spark.createDataFrame([(k, f"http://{h}.org/x", f"<p>{' '.join(t)}</p>") for k, (h, t) in enumerate(pages)], SCHEMA).coalesce(1)
    got = {r["page_id"]: r["text"] for r in html_text.page_texts(df, 3, limit, share=0.3).collect()}
    assert got == brute(pages, 3, 0.3) != brute(pages, 3, 0.0)


def test_the_registered_query_keeps_an_article_under_two_urls(spark, tmp_path):
    head = "Home News Sport Weather About Contact Imprint Privacy"
    article = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"http://h.org/{i}", f"<p>{head}</p><p>{article if i in (2, 4) else ' '.join(f'own{i}x{j}' for j in range(20))}</p>") for i in range(6)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.op4_page_texts(spark, str(tmp_path)).collect()}
    assert (got[2], got[4]) == (article, "") and all("News" not in t for t in got.values())


def test_codes_round_trip():
    rng = np.random.default_rng(4)
    for bits, n in ((1, 2), (9, 40), (34, 1000), (63, 3), (64, 5000), (12, 4096)):
        v = np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64) if bits < 64 else rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
        assert (html_text.decode(len(v), *html_text.encode(v, bits), bits) == v).all()


@pytest.mark.parametrize("spare", [-6, 7])
def test_a_hot_host_a_long_page_and_repeated_rows(spark, spare):
    """One host has most pages, one page most tokens; ids repeat, one is null; with few bits most suffixes are wrongly taken for repeated at first."""
    rng = random.Random(3)
    head = [f"nav{i}" for i in range(7)]
    pages = [("a" if k % 5 else "b", (head if k % 3 else []) + [f"w{rng.randrange(400)}" for _ in range(5000 if k == 7 else rng.randint(0, 60))]) for k in range(60)]
    pages += [pages[11], pages[11], pages[20]]
    ids = [None if k == 4 else k % 50 for k in range(len(pages))]
    rows = [(ids[k], f"http://{h}.org/{k}", f"<p>{' '.join(t)}</p>", k) for k, (h, t) in enumerate(pages)]
    df = spark.createDataFrame(rows, SCHEMA + ", _lds_row int").coalesce(1)
    for share in (0.0, 0.3):
        got = sorted((-1 if r["page_id"] is None else r["page_id"], r["text"]) for r in html_text.page_texts(df, 6, 200, share, spare).collect())
        want = brute(pages, 6, share)
        assert got == sorted((-1 if ids[k] is None else ids[k], want[k]) for k in want)


def test_no_pages_no_tokens(spark):
    assert html_text.page_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    got = html_text.page_texts(spark.createDataFrame([(1, None, None), (2, None, "<p></p>"), (3, "http://h.org", "a b")], SCHEMA)).collect()
    assert sorted((r["page_id"], r["text"], r["n_tokens"], r["n_removed"]) for r in got) == [(1, None, None, None), (2, "", 0, 0), (3, "a b", 2, 0)]
