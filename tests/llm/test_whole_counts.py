"""Counts of the whole corpus, whatever its vocabulary."""

import math
from collections import defaultdict
from itertools import product

import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import url_filter  # noqa: E402


def test_url_words_beyond_any_cap_are_counted(spark):
    words = ["q" + "".join(x) for x in product("abcdefghijklmnopqrstuvwxyz", repeat=4)][:210_000]
    pages = [(i, f"http://h.org/{i}", f"<title>{' '.join(2 * words[i::100])}</title>") for i in range(100)]
    pages.append((1000, "http://zworchardzwmeadow.net/zwa", "<title>zworchard zwmeadow</title>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert url_filter.scored(df).where("page_id = 1000").first()["host_words"] == "zworchard zwmeadow"


def bayes(rows):
    """Multinomial naive Bayes over (words, probability of bad), by dictionaries: the words' odds, the prior's."""
    n = [defaultdict(float), defaultdict(float)]
    for words, bad in rows:
        for w in words:
            n[0][w] += 1 - bad
            n[1][w] += bad
    a, v, total = url_filter.ALPHA, len({*n[0], *n[1]}) + 1, [sum(x.values()) for x in n]
    odds = {w: math.log((n[1][w] + a) / (total[1] + a * v)) - math.log((n[0][w] + a) / (total[0] + a * v)) for w in n[0]}
    return odds, math.log((sum(b for _, b in rows) + 1) / (sum(1 - b for _, b in rows) + 1))


def test_url_scores_equal_naive_bayes_over_all_words(spark):
    hosts = ["cheapcasino", "gardenschool", "casino-news", "x"]
    df = spark.createDataFrame([(i, f"http://{hosts[i % 4]}.example.com/p{'ab'[i % 2]}x/{'uvw'[i % 3]}", "") for i in range(30)] + [(99, None, None), (5, f"http://{hosts[1]}.example.com/pbx/w", "")], "page_id long, url string, html string")
    seeds = {1: ["casinocheap", "cheapbets"], 0: ["school", "gardennews"]}
    got = url_filter.scored(df, seeds=seeds).collect()
    words = [r["host_words"].split() + url_filter.path_words(r["url"] or "") for r in got]
    examples = [(x, k) for k, xs in ((1, [["casino", "cheap"], ["cheap", "bets"]]), (0, [["school"], ["garden", "news"]])) for x in xs]
    odds, _ = bayes(examples)
    first = math.log(url_filter.BAD_SHARE / (1 - url_filter.BAD_SHARE))
    guess = [1 / (1 + math.exp(-(first + sum(odds.get(w, 0) for w in ws)))) for ws in words]
    odds, prior = bayes([*zip(words, guess), *examples])
    assert len(got) == df.count()
    for r, ws in zip(got, words):
        assert r["score"] == pytest.approx(prior + sum(odds[w] for w in ws)) and r["blocked"] == (r["score"] > 0)
