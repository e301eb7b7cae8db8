"""Operators that look at one text at a time, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestone.llm")

from lodestone.llm import chat, decontaminate, html_text, licences, quality, secrets, url_filter  # noqa: E402


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# secrets (3)


@pytest.fixture(scope="module")
def automaton():
    return secrets.compile_rules(secrets.RULES)


def brute_secrets(text):
    raw = (text or "").encode()
    return sorted((k, m.start(), m.group().decode()) for k, p in enumerate(secrets.RULES.values()) for m in re.finditer(p.encode(), raw))


def test_secrets_equal_the_rules_themselves(automaton):
    rng = random.Random(5)
    bits = ["AIza", "xoxb-", "-", "a1b2c3d4", "0" * 9, "ghp_", "token = '", '"', "https://ab", ":", "abcd", "@", " ", "é", "AKIA", "Z" * 5, "sk_live_", "password:", "f" * 16, "-----BEGIN PRIVATE KEY-----", "xox"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 300))) for _ in range(200)] + ["", None, "word " * 60_000 + "AKIA" + "B" * 16]
    got = secrets.find(automaton, pa.array(texts))
    assert [sorted(g) for g in got] == [brute_secrets(t) for t in texts] and sum(map(len, got)) > 300


def test_secrets_of_a_table(spark):
    key = "AKIA" + "Q" * 16
    df = spark.createDataFrame([(1, f"a {key} b", "x"), (1, f"a {key} b", "x"), (None, key, "y"), (3, None, None), (4, "", "")], "doc_id long, text string, rule string")
    got = df.select("doc_id", F.explode(secrets.secrets(spark)(F.col("text"))).alias("s")).select("doc_id", "s.rule", "s.start")
    assert rows(got, "doc_id", "rule", "start") == rows(got.sparkSession.createDataFrame([(1, "aws_access_key", 2)] * 2 + [(None, "aws_access_key", 0)], got.schema), "doc_id", "rule", "start")


def test_rules_must_be_bounded():
    with pytest.raises(ValueError):
        secrets.compile_rules({"x": "a+"})


# licences (2)


def test_every_template_is_found_and_clean_text_is_not():
    s = licences.Scanner(licences.build())
    texts = [f"Intro words here. {t}. More words follow after." for _, t, _ in licences.TEMPLATES] + ["the license of the public software is general and free", "", None, "MIT is a university", "filler words " * 50_000 + "Released under the MIT License"]
    got = [{n for n, *_ in f} for f in s.scan(pa.array(texts))]
    for (name, *_), found in zip(licences.TEMPLATES, got):
        assert name in found
    assert got[len(licences.TEMPLATES) : -1] == [set(), set(), set(), set()] and got[-1] == {"MIT"}


def test_licences_need_their_key_phrases():
    s = licences.Scanner(licences.build())
    assert s.scan(pa.array(["This work is licensed under the GNU General Public License, version 3"]))[0][0][0] == "GPL-3.0"
    assert "GPL-2.0" not in {n for n, *_ in s.scan(pa.array(["This work is licensed under the GNU General Public License, version 3"]))[0]}


# page texts (4)


def brute_pages(pages, n):
    """All windows of n tokens that two pages of a host share are covered."""
    out = {}
    for k, (host, tokens) in enumerate(pages):
        gone = [False] * len(tokens)
        for i in range(len(tokens) - n + 1):
            w = tokens[i : i + n]
            if any(j != k and h == host and any(t[x : x + n] == w for x in range(len(t) - n + 1)) for j, (h, t) in enumerate(pages)):
                gone[i : i + n] = [True] * n
        out[k] = " ".join(t for t, g in zip(tokens, gone) if not g)
    return out


@pytest.mark.parametrize("limit", [1 << 24, 10])
def test_boilerplate_equals_brute_force(spark, limit):
    rng = random.Random(3)
    pages = [(rng.choice("ab"), [rng.choice("uvw") for _ in range(rng.randint(0, 25))]) for _ in range(24)]
    df = spark.createDataFrame([(k, f"http://{h}.org/x", f"<p>{' '.join(t)}</p>") for k, (h, t) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.page_texts(df, 3, limit).collect()}
    assert got == brute_pages(pages, 3)


def test_pages_with_nulls_and_repeats(spark):
    body = "<p>one two three four five six seven</p>"
    df = spark.createDataFrame([(None, "http://A.org/1", body, 1), (2, None, None, 2), (3, "", "", 3), (4, "http://a.org/2", body, 4), (5, "http://b.org", "<script>x</script>&amp; <!-- c -->ok", 5)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: (r["host"], r["text"], r["n_removed"]) for r in html_text.page_texts(df).collect()}
    assert got == {None: ("a.org", "", 7), 2: ("", None, None), 3: ("", "", 0), 4: ("a.org", "", 7), 5: ("b.org", "& ok", 0)}
    assert html_text.page_texts(df.where("false")).count() == 0


# chat (6)


def test_chat_parts(spark):
    turns = [
        (1, 1, "assistant", "see ![a](http://x.org/a.png) and http://x.org/b.mp3", 0),
        (1, 0, "user", '[{"type":"text","text":"hi <image_1>"},{"type":"image","url":"u","width":1024,"height":512},{"type":"document","url":"d.pdf","pages":3}]', 0),
        (1, 2, None, None, 0),
        (None, 0, "user", "", 0),
        (2, 0, "user", "x", 0),
        (2, 0, "user", "x", 0),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.conversations(df).collect()}
    r = got[1]
    assert r["formatted"] == "<|user|>\nhi <​image_1><image_1><document_1><|end|>\n<|assistant|>\nsee <image_2> and <audio_1><|end|>\n<|unknown|>\n<|end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "u", 85 + 170 * 2), ("document", "d.pdf", 2400), ("image", "http://x.org/a.png", 255), ("audio", "http://x.org/b.mp3", 750)]
    assert r["expanded_tokens"] == r["text_tokens"] + 425 + 2400 + 255 + 750
    assert got[None]["text_tokens"] == 0 and got[2]["n_turns"] == 2
    assert chat.conversations(df.where("false")).count() == 0


def test_long_texts_count_the_same_in_stretches():
    count = chat.counter(chat.ranks_of(chat.VOCABULARY))
    text = " ".join(random.Random(1).choice(["alpha", "beta's", "12", "??", "é"]) for _ in range(40_000))
    import tiktoken

    whole = tiktoken.Encoding("own", pat_str=chat.PATTERN, mergeable_ranks=chat.ranks_of(chat.VOCABULARY), special_tokens={})
    assert count([text, ""]) == [len(whole.encode_ordinary(text)), 0]


# decontamination (9)


def word_list(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def word_grams(w, n=3):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_matches(items, texts, threshold=0.5, overlap=0.5, size=64):
    """BM25 by its formula, over words, of every passage and every segment; then the overlaps around the passage. Items and texts as words, nothing of the operator's own."""
    segs = []  # item, place, words
    for k, (_, text) in enumerate(items):
        w = word_list(text)
        n = -(-len(w) // size)
        at = 0
        for j in range(n):
            step = len(w) // n + (j < len(w) % n)
            segs.append((k, j, w[at : at + step]))
            at += step
    parts = Counter(k for k, *_ in segs)
    df = Counter(t for *_, w in segs for t in set(w))
    mean = sum(len(w) for *_, w in segs) / len(segs)

    def weights(w):
        out = {}
        for t, tf in Counter(w).items():
            out[t] = math.log(1 + (len(segs) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        return {t: x / sum(out.values()) for t, x in out.items()}

    weighted = [weights(w) for *_, w in segs]
    result = []
    for text in texts:
        w = word_list(text)
        found = {}
        for b in range(max(1, -(-len(w) // size) - 1)):
            passage = set(w[b * size : (b + 2) * size])
            for (k, j, _), wt in zip(segs, weighted):
                score = sum(x for t, x in wt.items() if t in passage)
                if score < threshold - 1e-9:
                    continue
                own = w[max(0, b - j - 1) * size : (b + 2 + parts[k] - j) * size]
                held = word_grams(own) | {tuple(own[i : i + n]) for n in (1, 2) for i in range(len(own) - n + 1)}
                sides = [word_grams(word_list(x)) for x in decontaminate.split_item(items[k][1])]
                share = [len(g & held) / len(g) if g else 1.0 for g in sides]
                if min(share) >= overlap:
                    found[k] = max(found.get(k, (0,)), (round(score, 9), *share))
        result.append(sorted((items[k][0], *(round(x, 6) for x in v)) for k, v in found.items()))
    return result


def planted(seed=9, n=30, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{sentence(rng.randint(5, 150))}? {sentence(6)}.") for i in range(n)] + [(98, "single words"), (99, "")]
    texts = [sentence(rng.randint(0, 300)) for _ in range(40)] + [None, ""]
    texts += [f"{sentence(rng.randint(0, 500))} {t} {sentence(40)}" for _, t in items[:n]] + [" ".join(t for _, t in items)]
    return items, texts


def run_search(items, texts, slices=1):
    stats = decontaminate.statistics([t for _, t in items])
    step = -(-len(items) // slices)
    s = [decontaminate.Searcher(decontaminate.build(items[i : i + step], stats)) for i in range(0, len(items), step)]
    return [sorted((m[0], *(round(x, 6) for x in m[1:])) for m in ms) for ms in decontaminate.find(s, pa.array(texts))]


@pytest.mark.parametrize(("seed", "vocabulary", "slices"), [(9, 60, 1), (10, 20, 1), (11, 2000, 1), (12, 60, 4)])
def test_decontamination_equals_brute_force(seed, vocabulary, slices):
    items, texts = planted(seed, 30, vocabulary)
    got = run_search(items, texts, slices)
    assert got == brute_matches(items, texts)
    assert all(i in [m[0] for m in g] for i, g in zip(range(30), got[42:])) and set(range(30)) <= {m[0] for m in got[-1]}


def test_an_items_grams_elsewhere_in_a_long_text_do_not_count():
    """The question's and the answer's grams must stand around the passage, not anywhere in the text."""
    question, answer = " ".join(f"q{i}" for i in range(40)), " ".join(f"a{i}" for i in range(40))
    filler = " ".join(f"f{i}" for i in range(2000))
    items = [(1, f"{question}? {answer}.")]
    texts = [f"{question} {answer}", f"{question} {filler} {answer}", f"{filler} {question} {answer} {filler}"]
    assert [bool(g) for g in run_search(items, texts)] == [True, False, True]
    assert run_search(items, texts) == brute_matches(items, texts)


def test_the_search_follows_matching_postings_not_items():
    """A hundred times the items, of words that the texts lack, move hardly any more cursors."""
    items, texts = planted(13, 30, 60)
    other = random.Random(5)
    more = items + [(1000 + i, " ".join(f"z{other.randrange(50_000)}" for _ in range(40))) for i in range(3000)]
    steps = []
    for rows in (items, more):
        s = decontaminate.Searcher(decontaminate.build(rows, decontaminate.statistics([t for _, t in rows])))
        seek, n = s._seek, [0]
        s._seek = lambda t, *a, seek=seek, n=n: (n.__setitem__(0, n[0] + len(t)), seek(t, *a))[1]
        got = decontaminate.find([s], pa.array(texts))
        assert all(i in [m[0] for m in g] for i, g in zip(range(30), got[42:]))
        steps.append(n[0])
    assert steps[1] <= 2 * steps[0]


def test_decontamination_of_tables(spark):
    bench = spark.createDataFrame([(1, "What colour is the quiet northern harbour at dawn? It is mostly silver."), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Intro. What colour is the quiet northern harbour at dawn? It is mostly silver. End.", 0), (2, "A clean text about harbours.", 0), (None, None, 0), (4, "", 0)], "doc_id long, text string, item_id int")
    assert rows(decontaminate.clean(docs, bench), "doc_id") == rows(docs.where("doc_id is null or doc_id <> 1"), "doc_id")
    assert decontaminate.clean(docs, bench.where("false")).count() == 4 and decontaminate.clean(docs.where("false"), bench).count() == 0
    loud = spark.createDataFrame([(1, "AVANT ÉCOLE ÎLE ÈRE ÉTÉ ÊTRE ÂME ÔTER ÛN? ÉTAIT À L'ÉGLISE.")], "item_id long, text string")
    assert decontaminate.clean(spark.createDataFrame([(1, "x avant école île ère été être âme ôter ûn? était à l'église. y")], "doc_id long, text string"), loud).count() == 0
    sliced = decontaminate.clean(docs, bench.unionByName(bench), slice_items=1)
    assert sliced.count() == 3


# quality (7)


def test_quality_learns_and_is_calibrated():
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    both = [f"c{i}" for i in range(100)]
    y = [rng.random() < 0.5 for _ in range(1200)]
    texts = [" ".join(rng.choice(both if rng.random() < 0.7 else good if k else bad) for _ in range(60)) for k in y]
    model = quality.fit(pa.array(texts[:900]), np.where(y[:900], 2, 0))
    p = model.probabilities(pa.array([*texts[900:], None, ""]))
    assert np.mean((p[:300] >= 0.5) == np.array(y[900:])) >= 0.9 and np.isfinite(p).all() and p[-1] == p[-2]
    assert abs(p[:300].mean() - np.mean(y[900:])) < 0.1


def test_quality_without_labels_keeps_everything(spark):
    docs = spark.createDataFrame([(1, "a", 0.1), (None, None, 0.2), (3, "", 0.3)], "doc_id long, text string, probability double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.clean(docs, labels).count() == 3 and quality.clean(docs, labels).columns == docs.columns
    odd = spark.createDataFrame([(1, None, 0), (3, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.clean(docs, odd).count() == 3


# URLs (10)


def log_share(shares, w):
    return math.log(shares[w]) if w in shares else math.log(url_filter.UNKNOWN) - len(w) * math.log(26)


def brute_split(shares, name):
    """The best score of all ways to split."""
    best = [0.0] + [-math.inf] * len(name)
    for j in range(1, len(name) + 1):
        best[j] = max(best[i] + log_share(shares, name[i:j]) for i in range(j))
    return best[-1]


def test_segmentation_is_the_likeliest():
    shares = {w: n / 288 for w, n in {"cheap": 50, "pills": 40, "online": 60, "on": 100, "line": 30, "lines": 5, "hea": 2, "p": 1}.items()}
    s = url_filter.Segmenter(shares)
    rng = random.Random(4)
    for name in ["cheappillsonline", "onlines", "zzzz", "cheapzzpills"] + ["".join(rng.choice(["cheap", "on", "line", "s", "q", "p"]) for _ in range(5)) for _ in range(50)]:
        got = s.split(name)
        assert "".join(got) == name and sum(log_share(shares, w) for w in got) == pytest.approx(brute_split(shares, name))
    assert s.split("cheappillsonline") == ("cheap", "pills", "online") and s.split("x" * 5000) == ("x" * 5000,)


def test_urls_of_a_table(spark):
    pages = [(i, f"http://cheapcasino{i % 3}.example.com/win/{i}", "<title>win</title>") for i in range(20)] + [(100 + i, f"http://gardenschool.example.org/lesson/{i}", "<title>garden lesson</title>") for i in range(20)]
    df = spark.createDataFrame([*pages, (None, None, None), (7, "not a url", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.scored(df).collect() if r["url"] != "not a url"}
    assert all(got[i]["blocked"] == (i < 100) for i, *_ in pages) and got[1]["host_words"] == "cheap casino example" and not got[None]["blocked"]
    assert url_filter.scored(df.where("false")).count() == 0


def test_names_split_alike_at_any_size(spark):
    """The same pages a thousand times give the same splits."""
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ca", "sino", "gar", "den") for b in ("", "s", "ing", "er")]
    pages = [(i, f"http://{rng.choice(words)}{rng.choice(words)}{rng.choice(words)}.example.com/{rng.choice(words)}", f"<title>{' '.join(rng.choice(words) for _ in range(6))}</title>", None) for i in range(40)]
    one = spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string, words string")
    many = one.crossJoin(spark.range(1000).select(F.col("id").alias("host")))
    split = lambda df: {(r["page_id"], r["host_words"]) for r in url_filter.scored(df).select("page_id", "host_words").distinct().collect()}
    assert split(one) == split(many) and len(split(one)) == 40
