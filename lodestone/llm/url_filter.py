"""URL filters: host word segmentation by unigram Viterbi, then multinomial naive Bayes over host and path words.

Unigram counts come from all pages: the words of titles, host names and paths. A word's probability is its share of them, mixed with a small lexicon of words that hosts like to concatenate, which has LEXICON_SHARE of the
whole at any size; an unknown run of n letters has UNKNOWN / 26^n. So a corpus that is many times as large, but alike, splits names alike. Each label of a host name is split into the words that are likeliest as a product
of their probabilities. The bytes of other alphabets, digits and signs separate words; the public suffix and a leading www are left out.

Naive Bayes is trained on labelled examples, SEEDS, which are names of invented hosts of both classes; and then once more, as in expectation maximisation, on all pages of the corpus, each of which counts for both classes by the
probability that the examples, and a share of BAD_SHARE of bad pages, give it, so that words the examples don't have get their odds from the company they keep. Scores are log odds of bad over the words of host and path; a page above
THRESHOLD is blocked.

Defined results: a null or malformed URL has no words and gets the prior's log odds; repeated rows each get their score and count for the training; an empty table gives an empty one; a run of more than LABEL letters is no
label of a host name, and one unknown word. Words may have any length, URLs too. A null page_id is carried through. Of the table's columns page_id and url are returned, others, whatever their names, are not.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, arrow_map, materialise, table
from .html_text import host_of

#: Labelled examples: names of hosts, as they would stand in a URL.
SEEDS = {
    1: """adultvideotube adultdatingxxx bestcasinobets bestescortgirls buycheappills cheapviagrapills cheapreplicawatch clickadsmoney crackedwarez earnfastmoney freeadultporn freecasinoslots freepokerbets
freepornvideos freeviagrapills hotxxxgirls instantpaydayloans luckycasinowin moneybetswin onlinecasinopoker onlinegamblingslots onlinepillspharmacy pornxxxtube quickpaydayloans replicabagsale spamadsclick spammailserver
sportsbetsonline trackingadsserver vegaspokerwin warezcrackdownload weightlosspills winfreeprize xxxadultgirls adultchatroom adultfriends adultlive adultmovies adultpics adulttoys adsbanner adsclicktracker adsnetwork
adspopup adsserver betsforfun bestslots bulkspam cashloans casinobonus casinocity casinoroyal cheapmeds clicktracker crackedgames crackkeys diet-pills discountviagra escortservice fakewatches footballbets gamblingtips
horsebets jackpotslots loanshark meds-pills pokerroom porngallery pornlive replicabags scamcoin spambot spamemail spamhost spamlist spamnetwork slotsbonus trackpixel vipescort viagrashop warezgames warezforum
xxxmovies xxxlive""".split(),
    0: """artschool bankofthecity bookreviews carexpert citylibrary citynews codelearning collegelaw cookingclub digitaldesign dogcare educationonline farmmarket filmreviews financenews fitnessclub flowershop foodblog gamereviews
gardenblog greenhouse healthcare historymuseum homedesign hotelguide insuranceexpert jobsearch kidsgames lawschool lifestylemagazine localnews lovemusic medicalcenter movienews musicstore newsnetwork onlineschool
parkhotel photostudio realestate schoolbooks sciencelab securebank softwaresolutions sportnews techsupport theweather toolshop traveltips universitypress weatherstation webdesign womenhealth worldnews animalfarm bikerepair bloggers chesscenter cheapflights childrensmuseum coffeehouse communitycenter dailyblog
familyfarm farmfood filmstudio freebooks freelibrary freeschool gardencenter girlschool guitarlessons kidsmovies languageschool marketwatch moviereviews musiclive nightsky officetools openlibrary paintingclub petcare
photoblog radiolive runningtrack schoolforum sciencevideo socialwork sportsclub studentjobs summercamp swimmingclub teachersnetwork trackandfield traintickets villageinn watchrepair winehouse winteractivities
writersroom youthclub""".split(),  # noqa: SIM905
}
LEXICON = """about account ads adult affiliate age all amazon app apps art auto baby bank best bet bets big biz blog book books box business buy car cards care cash casino center cheap city click club code
coin college cool crack credit crypto data date dating deal deals design dev digital direct dollar download drug drugs earn easy education escort expert express farm fashion fast film finance fire fit food forum free fun
gambling game games gift girls global go gold good green group health help home hot hotel house info insurance job jobs kids king lab law learn life link live loan loans local love magazine mail market media men meds mobile
money movie music my net network news now office one online page park party pay payday pharmacy phone photo pills play poker porn post press prize pro quick real replica review reviews rich sale save scam school search
secure sell seo server sex shop shopping site slot slots smart social soft software solutions spam sport sports spy star stock store stream studio success support system tech the tickets tool tools top track tracker trade
travel trust tube tv ultimate university vegas viagra video vip warez watch weather web weight win winner women work world xxx your zone""".split()  # noqa: SIM905
#: Of the probability, the lexicon's part; what an unknown word has before its letters.
LEXICON_SHARE, UNKNOWN = 0.2, 1e-4
THRESHOLD = 0.0
#: What every word counts for in either class beside its occurrences.
ALPHA = 0.1
#: The part of all pages that is taken for bad before anything is known of them.
BAD_SHARE = 0.05
LABEL = 63

_WORD = re.compile(r"[a-z]+")
_SECOND = frozenset("ac co com edu gov net org".split())


class Segmenter:
    """shares: the probabilities of all words that a name can hold."""

    def __init__(self, shares: dict[str, float]):
        self.logs = {w: math.log(p) for w, p in shares.items() if p > 0}
        self.longest = max(map(len, self.logs), default=1)

    def split(self, name: str) -> tuple[str, ...]:
        """The likeliest words of a run of letters; of equally likely ones, that whose last words are longest. Linear in the length: unknown runs grow letter by letter."""
        if len(name) > LABEL:
            return (name,)
        n, letter = len(name), math.log(26.0)
        best = [0.0] + [-math.inf] * n
        back = [0] * (n + 1)
        start = [0] * (n + 1)  # where the unknown run that ends here begins
        run = [-math.inf] * (n + 1)  # best score with an unknown run that ends here
        for j in range(1, n + 1):
            fresh, longer = best[j - 1] + math.log(UNKNOWN) - letter, run[j - 1] - letter
            run[j], start[j] = (longer, start[j - 1]) if longer >= fresh else (fresh, j - 1)
            best[j], back[j] = run[j], start[j]
            for i in range(max(0, j - self.longest), j):
                lp = self.logs.get(name[i:j])
                if lp is not None and (best[i] + lp > best[j] or best[i] + lp == best[j] and i < back[j]):
                    best[j], back[j] = best[i] + lp, i
        out, j = [], n
        while j > 0:
            out.append(name[back[j] : j])
            j = back[j]
        return tuple(reversed(out))


def host_runs(host: str) -> list[str]:
    """Runs of letters, without the public suffix (the last label, and a general one before a country's) and a leading www."""
    labels = host.lower().split(".")
    cut = 2 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND else 1
    labels = labels[:-cut] if len(labels) > 1 else labels
    return [run for x in labels[labels[:1] == ["www"] :] for run in _WORD.findall(x)]


def path_words(url: str) -> list[str]:
    m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", url, re.S)
    return ["/" + w for w in _WORD.findall(m[1].lower())] if m else []


def unigrams(pages: DataFrame) -> DataFrame:
    """w, p: the probability of every word, from counts over all pages, mixed with the lexicon's."""
    title = F.regexp_extract(F.col("html"), r"(?is)<title[^>]*>(.*?)</title", 1)
    path = F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    # pieces of host names count only as parts between signs: a concatenation must not outweigh its words
    hyphened = F.when(host_of(F.col("url")).contains("-"), F.array_join(F.filter(F.split(host_of(F.col("url")), r"\."), lambda x: x.contains("-")), " ")).otherwise("")
    words = F.split(F.lower(F.concat_ws(" ", title, path, hyphened)), "[^a-z]+")
    counted = materialise(pages.select(F.explode(words).alias("w")).where(F.length("w") >= 2).groupBy("w").agg(F.count("*").alias("n")), "words")
    total = counted.agg(F.sum("n")).first()[0]
    shares = counted.select("w", (F.col("n") / float(total or 1) * (1 - LEXICON_SHARE)).alias("p"))
    lexicon = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, LEXICON))).alias("w"), F.lit(LEXICON_SHARE / len(LEXICON)).alias("p"))
    return shares.unionByName(lexicon).groupBy("w").agg(F.sum("p").alias("p"))


def _strings(rows: list[list[str]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.string()))


def _parts(url: Column) -> Column:
    """The host's runs of letters and the words of the path."""

    def start():  # noqa: ANN202
        hosts = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

        def run(urls: pa.Array) -> pa.Array:
            out = []
            for u in urls.to_pylist():
                m = hosts.match(u or "")
                out.append({"runs": host_runs(m[1]) if m else [], "path": path_words(u or "")})
            return pa.array(out, pa.struct([("runs", pa.list_(pa.string())), ("path", pa.list_(pa.string()))]))

        return run

    return arrow_map(start, "struct<runs:array<string>,path:array<string>>", url)


def _substrings(run: Column) -> Column:
    """What may be a word in it, each once."""

    def start():  # noqa: ANN202
        return lambda runs: _strings([sorted({r[i:j] for i in range(len(r)) for j in range(i + 2, len(r) + 1)}) if len(r) <= LABEL else [] for r in runs.to_pylist()])

    return arrow_map(start, "array<string>", run)


def segmented(runs: DataFrame, shares: DataFrame) -> DataFrame:
    """runs: run, distinct. run, words: the likeliest. Each run meets the shares of its own substrings alone, so they may be of any number."""

    def start():  # noqa: ANN202
        return lambda names, known: _strings([list(Segmenter({x["w"]: x["p"] for x in k or []}).split(r)) for r, k in zip(names.to_pylist(), known.to_pylist())])

    found = runs.select("run", F.explode(_substrings(F.col("run"))).alias("w")).join(shares, "w").groupBy("run").agg(F.collect_list(F.struct("w", "p")).alias("known"))
    return runs.join(found, "run", "left").select("run", arrow_map(start, "array<string>", F.col("run"), F.col("known")).alias("words"))


def split_hosts(parts: DataFrame, shares: DataFrame) -> DataFrame:
    """parts: runs. runs, host: the words of each distinct list of runs."""
    hosts = parts.select("runs").where(F.size("runs") > 0).distinct()
    each = hosts.select("runs", F.posexplode("runs").alias("at", "run"))
    words = each.join(segmented(each.select("run").distinct(), shares), "run").groupBy("runs").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("x"))
    return words.select("runs", F.flatten(F.transform("x", lambda x: x["words"])).alias("host"))


def train(labelled: DataFrame) -> tuple[DataFrame, float]:
    """labelled: words, bad (a probability). Naive Bayes: w and its odds, for every word, and the prior's odds. Smoothing by ALPHA over the words seen and one more; totals are of all of them."""
    p = F.col("bad")
    each = labelled.select("bad", F.explode("words").alias("w")).groupBy("w").agg(F.sum(1 - p).alias("good"), F.sum(p).alias("bad"))
    each = materialise(each, "word-classes")
    good, bad, v = (x or 0 for x in each.agg(F.sum("good"), F.sum("bad"), F.count("*")).first())
    pages = [x or 0 for x in labelled.agg(F.sum(1 - p), F.sum(p)).first()]
    odds = F.log((F.col("bad") + ALPHA) / F.lit(float(bad + ALPHA * (v + 1)))) - F.log((F.col("good") + ALPHA) / F.lit(float(good + ALPHA * (v + 1))))
    return each.select("w", odds.alias("odds")), math.log((pages[1] + 1) / (pages[0] + 1))


def _scores(rows: DataFrame, odds: DataFrame, prior: float) -> DataFrame:
    """rows: _lds_row, words. _lds_row, score: summed in the words' order, so that it is the same in every run."""
    sums = rows.select(f"{P}row", F.posexplode("words").alias("at", "w")).join(odds, "w").groupBy(f"{P}row").agg(F.sort_array(F.collect_list(F.struct("at", "odds"))).alias("x"))
    sums = sums.select(f"{P}row", F.aggregate("x", F.lit(0.0), lambda s, x: s + x["odds"]).alias("s"))
    return rows.select(f"{P}row").join(sums, f"{P}row", "left").select(f"{P}row", (F.lit(prior) + F.coalesce("s", F.lit(0.0))).alias("score"))


def scored(pages: DataFrame, threshold: float = THRESHOLD, seeds: dict[int, list[str]] | None = None) -> DataFrame:
    """pages: page_id, url, html; seeds: examples by class (1: bad). page_id, url, words of the host, score, blocked. The words' shares and odds are tables that are joined to, whatever their size; names are split once."""
    spark = pages.sparkSession
    shares = materialise(unigrams(pages), "unigrams")
    parts = pages.select("page_id", "url", _parts(F.col("url")).alias("p")).select("page_id", "url", "p.*", F.monotonically_increasing_id().alias(f"{P}row"), F.lit(None).cast("double").alias("bad"))
    examples = [(None, None, [x], [], -1 - i, float(k)) for i, (k, x) in enumerate((k, x) for k, xs in (SEEDS if seeds is None else seeds).items() for x in xs)]
    parts = materialise(parts.unionByName(spark.createDataFrame(examples, parts.schema)), "url-parts")
    rows = parts.join(split_hosts(parts, shares), "runs", "left").withColumn("host", F.coalesce("host", F.array().cast("array<string>")))
    rows = materialise(rows.select(f"{P}row", "page_id", "url", "host", F.concat("host", "path").alias("words"), "bad"), "url-words")
    own = rows.where(F.col(f"{P}row") >= 0).drop("bad")
    examples = rows.where(F.col(f"{P}row") < 0)
    odds, _ = train(examples)
    guess = _scores(own, F.broadcast(odds), math.log(BAD_SHARE / (1 - BAD_SHARE)))  # as many words as the examples have
    guess = materialise(own.join(guess, f"{P}row").select(f"{P}row", "words", (1 / (1 + F.exp(-F.col("score")))).alias("bad")), "url-guesses")
    odds, prior = train(guess.select("words", "bad").unionByName(examples.select("words", "bad")))
    out = own.join(_scores(own, odds, prior), f"{P}row").select("page_id", "url", F.array_join("host", " ").alias("host_words"), "score")
    return out.withColumn("blocked", F.col("score") > threshold)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, host's words, log odds and verdict of every page."""
    return scored(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
