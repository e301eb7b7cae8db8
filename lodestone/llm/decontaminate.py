"""Benchmark decontamination: a BM25 inverted index of the test items, searched with block-max WAND by every passage of every training text.

Items are cut into segments of at most SEGMENT words. A segment's BM25 score is divided by the score that it gets for its own words, so that one threshold holds
for all. A text is cut into blocks of SEGMENT words; a passage is two adjacent blocks, so any copied segment lies whole in one passage. All segments that score the
threshold or more for a passage are retrieved, by block-max WAND over ranges of RANGE segments: a range in which the greatest weights of the passage's terms don't add up to the threshold is dead, and none of its
postings are touched. In a live one, the passage has a cursor into the postings of each of its terms; in the order of the cursors, the terms' greatest weights in the range are added up until they reach the
threshold, which makes the pivot; what is before the pivot can't reach it and is skipped. If the greatest weights within the pivot's block of BLOCK segments don't reach the threshold either, the whole
block is skipped; else the pivot is scored. Passages go in step: each round moves the cursors of all that are still searching, as arrays. So the cost follows the matching postings of live ranges, not the number of items.

A pair counts once the text around the passage, as long as the item, is verified to hold OVERLAP of the item's question 3-grams and of its answer 3-grams; the answer is the item's last sentence, the question
what precedes it. An item of one sentence has no answer to verify.

Statistics are over all items. The index is built by numpy on the driver: it is of the test items alone and does not grow with the corpus. It is broadcast in slices of SLICE items; texts are tokenised once for all of them.

Defined results: case doesn't count, in any alphabet; null or empty texts match nothing; texts of any length are searched whole; items without words are left out; repeated items each match, and so do repeated documents;
a null doc_id or item_id is carried through; without items, or without documents, nothing is found. Other columns of the documents, whatever their names, play no part and clean() carries them along.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, arrow_map, table
from .textops import HashTable, U, ngrams, words

K1, B = 1.2, 0.75
SEGMENT = 64
THRESHOLD = 0.5
OVERLAP = 0.5
GRAM = 3
#: Segments of a block and of a range, which is whole blocks.
BLOCK, RANGE = 4, 8
SLICE = 50_000
#: Cursors that move in step, at most about.
CURSORS = 1 << 18
_EPS = 1e-9


def split_item(text: str) -> tuple[str, str]:
    """Question and answer."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if re.search(r"\w", p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the texts' offsets."""
    hs, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for *_, h, ptr in words(pa.array([t.lower() for t in texts], pa.large_string())) if texts else ():
        hs.append(h)
        sizes.append(np.diff(ptr))
    return np.concatenate(hs), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each text, and the texts' offsets."""
    g, row = ngrams(*_hashed(texts), GRAM)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], np.searchsorted(row[new], np.arange(len(texts) + 1))


@dataclass
class Segments:
    """The segments of items: their words' hashes, distinct by segment and in its order, with counts; their lengths, items, and places in the item."""

    seg: np.ndarray
    term: np.ndarray
    tf: np.ndarray
    length: np.ndarray
    item: np.ndarray
    place: np.ndarray


def segments(texts: list[str]) -> Segments:
    h, ptr = _hashed(texts)
    size = np.diff(ptr)
    n = -(-size // SEGMENT)
    item = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    length = size[item] // n[item] + (place < size[item] % n[item])
    seg = np.repeat(np.arange(len(item)), length)
    order = np.lexsort((h, seg))
    h, seg = h[order], seg[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (seg[1:] != seg[:-1])])) if len(h) else np.zeros(0, np.int64)
    return Segments(seg[first], h[first], np.diff(np.append(first, len(h))), length, item, place)


@dataclass
class Statistics:
    """Over all segments of all items: terms (ascending) and the segments that have them, the number of segments, their mean length."""

    terms: np.ndarray
    df: np.ndarray
    n: int
    mean: float


def statistics(texts: list[str]) -> Statistics:
    s = segments(texts)
    terms, df = np.unique(s.term, return_counts=True)
    return Statistics(terms, df, len(s.length), float(s.length.mean()) if len(s.length) else 0.0)


@dataclass
class Index:
    terms: np.ndarray  # hashes
    key: np.ndarray  # of the postings, term * segments + segment, ascending
    weight: np.ndarray
    range_ptr: np.ndarray  # by term, the ranges that it has postings in
    range_id: np.ndarray
    range_weight: np.ndarray  # the greatest in it
    range_at: np.ndarray  # the postings in it, up to the next one's
    block_key: np.ndarray  # of the terms' blocks, term * blocks + block, ascending
    block_weight: np.ndarray  # the greatest in it
    item: np.ndarray  # by segment
    place: np.ndarray
    ids: list[int | None]
    parts: np.ndarray  # by item, its segments
    question: tuple[np.ndarray, np.ndarray]
    answer: tuple[np.ndarray, np.ndarray]

    @property
    def n(self) -> int:
        return len(self.item)


def _expand(ptr: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of k the positions ptr[k] to ptr[k + 1]: which of k, and the position."""
    size = ptr[k + 1] - ptr[k]
    which = np.repeat(np.arange(len(k)), size)
    return which, np.repeat(ptr[k] - (np.cumsum(size) - size), size) + np.arange(len(which))


def build(items: list[tuple[int | None, str]], stats: Statistics) -> Index:
    s = segments([t for _, t in items])
    n = len(s.item)
    df = stats.df[np.searchsorted(stats.terms, s.term)]
    idf = np.log(1 + (stats.n - df + 0.5) / (df + 0.5))
    w = idf * s.tf * (K1 + 1) / (s.tf + K1 * (1 - B + B * s.length[s.seg] / stats.mean)) if n else np.zeros(0)
    w = w / np.bincount(s.seg, w, n)[s.seg] if n else w
    terms, term = np.unique(s.term, return_inverse=True)
    key = term * n + s.seg
    order = np.argsort(key)
    key, w, term, seg = key[order], w[order], term[order], s.seg[order]

    def cells(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of a term's postings in one cell of so many segments: key, first posting, greatest weight."""
        k = term * (n // width + 1) + seg // width
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        return k[first], first, np.maximum.reduceat(w, first) if len(first) else np.zeros(0)

    rkey, rfirst, rweight = cells(RANGE)
    bkey, _, bweight = cells(BLOCK)
    ranges = n // RANGE + 1
    halves = [split_item(t) for _, t in items]
    return Index(
        terms, key, w, np.searchsorted(rkey // ranges, np.arange(len(terms) + 1)), rkey % ranges, rweight, np.append(rfirst, len(key)), bkey, bweight, s.item, s.place,
        [i for i, _ in items], np.bincount(s.item, minlength=len(items)), _grams([q for q, _ in halves]), _grams([a for _, a in halves]),
    )


class Searcher:
    def __init__(self, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP):
        self.x, self.threshold, self.overlap = index, threshold, overlap
        self.known = HashTable(index.terms)

    def passages(self, h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct terms of the passages of texts, by passage; the passages' rows and first blocks. A passage is named by its first block, counted over all rows."""
        x = self.x
        at, term = self.known.find(h)
        blocks = np.maximum(1, -(-np.diff(ptr) // SEGMENT))
        base = np.concatenate([[0], np.cumsum(blocks)])
        row = np.searchsorted(ptr, at, "right") - 1
        place = (at - ptr[row]) // SEGMENT
        block = base[row] + place
        # in the passage that begins with its block, unless that is the row's last of several, and in the one before
        first, second = (place < blocks[row] - 1) | (blocks[row] == 1), place > 0
        m = max(1, len(x.terms))
        key = np.unique(np.concatenate([block[first] * m + term[first], (block[second] - 1) * m + term[second]]))
        rows = np.repeat(np.arange(len(blocks)), blocks)
        return key // m, key % m, rows, np.arange(len(rows)) - base[rows]

    def search(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages (ascending, as passages() gives them), segments and scores of all pairs whose score reaches the threshold."""
        x, least = self.x, self.threshold - _EPS
        ranges = x.n // RANGE + 1
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.zeros(0, np.int64)
        lo = 0
        width = np.concatenate([[0], np.cumsum(x.range_ptr[term + 1] - x.range_ptr[term])]) if len(term) else np.zeros(1, np.int64)
        before = width[start]
        while lo < len(start):  # whole passages, with so many cursors or cells at most
            hi = max(lo + 1, min(int(np.searchsorted(before, before[lo] + CURSORS, "right")) - 1, int(np.searchsorted(passage[start], passage[start[lo]] + CURSORS * 8 // ranges, "right"))))
            i, j = start[lo], start[hi] if hi < len(start) else len(passage)
            which, k = _expand(x.range_ptr, term[i:j])
            base = passage[i]
            query = (passage[i:j][which] - base) * ranges + x.range_id[k]
            live = np.bincount(query, x.range_weight[k])[query] >= least if len(query) else np.zeros(0, bool)
            query, k = query[live], k[live]
            for q, segment, score in self._wand(query, term[i:j][which[live]], k):
                out.append((base + q // ranges, segment, score))
            lo = hi
        return tuple(np.concatenate(c) for c in zip(*out))

    def _wand(self, query: np.ndarray, term: np.ndarray, k: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Block-max WAND of queries (a passage in a range) in step. k: the term's postings in the range. pos: cursors into the postings; at: their segments, n when they are at the range's end."""
        x, n, blocks, least, out = self.x, self.x.n, self.x.n // BLOCK + 1, self.threshold - _EPS, []
        most, pos, end = x.range_weight[k], x.range_at[k], x.range_at[k + 1]
        at = x.key[pos] - term * n
        while len(term):
            order = np.argsort(query * (n + 1) + at)
            query, term, most, pos, end, at = (a[order] for a in (query, term, most, pos, end, at))
            first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
            last = np.append(first[1:], len(query))
            total = np.cumsum(most)
            pivot = np.searchsorted(total, np.concatenate([[0.0], total])[first] + least)
            live = (pivot < last) & (at[np.minimum(pivot, len(at) - 1)] < n)
            if not live.all():  # without a pivot a query is done
                keep = np.repeat(live, last - first)
                query, term, most, pos, end, at = (a[keep] for a in (query, term, most, pos, end, at))
                continue
            segment, group = at[pivot], np.repeat(np.arange(len(first)), last - first)
            mine = segment[group]
            behind, ahead = np.flatnonzero(at <= mine), np.flatnonzero(at > mine)
            t, g = term[behind], group[behind]
            key = t * blocks + segment[g] // BLOCK
            b = np.minimum(np.searchsorted(x.block_key, key), len(x.block_key) - 1)
            open_ = np.bincount(g, np.where(x.block_key[b] == key, x.block_weight[b], 0), len(first)) >= least
            # a block that can't reach it is skipped up to its end, or to the first cursor beyond the pivot
            beyond = np.full(len(first), n)
            np.minimum.at(beyond, group[ahead], at[ahead])
            to = np.where(open_, segment, np.minimum((segment // BLOCK + 1) * BLOCK, beyond))
            p, s, e = pos[behind], at[behind], end[behind]
            self._seek(t, p, s, e, to[g])
            hit = open_[g] & (s == segment[g])
            score = np.bincount(g[hit], x.weight[p[hit]], len(first))
            found = np.flatnonzero(open_ & (score >= least))
            if len(found):
                out.append((query[first[found]], segment[found], score[found]))
            p[hit] += 1
            s[hit] = self._at(t[hit], p[hit], e[hit])
            pos[behind], at[behind] = p, s
        return out

    def _at(self, term: np.ndarray, pos: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.where(pos < end, self.x.key[np.minimum(pos, len(self.x.key) - 1)] - term * self.x.n, self.x.n)

    def _seek(self, term: np.ndarray, pos: np.ndarray, at: np.ndarray, end: np.ndarray, to: np.ndarray) -> None:
        """Moves cursors to the first segments that aren't below `to`."""
        move = np.flatnonzero(at < to)
        pos[move] = np.minimum(np.searchsorted(self.x.key, term[move] * self.x.n + to[move]), end[move])
        at[move] = self._at(term[move], pos[move], end[move])

    def found(self, h: np.ndarray, ptr: np.ndarray) -> list[tuple[int, tuple[int | None, float, float, float]]]:
        """Row and match of each item that a text is verified to hold."""
        x = self.x
        if not x.n:
            return []
        passage, term, rows, place = self.passages(h, ptr)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        cache: dict[tuple[int, int], np.ndarray] = {}
        for p, seg, score in zip(*(a.tolist() for a in self.search(passage, term))):
            row, item = int(rows[p]), int(x.item[seg])
            # the item may begin so many segments before the passage, and end so many after
            lo = ptr[row] + max(0, int(place[p]) - int(x.place[seg]) - 1) * SEGMENT
            hi = min(ptr[row + 1], ptr[row] + (int(place[p]) + 2 + int(x.parts[item] - x.place[seg])) * SEGMENT)
            if (lo, hi) not in cache:
                own = h[lo:hi]
                cache[lo, hi] = np.unique(np.concatenate([ngrams(own, np.array([0, len(own)]), GRAM)[0], *(_short(own, n) for n in range(1, GRAM))]))
            held = []
            for grams, at in (x.question, x.answer):
                g = grams[at[item] : at[item + 1]]
                held.append(float(np.isin(g, cache[lo, hi]).mean()) if len(g) else 1.0)
            if min(held) >= self.overlap:
                now = (round(score, 9), *held)
                best[row, item] = max(best.get((row, item), now), now)
        return [(row, (x.ids[item], *b)) for (row, item), b in sorted(best.items())]


def _short(own: np.ndarray, n: int) -> np.ndarray:
    """n words anywhere, hashed as a text of just these."""
    m = len(own) - n + 1
    if m < 1:
        return np.zeros(0, U)
    parts = np.lib.stride_tricks.sliding_window_view(own, n).ravel()
    return ngrams(parts, np.arange(0, m * n + 1, n), GRAM)[0]


def find(searchers: list[Searcher], texts: pa.Array) -> list[list[tuple[int | None, float, float, float]]]:
    """For each text: item, best score (to nine digits; of equal ones the best overlaps), overlap with question and answer. Texts are tokenised once."""
    out: list[list] = [[] for _ in range(len(texts))]
    for i, _, h, ptr in words(texts):
        for s in searchers:
            for row, match in s.found(h, ptr):
                out[i + row].append(match)
    return out


RESULT = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def matches(benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, slice_items: int = SLICE) -> Callable[[Column], Column]:
    """A function from a text column to an array of the verified items."""
    spark = benchmark.sparkSession
    rows = [(r[0], r[1] or "") for r in benchmark.select(F.col("item_id").cast("long"), F.lower("text").alias("text")).orderBy("item_id", "text").toLocalIterator()]
    stats = statistics([t for _, t in rows])
    parts = [spark.sparkContext.broadcast(build(rows[i : i + slice_items], stats)) for i in range(0, max(1, len(rows)), slice_items)]

    def start():  # noqa: ANN202
        searchers = [Searcher(p.value, threshold, overlap) for p in parts]
        fields = ("item_id", "score", "question_overlap", "answer_overlap")
        return lambda texts: pa.array([[dict(zip(fields, m)) for m in ms] for ms in find(searchers, texts)], _TYPE)

    return lambda text: arrow_map(start, RESULT, F.lower(text))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that hold no test item."""
    return docs.where(F.size(matches(benchmark, **how)(F.col("text"))) == 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and test item that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    on = matches(table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", F.explode(on(F.col("text"))).alias(f"{P}m")).select("doc_id", f"{P}m.*")
