"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with temperature-calibrated probabilities.

Random indexing: every context has a fixed sparse ternary index vector; a word's vector is the sum of the index vectors of the contexts it occurs in. Words have places in two tables of BUCKETS each, by two hashes, and
go by the less crowded one: so the model is of fixed size and still no word is left out; words that share a place share a vector. Contexts are the neighbouring words, summed over all documents of the corpus (each task sums its own, the sums are
added up by place), taken as the mean less that of all words, shrunk for rare words; and the classes of labelled documents, weighted by smoothed positive pointwise mutual information.
A document is pooled to the mean, the maximum and the minimum over its words' vectors, by dimension, so that a few telling words in a long text still show.
The network is trained on other labelled documents than the class contexts, and its temperature fitted on yet others.

Labels are used of at most SAMPLE documents, those with the smallest hash of doc_id; all else is of the whole corpus. Every document is scored over its whole text. good means quality 1 and toxic 0.

Defined results: labels with a null are left out, and so are conflicting labels of one doc_id; without labelled documents of both kinds every document gets probability 1.
A null or empty text gets the score of pooled zeros; texts may be of any length; equal texts get equal scores, and rows that are repeated count as often for the vectors; an empty table gives an empty one.
Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, arrow_map, discard, materialise, shuffle_partitions, table
from .textops import DIGIT, KIND, UPPER, U, buffers, hash_spans, mix, pieces, spans

SAMPLE = 20_000
DIM = 32
NONZERO = 6
#: Places in each of two tables, a power of 2.
BUCKETS = 1 << 17
PRIOR = 8.0
#: Occurrences at which a word's neighbours count by half.
RARE = 10.0
UNIT = 127.0
CLASS_WEIGHT = 4.0
HIDDEN = 32
KEEP = 0.5
#: Bytes of text that are cut into tokens at once, and words whose neighbours are summed at once: they bound the memory, nothing else.
PIECE, WORDS = 1 << 19, 1 << 18
CLASSES = ("poor", "toxic", "good")
_CAPS, _NUMBER, _REPEAT = (U(x) for x in (0x5EED0001, 0x5EED0002, 0x5EED0003))


def tokens(texts: pa.Array, most: int = PIECE):
    """For pieces of the rows: first row, token hashes, offsets. Words are folded to lower case; words in capitals, numbers and repeats of the word before add a token of
    their own kind; runs of punctuation are tokens."""
    raw, off = buffers(texts)
    for i, j in pieces(off, most):
        r, o = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        s, e, ptr = spans(r, o, punctuation=True)
        if not len(s):
            yield i, np.zeros(0, U), np.zeros(j - i + 1, np.int64)
            continue
        h = hash_spans(r, s, e)
        size = e - s
        word = KIND[r[s]] == 1
        upper = np.concatenate([[0], np.cumsum(UPPER[r] | (r >= 128))])
        digit = np.concatenate([[0], np.cumsum(DIGIT[r])])
        ascii_upper = np.concatenate([[0], np.cumsum(UPPER[r])])
        caps = word & (upper[e] - upper[s] == size) & (ascii_upper[e] - ascii_upper[s] >= 2)
        number = word & (digit[e] - digit[s] == size)
        h[number] = _NUMBER
        row = np.repeat(np.arange(j - i), np.diff(ptr))
        repeat = np.zeros(len(h), bool)
        repeat[1:] = word[1:] & (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        extra = np.concatenate([np.flatnonzero(caps), np.flatnonzero(repeat)])
        if len(extra):
            kinds = np.concatenate([np.full(int(caps.sum()), _CAPS), np.full(int(repeat.sum()), _REPEAT)])
            h = np.insert(h, extra, kinds)
            row = np.insert(row, extra, row[extra])
        yield i, h, np.searchsorted(row, np.arange(j - i + 1))


def _nonzero(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys' index vectors, which are a function of the keys alone, the k-th dimension that isn't zero, and its sign."""
    x = mix(keys + U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return (x % U(DIM)).astype(np.int64), np.where(x >> U(63), 1.0, -1.0)


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """Sparse ternary vectors."""
    out = np.zeros((len(keys), DIM), np.float32)
    for k in range(NONZERO):
        dim, sign = _nonzero(keys, k)
        out[np.arange(len(keys)), dim] += sign
    return out


def _both(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's two places."""
    shift = U(64 - int(np.log2(BUCKETS)))
    return (mix(h) >> shift).astype(np.int64), BUCKETS + (mix(h ^ U(0x5BD1E9955BD1E995)) >> shift).astype(np.int64)


@dataclass
class Places:
    """By place: the words' occurrences, and the neighbours' part of their vector, a byte a dimension in units of 1 / UNIT."""

    n: np.ndarray
    vectors: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        """The less crowded of each word's two places."""
        a, b = _both(h)
        return np.where(self.n[a] <= self.n[b], a, b)


class Neighbours:
    """By place: occurrences, and the sum of their neighbours' index vectors."""

    def __init__(self) -> None:
        self.n = np.zeros(2 * BUCKETS, np.int64)
        self.sums = np.zeros((2 * BUCKETS, DIM), np.int32)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, texts: pa.Array) -> None:
        for _, h, ptr in tokens(texts):
            joined = np.ones(len(h), bool)  # with the word before
            joined[ptr[:-1][ptr[:-1] < len(h)]] = False
            self.held.append((h, joined))
            self.size += len(h)
            if self.size >= WORDS:
                self.flush()

    def flush(self) -> None:
        if self.size:
            h, joined = (np.concatenate(x) for x in zip(*self.held))
            u, at, n = np.unique(h, return_inverse=True, return_counts=True)
            right = np.flatnonzero(joined)
            word, context = np.concatenate([at[right], at[right - 1]]), np.concatenate([at[right - 1], at[right]])
            sums = np.zeros(len(u) * DIM)
            for k in range(NONZERO):
                dim, sign = _nonzero(u, k)
                sums += np.bincount(word * DIM + dim[context], sign[context], len(u) * DIM)
            sums = sums.reshape(-1, DIM).astype(np.int32)
            for places in _both(u):
                order = np.argsort(places, kind="stable")
                first = np.flatnonzero(np.concatenate([[True], np.diff(places[order]) > 0]))
                self.n[places[order[first]]] += np.add.reduceat(n[order], first)
                self.sums[places[order[first]]] += np.add.reduceat(sums[order], first, axis=0)
        self.held, self.size = [], 0


def vectors_of(n: np.ndarray, sums: np.ndarray, all_n: int, all_sums: np.ndarray) -> np.ndarray:
    """The neighbours' part of the words' vectors: the direction in which they differ from all words', of length n / (n + RARE)."""
    mean = sums / np.maximum(n, 1)[:, None] - all_sums / max(1, all_n)
    out = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-6) * (n / (n + RARE))[:, None]
    return np.round(out * (n > 0)[:, None] * UNIT).astype(np.int8)


def _few_bytes(n: np.ndarray) -> np.ndarray:
    return np.minimum(n, (1 << 32) - 1).astype(np.uint32)


def places_of(texts: pa.Array) -> Places:
    x = Neighbours()
    x.add(texts)
    x.flush()
    return Places(_few_bytes(x.n), vectors_of(x.n, x.sums, x.n.sum(), x.sums.sum(0, dtype=np.int64)))


def corpus_places(docs: DataFrame) -> Places:
    """Over all documents. Tasks send sums of the places that they have; what the driver gets is a vector a place, so its size is BUCKETS', not the corpus's."""
    parts = 16
    step = 2 * BUCKETS // parts
    salts = max(1, shuffle_partitions(docs.sparkSession) // parts)  # sums are added up in two steps, so that no task adds those of all others

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, salt = Neighbours(), TaskContext.get().partitionId() % salts
        for b in batches:
            x.add(b.column(0))
        x.flush()
        for p in range(parts):
            own = np.flatnonzero(x.n[p * step : (p + 1) * step])
            if len(own):
                s = x.sums[p * step + own]
                narrow = np.abs(s).max(1) < 128
                for wide, rows in ((False, narrow), (True, ~narrow)):
                    if rows.any():
                        yield packed(p, salt, wide, own[rows], x.n[p * step + own[rows]], s[rows])

    def packed(part: int, salt: int, wide: bool, at: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        """Most words are rare in a task: their sums fit a byte a dimension."""
        cols = (pa.array([part], pa.int32()), pa.array([salt], pa.int32()), pa.array([wide]), pa.array([at.astype(np.int32).tobytes()]), pa.array([n.astype(np.int64).tobytes()]), pa.array([sums.astype(np.int64 if wide else np.int8).tobytes()]))
        return pa.RecordBatch.from_arrays(list(cols), names=["part", "salt", "wide", "at", "n", "sums"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(step, np.int64), np.zeros((step, DIM), np.int64)
        for b in batches:
            for wide, at, k, s in zip(*(b.column(c).to_pylist() for c in ("wide", "at", "n", "sums"))):
                own = np.frombuffer(at, np.int32)
                n[own] += np.frombuffer(k, np.int64)
                sums[own] += np.frombuffer(s, np.int64 if wide else np.int8).reshape(-1, DIM)
        own = np.flatnonzero(n)
        yield packed(key[0].as_py(), 0, True, own, n[own], sums[own])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_pydict({"n": pa.array([int(np.frombuffer(n, np.int64).sum())]), "sums": pa.array([np.frombuffer(s, np.int64).reshape(-1, DIM).sum(0).tolist()])})

    kind = "part int, salt int, wide boolean, at binary, n binary, sums binary"
    found = docs.where("text is not null").select("text").mapInArrow(count, kind).groupBy("part", "salt").applyInArrow(add, kind)
    if salts > 1:
        found = found.groupBy("part").applyInArrow(add, kind)
    found = materialise(found, "neighbours")
    rows = found.select("n", "sums").mapInArrow(total, "n long, sums array<long>").collect()
    all_n, all_sums = sum(r["n"] for r in rows), np.array([r["sums"] for r in rows] or [[0] * DIM]).sum(0)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, at, k, s in zip(*(b.column(c).to_pylist() for c in range(4))):
                n = np.frombuffer(k, np.int64)
                v = vectors_of(n, np.frombuffer(s, np.int64).reshape(-1, DIM), all_n, all_sums)
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "at": pa.array([at]), "n": pa.array([_few_bytes(n).tobytes()]), "vectors": pa.array([v.tobytes()])})

    out = Places(np.zeros(2 * BUCKETS, np.uint32), np.zeros((2 * BUCKETS, DIM), np.int8))
    for p, at, k, v in found.select("part", "at", "n", "sums").mapInArrow(finish, "part int, at binary, n binary, vectors binary").toLocalIterator():
        own = p * step + np.frombuffer(at, np.int32)
        out.n[own] = np.frombuffer(k, np.uint32)
        out.vectors[own] = np.frombuffer(v, np.int8).reshape(-1, DIM)
    discard(found)
    return out


def _kinds() -> np.ndarray:
    """The classes' index vectors, weighted."""
    return index_vectors(np.arange(1, len(CLASSES) + 1, dtype=U) * U(0xC1A55)) * np.float32(CLASS_WEIGHT)


class Model:
    """Class contexts by place, network and temperature; the places themselves travel apart (shared is their broadcast). Without a network every probability is 1."""

    def __init__(self, places: Places | None = None, lift: np.ndarray | None = None):
        self.places, self.lift = places, lift
        self.shared = None
        self.net: tuple[np.ndarray, ...] | None = None
        self.shift = self.scale = None
        self.temperature = 1.0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"places": None, "shared": None}

    def features(self, texts: pa.Array) -> np.ndarray:
        out, kinds = np.zeros((len(texts), 3 * DIM), np.float32), _kinds()
        for i, h, ptr in tokens(texts):
            if not len(h):
                continue
            row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
            key, count = np.unique(row * 2 * BUCKETS + self.places.of(h), return_counts=True)
            row, k = key // (2 * BUCKETS), key % (2 * BUCKETS)
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            who = i + row[first]
            v = self.places.vectors[k] / np.float32(UNIT) + self.lift[k].astype(np.float32) @ kinds
            out[who, DIM : 2 * DIM] = np.maximum.reduceat(v, first, axis=0)
            out[who, 2 * DIM :] = np.minimum.reduceat(v, first, axis=0)
            v *= count[:, None].astype(np.float32)
            out[who, :DIM] = np.add.reduceat(v, first, axis=0) / np.add.reduceat(count, first)[:, None]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.net
        return np.maximum((x - self.shift) / self.scale @ w1 + b1, 0) @ w2 + b2

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.ones(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -60, 60)))


def _network(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, seed: int = 7) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = 3e-3 * (1 - epoch / epochs) + 1e-5
        for lo in range(0, len(x), batch):
            a, b = x[order[lo : lo + batch]], y[order[lo : lo + batch]]
            z = a @ p[0] + p[1]
            h = np.maximum(z, 0)
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - b) / len(b)
            dz = d[:, None] * p[2] * (z > 0)
            t += 1
            for k, g in enumerate((a.T @ dz + 1e-4 * p[0], dz.sum(0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(p)


def fit(texts: pa.Array, classes: np.ndarray, base: Places | None = None) -> Model:
    """classes: positions in CLASSES; base: the places and the neighbours' part of their vectors, by default of these texts. Documents must be in random order: the first half makes the class contexts, the next 40 % the network, the rest the
    temperature. Where that leaves the network fewer than 2 of either kind, or there are fewer than 20 in all, every document makes contexts and network, and the temperature is 1."""
    n = len(classes)
    good = (classes == 2).astype(np.float64)
    if not 0 < good.sum() < n:
        return Model()
    base = places_of(texts) if base is None else base
    a, b = n // 2, n - max(1, n // 10)
    few = n < 20 or min(good[a:b].sum(), (1 - good[a:b]).sum()) < 2
    if few:
        a = b = n
    c = np.zeros((2 * BUCKETS, len(CLASSES)))
    for i, h, ptr in tokens(texts.slice(0, a)):
        row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        held = np.unique(row * 2 * BUCKETS + base.of(h))
        kind = classes[i + held // (2 * BUCKETS)]
        for k in range(len(CLASSES)):
            c[:, k] += np.bincount(held[kind == k] % (2 * BUCKETS), minlength=2 * BUCKETS)
    p = np.maximum(np.bincount(classes[:a], minlength=len(CLASSES)) / max(1, a), 1e-9)
    lift = np.log((c + PRIOR * p) / (c.sum(1, keepdims=True) + PRIOR) / p) * (c.sum(1, keepdims=True) > 1)  # what one document has alone tells nothing of others
    model = Model(base, np.maximum(lift, 0).astype(np.float16))
    del c, lift
    if few:
        a = 0  # the network's documents, up to b
    x = model.features(texts.slice(a))
    model.shift, model.scale = x[: b - a].mean(0), x[: b - a].std(0) + 1e-3
    model.net = _network((x[: b - a] - model.shift) / model.scale, good[a:b])
    z, y = model.logits(x[b - a :]), good[b:]
    if len(y) >= 20:
        grid = np.geomspace(0.25, 8, 60)
        loss = [np.logaddexp(0, -(2 * y - 1) * z / t).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The vectors are the whole corpus's; class contexts, network and temperature are fitted in one task of an executor. What comes to the driver is a vector a place, and the model."""
    q, t = F.min("quality"), F.max("toxic")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias(f"{P}l"))
    known = known.agg(F.when(t == 1, 1).when(q == 1, 2).otherwise(0).alias(f"{P}c"), (F.min("quality") == F.max("quality")).alias(f"{P}a"), (F.min("toxic") == F.max("toxic")).alias(f"{P}b")).where(f"{P}a and {P}b")
    known = known.orderBy(F.xxhash64(f"{P}l"), f"{P}l").limit(sample).select(f"{P}l", f"{P}c")
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias(f"{P}i"), F.col("text").alias(f"{P}t"))
    rows = texts.join(F.broadcast(known), F.col(f"{P}i") == F.col(f"{P}l")).select(F.xxhash64(f"{P}i").alias(f"{P}o"), f"{P}i", f"{P}t", f"{P}c")

    base = docs.sparkSession.sparkContext.broadcast(corpus_places(docs))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(f"{P}o", "ascending"), (f"{P}i", "ascending"), (f"{P}t", "ascending")])
        texts, classes = t[f"{P}t"].combine_chunks(), t[f"{P}c"].to_numpy().astype(np.int64)
        del t
        pa.default_memory_pool().release_unused()
        return pa.table({"model": pa.array([pickle.dumps(fit(texts, classes, base.value))], pa.binary())})

    found = rows.groupBy(F.lit(0).alias(f"{P}g")).applyInArrow(lambda t: run(t), "model binary").collect()
    model = pickle.loads(found[0][0]) if found else Model()
    model.shared = base
    return model


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to the calibrated probability that the document is good."""
    places, shared = model.shared, spark.sparkContext.broadcast(model)

    def start():  # noqa: ANN202
        m = shared.value
        m.places = places.value
        return lambda texts: pa.array(m.probabilities(texts), pa.float64())

    return lambda text: arrow_map(start, "double", text)


def clean(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that the classifier, fitted on those of them that have labels, does not reject."""
    return docs.where(scorer(docs.sparkSession, train(docs, labels, sample))(F.col("text")) >= keep)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and probability of the documents that the classifier keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    p = scorer(spark, train(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", p(F.col("text")).alias("probability")).where(F.col("probability") >= KEEP)
