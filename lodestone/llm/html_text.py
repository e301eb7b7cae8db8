"""HTML extraction: text of web pages without their host's boilerplate.

A page's tags, comments, scripts and styles are dropped, entities resolved, the rest is split into tokens at white space. The token streams of all pages are concatenated to
batches of about BATCH tokens (a page is never cut) and kept in the shared folder. The suffixes of a host's streams are sorted by their leading REPEAT tokens, in the order of the tokens'
hashes: a suffix array, to the depth of REPEAT tokens. Order beyond that depth would not change what is covered: a repeated substring of REPEAT tokens or more is the union of its windows of REPEAT.
No host needs a single task, whatever its size, and every host is treated alike:

1. Each batch sorts its own suffixes and sends them, as gaps of truncated hashes, to partitions by range of the order. There the sorted runs of all batches are merged; a suffix
   whose leading tokens no other batch has is told apart. Hashes have SPARE bits beyond what numbers the corpus's suffixes, so about 1 of 2^SPARE is taken for repeated here.
2. Only suffixes that may be repeated (by another batch, or by two pages of this one) are sent again, once for each batch, with 96 bits of their leading tokens' hash, the number of pages that have them and the
   host's support. The merged runs say which are removed.
3. Each batch covers REPEAT tokens from each such suffix on; tokens that are covered are boilerplate, the unique runs between them stay.

What only few pages of a host share may as well be an article under several URLs, or a phrase: with a share, runs on fewer than max(3, share of the host's pages) pages stay on the first of
them, in the table's order, so that no text is lost to the host. op4_page_texts has SHARE.

Defined results: a null html gives a null text, one without tokens an empty text; a page shorter than REPEAT tokens keeps all of them; an empty table gives an empty one. The host is the URL's, lower case, or empty
if there is none (pages without a URL share that host); repeats within one page alone are kept; rows that repeat a page_id are pages of their own, so equal pages remove each other's tokens (with a
share, where they are few, all but the first's); a null page_id is carried through. A page may be of any length. Other columns, whatever their names, are not touched. Leading tokens are compared by 96 bits of hash.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_path, scratch_root, shuffle_partitions, table
from .textops import U, buffers, hash_spans, mix

REPEAT = 6
SHARE = 0.02
#: Tokens of a batch, about; bounds the memory of a task, nothing else.
BATCH = 1 << 20
SPARE = 7
#: Bytes of text that are hashed at once.
PIECE = 1 << 21

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[!/?]?[A-Za-z](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>?|</?>")


def tokens_of(page: str) -> list[str]:
    """Tokens of a page's text."""
    return html.unescape(_TAG.sub(" ", _DROP.sub(" ", page))).split()


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def support(pages: int, share: float) -> int:
    """Pages from which on a repeated run is removed from all of them."""
    return max(3, math.ceil(share * pages)) if share else 2


BATCHES = "batch long, n long, windows long, page_ids array<long>, hosts array<string>, texts array<string>"


def _batches(most: int, depth: int):
    """Pages to rows of a batch each. A batch's number follows the table's order."""

    def run(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        ids, hosts, texts, n, windows, k = [], [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            cols = [pa.array([first + k], pa.int64()), pa.array([n], pa.int64()), pa.array([windows], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([hosts], pa.list_(pa.string())), pa.array([texts], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=["batch", "n", "windows", "page_ids", "hosts", "texts"])

        for b in pages:
            for i in range(b.num_rows):
                page = b.column(2)[i].as_py()
                tokens = tokens_of(page) if page else []
                if ids and n + len(tokens) > most:
                    yield out()
                    ids, hosts, texts, n, windows, k = [], [], [], 0, 0, k + 1
                ids.append(b.column(0)[i].as_py())
                hosts.append(b.column(1)[i].as_py())
                texts.append(None if page is None else " ".join(tokens))
                n, windows = n + len(tokens), windows + max(0, len(tokens) - depth + 1)
        if ids:
            yield out()

    return run


def _spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens (between single spaces), and the rows' token offsets."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    full = raw != 32
    edge = np.ones(len(raw) + 1, bool)
    np.not_equal(full[1:], full[:-1], out=edge[1:-1])
    edge[off] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    some = full[starts]
    starts, ends = starts[some], ends[some]
    return starts, ends, np.searchsorted(starts, off)


def _token_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, lo = np.empty(len(starts), U), 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, "right")))
        base = starts[lo]
        out[lo:hi] = hash_spans(raw[base : ends[hi - 1]], starts[lo:hi] - base, ends[lo:hi] - base, fold=False)
        lo = hi
    return out


class Suffixes:
    """The suffixes of a batch that have `depth` tokens or more before their page ends: their places, pages, and 96 bits of their leading tokens' hash."""

    def __init__(self, hosts: pa.Array, texts: pa.Array, depth: int):
        raw, off = buffers(texts)
        self.raw, (self.starts, self.ends, self.ptr) = raw, _spans(raw, off)
        h = _token_hashes(raw, self.starts, self.ends)
        size = np.diff(self.ptr)
        row = np.repeat(np.arange(len(size), dtype=np.int32), size)
        at = np.flatnonzero(np.repeat(self.ptr[1:], size) - np.arange(len(h)) >= depth)
        raw, off = buffers(hosts)
        own = mix(hash_spans(raw, off[:-1], off[1:], fold=False) + U(1)) if len(off) > 1 else np.zeros(0, U)
        self.at, self.page = at, row[at]
        w = own[self.page]
        x = np.zeros(len(at), np.uint32)
        for k in range(depth):
            part = h[at + k]
            w = mix(w + part * U(2 * k + 3))
            x = x * np.uint32(0x85EBCA6B) + (part >> U(29)).astype(np.uint32)
        self.w, self.x = w, x


def _fit(n: int, bits: int) -> int:
    """Low bits of n sorted numbers of that many bits, in Elias and Fano's code."""
    return max(0, bits - max(0, int(n).bit_length() - 1))


def encode(v: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Sorted numbers below 2^bits: low bits, and a bit vector of the gaps of the high ones."""
    low = _fit(len(v), bits)
    shifts = np.arange(low, dtype=U)
    packed = np.packbits(((v[:, None] >> shifts) & U(1)).astype(bool), axis=None).tobytes() if low else b""
    high = (v >> U(low)).astype(np.int64)
    gaps = np.zeros(int(high[-1]) + len(v), bool)
    gaps[high + np.arange(len(v))] = True
    return packed, np.packbits(gaps).tobytes()


def decode(n: int, packed: bytes, gaps: bytes, bits: int) -> np.ndarray:
    low = _fit(n, bits)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(gaps, np.uint8)))[:n] - np.arange(n)
    v = high.astype(U) << U(low)
    if low:
        m = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * low).reshape(n, low)
        for k in range(low):
            v |= m[:, k].astype(U) << U(k)
    return v


def _new(v: np.ndarray) -> np.ndarray:
    """Where sorted numbers differ from the one before."""
    new = np.ones(len(v), bool)
    np.not_equal(v[1:], v[:-1], out=new[1:])
    return new


def _distinct(v: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted. np.unique goes by a hash table: 0.73 s for a batch that is sorted in 0.01 s (numpy 2.3)."""
    v = np.sort(v)
    return v[_new(v)]


def _ids(distinct: np.ndarray, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the partitions cut sorted hashes of that many bits, and the partitions that have some."""
    p = (distinct >> U(bits - int(math.log2(parts)))).astype(np.int64)
    cut = np.searchsorted(p, np.arange(parts + 1))
    return cut, np.flatnonzero(np.diff(cut))


RUNS = "part int, batch long, n int, low binary, high binary"


def _runs(depth: int, bits: int, parts: int):
    """Batches to the sorted hashes of their suffixes, by partition."""
    rest = bits - int(math.log2(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = Suffixes(b.column(1)[i].values, b.column(2)[i].values, depth)
                u = _distinct(s.w >> U(64 - bits))
                cut, some = _ids(u, bits, parts)
                u &= U((1 << rest) - 1)
                codes = [encode(u[cut[p] : cut[p + 1]], rest) for p in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([b.column(0)[i].as_py()] * len(some), pa.int64()), pa.array(np.diff(cut)[some], pa.int32()), pa.array([c[0] for c in codes], pa.binary()), pa.array([c[1] for c in codes], pa.binary())],
                    names=["part", "batch", "n", "low", "high"],
                )

    return run


def _repeated(bits: int, parts: int):
    """Of one partition's sorted runs: by batch, a bit for each hash, set if another batch has it too."""
    rest = bits - int(math.log2(parts))

    def run(t: pa.Table) -> pa.Table:
        n = t["n"].to_numpy()
        v = np.concatenate([decode(k, a, b, rest) for k, a, b in zip(n.tolist(), t["low"].to_pylist(), t["high"].to_pylist())])
        order = np.argsort(v, kind="stable")
        s = v[order]
        same = s[1:] == s[:-1]  # a batch has each hash once
        hit = np.zeros(len(v), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        cut = np.concatenate([[0], np.cumsum(n)])
        some = np.flatnonzero(np.add.reduceat(hit, cut[:-1]))
        bits_ = [np.packbits(hit[cut[k] : cut[k + 1]]).tobytes() for k in some]
        return pa.table({"part": t["part"].take(pa.array(some)), "batch": t["batch"].take(pa.array(some)), "hit": pa.array(bits_, pa.binary())})

    return run


def _groups(s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of a batch: the suffixes in the order of their leading tokens' hash, each group's start in it, size, and number of distinct pages."""
    order = np.argsort(s.w, kind="stable")
    w, page = s.w[order], s.page[order]
    start = np.flatnonzero(_new(w))
    new = np.ones(len(w), np.int32)  # within a group the order is by place, so pages ascend
    new[1:] = page[1:] != page[:-1]
    new[start] = 1
    return order, start, np.diff(np.append(start, len(w))), np.add.reduceat(new, start) if len(start) else new


def _may(s: Suffixes, hits: pa.Scalar, bits: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array's order, groups and numbers of pages, and the groups that may be repeated: by two pages of the batch or, as _repeated said, by another batch."""
    order, start, size, pages = _groups(s)
    top = s.w[order[start]] >> U(64 - bits)
    new = _new(top)
    cut, _ = _ids(top[new], bits, parts)
    hit = np.zeros(int(cut[-1]), bool)
    for p, x in zip(*(hits.values.field(k).to_pylist() for k in (0, 1))) if hits.is_valid else ():
        hit[cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=int(cut[p + 1] - cut[p]))
    return order, start, size, pages, (pages > 1) | hit[np.cumsum(new) - 1]


def _small(a: np.ndarray) -> bytes:
    """Counts, in as few bytes each as the greatest needs."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if int(a.max(initial=0)) <= np.iinfo(k).max)
    return a.astype(kind).tobytes()


def _counts(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(raw) // n]).astype(np.int64)


CANDIDATES = "part int, batch long, n int, low binary, high binary, x binary, pages binary, least binary"


def _candidates(depth: int, bits: int, parts: int, share: float):
    """Batches with what _repeated said of them, and the sizes of their hosts, to the suffixes that may be repeated."""
    rest = 64 - int(math.log2(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hosts = b.column(1)[i].values
                s = Suffixes(hosts, b.column(2)[i].values, depth)
                order, start, _, pages, may = _may(s, b.column(3)[i], bits, parts)
                first = order[start][may]
                w, x, pages = s.w[first], s.x[first], pages[may]
                known = dict(zip(*(b.column(4)[i].values.field(k).to_pylist() for k in (0, 1))))
                least = np.array([support(known[h], share) for h in hosts.to_pylist()], np.int64)[s.page[first]]
                cut, some = _ids(w, 64, parts)
                w &= U((1 << rest) - 1)
                codes = [encode(w[cut[p] : cut[p + 1]], rest) for p in some]
                pack = lambda a, f: pa.array([f(a[cut[p] : cut[p + 1]]) for p in some], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([b.column(0)[i].as_py()] * len(some), pa.int64()), pa.array(np.diff(cut)[some], pa.int32()), pa.array([c[0] for c in codes], pa.binary()), pa.array([c[1] for c in codes], pa.binary()), pack(x, np.ndarray.tobytes), pack(pages, _small), pack(least, _small)],
                    names=["part", "batch", "n", "low", "high", "x", "pages", "least"],
                )

    return run


def _decide(parts: int):
    """Of one partition's candidates: by batch, in their order, a bit for those removed from all its pages, and for those that stay on the first."""
    rest = 64 - int(math.log2(parts))

    def run(t: pa.Table) -> pa.Table:
        n, batch = t["n"].to_numpy(), t["batch"].to_numpy()
        w = np.concatenate([decode(k, a, b, rest) for k, a, b in zip(n.tolist(), t["low"].to_pylist(), t["high"].to_pylist())])
        x = np.frombuffer(b"".join(t["x"].to_pylist()), np.uint32)
        pages, least = (np.concatenate([_counts(a, k) for a, k in zip(t[c].to_pylist(), n.tolist())]) for c in ("pages", "least"))
        which = np.repeat(np.arange(len(t)), n)
        order = np.lexsort((batch[which], x, w))
        w, x, pages, least = w[order], x[order], pages[order], least[order]
        start = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (x[1:] != x[:-1])]))
        size = np.diff(np.append(start, len(w)))
        total = np.repeat(np.add.reduceat(pages, start), size)
        first = np.zeros(len(w), bool)
        first[start] = True
        stays = (total > 1) & (total < least) & first
        gone, few = np.zeros(len(w), bool), np.zeros(len(w), bool)
        gone[order] = (total > 1) & ~stays
        few[order] = stays & (pages > 1)  # a first page alone in its batch needs no word
        cut = np.concatenate([[0], np.cumsum(n)])
        some = np.flatnonzero(np.add.reduceat(gone | few, cut[:-1]))
        bits = lambda a: pa.array([np.packbits(a[cut[k] : cut[k + 1]]).tobytes() for k in some], pa.binary())
        return pa.table({"part": t["part"].take(pa.array(some)), "batch": t["batch"].take(pa.array(some)), "gone": bits(gone), "few": bits(few)})

    return run


RESULT = "page_id long, host string, text string, n_tokens long, n_removed long"


def _cut(depth: int, bits: int, parts: int):
    """Batches with what _repeated and _decide said of them to the pages' texts."""

    def one(ids: pa.Array, hosts: pa.Array, texts: pa.Array, hits: pa.Scalar, said: pa.Scalar) -> pa.RecordBatch:
        s = Suffixes(hosts, texts, depth)
        n = len(s.starts)
        covered = np.zeros(n, bool)
        if said.is_valid and n:
            order, start, size, _, may = _may(s, hits, bits, parts)
            cut, _ = _ids(s.w[order[start]][may], 64, parts)
            flags = np.zeros((2, int(cut[-1])), bool)
            for p, *both in zip(*(said.values.field(k).to_pylist() for k in (0, 1, 2))):
                for k, x in enumerate(both):
                    flags[k, cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=int(cut[p + 1] - cut[p]))
            gone, few = np.zeros((2, len(start)), bool)
            gone[may], few[may] = flags
            page = s.page[order]
            mark = np.repeat(gone, size) | np.repeat(few, size) & (page != np.repeat(page[start], size))
            at = s.at[order[mark]]
            delta = np.zeros(n + 1, np.int32)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + depth, -1)
            covered = np.cumsum(delta[:-1]) > 0
        total = np.diff(s.ptr)
        removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[s.ptr])
        # a token's bytes and the space after it; of what is left of a row, the last space goes
        keep = np.repeat(~covered, np.diff(np.append(s.starts, len(s.raw)))) if n else np.zeros(0, bool)
        left = np.concatenate([[0], np.cumsum(keep)])
        _, off = buffers(texts)
        raw = s.raw[keep].tobytes()
        valid = texts.is_valid().to_pylist()
        out = []
        for k, (a, b) in enumerate(zip(left[off[:-1]].tolist(), left[off[1:]].tolist())):
            out.append(raw[a:b].rstrip(b" ").decode() if valid[k] else None)
        none = ~np.array(valid, bool)
        return pa.RecordBatch.from_arrays([ids, hosts, pa.array(out, pa.string()), pa.array(total, pa.int64(), mask=none), pa.array(removed, pa.int64(), mask=none)], names=["page_id", "host", "text", "n_tokens", "n_removed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield one(*(b.column(k)[i].values for k in (0, 1, 2)), b.column(3)[i], b.column(4)[i])

    return run


def _stored(batches: DataFrame, buckets: int) -> DataFrame:
    """Batches in the shared folder, compressed, in buckets by their number: what is said of them is brought to them, and they are never shuffled."""
    spark, name = batches.sparkSession, f"lodestone_pages_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    batches.write.format("parquet").option("path", path).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "7").bucketBy(buckets, "batch").saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # noqa: B018 it is resolved before the name goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return keep_path(stored, path)


def page_texts(pages: DataFrame, repeat: int = REPEAT, batch: int = BATCH, share: float = 0.0, spare: int = SPARE) -> DataFrame:
    """pages: page_id, url, html. share: of the host's pages that a run must stand on to be removed from all; 0: any two. A row for each: page_id, host, text without boilerplate, n_tokens before, n_removed."""
    if repeat < 2:
        raise ValueError("repeat must be 2 or more")
    spark = pages.sparkSession
    p = shuffle_partitions(spark)
    parts = 1 << max(2, math.ceil(math.log2(2 * p)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), "html")
    stored = _stored(rows.mapInArrow(_batches(batch, repeat), BATCHES), 2 * p)
    windows = stored.agg(F.sum("windows")).first()[0] or 0
    bits = min(64, max(int(math.log2(parts)) + 1, int(windows).bit_length() + spare))
    texts = stored.select("batch", "hosts", "texts")
    hit = texts.mapInArrow(_runs(repeat, bits, parts), RUNS).groupBy("part").applyInArrow(_repeated(bits, parts), "part int, batch long, hit binary")
    hit = hit.groupBy("batch").agg(F.collect_list(F.struct("part", "hit")).alias("hits"))
    own = stored.select("batch", F.explode(F.array_distinct("hosts")).alias("host"))
    sizes = stored.select(F.explode("hosts").alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    sizes = own.join(sizes, "host").groupBy("batch").agg(F.collect_list(F.struct("host", "pages")).alias("sizes"))
    said = texts.join(hit, "batch", "left").join(sizes, "batch").select("batch", "hosts", "texts", "hits", "sizes").mapInArrow(_candidates(repeat, bits, parts, share), CANDIDATES)
    said = said.groupBy("part").applyInArrow(_decide(parts), "part int, batch long, gone binary, few binary")
    said = said.groupBy("batch").agg(F.collect_list(F.struct("part", "gone", "few")).alias("said"))
    return stored.join(hit, "batch", "left").join(said, "batch", "left").select("page_ids", "hosts", "texts", "hits", "said").mapInArrow(_cut(repeat, bits, parts), RESULT)


def op4_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"), share=SHARE)
