"""N-gram Jaccard join by token-combination prefixes.

All pairs of documents whose sets of word 3-grams have a Jaccard similarity of at least THETA, exactly. Sets are ordered by one global order: rarest
first. Of a set with s grams at most e = s - ceil(THETA s) can be missing in a partner. If the prefix of a set holds p1 rare grams, and pc grams of each class c of
frequent ones, at least p1 + sum max(0, pc - (k - 1)) of its grams would have to be missing for the pair to share neither a rare gram nor a combination of k grams of a class;
so prefixes are extended until that sum exceeds e, rare grams are indexed singly, frequent ones by combinations of K = 2. Classes of frequent grams number
in proportion to the smaller set's size, so the combinations of a set stay in proportion to its size.

1. Each batch of documents sends its grams, packed, to the partition of their hash; there document frequencies are counted over all documents. Grams of one document alone
   never match: they are not sent on, and a set with more than e of them has no partner and is dropped.
2. What is left goes back, packed, to the batch's own partition and gives the sets (in the shared folder), their prefixes, and so their signatures.
3. Sets that share a signature are linked to one of them; connected sets form a cluster. Each distinct set travels to its cluster, where all pairs are verified by matrix products.
   A cluster of more than CELL sets is cut into blocks by their sizes, and pairs of blocks whose sizes allow the similarity are verified apart.

Links of documents are not sent as pairs: classes() gives a row for each document with its class (all that chains of links connect) and the number of its links, from sums by distinct set. Documents with equal sets are
one set there, with a count, so that thousands of copies cost no more than one.

Defined results: a text of 1 or 2 words has one gram, of all its words; a null text, or one without words, has no set and no partner; a null doc_id takes no part; rows that
repeat a doc_id are no pair with each other (in classes(), such a document has the links of all its different texts, and one class); of equal sets all pairs have similarity 1. Texts may be of any length; an empty table
gives no rows. Sets are told apart by 64 bits; within two sets that are compared, grams by hashes of 40 bits and those of the partition's number, at least 46, so that a pair's overlap is wrong with a
probability of about the product of their sizes over 2^46. Other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, discard, materialise, shuffle_partitions, table
from .components import components, forest
from .textops import U, buffers, mix, ngrams, pieces, words

N = 3
THETA = 0.5
#: A gram in more sets than this is frequent.
FREQUENT = 32
K = 2
#: Grams of a class in a prefix, about.
CLASS_SIZE = 4
#: Most sets of a block in verification.
CELL = 2000
#: Grams and documents of a batch, at most.
BATCH_GRAMS, BATCH_DOCS = 1 << 21, 1 << 15


def pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def gram_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and their rows, sorted by row and gram."""
    gs, rs = [], []
    for i, _, h, ptr in words(texts):
        g, r = ngrams(h, ptr, n)
        order = np.lexsort((g, r))
        g, r = g[order], r[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        gs.append(g[new])
        rs.append(r[new] + i)
    return (np.concatenate(gs), np.concatenate(rs)) if gs else (np.zeros(0, U), np.zeros(0, np.int64))


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def errors(size: np.ndarray | int, theta: float) -> np.ndarray:
    return size - np.maximum(1, np.ceil(np.asarray(size) * theta - 1e-9)).astype(np.int64)


#: Bits of a gram's hash within its partition; they travel as 32 (grams) and 8 (freqs, which on the way back holds frequencies).
BITS = 40
POSTINGS = "part int, batch long, docs binary, ids binary, hashes binary, sizes binary, grams binary, freqs binary"
EMPTY = b""


def _postings(parts: int, n: int):
    """Documents to packed grams by partition, and, to a partition of the batch's, the documents themselves."""
    shift = U(64 - BITS - int(np.log2(parts)))

    def flush(ids: np.ndarray, grams: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        size = np.bincount(row, minlength=len(ids))
        start = np.concatenate([[0], np.cumsum(size)])
        total = np.concatenate([[U(0)], np.cumsum(mix(grams), dtype=U)])
        digest = mix((total[start[1:]] - total[start[:-1]]) ^ (size.astype(U) * U(0x9E3779B97F4A7C15)))
        digest = digest.view(np.int64)
        batch = int(mix(np.array([np.sum(mix(ids.view(U) + digest.view(U) * U(3)), dtype=U) ^ U(len(ids))], U)).view(np.int64)[0])
        grams = grams >> shift
        part = (grams >> U(BITS)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        grams, row = grams[order], row[order].astype(np.uint16)
        low, high = grams.astype(np.uint32), (grams >> U(32)).astype(np.uint8)
        some = np.flatnonzero(np.diff(cut))
        m = len(some)
        cols = {
            "part": pa.array([batch % parts, *some.tolist()], pa.int32()),
            "batch": pa.array([batch] * (m + 1), pa.int64()),
            "docs": pa.array([EMPTY, *(pack(row[cut[p] : cut[p + 1]]) for p in some)], pa.binary()),
            "ids": pa.array([pack(ids)] + [EMPTY] * m, pa.binary()),
            "hashes": pa.array([pack(digest)] + [EMPTY] * m, pa.binary()),
            "sizes": pa.array([pack(size.astype(np.int32))] + [EMPTY] * m, pa.binary()),
            "grams": pa.array([EMPTY, *(pack(low[cut[p] : cut[p + 1]]) for p in some)], pa.binary()),
            "freqs": pa.array([EMPTY, *(pack(high[cut[p] : cut[p + 1]]) for p in some)], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, grams, rows, docs, held = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            return flush(np.concatenate(ids), np.concatenate(grams), np.concatenate(rows))

        for b in batches:
            for lo, hi in [(k, min(k + 1024, y)) for x, y in pieces(buffers(b.column(1))[1], 1 << 22) for k in range(x, y, 1024)]:
                part = b.slice(lo, hi - lo)
                own = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                g, r = gram_sets(part.column(1), n)
                if docs and (docs + len(own) > BATCH_DOCS or held + len(g) > BATCH_GRAMS):
                    yield out()
                    ids, grams, rows, docs, held = [], [], [], 0, 0
                ids.append(own)
                grams.append(g)
                rows.append(r + docs)
                docs, held = docs + len(own), held + len(g)
        if docs:
            yield out()

    return run


def _count(t: pa.Table) -> pa.Table:
    """Of one partition's grams: those in two documents or more, with their frequencies, by batch."""
    batch, docs, grams, high = t["batch"].to_numpy(), t["docs"].to_pylist(), t["grams"].to_pylist(), t["freqs"].to_pylist()
    head = [k for k, g in enumerate(t["sizes"].to_pylist()) if g]
    body = [k for k, g in enumerate(grams) if g]
    rest = t.take(pa.array(head, pa.int64()))
    if not body:
        return rest
    g = np.frombuffer(b"".join(grams[k] for k in body), np.uint32) | np.frombuffer(b"".join(high[k] for k in body), np.uint8).astype(U) << U(32)
    g |= U(t["part"][body[0]].as_py()) << U(BITS)
    d = np.concatenate([np.frombuffer(docs[k], np.uint16) for k in body])
    which = np.repeat(np.arange(len(body)), [len(grams[k]) // 4 for k in body])
    del docs, grams, high
    order = np.argsort(g, kind="stable")
    s = g[order]
    start = _starts(s)
    df = np.diff(np.append(start, len(s)))
    freq = np.empty(len(g), np.uint16)
    freq[order] = np.repeat(np.minimum(df, 65535).astype(np.uint16), df)
    keep = freq > 1
    g, d, which, freq = g[keep], d[keep], which[keep], freq[keep]
    cut = np.searchsorted(which, np.arange(len(body) + 1))
    some = np.flatnonzero(np.diff(cut))
    cols: dict[str, pa.Array] = {
        "part": pa.array(np.zeros(len(some), np.int32)),
        "batch": pa.array(batch[np.array(body)[some]] if len(some) else np.zeros(0, np.int64), pa.int64()),
        **{c: pa.array([EMPTY] * len(some), pa.binary()) for c in ("ids", "hashes", "sizes")},
    }
    for name, a in (("docs", d), ("grams", g), ("freqs", freq)):
        cols[name] = pa.array([pack(a[cut[k] : cut[k + 1]]) for k in some], pa.binary())
    return pa.concat_tables([rest.combine_chunks(), pa.table({c: cols[c] for c in rest.column_names}).cast(rest.schema)])


SETS = "doc_id long, hash long, size int, grams binary, freqs binary"


def _sets(theta: float):
    """A batch's documents that can have a partner, with their grams in the global order."""

    def run(t: pa.Table) -> pa.Table:
        heads = [r for r in t.select(["ids", "hashes", "sizes"]).to_pylist() if r["sizes"]][:1]  # equal batches have equal heads
        nothing = pa.table({"doc_id": pa.array([], pa.int64()), "hash": pa.array([], pa.int64()), "size": pa.array([], pa.int32()), "grams": pa.array([], pa.binary()), "freqs": pa.array([], pa.binary())})
        if not heads:
            return nothing
        ids, hashes, sizes = np.frombuffer(heads[0]["ids"], np.int64), np.frombuffer(heads[0]["hashes"], np.int64), np.frombuffer(heads[0]["sizes"], np.int32)
        d = np.frombuffer(b"".join(t["docs"].to_pylist()), np.uint16)
        g = np.frombuffer(b"".join(t["grams"].to_pylist()), U)
        f = np.frombuffer(b"".join(t["freqs"].to_pylist()), np.uint16)
        order = np.lexsort((g, f, d))
        d, g, f = d[order], g[order], f[order]
        new = np.ones(len(g), bool)  # a batch that occurs twice sends all twice
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        shared = np.bincount(d[new], minlength=len(ids))
        alive = (sizes > 0) & (sizes - shared <= errors(sizes.astype(np.int64), theta))
        ok = new & alive[d]
        d, g, f = d[ok], g[ok], f[ok]
        who = np.flatnonzero(alive)
        cut = np.searchsorted(d, np.append(who, len(ids)))
        return pa.table(
            {
                "doc_id": ids[who], "hash": hashes[who], "size": sizes[who],
                "grams": pa.array([pack(g[cut[k] : cut[k + 1]]) for k in range(len(who))], pa.binary()),
                "freqs": pa.array([pack(f[cut[k] : cut[k + 1]]) for k in range(len(who))], pa.binary()),
            }
        )

    return run


def classes_of(bucket: int, theta: float) -> int:
    """Classes of frequent grams for pairs whose smaller set has 2^bucket to 2^(bucket + 1) - 1 grams. 0: small sets index all grams singly."""
    return 0 if bucket < 3 else max(1, int((1 - theta) * (1 << bucket) / CLASS_SIZE))


def signatures(g: np.ndarray, f: np.ndarray, size: int, theta: float, frequent: int = FREQUENT) -> np.ndarray:
    """Signatures of a set whose shared grams g are in the global order (frequencies f)."""
    free = int(errors(size, theta)) - (size - len(g))  # grams of its own are missing in any partner
    top = size.bit_length() - 1
    low = int(np.ceil(size * theta - 1e-9)).bit_length() - 1
    often = f > frequent
    singles, out = 0, []
    for bucket in range(max(0, low), top + 1):
        m = classes_of(bucket, theta)
        if m == 0 or not often.any():
            singles = max(singles, min(len(g), free + 1))
            if m == 0:
                out.append(mix(g[: min(len(g), free + 1)][often[: min(len(g), free + 1)]]))  # small pairs: single frequent grams
            continue
        first = int(np.argmax(often))  # frequencies ascend: rare grams come first
        cls = (mix(g[first:] ^ U(0xC0FFEE + bucket)) % U(m)).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        nth = np.empty(len(cls), np.int64)
        start = np.searchsorted(cls[order], np.arange(m))
        nth[order] = np.arange(len(cls)) - start[cls[order]]
        gain = np.concatenate([np.ones(first, np.int64), (nth >= K - 1).astype(np.int64)])
        end = int(np.searchsorted(np.cumsum(gain), free + 1)) + 1
        singles = max(singles, min(first, end))
        n = max(0, min(end, len(g)) - first)
        if n < K:
            continue
        cls, own = cls[:n], g[first : first + n]
        order = np.argsort(cls, kind="stable")
        cut = np.append(_starts(cls[order]), n)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= K:
                x = np.sort(own[order[a:b]])
                i, j = np.triu_indices(b - a, 1)
                out.append(mix(mix(x[i] + U(bucket + 1)) ^ x[j]))
    out.append(mix(g[:singles][~often[:singles]]))
    return np.unique(np.concatenate(out))


def _signature_rows(theta: float, parts: int):
    shift = U(64 - int(np.log2(parts))) if parts > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, node, size = [], [], []
            for h, s, g, f in zip(b.column("hash").to_pylist(), b.column("size").to_pylist(), b.column("grams").to_pylist(), b.column("freqs").to_pylist()):
                x = signatures(np.frombuffer(g, U), np.frombuffer(f, np.uint16), s, theta)
                sig.append(x)
                node.append(np.full(len(x), h, np.int64))
                size.append(np.full(len(x), s, np.int32))
            if not sig:
                continue
            x, n, z = np.concatenate(sig), np.concatenate(node), np.concatenate(size)
            p = (x >> shift).astype(np.int64) if shift is not None else np.zeros(len(x), np.int64)
            order = np.argsort(p, kind="stable")
            cut = np.searchsorted(p[order], np.arange(parts + 1))
            x, n, z = x[order], n[order], z[order]
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), **{c: pa.array([pack(a[cut[k] : cut[k + 1]]) for k in some], pa.binary()) for c, a in (("sig", x), ("node", n), ("size", z))}})

    return run


def _links(theta: float):
    """Sets that share a signature, and whose sizes allow the similarity, as a forest."""

    def run(t: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), U)
        node = np.frombuffer(b"".join(t["node"].to_pylist()), np.int64)
        size = np.frombuffer(b"".join(t["size"].to_pylist()), np.int32)
        order = np.lexsort((node, size, sig))
        sig, node, size = sig[order], node[order], size[order]
        # within a signature sizes ascend: neighbours too far apart in size separate all before from all after
        near = (sig[1:] == sig[:-1]) & (size[:-1] >= theta * size[1:] - 1e-9) & (node[1:] != node[:-1])
        pair = np.unique(np.stack([node[1:][near], node[:-1][near]], 1), axis=0) if near.any() else np.zeros((0, 2), np.int64)
        a, b = forest(pair[:, 0], pair[:, 1])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def similar(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (one of left, one of right; if both are the same, i < j) of sets of shared grams, and their similarity, verified in full."""
    same = left is right
    if same and len(left) == 2:
        i, j = left.tolist()
        o = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        s = o / (sizes[i] + sizes[j] - o)
        ok = s >= theta - 1e-12
        return (np.array([i]), np.array([j]), np.array([s])) if ok else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    who = left if same else np.concatenate([left, right])
    g = np.concatenate([sets[k] for k in who])
    row = np.repeat(np.arange(len(who)), [len(sets[k]) for k in who])
    order = np.argsort(g, kind="stable")
    g, row = g[order], row[order]
    start = _starts(g)
    col = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(g))))
    many = np.diff(np.append(start, len(g))) > 1
    new = np.cumsum(many) - 1
    ok = many[col]
    col, row = new[col[ok]], row[ok]
    n = len(left)
    overlap = np.zeros((n, len(who) if same else len(right)), np.float32)
    width = max(256, min(4096, (1 << 24) // max(1, len(who))))
    for lo in range(0, int(many.sum()), width):
        i, j = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(who), width), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        overlap += m[:n] @ (m if same else m[n:]).T
    sa, sb = sizes[left].astype(np.float64), sizes[left if same else right].astype(np.float64)
    s = overlap / (sa[:, None] + sb[None, :] - overlap)
    hit = s >= theta - 1e-12
    if same:
        hit &= np.triu(np.ones_like(hit), 1).astype(bool)
    i, j = np.nonzero(hit)
    return left[i], (left if same else right)[j], s[i, j]


def _verify(theta: float):
    """The similar pairs of documents in the cells of one partition."""

    def cell(t: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        hashes, ids, half = t["hash"].to_numpy(), t["doc_id"].to_numpy(), t["half"].to_numpy()
        u, first, node = np.unique(hashes, return_index=True, return_inverse=True)
        sizes, side = t["size"].to_numpy()[first], half[first]
        sets = [np.sort(np.frombuffer(b, U)) for b in t["grams"].take(pa.array(first)).to_pylist()]
        order = np.argsort(node, kind="stable")
        cut = np.searchsorted(node[order], np.arange(len(u) + 1))
        members = [np.unique(ids[order[cut[k] : cut[k + 1]]]) for k in range(len(u))]
        split = t["x"][0].as_py() != t["y"][0].as_py()
        every = np.arange(len(u))
        left, right = (every[side == 0], every[side == 1]) if split else (every, every)
        if len(left) == 0 or len(right) == 0:
            return [], [], []
        a, b, c = [], [], []
        if len(u) > 1:
            for x, y, z in zip(*(v.tolist() for v in similar(sets, sizes, left, right if split else left, theta))):
                m, n = members[x], members[y]
                a.append(np.repeat(m, len(n)))
                b.append(np.tile(n, len(m)))
                c.append(np.full(len(m) * len(n), z))
        for k in () if split else np.flatnonzero(np.diff(cut) > 1):  # equal sets
            x, y = np.triu_indices(len(members[k]), 1)
            a.append(members[k][x])
            b.append(members[k][y])
            c.append(np.ones(len(x)))
        return a, b, c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_cell(batches):
            a, b, c = cell(t)
            if not a:
                continue
            a, b, c = np.concatenate(a), np.concatenate(b), np.concatenate(c)
            ok = a != b
            a, b, c = np.minimum(a, b)[ok], np.maximum(a, b)[ok], c[ok]
            for lo in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (a, b, c)], names=["doc_a", "doc_b", "jaccard"])

    return run


CELLS = "cluster long, x long, y long, half int"


def _counted(theta: float):
    """The distinct sets of a block, or of a pair of blocks: for each with a link, the documents that it is linked with (a = b), and a forest of the links (a, b)."""

    def cell(t: pa.Table) -> pa.RecordBatch | None:
        hashes, sizes, many, half = (t[c].to_numpy() for c in ("hash", "size", "copies", "half"))
        sets = [np.sort(np.frombuffer(g, U)) for g in t["grams"].to_pylist()]
        split = t["x"][0].as_py() != t["y"][0].as_py()
        every = np.arange(len(sets))
        left, right = (every[half == 0], every[half == 1]) if split else (every, every)
        if len(left) == 0 or len(right) == 0 or len(sets) < 2:
            return None
        i, j, _ = similar(sets, sizes, left, right if split else left, theta)
        links = np.bincount(i, many[j], len(sets)) + np.bincount(j, many[i], len(sets))
        some = np.flatnonzero(links)
        a, b = forest(hashes[i], hashes[j])
        return pa.RecordBatch.from_pydict({"a": np.concatenate([hashes[some], a]), "b": np.concatenate([hashes[some], b]), "links": np.concatenate([links[some], np.zeros(len(a))]).astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_cell(batches):
            if (found := cell(t)) is not None and found.num_rows:
                yield found

    return run


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches, cut into the rows of each cell."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        cells = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "x", "y")], 1)
        cut = [0, *(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), len(cells)]
        for i, j in zip(cut, cut[1:]):
            if i == j:
                continue
            if held and tuple(cells[i]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tuple(cells[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _prepared(docs: DataFrame, theta: float, n: int) -> tuple[DataFrame, DataFrame]:
    """Sets that may have a partner, in the shared folder, and hash, component: those of them whose signatures connect them."""
    p = shuffle_partitions(docs.sparkSession)
    parts = 1 << int(np.ceil(np.log2(max(16, 4 * p))))
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    packed = rows.mapInArrow(_postings(parts, n), POSTINGS)
    counted = packed.groupBy("part").applyInArrow(lambda t: _count(t), POSTINGS)
    sets = materialise(counted.groupBy("batch").applyInArrow(_sets(theta), SETS), "sets")
    signed = sets.mapInArrow(_signature_rows(theta, parts), "part int, sig binary, node binary, size binary")
    links = materialise(signed.groupBy("part").applyInArrow(_links(theta), "a long, b long").distinct(), "links")
    found = components(links)
    discard(links)
    return sets, found


def _placed(nodes: DataFrame, theta: float, cell: int) -> DataFrame:
    """nodes: hash, size, cluster, distinct. Adds the cells that each is verified in: CELLS. Blocks are of one binary order of size; sizes further apart than theta allows never meet."""
    order = F.floor(F.log2("size")).cast("int")
    reach = int(np.ceil(np.log2(1 / theta) - 1e-9)) if theta > 0 else 31
    blocks = nodes.groupBy("cluster", order.alias("o")).agg(F.count("*").alias("n")).withColumn("k", F.ceil(F.col("n") / cell).cast("int"))
    blocks = blocks.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("o", "k"))).alias("blocks"), F.sum("n").alias("all"))  # at most 31 orders
    at = nodes.withColumn("o", order).join(blocks, "cluster")
    whole = F.col("all") <= cell
    own = F.when(whole, 0).otherwise(F.col("o") * (1 << 32) + F.pmod(F.xxhash64("hash"), F.col("blocks")[F.col("o")]))
    near = F.filter(F.transform(F.sequence(F.col("o") - reach, F.col("o") + reach), lambda o: F.struct(o.alias("o"), F.col("blocks")[o].alias("k"))), lambda s: s["k"].isNotNull())
    others = F.flatten(F.transform(near, lambda s: F.transform(F.sequence(F.lit(0), s["k"] - 1), lambda k: s["o"] * F.lit(1 << 32) + k)))
    at = at.withColumn("own", own.cast("long")).withColumn("other", F.explode(F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(others)))
    return at.select(*nodes.columns, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("half"))


def similar_documents(docs: DataFrame, theta: float = THETA, n: int = N, cell: int = CELL) -> DataFrame:
    """doc_a < doc_b, jaccard: all pairs, each once. Groups of copies give all their pairs here; classes() says the same in a row for each document."""
    sets, found = _prepared(docs, theta, n)
    light = sets.groupBy("hash", "size").agg(F.count("*").alias("n")).join(found, F.col("hash") == F.col("node"), "left")
    # sets alone in their cluster have no partner, unless another document has the same set
    light = light.where("component is not null or n > 1").select("hash", "size", F.coalesce("component", "hash").alias("cluster"))
    placed = _placed(light, theta, cell).withColumnsRenamed({"hash": f"{P}h"}).drop("size")
    members = sets.drop("freqs").join(placed, F.col("hash") == F.col(f"{P}h")).drop(f"{P}h")
    return members.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").mapInArrow(_verify(theta), "doc_a long, doc_b long, jaccard double")


def classes(docs: DataFrame, theta: float = THETA, n: int = N, cell: int = CELL) -> DataFrame:
    """doc_id, class_id, n_links for each distinct doc_id: the smallest doc_id that links connect it with (or its own), and the number of documents whose similarity with it is theta or more."""
    sets, found = _prepared(docs, theta, n)
    ids = materialise(sets.select("doc_id", "hash").distinct(), "ids")
    copies = ids.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"))
    light = sets.select("hash", "size").distinct().join(copies, "hash").join(found.withColumnRenamed("node", "hash").withColumnRenamed("component", "cluster"), "hash")
    light = materialise(_placed(light, theta, cell), "placed")
    # each distinct set once: what is joined by hash lies by hash
    grams = sets.select(F.col("hash").alias(f"{P}h"), "grams").join(light.select("hash").distinct(), F.col(f"{P}h") == F.col("hash"), "left_semi").groupBy(f"{P}h").agg(F.first("grams").alias("grams"))
    members = grams.join(light, F.col(f"{P}h") == F.col("hash")).drop(f"{P}h", "low")
    linked = members.repartition("cluster", "x", "y").sortWithinPartitions("cluster", "x", "y").mapInArrow(_counted(theta), "a long, b long, links long")
    linked = materialise(linked, "links")
    discard(sets, light)
    joined = components(linked.where("a <> b").select("a", "b"))
    each = ids.join(copies, "hash").join(linked.where("a = b").groupBy(F.col("a").alias("hash")).agg(F.sum("links").alias("links")), "hash", "left")
    each = each.join(joined.withColumnRenamed("node", "hash"), "hash", "left").withColumn("component", F.coalesce("component", "hash"))
    lowest = each.groupBy("component").agg(F.min("low").alias("lowest"))
    each = each.join(lowest, "component").select(F.col("doc_id").alias(f"{P}i"), "lowest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    each = each.groupBy(f"{P}i").agg(F.min("lowest").alias("lowest"), F.sum("links").alias("links"))
    every = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = every.join(each, F.col("doc_id") == F.col(f"{P}i"), "left")
    return rows.select("doc_id", F.coalesce("lowest", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, but of each class of near duplicates only those with the smallest doc_id."""
    gone = materialise(classes(docs, **how).where("class_id <> doc_id").select(F.col("doc_id").alias(f"{P}gone")), "gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(f"{P}gone"), "left_anti")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its class of documents connected by Jaccard similarities of THETA or more, and the number of its links."""
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pairs_sql(docs: str = "documents") -> str:
    """CTEs up to pairs(doc_a, doc_b, jaccard)."""
    return f"""words AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {docs} WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, CAST(len(w) - {N - 2} AS BIGINT)), lambda i: array_to_string(w[i : i + {N - 1}], ' ')) END) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT doc_a, doc_b, o / CAST(x.n + y.n - o AS DOUBLE) AS jaccard FROM shared JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b WHERE o >= {THETA} * (x.n + y.n - o))"""


def classes_sql(docs: str = "documents") -> str:
    """CTEs up to classes(doc_id, class_id, n_links), for WITH RECURSIVE."""
    return f"""{pairs_sql(docs)},
e AS (SELECT doc_a AS a, doc_b AS b FROM pairs UNION ALL SELECT doc_b, doc_a FROM pairs),
reach(doc_id, other) AS (SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.other = e.a),
low AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id), links AS (SELECT a, count(*) AS n FROM e GROUP BY a),
classes AS (SELECT d.doc_id, least(d.doc_id, coalesce(low, d.doc_id)) AS class_id, coalesce(n, 0) AS n_links FROM (SELECT DISTINCT doc_id FROM {docs} WHERE doc_id IS NOT NULL) d LEFT JOIN low USING (doc_id) LEFT JOIN links ON a = d.doc_id)"""


OP1_SQL = f"WITH RECURSIVE {classes_sql()} SELECT doc_id, class_id, n_links FROM classes"
