"""Exact dedup against a history of distinct digests held in minimal perfect hashes.

The history is cut into shards by the digest's leading bits. Each shard is one row: a minimal perfect hash (levels of bit vectors with
ranks), and, by its slots, full 32-byte digests and the winners' locators (the smallest doc_id that had the text). A hash of this kind
gives a nonmember an arbitrary slot, so a lookup counts only if all 32 bytes agree. Members other than the winner are repeats;
nonmembers are grouped among themselves, apart from the history.

The history may be stored (history_of) or part of the table itself: op5_exact_dedup and the pipeline take the sources whose MD5 begins with 0 to 7 for the earlier ones (historic()). Their distinct digests make the hash,
in which all rows are then looked up: an earlier source's winner stays, whatever later sources hold; texts that no earlier source has are grouped by themselves.

Defined results: texts are equal if their UTF-8 bytes are; the smallest doc_id of a group stays, a null doc_id only if the group has no other; of rows
equal in doc_id and text one stays; an empty text is a text like others; a null text is no text: such rows all stay. Other columns, whatever
their names, are carried along. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, discard, materialise, table
from .textops import U, mix

KEYS_PER_SHARD = 1 << 17
GAMMA = 2.0
WIDTH = 32


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: at each level a key takes a bit of its own or goes on to the next; its slot is its bit's rank."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = []
        n = 0
        for bits in levels:
            self.ranks.append(n + np.cumsum(bits) - bits)
            n += int(bits.sum())
        self.n = n

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < 64:
            size = max(8, int(len(left) * GAMMA))
            at = cls._at(left, len(levels), size)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            left = left[~bits[at]]
        return cls(levels, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self._at(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.ranks[level][at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            k = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            hit = self.rest[k] == keys[open_]
            out[open_[hit]] = self.n + k[hit]
        return out

    def dump(self) -> tuple[bytes, bytes, bytes]:
        sizes = np.array([len(b) for b in self.levels], np.int64).tobytes()
        return sizes, b"".join(np.packbits(b).tobytes() for b in self.levels), self.rest.tobytes()

    @classmethod
    def load(cls, sizes: bytes, bits: bytes, rest: bytes) -> PerfectHash:
        levels, at, raw = [], 0, np.frombuffer(bits, np.uint8)
        for n in np.frombuffer(sizes, np.int64):
            m = (int(n) + 7) // 8
            levels.append(np.unpackbits(raw[at : at + m], count=int(n)).astype(bool))
            at += m
        return cls(levels, np.frombuffer(rest, U))


def _digests(column: pa.Array) -> np.ndarray:
    """n x 32 bytes of a binary column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, WIDTH), np.uint8)
    fixed = column.cast(pa.binary(WIDTH))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * WIDTH :][: len(fixed) * WIDTH].reshape(-1, WIDTH)


def _keys(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, 8:16]).view(U).ravel() ^ np.ascontiguousarray(digests[:, 16:24]).view(U).ravel()


def _shard(bits: int):
    """The first bits of the digest."""
    return F.expr(f"cast(shiftrightunsigned(cast(conv(hex(substring({P}digest, 1, 4)), 16, 10) as bigint), {32 - bits}) as int)") if bits else F.lit(0)


INDEX = "shard int, sizes binary, bits binary, rest binary, digests binary, winners binary, filled binary"


def _build(shard: pa.Table) -> pa.Table:
    d = _digests(shard[f"{P}digest"])
    winners = shard[f"{P}winner"].combine_chunks()
    h = PerfectHash.build(_keys(d))
    slot = h.slots(_keys(d))
    by = np.empty((len(d), WIDTH), np.uint8)
    by[slot] = d
    w, filled = np.zeros(len(d), np.int64), np.zeros(len(d), bool)
    w[slot] = winners.fill_null(0).to_numpy(zero_copy_only=False)
    filled[slot] = winners.is_valid().to_numpy(zero_copy_only=False)
    a, b, c = h.dump()
    return pa.table({"shard": pa.array([shard[f"{P}shard"][0].as_py()], pa.int32()), "sizes": [a], "bits": [b], "rest": [c], "digests": [by.tobytes()], "winners": [w.tobytes()], "filled": [filled.tobytes()]})


def historic() -> Column:
    """Whether a row's source is one of the earlier ones."""
    return F.substring(F.md5(F.coalesce("source", F.lit(""))), 1, 1) < "8"


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def build_history(winners: DataFrame, bits: int) -> DataFrame:
    """winners: distinct digests and their winners. One row for each shard."""
    return winners.select(_shard(bits).alias(f"{P}shard"), f"{P}digest", f"{P}winner").groupBy(f"{P}shard").applyInArrow(_build, INDEX)


def shard_bits(distinct: int, keys_per_shard: int = KEYS_PER_SHARD) -> int:
    return min(31, max(0, int(np.ceil(np.log2(max(1, distinct / keys_per_shard))))))


FOUND = f"{P}id long, {P}digest binary, {P}n long, {P}old boolean, {P}member boolean, {P}winner long"


def lookup(incoming: DataFrame, history: DataFrame, bits: int) -> DataFrame:
    """incoming: _lds_id, _lds_digest, _lds_n, _lds_old. Adds _lds_member and _lds_winner. Rows meet their shard's index in one sorted partition; they stream past it, so that a
    shard with many more lookups than slots needs no more memory."""
    nothing = {c.split()[0]: c.split()[1] for c in INDEX.split(", ")}
    rows = incoming.select(_shard(bits).alias("shard"), F.lit(1).alias(f"{P}kind"), f"{P}id", f"{P}digest", f"{P}n", f"{P}old", *(F.lit(None).cast(t).alias(c) for c, t in nothing.items() if c != "shard"))
    index = history.select("shard", F.lit(0).alias(f"{P}kind"), F.lit(None).cast("long").alias(f"{P}id"), F.lit(None).cast("binary").alias(f"{P}digest"), F.lit(None).cast("long").alias(f"{P}n"), F.lit(None).cast("boolean").alias(f"{P}old"), *(c for c in nothing if c != "shard"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, h, d, w, filled = None, None, None, None, None
        for batch in batches:
            t = pa.table(batch)
            shards = t["shard"].to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for i, j in zip(cut, cut[1:]):
                if i == j:
                    continue
                part = t.slice(i, j - i)
                if shards[i] != shard:
                    shard, h = shards[i], None
                kinds = part[f"{P}kind"].to_numpy()
                if kinds[0] == 0:
                    row = part.slice(0, 1).to_pylist()[0]
                    h = PerfectHash.load(row["sizes"], row["bits"], row["rest"])
                    d = np.frombuffer(row["digests"], np.uint8).reshape(-1, WIDTH)
                    w, filled = np.frombuffer(row["winners"], np.int64), np.frombuffer(row["filled"], bool)
                    part = part.slice(1)
                n = len(part)
                if not n:
                    continue
                member, winner, has = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, bool)
                if h is not None:
                    own = _digests(part[f"{P}digest"])
                    slot = h.slots(_keys(own))
                    k = np.flatnonzero(slot >= 0)
                    k = k[(d[slot[k]] == own[k]).all(1)]
                    member[k], winner[k], has[k] = True, w[slot[k]], filled[slot[k]]
                yield pa.RecordBatch.from_arrays(
                    [*(part[f"{P}{c}"].combine_chunks() for c in ("id", "digest", "n", "old")), pa.array(member), pa.array(winner, mask=~has)], names=[f"{P}{c}" for c in ("id", "digest", "n", "old", "member", "winner")]
                )

    return rows.unionByName(index).repartition("shard").sortWithinPartitions("shard", f"{P}kind").mapInArrow(run, FOUND)


def _counts(docs: DataFrame, old: Column) -> DataFrame:
    """A row for each (digest, doc_id, earlier or not) with the number of its rows; one shuffle, of digests and ids alone. Rows without a text have none."""
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias(f"{P}id"), _digest().alias(f"{P}digest"), old.alias(f"{P}old"))
    return rows.groupBy(f"{P}digest", f"{P}id", f"{P}old").agg(F.count("*").alias(f"{P}n"))


def _history(counts: DataFrame, keys_per_shard: int) -> tuple[DataFrame, int]:
    winners = materialise(counts.groupBy(f"{P}digest").agg(F.min(f"{P}id").alias(f"{P}winner")), "winners")
    bits = shard_bits(winners.count(), keys_per_shard)
    history = materialise(build_history(winners, bits), "history")
    discard(winners)
    return history, bits


def history_of(docs: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """The history that docs make, in the shared folder, and the bits of its shards."""
    return _history(_counts(docs, F.lit(True)), keys_per_shard)


def decide(docs: DataFrame, history: tuple[DataFrame, int] | None = None, keys_per_shard: int = KEYS_PER_SHARD, old: Column | None = None) -> DataFrame:
    """A row for each distinct (doc_id, text, old), in the shared folder: _lds_id, _lds_digest, _lds_old, _lds_n rows of it, _lds_keep, _lds_winner. history: a stored one; or old: which of the rows are the history themselves.
    With neither the history is empty, and all rows are grouped among themselves."""
    counts = materialise(_counts(docs, F.lit(False) if old is None or history is not None else old), "digests")
    own = None
    if history is None and old is not None:
        history = own = _history(counts.where(f"{P}old"), keys_per_shard)
    if history is None:
        found = counts.withColumn(f"{P}member", F.lit(False)).withColumn(f"{P}winner", F.lit(None).cast("long"))
    else:
        found = materialise(lookup(counts, *history), "found")
    members = found.where(f"{P}member").withColumn(f"{P}keep", F.col(f"{P}old") & F.col(f"{P}id").eqNullSafe(F.col(f"{P}winner")))
    rest = found.where(f"not {P}member").drop(f"{P}winner")
    first = rest.groupBy(f"{P}digest").agg(F.min(f"{P}id").alias(f"{P}winner"))
    rest = rest.join(first, f"{P}digest").withColumn(f"{P}keep", F.col(f"{P}id").eqNullSafe(F.col(f"{P}winner")))
    decided = materialise(members.unionByName(rest), "decided")
    discard(counts, *([found] if history is not None else []), *([own[0]] if own is not None else []))
    return decided


def kept(docs: DataFrame, history: tuple[DataFrame, int] | None = None, keys_per_shard: int = KEYS_PER_SHARD, old: Column | None = None) -> DataFrame:
    """The rows of docs that stay, with their columns. Only the keys of what goes travel to the texts."""
    found = decide(docs, history, keys_per_shard, old)
    keys = (f"{P}id", f"{P}digest", f"{P}old")
    gone = found.where(f"not {P}keep or {P}n > 1").select(*keys)
    again = found.where(f"{P}keep and {P}n > 1").select(*keys)

    def match(keys: DataFrame, how: str) -> DataFrame:
        keyed = docs.withColumns({f"{P}i": F.col("doc_id").cast("long"), f"{P}d": _digest(), f"{P}o": F.lit(False) if old is None or history is not None else old})
        return keyed.join(keys, F.col(f"{P}i").eqNullSafe(keys[f"{P}id"]) & (F.col(f"{P}d") == keys[f"{P}digest"]) & (F.col(f"{P}o") == keys[f"{P}old"]), how)

    out = match(gone, "left_anti").select(*(docs[c] for c in docs.columns))
    if not again.isEmpty():
        out = out.unionByName(match(again, "left_semi").dropDuplicates([f"{P}i", f"{P}d"]).drop(f"{P}i", f"{P}d", f"{P}o"))
    return out


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and digest of the documents that stay, and the rows that share the text. The earlier sources are the history."""
    found = decide(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), old=historic())
    sizes = found.groupBy(f"{P}digest").agg(F.sum(f"{P}n").alias("n_copies"), F.max(F.when(F.col(f"{P}keep"), F.col(f"{P}id"))).alias("doc_id"))
    return sizes.select("doc_id", F.lower(F.hex(f"{P}digest")).alias("digest"), "n_copies")


OP5_SQL = """WITH d AS (SELECT doc_id, text, substr(md5(coalesce(source, '')), 1, 1) < '8' AS old FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN bool_or(old) THEN min(doc_id) FILTER (old) ELSE min(doc_id) END AS doc_id, sha256(text) AS digest, count(*) AS n_copies FROM d GROUP BY text"""
