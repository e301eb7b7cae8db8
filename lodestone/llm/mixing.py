"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's budget is its share of the token budget. While a source's tokens fit, all of it is taken: complete epochs. What is left is drawn without replacement:
each document has an exponential key -ln(u) / w, with u from a hash of its doc_id and w its quality weight; in the order of the keys a document is
taken as long as the sum of tokens up to and with it stays within the rest of the budget.

Target weights are given by source (TARGETS for op8_mix and the pipeline; sources without one have OTHER). Quality weights are those of labels, or any column of the documents, such as a classifier's probability.

Sorting a source needs no single task: keys fall into buckets, tokens are summed by bucket, and only the bucket in which a source's budget runs out is sorted.

Defined results: a null source is a source; documents without words, or without a text, are never taken; without a label, or with a null weight, it is UNKNOWN, and no weight is below LEAST; equal keys go by
doc_id, then by a hash of the text; rows equal in all three are drawn as often as they occur. A source with target weight 0 gives nothing, an empty table an empty one; texts may be of any length. Other columns,
whatever their names, are carried along; an epoch that there was is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import P, discard, materialise, table

SEED = "lodestone-1"
#: Of the tokens that there are, the budget.
RATIO = 1.0
BUCKETS = 1 << 14
GOOD, POOR, TOXIC, UNKNOWN, LEAST = 1.0, 0.5, 0.25, 0.75, 1e-3
#: Target weights of sources, and of all others.
TARGETS: dict[str | None, float] = {"src0": 4.0, "src1": 2.0, "src2": 0.5}
OTHER = 1.0


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """In (0, 1), the same on every engine: 52 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def label_weights(labels: DataFrame) -> DataFrame:
    """A weight for each labelled doc_id; several labels count by the worst."""
    q, t = F.min("quality"), F.max("toxic")
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias(f"{P}l")).agg(F.when(t == 1, TOXIC).when(q == 0, POOR).when(q == 1, GOOD).otherwise(UNKNOWN).alias(f"{P}w"))


def select(docs: DataFrame, weights: DataFrame | Column, targets: dict[str | None, float] | None = None, ratio: float = RATIO, seed: str = SEED, buckets: int = BUCKETS, other: float = 0.0) -> DataFrame:
    """weights: _lds_l (doc_id) and _lds_w, or a column of docs. A row for each doc_id, source, text digest that is taken: _lds_id, _lds_s, _lds_x, its complete epochs _lds_full, and _lds_part
    of its equal rows are taken once more. targets: weights by source, other: of the rest; None: all the same."""
    own = [weights.alias(f"{P}w")] if isinstance(weights, Column) else []
    d = docs.select(F.col("doc_id").alias(f"{P}id"), F.col("source").alias(f"{P}s"), F.xxhash64("text").alias(f"{P}x"), tokens(F.col("text")).alias(f"{P}t"), *own)
    d = d.where(F.col(f"{P}t") > 0)
    if not own:
        d = d.join(weights, F.col(f"{P}id") == F.col(f"{P}l"), "left").drop(f"{P}l")
    d = d.withColumn(f"{P}w", F.greatest(F.coalesce(f"{P}w", F.lit(UNKNOWN)), F.lit(LEAST)))
    d = d.withColumn(f"{P}k", -F.log(uniform(F.col(f"{P}id"), seed)) / F.col(f"{P}w"))
    d = materialise(d.withColumn(f"{P}b", F.floor((1 - F.exp(-F.col(f"{P}k") / 2)) * buckets).cast("int")), "keys")
    cells = materialise(d.groupBy(f"{P}s", f"{P}b").agg(F.sum(f"{P}t").alias(f"{P}sum")), "cells")
    total = cells.groupBy(f"{P}s").agg(F.sum(f"{P}sum").alias(f"{P}all"))
    if targets is None:
        total = total.withColumn(f"{P}target", F.lit(1.0))
    else:
        share = F.lit(float(other))
        for source, x in targets.items():
            share = F.when(F.col(f"{P}s").eqNullSafe(F.lit(source)), float(x)).otherwise(share)
        total = total.withColumn(f"{P}target", share)
    every = total.agg(F.sum(f"{P}all").alias(f"{P}every"), F.sum(f"{P}target").alias(f"{P}shares"))
    budget = F.floor(F.col(f"{P}every") * F.lit(ratio) * F.col(f"{P}target") / F.col(f"{P}shares"))
    total = total.crossJoin(F.broadcast(every)).where(f"{P}target > 0")
    total = total.withColumn(f"{P}full", F.floor(budget / F.col(f"{P}all")).cast("long")).withColumn(f"{P}rest", budget - F.col(f"{P}full") * F.col(f"{P}all"))
    total = total.select(f"{P}s", f"{P}full", f"{P}rest")
    order = Window.partitionBy(f"{P}s").orderBy(f"{P}b")  # over at most BUCKETS rows a source
    cells = cells.withColumn(f"{P}to", F.sum(f"{P}sum").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = lambda a, b: a[f"{P}s"].eqNullSafe(b[f"{P}s"])
    t = total.alias("t")
    cells = cells.join(t, F.col(f"t.{P}s").eqNullSafe(cells[f"{P}s"])).select(cells[f"{P}s"], f"{P}b", f"{P}full", F.when(F.col(f"{P}to") <= F.col(f"{P}rest"), -1).otherwise(F.greatest(F.lit(0), F.col(f"{P}rest") - F.col(f"{P}to") + F.col(f"{P}sum"))).cast("long").alias(f"{P}left"))
    d = d.join(cells, same(d, cells) & (d[f"{P}b"] == cells[f"{P}b"])).select(d[f"{P}id"], d[f"{P}s"], f"{P}x", f"{P}t", f"{P}k", d[f"{P}b"], f"{P}full", f"{P}left")
    inner = Window.partitionBy(f"{P}s", f"{P}b").orderBy(f"{P}k", f"{P}id", f"{P}x").rowsBetween(Window.unboundedPreceding, 0)
    whole = d.where(f"{P}left <= 0").withColumn(f"{P}in", F.col(f"{P}left") < 0)
    cut = d.where(f"{P}left > 0").withColumn(f"{P}in", F.sum(f"{P}t").over(inner) <= F.col(f"{P}left"))
    taken = whole.unionByName(cut).where(f"{P}in or {P}full > 0")
    return taken.groupBy(f"{P}id", f"{P}s", f"{P}x").agg(F.min(f"{P}full").alias(f"{P}full"), F.count("*").alias(f"{P}rows"), F.sum(F.col(f"{P}in").cast("long")).alias(f"{P}part"), F.min(f"{P}k").alias(f"{P}k"), F.min(f"{P}t").alias(f"{P}t"))


def mix(docs: DataFrame, weights: DataFrame | Column, **how) -> DataFrame:
    """The taken rows of docs, once for each epoch (column epoch, from 0; it replaces an epoch that docs have). The last epoch of a source is the fractional one."""
    chosen = select(docs, weights, **how)
    # equal rows: each is in every complete epoch; in the fractional one as many of them as were drawn
    one = chosen.where(f"{P}rows = 1 or {P}part in (0, {P}rows)").select(f"{P}id", f"{P}s", f"{P}x", (F.col(f"{P}full") + (F.col(f"{P}part") > 0).cast("long")).alias(f"{P}n"))
    some = chosen.where(f"{P}rows > 1 and {P}part > 0 and {P}part < {P}rows").select(f"{P}id", f"{P}s", f"{P}x", f"{P}full", f"{P}part")
    keyed = docs.drop("epoch").withColumn(f"{P}h", F.xxhash64("text"))
    on = lambda c: F.col("doc_id").eqNullSafe(c[f"{P}id"]) & F.col("source").eqNullSafe(c[f"{P}s"]) & (F.col(f"{P}h") == c[f"{P}x"])
    first = keyed.join(one, on(one)).select(*(keyed[c] for c in keyed.columns if c != f"{P}h"), f"{P}n")
    if not some.isEmpty():
        rank = Window.partitionBy("doc_id", "source", f"{P}h").orderBy(F.lit(0))
        more = keyed.join(some, on(some)).withColumn(f"{P}n", F.col(f"{P}full") + (F.row_number().over(rank) <= F.col(f"{P}part")).cast("long"))
        first = first.unionByName(more.select(*(keyed[c] for c in keyed.columns if c != f"{P}h"), f"{P}n"))
    return first.where(f"{P}n > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{P}n") - 1))).drop(f"{P}n")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens and epoch of every draw."""
    chosen = select(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), label_weights(table(spark, sf_dir, "labels")), TARGETS, other=OTHER)
    draws = F.sequence(F.lit(1).cast("long"), F.col(f"{P}full") * F.col(f"{P}rows") + F.col(f"{P}part"))
    draws = chosen.where(F.col(f"{P}full") + F.col(f"{P}part") > 0).select(f"{P}id", f"{P}s", f"{P}t", f"{P}rows", F.explode(draws).alias(f"{P}i"))
    return draws.select(F.col(f"{P}id").alias("doc_id"), F.col(f"{P}s").alias("source"), F.col(f"{P}t").alias("tokens"), F.floor((F.col(f"{P}i") - 1) / F.col(f"{P}rows")).cast("long").alias("epoch"))


def mix_sql(docs: str = "documents") -> str:
    """CTEs up to taken(doc_id, source, text, ..., n)."""
    return f"""w AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN {TOXIC} WHEN min(quality) = 0 THEN {POOR} WHEN min(quality) = 1 THEN {GOOD} ELSE {UNKNOWN} END AS w FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT d.*, CAST(len(regexp_extract_all(d.text, '[^ \\t\\n\\r]+')) AS BIGINT) AS tokens FROM {docs} d),
k AS (SELECT t.*, -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(t.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE) / coalesce(w.w, {UNKNOWN})::DOUBLE AS k FROM t LEFT JOIN w ON t.doc_id = w.doc_id WHERE tokens > 0),
s AS (SELECT source, sum(tokens) AS all_ FROM k GROUP BY source),
g AS (SELECT source, all_, (CASE {" ".join(f"WHEN source = '{x}' THEN {w}" for x, w in TARGETS.items())} ELSE {OTHER} END)::DOUBLE AS target FROM s),
b AS (SELECT source, all_, floor((SELECT sum(all_) FROM s)::DOUBLE * {RATIO} * target / (SELECT sum(target) FROM g)) AS budget FROM g),
r AS (SELECT source, floor(budget / all_) AS full_, budget - floor(budget / all_) * all_ AS rest FROM b),
c AS (SELECT k.*, r.full_, r.rest, sum(tokens) OVER (PARTITION BY k.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS to_ FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source),
taken AS (SELECT c.*, CAST(full_ + CASE WHEN to_ <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM c)"""


OP8_SQL = f"WITH {mix_sql()} SELECT doc_id, source, tokens, unnest(range(n)) AS epoch FROM taken"
