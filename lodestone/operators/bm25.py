"""BM25 over an inverted index held as DataFrames: postings with positions, document lengths, one row of statistics; in memory of no one, or stored."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, tokens_of
from ..sources.versions import Versions

K1, B = 1.2, 0.75
#: Tokens that a task takes at a time, rows that it gives at a time, and scores that it holds at a time; parts that a stored term is dealt to.
WORDS, ROWS, SCORES, PARTS = 1 << 20, 50_000, 1 << 20, 8


def doc_lengths(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.size(tokens(F.col(text))).cast("long").alias("len"))


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc_id, t: a row a document with the tokens of its texts. Where each id has one text, as a look at the ids alone tells, nothing is shuffled."""
    own = F.coalesce(F.col(text), F.lit(""))
    if docs.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        texts = docs.select(F.col(id_col).alias("doc_id"), F.array(own).alias("t"))
    else:
        texts = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.collect_list(own).alias("t"))
    return texts.select("doc_id", F.transform("t", tokens).alias("t"))


class _Words:
    """The tokens of some documents as arrays: of each its document, term (a place in `terms`) and position; of each text its document and length."""

    def __init__(self, b: pa.RecordBatch):
        self.ids, lists = b.column(0), b.column(1)
        flat = lists.flatten()
        self.owner = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy())
        self.length = pc.list_value_length(flat).to_numpy().astype(np.int64)
        coded = flat.flatten().dictionary_encode()
        self.terms, self.term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.doc = np.repeat(self.owner, self.length)
        self.pos = (np.arange(len(self.term)) - np.repeat(np.cumsum(self.length) - self.length, self.length)).astype(np.int32)
        self.single = len(self.owner) == b.num_rows

    def runs(self) -> tuple[np.ndarray, ...]:
        """Term and document of each pair, by term, then document; where its positions end, and all positions."""
        key = self.term * len(self.ids) + self.doc
        order = np.argsort(key, kind="stable") if self.single else np.lexsort((self.pos, key))
        key = key[order]
        begin = np.flatnonzero(np.diff(key, prepend=-1))
        term, doc = np.divmod(key[begin], max(1, len(self.ids)))
        return term, doc, np.append(begin[1:], len(key)).astype(np.int64), self.pos[order]


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Documents with about WORDS tokens at a time, so that memory doesn't follow their number or length."""
    n = pc.list_value_length(b.column(1).flatten()).to_numpy()
    ends = np.cumsum(np.bincount(np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy()), n, b.num_rows))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def postings(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """term, doc_id, positions (ascending), tf. A text is tokenised once, and its postings are made where it lies."""
    rows = _texts(docs, id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                w = _Words(part)
                term, doc, ends, pos = w.runs()
                offsets = np.append(0, ends).astype(np.int32)
                for lo in range(0, len(term), ROWS):
                    own = slice(lo, lo + ROWS)
                    lists = pa.ListArray.from_arrays(pa.array(offsets[lo : lo + len(term[own]) + 1] - offsets[lo]), pa.array(pos[offsets[lo] : offsets[min(lo + ROWS, len(term))]]))
                    yield pa.RecordBatch.from_arrays([w.terms.take(pa.array(term[own])), w.ids.take(pa.array(doc[own])), lists, pa.array(np.diff(offsets)[own].astype(np.int64))], names=["term", "doc_id", "positions", "tf"])

    return rows.mapInArrow(run, f"term string, doc_id {rows.schema['doc_id'].dataType.simpleString()}, positions array<int>, tf long")


def blocks(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """Postings by slices of documents: slice, term, and of each document that has it docs and lens (its length; once for each of its texts), ends (where its positions end) and all positions."""
    rows = _texts(docs, id_col, text)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in _slices(b.filter(pc.is_valid(b.column(0)))):
                w = _Words(part)
                term, doc, ends, pos = w.runs()
                begin = np.append(0, ends[:-1]) if len(ends) else ends
                size, length = ends - begin, w.length
                if w.single:
                    lens = length[doc]
                else:  # a document's postings once for each of its texts
                    n, first = np.bincount(w.owner, minlength=len(w.ids)), np.searchsorted(w.owner, np.arange(len(w.ids)))
                    of = np.repeat(np.arange(len(doc)), n[doc])
                    lens = length[np.repeat(first[doc], n[doc]) + np.arange(len(of)) - np.repeat(np.cumsum(n[doc]) - n[doc], n[doc])]
                    pos = pos[np.repeat(begin[of], size[of]) + np.arange(size[of].sum()) - np.repeat(np.cumsum(size[of]) - size[of], size[of])]
                    term, doc, size = term[of], doc[of], size[of]
                ends = np.cumsum(size)
                at = np.flatnonzero(np.diff(term, prepend=-1))
                before = np.append(0, ends)[at]  # positions of earlier terms
                rows_, places = pa.array(np.append(at, len(term)).astype(np.int32)), pa.array(np.append(before, len(pos)).astype(np.int32))
                local = (ends - np.repeat(before, np.diff(np.append(at, len(term))))).astype(np.int32)
                columns = [pa.array(np.full(len(at), number)), w.terms.take(pa.array(term[at])), *(pa.ListArray.from_arrays(o, x) for o, x in ((rows_, w.ids.take(pa.array(doc))), (rows_, pa.array(lens.astype(np.int32))), (rows_, pa.array(local)), (places, pa.array(pos))))]
                out = pa.RecordBatch.from_arrays(columns, names=["slice", "term", "docs", "lens", "ends", "positions"])
                for lo in range(0, len(at), ROWS):
                    yield out.slice(lo, ROWS)
                number += 1

    return rows.mapInArrow(run, f"slice long, term string, docs array<{kind}>, lens array<int>, ends array<int>, positions array<int>")


def unfolded(stored: DataFrame, positions: bool) -> DataFrame:
    """term, doc_id, tf, len, and positions if asked for, of rows of blocks()."""
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("ends", i - 1))
    tf = lambda i: F.get("ends", i) - begin(i)
    one = lambda i: F.struct(F.get("docs", i).alias("doc_id"), tf(i).cast("long").alias("tf"), F.get("lens", i).cast("long").alias("len"), *([F.slice("positions", begin(i) + 1, tf(i)).alias("positions")] if positions else []))
    return stored.select("term", F.explode(F.transform(F.sequence(F.lit(0), F.size("docs") - 1), one)).alias("x")).select("term", "x.*")


def term_counts(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """term, doc_id, tf: postings without positions, counted by a map-side combined aggregate."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def idf_of(n: Column, df: Column) -> Column:
    without = n - df
    return F.log((without + 0.5) / (df + 0.5)) + 1


def idf_table(counts: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", "df", idf_of(F.col("n"), F.col("df")).alias("idf"))


def vocabulary(docs: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """term, df, idf from one pass: a document's distinct terms are counted where it lies, only counts are shuffled. The number of documents counts those without a token too."""
    df = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", idf_of(F.col("n"), F.col("df")).alias("idf"))


def statistics(lengths: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))


class Bm25:
    """The index of one table. counts may be any DataFrame with term, doc_id, tf (and positions, for phrases), such as stored postings; queries touch the rows of their own terms alone."""

    def __init__(self, docs: DataFrame, id_col: str = "id", text: str = "text", counts: DataFrame | None = None, lengths: DataFrame | None = None, stats: DataFrame | None = None, stored: DataFrame | None = None):
        self.stored = stored  # as blocks() gives them
        self.docs, self.id_col, self.text = docs, id_col, text
        self.lengths = lengths if lengths is not None else doc_lengths(docs, id_col, text)
        self.counts = counts
        self.stats = stats if stats is not None else statistics(self.lengths)

    def __len__(self) -> int:
        return self.docs.count()

    def is_empty(self) -> bool:
        return self.docs.isEmpty()

    def save(self, path: str) -> Bm25:
        """Writes the index and gives it as stored: postings of a term and a slice of documents in one row, ordered by term, so that row groups of other terms are skipped; a document's length stands in its postings,
        so that a search joins nothing.
        Readers of an index that is replaced keep theirs."""
        p = blocks(self.docs, self.id_col, self.text)
        lengths = doc_lengths(self.docs, self.id_col, self.text)
        v = Versions(self.docs.sparkSession, path)
        new = v.begin()
        lengths.write.parquet(f"{new}/lengths")
        stored = self.docs.sparkSession.read.parquet(f"{new}/lengths")
        spread = p.repartition("term", F.pmod("slice", F.lit(PARTS))).sortWithinPartitions("term", "slice")
        spread.write.option("parquet.bloom.filter.enabled#term", "true").parquet(f"{new}/postings")
        statistics(stored).coalesce(1).write.parquet(f"{new}/statistics")
        v.commit(new)
        return Bm25.load(path, self.docs, self.id_col, self.text)

    @classmethod
    def load(cls, path: str, docs: DataFrame, id_col: str = "id", text: str = "text") -> Bm25:
        spark = docs.sparkSession
        now = Versions(spark, path).current()
        if now is None:
            raise FileNotFoundError(path)
        stored, lengths, stats = (spark.read.parquet(f"{now}/{x}") for x in ("postings", "lengths", "statistics"))
        if "slice" not in stored.columns:  # of before postings were in slices
            raise FileNotFoundError(path)
        return cls(docs, id_col, text, unfolded(stored, True), lengths, stats, stored)

    @classmethod
    def cached(cls, path: str, docs: DataFrame, id_col: str = "id", text: str = "text") -> Bm25:
        """The stored index if it has as many documents as docs; otherwise, or if it can't be read, it is built anew and stored."""
        try:
            found = cls.load(path, docs, id_col, text)
            if found.stats.first()["n"] == docs.count():
                return found
        except Exception:  # noqa: BLE001, S110 whatever is wrong with the cache, a new one takes its place
            pass
        return cls(docs, id_col, text).save(path)

    def _hits(self, terms: list[str]) -> DataFrame:
        """term, doc_id, tf, len of these terms: without stored postings one pass over the texts that explodes only what the query asks for."""
        if self.stored is not None:
            return unfolded(self.stored.where(F.col("term").isin(terms)), False)
        if self.counts is not None:
            own = self.counts.where(F.col("term").isin(terms))
            return own if "len" in own.columns else own.join(self.lengths, "doc_id")
        t = self.docs.select(F.col(self.id_col).alias("doc_id"), tokens(F.col(self.text)).alias("t")).withColumn("len", F.size("t").cast("long"))
        own = F.filter("t", lambda x: x.isin(terms))
        return t.select("doc_id", "len", F.explode(own).alias("term")).groupBy("term", "doc_id", "len").agg(F.count("*").alias("tf"))

    def scored(self, query: str) -> DataFrame:
        """doc_id, score of all documents that hold a term with a positive idf; repeated query words count repeatedly."""
        q = Counter(tokens_of(query))
        if not q:
            return self.lengths.select("doc_id", F.lit(0.0).alias("score")).where(F.lit(False))
        return self._sum(self._hits(sorted(q)), q)

    def _sum(self, hits: DataFrame, q: Counter) -> DataFrame:
        df = hits.groupBy("term").agg(F.count("*").alias("df"))  # at most one row a query word
        weight = reduce(lambda w, t: F.when(F.col("term") == t, float(q[t])).otherwise(w), q, F.lit(0.0))
        rows = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(self.stats)).withColumn("idf", idf_of(F.col("n"), F.col("df"))).where("idf > 0")
        return rows.groupBy("doc_id").agg(F.sum(weight * term_score(F.col("idf"), F.col("tf"), F.col("len"), F.col("avgdl"))).alias("score"))

    def phrase(self, words: list[str]) -> DataFrame:
        """doc_id, score of the documents that hold the words side by side; the score is that of the bag of words, 0 if no word counts."""
        if self.counts is not None and "positions" in self.counts.columns:
            held = self._adjacent(words)
        else:  # tokens have no spaces, so the phrase is a string between spaces: a text is tokenised once
            line = F.concat(F.lit(" "), F.array_join(tokens(F.col(self.text)), " "), F.lit(" "))
            held = self.docs.where(F.contains(line, F.lit(f" {' '.join(words)} "))).select(F.col(self.id_col).alias("doc_id"))
        return held.join(self._sum(self._hits(sorted(set(words))), Counter(words)), "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))

    def _adjacent(self, words: list[str]) -> DataFrame:
        """By stored positions: a place counts for the phrase's start once for each of its words that stands where it should."""
        offsets = F.create_map(*(x for w in set(words) for x in (F.lit(w), F.array(*(F.lit(i) for i, v in enumerate(words) if v == w)))))
        own = self.counts.where(F.col("term").isin(sorted(set(words)))).select("doc_id", "positions", F.explode(offsets[F.col("term")]).alias("off"))
        starts = own.select("doc_id", F.explode(F.transform("positions", lambda p: p - F.col("off"))).alias("at"))
        return starts.groupBy("doc_id", "at").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("doc_id").distinct()

    def search(self, query: str, k: int) -> DataFrame:
        """doc_id, score: the k best. A query in double quotes is a phrase."""
        q = query.strip()
        if len(q) > 2 and q[0] == q[-1] == '"':
            words = tokens_of(q)
            found = self.phrase(words) if len(words) > 1 else self.scored(" ".join(words))
        else:
            found = self.scored(q)
        return found.orderBy(F.desc("score"), "doc_id").limit(max(0, k))

    def search_batch(self, queries: DataFrame, query_id: str = "query_id", text: str = "text", k: int | None = None) -> DataFrame:
        """query_id, doc_id, score of all pairs with a score or, with k, of those of which some can be among a query's k best at nine decimals; take the best with search.ranked().

        Documents are scored where they lie, or slice by slice as stored, against all queries: nothing is sent for a pair but its score. The queries' words are on the driver and broadcast: they grow with the queries, not with the documents."""
        q = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        if self.counts is not None and self.stored is None:
            return self._joined(q)
        asked = q.orderBy("query_id", "term").toArrow()
        who, words = (asked[c].combine_chunks().dictionary_encode("encode") for c in ("query_id", "term"))
        vocabulary_ = words.dictionary
        session = self.docs.sparkSession
        if self.stored is not None:
            number = session.createDataFrame(pa.table({"term": vocabulary_.cast(pa.string()), "w": np.arange(len(vocabulary_), dtype=np.int32)}))
            own = self.stored.join(F.broadcast(number), "term").select("slice", "w", "docs", "lens", "ends")
            n, mean = self.stats.first()
            df = np.zeros(len(vocabulary_))
            for w, x in own.groupBy("w").agg(F.sum(F.size(F.array_distinct("docs")))).collect():  # a row a word of the queries
                df[w] = x
            rows, kind = own.repartition("slice").sortWithinPartitions("slice"), self.stored.schema["docs"].dataType.elementType.simpleString()
        else:
            rows = _texts(self.docs, self.id_col, self.text)
            kind = rows.schema["doc_id"].dataType.simpleString()
            n, mean, df = _counted(rows, vocabulary_)
        plan = _Plan(who.dictionary, who.indices.to_numpy(), vocabulary_, words.indices.to_numpy(), asked["qtf"].to_numpy(), n or 0, mean or 0.0, df, k)
        shared, stored = session.sparkContext.broadcast(plan), self.stored is not None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = _Scorer(shared.value)
            if stored:
                held: list[pa.RecordBatch] = []
                for b in batches:
                    at = b.column(0).to_numpy()
                    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at)) + 1):
                        if len(part):
                            if held and held[-1].column(0)[0].as_py() != int(at[part[0]]):
                                yield from s.stored(pa.Table.from_batches(held))
                                held = []
                            held.append(b.slice(part[0], len(part)))
                if held:
                    yield from s.stored(pa.Table.from_batches(held))
            else:
                for b in batches:
                    for part in _slices(b.filter(pc.is_valid(b.column(0)))):
                        yield from s.texts(_Words(part))
            yield from s.end()

        return rows.mapInArrow(run, f"query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {kind}, score double")

    def _joined(self, q: DataFrame) -> DataFrame:
        """With postings of one's own: one join on the term."""
        counts = self.counts.join(F.broadcast(q.select("term").distinct()), "term", "left_semi")
        if "len" not in counts.columns:
            counts = counts.join(self.lengths, "doc_id")
        idf = idf_table(counts, self.stats).where("idf > 0")
        rows = q.join(idf, "term").join(counts, "term").crossJoin(F.broadcast(self.stats.select("avgdl")))
        return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * term_score(F.col("idf"), F.col("tf"), F.col("len"), F.col("avgdl"))).alias("score"))


def _counted(rows: DataFrame, words: pa.Array) -> tuple[int, float, np.ndarray]:
    """Texts, their mean length, and of each word the documents that have it, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(len(shared.value), np.int64)
        for b in batches:
            for part in _slices(b):
                w = _Words(part)
                n, total = n + len(w.length), total + int(w.length.sum())
                at = pc.index_in(w.terms, shared.value).fill_null(-1).to_numpy()[w.term]
                own = at >= 0
                df += np.bincount(np.unique(w.doc[own] * len(df) + at[own]) % max(1, len(df)), minlength=len(df))
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"w": np.append(own, [-1, -2]), "x": np.append(df[own], [n, total])})

    df = np.zeros(len(words))
    sums = dict(rows.mapInArrow(run, "w long, x long").groupBy("w").agg(F.sum("x")).collect())  # a row a word
    n, total = sums.pop(-1, 0), sums.pop(-2, 0)
    df[list(sums)] = list(sums.values())
    return n, total / n if n else 0.0, df


class _Plan:
    """What a search of many queries sends to its tasks: the words with a positive idf, and for each the queries that have it."""

    def __init__(self, queries: pa.Array, who: np.ndarray, words: pa.Array, word: np.ndarray, qtf: np.ndarray, n: int, mean: float, df: np.ndarray, k: int | None):
        self.queries, self.words, self.mean, self.k = queries, words, mean, k
        self.idf = np.where(df > 0, np.log((np.maximum(n - df, 0) + 0.5) / (df + 0.5)) + 1, 0)
        order = np.argsort(word, kind="stable")
        self.who, self.qtf = who[order], qtf[order].astype(np.float64)
        self.count = np.bincount(word, minlength=len(words))
        self.first = np.cumsum(self.count) - self.count


class _Scorer:
    def __init__(self, plan: _Plan):
        self.p = plan
        self.best = np.full((plan.k or 0, len(plan.queries)), -np.inf)
        self.kept: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []

    def texts(self, w: _Words) -> Iterator[pa.RecordBatch]:
        at = pc.index_in(w.terms, self.p.words).fill_null(-1).to_numpy()[w.term]
        own = at >= 0
        key, tf = np.unique(w.doc[own] * max(1, len(self.p.words)) + at[own], return_counts=True)
        doc, word = np.divmod(key, max(1, len(self.p.words)))
        n, first = np.bincount(w.owner, minlength=len(w.ids)), np.searchsorted(w.owner, np.arange(len(w.ids)))
        of = np.repeat(np.arange(len(doc)), n[doc])  # once for each of a document's texts
        text = np.repeat(first[doc], n[doc]) + np.arange(len(of)) - np.repeat(np.cumsum(n[doc]) - n[doc], n[doc])
        yield from self._scored(w.ids, doc[of], word[of], tf[of], w.length[text])

    def stored(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        """The rows of one slice."""
        t = t.combine_chunks()
        size = pc.list_value_length(t["docs"]).to_numpy()
        ids = pc.list_flatten(t["docs"]).combine_chunks().dictionary_encode()
        ends = pc.list_flatten(t["ends"]).to_numpy().astype(np.int64)
        tf = np.diff(ends, prepend=0)
        begin = np.cumsum(size) - size
        tf[begin] = ends[begin]
        yield from self._scored(ids.dictionary, ids.indices.to_numpy(), np.repeat(t["w"].to_numpy(), size), tf, pc.list_flatten(t["lens"]).to_numpy())

    def _scored(self, ids: pa.Array, doc: np.ndarray, word: np.ndarray, tf: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        p, width = self.p, max(1, len(self.p.queries))
        ok = p.idf[word] > 0
        order = np.flatnonzero(ok)[np.argsort(doc[ok], kind="stable")]
        doc, word, tf, length = doc[order].astype(np.int64), word[order], tf[order], length[order]
        s = p.idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (p.mean or 1)))
        step = max(1, SCORES // width)
        cuts = np.searchsorted(doc, np.arange(0, len(ids) + step, step))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if lo < hi:
                n = p.count[word[lo:hi]]
                of = np.repeat(np.arange(lo, hi), n)
                at = np.repeat(p.first[word[lo:hi]], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                total = np.bincount((doc[of] - i * step) * width + p.who[at], s[of] * p.qtf[at], step * width).reshape(step, width)
                yield from self._take(ids, i * step, total)

    def _take(self, ids: pa.Array, base: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = total > 0
        if self.p.k:
            both = np.concatenate([self.best, total])
            self.best = np.partition(both, len(both) - self.p.k, axis=0)[-self.p.k :]
            keep &= total >= self._least()
        doc, who = np.nonzero(keep)
        found = who, ids.take(pa.array(doc + base)), total[doc, who]
        if not self.p.k:
            yield from self._given(*found)
        elif len(doc):
            self.kept.append(found)

    def _least(self) -> np.ndarray:
        """With room for what rounds to the same nine decimals."""
        return np.maximum(self.best.min(0), 0) - 2e-9

    def _given(self, who: np.ndarray, doc: pa.Array, score: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(who), ROWS):
            yield pa.RecordBatch.from_arrays([self.p.queries.take(pa.array(who[lo : lo + ROWS])), doc.slice(lo, ROWS), pa.array(score[lo : lo + ROWS])], names=["query_id", "doc_id", "score"])

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.kept:
            least = self._least()
            for who, doc, score in self.kept:
                ok = score >= least[who]
                yield from self._given(who[ok], doc.filter(pa.array(ok)), score[ok])


def term_score(idf: Column, tf: Column, length: Column, avgdl: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))
