"""An inverted index in blocks, and BM25 over it that leaves most postings unread.

A cell is a row: some SPAN chunks of one type with their blocks. A block holds the postings of one term in the cell, and the greatest part of a score that any of them can give. Cells
are made where their chunks are read, and queries are sent to the tasks, some at a time, so no posting is shuffled. Queries are answered as a set:

1. Threshold: each query's rarest terms, SEED postings of them, for each of k, are scored; the k-th best sum is a score that the k-th best hit reaches at least.
2. Essential terms: from the most frequent on, terms are left out as long as their greatest parts together stay below the threshold. A chunk that
   has none of the others can't be a hit.
3. Cells whose blocks together can't reach the threshold are passed over. In the others the blocks of essential terms are scored; a chunk is a candidate
   if its sum and what the cell's other blocks can give reach the threshold, which a task's hits raise once more.
4. Only cells with candidates have their other blocks scored, and candidates get their exact scores; a task returns its k best for each query.

Results equal those of retrieval.bm25. With idfs below 0 (in corpora where most terms are in most chunks) sums can fall, so nothing is left out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.shared import kept, shared_folder
from plinth.functions.text import words
from plinth.operators.retrieval import K1, B, _repeated, _spark_type, term_weights

#: Chunks of a cell; postings, for each of k, from which a query's threshold is found; what rounding may hide from it; bytes of a table of weights that is sent to the tasks.
SPAN, SEED, SLACK, SENT_BYTES = 128, 10, 1e-6, 32 << 20
#: Cells that a task has at a time: a cell has some tens of thousands of postings.
CELLS = 16
CELL = "kinds array<string>, ords array<long>, lens array<int>, terms array<string>, sizes array<int>, tops array<double>, docs array<int>, tfs array<int>"


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Steps that read cells have CELLS at a time, where Spark's readers would have thousands. The settings are those of the session, so other threads of it share them meanwhile."""
    names = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = [spark.conf.get(n) for n in names]
    try:
        for n in names:
            spark.conf.set(n, str(CELLS))
        yield
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


@dataclass
class Index:
    """cells: see CELL (of each chunk kind, ord, len; of each term its postings' number and greatest part; of each posting, by term, its chunk's place and tf). terms: term, df,
    top (the greatest part of all), idf, avgdl."""

    cells: DataFrame
    terms: DataFrame


def _part(tf: np.ndarray, length: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def _ints(c: pa.Array) -> np.ndarray:
    """Numbers; nulls are the least."""
    return pc.fill_null(c, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) if c.null_count else c.to_numpy(zero_copy_only=False)


def _cell(rows: pa.Table, avgdl: float) -> list:
    rows = rows.combine_chunks().to_batches()[0]
    n, lens, t = rows.num_rows, rows.column("len").to_numpy(zero_copy_only=False), rows.column("t")
    here = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(t.flatten())
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), here), return_counts=True)
    sizes = np.bincount(key // n, minlength=len(coded.dictionary))
    tops = np.maximum.reduceat(_part(tf, lens[key % n], avgdl), np.cumsum(sizes) - sizes) if len(key) else np.zeros(0)
    return [rows.column("type"), rows.column("ord"), lens, coded.dictionary, sizes, tops, key % n, tf]


def build(chunks: DataFrame, path: str | None = None, tokens: Callable[[Column], Column] = words, span: int = SPAN) -> Index:
    """Writes the index of chunks (ord, type, text) under path, or a new shared folder. Texts are split into words twice, first for the mean length; nothing but counts of terms is shuffled,
    and chunks that share an ord, which count together and so must lie in one cell."""
    spark = chunks.sparkSession
    path = path or shared_folder(spark, "index")
    split = lambda some: some.select(F.col("ord").cast("long").alias("ord"), F.col("type").cast("string").alias("type"), F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    size = chunks.select(F.size(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))).cast("long").alias("len")).agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")).first()
    avgdl = size.words / size.n if size.words else 1.0
    many = _repeated(chunks)
    once = split(chunks if many is None else chunks.join(many, "ord", "left_anti")).withColumn("len", F.size("t")).select("ord", "type", "len", "t")
    out = T.StructType.fromDDL(CELL)

    def packed(by_type: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def row(cell: list) -> pa.RecordBatch:
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, k)) for c, k in zip(cell, kinds)], out.names)

            left: dict[str | None, pa.Table] = {}
            for b in batches:
                whole = pa.Table.from_batches([b])
                kinds = pc.unique(b.column(1)).to_pylist() if by_type else [None]
                for kind in kinds:
                    some = whole if not by_type else whole.filter(pc.is_null(whole["type"]) if kind is None else pc.fill_null(pc.equal(whole["type"], kind), False))
                    some = pa.concat_tables([left.pop(kind), some]) if kind in left else some
                    at = 0
                    while some.num_rows - at > span:
                        end = at + span
                        if not by_type:  # chunks of one ord stay together
                            ords = _ints(some["ord"].combine_chunks())
                            while end < len(ords) and ords[end] == ords[end - 1]:
                                end += 1
                            if end == len(ords):
                                break
                        yield row(_cell(some.slice(at, end - at), avgdl))
                        at = end
                    left[kind] = some.slice(at).combine_chunks()
            for some in left.values():
                if some.num_rows:
                    yield row(_cell(some, avgdl))

        return run

    once.mapInArrow(packed(True), out).write.mode("overwrite").parquet(f"{path}/cells")
    if many is not None:
        # Of one type and length their words count as one chunk's, as in retrieval.postings.
        same = split(chunks.join(many, "ord", "left_semi")).withColumn("len", F.size("t")).groupBy("ord", "type", "len").agg(F.flatten(F.collect_list("t")).alias("t"))
        same.repartition("ord").sortWithinPartitions("ord").select("ord", "type", "len", "t").mapInArrow(packed(False), out).write.mode("append").parquet(f"{path}/cells")
    cells = spark.read.schema(CELL).parquet(f"{path}/cells")
    # A cell's chunks with a term: of those with one ord, each counts, as in retrieval.term_table.
    seen = cells.select(F.explode(F.arrays_zip("terms", "sizes", "tops")).alias("b")).groupBy("b.terms").agg(F.sum("b.sizes").alias("df"), F.max("b.tops").alias("top"))
    with _few_at_once(spark):
        sums = kept(seen.select(F.col("terms").alias("term"), "df", "top"), "sums")
    df = sums.select("term", "df") if many is None else kept(_document_counts(chunks, tokens), "df")
    whole = spark.createDataFrame([(None, size.n, size.words)], "term string, df long, words long")
    weights = term_weights(df.withColumn("words", F.lit(None).cast("long")).unionByName(whole))
    weights.join(df, "term").join(sums.select("term", "top"), "term").write.mode("overwrite").parquet(f"{path}/terms")
    return load(spark, path)


def _document_counts(chunks: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    from plinth.operators.retrieval import term_table

    return term_table(chunks, tokens(F.col("text"))).filter("term is not null").select("term", "df")


def load(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.schema(CELL).parquet(f"{path}/cells"), spark.read.parquet(f"{path}/terms"))


@dataclass
class Answer:
    """hits: query_id, ord, rank (from 0), score. The others number the postings (query_id, n) that a query's terms have, and those read in each step."""

    hits: DataFrame
    blocks: DataFrame
    seeds: DataFrame
    essential: DataFrame
    completing: DataFrame


@dataclass
class _Sent:
    """A set of queries for the tasks: ids, terms, and of each term (row) and query (column) the weight, 0 if the query lacks it. sound: queries without weights below 0."""

    ids: pa.Array
    terms: pa.Array
    w: np.ndarray
    df: np.ndarray
    top: np.ndarray
    avgdl: float

    @property
    def sound(self) -> np.ndarray:
        return self.w.min(0) >= 0

    @property
    def most(self) -> np.ndarray:
        return np.maximum(self.w, 0.0)

    def _ordered(self, order: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of values (terms, queries) over the terms up to and with each, in that order."""
        sums = np.empty_like(values, float)
        sums[order] = np.cumsum(values[order], axis=0)
        return sums

    def seeds(self, postings: int) -> np.ndarray:
        """The terms, from the rarest on, that have so many postings together, the first whatever it has."""
        n = (self.w != 0) * self.df[:, None]
        so_far = self._ordered(np.argsort(self.df, kind="stable"), n)
        return (n > 0) & ((so_far == n) | (so_far <= postings)) & self.sound

    def essential(self, floor: np.ndarray) -> np.ndarray:
        so_far = self._ordered(np.argsort(-self.df, kind="stable"), self.most * self.top[:, None])
        return (self.w != 0) & (so_far >= floor)


def _groups(asked: pa.Table) -> Iterator[_Sent]:
    """Sets of queries whose tables of weights are small enough to be sent. asked: query_id, term, w, df, top, avgdl."""
    of = pc.dictionary_encode(asked["query_id"].combine_chunks(), null_encoding="encode")
    at, todo = of.indices.to_numpy(), [np.arange(len(of.dictionary))] if asked.num_rows else []
    while todo:
        some = todo.pop()
        rows = asked.take(pa.array(np.flatnonzero(np.isin(at, some))))
        terms = pc.dictionary_encode(rows["term"].combine_chunks())
        if 8 * len(some) * len(terms.dictionary) > SENT_BYTES and len(some) > 1:
            todo += [some[len(some) // 2 :], some[: len(some) // 2]]
            continue
        i, j = terms.indices.to_numpy(), np.searchsorted(some, at[np.isin(at, some)])
        w, df, top = np.zeros((len(terms.dictionary), len(some))), np.zeros(len(terms.dictionary), np.int64), np.zeros(len(terms.dictionary))
        w[i, j], df[i], top[i] = rows["w"].to_numpy(), rows["df"].to_numpy(), rows["top"].to_numpy()
        yield _Sent(of.dictionary.take(pa.array(some)), terms.dictionary, w, df, top, rows["avgdl"][0].as_py())


class _Met:
    """A cell's chunks of the wanted types and its blocks of the sent terms."""

    def __init__(self, b: pa.RecordBatch, i: int, sent: _Sent, types: list[str] | None):
        at = lambda name: b.column(name)[i].values
        wanted = np.ones(len(at("kinds")), bool) if types is None else pc.fill_null(pc.is_in(at("kinds"), value_set=pa.array(types, pa.string())), False).to_numpy(zero_copy_only=False)
        found = pc.fill_null(pc.index_in(at("terms"), value_set=sent.terms), -1).to_numpy(zero_copy_only=False)
        self.here = np.flatnonzero(found >= 0) if wanted.any() else np.zeros(0, int)
        self.terms, self.avgdl = found[self.here], sent.avgdl
        sizes = at("sizes").to_numpy()
        self.sizes, self.starts, self.tops = sizes[self.here], (np.cumsum(sizes) - sizes)[self.here], at("tops").to_numpy()[self.here]
        self.lens, self.docs, self.tfs = at("lens").to_numpy(), at("docs").to_numpy(), at("tfs").to_numpy()
        self.chunk = np.where(wanted, np.cumsum(wanted) - 1, -1)
        self.ords, self.row, n = np.unique(_ints(at("ords"))[wanted], return_inverse=True, return_counts=True)
        # What an ord's chunks can have together.
        self.times = n.max() if len(n) else 1

    def sums(self, some: np.ndarray, w: np.ndarray) -> np.ndarray:
        """(ords, queries): what the blocks `some` (places in terms) give, by weights of theirs."""
        n = self.sizes[some]
        at = np.repeat(self.starts[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        chunk, col = self.chunk[self.docs[at]], np.repeat(np.arange(len(some)), n)
        ok = chunk >= 0
        x = np.zeros((len(self.ords), len(some)))
        np.add.at(x, (self.row[chunk[ok]], col[ok]), _part(self.tfs[at], self.lens[self.docs[at]], self.avgdl)[ok])
        return x @ w


def _thresholds(index: Index, sent: _Sent, k: int, types: list[str] | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query a score that its k-th best hit reaches, and how many postings were read for it."""
    spark, chosen = index.cells.sparkSession, sent.seeds(seed * k)
    told = spark.sparkContext.broadcast((sent, chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, chosen = told.value
        best, read, w = np.zeros((k, len(sent.ids))), np.zeros(len(sent.ids), np.int64), sent.w * chosen
        for b in batches:
            for i in range(b.num_rows):
                c = _Met(b, i, sent, types)
                some = np.flatnonzero(chosen[c.terms].any(1))
                if len(some):
                    read += c.sizes[some] @ chosen[c.terms[some]]
                    best = -np.sort(-np.vstack([best, c.sums(some, w[c.terms[some]])]), axis=0)[:k]
        q = np.arange(len(sent.ids))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([q, np.repeat(q, k)])), pa.array(np.concatenate([read, np.full(len(q) * k, -1)])), pa.array(np.concatenate([np.full(len(q), -1.0), best.T.ravel()]))], ["q", "n", "s"])

    with _few_at_once(spark):
        met = kept(index.cells.mapInArrow(run, "q long, n long, s double"), "seeds")
    w = Window.partitionBy("q").orderBy(F.col("s").desc())
    found = met.filter("n < 0").withColumn("r", F.row_number().over(w)).filter(F.col("r") == k).select("q", "s").toArrow()
    read = met.filter("n >= 0").groupBy("q").agg(F.sum("n").alias("n")).toArrow()
    low, seen = np.zeros(len(sent.ids)), np.zeros(len(sent.ids), np.int64)
    low[found["q"].to_numpy()], seen[read["q"].to_numpy()] = found["s"].to_numpy(), read["n"].to_numpy()
    return low, seen


def _hits(index: Index, sent: _Sent, k: int, types: list[str] | None, low: np.ndarray) -> DataFrame:
    """query_id, ord, raw: each task's k best; and rows without raw: step, n (postings of a query's terms, and those read)."""
    floor = low - SLACK
    told = index.cells.sparkSession.sparkContext.broadcast((sent, sent.essential(floor), floor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, essential, floor = told.value
        sound, asks, most, n_q = sent.sound, sent.w != 0, sent.most, len(sent.ids)
        w, others = sent.w * essential, asks & ~essential
        key, raw, ord = np.full((n_q, k), -1.0), np.zeros((n_q, k)), np.full((n_q, k), np.iinfo(np.int64).max)
        read = np.zeros((3, n_q), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                c = _Met(b, i, sent, types)
                if not len(c.terms):
                    continue
                read[0] += c.sizes @ asks[c.terms]
                least = np.where(sound, np.maximum(floor, key[:, -1] - SLACK), floor)
                live = np.flatnonzero((c.times * (c.tops @ most[c.terms]) >= least - SLACK) & asks[c.terms].any(0))
                some = np.flatnonzero(essential[np.ix_(c.terms, live)].any(1))
                if not len(some):
                    continue
                read[1, live] += c.sizes @ essential[np.ix_(c.terms, live)]
                s = c.sums(some, w[np.ix_(c.terms[some], live)])
                rest = c.times * (c.tops @ (most * others)[np.ix_(c.terms, live)])
                there = s + rest >= least[live] - SLACK
                cols = np.flatnonzero(there.any(0))
                if not len(cols):
                    continue
                live, s, there = live[cols], s[:, cols], there[:, cols]
                some = np.flatnonzero(others[np.ix_(c.terms, live)].any(1))
                if len(some):
                    read[2, live] += c.sizes @ others[np.ix_(c.terms, live)]
                    s = s + c.sums(some, (sent.w * others)[np.ix_(c.terms[some], live)])
                # Rounded halves up, as F.round does.
                near = np.where(there & (s > 0), np.floor(s * 1e9 + 0.5 + 1e-11) / 1e9, -1.0).T
                hot = np.flatnonzero((near.max(1) >= key[live, -1]) & (near.max(1) >= 0))
                q = live[hot]
                joined = np.hstack([key[q], near[hot]]), np.hstack([raw[q], s.T[hot]]), np.hstack([ord[q], np.broadcast_to(c.ords, (len(hot), len(c.ords)))])
                order = np.lexsort((joined[2], -joined[0]), axis=1)[:, :k]
                key[q], raw[q], ord[q] = (np.take_along_axis(x, order, 1) for x in joined)
        q, at = np.nonzero(key >= 0)
        o, steps = ord[q, at], np.repeat(np.arange(3), n_q)
        ids = sent.ids.take(pa.array(np.concatenate([q, np.tile(np.arange(n_q), 3)])))
        o = pa.array(np.concatenate([o, np.zeros(3 * n_q, np.int64)]), mask=np.concatenate([o == np.iinfo(np.int64).min, np.ones(3 * n_q, bool)]))
        score = pa.array(np.concatenate([raw[q, at], np.zeros(3 * n_q)]), mask=np.arange(len(ids)) >= len(q))
        yield pa.RecordBatch.from_arrays([ids, o, score, pa.array(np.concatenate([np.full(len(q), -1), steps]), pa.int32()), pa.array(np.concatenate([np.zeros(len(q), np.int64), read.ravel()]))], ["query_id", "ord", "raw", "step", "n"])

    kind = T.StructType([T.StructField("query_id", _spark_type(sent.ids.type)), T.StructField("ord", T.LongType()), T.StructField("raw", T.DoubleType()), T.StructField("step", T.IntegerType()), T.StructField("n", T.LongType())])
    return index.cells.mapInArrow(run, kind)


def answer(index: Index, queries: DataFrame, k: int = 10, types: list[str] | None = None, tokens: Callable[[Column], Column] = words, seed: int = SEED) -> Answer:
    """The k best chunks of each query (query_id, query), as retrieval.bm25 gives them, and what was read for them. The queries' terms with their weights go through the driver, in the
    groups in which they are sent."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = asked.join(index.terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "df", "top", "avgdl").toArrow()
    names = "query_id", "n"
    found, seeds = [], []
    for sent in _groups(asked):
        low, read = _thresholds(index, sent, k, types, seed)
        found.append(_hits(index, sent, k, types, low))
        seeds.append(pa.table({"query_id": sent.ids, "n": read}))
    if not found:
        none = queries.select("query_id").limit(0)
        empty = none.withColumn("n", F.lit(0).cast("long"))
        return Answer(none.select("query_id", F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("score")), *[empty] * 4)
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    with _few_at_once(spark):
        whole = kept(whole, "hits")
    w = Window.partitionBy("query_id").orderBy(F.round("raw", 9).desc(), "ord")
    hits = whole.filter("step < 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "ord", (F.col("place") - 1).cast("long").alias("rank"), F.round("raw", 4).alias("score"))
    at = lambda step: whole.filter(F.col("step") == step).select(*names)
    return Answer(hits, at(0), spark.createDataFrame(pa.concat_tables(seeds)), at(1), at(2))


def top_k(index: Index, queries: DataFrame, k: int = 10, types: list[str] | None = None, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """query_id, ord, rank, score of the k best chunks of each query."""
    return answer(index, queries, k, types, tokens).hits


def postings_read(a: Answer) -> tuple[int, int]:
    """Postings that a search read, each step's counted, and those of all its terms."""
    read = sum(x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for x in (a.seeds, a.essential, a.completing))
    return read, a.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
