"""Batch retrieval: a table of queries against chunks by BM25 and by vectors, fusion, named-entity reranking, evaluation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.shared import kept
from plinth.functions.text import named_in, words

#: BM25's constants, the negative-idf floor's factor, and the constant of reciprocal ranks.
K1, B, FLOOR, RRF = 1.5, 0.75, 0.25, 60
#: Bytes of query vectors (8 a component) that are sent to the tasks at once.
BLOCK_BYTES = 8 << 20
#: Queries whose scores a task has at a time.
QUERIES = 256
#: Rows (query, term) of a set of queries, and bytes of its table of weights, that are sent to the tasks; a larger set is joined with the postings.
SENT_ROWS, SENT_BYTES = 500_000, 32 << 20


def postings(chunks: DataFrame, tokens: Column | None = None, terms: DataFrame | None = None) -> DataFrame:
    """ord, type, len, term, tf of each chunk's terms; only of `terms`, if given. chunks: ord, type, text."""
    t = words(F.col("text")) if tokens is None else tokens
    rows = chunks.select("ord", "type", t.alias("t")).select("ord", "type", F.size("t").cast("long").alias("len"), F.explode("t").alias("term"))
    rows = rows if terms is None else rows.join(terms, "term", "left_semi")
    # A chunk's words lie together, so the partial counts before the shuffle are its whole counts.
    return rows.groupBy("ord", "type", "len", "term").agg(F.count("*").alias("tf"))


def term_table(chunks: DataFrame, tokens: Column | None = None) -> DataFrame:
    """term, df, and on the one row without a term: df (chunks) and words (of all chunks). One pass: each chunk gives its distinct terms and a null."""
    t = words(F.col("text")) if tokens is None else tokens
    rows = chunks.select(F.coalesce(t, F.array().cast("array<string>")).alias("t"))
    each = rows.select(F.size("t").cast("long").alias("len"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("t"))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("len"))).alias("words"))


def term_weights(table: DataFrame) -> DataFrame:
    """term, idf, avgdl. Negative idfs become a quarter of the mean idf over all terms. table: see term_table; what is one row is joined as one row."""
    size = table.filter("term is null").select(F.col("df").alias("n"), F.try_divide("words", "df").alias("avgdl"))
    raw = table.filter("term is not null").crossJoin(F.broadcast(size)).select("term", "avgdl", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _sent(asked: DataFrame) -> pa.Table | None:
    """asked (a row for each query and term), if its table of weights is small enough to be sent to the tasks and no id stands for queries of two types or lengths."""
    rows = asked.limit(SENT_ROWS + 1).toArrow()
    n, of_query = pc.count_distinct(rows["query_id"], mode="all").as_py(), [c for c in rows.column_names if c not in ("term", "w")]
    plain = rows.group_by(of_query).aggregate([]).num_rows == n
    return rows if plain and rows.num_rows <= SENT_ROWS and 8 * n * pc.count_distinct(rows["term"]).as_py() <= SENT_BYTES else None


def _repeated(chunks: DataFrame) -> DataFrame | None:
    """The ords that several chunks share; None, as is usual, if there are none."""
    many = chunks.groupBy("ord").agg(F.count("*").alias("n")).filter("n > 1").select("ord")
    return None if many.isEmpty() else many


def _best_in_tasks(rows: DataFrame, sent: pa.Table, most: int, digits: int, part: Callable | None = None) -> DataFrame:
    """query_id, ord, raw: each task's `most` best rows of every query, by the score rounded to `digits`, then ord. No posting is shuffled: a row's words become a row of a matrix
    of words, which is multiplied by the queries' weights.

    rows: ord, type, t (words), each ord once. sent: query_id, term, w; with doc_type the queries meet rows of that type alone, if it is not null; with ql the sum is
    divided by the root of ql times the row's words. part(tf, len): what a word adds, its tf if not given."""
    spark = rows.sparkSession
    asked, terms = pc.dictionary_encode(sent["query_id"].combine_chunks(), null_encoding="encode"), pc.dictionary_encode(sent["term"].combine_chunks())
    ids, of = asked.dictionary, asked.indices.to_numpy()
    w = np.zeros((len(terms.dictionary), len(ids)))
    np.add.at(w, (terms.indices.to_numpy(), of), sent["w"].to_numpy())
    first = np.unique(of, return_index=True)[1]
    ql = sent["ql"].to_numpy()[first] if "ql" in sent.column_names else None
    kinds = sent["doc_type"].combine_chunks().take(pa.array(first)) if "doc_type" in sent.column_names else None
    table = spark.sparkContext.broadcast((ids, terms.dictionary, w, ql, kinds))
    slab = max(1, min(1024, (16 << 20) // (8 * max(w.shape))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, w, ql, kinds = table.value
        key, raw, ord = np.full((len(ids), most), -1.0), np.zeros((len(ids), most)), np.full((len(ids), most), np.iinfo(np.int64).max)
        for b in batches:
            for i in range(0, b.num_rows, slab):
                some = b.slice(i, slab)
                n, t = some.num_rows, some.column(2)
                length = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
                at = pc.fill_null(pc.index_in(t.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False)
                cells = (np.repeat(np.arange(n), length) * len(terms) + at)[at >= 0]
                tf = np.bincount(cells, minlength=n * len(terms))
                there = np.flatnonzero(tf)
                x = np.zeros(tf.shape)
                x[there] = tf[there] if part is None else part(tf[there], length[there // len(terms)])
                s = (x.reshape(n, len(terms)) @ w).T
                if ql is not None:
                    s = np.divide(s, np.sqrt((ql[:, None] * length[None]).astype(float)), out=np.zeros_like(s), where=length[None] > 0)
                if kinds is not None:
                    values = pc.unique(pc.drop_null(kinds))
                    want, have = (pc.fill_null(pc.index_in(c, value_set=values), -1).to_numpy(zero_copy_only=False) for c in (kinds, some.column(1)))
                    s[(want[:, None] >= 0) & (want[:, None] != have[None])] = 0.0
                # Rounded halves up, as F.round does.
                near = np.where(s > 0, np.floor(s * 10.0**digits + 0.5 + 1e-11) / 10.0**digits, -1.0)
                hot = np.flatnonzero((near.max(1) >= key[:, -1]) & (near.max(1) >= 0))
                o = pc.fill_null(some.column(0), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                k, r, o = np.hstack([key[hot], near[hot]]), np.hstack([raw[hot], s[hot]]), np.hstack([ord[hot], np.broadcast_to(o, (len(hot), n))])
                order = np.lexsort((o, -k), axis=1)[:, :most]
                key[hot], raw[hot], ord[hot] = (np.take_along_axis(c, order, 1) for c in (k, r, o))
        q, at = np.nonzero(key >= 0)
        o = ord[q, at]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(o, mask=o == np.iinfo(np.int64).min), pa.array(raw[q, at])], ["query_id", "ord", "raw"])

    kind = T.StructType([T.StructField("query_id", _spark_type(ids.type)), T.StructField("ord", T.LongType()), T.StructField("raw", T.DoubleType())])
    return rows.select(F.col("ord").cast("long").alias("ord"), F.col("type").cast("string").alias("type"), "t").mapInArrow(run, kind)


def _spark_type(kind: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)


def _scores(chunks: DataFrame, asked: DataFrame, most: int, digits: int, tokens: Callable[[Column], Column], part: Callable | None, joined: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """query_id, ord, raw of at least the `most` best chunks of each query. asked: see sent of _best_in_tasks. joined: the same from chunks by their postings, for sets of queries
    that are too large to be sent and for chunks that share an ord, whose words count together. What the tasks found is written, as it is small and read several times."""
    sent = _sent(asked)
    if sent is None or not sent.num_rows:
        return joined(chunks)
    many = _repeated(chunks)
    once = chunks if many is None else chunks.join(many, "ord", "left_anti")
    rows = once.select("ord", "type", tokens(F.col("text")).alias("t"))
    found = _best_in_tasks(rows, sent, most, digits, part)
    found = found if many is None else found.unionByName(joined(chunks.join(many, "ord", "left_semi")))
    return kept(found, "hits")


def _bm25_part(avgdl: float | None) -> Callable:
    return lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def save_index(chunks: DataFrame, path: str, tokens: Callable[[Column], Column] = words) -> tuple[int, int]:
    """Writes a corpus's postings, and its terms with their weights, as Parquet; chunks and postings written. Sorted by term, so a query's terms prune."""
    index = postings(chunks, tokens(F.col("text")))
    seen = Observation("index")
    index.repartitionByRange("term").sortWithinPartitions("term").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/postings")
    term_weights(term_table(chunks, tokens(F.col("text")))).write.mode("overwrite").parquet(f"{path}/terms")
    return chunks.count(), seen.get["n"]


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """postings and weighted terms, as save_index wrote them."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")


def bm25(chunks: DataFrame | None, queries: DataFrame, k: int = 10, types: list[str] | None = None, tokens: Callable[[Column], Column] = words, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, ord, rank (from 0), score (4 places) of the k best chunks with a score above 0. Corpus statistics stay those of all chunks when types
    filter; a word that a query repeats counts as often; ties keep the corpus's order. queries: query_id, query. index: of load_index, instead of chunks.

    The corpus is read twice: for the term table, which is written once, and for the scores, which each task sums up for its own chunks."""
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    if index is None:
        chosen = chunks if types is None else chunks.filter(F.col("type").isin(types))
        weighted = asked.join(term_weights(kept(term_table(chunks, tokens(F.col("text"))), "terms")), "term").withColumn("w", F.col("qtf") * F.col("idf"))
        avgdl = weighted.select("avgdl").first()
        joined = lambda some: postings(some, tokens(F.col("text")), asked.select("term").distinct()).join(weighted, "term").groupBy("query_id", "ord").agg(F.sum(part).alias("raw"))
        scores = _scores(chosen, weighted.select("query_id", "term", "w"), k, 9, tokens, _bm25_part(avgdl and avgdl[0]), joined)
    else:
        found, weights = index
        found = found if types is None else found.filter(F.col("type").isin(types))
        scores = found.join(asked.join(weights, "term"), "term").groupBy("query_id", "ord").agg(F.sum(part).alias("raw"))
    w = Window.partitionBy("query_id").orderBy(F.round("raw", 9).desc(), "ord")
    return scores.filter("raw > 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "ord", (F.col("place") - 1).cast("long").alias("rank"), F.round("raw", 4).alias("score"))


def search_guide(chunks: DataFrame, requests: DataFrame, bounds: tuple[int, int] = (1, 20), tokens: Callable[[Column], Column] = words) -> DataFrame:
    """req_id, found, rank, ord, score, evidence (retrieved) for the k best chunks of each request, k held to the bounds, of one type if it names one. A request
    that is blank or finds nothing has one row, found = false. requests: req_id, query, k, doc_type. Weights are those of the whole corpus."""
    wanted = requests.select("req_id", F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.coalesce("k", F.lit(5)))).alias("k"), "doc_type", "query")
    asked = wanted.select("req_id", "k", "doc_type", F.explode(tokens(F.col("query"))).alias("term")).groupBy("req_id", "k", "doc_type", "term").agg(F.count("*").alias("qtf"))
    weighted = asked.join(term_weights(kept(term_table(chunks, tokens(F.col("text"))), "terms")), "term").withColumn("w", F.col("qtf") * F.col("idf"))
    avgdl = weighted.select("avgdl").first()
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))

    def joined(some: DataFrame) -> DataFrame:
        found = postings(some, tokens(F.col("text")), asked.select("term").distinct()).join(weighted, "term").filter("doc_type is null or type = doc_type")
        return found.groupBy("req_id", "ord").agg(F.sum(part).alias("raw")).select(F.col("req_id").alias("query_id"), "ord", "raw")

    scores = _scores(chunks, weighted.select(F.col("req_id").alias("query_id"), "term", "w", "doc_type"), bounds[1], 9, tokens, _bm25_part(avgdl and avgdl[0]), joined)
    scores = scores.filter("raw > 0").withColumnRenamed("query_id", "req_id").join(wanted.select("req_id", "k").groupBy("req_id").agg(F.first("k").alias("k")), "req_id")
    place = F.row_number().over(Window.partitionBy("req_id").orderBy(F.round("raw", 9).desc(), "ord"))
    best = scores.withColumn("place", place).filter(F.col("place") <= bounds[1]).filter("place <= k")
    best = best.select("req_id", (F.col("place") - 1).cast("long").alias("rank"), "ord", F.round("raw", 4).alias("score"))
    return requests.select("req_id").join(best, "req_id", "left").select("req_id", F.col("ord").isNotNull().alias("found"), "rank", "ord", "score", F.lit("retrieved").alias("evidence"))


def token_overlap(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ord, rank, score: chunk words among the query's, over the root of both lengths' product (4 places)."""
    asked = queries.select("query_id", words(F.col("query")).alias("q")).select("query_id", F.size("q").alias("ql"), F.explode(F.array_distinct("q")).alias("term"))

    def joined(some: DataFrame) -> DataFrame:
        have = postings(some, terms=asked.select("term").distinct())
        return have.join(asked, "term").groupBy("query_id", "ord").agg((F.sum("tf") / F.sqrt(F.first("ql") * F.first("len"))).alias("raw"))

    scores = _scores(chunks, asked.select("query_id", "term", "ql", F.lit(1.0).alias("w")), k, 4, words, None, joined)
    scores = scores.select("query_id", "ord", F.round("raw", 4).alias("score")).filter("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord")
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "ord", (F.col("place") - 1).cast("long").alias("rank"), "score")


def hashed_embedder(dimensions: int = 64) -> Callable[[Column], Column]:
    """A deterministic embedder for offline use: signed feature hashing of words, unit length; null or wordless texts give zeros."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict[str, tuple[int, float]] = {}
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dimensions)
                for w in (t or "").lower().split():
                    if (at := seen.get(w)) is None:
                        h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                        at = seen[w] = (h % dimensions, 1.0 if h >> 63 else -1.0)
                        if len(seen) > 200_000:
                            seen.clear()
                    v[at[0]] += at[1]
                n = math.sqrt(v @ v)
                out.append((v / n if n else v).astype("float32"))
            yield pd.Series(out)

    return embed


def embed(chunks: DataFrame, text: str = "text", embedder: Callable[[Column], Column] | None = None, prefix: str = "") -> DataFrame:
    """chunks with a column embedding. A prefix stands before each text, as for queries with an instruction."""
    return chunks.withColumn("embedding", (embedder or hashed_embedder())(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit("")))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine, l2 (squared) or ip distance of two array columns."""
    if metric == "ip":
        return 1 - dot(a, b)
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, metric: str = "cosine", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, vec_id, rank, score (1 - distance, 4 places), exact. The filter comes before ranking. queries: query_id, q.

    The queries are a stated set, met by all rows: in blocks, each sent to the tasks, which return their own k best for each query."""
    chosen = vectors if where is None else vectors.filter(where)
    chosen = chosen.select("vec_id", "embedding")
    asked = queries.select("query_id", "q")
    spark = vectors.sparkSession
    parts = []

    def flush(rows):
        ids, q = np.array([r.query_id for r in rows]), np.array([r.q for r in rows], float)
        sent = spark.sparkContext.broadcast((ids, q))

        def first(q: np.ndarray, y: np.ndarray, c: np.ndarray, best: tuple | None) -> tuple:
            """The k best of y and of those found before: scores and ids."""
            s = q @ y.T
            if metric == "cosine":
                lengths = np.outer(np.sqrt((q * q).sum(1)), np.sqrt((y * y).sum(1)))
                s = np.divide(s, lengths, out=np.zeros_like(s), where=lengths > 0)
            elif metric == "l2":
                s = 1 - ((q * q).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * s)
            s = np.round(s, 9)
            found = np.broadcast_to(c, s.shape)
            if best is not None:
                s, found = np.hstack([best[0], s]), np.hstack([best[1], found])
            order = np.lexsort((found, -s), axis=1)[:, :k]
            return np.take_along_axis(s, order, 1), np.take_along_axis(found, order, 1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = sent.value
            best = None
            for pdf in batches:
                if pdf.empty:
                    continue
                x = np.stack(pdf.embedding.to_numpy()).astype(float)
                cand = pdf.vec_id.to_numpy()
                for a in range(0, len(cand), 2048):
                    y, c = x[a : a + 2048], cand[a : a + 2048]
                    # Some queries at a time, so that a table of scores stays small however many queries were sent.
                    best = [first(q[i : i + QUERIES], y, c, best and best[j]) for j, i in enumerate(range(0, len(q), QUERIES))]
            for j, (sim, ids2) in enumerate(best or []):
                asked_ids = ids[j * QUERIES : (j + 1) * QUERIES]
                yield pd.DataFrame({"query_id": np.repeat(asked_ids, sim.shape[1]), "vec_id": ids2.ravel(), "sim": sim.ravel()})

        parts.append(chosen.mapInPandas(run, "query_id long, vec_id long, sim double"))

    rows = []
    for r in asked.toLocalIterator():
        rows.append(r)
        if 8 * len(r.q) * len(rows) >= block_bytes:
            flush(rows)
            rows = []
    if rows or not parts:
        if not rows:
            return spark.createDataFrame([], "query_id long, vec_id long, rank long, score double")
        flush(rows)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "vec_id")
    return whole.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "vec_id", (F.col("place") - 1).cast("long").alias("rank"), F.round("sim", 4).alias("score"))


def pool_size(k: int) -> int:
    """How many hits vector search fetches before reranking."""
    return max(k, min(4 * k, 20))


def explicitly_named(source: Column, kind: Column, query: Column) -> Column:
    """Whether the query names the chunk's source; of a stage, its code will do."""
    name = F.trim(F.coalesce(source, F.lit("")))
    return F.coalesce(named_in(name, query) | ((kind == "stage") & named_in(F.split_part(name, F.lit(" "), F.lit(1)), query)), F.lit(False))


def named_rerank(hits: DataFrame, k: int) -> DataFrame:
    """The first k of each query: named ones first, then by score, then as they were. hits: query_id, query, source, type, rank, score."""
    w = Window.partitionBy("query_id").orderBy(F.col("named").desc(), F.col("score").desc(), "rank")
    return hits.withColumn("named", explicitly_named(F.col("source"), F.col("type"), F.col("query"))).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).withColumn("rank", (F.col("place") - 1).cast("long")).drop("place")


def rrf_fuse(hits: DataFrame, constant: int = RRF) -> DataFrame:
    """query_id, content, score (6 places) and paths (each hit's path, in order) by reciprocal ranks. hits: query_id, path, content, rank and any
    metadata columns, of which the first hit's stand. Repeats inside a path add up."""
    rest = [c for c in hits.columns if c not in ("query_id", "path", "content", "rank")]
    out = hits.groupBy("query_id", "content").agg(F.round(F.sum(1.0 / (constant + F.col("rank") + 1)), 6).alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("path", "rank"))), lambda x: x.path).alias("paths"), *[F.min_by(c, F.struct("path", "rank")).alias(c) for c in rest])
    return out


def hybrid(vector_hits: DataFrame, bm25_hits: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k best of each query after fusion and reranking; a query without BM25 hits keeps its vector hits and their scores (degraded). Hits: query_id, content,
    rank, score, source, type. queries: query_id, query."""
    keep = ["query_id", "content", "rank", "source", "type"]
    both = vector_hits.select(*keep, F.lit(0).alias("path")).unionByName(bm25_hits.select(*keep, F.lit(1).alias("path")))
    with_words = bm25_hits.select("query_id").distinct()
    fused = rrf_fuse(both.join(with_words, "query_id", "left_semi")).select("query_id", "content", "source", "type", "score", F.lit(False).alias("degraded"))
    alone = vector_hits.join(with_words, "query_id", "left_anti").select("query_id", "content", "source", "type", "score", F.lit(True).alias("degraded"))
    every = fused.unionByName(alone).join(queries.select("query_id", "query"), "query_id").withColumn("named", explicitly_named(F.col("source"), F.col("type"), F.col("query")))
    w = Window.partitionBy("query_id").orderBy(F.col("named").desc(), F.col("score").desc(), "content")
    return every.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).select("query_id", "content", "source", "type", "score", "named", "degraded", (F.col("place") - 1).cast("long").alias("rank"))


def hit_at_k(hits: DataFrame, expectations: DataFrame, fits: Column, k: int = 5) -> DataFrame:
    """query_id, hit, hit_rank of each expectation: the first of its query's k best hits that fits. A query without such a hit has a null rank. fits: a
    condition over the columns of both, which share query_id alone."""
    found = hits.filter(F.col("rank") < k).join(expectations, "query_id").filter(fits).groupBy("query_id").agg(F.min("rank").cast("long").alias("hit_rank"))
    return expectations.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.col("hit_rank").isNotNull().alias("hit"), "hit_rank")
