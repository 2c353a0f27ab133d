"""Retrieval and chunking over documents (chunks: ord = doc_id, type = lang), benchmark (queries) and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.text import minutes_seconds, page_url, sentences, stable_id
from plinth.functions.names import splitter
from plinth.functions.shared import kept, shared_folder
from plinth.operators import blocks, chunking, retrieval, vector_index
from plinth.plans.registry import Tables, query

BASE = "https://wiki.example/w/"


def chunks(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("ord"), F.col("lang").alias("type"), "source", "text")


def asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_BM25 = r"""
with toks as (select doc_id as ord, lang as type, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as t from documents),
size as (select count(*) as n, avg(len(t)) as avgdl from toks),
post as (select ord, type, dl, term, count(*) as tf from (select ord, type, len(t) as dl, unnest(t) as term from toks) group by all),
df as (select term, count(*) as df from post group by term),
raw as (select term, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, size),
idf as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as term from benchmark) group by all),
s as (
  select query_id, ord, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as raw
  from post join idf using (term) join q using (term), size {where} group by all),
r as (select query_id, ord, row_number() over (partition by query_id order by round(raw, 9) desc, ord) - 1 as rank, raw from s where raw > 0)
select query_id, ord, rank, round(raw, 4) as score from r where rank < {k}
"""


@query(_BM25.format(where="", k=5))
def bm25_topk(t: Tables) -> DataFrame:
    return retrieval.bm25(chunks(t), asked(t), 5)


@query(_BM25.format(where="where type in ('en', 'fr')", k=5))
def bm25_topk_by_lang(t: Tables) -> DataFrame:
    return retrieval.bm25(chunks(t), asked(t), 5, types=["en", "fr"])


@query(_BM25.format(where="", k=5))
def bm25_blocks_topk(t: Tables) -> DataFrame:
    """The same rows from an index in blocks, with the postings left unread that can't matter."""
    return blocks.top_k(blocks.build(chunks(t)), asked(t), 5)


_KEYWORDS = r"""
kw as (
  select item_id as query_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), 'DESC')[:2], ' ') || ' ' || array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')))[:1], ' ') as query from benchmark),
"""


def keywords(t: Tables) -> DataFrame:
    """Short queries: of each item the two last words of the alphabet and the first."""
    w = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.array_join(F.slice(F.reverse(w), 1, 2), " "), F.lit(" "), F.array_join(F.slice(w, 1, 1), " ")).alias("query"))


@query(_BM25.replace("with toks", "with " + _KEYWORDS.strip().replace("{", "{{").replace("}", "}}") + "\ntoks").replace("(select item_id as query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) as term from benchmark)", "(select query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) as term from kw)").format(where="where type in ('en', 'fr')", k=10))
def bm25_keywords_topk(t: Tables) -> DataFrame:
    """Short queries against two languages: few rare words set a threshold that the frequent one can't reach alone."""
    return blocks.top_k(blocks.build(chunks(t)), keywords(t), 10, types=["en", "fr"])


@query(r"""
with d as (select doc_id as ord, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as t from documents),
q as (select item_id as query_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as q from benchmark),
terms as (select distinct query_id, len(q) as ql, unnest(q) as term from q),
words as (select ord, len(t) as dl, unnest(t) as term from d),
s as (select query_id, ord, round(count(*) / sqrt(any_value(ql) * any_value(dl)), 4) as score from words join terms using (term) group by query_id, ord),
r as (select query_id, ord, row_number() over (partition by query_id order by score desc, ord) - 1 as rank, score from s where score > 0)
select * from r where rank < 5
""")
def token_overlap_topk(t: Tables) -> DataFrame:
    return retrieval.token_overlap(chunks(t), asked(t), 5)


_VECTORS = """
with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 50 = 0),
s as (select query_id, vec_id, round(list_sum(list_transform(list_zip(q, embedding), lambda x: x[1]::double * x[2]::double)) / sqrt(list_sum(list_transform(q, lambda x: x::double * x::double)) * list_sum(list_transform(embedding, lambda x: x::double * x::double))), 9) as sim from q, embeddings {where}),
r as (select query_id, vec_id, row_number() over (partition by query_id order by sim desc, vec_id) - 1 as rank, sim from s)
select query_id, vec_id, rank, round(sim, 4) as score from r where rank < {k}
"""


def vector_queries(t: Tables) -> DataFrame:
    return t.embeddings.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query(_VECTORS.format(where="", k=5))
def vector_topk(t: Tables) -> DataFrame:
    return retrieval.vector_top_k(t.embeddings, vector_queries(t), 5)


@query(_VECTORS.format(where="where label <= 3", k=5))
def vector_topk_filtered(t: Tables) -> DataFrame:
    return retrieval.vector_top_k(t.embeddings, vector_queries(t), 5, where=F.col("label") <= 3)


@query(f"""
with hits as ({_VECTORS.format(where="", k=20)}),
n as (select h.*, (l.label = ql.label) as named from hits h join embeddings l on h.vec_id = l.vec_id join embeddings ql on h.query_id = ql.vec_id),
r as (select query_id, vec_id, score, named, row_number() over (partition by query_id order by named desc, score desc, rank) - 1 as rank from n)
select query_id, vec_id, score, named, rank from r where rank < 5
""")
def vector_named_rerank(t: Tables) -> DataFrame:
    """Vectors are named by their label, and a query names its own label."""
    hits = retrieval.vector_top_k(t.embeddings, vector_queries(t), retrieval.pool_size(5))
    label = F.concat(F.lit("label-"), F.col("label").cast("string"))
    named = hits.join(t.embeddings.select("vec_id", label.alias("source")), "vec_id").join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.concat(F.lit("about "), label, F.lit(".")).alias("query")), "query_id")
    return retrieval.named_rerank(named.withColumn("type", F.lit("vector")), 5).select("query_id", "vec_id", "score", "named", "rank")


def vector_lists(t: Tables) -> vector_index.VectorIndex | None:
    model = vector_index.fit(t.embeddings, k=10)
    return model and vector_index.save(t.embeddings, shared_folder(t.spark, "vectors"), model)


@query()
def vector_ann_topk(t: Tables) -> DataFrame:
    """Approximate neighbours from the learnt index over all vectors; vector_ann_recall holds them against the exact ones."""
    index = vector_lists(t)
    return vector_index.search(index, vector_queries(t), 10) if index else retrieval.vector_top_k(t.embeddings, vector_queries(t), 10)


@query("select count(*) filter (vec_id % 50 = 0) as queries, true as found_nine_of_ten, true as scores_exact, count(*) as indexed from embeddings")
def vector_ann_recall(t: Tables) -> DataFrame:
    """Whether the index finds nine of ten exact neighbours (k = 10) of every fiftieth vector, scores them as exactly, and holds every row."""
    index = vector_lists(t)
    found = kept(vector_index.search(index, vector_queries(t), 10), "found")
    exact = kept(retrieval.vector_top_k(t.embeddings, vector_queries(t), 10), "exact")
    off = found.join(exact.withColumnRenamed("score", "s"), ["query_id", "vec_id"]).agg(F.coalesce(F.max(F.abs(F.col("score") - F.col("s"))), F.lit(0.0)).alias("off"))
    rows = index.vectors.agg(F.count("*").alias("indexed"))
    return vector_index.recall(found, exact).crossJoin(off).crossJoin(rows).select("queries", (F.col("recall") >= 0.9).alias("found_nine_of_ten"), (F.col("off") < 1.5e-4).alias("scores_exact"), "indexed")


@query(r"""
with n as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{6,20}')) as n from benchmark),
p as (select string_agg(n, '|' order by length(n) desc, n) as p from n),
m as (select doc_id, regexp_extract_all(lower(text), p) as m from documents, p)
select doc_id, len(m)::bigint as n_names, md5(array_to_string(m, ',')) as names from m
""")
def names_in_texts(t: Tables) -> DataFrame:
    """The longer words of the benchmark as a list of names, found in all documents at once: leftmost, longest, none over another."""
    listed = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,20}"), F.lit(0))).alias("n")).distinct()
    found = splitter(t.spark, [r.n for r in listed.toLocalIterator()])(F.col("text"))["names"]
    return t.documents.select("doc_id", F.size(found).cast("long").alias("n_names"), F.md5(F.array_join(found, ",")).alias("names"))


def with_meta(t: Tables, hits: DataFrame) -> DataFrame:
    return hits.join(chunks(t).select("ord", "source", "type", F.col("ord").cast("string").alias("content")), "ord").drop("ord")


def two_paths(t: Tables) -> tuple[DataFrame, DataFrame]:
    return with_meta(t, retrieval.token_overlap(chunks(t), asked(t), 10)), with_meta(t, retrieval.bm25(chunks(t), asked(t), 10))


_PATHS = f"""
a as ({_BM25.format(where="", k=10)}),
b as (with d as (select doc_id as ord, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as t from documents),
  q as (select item_id as query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as q from benchmark),
  terms as (select distinct query_id, len(q) as ql, unnest(q) as term from q), words as (select ord, len(t) as dl, unnest(t) as term from d),
  s as (select query_id, ord, round(count(*) / sqrt(any_value(ql) * any_value(dl)), 4) as score from words join terms using (term) group by query_id, ord),
  r as (select query_id, ord, row_number() over (partition by query_id order by score desc, ord) - 1 as rank, score from s where score > 0)
  select * from r where rank < 10),
fused as (select query_id, ord, round(sum(1.0 / (60 + rank + 1)), 6) as score, string_agg(path::varchar, ',' order by path) as paths from (select *, 0 as path from b union all select *, 1 as path from a) group by query_id, ord)
"""


@query(f"with {_PATHS} select query_id, ord::varchar as content, score, paths from fused")
def rrf_fuse(t: Tables) -> DataFrame:
    b, a = two_paths(t)
    both = b.withColumn("path", F.lit(0)).unionByName(a.withColumn("path", F.lit(1)))
    return retrieval.rrf_fuse(both.select("query_id", "path", "content", "rank", "source", "type")).select("query_id", "content", "score", F.array_join(F.col("paths").cast("array<string>"), ",").alias("paths"))


@query(f"""
with {_PATHS},
n as (select f.query_id, f.ord::varchar as content, d.source, d.lang as type, f.score, regexp_matches(bm.text, '(^|[^0-9A-Za-z])' || d.source || '($|[^0-9A-Za-z])') as named from fused f join documents d on d.doc_id = f.ord join benchmark bm on bm.item_id = f.query_id),
r as (select *, row_number() over (partition by query_id order by named desc, score desc, content) - 1 as rank from n)
select query_id, content, source, type, score, named, false as degraded, rank from r where rank < 5
""")
def hybrid_search(t: Tables) -> DataFrame:
    b, a = two_paths(t)
    return retrieval.hybrid(b, a, asked(t), 5)


#: Queries whose own words are all out of BM25's reach: it answers from one language's documents only.
_FALLBACK = f"""
a as ({_BM25.format(where="where type = 'de'", k=10)}),
b as (with d as (select doc_id as ord, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as t from documents),
  q as (select item_id as query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as q from benchmark),
  terms as (select distinct query_id, len(q) as ql, unnest(q) as term from q), words as (select ord, len(t) as dl, unnest(t) as term from d),
  s as (select query_id, ord, round(count(*) / sqrt(any_value(ql) * any_value(dl)), 4) as score from words join terms using (term) group by query_id, ord),
  r as (select query_id, ord, row_number() over (partition by query_id order by score desc, ord) - 1 as rank, score from s where score > 0)
  select * from r where rank < 10),
fused as (select query_id, ord, round(sum(1.0 / (60 + rank + 1)), 6) as score, false as degraded from (select * from b where query_id in (select query_id from a) union all select * from a) group by query_id, ord
  union all select query_id, ord, score, true from b where query_id not in (select query_id from a))
"""


@query(f"""
with {_FALLBACK},
n as (select f.query_id, f.ord::varchar as content, f.score, f.degraded, regexp_matches(bm.text, '(^|[^0-9A-Za-z])' || d.source || '($|[^0-9A-Za-z])') as named from fused f join documents d on d.doc_id = f.ord join benchmark bm on bm.item_id = f.query_id),
r as (select *, row_number() over (partition by query_id order by named desc, score desc, content) - 1 as rank from n)
select query_id, content, score, degraded, rank from r where rank < 5
""")
def hybrid_fallback(t: Tables) -> DataFrame:
    """All queries; those that BM25 over German documents can't answer keep the other path's hits and scores."""
    b = with_meta(t, retrieval.token_overlap(chunks(t), asked(t), 10))
    a = with_meta(t, retrieval.bm25(chunks(t), asked(t), 10, types=["de"]))
    return retrieval.hybrid(b, a, asked(t), 5).select("query_id", "content", "score", "degraded", "rank")


@query(f"""
with hits as ({_BM25.format(where="", k=5)}),
h as (select query_id, min(rank) as hit_rank from hits join documents d on d.doc_id = ord join benchmark b on b.item_id = query_id where contains(d.text, b.text) group by query_id)
select item_id as query_id, hit_rank is not null as hit, coalesce(hit_rank, -1) as hit_rank from benchmark left join h on query_id = item_id
""")
def retrieval_hit_at_k(t: Tables) -> DataFrame:
    """Whether the documents found for an item hold its whole text."""
    hits = retrieval.bm25(chunks(t), asked(t), 5).join(chunks(t).select("ord", "text"), "ord")
    found = retrieval.hit_at_k(hits, asked(t), F.contains("text", F.col("query")))
    return found.select("query_id", "hit", F.coalesce("hit_rank", F.lit(-1)).alias("hit_rank"))


_GUIDE = _BM25.format(where="", k=20).split("\ns as (")[0]


@query(_GUIDE + r"""
a as (select query_id, 1 + query_id % 25 as k, case query_id % 3 when 1 then 'en' when 2 then 'xx' end as doc_type from (select item_id as query_id from benchmark)),
s as (
  select query_id, ord, any_value(k) as k, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as raw
  from post join idf using (term) join q using (term) join a using (query_id), size where doc_type is null or type = doc_type group by query_id, ord),
r as (select query_id, ord, k, row_number() over (partition by query_id order by round(raw, 9) desc, ord) - 1 as rank, round(raw, 4) as score from s where raw > 0)
select a.query_id as req_id, ord is not null as found, rank, ord, score, 'retrieved' as evidence from a left join r on a.query_id = r.query_id and rank < least(20, r.k)
""")
def guide_search(t: Tables) -> DataFrame:
    """Requests with their own k (beyond the bound for some) and type (one that no document has, for a third)."""
    kind = F.when(F.col("query_id") % 3 == 1, "en").when(F.col("query_id") % 3 == 2, "xx")
    return retrieval.search_guide(chunks(t), asked(t).select(F.col("query_id").alias("req_id"), "query", (1 + F.col("query_id") % 25).cast("int").alias("k"), kind.alias("doc_type")))


@query()
def embedded_topk(t: Tables) -> DataFrame:
    """Documents and prefixed queries through the offline embedder, then exact top-k."""
    docs = retrieval.embed(chunks(t)).select(F.col("ord").alias("vec_id"), "embedding")
    q = retrieval.embed(asked(t), "query", prefix="query: ").select("query_id", F.col("embedding").alias("q"))
    return retrieval.vector_top_k(docs, q, 3)


# -- chunking ----------------------------------------------------------------------------------------------------------------------------------


@query(r"""
with s as (select doc_id, unnest(string_split(regexp_replace(text, '([。；！？?!\n])', '\1' || chr(1), 'g'), chr(1))) as s from documents)
select doc_id, count(*)::bigint as n_sentences from s where regexp_matches(s, '\S') group by doc_id
""")
def sentence_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(sentences(F.col("text"))).cast("long").alias("n_sentences")).filter("n_sentences > 0")


@query()
def chunk_pack(t: Tables) -> DataFrame:
    """Documents packed into chunks of at most 500 characters."""
    return document_chunks(t).select("id", "source", "type", "ord", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def document_chunks(t: Tables) -> DataFrame:
    guides = t.documents.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "text")
    return chunking.chunks(chunking.guide_sections(guides), BASE)


@query("""
select md5('guide|' || 'doc ' || doc_id || '|body|0') as id, 'https://wiki.example/w/' || url_encode('doc ' || doc_id || ' (' || lang || ')~*') as url from documents
""")
def chunk_ids(t: Tables) -> DataFrame:
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return t.documents.select(stable_id(F.lit("guide"), title, F.lit("body"), F.lit(0)).alias("id"), page_url(F.concat(title, F.lit(" ("), "lang", F.lit(")~*")), BASE).alias("url"))


@query("""
with r as (select lang as type, length(text) as len, row_number() over (partition by lang order by length(text)) - 1 as r, count(*) over (partition by lang) as n from documents)
select type, count(*) as n_chunks, min(len) as shortest, max(len) as longest, count(*) filter (where len > 500) as over, max(len) filter (where r = n // 2) as upper_median from r group by type
""")
def chunk_stats(t: Tables) -> DataFrame:
    found = chunks(t)
    median = chunking.upper_median(found.withColumn("len", F.length("text").cast("long")), ["type"], "len")
    return chunking.chunk_stats(found).join(median, "type")


@query("select doc_id, printf('%02d:%02d', n_chars // 60, n_chars % 60) as clock from documents")
def clock_format(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", minutes_seconds(F.col("n_chars").cast("double")).alias("clock"))
