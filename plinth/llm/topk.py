"""Exact top-k inner products: norm-sorted candidates, rotated partial sums, Cauchy-Schwarz bounds.

Candidates are dealt in ranges of descending length. The second-moment matrix of all of them (summed by Spark) gives a
rotation whose first axes hold most of the length (the right singular vectors). For a query, the product over the first
axes plus the product of the two remainders' lengths bounds the score from above (Cauchy-Schwarz); a candidate whose bound is below the
query's current k-th score is dropped, and as lengths descend, a whole block is dropped once length times length is below it. What is left
is scored with exact integers.

The queries are a stated set. Nothing of them passes through the driver: candidates are dealt in ranges of PART rows, queries in blocks of
QUERY_BLOCK, and each pair of a range and a block meets in one group, which bounds what a task holds. A group returns the k best for each
query that it can't rule out. The driver sees d * d sums, and the BLOCK longest rows, whose k best bound each query's k-th score from below.

Defined results: vectors that are null, empty or hold a null or a non-finite component take no part, nor do rows with a null vec_id;
vectors of fewer components than the longest are filled up with zeros; vec_id names a row: rows that share the query's are its own;
exact repeats (vec_id and x) count once, rows of one id with other vectors are candidates each; a repeated query id asks with its least vector; equal scores go to the smaller vec_id; fewer candidates than k give as many rows as there are; an empty table gives no rows. Other columns are never read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import column, cut

K, SCALE, EVERY = 5, 256, 50
#: Queries and candidates of one group; candidates of one bound test.
QUERY_BLOCK, PART, BLOCK = 4096, 32_768, 1024
#: Part of the squared length that the first axes must hold.
HEAD = 0.7


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array of long: floor(scale * component)) and norm of each usable row."""
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    return rows.filter(usable).select(F.col("vec_id").cast("long"), whole.alias("x")).withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def _matrix(values: list[list[int]], d: int) -> np.ndarray:
    out = np.zeros((len(values), d), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def rotation(rows: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """The axes by descending share of the squared length, and how many make the head. d * d sums reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(column(b, "x"), d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    total = np.zeros(d * d)
    for r in rows.select("x").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        total[r.at] = r.v
    values, axes = np.linalg.eigh(total.reshape(d, d))
    share = np.cumsum(values[::-1]) / max(values.sum(), 1e-9)
    return axes[:, ::-1], int(min(d, max(1, np.searchsorted(share, HEAD) + 1)))


def best(ids: np.ndarray, x: np.ndarray, norms: np.ndarray, queries, k: int, axes: np.ndarray, head: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best of these candidates (in descending length) for each query."""
    q_ids, q, floor = queries
    # Work in doubles is off by far less than this; scores are integers, so a bound may be too high by a half without harm.
    slack = 0.5
    turned, q_turned = x @ axes, q @ axes
    rest, q_rest = np.sqrt((turned[:, head:] ** 2).sum(1)), np.sqrt((q_turned[:, head:] ** 2).sum(1))
    q_norms = np.sqrt((q.astype(float) ** 2).sum(1))
    heaps: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    low = floor.astype(float)
    for a in range(0, len(ids), BLOCK):
        b = min(len(ids), a + BLOCK)
        live = np.flatnonzero(q_norms * norms[a] + slack >= low)
        if not len(live):
            break
        bound = q_turned[live, :head] @ turned[a:b, :head].T + np.outer(q_rest[live], rest[a:b]) + slack
        own = ids[None, a:b] == q_ids[live, None]
        at_q, at_c = np.nonzero((bound >= low[live, None]) & ~own)
        if not len(at_q):
            continue
        scores = np.einsum("ij,ij->i", q[live[at_q]], x[a + at_c]) if len(at_q) < 200_000 else np.concatenate([np.einsum("ij,ij->i", q[live[at_q[i : i + 200_000]]], x[a + at_c[i : i + 200_000]]) for i in range(0, len(at_q), 200_000)])
        cand = ids[a + at_c]
        order = np.lexsort((cand, -scores, at_q))
        at_q, scores, cand = at_q[order], scores[order], cand[order]
        starts = np.flatnonzero(np.r_[True, at_q[1:] != at_q[:-1]])
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(at_q)).tolist()):
            i = int(live[at_q[s]])
            e = min(e, s + k)
            heaps[i] = heapq.nsmallest(k, heaps[i] + list(zip((-scores[s:e]).tolist(), cand[s:e].tolist())))
            if len(heaps[i]) == k:
                low[i] = max(low[i], -heaps[i][-1][0])
    return [(int(q_ids[i]), c, -s) for i, h in enumerate(heaps) for s, c in h]


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. rows and queries: vec_id, x (array of long), norm (see quantised)."""
    spark = rows.sparkSession
    rows = cut(rows.dropDuplicates(["vec_id", "x"]))
    queries = cut(queries.groupBy("vec_id").agg(F.min("x").alias("x")))
    widest, n = rows.agg(F.max(F.size("x")), F.count("*")).first()
    d, asked = widest or 1, queries.count()
    axes, head = rotation(rows, d)
    longest = rows.orderBy(F.col("norm").desc(), "vec_id").limit(BLOCK).select("vec_id", "x").collect()
    sent = spark.sparkContext.broadcast((np.array([r.vec_id for r in longest], np.int64), _matrix([r.x for r in longest], d), axes, head))
    parts = max(1, -(-n // PART), min(spark.sparkContext.defaultParallelism, n // BLOCK))
    blocks = max(1, -(-asked // QUERY_BLOCK))
    # Ranges of descending length; ties are dealt by id, so that equal vectors don't fill one range. A range is what its task got, so written first.
    ranged = cut(rows.repartitionByRange(parts, F.col("norm").desc(), F.xxhash64("vec_id")).select("vec_id", "x", "norm", F.spark_partition_id().cast("long").alias("part")))
    parts = (ranged.agg(F.max("part")).first()[0] or 0) + 1
    left = ranged.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long"))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def meet(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and asking.num_rows:
            seed_ids, seed, axes, head = sent.value
            order = np.argsort(-np.array(candidates["norm"]), kind="stable")
            q_ids, q = np.array(asking["vec_id"]), _matrix(asking["x"].to_pylist(), d)
            # The k best of the longest candidates, the query's own rows aside, bound the k-th score from below.
            floor = np.full(len(q), -(1 << 62))
            if len(seed) >= k:
                floor = np.partition(np.where(q_ids[:, None] == seed_ids, -(1 << 62), q @ seed.T), -k, axis=1)[:, -k]
            found = best(np.array(candidates["vec_id"])[order], _matrix(candidates["x"].to_pylist(), d)[order], np.array(candidates["norm"])[order], (q_ids, q, floor), k, axes, head)
        return pa.table({name: pa.array([x[i] for x in found], pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score"))})

    whole = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return whole.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_fiftieth(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The top k of every vector whose id is divisible by `every`, among all others."""
    rows = cut(quantised(embeddings))
    return top_k(rows, rows.filter(F.col("vec_id") % every == 0), k)
