"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are written once, and the partitions of that writing are the matrix's rows; its columns are blocks of the output, with sizes fixed beforehand.
The matrix says how many rows go from each partition to each block, by the multivariate hypergeometric law that a uniform permutation has. It is
never drawn whole: the partitions are halved again and again, each halving draws how many rows of each block fall to the left half, from a seed of
its own. So a task finds its partition's row of the matrix in a logarithmic number of draws, the same whenever it is run again, and the driver holds
no more than the number of rows of each partition.

Each partition permutes its rows and deals them out by its row of the matrix, the rows move to their blocks once, and each block permutes what it gets:
together a uniform permutation with exact sizes. A shard is a run of consecutive blocks, so no task holds a whole shard.

Law `rows`: shard sizes differ by one at most. Rows are dealt by their place alone, never by a key, so repeated rows or equal ids make no
block large. Places are read from the checkpoint folder, so a lost executor can't change them.

Defined results: a null text has no bytes (size 16, crc32 0); null or repeated ids get a row each; an empty table gives no rows; with fewer rows than
shards some shards are empty; ties of the random key fall to the row's place; texts of any length and all other columns move with their
row, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plinth.llm.common import numbered

SHARDS, ROW_BYTES = 40, 16
#: Rows of a block, which one task sorts.
BLOCK_ROWS = 50_000
#: numpy draws from fewer things than this at once; beyond, hypergeometric does.
NUMPY_MOST = 1_000_000_000
#: A place holds its partition above these bits and the row's number there in them.
PLACE_BITS = 33


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without return are good. By inversion around the mode, for counts of any size."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    reach = int(12 * sd) + 60
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(mode, b, dtype=float)
    up = np.cumprod((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1)))
    k = np.arange(mode, a, -1, dtype=float)
    down = np.cumprod(k * (bad - n + k) / ((good - k + 1) * (n - k + 1)))
    mass = np.cumsum(np.concatenate([down[::-1], [1.0], up]))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows fall to each block, of which left[b] places are free."""
    total = int(left.sum())
    if total < NUMPY_MOST:
        return rng.multivariate_hypergeometric(left, n, method="marginals")
    out = np.zeros(len(left), np.int64)
    for b, free in enumerate(left.tolist()):
        total -= free
        out[b] = take = hypergeometric(rng, free, total, n)
        n -= take
    return out


def matrix_row(partition: int, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Of one partition's rows, how many go to each block. starts: rows before each partition, and all rows last; sizes: of the blocks."""
    a, b, free = 0, len(starts) - 1, sizes
    while b - a > 1:
        mid = (a + b) // 2
        first = draw(np.random.default_rng((seed, a, b)), free, int(starts[mid] - starts[a]))
        if partition < mid:
            b, free = mid, first
        else:
            a, free = mid, free - first
    return free


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """All rows of the matrix; row sums are counts, column sums are sizes."""
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return np.array([matrix_row(c, starts, np.array(sizes, np.int64), seed) for c in range(len(counts))])


def exact_sizes(n: int, parts: int) -> list[int]:
    return [n // parts + (i < n % parts) for i in range(parts)]


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc (the whole row, a struct), shard and slot for each row of docs. A block is one shuffle key, and its rows are in slot order."""
    rows = numbered(docs).withColumnRenamed("_row", "place")
    seen = {r.p: r.n for r in rows.groupBy(F.shiftright("place", PLACE_BITS).alias("p")).agg(F.count("*").alias("n")).collect()}  # a number for each written partition
    ids = np.array(sorted(seen), np.int64)
    starts = np.concatenate([[0], np.cumsum([seen[p] for p in ids.tolist()])]).astype(np.int64)
    n = int(starts[-1])
    blocks = max(1, -(-n // (shards * block_rows)))
    sizes = np.array([size for whole in exact_sizes(n, shards) for size in exact_sizes(whole, blocks)], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((ids, starts, sizes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, sizes = sent.value
        dealt: dict[int, np.ndarray] = {}
        for batch in batches:
            place = batch.column(0).to_numpy()
            part, at = place >> PLACE_BITS, place & ((1 << PLACE_BITS) - 1)
            block = np.zeros(len(place), np.int32)
            for p in np.unique(part).tolist():
                if p not in dealt:
                    c = int(np.searchsorted(ids, p))
                    # The partition's rows, permuted: the row at a place goes to this block.
                    goes = np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(c, starts, sizes, seed))
                    dealt = {p: np.random.default_rng((seed, c)).permutation(goes)}
                mine = part == p
                block[mine] = dealt[p][at[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "block"])

    kind = StructType([*rows.schema.fields, StructField("block", IntegerType())])
    within = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "place"), "place")
    before = np.concatenate([[0], np.cumsum(sizes)])
    offset = [int(before[b] - before[b - b % blocks]) for b in range(len(sizes))]
    placed = rows.mapInArrow(deal, kind).withColumn("slot", F.row_number().over(within) - 1)
    if blocks > 1:
        first = docs.sparkSession.createDataFrame(list(enumerate(offset)), "of int, first long")  # a number for each block
        placed = placed.join(F.broadcast(first), F.col("block") == F.col("of")).withColumn("slot", F.col("slot") + F.col("first"))
    return placed.select("doc", F.floor(F.col("block") / blocks).cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 42) -> None:
    """Writes the documents, whole, as a folder for each shard; slot gives the order in it."""
    shard_documents(docs, shards, seed).write.partitionBy("shard").parquet(path)


def uniform_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of each sharded row."""
    raw = F.coalesce(F.col("doc.text").cast("binary"), F.lit(b""))
    placed = shard_documents(docs, shards, seed)
    return placed.select(F.col("doc.doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
