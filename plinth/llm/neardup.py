"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in few bits are found without comparing all pairs:

1. Equal fingerprints are one class (its smallest doc_id speaks for it), so copies cost nothing further.
2. With at most `radius` differing bits, one of radius + 1 bit fields is equal. Each class goes to a bucket for each field; a
   bucket with more than BUCKET classes is split by the fields of the remaining bits, and what is still larger by pairs
   of tiles. Thus no task gets more than two tiles, whatever a group's size.
3. A bucket's fingerprints are sorted by Gray rank, so neighbours share bits. Runs of FAN_OUT make a node that stores the
   bits its members share (a pattern and a mask), and so on upwards. A search goes down from the roots for all fingerprints at once, adds
   up the differences in the bits that a node fixes beyond its parent's, and drops a whole group once they pass the radius.
4. A bucket reports a spanning forest of its links, not all pairs, so a group of n near copies costs n rows.
5. Components come from the links by alternating large-star and small-star steps, with a checkpoint each.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like any other; fewer words than a
shingle make one shingle of all words; repeated rows get a row each; a row with a null doc_id gets its fingerprint's component and never names one, unless no
row of the component has an id (then null). Whole texts count, repeats included; an empty table gives no rows. Other columns are never read,
whatever their names. keep_one (in setdup) uses the same buckets and index, and the index at a wide radius beyond them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, cut, small

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
#: Classes of a bucket before it is split, and the members of an index node.
BUCKET, FAN_OUT = 1024, 16
#: Pairs of a fingerprint and a node that a search holds at once.
FRONTIER = 2_000_000
#: Shingles that are hashed before their bits are added up.
STEP = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes. Words are split at blanks, ASCII capitals lowered."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    sums = np.zeros(BITS, np.int64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    for a in range(0, n, STEP):
        part = words[a : min(n, a + STEP) + shingle - 1]
        if len(part) <= shingle:
            hashes = [h(join(part), seed)]
        else:
            hashes = [h(join(x), seed) for x in zip(*(part[i:] for i in range(shingle)))]
        sums += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * sums > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fp = np.array([fingerprint(t, shingle) for t in column(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def _levels(codes: np.ndarray, bucket: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the leaves' parents upwards: first child, end child, pattern and mask of each node. Nodes stay inside a bucket."""
    ones, zeros, owner, out = codes, ~codes, bucket, []
    while True:
        n = len(owner)
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(owner[1:], owner[:-1], out=new[1:])
        first_of = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(first_of, np.diff(np.append(first_of, n)))
        starts = np.flatnonzero(place % FAN_OUT == 0)
        ones, zeros, owner = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts), owner[starts]
        out.append((starts, np.append(starts[1:], n), ones, ones | zeros))
        if len(starts) == len(first_of):
            return out


def links(codes: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one bucket that differ in at most radius bits. Rows must be sorted by bucket, then Gray rank."""
    levels = _levels(codes, bucket)
    top = levels[-1]
    root = np.repeat(np.arange(len(top[0])), _spans(levels))
    n, step = len(codes), max(1, FRONTIER // (FAN_OUT * 8))
    # Blocks of queries keep the frontier small; a block that grows beyond it is halved.
    todo = [(a, min(n, a + step)) for a in range(0, n, step)][::-1]
    while todo:
        a, b = todo.pop()
        q, node = np.arange(a, b), root[a:b]
        fixed = top[3][node]
        acc = np.bitwise_count((codes[q] ^ top[2][node]) & fixed).astype(np.int16)
        keep = acc <= radius
        q, node, acc = q[keep], node[keep], acc[keep]
        split = False
        for depth in range(len(levels) - 1, -1, -1):
            starts, ends, _, mask = levels[depth]
            size = (ends - starts)[node]
            total = int(size.sum())
            if total > FRONTIER and b - a > 1:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
                split = True
                break
            child = np.repeat(starts[node] - np.cumsum(size) + size, size) + np.arange(total)
            parent = np.repeat(node, size)
            q, acc = np.repeat(q, size), np.repeat(acc, size)
            if depth:
                _, _, pattern, own = levels[depth - 1]
                # Only bits that the child fixes and its parent didn't are new.
                acc = acc + np.bitwise_count((codes[q] ^ pattern[child]) & (own[child] & ~mask[parent]))
                keep = acc <= radius
            else:
                keep = (child > q) & (acc + np.bitwise_count((codes[q] ^ codes[child]) & ~mask[parent]) <= radius)
            q, node, acc = q[keep], child[keep], acc[keep]
        if not split and len(q):
            yield q, node


def _spans(levels) -> np.ndarray:
    """How many leaves lie below each top node."""
    count = levels[0][1] - levels[0][0]
    for starts, _, _, _ in levels[1:]:
        count = np.add.reduceat(count, starts)
    return count


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the first row of its component."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(label, up := label[label]):
                label = up
    return label


def bucket_links(buckets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """src, dst: a spanning forest of the links in each bucket. buckets (bucket long, fp) must hold each bucket in one partition,
    sorted by bucket."""

    def solve(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        codes = fps.view(np.uint64)
        order = np.lexsort((gray_rank(codes), keys))
        codes, keys = codes[order], keys[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (keys[1:] != keys[:-1])
        codes, keys = codes[new], keys[new]
        label = forest(len(codes), links(codes, keys, radius))
        far = np.flatnonzero(label != np.arange(len(codes)))
        return pa.RecordBatch.from_arrays([pa.array(codes[far].view(np.int64)), pa.array(codes[label[far]].view(np.int64))], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            keys, fps = np.concatenate([keys, b.column(0).to_numpy(zero_copy_only=False)]), np.concatenate([fps, b.column(1).to_numpy(zero_copy_only=False)])
            # The last bucket may go on in the next batch.
            if len(keys) > 100_000 and (end := int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0):
                yield solve(keys[:end], fps[:end])
                keys, fps = keys[end:], fps[end:]
        if len(keys):
            yield solve(keys, fps)

    return buckets.select("bucket", "fp").mapInArrow(run, "src long, dst long")


def _fields(bits: list[int], n: int) -> list[list[int]]:
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def _pick(bits: list[int]) -> int:
    """The signed long with these bits set."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def into_buckets(classes: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """bucket (a hash of the shared fields), fp: any two classes within the radius meet in some bucket."""
    first = _fields(list(range(BITS)), radius + 1)
    masks = [F.lit(_pick(x)) for x in first]
    one = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(m) for m in masks])).alias("field", "shared")).withColumn("bucket", F.xxhash64("field", "shared"))
    one, small, large = _split(one, ["field"], most)
    # Second fields: of the bits outside the first field, so that equal first fields are used up.
    subs = F.array(*[F.array(*[F.lit(_pick(y)) for y in _fields([b for b in range(BITS) if b not in set(x)], radius + 1)]) for x in first])
    two = large.select("fp", "bucket", F.posexplode(F.element_at(subs, F.col("field") + 1)).alias("sub", "mask"))
    two = two.select("fp", F.xxhash64("bucket", "sub", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket"))
    two, small_two, large_two = _split(two, [], most)
    # Tiles: every pair of a bucket's tiles makes a bucket, so that any two members still meet.
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles"))
    pairs = large_two.withColumn("tile", tile).select("fp", "bucket", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    tiled = pairs.select(F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other")).alias("bucket"), "fp")
    return small.select("bucket", "fp").unionByName(small_two.select("bucket", "fp")).unionByName(tiled)


def _split(rows: DataFrame, keep: list[str], most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows, those of buckets with at most `most` members, and the others with the number of tiles they need."""
    full = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.col("bucket").alias("full"), F.ceil(F.col("n") / most).cast("long").alias("tiles"))
    full = cut(full)  # few rows: the buckets that are too large
    marked = rows.join(full, F.col("bucket") == F.col("full"), "left")
    return rows, marked.filter("full is null"), marked.filter("full is not null").select("fp", "bucket", "tiles", *keep)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) for each node with an edge. edges: src, dst of any type with an order.

    Alternates large-star (a node's larger neighbours move to its smallest neighbour) and small-star (its smaller ones do)
    until a pass changes nothing; passes grow with the logarithm of the longest chain. Each node's smallest neighbour is written before it is
    joined: a join of two plain tables is one that Spark can split when a hub holds most edges."""
    pairs = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    last = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
        large = both.filter("v > u").join(lowest, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(lowest, F.col("u") == F.col("k"))  # after large-star the hubs are on the other side
        stars = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        pairs = cut(stars)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) for each row of docs.

    A class is named by its smallest id (one without ids by its fingerprint, after all others), so a component's smallest node is
    its component_id, and no join on the component is needed."""
    rows = cut(fingerprints(docs, shingle))
    name = F.struct(F.min("doc_id").isNull().alias("none"), F.coalesce(F.min("doc_id"), F.col("fp")).alias("id"))
    classes = cut(rows.groupBy("fp").agg(name.alias("name")))
    edges = cut(bucket_links(_dealt(into_buckets(classes.select("fp"), radius)), radius).distinct())
    of = lambda x: classes.select(F.col("fp").alias(f"{x}_fp"), F.col("name").alias(f"{x}_name"))
    named = edges.join(of("src"), F.col("src") == F.col("src_fp")).join(of("dst"), F.col("dst") == F.col("dst_fp")).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
    found = classes.join(components(named), F.col("name") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("root", "name").alias("root"))
    out = rows.join(cut(found), F.col("fp") == F.col("of"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(~F.col("root.none"), F.col("root.id")).alias("component_id"))


def _dealt(buckets: DataFrame) -> DataFrame:
    """Buckets as bucket_links needs them."""
    return buckets.repartition(F.col("bucket")).sortWithinPartitions("bucket")
