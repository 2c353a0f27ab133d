"""Operator 7 at a similarity: documents whose word shingles have a Jaccard similarity of `share` or more are one group.

Pigeonhole buckets of the fingerprints and their Gray-order index come first, as in neardup. Fingerprints at that similarity differ in some 10 of 64 bits, where the
equal bit fields of neardup would be 4 bits long and tell nothing apart. So what its radius leaves apart is dealt to further buckets by minima of the shingles' hashes;
the Gray-order index searches these at a wide radius. Whatever is found is compared by whole shingle sets.

1. Documents with equal shingle sets are one class (its first row by doc_id speaks for it), so copies cost nothing further.
2. A class has BANDS keys, each of ROWS minima of hashed shingles. Two sets of similarity s share a key with probability
   1 - (1 - s ** ROWS) ** BANDS: at 0.8 all but one pair in 900,000, above it fewer are missed.
3. Classes whose fingerprints differ in neardup.RADIUS bits or less meet in a pigeonhole bucket, whose index gives a spanning forest of them; its pairs are compared.
4. The class that shares most keys with others is a key's hub. Every class still in another component is compared with the hubs of its keys: a group of n near
   copies costs some n comparisons.
5. Keys whose classes still lie in different components go through the Gray-order index, in tiles of TILE classes: it drops whole groups of
   fingerprints beyond the radius. Of the pairs it leaves, those go whose shared shingles can't suffice (a shingle that no other class of these
   keys has is never shared), and those whose SKETCH minima agree in fewer than least_agreement places, four standard deviations below what the
   similarity gives. That rules out the pairs inside a large group of much edited copies without comparing their texts. The others are compared.
6. A pair is linked only if the Jaccard similarity of its whole shingle sets is at least `share`, in whole numbers.

Defined results: words are split at blanks, ASCII capitals lowered; fewer words than a shingle make one shingle of all words; null, empty and
wordless texts are copies of each other; of a component the smallest doc_id stays, then the first row; null ids come last; an empty table gives no
rows; texts of any length count whole; all columns pass through, whatever their names. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import neardup
from plinth.llm.common import column, cut, numbered, picked, plain, small, written

#: A pair is similar from SHARE hundredths on.
SHINGLE, SHARE, SEED = 5, 80, 42
BANDS, ROWS = 26, 4
#: Differing bits up to which the index finds a pair: five standard deviations above the mean at similarity 0.8.
RADIUS = 24
#: Minima, a byte each, of the classes that the index compares.
SKETCH = 512
#: Classes of a tile of a key.
TILE = 1024
#: Shingles that are multiplied by all the factors at once.
STEP = 2048

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 64, SKETCH, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted, distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return np.array([h(join(words), SEED)] if words else [], np.uint64)
    return np.unique(np.array([h(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))], np.uint64))


def minima(s: np.ndarray, count: int) -> np.ndarray:
    """For each of count multipliers the smallest product with a hash."""
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), STEP):
        np.minimum(low, (_FACTORS[:count, None] * s[None, a : a + STEP]).min(1), out=low)
    return low


def band_keys(s: np.ndarray) -> list[int]:
    if not len(s):
        return []
    return [xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(minima(s, BANDS * ROWS).reshape(BANDS, ROWS))]


def least_agreement(share: int) -> int:
    p = share / 100
    return int(SKETCH * p - 4 * (SKETCH * p * (1 - p)) ** 0.5)


def set_fingerprint(s: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed long."""
    sums = np.zeros(64, np.int64)
    for a in range(0, len(s), neardup.STEP):
        sums += np.unpackbits(s[a : a + neardup.STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(s), bitorder="little").view(np.int64)[0])


def similar(x: np.ndarray, y: np.ndarray, share: int = SHARE) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= share * (len(x) + len(y) - both)


def _signed(rows: DataFrame, shingle: int) -> DataFrame:
    """_row, doc_id, a and b (which name the shingle set), n (its size), fp and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for t in column(batch, "text"):
                s = shingles(t, shingle)
                out.append((xxhash.xxh64_intdigest(s.tobytes(), 0) - (1 << 63), xxhash.xxh64_intdigest(s.tobytes(), 1) - (1 << 63), len(s), set_fingerprint(s), band_keys(s)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], ["_row", "doc_id", "a", "b", "n", "fp", "keys"])

    return plain(rows).mapInArrow(run, "_row long, doc_id long, a long, b long, n long, fp long, keys array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, shingle: int, share: int) -> DataFrame:
    """src, dst of those pairs (src, dst: rows of texts) whose shingle sets are similar. Both are plain tables, so Spark can split a hub's part."""
    both = pairs.join(texts.select(F.col("_row").alias("src"), F.col("text").alias("x")), "src").join(texts.select(F.col("_row").alias("dst"), F.col("text").alias("y")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            keep = [similar(shingles(x, shingle), shingles(y, shingle), share) for x, y in zip(column(b, "x"), column(b, "y"))]
            yield b.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return cut(both.select("src", "dst", "x", "y").mapInArrow(run, "src long, dst long"))


def _in_reach(share: int):
    """Sets whose sizes differ by more can't be similar."""
    return 100 * F.least("n", "m") >= share * F.greatest("n", "m")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "to").alias("src"), F.greatest("node", "to").alias("dst")).distinct()


def _with_root(rows: DataFrame, node: str, roots: DataFrame, root: str) -> DataFrame:
    joined = rows.join(roots.select(F.col("node").alias("of"), F.col("root").alias("found")), F.col(node) == F.col("of"), "left")
    return joined.select(*rows.columns, F.coalesce("found", node).alias(root))


def alone(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, own: how many of its shingles no other of these nodes has (nodes without such are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            sets = [shingles(t, shingle) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(column(b, "_row"), np.int64), [len(s) for s in sets])), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["node", "h"])

    each = picked(texts, nodes).mapInArrow(run, "node long, h long")
    return each.groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))


def sketches(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, low: the last byte of each of SKETCH minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([minima(shingles(t, shingle), SKETCH).astype(np.uint8).tobytes() for t in column(b, "text")], pa.binary())], ["node", "low"])

    return picked(texts, nodes).select("_row", "text").mapInArrow(run, "node long, low binary")


def index_pairs(buckets: DataFrame, share: int = SHARE, radius: int = RADIUS) -> DataFrame:
    """src, dst: pairs of a bucket that the Gray-order index finds, of different roots, whose sizes n, shareable shingles s and minima allow the
    similarity. buckets: bucket, fp, node, root, n, s, low, each bucket in one partition, sorted by bucket."""
    agree = least_agreement(share)

    def solve(t: np.ndarray, low: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((neardup.gray_rank(t[1].view(np.uint64)), t[0]))
        (bucket, fp, node, root, n, s), low = np.ascontiguousarray(t[:, order]), low[order]
        for i, j in neardup.links(fp.view(np.uint64), bucket, radius):
            both = np.minimum(s[i], s[j])
            keep = (root[i] != root[j]) & (100 * both >= share * (n[i] + n[j] - both))
            i, j = i[keep], j[keep]
            for a in range(0, len(i), 100_000):
                x, y = i[a : a + 100_000], j[a : a + 100_000]
                keep = (low[x] == low[y]).sum(1) >= agree
                x, y = node[x[keep]], node[y[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, low = np.zeros((6, 0), np.int64), np.zeros((0, SKETCH), np.uint8)
        for b in batches:
            if not b.num_rows:
                continue
            got = np.concatenate([got, np.array([c.to_numpy(zero_copy_only=False) for c in b.columns[:6]], np.int64)], 1)
            low = np.concatenate([low, np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(-1, SKETCH)])
            # The last bucket may go on in the next batch.
            if got.shape[1] > 50_000 and (end := int(np.flatnonzero(got[0] != got[0, -1])[-1]) + 1 if (got[0] != got[0, -1]).any() else 0):
                yield from solve(np.ascontiguousarray(got[:, :end]), low[:end])
                got, low = got[:, end:], low[end:]
        if got.shape[1]:
            yield from solve(np.ascontiguousarray(got), low)

    return buckets.select("bucket", "fp", "node", "root", "n", "s", "low").mapInArrow(run, "src long, dst long")


def fingerprint_pairs(classes: DataFrame, share: int = SHARE) -> DataFrame:
    """src, dst: pairs of classes (node, n, fp) of near fingerprints whose sizes allow the similarity: a spanning forest of each pigeonhole bucket's links, and each
    class with the first one of its own fingerprint."""
    fps = cut(classes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("c")))
    near = cut(neardup.bucket_links(neardup._dealt(neardup.into_buckets(fps.select("fp")))).distinct())
    of = lambda fp, node, n: fps.select(F.col("fp").alias(fp), F.col("c.node").alias(node), F.col("c.n").alias(n))
    far = near.join(of("src", "node", "n"), "src").join(of("dst", "to", "m"), "dst").select("node", "n", "to", "m")
    same = classes.select("node", "n", "fp").join(of("fp", "to", "m"), "fp").filter("node <> to").select("node", "n", "to", "m")
    return _ordered(far.unionByName(same).filter(_in_reach(share)))


def links(rows: DataFrame, classes: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """node, root for each class (node: the row that stands for it, n, fp, keys) that is linked to another. rows: numbered."""
    keys = classes.select("node", "n", "fp", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"))
    keys = cut(keys.join(shared, "key"))  # keys of one class alone are gone
    first = cut(fingerprint_pairs(classes, share))
    # Only these classes are ever compared: their texts are written once, in a table of their own.
    compared = keys.select("node").unionByName(first.select(F.col("src").alias("node"))).unionByName(first.select(F.col("dst").alias("node")))
    texts = written(picked(plain(rows).select("_row", "text"), compared.distinct()), "texts")
    near = _linked(first, texts, shingle, share)
    roots = cut(neardup.components(near))
    degree = cut(keys.groupBy("node").agg(F.sum("size").alias("degree")))
    hubs = cut(keys.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node", "n")).alias("hub")))
    star = keys.select("key", "node", "n").join(hubs, "key").select("node", "n", F.col("hub.node").alias("to"), F.col("hub.n").alias("m"))
    star = _with_root(_with_root(star.filter("node <> to").filter(_in_reach(share)), "node", roots, "a"), "to", roots, "b").filter("a <> b")
    star = cut(_ordered(star))
    edges = near.unionByName(_linked(star, texts, shingle, share))
    roots = neardup.components(edges)
    placed = cut(_with_root(keys.filter("size > 2"), "node", roots, "root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("key")
    placed = cut(placed.join(cut(mixed), "key", "left_semi"))
    own = alone(texts, placed.select("node").distinct(), shingle).withColumnRenamed("node", "of")
    placed = cut(placed.join(cut(own), F.col("node") == F.col("of"), "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0))).filter(100 * F.col("s") >= share * F.col("n")))
    tiles = F.ceil(F.col("size") / TILE).cast("long")
    tiled = placed.withColumn("tile", F.pmod(F.xxhash64("node"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    tiled = tiled.withColumn("bucket", F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other")))
    tiled = tiled.join(cut(sketches(texts, placed.select("node").distinct(), shingle)).withColumnRenamed("node", "with"), F.col("node") == F.col("with"))
    found = index_pairs(tiled.repartition("bucket").sortWithinPartitions("bucket"), share).distinct()
    more = _linked(cut(found.join(star, ["src", "dst"], "left_anti")), texts, shingle, share)
    return neardup.components(edges.unionByName(more)) if not more.isEmpty() else roots


def keep_one(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """docs, all columns, with one row of each component of near copies: that of the smallest doc_id stays."""
    rows = numbered(docs)
    signed = cut(_signed(rows, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")
    classes = cut(signed.groupBy("a", "b").agg(first, F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")).select(F.col("first._row").alias("node"), "first", "n", "fp", "keys"))
    named = _with_root(classes.select("node", "first"), "node", links(rows, classes, shingle, share), "root")
    stay = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_stay"))
    gone = signed.select("_row").join(stay, F.col("_row") == F.col("_stay"), "left_anti")
    return picked(rows, gone, "left_anti").select("doc.*")
