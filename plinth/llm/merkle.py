"""Merkle manifest of a dataset: a digest for each row, trees of digests, and for each row the proof that leads to the root.

Each value of a column (lang) has a tree of its rows, in the order of doc_id; the trees' roots are the leaves of a last tree, in the order of that column.
Two neighbours make a parent, an odd last node alone makes one too. Each tree is built and read in the same way:

1. Places. Leaves are dealt into ranges of their order and counted by range and tree, so no task sees a whole tree.
2. Nodes. BLOCK levels at a time: 2**BLOCK neighbours meet in one row, and every node gets the segment that leads to its parent: its sibling and the side
   on which that stands.
3. Pointer jumping. A node's segment leads as far as an ancestor. A self-join appends the ancestor's own segment, which doubles the distance; nodes whose
   level is no multiple of the new distance are no one's ancestor any more and go. After log2(height) joins only leaves are left, with their whole proofs.

Digests travel as 32 bytes; no text does after the first step. A join's ancestor has at most 2**distance descendants and there are as many fewer ancestors,
so ancestors are many and their groups small, or few enough for Spark to broadcast them.

Defined results: a null value is the digest of `-`, hence unlike an empty text; a null lang is a tree of its own, before all others; a null doc_id comes after
all others, and changed() leaves its row alone; rows with equal ids stand in the order of their leaves, equal rows get a leaf each; an empty table gives no rows;
texts of any length count whole; only the five columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Levels that are made from one shuffle.
BLOCK = 6
#: Rows of a range of places.
RANGE = 200_000
#: A segment's entries: a byte for the sibling's side, then its digest (zeros, if there is none).
ALONE, LEFT, RIGHT, ENTRY = 0, 1, 2, 33


def digest(*values: Column) -> Column:
    """SHA-256 of the values one after another, as lowercase hex."""
    return F.sha2(F.concat(*values), 256)


def value_text(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows have the same text; null: `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(of: dict[str, Column] | None = None) -> Column:
    """The digest of a row; of: what stands in place of some columns."""
    return digest(*[value_text((of or {}).get(c, F.col(c))) for c in FIELDS])


def changed() -> dict[str, Column]:
    """The tampering that the report looks for: one more in n_chars, in the rows whose doc_id has a crc32 that 7 divides."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return {"n_chars": F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(21,0)"))}


def placed(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """leaves (with a column tree) with pos, the place in the tree (from 0), and size, the leaves of the tree. order: tells all rows of a tree apart."""
    ranges = max(1, -(-leaves.count() // RANGE))
    keys = [F.col("tree"), *order]
    ranged = written(leaves.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    parts = written(ranged.groupBy(part.alias("part"), F.col("tree").alias("of_tree")).agg(F.min("at").alias("first"), F.count("*").alias("n")), "parts")
    # A tree has as many rows here as it has ranges.
    tree = Window.partitionBy("of_tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("part", "of_tree", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return ranged.join(starts, (part == F.col("part")) & (F.col("tree") == F.col("of_tree"))).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "of_tree", "shift")


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def _shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by)


def _entry(side: int, sibling: Column | None = None) -> Column:
    return F.concat(F.lit(bytes([side])), sibling if sibling is not None else F.lit(bytes(ENTRY - 1)))


def _parents(xs: Column) -> Column:
    def one(i: Column) -> Column:
        return F.unhex(digest(_hex(F.get(xs, 2 * i)), F.coalesce(_hex(F.get(xs, 2 * i + 1)), F.lit(""))))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) + 1) / 2).cast("int") - 1), one)


def _nodes(level: int) -> Callable[[Column, Column], Column]:
    """The nodes of the i-th array of a block. Only leaves have a cargo; the last array's nodes find their siblings in the next block."""

    def of_array(xs: Column, i: Column) -> Column:
        root = F.col("size") <= _shifted(F.lit(1).cast("long"), i + level)

        def node(x: Column, k: Column) -> Column:
            sibling = F.when(k % 2 == 1, _entry(LEFT, F.get(xs, k - 1))).when(k + 1 < F.size(xs), _entry(RIGHT, F.get(xs, k + 1))).otherwise(_entry(ALONE))
            segment = F.when(root, F.lit(b"")).when(i < BLOCK, sibling)
            of = F.when(i + level == 0, F.get("xs", k).of)
            return F.struct((i + level).alias("level"), (_shifted(F.col("block"), F.lit(BLOCK) - i) + k).alias("pos"), of.alias("of"), x.alias("digest"), segment.alias("segment"))

        return F.transform(xs, node)

    return of_array


def nodes(leaves: DataFrame) -> DataFrame:
    """tree, size, level, pos, of, digest, segment (towards the parent; of the root: empty) of every node. leaves: tree, pos, size, digest (bytes), of (what a leaf carries)."""
    rows, level, made = leaves.select("tree", "size", "pos", "digest", "of"), 0, None
    while True:
        block = rows.groupBy("tree", "size", F.shiftright("pos", BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "of"))).alias("xs"))
        # A level stands where the one below has more than one node in its tree.
        up = lambda xs, i: F.when(F.col("size") > _shifted(F.lit(1).cast("long"), i + level), F.concat(xs, F.array(_parents(F.element_at(xs, -1))))).otherwise(xs)  # noqa: B023, E731
        block = block.withColumn("levels", F.aggregate(F.sequence(F.lit(0), F.lit(BLOCK - 1)), F.array(F.transform("xs", lambda x: x.digest)), up))
        made_here = F.flatten(F.transform("levels", _nodes(level)))
        block = written(block.select("tree", "size", F.explode(made_here).alias("node")).select("tree", "size", "node.*"), f"nodes-{level}")
        here = block.filter("segment is not null")
        made = here if made is None else made.unionByName(here)
        level += BLOCK
        rows = block.filter("segment is null")
        if rows.isEmpty():
            return made


def proofs(leaves: DataFrame) -> DataFrame:
    """tree, of, digest (of the leaf), segment (all the way to the root) and root (of its tree) for each leaf."""
    every = nodes(leaves)
    roots = written(every.filter("length(segment) = 0").select(F.col("tree").alias("of_tree"), F.col("digest").alias("root")), "roots")
    height, step = every.agg(F.max("level")).first()[0] or 0, 1
    held = every.select("tree", "level", "pos", "of", "digest", "segment")
    while step < height:
        ancestors = held.filter(F.col("level") % (2 * step) == step).select(F.col("tree").alias("a_tree"), F.col("level").alias("a_level"), F.col("pos").alias("a_pos"), F.col("segment").alias("a_segment"))
        mine = held.filter(F.col("level") % (2 * step) == 0)
        met = (F.col("tree") == F.col("a_tree")) & (F.col("level") + step == F.col("a_level")) & (F.shiftright("pos", step) == F.col("a_pos"))
        held = written(mine.join(ancestors, met, "left").select("tree", "level", "pos", "of", "digest", F.concat("segment", F.coalesce("a_segment", F.lit(b""))).alias("segment")), f"jumped-{step}")
        step *= 2
    return held.filter("level = 0").join(roots, F.col("tree") == F.col("of_tree")).select("tree", "of", "digest", "segment", "root")


def entries(segment: Column) -> Column:
    n = (F.length(segment) / ENTRY).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(segment, i * ENTRY + 1, F.lit(ENTRY)))).otherwise(F.array().cast("array<binary>"))


def siblings(proof: Column) -> Column:
    """Hex digests of the siblings of a proof, from the leaf's up."""
    return F.transform(F.filter(proof, lambda e: F.substring(e, 1, 1) != F.lit(bytes([ALONE]))), lambda e: _hex(F.substring(e, 2, ENTRY)))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and a proof lead to."""

    def up(acc: Column, e: Column) -> Column:
        side, sibling = F.substring(e, 1, 1), _hex(F.substring(e, 2, ENTRY))
        return digest(F.when(side == F.lit(bytes([LEFT])), sibling).otherwise(""), acc, F.when(side == F.lit(bytes([RIGHT])), sibling).otherwise(""))

    return F.aggregate(proof, start, up)


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof (entries of side and sibling, from the leaf to the root) and told, the leaf of the row with tampered in place of
    its own columns, for each row of docs. Digests in hex."""
    named = docs.select(*[F.col(c) for c in FIELDS])
    tree = F.coalesce(F.concat(F.lit(":"), F.col("lang").cast("string")), F.lit(""))  # null before all, then by bytes
    of = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf(tampered)).alias("told"), F.monotonically_increasing_id().alias("row"))
    leaves = written(named.select(tree.alias("tree"), F.unhex(leaf()).alias("digest"), of.alias("of")), "leaves")
    low = written(proofs(placed(leaves, [F.col("of.doc_id").isNull(), F.col("of.doc_id"), F.col("digest"), F.col("of.row")])), "proofs")
    tops = written(low.groupBy("tree").agg(F.any_value("root").alias("digest")).select(F.lit("").alias("tree"), "digest", F.struct("tree").alias("of")), "subroots")
    high = written(proofs(placed(tops, [F.col("of.tree")])).select(F.col("of.tree").alias("of_tree"), F.col("digest").alias("subroot"), F.col("segment").alias("on"), F.col("root").alias("top")), "top")
    both = low.join(high, F.col("tree") == F.col("of_tree"))
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return both.select(F.col("of.doc_id").alias("doc_id"), lang.alias("lang"), _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), _hex(F.col("top")).alias("root"), entries(F.concat("segment", "on")).alias("proof"), _hex(F.col("of.told")).alias("told"))


def report(docs: DataFrame, tampered: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from told and the proof) and verified for each row of docs."""
    m = manifest(docs, tampered)
    out = m.select("doc_id", "leaf", "subroot", "root", digest(F.array_join(siblings(F.col("proof")), "")).alias("proof_sha256"), folded(F.col("told"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
