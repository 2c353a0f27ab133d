"""Spelling variants: words of a corpus that differ by one code point, found by a frontier of states over a trie that is a table.

1. Words are counted (partial counts before the shuffle, so a word that is everywhere costs a row for each task).
2. The trie is a table of edges (side, parent, letter, child), where a node is a prefix. One edit leaves the first or the last half of a word as it is, so
   there are two sides, words and words turned round, and a word enters each at its half. Entering deep, no node near the root meets all words.
3. Where a word leaves its own path the edit is spent: another letter in place of its own or before it (a join with the edges of the node), or its own
   letter left out. A child is not entered if no word
   of the fitting length, or none with the word's next letter, lies below it.
4. States (word, position, node) whose edit is spent go on level by level: a join with the edges of the level by node and next letter. States at the end of
   their word whose node is a word are its neighbours.
5. A word's form is its most frequent neighbour, if that is FREQUENT times as frequent; roots follow forms by pointer doubling, as counts at least double.

Levels are as many as the longest word has letters, so words of LONG letters or more take another exact way: a hash for each letter left out, with its place. Words
that share it differ there alone, so it joins at most an alphabet of words, all of them neighbours; pairs are verified on the words. Pairs of a long word and one
just short of LONG go the same way.

Defined results: null and empty texts have no words; a null doc_id counts as the empty text where words are spoilt; repeated rows count each; words of any length
are whole; an empty table gives no rows; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import checkpoint_dir, column, released, small, written
from plinth.llm.decontam import powers

RUN = r"([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run is spoilt by the test's rule if this divides its checksum.
SPOIL = 97
#: Words: their least length and number; a form is so many times as frequent.
MIN_LENGTH, MIN_COUNT, FREQUENT = 5, 3, 2
#: Words from this length on don't enter the trie.
LONG = 40
#: Bases of the two hashes of a long word.
PRIMES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def runs(docs: DataFrame) -> DataFrame:
    """word: every run of letters, in lower case (A-Z alone). A run of which SPOIL divides the crc32 of `doc_id:run` loses a letter."""
    id_ = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    each = docs.select(id_.alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), 1)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return each.select(F.when(h % SPOIL == 0, less).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _letter(word: str, at: Column) -> Column:
    return F.substring(F.col(word), at + 1, F.lit(1))


def edges_of(sides: DataFrame) -> DataFrame:
    """side, depth (of the parent), parent, letter, child, the least and greatest length of the words below the child, and next, bits of the letters that go on from
    it. sides: side, word. A word is also met by words one letter shorter, which enter at their half."""
    d = F.explode(F.sequence(F.floor((F.length("word") - 1) / 2).cast("int"), F.length("word") - 1)).alias("depth")
    e = sides.select("side", "word", d).select("side", "depth", F.substring("word", F.lit(1), F.col("depth")).alias("parent"), _letter("word", F.col("depth")).alias("letter"), F.substring("word", F.lit(1), F.col("depth") + 1).alias("child"), F.length("word").alias("length"), _bit(_letter("word", F.col("depth") + 1)).alias("bit"))
    return e.groupBy("side", "depth", "parent", "letter", "child").agg(F.min("length").alias("least"), F.max("length").alias("most"), F.bit_or("bit").alias("next"))


def _bit(letter: Column) -> Column:
    """One of 64 bits for a letter, none for no letter. Letters may share one."""
    return F.when(letter == "", F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(letter) % 64))


def _goes_on(pos: Column) -> Column:
    """Whether the child of an edge is a word where the state's word ends, or can have its next letter below it."""
    return F.when(pos == F.length("word"), F.col("least") == F.length("child")).otherwise(F.col("next").bitwiseAND(_bit(_letter("word", pos))) != 0)


def _fits(reach: Column) -> Column:
    """Whether a word with `reach` letters in all can lie below the child."""
    return (F.col("least") <= reach) & (F.col("most") >= reach)


def spent(sides: DataFrame, edges: DataFrame) -> DataFrame:
    """side, word, pos, node, depth, reach (the length of the word to be found): the states right after the edit."""
    n = F.length("word")
    own = sides.select("side", "word", F.explode(F.sequence(F.floor(n / 2).cast("int"), n)).alias("pos")).select("side", "word", "pos", F.substring("word", F.lit(1), F.col("pos")).alias("node"))
    # A letter left out, unless it is the next one's double: that gives the same word.
    out = own.filter((F.col("pos") < n) & (_letter("word", F.col("pos")) != _letter("word", F.col("pos") + 1)))
    out = out.select("side", "word", (F.col("pos") + 1).alias("pos"), "node", F.col("pos").alias("depth"), (n - 1).alias("reach"))
    met = own.join(edges.withColumnRenamed("side", "e_side"), (F.col("side") == F.col("e_side")) & (F.col("node") == F.col("parent")) & (F.col("letter") != _letter("word", F.col("pos"))))
    kinds = F.array(F.struct(F.lit(1).alias("eats"), n.alias("reach")), F.struct(F.lit(0).alias("eats"), (n + 1).alias("reach")))
    met = met.withColumn("kind", F.explode(kinds)).filter(_fits(F.col("kind.reach")) & (F.col("pos") + F.col("kind.eats") <= n) & _goes_on(F.col("pos") + F.col("kind.eats")))
    return out.unionByName(met.select("side", "word", (F.col("pos") + F.col("kind.eats")).alias("pos"), F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("kind.reach").alias("reach")))


def _in_folders(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, written in folders by some columns, so that a level reads only its own."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.select(*[c for c in df.columns if c not in by], *by).schema).parquet(path)


def frontier(words: DataFrame) -> DataFrame:
    """word, other: pairs, both ways, of words (column word) below LONG letters that one edit turns into each other."""
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word"))))
    sides = written(words.filter(F.length("word") < LONG).select(both.alias("s")).select("s.*"), "sides")
    edges = _in_folders(edges_of(sides), "edges", "depth")
    start = _in_folders(spent(sides, edges).withColumn("done", F.col("pos") == F.length("word")), "spent", "done", "depth")
    depths = start.agg(F.min("depth"), F.max("reach")).first()
    ended = start.filter("done").select("side", "word", "node")
    carried = None
    for depth in range(depths[0] or 0, depths[1] or 0):
        states = start.filter(~F.col("done") & (F.col("depth") == depth)).select("side", "word", "pos", "node", "reach")
        states = states if carried is None else states.unionByName(carried)
        step = edges.filter(F.col("depth") == depth).select(F.col("side").alias("e_side"), "parent", "letter", "child", "least", "most", "next")
        went = states.join(step, (F.col("side") == F.col("e_side")) & (F.col("node") == F.col("parent")) & (_letter("word", F.col("pos")) == F.col("letter"))).filter(_fits(F.col("reach")) & _goes_on(F.col("pos") + 1))
        went = written(went.select("side", "word", (F.col("pos") + 1).alias("pos"), F.col("child").alias("node"), "reach"), f"level-{depth}")
        ended = ended.unionByName(went.filter(F.col("pos") == F.length("word")).select("side", "word", "node"))
        carried = went.filter(F.col("pos") < F.length("word"))
    turned = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    return ended.select(turned("word").alias("word"), turned("node").alias("other")).distinct()


def _left_out(long_: DataFrame) -> DataFrame:
    """num, at, n, a, b for each letter of each word (num, word): the length and two hashes of the word without the letter at that place; at -1: of the whole word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 16):
            for num, word in zip(column(batch, "num"), column(batch, "word"), strict=True):
                x = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
                n, keys = len(x), []
                for prime in PRIMES:
                    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(prime, n))])
                    moved = (before[n] - before[1:]) * np.uint64(pow(int(prime), -1, 1 << 64))  # letters after the gap come one place nearer
                    keys.append(np.concatenate([before[:-1] + moved, before[n:]]).view(np.int64))
                at = np.append(np.arange(n), -1)
                for i in range(0, n + 1, 50_000):
                    here = at[i : i + 50_000]
                    of = np.full(len(here), num)
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(here.astype(np.int32)), pa.array(np.where(here < 0, n, n - 1).astype(np.int32)), *[pa.array(k[i : i + 50_000]) for k in keys]], ["num", "at", "n", "a", "b"])

    return long_.mapInArrow(run, "num long, at int, n int, a long, b long")


def _without(word: str, at: str) -> Column:
    return F.concat(F.substring(F.col(word), F.lit(1), F.col(at)), F.substring(F.col(word), F.col(at) + 2, F.length(word)))


def long_pairs(words: DataFrame) -> DataFrame:
    """word, other: pairs, both ways, of words of at least LONG - 1 letters. Words that share what is left around one place differ there alone."""
    long_ = words.filter(F.length("word") >= LONG - 1)
    long_ = written(long_.select(F.monotonically_increasing_id().alias("num"), "word"), "long")
    keys = written(_left_out(long_), "left-out")
    gap, other = keys.filter("at >= 0"), keys.select(F.col("num").alias("o_num"), F.col("at").alias("o_at"), F.col("n").alias("o_n"), F.col("a").alias("o_a"), F.col("b").alias("o_b"))
    same = (F.col("a") == F.col("o_a")) & (F.col("b") == F.col("o_b")) & (F.col("n") == F.col("o_n"))
    swapped = gap.join(other, same & (F.col("at") == F.col("o_at")) & (F.col("num") != F.col("o_num")))
    longer = gap.join(other.filter("o_at < 0"), same)
    pairs = swapped.unionByName(longer).select("num", "at", "o_num", "o_at")
    names = long_.select(F.col("num").alias("o_num"), F.col("word").alias("other"))
    met = pairs.join(long_, "num").join(names, "o_num")
    met = met.filter(_without("word", "at") == F.when(F.col("o_at") < 0, F.col("other")).otherwise(_without("other", "o_at")))
    ways = F.explode(F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"))))
    return met.select(ways.alias("p")).select("p.*").distinct()


def neighbours(words: DataFrame) -> DataFrame:
    """word, other: all pairs, both ways, of words (column word, distinct) that differ by one letter put in, left out or replaced."""
    pairs = frontier(words)
    return pairs.unionByName(long_pairs(words)).distinct() if not words.filter(F.length("word") >= LONG).isEmpty() else pairs


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from each word of forms (word, form); forms must not lead round."""
    ends = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.join(ends.select(F.col("word").alias("of"), F.col("root").alias("next")), F.col("root") == F.col("of"), "left")
        ends = written(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if ends.filter("moved").isEmpty():
            return ends.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, frequent: int = FREQUENT) -> DataFrame:
    """word, n, form, form_n, root and n_near for each word of docs."""
    words = written(counted(runs(docs), min_length, min_count), "words")
    known = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = neighbours(words.select("word")).join(known, "other")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near.groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n_near"), best.alias("best"))
    counts = written(words.join(near, F.col("word") == F.col("of"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= frequent * F.col("n"), F.col("best")).alias("best")), "counts")
    forms = counts.filter("best is not null").select("word", F.col("best.form").alias("form"))
    ends = roots(forms).withColumnRenamed("word", "of")
    return counts.join(ends, F.col("word") == F.col("of"), "left").select("word", "n", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"), F.coalesce("root", "word").alias("root"), "n_near")
