"""Substring dedup on a De Bruijn graph of words: passages that stand earlier in the corpus are found as paths, verified at their source and removed.

An edge of the graph is a window of WINDOW words, its nodes are its first and last WINDOW - 1 words.

1. Equal texts are one: all but the first lose every window. The other texts are cut into pieces, maximal runs of windows that share the same smallest hash of
   GRAM words (their anchor). Equal windows have equal anchors, so only pieces with an anchor that occurs again can hold repeated windows; a piece is an
   eighth as many rows as its windows, and equal pieces are one class at its first place, with its number.
2. Only classes are opened into edges. An edge has its first place, and is repeated if it occurs twice.
3. Compaction. Nodes with one repeated edge in and one out join the two. Edges joined so that also follow each other at their first places are a
   segment with one source; segments joined so across documents are one path, whose head pointer doubling by self-joins finds. (A path ends where it would
   go back to an earlier source, so there are no rings.)
4. Spans. Each piece takes the segments of its class; windows that are not their own source are merged into spans of a document and its source.
5. A span is verified by SHA-256 of its words against those at the source's coordinates. Words of verified spans go.

Hot passages: pieces are counted by anchor and class before they meet, joins are between plain tables, so that Spark splits hot keys, and classes stand for
their copies. What is gathered in one place belongs to one document, or to 8192 word places of a source.

Defined results: null texts have no words and stay null; texts of fewer words than a window keep all; the earlier one has the smaller doc_id (null counts as
the greatest), of equal ids the row that comes first; windows are judged on the input, and may overlap in one document; an empty table gives no rows; texts of any length
are whole; other columns pass through without_repeats untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import column, cut, forget, numbered, picked, plain, small, written
from plinth.llm.decontam import gram_hashes, range_hashes

WINDOW = 20
#: Words whose hashes compete for a window's anchor.
GRAM = 6
_BASE = np.uint64(0xC6A4A7935BD1E995)
LAST = (1 << 63) - 1
PIECE = "g long, a long, n int, id long, row long, pos int"
EDGE = "g long, h long, s long, t long, many long, id long, row long, pos int, base int"


def words_of(text: bytes | None) -> list[bytes]:
    """What blanks, tabs and line ends separate."""
    return (text or b"").split()


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def anchored(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and number of windows of each piece, and its anchor's hash."""
    if len(hashes) < window:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    grams = gram_hashes(hashes, gram)
    wide = window - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, wide).argmin(1) + np.arange(len(grams) - wide + 1)
    start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return start, np.diff(np.append(start, len(at))), grams[at[start]]


def _lists(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, pa.StructArray]:
    """Where each row's list begins and ends in the structs of all rows."""
    ends, flat = batch.column(i).offsets.to_numpy(), batch.column(i).flatten()
    return ends - ends[0], flat


def _place(id_: str = "id"):
    return F.struct(F.col(id_).alias("id"), "row", "pos")


def pieces(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """g (anchor), a (hash of all words), n (windows), id, row, pos (first word) of each piece. texts: id, row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            got: list[list] = [[] for _ in range(6)]
            for id_, row, text in zip(column(b, "id"), column(b, "row"), column(b, "text"), strict=True):
                h = _hashed(words_of(text))
                start, n, g = anchored(h, window, gram)
                for to, x in zip(got, (g.view(np.int64), range_hashes(h, start, start + n + window - 1, _BASE).view(np.int64), n, np.full(len(n), id_), np.full(len(n), row), start), strict=True):
                    to.append(x)
            arrays = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in got]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if i in (2, 5) else x.astype(np.int64)) for i, x in enumerate(arrays)], ["g", "a", "n", "id", "row", "pos"])

    return texts.select("id", "row", "text").mapInArrow(run, PIECE)


def opened(texts: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """The windows of each class: g and h (anchor and hash), s and t (nodes), many (the class's number), where it stands, base (the piece's first word)."""
    places = classes.groupBy(F.col("first.row").alias("of")).agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "n", "g", "many")).alias("places"))
    at = texts.join(places, F.col("row") == F.col("of")).select("id", "row", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            ends, flat = _lists(b, 3)
            pos, n, g, many = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            got = []
            for i, (id_, row, text) in enumerate(zip(column(b, "id"), column(b, "row"), column(b, "text"), strict=True)):
                k = slice(ends[i], ends[i + 1])
                words, at_, long_ = words_of(text), pos[k], n[k]
                # Only the words of the classes are hashed; the others count as zero, and no window covers them.
                inside = np.zeros(len(words) + 1, np.int32)
                np.add.at(inside, at_, 1)
                np.add.at(inside, at_ + long_ + window - 1, -1)
                inside = np.flatnonzero(np.cumsum(inside[:-1]))
                h = np.zeros(len(words), np.uint64)
                h[inside] = _hashed([words[j] for j in inside.tolist()])
                base, size = np.repeat(at_, long_), int(long_.sum())
                p = base + np.arange(size) - np.repeat(np.cumsum(long_) - long_, long_)
                edges, left, right = (range_hashes(h, p + x, p + y, _BASE) for x, y in ((0, window), (0, window - 1), (1, window)))
                got.append((np.repeat(g[k], long_), edges.view(np.int64), left.view(np.int64), right.view(np.int64), np.repeat(many[k], long_), np.full(size, id_), np.full(size, row), p, base))
            cols = [np.concatenate(c) for c in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if i > 6 else c) for i, c in enumerate(cols)], ["g", "h", "s", "t", "many", "id", "row", "pos", "base"])

    return at.mapInArrow(run, EDGE)


def compacted(edges: DataFrame) -> DataFrame:
    """edges (g, h, s, t, first) with segment (the first word of its segment at the source) and path (row and pos of the head of its path)."""
    into = edges.groupBy("t").agg(F.count("*").alias("n_in"), F.any_value("first").alias("before")).filter("n_in = 1")
    out = edges.groupBy("s").agg(F.count("*").alias("n_out"), F.any_value("first").alias("after")).filter("n_out = 1")
    joints = written(into.join(out, F.col("t") == F.col("s")).filter("before < after").select("before", "after"), "joints")
    here = (F.col("before.row") == F.col("after.row")) & (F.col("before.pos") + 1 == F.col("after.pos"))
    inner = joints.filter(here).select(F.col("after").alias("inner"))
    marked = edges.join(inner, F.col("first") == F.col("inner"), "left")
    # Edges of a document in a row: a segment begins wherever no joint leads on from the place before.
    along = Window.partitionBy("first.row").orderBy("first.pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = written(marked.withColumn("segment", F.max(F.when(F.col("inner").isNull(), F.col("first.pos"))).over(along)).select("g", "h", "first", "segment"), "marked")
    segments = marked.groupBy(F.struct(F.col("first.row").alias("row"), F.col("segment").alias("pos")).alias("head")).agg(F.max("first").alias("tail"))
    outer = joints.filter(~here).join(segments, F.col("before") == F.col("tail"))
    up = written(outer.select(F.struct("after.row", "after.pos").alias("seg"), F.col("head").alias("up"), F.lit(True).alias("moved")), "up")
    while not up.filter("moved").isEmpty():
        further = up.join(up.select(F.col("seg").alias("of"), F.col("up").alias("next")), F.col("up") == F.col("of"), "left")
        up = written(further.select("seg", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "up")
    head = F.struct(F.col("first.row").alias("row"), F.col("segment").alias("pos"))
    return marked.withColumn("own", head).join(up.select("seg", "up"), F.col("own") == F.col("seg"), "left").select("g", "h", "first", "segment", F.coalesce("up", "own").alias("path"))


def _spans(found: DataFrame, bits: int) -> DataFrame:
    """row, start, n (words), src_row, src_start, path of maximal runs of windows. found: row, parts (pos, src_row, diff, mask, path) of each document."""
    names = ["row", "start", "n", "src_row", "src_start", "path_row", "path_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            ends, flat = _lists(b, 1)
            row = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(ends))
            pos, src, diff, mask, path_row, path_pos = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6))
            part, off = np.nonzero((mask[:, None] >> np.arange(bits)) & 1)
            x = np.stack([row[part], src[part], diff[part] - pos[part], pos[part] + off, path_row[part], path_pos[part]])
            x = x[:, np.lexsort((x[3], x[2], x[1], x[0]))]
            # A run ends where the next window is another document's, source's or place's.
            new = np.append(True, (x[:3, 1:] != x[:3, :-1]).any(0) | (x[3, 1:] != x[3, :-1] + 1) | (x[4:, 1:] != x[4:, :-1]).any(0))[: x.shape[1]]
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, x.shape[1]))
            first = x[:, at]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (first[0], first[3], n, first[1], first[3] + first[2], first[4], first[5])], names)

    return found.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _digests(texts: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """src_row, src_start, n and the SHA-256 of the words there."""
    wanted = spans.select("src_row", "src_start", "n").distinct().groupBy("src_row", F.shiftright("src_start", 13).alias("bin")).agg(F.collect_list(F.struct("src_start", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            ends, flat = _lists(b, 2)
            start, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            digests = []
            for i, text in enumerate(column(b, "text")):
                w = words_of(text)
                digests += [_sha(w[x : x + y + window - 1]) for x, y in zip(start[ends[i] : ends[i + 1]].tolist(), n[ends[i] : ends[i + 1]].tolist(), strict=True)]
            row = np.repeat(b.column(0).to_numpy(zero_copy_only=False), np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(start), pa.array(n), pa.array(digests, pa.binary())], ["d_row", "d_start", "d_n", "digest"])

    return texts.join(wanted, F.col("row") == F.col("src_row")).select("row", "text", "spans").mapInArrow(run, "d_row long, d_start long, d_n long, digest binary")


def _sha(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Spans of windows (row, start, n, src_row, src_start, path_row, path_pos and the digest of the source's words) that stand earlier, and the row numbers of
    copies of whole texts, whose windows all do. rows: numbered. n counts windows; the span has n + window - 1 words."""
    if not 0 <= window - gram < 63:
        raise ValueError("a window has 63 grams at most")
    texts = plain(rows).select(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("_row").alias("row"), F.col("text").cast("binary").alias("text"))
    keyed = written(texts.select("id", "row", F.unhex(F.sha2("text", 256)).alias("key")), "texts")
    low = written(keyed.groupBy("key").agg(F.min(F.struct("id", "row")).alias("low")).select(F.col("key").alias("of_key"), "low.row"), "low")
    copies = cut(keyed.join(low.select("of_key", F.col("row").alias("low")), (F.col("key") == F.col("of_key")) & (F.col("row") != F.col("low"))).select("row"))
    firsts = picked(texts.withColumnRenamed("row", "_row"), copies, "left_anti").withColumnRenamed("_row", "row")
    every = written(pieces(firsts, window, gram), "pieces")
    shared = written(every.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"), "anchors")
    kept = written(every.join(shared.hint("shuffle_hash"), "g", "left_semi"), "shared")
    forget(every)
    classes = written(kept.groupBy("g", "a", "n").agg(F.min(_place()).alias("first"), F.count("*").alias("many")), "classes")
    windows = written(opened(texts, classes, window), "windows")
    edges = windows.groupBy("g", "h").agg(F.min(_place()).alias("first"), F.sum("many").alias("k"), F.any_value("s").alias("s"), F.any_value("t").alias("t")).filter("k > 1")
    edges = written(edges, "edges")
    joined = written(compacted(edges), "compacted")
    forget(edges)
    # Of each class: which windows have which source, as bits by place in the piece.
    met = windows.join(joined.hint("shuffle_hash"), ["g", "h"]).select("g", "row", "base", F.col("pos") - F.col("base"), F.col("first.row").alias("src_row"), (F.col("first.pos") - F.col("pos") + F.col("base")).alias("diff"), "path").toDF("g", "row", "base", "off", "src_row", "diff", "path")
    masks = met.groupBy("row", "base", "src_row", "diff", "path").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("off"))).alias("mask"))
    masks = written(masks, "masks")
    forget(windows, joined)
    sources = masks.groupBy(F.struct("row", F.col("base").alias("pos")).alias("at")).agg(F.collect_list(F.struct("src_row", "diff", "mask", "path")).alias("sources"))
    classes = written(classes.withColumn("at", F.struct("first.row", "first.pos")).join(sources, "at").select("g", "a", "n", "sources"), "sources")
    each = kept.join(classes.hint("shuffle_hash"), ["g", "a", "n"]).select("row", "pos", F.explode("sources").alias("x")).filter("not (x.src_row = row and x.diff = pos)")
    found = each.groupBy("row").agg(F.collect_list(F.struct("pos", "x.src_row", "x.diff", "x.mask", F.col("x.path.row").alias("path_row"), F.col("x.path.pos").alias("path_pos"))).alias("parts"))
    spans = written(_spans(found, window - gram + 1), "spans")
    forget(kept, classes, masks)
    digests = written(_digests(texts, spans, window), "digests")
    same = (F.col("src_row") == F.col("d_row")) & (F.col("src_start") == F.col("d_start")) & (F.col("n") == F.col("d_n"))
    return spans.join(digests, same).drop("d_row", "d_start", "d_n"), copies


def _what_stays(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """rows with _copy and _spans (start, n and digest)."""
    spans, copies = repeated_spans(rows, window, gram)
    gone = spans.groupBy(F.col("row").alias("_of")).agg(F.collect_list(F.struct("start", "n", "digest")).alias("_spans")).withColumn("_copy", F.lit(False))
    gone = gone.unionByName(copies.select(F.col("row").alias("_of"), F.lit(None).cast(gone.schema["_spans"].dataType).alias("_spans"), F.lit(True).alias("_copy")))
    return rows.join(gone, F.col("_row") == F.col("_of"), "left")


def _kept(text: bytes | None, copy: bool | None, start: list[int], n: list[int], digests: list[bytes], window: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = words_of(text)
    if copy:
        return ([] if len(words) >= window else words), len(words)
    if not start:
        return words, len(words)
    stays = np.ones(len(words), bool)
    for a, k, digest in zip(start, n, digests, strict=True):
        b = a + k + window - 1
        if stays[a:b].any() and _sha(words[a:b]) == digest:
            stays[a:b] = False
    return list(compress(words, stays.tolist())), len(words)


def _each_kept(batch: pa.RecordBatch, window: int) -> Iterator[tuple[bytes | None, list[bytes], int]]:
    """text, kept words and number of words of each row with text, _copy, _spans as its last columns."""
    i = batch.num_columns - 1
    ends, flat = _lists(batch, i)
    start, n, digests = (flat.field(j).to_pylist() for j in range(3))
    for j, (text, copy) in enumerate(zip(column(batch, "text"), column(batch, "_copy"), strict=True)):
        k = slice(ends[j], ends[j + 1])
        yield text, *_kept(text, copy, start[k], n[k], digests[k], window)


def report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by blanks) for each row of docs."""
    rows = numbered(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            out = [(n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for _, kept, n in _each_kept(b, window)]
            n, gone, sha = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    at = _what_stays(rows, window, gram).select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").cast("binary").alias("text"), "_copy", "_spans")
    return at.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, all rows and columns; a text that loses words is its other words, joined by blanks (n_chars, where it stands, set anew)."""
    rows = numbered(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            left = [text if text is None or len(kept) == n else b" ".join(kept) for text, kept, n in _each_kept(b, window)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.binary())], ["_at", "_left"])

    keyed = _what_stays(rows, window, gram).select("_row", F.col("doc.text").cast("string").cast("binary").alias("text"), "_copy", "_spans")
    left = written(keyed.mapInArrow(run, "_at long, _left binary"), "left")
    keyed = rows.join(left, F.col("_row") == F.col("_at")).withColumn("_left", F.col("_left").cast("string"))
    doc = F.col("doc").withField("text", F.col("_left").cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("_left").cast(docs.schema["n_chars"].dataType))
    return keyed.select(doc.alias("doc")).select("doc.*")
