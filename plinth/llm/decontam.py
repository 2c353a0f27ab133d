"""Benchmark decontamination by winnowing.

Words are hashed, runs of k words (k-grams) get a hash each, and of every w consecutive k-grams the smallest hash is kept
(the later one of equals needs no rule: only the value counts). Any span of k + w - 1 words that both sides share
has the same smallest hash on both sides, so joining the kept hashes finds every such span. With t the length of the
shortest window, k + w - 1 = t: nothing is missed. Document windows with a hit are extended to the items' windows and
compared by the hash of the whole window, then word by word.

A benchmark of at most BLOCK_WORDS words and BLOCK_BYTES bytes (Spark counts both first) is sent to the tasks, and one pass over the documents does
all. A larger one stays in Spark: its kept hashes are joined with those of the documents, and the windows around hits with its windows, as texts.

Defined results: null and empty texts, and texts without words, have no words and no hits; items without words have no
window; equal items, and items with equal windows, count each by its own item_id; a null item_id makes hits but is in no list; repeated
documents get a row each; no benchmark means no hits; no documents give no rows; texts of any length are scanned whole. Other columns pass through
keep_clean untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import column, cut, groups, numbered, plain, small

#: Words of a window; hit words times SHARE reach the words of a contaminated document.
WINDOW, SHARE = 13, 20
#: The largest benchmark that is sent to the tasks; its hashes, word lists and window tables take some 300 MB a task at these bounds.
BLOCK_WORDS, BLOCK_BYTES = 500_000, 8 << 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLOOM_BITS = 22


def _inverse(p: np.uint64) -> np.uint64:
    return np.uint64(pow(int(p), -1, 1 << 64))


_powers: dict[int, np.ndarray] = {}


def powers(p: np.uint64, n: int) -> np.ndarray:
    """p**0 ... p**(n-1) modulo 2**64."""
    have = _powers.get(int(p))
    if have is None or len(have) < n:
        x = np.full(max(n, 4096), p, np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= 1_000_000:
            _powers[int(p)] = have
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _WORD[np.frombuffer(raw, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.uint64) -> np.ndarray:
    """A hash of values[a:b] for each range, from prefix sums of values * p**i."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(p, n), out=prefix[1:])
    back = powers(_inverse(p), n + 1)
    return _mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _Q)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), starts, ends, _P)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; empty if there are fewer."""
    at = np.arange(max(0, len(words) - k + 1))
    return range_hashes(words, at, at + k, _Q)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive hashes."""
    out, have = h, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


@dataclass
class Block:
    """Fingerprints of some items. windows: by length, the sorted hashes, and for each a list of (item, first word)."""

    k: int
    w: int
    kept: np.ndarray
    bloom: np.ndarray
    windows: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]]
    words: list[list[bytes]]
    names: list[str | None]


def block_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Block | None:
    found = []
    for name, text in items:
        raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        a, b = words_of(raw)
        if len(a):
            found.append((name, raw, a, b))
    if not found:
        return None
    shortest = min(window, *(len(a) for _, _, a, _ in found))
    k = (shortest + 1) // 2
    w = shortest - k + 1
    kept: list[np.ndarray] = []
    windows: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for i, (_, raw, a, b) in enumerate(found):
        h = word_hashes(raw, a, b)
        kept.append(np.unique(window_minima(gram_hashes(h, k), w)))
        n = min(window, len(a))
        for j, x in enumerate(gram_hashes(h, n).tolist()):
            windows.setdefault(n, {}).setdefault(x, []).append((i, j))
    all_kept = np.unique(np.concatenate(kept))
    bloom = np.zeros(1 << _BLOOM_BITS, bool)
    bloom[all_kept & np.uint64((1 << _BLOOM_BITS) - 1)] = True
    by_length = {n: (np.array(sorted(x), np.uint64), [x[h] for h in sorted(x)]) for n, x in windows.items()}
    return Block(k, w, all_kept, bloom, by_length, [[raw[s:e] for s, e in zip(a.tolist(), b.tolist(), strict=True)] for _, raw, a, b in found], [x[0] for x in found])


def contains(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def scan(texts: list[str | None], block: Block | None) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: words, merged hit ranges of words, and names of the items with occurring windows."""
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    raw = b" ".join(raws)
    a, b = words_of(raw)
    offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
    first = np.searchsorted(a, offsets)  # of each text, the number of its first word
    counts = np.diff(first)
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    names: list[set[str]] = [set() for _ in texts]
    if block is not None and len(a):
        h = word_hashes(raw, a, b)
        minima = window_minima(gram_hashes(h, block.k), block.w)
        if len(minima):
            maybe = np.flatnonzero(block.bloom[minima & np.uint64((1 << _BLOOM_BITS) - 1)])
            at = maybe[contains(block.kept, minima[maybe])]
            owner = np.searchsorted(first, at, side="right") - 1
            for n, (known, places) in block.windows.items():
                inside = at + n <= first[owner + 1]
                p, o = at[inside], owner[inside]
                if not len(p):
                    continue
                # Of the many places only those with a known k-gram get the hash of the whole window.
                x = gram_hashes(h, n)[p]
                same = contains(known, x)
                for i, d, key in zip(p[same].tolist(), o[same].tolist(), x[same].tolist(), strict=True):
                    here = [raw[s:e] for s, e in zip(a[i : i + n].tolist(), b[i : i + n].tolist(), strict=True)]
                    true = [item for item, j in places[int(np.searchsorted(known, np.uint64(key)))] if block.words[item][j : j + n] == here]
                    if true:
                        names[d].update(block.names[item] for item in true if block.names[item] is not None)
                        hits[d].append((i - int(first[d]), i - int(first[d]) + n))
    return [(int(c), merged(x), sorted(y)) for c, x, y in zip(counts, hits, names, strict=True)]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def size_of(items: DataFrame) -> tuple[int, int, int]:
    """Words (as this operator splits them) and bytes of all items, and words of the shortest item that has any (0: none has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            n = [len(words_of((t or "").encode("utf-8", "surrogatepass").translate(_LOWER))[0]) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([len((t or "").encode("utf-8", "surrogatepass")) for t in column(b, "text")], pa.int64())], ["n", "bytes"])

    r = items.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n long, bytes long").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("least")).first()
    return r.n or 0, r.bytes or 0, r.least or 0


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _pass(rows: DataFrame, block: Block | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = column(b, "text")
            found = [x for s, e in groups(texts) for x in scan(texts[s:e], sent.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in found], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in x[1]] for x in found], _SPANS), pa.array([x[2] for x in found], pa.list_(pa.string()))], ["row", "doc_id", "n_words", "hits", "items"])

    return rows.mapInArrow(run, "row long, doc_id long, n_words long, hits array<struct<s:int,e:int>>, items array<string>")


def _joined(rows: DataFrame, items: DataFrame, least: int, window: int = WINDOW) -> DataFrame:
    """What _pass gives, for a benchmark of any size. rows: _row, doc_id, text."""
    shortest = min(window, least)
    k = (shortest + 1) // 2
    w = shortest - k + 1

    def split(t: str | None):
        raw = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        return raw, *words_of(raw)

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """item, n, kept (hashes) and windows (texts) of each item."""
        for b in small(batches, 32):
            out = []
            for t in column(b, "text"):
                raw, a, e = split(t)
                n = min(window, len(a))
                kept = np.unique(window_minima(gram_hashes(word_hashes(raw, a, e), k), w)).view(np.int64).tolist() if n else []
                x = [raw[i:j] for i, j in zip(a.tolist(), e.tolist(), strict=True)]
                out.append((n, kept, sorted({b" ".join(x[i : i + n]) for i in range(len(x) - n + 1)}) if n else []))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.binary()))], ["item", "n", "kept", "windows"])

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, n_words and kept hashes of each document."""
        for b in small(batches, 32):
            out = []
            for t in column(b, "text"):
                raw, a, e = split(t)
                out.append((len(a), np.unique(window_minima(gram_hashes(word_hashes(raw, a, e), k), w)).view(np.int64).tolist() if len(a) >= shortest else []))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["row", "doc_id", "n_words", "kept"])

    marks = cut(items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).mapInArrow(of_items, "item string, n int, kept array<long>, windows array<binary>").filter("n > 0"))
    lengths = [r.n for r in marks.select("n").distinct().collect()]  # window lengths: 13 at most
    seen = cut(rows.mapInArrow(of_docs, "row long, doc_id long, n_words long, kept array<long>"))
    known = cut(marks.select(F.explode("kept").alias("h")).distinct())
    near = seen.select("row", F.explode("kept").alias("h")).join(known, "h", "left_semi").groupBy("row").agg(F.collect_set("h").alias("known"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, s, n, window: the windows that begin at a k-gram minimum which the benchmark has."""
        for b in small(batches, 32):
            out = []
            for row, t, have in zip(column(b, "_row"), column(b, "text"), column(b, "known"), strict=True):
                raw, a, e = split(t)
                minima = window_minima(gram_hashes(word_hashes(raw, a, e), k), w)
                at = np.flatnonzero(contains(np.sort(np.array(have, np.int64).view(np.uint64)), minima)).tolist()
                x = [raw[i:j] for i, j in zip(a.tolist(), e.tolist(), strict=True)]
                out += [(row, i, n, b" ".join(x[i : i + n])) for n in lengths for i in at if i + n <= len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["row", "s", "n", "window"])

    found = cut(rows.join(near, F.col("_row") == F.col("row")).select("_row", "text", "known").mapInArrow(extend, "row long, s int, n int, window binary"))
    windows = cut(marks.select("item", "n", F.explode("windows").alias("window")))
    # Windows are matched first without their items, so that one which many items share makes no more rows than places.
    hit = cut(found.join(cut(windows.select("n", "window").distinct()), ["n", "window"], "left_semi"))
    spans = hit.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("h"))
    named = hit.select("row", "n", "window").distinct().join(windows, ["n", "window"]).filter("item is not null").select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    step = "case when size(acc) > 0 and element_at(acc, -1).e >= x.s then concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.e)))) else concat(acc, array(x)) end"
    spans = spans.select("row", F.expr(f"aggregate(h, cast(array() as array<struct<s:int,e:int>>), (acc, x) -> {step})").alias("hits"))
    none, nobody = F.expr("cast(array() as array<struct<s:int,e:int>>)"), F.expr("cast(array() as array<string>)")
    return seen.drop("kept").join(spans, "row", "left").join(named, "row", "left").select("row", "doc_id", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("items", nobody).alias("items"))


def _block_if_small(items: DataFrame, most_words: int) -> tuple[bool, Block | None, int]:
    """Whether the benchmark may be sent to the tasks, then its fingerprints, and the words of its shortest item."""
    n, size, least = size_of(items)
    if n > most_words or size > BLOCK_BYTES:
        return False, None, least
    return True, block_of([tuple(r) for r in items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).collect()]), least


def hit_spans(docs: DataFrame, items: DataFrame, most_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs: row, doc_id, n_words, hits (disjoint ranges of word numbers) and items (sorted, distinct)."""
    sent, block, least = _block_if_small(items, most_words)
    if not sent:
        return _joined(plain(numbered(docs.select("doc_id", "text"))), items, least)
    return _pass(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), block)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and hits for each row of docs."""
    found = hit_spans(docs, items).withColumn("n_hit", F.expr("aggregate(hits, 0L, (n, x) -> n + x.e - x.s)"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"), "hits")


def keep_clean(docs: DataFrame, items: DataFrame, most_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated."""
    small_enough, block, least = _block_if_small(items, most_words)
    if not small_enough:
        rows = numbered(docs)
        spans = _joined(plain(rows), items, least).withColumn("n_hit", F.expr("aggregate(hits, 0L, (n, x) -> n + x.e - x.s)"))
        bad = spans.filter((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).select("row")
        return rows.join(bad, F.col("_row") == F.col("row"), "left_anti").select("doc.*")
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = column(b, "text")
            keep = []
            for s, e in groups(texts):
                for n, hits, _ in scan(texts[s:e], sent.value):
                    hit = sum(y - x for x, y in hits)
                    keep.append(not (hit > 0 and hit * SHARE >= n))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
