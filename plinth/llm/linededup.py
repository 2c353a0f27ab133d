"""Line dedup by a deletion-neighbourhood join, with DataFrame functions alone.

Two lines are near copies if one word's insertion, deletion or replacement makes them equal (lines of MIN_WORDS words or more);
shorter lines are copies only if equal. A line goes if an earlier line (by doc_id, then row, then line number) is a copy or near copy of it.
Lines are compared without blanks at their ends; words are what single blanks separate. Blank lines always stay.

1. Equal lines become one class at its first place (a partial aggregate runs before the shuffle, so a very common line costs a
   row for each task). A class keeps hashes of its first and last halves, not its text.
2. Only lines that share a half with another class can be near copies: one edit leaves a half as it is. The halves' hashes are
   counted, and only lines with a shared half go on; their texts are fetched again from where they stand.
3. Those emit their deletion neighbourhood: a key for each word left out (its place is part of the key when it may be replaced), and
   a key for the line itself. Keys are XORs of hashes of (place, word), so a line of n words costs n steps, not n squared.
4. Equal keys are joined with the earliest line of the key; each such link is verified on the words, and links to the earliest
   suffice, so no key ever makes pairs of its lines.

Defined results: null texts stay null, empty texts stay; texts whose lines all go become empty; repeated rows keep their first row's lines;
a null doc_id comes after all others; an empty table gives no rows; texts and lines of any length are taken whole; other columns pass
through dedup_lines untouched, whatever their names, for a row travels as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import cut, numbered, plain, written

#: Words from which a line has near copies.
MIN_WORDS = 8
#: What a key stands for: a line with a word replaced, a line with a word left out, a line itself.
SWAP, GAP, OWN = 0, 1, 2


#: Bytes of fetched places up to which they are broadcast; beyond, they are joined by a shuffle. A place takes PLACE_BYTES, a row of places as much again.
BROADCAST_BYTES, PLACE_BYTES = 64 << 20, 72


def lines_of(rows: DataFrame) -> DataFrame:
    """row, doc_id, no and line of each line that isn't blank. rows: numbered."""
    rows = plain(rows).select(F.col("_row").alias("row"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "raw"))
    return rows.select("row", "doc_id", "no", F.trim(F.col("raw")).alias("line")).filter("line <> ''")


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "row", "no")


def halves(min_words: int) -> Column:
    """Hashes of the first and last halves of a line of n words, empty for a short line. The longer line of a pair has n or n + 1 words, m; the halves are
    its first m div 2 words and its other words, counted from the end. Three of the four lengths differ."""
    first = "xxhash64('first', {0}, substring_index(line, ' ', {0}))"
    last = "xxhash64('last', {0}, substring_index(line, ' ', -({0})))"
    low, high = "(n div 2)", "((n + 1) div 2)"
    low, high = f"cast{low[:-1]} as int)", f"cast{high[:-1]} as int)"
    return F.expr(f"if(n < {min_words}, cast(array() as array<bigint>), array({first.format(low)}, {last.format(high)}, if(n % 2 = 0, {last.format(low + ' + 1')}, {first.format(high)})))")


def classes_of(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """a and b (two hashes of a line, which name its class), first (the place of its first occurrence) and halves."""
    n = (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n")
    keyed = lines.select("*", n).select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), F.col("line")).alias("b"), place().alias("at"), halves(min_words).alias("halves"))
    return keyed.groupBy("a", "b").agg(F.min("at").alias("first"), F.any_value("halves").alias("halves"))


def candidates(classes: DataFrame) -> DataFrame:
    """a, b, first of the classes that share a half with another one."""
    one = classes.select("a", F.explode("halves").alias("half"))
    shared = one.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")  # a class's own halves differ
    # Written first: a join of two plain tables is one whose hot keys Spark can split.
    some = one.join(cut(shared), "half", "left_semi").select(F.col("a").alias("some")).distinct()
    return classes.join(some, F.col("a") == F.col("some"), "left_semi").select("a", "b", "first")


def texts_at(rows: DataFrame, places: DataFrame) -> DataFrame:
    """a, b, first, line of places (a, b, first): each row's wanted lines are gathered, and only its text is split again."""
    wanted = places.groupBy(F.col("first.row").alias("of")).agg(F.collect_list(F.struct("a", "b", "first")).alias("places"))
    wanted = cut(wanted)
    if (wanted.agg(F.sum(F.size("places") + 1)).first()[0] or 0) * PLACE_BYTES <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    got = plain(rows).join(wanted, F.col("_row") == F.col("of")).withColumn("lines", F.split("text", "\n", -1))
    return got.select(F.explode(F.transform("places", lambda p: F.struct(p.a.alias("a"), p.b.alias("b"), p.first.alias("first"), F.trim(F.get("lines", p.first.no)).alias("line")))).alias("p")).select("p.*")


def near_copies(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """row and no of the first line of each class that an earlier near copy makes go."""
    found = texts_at(rows, cut(candidates(classes)))
    chosen = cut(found.select(F.struct("a", "b").alias("id"), F.col("first").alias("at"), F.split("line", " ").alias("w")))
    keys = _neighbourhood(chosen)
    # Keys that stand once go first: what is left is small enough to carry places. A class that has a key twice is no link, for links go to earlier lines.
    met = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    keys = written(keys.join(cut(met), "key", "left_semi").join(chosen.select(F.col("id.a").alias("of"), "id", "at"), F.col("a") == F.col("of")).select("key", "kind", "spot", "id", "at"), "keys")
    # The earliest of a key: any member for replacements; the line itself against those with a word more, for deletions.
    mine = F.struct("at", "id", "spot")
    low = keys.groupBy("key").agg(F.min(F.when(F.col("kind") != GAP, mine)).alias("own"), F.min(F.when(F.col("kind") != OWN, mine)).alias("any"))
    links = keys.join(cut(low), "key").withColumn("to", F.when(F.col("kind") == GAP, F.col("own")).otherwise(F.col("any")))
    links = links.filter("to is not null and to.at < at").select("id", "at", "kind", "spot", F.col("to.id").alias("to_id"), F.col("to.spot").alias("to_spot"))
    here, there = chosen.select("id", "w"), chosen.select(F.col("id").alias("to_id"), F.col("w").alias("v"))
    # A replaced word stands at the same place of both lines, which its key holds.
    same = F.when(F.col("kind") == SWAP, _without("w", "spot") == _without("v", "spot")).when(F.col("kind") == GAP, _without("w", "spot") == F.col("v")).otherwise(F.col("w") == _without("v", "to_spot"))
    return links.join(here, "id").join(there, "to_id").filter(same).select("at.row", "at.no").distinct()


def _without(words: str, spot: str) -> Column:
    return F.expr(f"concat(slice({words}, 1, {spot}), slice({words}, {spot} + 2, greatest(size({words}) - {spot} - 1, 0)))")


def _neighbourhood(chosen: DataFrame) -> DataFrame:
    """key, kind (SWAP, GAP or OWN), spot (the word left out), a (the class)."""
    e = chosen.select(F.col("id.a").alias("a"), "w", F.size("w").alias("n"))
    e = e.withColumn("e", F.transform("w", lambda w, i: F.xxhash64(i, w))).withColumn("f", F.transform("w", lambda w, i: F.xxhash64(i - 1, w))).drop("w")
    # XORs of all places before each place: of words where they stand, and of words moved up by one.
    running = "aggregate({0}, named_struct('x', 0L, 'xs', array(0L)), (a, v) -> named_struct('x', a.x ^ v, 'xs', array_append(a.xs, a.x ^ v)), a -> a.xs)"
    e = e.withColumn("pe", F.expr(running.format("e"))).withColumn("pf", F.expr(running.format("f")))
    e = e.withColumn("te", F.expr("pe[n]")).withColumn("tf", F.expr("pf[n]"))
    swap = F.expr(f"transform(e, (x, i) -> named_struct('key', xxhash64('swap', n, i, te ^ x), 'kind', {SWAP}, 'spot', i))")
    gap = F.expr(f"transform(e, (x, i) -> named_struct('key', xxhash64('gap', n - 1, pe[i] ^ tf ^ pf[i + 1]), 'kind', {GAP}, 'spot', i))")
    own = F.expr(f"array(named_struct('key', xxhash64('gap', n, te), 'kind', {OWN}, 'spot', 0))")
    return e.select("a", F.explode(F.concat(swap, gap, own)).alias("k")).select("k.key", "k.kind", "k.spot", "a")


def kept_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_of (row), _kept (numbers of its lines that stay, blank ones aside) and _near (lines, first of their kind, that a near copy makes go). rows: numbered."""
    classes = written(classes_of(lines_of(rows), min_words), "classes")
    firsts = classes.select("first.row", F.col("first.no").alias("stays"), F.lit(None).cast("int").alias("goes"))
    near = near_copies(rows, classes).select("row", F.lit(None).cast("int").alias("stays"), F.col("no").alias("goes"))
    # Both are gathered by row at once, so the classes need no join with the few that go.
    each = firsts.unionByName(near).groupBy(F.col("row").alias("_of")).agg(F.collect_list("stays").alias("firsts"), F.collect_list("goes").alias("gone"))
    return each.select("_of", F.array_except("firsts", "gone").alias("_kept"), F.size("gone").cast("long").alias("_near"))


def _stays(text: str) -> str:
    """Lines of a text, those that go taken out. A row without kept lines has none in kept_lines, or an empty list."""
    return f"array_join(filter(split(cast({text} as string), '\\n', -1), (l, i) -> trim(l) = '' or coalesce(array_contains(_kept, i), false)), '\\n')"


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all rows and columns, with the lines that go taken out of text (and n_chars, where it stands, set anew)."""
    rows = numbered(docs)
    keyed = rows.join(kept_lines(rows, min_words), F.col("_row") == F.col("_of"), "left").withColumn("_left", F.expr(_stays("doc.text")))
    doc = F.col("doc").withField("text", F.col("_left").cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("_left").cast(docs.schema["n_chars"].dataType))
    return keyed.select(doc.alias("doc")).select("doc.*")


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (not blank), n_removed, n_near and kept_sha256 (of the text that stays; null text: of the empty one) for each row of docs."""
    rows = numbered(docs.select("doc_id", "text"))
    keyed = plain(rows).join(kept_lines(rows, min_words), F.col("_row") == F.col("_of"), "left")
    n = F.expr("coalesce(size(filter(split(text, '\n', -1), l -> trim(l) <> '')), 0)")
    kept = F.coalesce(F.expr(_stays("text")), F.lit(""))
    return keyed.select("doc_id", n.cast("long").alias("n_lines"), (n - F.coalesce(F.size("_kept"), F.lit(0))).cast("long").alias("n_removed"), F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
