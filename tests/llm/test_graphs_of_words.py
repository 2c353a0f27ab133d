"""Substring dedup, spelling variants and the Merkle manifest against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plinth.llm import merkle, repeats, spelling
from tests.llm.test_operators import AWKWARD, DOCS, frames


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_repeats(docs, window):
    """docs: (doc_id, text) in the order of rows."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    words = [(t or "").encode().split() for _, t in docs]
    seen, out = set(), []
    for i in order:
        w, gone = words[i], set()
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone.update(range(j, j + window))
            seen.add(key)
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((docs[i][0], len(w), len(gone), sha(b" ".join(kept))))
    return Counter(out)


@pytest.mark.parametrize("window,gram,letters", [(20, 6, 50), (6, 2, 3), (5, 5, 2)])
def test_repeats_equal_brute_force(spark, window, gram, letters):
    """Few words make branches, rings and documents that repeat themselves; passages are planted whole, cut and end to end."""
    rng = random.Random(window)
    word = lambda: "w%d" % rng.randrange(letters)
    passages = [[word() for _ in range(rng.randrange(window - 1, 4 * window))] for _ in range(6)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(3 * window))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(w) + 1)
            w[a:a] = p[rng.randrange(3) : len(p) - rng.randrange(3)]
        docs.append((rng.randrange(50), " ".join(w)))
    docs += [(None, docs[3][1]), (99, docs[4][1]), (0, "a b " * 60), (100, "c " * 200), (101, None), (102, ""), (103, docs[5][1] + "\t" + docs[6][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert Counter(map(tuple, repeats.report(frame, window, gram).collect())) == brute_repeats(docs, window)


def test_spans_paths_and_texts_without_repeats(spark):
    shared = [f"s{i}" for i in range(40)]
    docs = [(1, "a b " + " ".join(shared) + " c"), (2, "d " + " ".join(shared[5:]) + " e f"), (3, " ".join(shared[:35]) + " g")]
    frame = spark.createDataFrame([d + (7, "x", d[1]) for d in docs], "doc_id long, text string, n_chars int, _row string, doc string")
    rows = repeats.numbered(frame)
    spans, copies = repeats.repeated_spans(rows)
    got = sorted((r.start, r.n, r.src_start) for r in spans.collect())
    assert got == [(0, 16, 2), (1, 16, 7)] and copies.count() == 0
    out = {r.doc_id: r for r in repeats.without_repeats(frame).collect()}
    assert out[1].text == docs[0][1] and out[2].text == "d e f" and out[3].text == "g" and out[2].n_chars == 5 and out[2].doc == docs[1][1]


def test_paths_go_on_in_other_documents(spark):
    """The first half of a passage stands earlier elsewhere: two sources, one path."""
    p = [f"p{i}" for i in range(30)]
    docs = [(1, " ".join(p[:12])), (2, " ".join(p)), (3, " ".join(p))]
    texts = spark.createDataFrame(docs + [(4, "z " + " ".join(p))], "doc_id long, text string")
    spans, _ = repeats.repeated_spans(repeats.numbered(texts), 6, 2)
    assert spans.select("path_row", "path_pos").distinct().count() == 1 and spans.select("src_row").distinct().count() == 2


def brute_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = defaultdict(set)
    for w in n:
        for v in {w[:i] + "\0" + w[i + 1 :] for i in range(len(w))} | {w[:i] + "\0" + w[i:] for i in range(len(w) + 1)}:
            near[v].add(w)
    met = defaultdict(set)
    for group in near.values():
        for a in group:
            met[a] |= group - {a}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
        return a != b and len(b) - len(a) <= 1 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])

    near = {w: [x for x in met[w] if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n[w], form[w], n[form[w]] if form[w] else None, root, len(near[w])))
    return out


@pytest.mark.parametrize("long_", [False, True])
def test_variants_equal_brute_force(spark, long_, monkeypatch):
    """Words of two letters have many neighbours; with long words the other exact way is taken, and the border between both."""
    rng = random.Random(5)
    if long_:
        monkeypatch.setattr(spelling, "LONG", 8)
    letters = "abÀé"
    words = ["".join(rng.choice(letters[: rng.choice((2, 4))]) for _ in range(rng.randrange(4, 12))) for _ in range(400)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(60)] + [(None, "aaaaa " * 40), (7, "AAAAA×÷ bbbbb"), (8, None), (9, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.word, r.n, r.form, r.form_n, r.root, r.n_near) for r in spelling.variants(frame).collect()}
    assert got == brute_variants(docs) and any(r[2] for r in got) and max(r[5] for r in got) > 5


def test_very_long_words(spark):
    w = "ab" * 4000
    docs = [(i, f"{w} {w[:3000]}x{w[3000:]} {w[:77]}{w[78:]} {'c' * 39} {'c' * 40} {'c' * 38} plain") for i in range(3)] + [(9, w)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.word, r.n, r.form, r.form_n, r.root, r.n_near) for r in spelling.variants(frame).collect()}
    assert got == brute_variants(docs) and max(r[5] for r in got) >= 2


def brute_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, l, n, t: sha("".join(map(told, (i, s, l, n, t))))  # noqa: E731, E741

    def tree(x):
        levels = [x]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
        return levels

    by = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        by[r[2]].append(((r[0] is None, r[0] or 0), leaf(*r), leaf(r[0], r[1], r[2], r[3] + 1, r[4]) if hit else leaf(*r), r[0]))
    trees = {k: tree([x[1] for x in sorted(v)]) for k, v in by.items()}
    order = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    top = tree([trees[k][-1][0] for k in order])
    out = Counter()
    for k, v in by.items():
        for i, x in enumerate(sorted(v)):
            siblings, fold = "", x[2]
            for levels, at in ((trees[k], i), (top, order.index(k))):
                for level in levels[:-1]:
                    run = level[at // 2 * 2 :][:2]
                    siblings += "".join(run[: at % 2] + run[at % 2 + 1 :])
                    run[at % 2] = fold
                    fold, at = sha("".join(run)), at // 2
            out[(x[3], x[1], trees[k][-1][0], top[-1][0], sha(siblings), fold, fold == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("ranges", [200_000, 7])
def test_manifest_equals_trees_built_by_hand(spark, monkeypatch, ranges):
    """A tree of one leaf, of two, of an odd number and of more than a block; with ranges of 7 rows places come from many tasks."""
    monkeypatch.setattr(merkle, "RANGE", ranges)
    rng = random.Random(3)
    rows = [(rng.randrange(10_000), rng.choice(("s", None, "é")), lang, rng.choice((None, 5, 10)), "t" * rng.randrange(3)) for lang, n in ((None, 1), ("", 2), ("de", 67), ("en", 200), ("é", 3)) for _ in range(n)]
    rows += [rows[-1], (None, None, "en", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = merkle.report(docs, merkle.changed()).collect()
    assert Counter(map(tuple, got)) == brute_merkle(rows) and 0 < sum(not r.verified for r in got) < len(got)
    m = merkle.manifest(docs).limit(50)
    assert m.filter(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0


@pytest.mark.parametrize("which", ["awkward", "clashing", "empty"])
def test_awkward_rows(spark, which):
    docs = frames(spark)[which]
    n, rows = docs.count(), [r[:5] for r in docs.collect()]
    got = repeats.report(docs).collect()
    assert Counter(map(tuple, got)) == (brute_repeats([(r[0], r[1]) for r in rows], 20) if n else Counter())
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == n
    got = {(r.word, r.n, r.form, r.form_n, r.root, r.n_near) for r in spelling.variants(docs).collect()}
    assert got == brute_variants([(r[0], r[1]) for r in rows])
    got = merkle.report(docs, merkle.changed()).collect()
    assert Counter(map(tuple, got)) == (brute_merkle([(r[0], r[3], r[2], r[4], r[1]) for r in rows]) if n else Counter())
    assert AWKWARD and DOCS
