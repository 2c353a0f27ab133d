"""Whole-job cases from reviews: each fails on the code before its finding was settled."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from plinth.llm import decontam, setdup, topk
from plinth.llm.queries import op10_line_dedup

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def later_split(spark):
    """A table of one file that is read in one piece while the operators are built, and in many pieces when the result is planned."""
    yield lambda small: spark.conf.set(SPLIT, "2000" if small else "128MB")
    spark.conf.unset(SPLIT)


@pytest.mark.parametrize("operator", ["dedup_lines", "line_report", "keep_one", "keep_clean"])
def test_row_numbers_outlive_other_splits(spark, tmp_path, later_split, operator):
    rows = [(i, f"line {i % 400} of words that stand here for long and again {i % 400} or {i * 7919 % 400}", "en", "s", 9) for i in range(800)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.option("parquet.block.size", "4000").parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 40, 2)], "item_id long, text string")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    run = {
        "dedup_lines": lambda: corpus_pipeline.distinct_lines(spark, docs, str(tmp_path)), "line_report": lambda: op10_line_dedup(spark, str(tmp_path)),
        "keep_one": lambda: corpus_pipeline.distinct_documents(spark, docs, str(tmp_path)), "keep_clean": lambda: decontam.keep_clean(docs, items, 60),
    }[operator]
    later_split(False)
    want = sorted(map(str, run().collect()))
    later_split(False)
    out = run()
    later_split(True)
    assert sorted(map(str, out.collect())) == want


def brute_sets(docs):
    """The ids that stay when pairs of all documents are compared by the Jaccard similarity of their five-word shingles."""
    sets = {i: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())((t or "").lower().split()) for i, t in docs}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i for i in sets if top(i) == i}


@pytest.mark.parametrize("tile", [1024, 4])
def test_near_duplicates_stage_equals_brute_force(spark, monkeypatch, tile):
    """Chains of edits, so that similarities lie on both sides of 0.8 and some components hang on pairs beside a key's first and last class."""
    monkeypatch.setattr(setdup, "TILE", tile)
    rng, docs = random.Random(11), []
    for g in range(8):
        w = [f"w{rng.randrange(900)}" for _ in range(rng.choice([4, 30, 150, 400]))]
        for _ in range(16):
            for _ in range(max(1, len(w) // rng.choice([45, 90]))):
                w = list(w)
                w[rng.randrange(len(w))] = f"w{rng.randrange(900)}"
            docs.append(" ".join(w))
    rng.shuffle(docs)
    docs = list(enumerate([*docs, *docs[:5], None, "", " \n"]))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.distinct_documents(spark, d, "").collect()]
    want = brute_sets(docs)
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(docs) - 40


def test_near_duplicates_stage_on_a_table(spark, small):
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.01')}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()} == brute_sets([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("copies", [2, 6])
def test_top_k_of_repeated_rows(spark, copies):
    x = np.random.default_rng(9).normal(size=(120, 8))
    x[50] *= 20  # a long query vector
    fit = np.floor(256 * x).astype(int)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * copies
    got = sorted(map(tuple, topk.every_fiftieth(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).collect()))
    want = [(q, k + 1, c, -s) for q in (0, 50, 100) for k, (s, c) in enumerate(sorted((-int(fit[q] @ fit[c]), c) for c in range(120) if c != q)[:5])]
    assert got == want
