"""The pipeline's near duplicates go through operator 7's buckets and index before anything else."""

import random

from pyspark.sql import functions as F

from plinth.llm import setdup


def test_buckets_of_fingerprints_find_near_copies_by_themselves(spark, monkeypatch):
    """Without min-wise keys what lies within the fingerprints' radius is found, and only what is similar by whole sets."""
    signed = setdup._signed
    monkeypatch.setattr(setdup, "_signed", lambda rows, shingle: signed(rows, shingle).withColumn("keys", F.array().cast("array<bigint>")))
    rng, docs = random.Random(3), []
    for _ in range(12):
        w = [f"w{rng.randrange(5000)}" for _ in range(400)]
        docs += [" ".join(w), " ".join([*w, "end"]), " ".join(["start", *w])]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert sorted(r.doc_id for r in setdup.keep_one(d).collect()) == list(range(0, 36, 3))
