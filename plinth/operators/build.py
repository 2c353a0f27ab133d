"""From rendered sections to a searchable corpus: chunks, embeddings, an upsert and a check of the counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.operators import chunking, retrieval
from plinth.sources import writers


def build_corpus(sections: DataFrame, base_url: str, path: str, embedder: Callable[[Column], Column] | None = None, reset: bool = False, most: int = 500) -> dict[str, int]:
    """Chunks the sections, embeds the chunks and upserts them by id under path. Returns chunks, added (ids that were not there) and stored.

    No chunks, a chunk without text, or a table that afterwards lacks an id is an error; what was stored before stays readable then."""
    spark = sections.sparkSession
    chunks = chunking.chunks(sections, base_url, most)
    n, blank = chunks.agg(F.count_distinct("id"), F.count_if(F.length("text") == 0)).first()
    if not n or blank:
        raise ValueError(f"{n} chunks, {blank} of them without text: nothing is stored")
    before = None if reset else writers.read_table(spark, path)
    had = before.count() if before is not None else 0
    writers.upsert(spark, path, retrieval.embed(chunks, embedder=embedder), reset=reset)
    stored = writers.read_table(spark, path)
    lacking = chunks.select("id").join(stored.select("id"), "id", "left_anti").count()
    if lacking:
        raise ValueError(f"{lacking} chunks are not in the table at {path}")
    total = stored.count()
    return {"chunks": n, "added": total - had, "stored": total}
