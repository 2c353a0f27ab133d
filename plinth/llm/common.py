"""What several corpus operators share: checkpoints, stable row ids, batches of whole texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once; a longer text makes a group of its own.
GROUP_BYTES = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of checkpoints: the cluster's spark.checkpoint.dir. Only a local session without one gets a folder of its own; a cluster needs a shared one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="plinth-checkpoint-"))
    return sc.getCheckpointDir()


#: Spark's own setting by which the shuffle files of an action go when it ends, instead of whenever the driver collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Actions on frames made within leave no shuffle files behind: what they write is read from the shared folder, so nothing needs them again.
    While an action runs, lost shuffle files are made anew as ever. The session's own setting is put back."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from there: no lost executor makes its rows anew."""
    checkpoint_dir(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint()


def whole(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name of theirs can clash with one of ours."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """df, written as compressed Parquet to the checkpoint folder and read from there."""
    if any(x in df.schema.simpleString() for x in ("void", "interval")):  # Parquet can't hold these types
        return cut(df)
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*steps: DataFrame) -> None:
    """Deletes the folders of written steps that no later step reads."""
    for df in steps:
        spark = df.sparkSession
        top, jvm = checkpoint_dir(spark), spark.sparkContext._jvm
        folders = {f[f.index(top.rstrip("/").rpartition("/")[2]) :] for f in df.inputFiles()}
        for name in {x.split("/")[1] for x in folders}:
            path = jvm.org.apache.hadoop.fs.Path(f"{top}/{name}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame) -> DataFrame:
    """_row (a number of each row) and doc (the row as a struct). Numbers and rows are written together, once, and only read afterwards: numbering
    a scan again gives other numbers when its files are split otherwise, as happens when executors come or go."""
    return written(docs.select(F.monotonically_increasing_id().alias("_row"), whole(docs).alias("doc")))


def plain(rows: DataFrame) -> DataFrame:
    """_row, doc_id and text of numbered rows."""
    return rows.select("_row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"))


#: Row numbers up to which a set of rows is broadcast (some 32 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def picked(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose _row is among ids (one column, distinct), or with left_anti the others. A small set of ids spares the rows a shuffle."""
    ids = cut(ids.toDF("of"))
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("_row") == F.col("of"), how)


def groups(texts: list[str | None], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts with about limit characters each, so that work arrays stay small whatever a batch holds."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        k = len(t or "")
        if n and n + k > limit:
            yield a, i
            a, n = i, 0
        n += k
    if a < len(texts):
        yield a, len(texts)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: as Python objects only these are in memory at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def crc_mod(col, n: int):
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(n))
