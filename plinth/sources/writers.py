"""Writers: JSON lines with counts, idempotent upserts, incremental runs and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from plinth.functions.shared import kept
from plinth.functions.text import safe_name
from plinth.sources.entity_files import EntityFiles


def write_jsonl(rows: DataFrame, path: str) -> int:
    """Writes UTF-8 JSON lines and gives their number, counted in the same job."""
    seen = Observation("written")
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def upserted(old: DataFrame | None, new: DataFrame, key: str = "id", order: str = "batch") -> DataFrame:
    """old and new with one row for each key (null is a key, too), that of the highest order (new after old; of equals the one with the greatest hash). Rows of a key
    meet as partial maxima, so a hot key costs a row for each task. Rows travel as structs: columns may have any name."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    kind = both.schema

    def side(df: DataFrame, n: int) -> DataFrame:
        there = {f.name for f in df.schema}
        row = F.struct(*[(q(f.name) if f.name in there else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])
        return df.select(row.alias("row"), F.lit(n).alias("side"))

    rows = side(new, 1) if old is None else side(old, 0).unionByName(side(new, 1))
    last = [F.col("row").getField(order)] if order in both.columns else []
    tie = [] if "map<" in kind.simpleString() else [F.xxhash64("row")]
    place = F.struct(F.col("side"), *[x.alias(f"x{i}") for i, x in enumerate([*last, *tie])])
    return rows.groupBy(F.col("row").getField(key).alias("key")).agg(F.max_by("row", place).alias("row")).select("row.*")


#: The folders of a table: rows by a hash of their key. No column of a table may have this name.
BUCKET, BUCKETS = "_key_bucket", 64


def upsert(spark: SparkSession, base: str, new: DataFrame, key: str = "id", reset: bool = False, batch: int | None = None, writer: str = "w", buckets: int = BUCKETS) -> list[int]:
    """Upserts into the table under base and gives the buckets that were written anew.

    A row lies in the folder of its key's hash. Only folders that new rows fall into are read, merged and overwritten (dynamic partition overwrite); Spark swaps
    each in when the job commits and deletes what it replaces, so no old version stays behind. batch: the number of a micro-batch of `writer`; one that is
    already marked as done changes nothing. A job that is lost before its mark is repeated, which gives the same rows, for merging is idempotent. The number of buckets is
    kept with the table; a reader should not read while a writer commits."""
    if BUCKET in new.columns:
        raise ValueError(f"{BUCKET} names the table's folders")
    old = None if reset else read_table(spark, base)
    if reset:
        _delete(spark, base)
    marks = f"{base}/_batches/{writer}"
    if batch is not None and _exists(spark, f"{marks}-{batch}"):
        return []
    if old is not None:
        buckets = int(next(x for x in _names(spark, base) if x.startswith("_buckets-")).rpartition("-")[2])
    elif not _exists(spark, f"{base}/_buckets-{buckets}"):
        _touch(spark, f"{base}/_buckets-{buckets}")
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).cast("int").alias(BUCKET)
    placed = kept(new.select("*", bucket), "upsert")
    touched = sorted(r[0] for r in placed.select(BUCKET).distinct().collect())  # BUCKETS numbers at most
    if touched:
        there = None if old is None else spark.read.option("mergeSchema", "true").parquet(base).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        merged = upserted(there, placed.drop(BUCKET), key).select("*", bucket)
        merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(base)
    if batch is not None:
        _touch(spark, f"{marks}-{batch}")
        for name in _names(spark, f"{base}/_batches"):  # older marks are of no use: a stream repeats its last batch only
            if name.startswith(f"{writer}-") and int(name.rpartition("-")[2]) < batch - 1:
                _delete(spark, f"{base}/_batches/{name}")
    return touched


def read_table(spark: SparkSession, base: str) -> DataFrame | None:
    """The table under base, or None."""
    if not _exists(spark, base) or not any(x.startswith(f"{BUCKET}=") for x in _names(spark, base)):
        return None
    return spark.read.option("mergeSchema", "true").parquet(base).drop(BUCKET)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


def _touch(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.create(p, True).close()


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_entities(rows: DataFrame, path: str, title: str = "title", category: str = "category") -> None:
    """Records by category, each with a name that is safe for files."""
    rows.withColumn("safe_name", safe_name(F.col(title))).write.mode("overwrite").partitionBy(category).parquet(path)


def write_entity_files(rows: DataFrame, path: str, title: str = "title", category: str = "category") -> int:
    """One JSON file for each entity, category/name.json with names that are safe for files; gives their number. Of titles with one safe name the last one's file
    stays. A null category is `_`, a null or empty title `_`. path: a URI that pyarrow's file systems reach (a local or shared folder, or an object store)."""
    name = lambda c: F.coalesce(F.nullif(safe_name(F.col(f"`{c}`").cast("string")), F.lit("")), F.lit("_"))
    named = rows.select(name(category).alias("folder"), name(title).alias("name"), F.col(f"`{title}`").cast("string").alias("title"), F.to_json(F.struct("*")).alias("json"))
    # Files take time, not bytes: rows are dealt over as many tasks as a shuffle has, however few bytes they are.
    named = named.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "folder", "name")
    one = named.groupBy("folder", "name").agg(F.max_by("json", F.struct("title", "json")).alias("json"))
    spark = rows.sparkSession
    spark.dataSource.register(EntityFiles)
    seen = Observation("entities")
    one.observe(seen, F.count(F.lit(1)).alias("n")).write.format("entity_files").mode("append").save(path)
    return seen.get["n"]


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables, cut by kind and relation so that a query reads only its own."""
    nodes.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def write_graph_tables(nodes: DataFrame, edges: DataFrame, name: str, path: str, buckets: int = 64) -> dict[str, str]:
    """Tables under path, known to the session by the names that are returned: nodes in buckets of node_id, out and in edges in buckets of src and dst, so a hop joins
    them without shuffling an edge, and stats: what (node or edge), kind, n and, on the rows without a kind, all of them."""
    names = {k: f"{name}_{k}" for k in ("nodes", "out", "in", "stats")}
    for df, part, key in ((nodes, "nodes", "node_id"), (edges, "out", "src"), (edges, "in", "dst")):
        # Dealt by bucket first: one file for each bucket, not one for each bucket and task.
        df.repartition(buckets, key).write.mode("overwrite").option("path", f"{path}/{part}").bucketBy(buckets, key).sortBy(key).saveAsTable(names[part])
    spark = nodes.sparkSession
    counted = [spark.table(names[part]).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n") for part, kind, what in (("nodes", "kind", "node"), ("out", "relation", "edge"))]
    stats = counted[0].unionByName(counted[1])
    stats = stats.unionByName(stats.groupBy("what").agg(F.sum("n").alias("n")).select("what", F.lit(None).cast("string").alias("kind"), "n"))
    stats.write.mode("overwrite").option("path", f"{path}/stats").saveAsTable(names["stats"])
    return names


def not_done(wanted: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key has no output yet."""
    return wanted if done is None else wanted.join(done.select(key).distinct(), key, "left_anti")


def run_report(rows: DataFrame, key: str, most: int = 100) -> DataFrame:
    """status, n, items: the first `most` keys of each status (a report's bound). rows: key, status."""
    n = rows.groupBy("status").agg(F.count("*").alias("n"))
    w = Window.partitionBy("status").orderBy(key)
    some = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).groupBy("status").agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("items"))
    return n.join(some, "status")


def write_split(train: DataFrame, evaluation: DataFrame, manifest: DataFrame, path: str) -> None:
    for name, df in (("train", train), ("eval", evaluation), ("manifest", manifest)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_report(report: DataFrame, sample: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(f"{path}/report")
    sample.write.mode("overwrite").json(f"{path}/sample")


def episode_id(raw: Column) -> Column:
    """A safe id: other characters become dashes, dashes and lines at the ends go; nothing left: episode."""
    clean = F.btrim(F.regexp_replace(raw, r"[^A-Za-z0-9_-]", "-"), F.lit("-_"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("episode"))


def default_episode_id(stage: Column, outcome: Column, ts: Column) -> Column:
    return episode_id(F.concat_ws("-", stage, outcome, F.unix_millis(ts).cast("string")))


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False
