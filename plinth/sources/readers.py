"""Readers with explicit policies for missing folders and corrupt records. Schemas are given, so nothing is read twice to infer them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.shared import kept

EPISODE_ID = r"^[A-Za-z0-9_-]{1,128}$"
_CORRUPT = "_corrupt_record"


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _read(spark: SparkSession, path: str, schema: T.StructType, missing: str, **options) -> DataFrame:
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except AnalysisException:
        if missing == "error":
            raise
        return spark.createDataFrame([], schema)


def _stem() -> Column:
    """The file's name without its folder and ending, decoded."""
    return F.url_decode(F.replace(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.jsonl?$", 1), F.lit("+"), F.lit("%2B")))


def entities(spark: SparkSession, path: str, schema, missing: str = "empty") -> DataFrame:
    """One JSON document a file, with `stem` as identity. A corrupt file fails the read; a missing folder is an empty table or, with missing='error', an error."""
    s = _schema(schema)
    df = _read(spark, path, s, missing, multiLine=True, mode="FAILFAST")
    return df.select(_stem().alias("stem"), "*") if "_metadata" in _meta(df) else df.select(F.lit(None).cast("string").alias("stem"), "*")


def _meta(df: DataFrame) -> list[str]:
    try:
        df.select("_metadata.file_name")
        return ["_metadata"]
    except AnalysisException:
        return []


def entities_lenient(spark: SparkSession, path: str, schema, missing: str = "empty") -> tuple[DataFrame, DataFrame]:
    """As entities, but corrupt files are set apart: (good, bad), bad with stem and the raw text. The parsed rows are cached, as both sides come from one read."""
    s = _schema(schema).add(_CORRUPT, T.StringType())
    df = _read(spark, path, s, missing, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    df = (df.select(_stem().alias("stem"), "*") if _meta(df) else df.select(F.lit(None).cast("string").alias("stem"), "*")).cache()
    return df.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT), df.filter(F.col(_CORRUPT).isNotNull()).select("stem", F.col(_CORRUPT).alias("raw"))


def entity_files(spark: SparkSession, path: str) -> DataFrame:
    """folder, name, json of the files that writers.write_entity_files wrote. Only the folders' names come to the driver: a folder is listed in a task, and its files are
    dealt over all tasks, which open them themselves. So there is no plan with an entry for each file."""
    from pyarrow import fs

    from plinth.sources.entity_files import files_at, lister, reader

    files, root = files_at(path)
    there = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    folders = spark.createDataFrame([(x.base_name,) for x in there if x.type == fs.FileType.Directory and not x.base_name.startswith("_staging-")], "folder string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = folders.repartition(max(1, min(n, len(there)))).mapInArrow(lister(path), "folder string, name string")
    return names.repartition(n, "folder", "name").mapInArrow(reader(path), "folder string, name string, json string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and line (from 1) of each line of text files, however many splits a file is read in.

    Each split tells where it begins, and numbers rise along a partition. So one pass writes lines with both, splits are counted, and a line's number
    is that of the lines in earlier splits of its file (a short sum for each file) and its own in its split."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    raw = kept(raw, "lines")
    return _with_lines(raw, raw).select("value", "file", "line")


def _with_lines(rows: DataFrame, per_split: DataFrame) -> DataFrame:
    """rows (at, start, id) with line. per_split: at, start, id of all lines."""
    splits = per_split.groupBy(F.col("at").alias("s_at"), F.col("start").alias("s_start")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s_at").orderBy("s_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("s_at", "s_start", (before - F.col("first") + 1).alias("shift"))
    return rows.join(splits, (F.col("at") == F.col("s_at")) & (F.col("start") == F.col("s_start"))).withColumn("line", F.col("id") + F.col("shift"))


def _judged(lines: DataFrame, schema: T.StructType, required: list[str] | None) -> DataFrame:
    """lines (value, ...) with r, the parsed row, and bad; blank lines are left out."""
    lines = lines.filter(F.trim("value") != "")
    parsed = lines.select("*", F.from_json("value", T.StructType(schema.fields + [T.StructField(_CORRUPT, T.StringType())]), {"columnNameOfCorruptRecord": _CORRUPT}).alias("r"))
    bad = F.col(f"r.{_CORRUPT}").isNotNull() | F.col("r").isNull()
    for k in required or []:
        bad = bad | F.col(f"r.`{k}`").isNull()
    return parsed.withColumn("bad", bad)


def bad_lines(spark: SparkSession, path: str, schema, required: list[str] | None = None) -> DataFrame:
    """file, line and value of each bad line of JSON line files."""
    return _judged(numbered_lines(spark, path), _schema(schema), required).filter("bad").select("file", "line", "value")


def jsonl(spark: SparkSession, path: str, schema, on_bad: str = "skip", required: list[str] | None = None) -> DataFrame:
    """JSON lines; blank lines don't count. A line is bad if it isn't an object or lacks a required key. on_bad: 'skip' leaves bad lines out (bad_lines tells them), 'keep'
    marks them (bad = true) and gives each line its number, 'raise' fails at once with the file and number of the first bad line."""
    s = _schema(schema)
    if on_bad == "raise":
        first = bad_lines(spark, path, s, required).orderBy("file", "line").limit(1).collect()
        if first:
            raise ValueError(f"bad line {first[0].line} in {first[0].file}: {first[0].value[:80]}")
    if on_bad == "keep":
        return _judged(numbered_lines(spark, path), s, required).select("r.*", "file", "line", "bad").drop(_CORRUPT)
    return _judged(spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")), s, required).filter("not bad").select("r.*", "file").drop(_CORRUPT)


def paged_items(spark: SparkSession, path: str, item: str, content: str) -> DataFrame:
    """Items of page files {data: [...]}, each with a JSON text `content`, as item's columns and a struct `content`; corrupt pages and items are left out."""
    s = _schema(f"data array<struct<{item}, content: string>>").add(_CORRUPT, T.StringType())
    pages = spark.read.schema(s).options(multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT).json(path).cache().filter(F.col(_CORRUPT).isNull())
    rows = pages.select(F.explode("data").alias("i")).select("i.*")
    inner = _schema(content).add(_CORRUPT, T.StringType())
    parsed = rows.withColumn("content", F.from_json("content", inner, {"columnNameOfCorruptRecord": _CORRUPT}))
    return parsed.filter(F.col("content").isNotNull() & F.col(f"content.{_CORRUPT}").isNull()).withColumn("content", F.col("content").dropFields(_CORRUPT))


def merged(parts: dict[str, DataFrame]) -> DataFrame:
    """Partitions of one entity type, with the column `part`; columns that a part lacks are null."""
    whole = None
    for name, df in parts.items():
        df = df.withColumn("part", F.lit(name))
        whole = df if whole is None else whole.unionByName(df, allowMissingColumns=True)
    return whole


def episodes(spark: SparkSession, path: str, schema) -> DataFrame:
    """Episode logs whose id (the file's stem) is well formed. A corrupt file fails the read."""
    df = spark.read.schema(_schema(schema)).options(multiLine=True, mode="FAILFAST").json(path)
    return df.select(_stem().alias("episode_id"), "*").filter(F.col("episode_id").rlike(EPISODE_ID))


def tier_list(spark: SparkSession, path: str) -> DataFrame:
    """name, tier, score, source of a JSON map; a missing file is an empty table, a file that holds no map an error."""
    kind = "map<string, struct<tier: string, score: double, source: string>>"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], "name string, tier string, score double, source string")
    parsed = F.from_json("value", kind)
    whole = F.when(F.trim("value").rlike(r"(?s)^\{.*\}$") & parsed.isNotNull(), parsed).otherwise(F.raise_error(F.lit("the tier list is not a map")).cast(kind))
    return text.select(F.explode(whole).alias("name", "t")).select("name", "t.*")


def annotated_timeline(spark: SparkSession, config: dict[str, list[dict]]) -> DataFrame:
    """stage_id, ord, time_sec, enemy, count from a configuration: a few rows."""
    rows = [(s, i, float(e["time_sec"]), e["enemy"], int(e.get("count", 1))) for s, es in config.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "stage_id string, ord int, time_sec double, enemy string, count int")


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """title, html of cached pages, one a file."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.html?)?$", 1).alias("title"), F.col("value").alias("html"))


def stems(spark: SparkSession, path: str) -> DataFrame:
    """Distinct stems of a folder's files: a whitelist. Only names are read."""
    return spark.read.format("binaryFile").load(path).select(F.url_decode(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)).alias("name")).distinct()


def split_valid(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid with reason: the first check, in order, that holds)."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()])
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def job_checks() -> dict[str, Column]:
    """For jobs: stage_name, details.actions."""
    return {"no stage": F.trim(F.coalesce("stage_name", F.lit(""))) == "", "no actions": F.coalesce(F.size("details.actions"), F.lit(0)) <= 0}


def preference_checks() -> dict[str, Column]:
    """For pairs: prompt, chosen, rejected."""
    blank = [F.trim(F.coalesce(c, F.lit(""))) == "" for c in ("prompt", "chosen", "rejected")]
    return {"blank": blank[0] | blank[1] | blank[2], "equal": F.trim("chosen") == F.trim("rejected")}
