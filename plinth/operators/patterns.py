"""Statistics of action patterns over an example table: action, operator, kills, location, direction, stage, question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """key, n, pct (2 places) of filled values. The total is a window over the few distinct values."""
    counts = rows.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(F.col(key).alias(name or key)).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))


def top_counts(rows: DataFrame, keys: list, k: int) -> DataFrame:
    """The k most frequent keys with n; ties go by key."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), *[c for c in counts.columns if c != "n"]).limit(k)


def listed(rows: DataFrame, names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """rows whose key is among names (one column), and the others. Rows without a key are in neither."""
    have = rows.filter(F.col(key).isNotNull())
    other = names.toDF("_listed").distinct()
    cond = F.col(key) == F.col("_listed")
    return have.join(other, cond, "left_semi"), have.join(other, cond, "left_anti")


def appearances(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg(F.count_distinct(key).alias("n_distinct"))


def bucket(value: Column, width: int) -> Column:
    """The lower end of value's bucket; negative values go down too."""
    return (F.floor(value / width) * width).cast("long")


def by_bucket(rows: DataFrame, value: str, key: str, width: int = 5) -> DataFrame:
    return rows.groupBy(bucket(F.col(value), width).alias("bucket"), key).agg(F.count("*").alias("n"))


def heat_map(rows: DataFrame, location: str = "location", k: int = 30) -> DataFrame:
    """The k most used places; locations of other than two elements are left out."""
    return top_counts(rows.filter(F.size(location) == 2), [F.get(location, F.lit(0)).alias("x"), F.get(location, F.lit(1)).alias("y")], k)


def set_sizes(rows: DataFrame, group: str, member: str) -> DataFrame:
    """size, n: how many groups have so many distinct members. Distinct pairs first, so a hot group is one partial row for each member and task."""
    pairs = rows.select(group, member).distinct()
    return pairs.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def bracketed(text: Column) -> Column:
    """What stands between full-width brackets, up to a slash."""
    return F.nullif(F.regexp_extract(text, "（([^/）]*)[/）]", 1), F.lit(""))


def summary(rows: DataFrame) -> DataFrame:
    """One row: rows, stages, operators, actions."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("stage").alias("n_stages"), F.count_distinct("operator").alias("n_operators"), F.count_distinct("action").alias("n_actions"))
