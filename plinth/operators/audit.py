"""Corpus audits: what entity pages lack, as counts and lists, and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _empty(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def issues(pages: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """key, issue for each check (a condition) that a page meets."""
    tags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return pages.select(F.col(key).alias("key"), F.explode(tags).alias("issue"))


def operator_checks() -> dict[str, Column]:
    """For pages: source, name, meta struct, skills array<struct<name>>, trait map."""
    return {
        "invalid": F.col("source").isNull(), "no_name": _empty(F.col("name")), "no_meta": F.col("meta").isNull(), "no_skills": F.coalesce(F.size("skills"), F.lit(0)) <= 0,
        "skill_without_name": F.exists("skills", lambda k: F.coalesce(k["name"], F.lit("")) == ""), "no_trait": F.coalesce(F.size(F.map_keys("trait")), F.lit(0)) <= 0, "title_differs": F.col("source") != F.col("name"),
    }


def enemy_checks() -> dict[str, Column]:
    """For pages: source, levels array<struct<level, data map>>."""
    return {
        "no_levels": F.coalesce(F.size("levels"), F.lit(0)) <= 0, "level_without_data": F.exists("levels", lambda v: F.coalesce(F.size(F.map_keys(v["data"])), F.lit(0)) <= 0),
        "level_without_name": F.exists("levels", lambda v: F.coalesce(F.try_element_at(v["data"], F.lit("名称")), F.lit("")) == ""),
    }


def stage_checks() -> dict[str, Column]:
    """For pages: source, code, enemies array<map>."""
    return {"no_code": _empty(F.col("code")), "no_enemies": F.coalesce(F.size("enemies"), F.lit(0)) <= 0, "enemy_without_name": F.exists("enemies", lambda m: F.coalesce(F.try_element_at(m, F.lit("名称")), F.lit("")) == "")}


def issue_counts(found: DataFrame, examples: int = 5) -> DataFrame:
    """issue, n and the first few keys (a report's bound; ranked in the shuffle, not gathered)."""
    from pyspark.sql import Window

    n = found.groupBy("issue").agg(F.count("*").alias("n"))
    w = Window.partitionBy("issue").orderBy("key")
    some = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= examples).groupBy("issue").agg(F.array_join(F.array_sort(F.collect_list(F.col("key").cast("string"))), ",").alias("examples"))
    return n.join(some, "issue")


def distribution(pages: DataFrame, value: Column, name: str) -> DataFrame:
    return pages.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def share(pages: DataFrame, condition: Column, name: str) -> DataFrame:
    """One row: the share of pages that meet the condition, to 4 places."""
    return pages.agg(F.round(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), 4).alias(name))


def top_prefixes(pages: DataFrame, code: str = "code", k: int = 12) -> DataFrame:
    """The k most frequent parts of a code before its dash."""
    return pages.groupBy(F.split_part(F.col(code), F.lit("-"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "prefix").limit(k)


def summarise(reports: dict[str, DataFrame]) -> DataFrame:
    """kind, issues over all reports of issue_counts, with a total (kind null)."""
    whole = None
    for kind, r in reports.items():
        part = r.select(F.lit(kind).alias("kind"), "n")
        whole = part if whole is None else whole.unionByName(part)
    return whole.rollup("kind").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("issues"))
