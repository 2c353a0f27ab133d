"""Places in one order over all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.shared import kept

#: Rows of one range, and ranges at most.
RANGE, RANGES = 200_000, 512


def placed(rows: DataFrame, *keys: Column, name: str = "place") -> DataFrame:
    """rows with their place (from 1) in the ascending order of keys, which should tell rows apart.

    A sample gives bounds, which balance the ranges and can't change a place: each row counts the bounds up to it, ranges are numbered
    inside, and each range starts after the rows of those before it."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns])  # no column of the rows can clash with ours
    keyed = rows.select(row.alias("row"), F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"))
    n = rows.count()
    ranges = min(RANGES, -(-n // RANGE))
    bounds = []
    if ranges > 1:
        drawn = [r.key for r in keyed.select("key").sample(min(1.0, 50 * ranges / n), seed=7).orderBy("key").limit(100 * RANGES).collect()]
        bounds = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []
    kind = keyed.schema["key"].dataType
    at = F.lit(0)
    if bounds:
        limits = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind.fields)]) for b in bounds])
        at = F.size(F.filter(limits, lambda b: b <= F.col("key")))
    ranged = keyed.withColumn("range", at).withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("key")))
    sizes = {r.range: r["count"] for r in keyed.withColumn("range", at).groupBy("range").count().collect()} if bounds else {}  # RANGES rows at most
    before, total = [], 0
    for i in range(len(bounds) + 1):
        before.append(total)
        total += sizes.get(i, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("range"))
    return ranged.select("row.*", (start + F.col("at")).alias(name))


def running(rows: DataFrame, place: str, value: Column, name: str = "running") -> DataFrame:
    """rows with the sum of value up to and with each place (a whole number): sums of ranges of places first, then inside each."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns])
    r = rows.select(row.alias("row"), F.floor(F.col(f"`{place}`") / RANGE).alias("range"), value.alias("v"))
    sums = r.groupBy(F.col("range").alias("of")).agg(F.sum("v").alias("s"))
    ahead = sums.select("of", F.coalesce(F.sum("s").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # a row for each RANGE rows
    inside = F.sum("v").over(Window.partitionBy("range").orderBy(F.col("row").getField(place)).rowsBetween(Window.unboundedPreceding, 0))
    return r.withColumn("inside", inside).join(ahead, F.col("range") == F.col("of")).select("row.*", (F.col("ahead") + F.col("inside")).alias(name))


def exact_quantiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """groups with a column for each of shares (name: 0 to 1): the value at that share of the group's order, between two neighbours in proportion, as `percentile` gives
    it, and n, the values that count (nulls don't). Places come from ranges of the whole order, so a group of any size needs a few rows of buffer: those at the places
    asked for. rows' groups may be null."""
    some = rows.filter(F.col(f"`{value}`").isNotNull()).select(*groups, F.col(f"`{value}`").cast("double").alias("value"), F.monotonically_increasing_id().alias("tie"))
    order = placed(kept(some, "values"), *[F.col(f"`{g}`") for g in groups], F.col("value"), F.col("tie"), name="place")
    order = kept(order.select(F.struct(*groups).alias("group"), "value", "place"), "places")
    sizes = order.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    asked = sizes.select("group", "first", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("at")) for k, p in shares.items()])).alias("q"))
    low = F.floor("q.at")
    wanted = asked.select("group", "n", "q.name", "q.at", F.explode(F.array_distinct(F.array(low, F.ceil("q.at")))).alias("k"), "first").withColumn("wanted", F.col("first") + F.col("k"))
    # A value counts by how near its place is to the one asked for.
    met = wanted.join(order.select("place", "value"), F.col("wanted") == F.col("place"))
    parts = met.groupBy("group", "n", "name").agg(F.sum(F.col("value") * (1 - F.abs(F.col("at") - F.col("k")))).alias("v"))
    return parts.groupBy("group", "n").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in shares]).select("group.*", "n", *shares)
