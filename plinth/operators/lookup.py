"""Entity lookups for a table of requests: names are resolved by ranked equi-joins, misses stay as rows with found = false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of inputs (inclusive) and the default number of recommendations.
BOUNDS = {"k": (1, 20), "level": (0, None), "min_star": (1, 6), "max_star": (1, 6), "top_n": (1, 30)}
TOP_N = 8


def resolve_entity(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """requests with page: an exact page, else of pages with that display the base form, else the shortest. requests: req_id, name; pages: page, display."""
    asked = requests.withColumn("_q", F.trim("name"))
    alias = pages.select(F.col("page").alias("alias"), F.lit(0).alias("tier"), "page").unionByName(pages.select(F.col("display").alias("alias"), F.when(F.col("page") == F.col("display"), 1).otherwise(2).alias("tier"), "page"))
    best = alias.groupBy("alias").agg(F.min_by("page", F.struct("tier", F.length("page"), "page")).alias("page"))
    return asked.join(best, F.col("_q") == F.col("alias"), "left").drop("_q", "alias").withColumn("found", F.col("page").isNotNull())


def resolve_stage(requests: DataFrame, stages: DataFrame) -> DataFrame:
    """requests with code: an exact code (of repeats the last by ord), else an equal title, else the first title that starts with the text and a blank, which is
    a join on the title's first word. requests: req_id, name; stages: ord, code, title."""
    # A stage's keys are shuffled once, for one join: its code, its title and, for "starts with the text and a blank", every prefix of the title that ends before a blank.
    split = F.split("title", " ")
    heads = F.filter(F.transform(F.sequence(F.lit(1), F.size(split)), lambda i: F.array_join(F.slice(split, 1, i), " ")), lambda k: k != F.col("title"))
    key = lambda k, tier: F.struct(k.alias("k"), F.lit(tier).alias("tier"))
    heads = F.coalesce(F.transform(heads, lambda k: key(k, 2)), F.array().cast("array<struct<k:string,tier:int>>"))
    names = stages.select("ord", "code", "title", F.explode(F.concat(F.array(key(F.col("code"), 0), key(F.col("title"), 1)), heads)).alias("a")).filter("a.k is not null")
    of = lambda tier, pick: pick(F.when(F.col("a.tier") == tier, F.struct("code", "title")), F.when(F.col("a.tier") == tier, F.col("ord")))
    best = names.groupBy(F.col("a.k").alias("k")).agg(F.coalesce(of(0, F.max_by), of(1, F.min_by), of(2, F.min_by)).alias("hit"))
    out = requests.withColumn("_q", F.trim("name")).join(best, F.col("_q") == F.col("k"), "left")
    return out.select(*requests.columns, F.col("hit.code").alias("code"), F.col("hit.title").alias("title"), F.col("hit").isNotNull().alias("found"))


def operator_records(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """req_id, page, found, class, tags (array), skills. pages: page, display, class, tag, skills."""
    hit = resolve_entity(requests, pages).select("req_id", "page", "found")
    return hit.join(pages.select("page", "class", F.filter(F.split("tag", r"\s+"), lambda t: t != "").alias("tags"), "skills"), "page", "left").withColumn("evidence", F.lit("fact"))


def skill_lookup(requests: DataFrame, skills: DataFrame) -> DataFrame:
    """req_id, skill, found, message: the exact name, else the first skill whose name holds the text or is held by it; a miss lists the names. requests: req_id, page, skill_name;
    skills: page, ord, skill."""
    asked = requests.select("req_id", "page", F.trim("skill_name").alias("q"))
    # Each different text of a page is looked for once, however many requests have it; an exact name is an equi-join, and only the others meet the page's names.
    texts = asked.filter("page is not null and q is not null").select("page", "q").distinct()
    best = F.min(F.struct(F.col("r"), F.col("ord"), F.col("skill"))).alias("hit")
    exact = texts.join(skills.withColumnRenamed("skill", "q"), ["page", "q"]).select("page", "q", F.lit(0).alias("r"), "ord", F.col("q").alias("skill")).groupBy("page", "q").agg(best)
    others = texts.join(exact, ["page", "q"], "left_anti").join(skills, "page").filter(F.contains("skill", F.col("q")) | F.contains("q", F.col("skill")))
    hits = exact.unionByName(others.withColumn("r", F.lit(1)).groupBy("page", "q").agg(best))
    found = asked.join(hits, ["page", "q"], "left").groupBy("req_id", "page").agg(F.min("hit").alias("hit")).select("req_id", "page", "hit.skill")
    # A page's names are put together once, not for each request.
    names = skills.filter("skill is not null").groupBy(F.col("page").alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "skill"))), lambda x: x.skill), "、").alias("names"))
    told = found.join(names, (F.col("page") == F.col("of")) & F.col("skill").isNull(), "left")
    return told.select("req_id", "skill", F.col("skill").isNotNull().alias("found"), F.when(F.col("skill").isNull(), F.concat(F.lit("available: "), F.coalesce("names", F.lit("")))).otherwise("").alias("message"), F.lit("fact").alias("evidence"))


def enemy_lookup(requests: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """req_id, page, level, attrs (filled ones of keys), found, message. requests: req_id, name, level (null: all); pages: page, display, levels array<struct<level,
    data map>>."""
    hit = resolve_entity(requests, pages.select("page", "display")).join(pages.select("page", "levels"), "page", "left")
    fit = F.filter("levels", lambda v: F.col("level").isNull() | (v.level == F.col("level")))
    rows = hit.select("req_id", "page", F.col("level").alias("asked"), "levels", F.explode_outer(fit).alias("v"))
    attrs = F.map_filter("v.data", lambda k, x: k.isin(keys) & (F.coalesce(x, F.lit("")) != ""))
    listed = F.array_join(F.transform("levels", lambda v: v.level.cast("string")), "、")
    return rows.select("req_id", "page", F.col("v.level").alias("level"), attrs.alias("attrs"), F.col("v").isNotNull().alias("found"), F.when(F.col("v").isNull() & F.col("levels").isNotNull(), F.concat(F.lit("levels: "), listed)).otherwise("").alias("message"), F.lit("fact").alias("evidence"))


def stage_lookup(requests: DataFrame, stages: DataFrame, renames: dict[str, str], stats: list[str]) -> DataFrame:
    """req_id, code, info (renamed filled entries), enemies (their filled stats), found. stages: ord, code, title, normal map, enemies array<map>."""
    # Only what is shown of a stage is shuffled.
    filled = F.map_filter("normal", lambda k, v: k.isin(list(renames)) & (F.coalesce(v, F.lit("")) != ""))
    names = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    foes = F.transform("enemies", lambda m: F.map_filter(m, lambda k, v: k.isin(stats) & (F.coalesce(v, F.lit("")) != "")))
    shown = stages.select("code", "ord", F.transform_keys(filled, lambda k, v: F.element_at(names, k)).alias("info"), foes.alias("enemies"))
    hit = resolve_stage(requests, stages.select("ord", "code", "title")).join(shown.groupBy("code").agg(F.max_by(F.struct("info", "enemies"), "ord").alias("s")), "code", "left")
    return hit.select("req_id", "code", "s.info", "s.enemies", "found", F.lit("fact").alias("evidence"))


def fits() -> Column:
    """Whether a row's operator, class and star keep within its classes, min_star, max_star and exclude."""
    star = F.nullif("star", F.lit(-1))
    return (
        (F.coalesce(F.size("classes"), F.lit(0)) <= 0) | F.array_contains("classes", F.col("class"))
    ) & (F.col("min_star").isNull() | F.coalesce(star >= F.col("min_star"), F.lit(False))) & (F.col("max_star").isNull() | F.coalesce(star <= F.col("max_star"), F.lit(False))) & ~F.coalesce(F.array_contains("exclude", F.col("operator")), F.lit(False))


def recommend(ranked: DataFrame, constraints: DataFrame) -> DataFrame:
    """req_id, stage, operator, score, rank: recommended operators of a request's stage within its constraints, in their order. An unknown star fails a star bound. ranked: stage,
    operator, class, star, score, rank (see operators_for_stage); constraints: req_id, stage, classes, min_star, max_star, top_n, exclude."""
    both = constraints.join(ranked, "stage")
    w = Window.partitionBy("req_id").orderBy("rank")
    return both.filter(fits()).withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= F.coalesce("top_n", F.lit(TOP_N))).select("req_id", "stage", "operator", "score", F.col("pos").alias("rank"), F.lit("inferred").alias("evidence"))


def out_of_bounds(requests: DataFrame, bounds: dict = BOUNDS) -> DataFrame:
    """requests with problems: the columns whose values are outside their bounds (empty: valid)."""
    tags = [F.when((F.col(c) < low) if high is None else ~F.col(c).between(low, high), F.lit(c)) for c, (low, high) in bounds.items() if c in requests.columns]
    return requests.withColumn("problems", F.array_compact(F.array(*tags)) if tags else F.array().cast("array<string>"))


def _cut(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def _ordered(column: str, order) -> Column:
    return F.transform(column, lambda x, i: F.struct(order(x).cast("long").alias("o"), i.alias("i"), x["name"].alias("n")))


def context_bundle(states: DataFrame, guide_hits: DataFrame, stage_enemies: DataFrame, ranked: DataFrame, enemy_facts: DataFrame, operator_facts: DataFrame, guides: int = 3, recommended: int = 5, enemies: int = 3, operators: int = 3) -> DataFrame:
    """state_id, text, citations (ordered struct ord, kind, name, evidence), by state: guide hits, the stage's enemies, recommended operators, the most seen enemies and the cheapest
    operators at hand. A state without a stage has no stage parts; nothing found gives empty ones. states: state_id, stage_id, enemies array<struct<name, observed_count>>, cards
    array<struct<name, cost>>; guide_hits: state_id, content, rank; stage_enemies: stage, enemy; ranked: see operators_for_stage; facts: name, text."""
    line = lambda kind, ord, name, text, evidence: F.struct(F.lit(kind).alias("part"), ord.cast("long").alias("ord"), name.alias("name"), text.alias("text"), F.lit(evidence).alias("evidence"))
    on_stage = states.filter(F.trim(F.coalesce("stage_id", F.lit(""))) != "").select("state_id", F.trim("stage_id").alias("stage"))
    parts = [guide_hits.filter(F.col("rank") < guides).select("state_id", line(0, F.col("rank"), F.lit("guide"), F.when(F.col("rank") == 0, _cut(F.col("content"), 120)).otherwise(_cut(F.col("content"), 80)), "retrieved").alias("l"))]
    named = on_stage.join(stage_enemies.groupBy("stage").agg(F.array_join(F.array_sort(F.collect_set("enemy")), "、").alias("t")), "stage")
    parts.append(named.select("state_id", line(1, F.lit(0), F.col("stage"), F.col("t"), "fact").alias("l")))
    top = on_stage.join(ranked.filter(F.col("rank") <= recommended), "stage")
    parts.append(top.select("state_id", line(2, F.col("rank"), F.col("operator"), F.format_string("%s %.2f", "operator", "score"), "inferred").alias("l")))
    for part, column, order, most, facts in ((3, "enemies", lambda x: -F.coalesce(x.observed_count, F.lit(0)), enemies, enemy_facts), (4, "cards", lambda x: F.coalesce(x.cost, F.lit(10**6)), operators, operator_facts)):
        # The few entries of a state are ordered inside its row.
        first = states.select("state_id", F.posexplode(F.slice(F.array_sort(_ordered(column, order)), 1, most)).alias("ord", "x")).select("state_id", "ord", F.col("x.n").alias("name"))
        parts.append(first.join(facts.select("name", "text"), "name").select("state_id", line(part, F.col("ord"), F.col("name"), _cut(F.col("text"), 120), "fact").alias("l")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    bundle = whole.groupBy("state_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    out = states.select("state_id").join(bundle, "state_id", "left")
    ls = F.coalesce("ls", F.array().cast(bundle.schema["ls"].dataType))
    return out.select("state_id", F.array_join(F.transform(ls, lambda x: x.text), "\n").alias("text"), F.transform(ls, lambda x: F.concat_ws("|", x.part.cast("string"), x["name"], x.evidence)).alias("citations"))
