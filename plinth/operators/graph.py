"""A property graph of operators, skills, enemies and stages as two tables, and its queries.

nodes: node_id, kind, name, class, star, defense, resistance, speed, position, code, title.
edges: src, dst, key, relation, evidence and the relation's attributes. Parallel edges differ in key. All queries are one or two hops, so they are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import lenient_double

#: Classes and words of skill texts that make a signal.
CASTER_CLASS, PHYSICAL_CLASSES = "术师", ["狙击", "近卫"]
ARTS_WORDS, CONTROL_WORDS = ["法术伤害", "无视防御", "真实伤害"], ["减速", "束缚", "眩晕", "停顿", "冻结"]
FAST_WORD = "高速"
#: Rules as data: each matcher is (rule, priority, signal, basis, weight); the first signal that an operator has decides.
MATCHERS = [
    ("R1_high_defense_to_arts", 0, "is_caster", "class", 1.0),
    ("R1_high_defense_to_arts", 1, "has_arts_or_true", "skill_keyword", 0.6),
    ("R2_high_resistance_to_physical", 0, "is_physical_dps", "class", 1.0),
    ("R3_fast_enemy_to_control", 0, "has_control", "skill_keyword", 0.6),
]
SIGNALS = ["is_caster", "is_physical_dps", "has_arts_or_true", "has_control"]
THRESHOLDS = {"defense": 800.0, "resistance": 50.0, "speed": 2.0}
#: Parts of the hashes of nodes, and the rows of a part beyond which its nodes are taken for hubs.
HASH_PARTS, HUB = 1 << 16, 200_000


def _holds(text: Column, found: list[str]) -> Column:
    return F.coalesce(text.rlike("|".join(found)), F.lit(False))


def operator_signals(pages: DataFrame) -> DataFrame:
    """name, class, branch, star, tags, skill_text and the four signals. pages: source, meta struct, skills array."""
    texts = F.flatten(F.transform(F.coalesce("skills", F.array().cast(pages.schema["skills"].dataType)), lambda k: F.concat(F.array(F.coalesce(k.type, F.lit(""))), F.filter(F.transform(k.levels, lambda v: v["desc"]), lambda d: F.coalesce(d, F.lit("")) != ""))))
    blob = F.array_join(texts, " ")
    kind = F.coalesce(F.col("meta.class"), F.lit(""))
    base = pages.select(F.col("source").alias("name"), kind.alias("class"), F.coalesce(F.col("meta.branch"), F.lit("")).alias("branch"), F.col("meta.star_rating").alias("star"), F.coalesce(F.col("meta.tag"), F.lit("")).alias("tags"), blob.alias("skill_text"))
    return base.select("*", (F.col("class") == CASTER_CLASS).alias("is_caster"), F.col("class").isin(PHYSICAL_CLASSES).alias("is_physical_dps"), _holds(F.col("skill_text"), ARTS_WORDS).alias("has_arts_or_true"), _holds(F.col("skill_text"), CONTROL_WORDS).alias("has_control"))


def enemy_records(pages: DataFrame) -> DataFrame:
    """page, display, defense, resistance, speed, hp, position, desc, traits of the last level. pages: source, name, levels array<struct<level, data, traits>>."""
    last = F.try_element_at("levels", F.lit(-1))
    at = lambda k: F.try_element_at(last.data, F.lit(k))
    return pages.select(F.col("source").alias("page"), F.coalesce(at("名称"), F.col("name"), F.col("source")).alias("display"), lenient_double(at("防御力")).alias("defense"), lenient_double(at("法术抗性")).alias("resistance"), lenient_double(at("移动速度")).alias("speed"), lenient_double(at("最大生命值")).alias("hp"), F.coalesce(at("地位"), F.lit("")).alias("position"), at("描述").alias("desc"), F.array_join(last.traits, "、").alias("traits"))


def light_records(stage_rows: DataFrame, known: DataFrame) -> DataFrame:
    """Records of enemies that only stage rows know; the first row seen stands, with all that it says. stage_rows: ord, enemy, defense, resistance and, where the rows
    have them, speed, hp, position; known: page."""
    there = lambda c: F.col(c) if c in stage_rows.columns else F.lit(None).cast("string")
    numbers = [lenient_double(there(c)).alias(c) for c in ("defense", "resistance", "speed", "hp")]
    first = F.min_by(F.struct(*numbers, F.coalesce(there("position"), F.lit("")).alias("position")), "ord").alias("r")
    missing = stage_rows.join(known.select(F.col("page").alias("enemy")), "enemy", "left_anti").groupBy("enemy").agg(first)
    return missing.select(F.col("enemy").alias("page"), F.col("enemy").alias("display"), "r.defense", "r.resistance", "r.speed", "r.hp", "r.position", F.lit(None).cast("string").alias("desc"), F.lit("").alias("traits"))


def resolve_names(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """display, page: an exact page, else a page that is its own display, else the shortest page with that display, else the display itself.
    asked: display; pages: page, display, ord."""
    names = pages.select(F.col("page").alias("alias"), F.lit(0).alias("tier"), "page", "ord").unionByName(pages.select(F.col("display").alias("alias"), F.when(F.col("page") == F.col("display"), 1).otherwise(2).alias("tier"), "page", "ord"))
    best = names.filter("alias is not null").groupBy("alias").agg(F.min_by("page", F.struct("tier", F.length("page"), "ord")).alias("page"))
    return asked.select("display").distinct().join(best, F.col("display") == F.col("alias"), "left").select("display", F.coalesce("page", "display").alias("page"))


def enemy_rules(enemies: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """page, rule, reason for each rule that an enemy meets; a null reading meets none. Rules are entries of one array, so no join is needed."""
    t = THRESHOLDS | (thresholds or {})
    fast = F.coalesce(F.col("speed") >= t["speed"], F.lit(False)) | F.contains(F.concat(F.coalesce("desc", F.lit("")), F.coalesce("traits", F.lit(""))), F.lit(FAST_WORD))
    hit = lambda rule, cond, reason: F.when(cond, F.struct(F.lit(rule).alias("rule"), reason.alias("reason")))
    rules = F.array_compact(F.array(
        hit("R1_high_defense_to_arts", F.col("defense") >= t["defense"], F.concat(F.lit("defense "), F.col("defense").cast("string"), F.lit(f" >= {t['defense']}"))),
        hit("R2_high_resistance_to_physical", F.col("resistance") >= t["resistance"], F.concat(F.lit("resistance "), F.col("resistance").cast("string"), F.lit(f" >= {t['resistance']}"))),
        hit("R3_fast_enemy_to_control", fast, F.concat(F.lit("speed "), F.coalesce(F.col("speed").cast("string"), F.lit("unknown")))),
    ))
    return enemies.select("page", F.explode(rules).alias("r")).select("page", "r.rule", "r.reason")


def counters(rules: DataFrame, signals: DataFrame, matchers: list[tuple] = MATCHERS) -> DataFrame:
    """page, rule, name, basis, weight, reason: every enemy of a rule with every operator that answers it. There are only a few rules, so the enemies are spread over all
    tasks first."""
    from plinth.operators import classes

    return classes.spread(rules, "page").join(classes.small(operator_answers(signals, matchers)), "rule").select("page", "rule", "name", "basis", "weight", "reason")


def operator_answers(signals: DataFrame, matchers: list[tuple] = MATCHERS) -> DataFrame:
    """name, rule, basis, weight: the first matcher of the rule whose signal the operator has. The theta join is an equi-join on the signal's name: operators are
    unpivoted to the signals they have."""
    spark = signals.sparkSession
    table = F.broadcast(spark.createDataFrame(matchers, "rule string, prio int, signal string, basis string, weight double"))  # as many rows as matchers
    have = signals.select("name", F.explode(F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in SIGNALS]))).alias("signal"))
    return have.join(table, "signal").groupBy("name", "rule").agg(F.min_by(F.struct("basis", "weight"), "prio").alias("m")).select("name", "rule", "m.basis", "m.weight")


def contains_edges(stage_rows: DataFrame) -> DataFrame:
    """stage, enemy, count, level of a stage's enemies; of an enemy's repeated rows the first stands. stage_rows: stage, ord, enemy, count, level."""
    return stage_rows.groupBy("stage", "enemy").agg(F.min_by(F.struct(F.col("count").cast("string").alias("count"), F.col("level").cast("string").alias("level")), "ord").alias("r")).select("stage", "enemy", "r.count", "r.level")


def recommendations(contains: DataFrame, counter: DataFrame) -> DataFrame:
    """stage, name, score (sum over enemies of the largest weight, 2 places), support (enemies), matched_enemies and matched_rules. contains: stage, enemy
    (a page); counter: page, rule, name, weight.

    Operators that answer the same rules with the same weights have one profile (there are as many as combinations of signals), and enemies that
    meet the same rules one kind. Which rules match, and with what weight, depends on profile and kind alone; stages are summed up for each
    profile, and operators come in at the end: no enemy row of a stage ever meets an operator."""
    answers = counter.select("name", F.struct("rule", "weight").alias("a")).distinct().groupBy("name").agg(F.array_sort(F.collect_list("a")).alias("answers"))
    answers = answers.withColumn("profile", F.xxhash64("answers"))
    profiles = answers.groupBy("profile").agg(F.first("answers").alias("answers"))
    kinds = counter.select("page", "rule").distinct().groupBy("page").agg(F.array_sort(F.collect_list("rule")).alias("meets"))
    met = contains.select("stage", F.col("enemy").alias("page")).distinct().join(kinds, "page")
    # An enemy's rules that the profile answers: a small equi-join on the rule, then the best weight for each profile.
    by_kind = kinds.select("meets").distinct().select("meets", F.explode("meets").alias("rule")).join(profiles.select("profile", F.explode("answers").alias("a")).select("profile", "a.rule", "a.weight"), "rule")
    by_kind = by_kind.groupBy("meets", "profile").agg(F.max("weight").alias("w"), F.array_sort(F.collect_set("rule")).alias("rules"))
    per = met.join(by_kind, "meets").groupBy("stage", "profile").agg(F.round(F.sum("w"), 2).alias("score"), F.count("*").alias("support"), F.array_join(F.array_sort(F.collect_set("page")), "、").alias("matched_enemies"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("rules")))), "、").alias("matched_rules"))
    return per.join(answers.select("profile", "name"), "profile").select("stage", "name", "score", "support", "matched_enemies", "matched_rules")


def node_table(signals: DataFrame, skills: DataFrame, enemies: DataFrame, stages: DataFrame) -> DataFrame:
    """All nodes. Unknown numbers are -1 and unknown texts empty, as the graph shows them. skills: name (operator), skill; stages: code, title."""
    parts = [
        signals.select(F.concat(F.lit("operator:"), "name").alias("node_id"), F.lit("operator").alias("kind"), "name", "class", F.col("star").cast("int").alias("star"), F.col("position") if "position" in signals.columns else F.lit("").alias("position")),
        skills.select(F.concat(F.lit("skill:"), "name", F.lit(":"), "skill").alias("node_id"), F.lit("skill").alias("kind"), F.col("skill").alias("name")),
        enemies.select(F.concat(F.lit("enemy:"), "page").alias("node_id"), F.lit("enemy").alias("kind"), F.col("page").alias("name"), "defense", "resistance", "speed", *[c for c in ("hp", "position") if c in enemies.columns]),
        stages.select(F.concat(F.lit("stage:"), "code").alias("node_id"), F.lit("stage").alias("kind"), F.col("title").alias("name"), "code", "title"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    numbers, texts = ["star", "defense", "resistance", "speed"], ["class", "position", "code", "title"]
    whole = whole if "hp" in whole.columns else whole.withColumn("hp", F.lit(None).cast("double"))
    return whole.select("node_id", "kind", "name", *[F.coalesce(c, F.lit(-1)).alias(c) for c in [*numbers, "hp"]], *[F.coalesce(c, F.lit("")).alias(c) for c in texts])


def has_skill_edges(skills: DataFrame) -> DataFrame:
    return skills.filter("skill is not null").select(F.concat(F.lit("operator:"), "name").alias("src"), F.concat(F.lit("skill:"), "name", F.lit(":"), "skill").alias("dst"), F.lit("HAS_SKILL").alias("key"), F.lit("HAS_SKILL").alias("relation"), F.lit("fact").alias("evidence")).distinct()


def counter_edges(counter: DataFrame) -> DataFrame:
    return counter.select(F.concat(F.lit("operator:"), "name").alias("src"), F.concat(F.lit("enemy:"), "page").alias("dst"), F.col("rule").alias("key"), F.lit("COUNTERS").alias("relation"), F.lit("inferred").alias("evidence"), "rule", "weight", F.col("basis").alias("match_basis"), "reason")


def edge_table(skills: DataFrame, contains: DataFrame, counter: DataFrame, recommended: DataFrame) -> DataFrame:
    """All edges, once for each (src, dst, key)."""
    op, enemy, stage = (lambda c: F.concat(F.lit("operator:"), c)), (lambda c: F.concat(F.lit("enemy:"), c)), (lambda c: F.concat(F.lit("stage:"), c))
    has = has_skill_edges(skills)
    con = contains.select(stage(F.col("stage")).alias("src"), enemy(F.col("enemy")).alias("dst"), F.lit("CONTAINS_ENEMY").alias("key"), F.lit("CONTAINS_ENEMY").alias("relation"), F.lit("fact").alias("evidence"), "count", "level")
    cou = counter_edges(counter)
    rec = recommended.select(stage(F.col("stage")).alias("src"), op(F.col("name")).alias("dst"), F.lit("RECOMMENDS").alias("key"), F.lit("RECOMMENDS").alias("relation"), F.lit("inferred").alias("evidence"), "support", "score", "matched_enemies", "matched_rules")
    whole = has
    for p in (con, cou, rec):
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


def first_edges(edges: DataFrame, ord: str = "ord") -> DataFrame:
    """Of edges with equal (src, dst, key) the first by `ord`."""
    w = Window.partitionBy("src", "dst", "key").orderBy(ord)
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """what (node or edge), kind, n, with a total for each (kind null)."""
    both = nodes.select(F.lit("node").alias("what"), "kind").unionByName(edges.select(F.lit("edge").alias("what"), F.col("relation").alias("kind")))
    return both.groupBy("what", "kind").agg(F.count("*").alias("n")).unionByName(both.groupBy("what").agg(F.count("*").alias("n")).select("what", F.lit(None).cast("string").alias("kind"), "n"))


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str, relation: str | None = None, reverse: bool = False) -> DataFrame:
    """The edges out of a node (or into it) with the node at the other end; empty for an unknown node or relation."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    e = edges.filter(F.col(near) == node_id)
    e = e if relation is None else e.filter(F.col("relation") == relation)
    other = nodes.select("node_id", *[F.col(c).alias(f"node_{c}") for c in nodes.columns if c != "node_id"])
    return e.join(other, F.col(far) == F.col("node_id")).drop("node_id")


def skills_of_operator(nodes, edges, name):
    return neighbours(nodes, edges, f"operator:{name}", "HAS_SKILL").select(F.col("node_name").alias("skill"))


def enemies_in_stage(nodes, edges, code):
    return neighbours(nodes, edges, f"stage:{code}", "CONTAINS_ENEMY").select(F.col("node_name").alias("enemy"), "count", "level", F.col("node_defense").alias("defense"), F.col("node_resistance").alias("resistance"))


def operators_countering(nodes: DataFrame, edges: DataFrame, enemy: str) -> DataFrame:
    """Operators that counter an enemy, named by page or by the start of its page's title."""
    page = nodes.filter(F.col("kind") == "enemy").filter((F.col("name") == enemy) | F.startswith("name", F.lit(enemy + "("))).select("node_id", "name").orderBy((F.col("name") != enemy), F.length("name"), "name").limit(1)
    hit = edges.filter(F.col("relation") == "COUNTERS").join(page.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return hit.join(nodes.select(F.col("node_id").alias("src"), F.col("name").alias("operator"), "star"), "src").select("operator", "star", "rule", "match_basis", "weight", "reason")


def enemies_countered_by(nodes, edges, name):
    return neighbours(nodes, edges, f"operator:{name}", "COUNTERS").select(F.col("node_name").alias("enemy"), "rule", "match_basis", "weight")


def operators_for_stage(nodes: DataFrame, edges: DataFrame, code: str | None = None) -> DataFrame:
    """stage, operator, star, class, score, support, rank by (score, star, name); of one stage or all."""
    e = edges.filter(F.col("relation") == "RECOMMENDS")
    e = e if code is None else e.filter(F.col("src") == f"stage:{code}")
    ops = nodes.filter(F.col("kind") == "operator").select(F.col("node_id").alias("dst"), F.col("name").alias("operator"), "star", "class")
    w = Window.partitionBy("stage").orderBy(F.col("score").desc(), F.col("star").desc(), "operator")
    return e.join(ops, "dst").select(F.expr("substr(src, 7)").alias("stage"), "operator", "star", "class", "score", "support").withColumn("rank", F.row_number().over(w).cast("long"))


def counter_heavy(nodes: DataFrame, edges: DataFrame, threshold: float = THRESHOLDS["defense"], limit: int = 20) -> DataFrame:
    """Operators by their votes over all COUNTERS edges into enemies of at least that defence: score, enemies."""
    heavy = nodes.filter((F.col("kind") == "enemy") & (F.col("defense") >= threshold)).select(F.col("node_id").alias("dst"), F.col("name").alias("enemy"))
    votes = edges.filter(F.col("relation") == "COUNTERS").join(heavy, "dst").groupBy("src").agg(F.round(F.sum("weight"), 2).alias("score"), F.array_sort(F.collect_set("enemy")).alias("enemies"))
    ops = nodes.filter(F.col("kind") == "operator").select(F.col("node_id").alias("src"), F.col("name").alias("operator"), "star")
    return votes.join(ops, "src").select("operator", "star", "score", F.size("enemies").cast("long").alias("n_enemies"), F.array_join("enemies", "、").alias("enemies")).orderBy(F.col("score").desc(), F.col("star").desc(), "operator").limit(limit)


def node_detail(edges: DataFrame, cap: int = 200) -> DataFrame:
    """node_id, direction, neighbour, relation, key, pos, total, truncated: out edges, then in edges, `cap` of a node at most (a display's bound)."""
    return capped(both_ways(edges).withColumn("n", F.lit(1).cast("long")), cap)


def both_ways(edges: DataFrame) -> DataFrame:
    """node_id, dir (0 out, 1 in), neighbour, relation, key: each edge at both of its ends."""
    return edges.select(F.col("src").alias("node_id"), F.lit(0).alias("dir"), F.col("dst").alias("neighbour"), "relation", "key").unionByName(edges.select(F.col("dst").alias("node_id"), F.lit(1).alias("dir"), F.col("src").alias("neighbour"), "relation", "key"))


def capped(both: DataFrame, cap: int) -> DataFrame:
    """The first `cap` edges of each node, with its total, the sum of n. both: see both_ways, and n, the edges that a row counts for.

    A node's rows are shuffled and sorted once. Nodes whose part of the hashes has more than HUB rows are cut in the tasks that have their rows and counted there first, so
    no task gets all rows of a hub. Ids start alike, so a hash that is sorted first tells nodes apart at once."""
    both = both.select(F.xxhash64("node_id").alias("_h"), "node_id", "dir", "neighbour", "relation", "key", "n")
    part = F.pmod("_h", F.lit(HASH_PARTS))
    hubs = [r.part for r in both.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).filter(F.col("rows") > HUB).select("part").collect()]
    node = Window.partitionBy("_h", "node_id")
    pos = F.row_number().over(node.orderBy("dir", "relation", "neighbour", "key")).cast("long").alias("pos")
    shown = ["_h", "node_id", "dir", "neighbour", "relation", "key"]
    plain = both
    if hubs:
        hub = F.broadcast(both.sparkSession.createDataFrame([(x,) for x in hubs], "part long"))
        plain, many = (both.withColumn("part", part).join(hub, "part", how).drop("part") for how in ("left_anti", "left_semi"))
    found = plain.select(*shown, pos, F.sum("n").over(node).alias("total")).filter(F.col("pos") <= cap)
    if hubs:
        first = many.select(*shown, pos).filter(F.col("pos") <= cap)
        found = found.unionByName(first.join(many.groupBy("_h", "node_id").agg(F.sum("n").alias("total")), ["_h", "node_id"]))
    return found.select("node_id", F.when(F.col("dir") == 0, "out").otherwise("in").alias("direction"), "neighbour", "relation", "key", "pos", "total", (F.col("total") > cap).alias("truncated"))


def node_view(nodes: DataFrame, edges: DataFrame, cap: int = 200) -> DataFrame:
    """view_of with the edges' own detail."""
    return view_of(nodes, node_detail(edges, cap))


def view_of(nodes: DataFrame, detail: DataFrame) -> DataFrame:
    """node_id, attrs (JSON of what is known of the node), total, truncated and neighbours (struct pos, direction, relation, key, node_id, kind, name; as many as
    detail has) of every node, those without edges too. detail: see node_detail."""
    known = F.to_json(F.struct(*[F.when(~F.col(c).cast("string").isin("", "-1", "-1.0"), F.col(c)).alias(c) for c in nodes.columns if c != "node_id"]))
    brief = nodes.select(F.col("node_id").alias("neighbour"), "kind", "name")
    shown = detail.join(brief, "neighbour", "left")
    entry = F.struct("pos", "direction", "relation", "key", F.col("neighbour").alias("node_id"), "kind", "name")
    per = shown.groupBy("node_id").agg(F.max("total").alias("total"), F.max("truncated").alias("truncated"), F.array_sort(F.collect_list(entry)).alias("neighbours"))
    out = nodes.select("node_id", known.alias("attrs")).join(per, "node_id", "left")
    return out.select("node_id", "attrs", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("truncated", F.lit(False)).alias("truncated"), F.coalesce("neighbours", F.array().cast(per.schema["neighbours"].dataType)).alias("neighbours"))


def neighbours_of(start: DataFrame, edges: DataFrame, relation: str | None = None) -> DataFrame:
    """start (node_id) with dst and relation of their out edges. With an edge table that is bucketed by src (writers.write_graph_tables) only start is shuffled."""
    e = edges if relation is None else edges.filter(F.col("relation") == relation)
    return start.select("node_id").distinct().join(e, F.col("node_id") == F.col("src")).select("node_id", "dst", "relation", "key")


def stage_subgraph(edges: DataFrame, stages: DataFrame | None = None, cap: int = 50) -> DataFrame:
    """stage, dst, relation, pos, truncated: all enemies of each stage and its `cap` best recommended operators (by score, then name)."""
    e = edges.filter(F.col("relation").isin("CONTAINS_ENEMY", "RECOMMENDS")).select(F.col("src").alias("stage"), "dst", "relation", "score")
    e = e if stages is None else e.join(stages.select("stage"), "stage", "left_semi")
    w = Window.partitionBy("stage", "relation").orderBy(F.col("score").desc_nulls_last(), "dst")
    n = F.count("*").over(Window.partitionBy("stage", "relation"))
    return e.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("truncated", (F.col("relation") == "RECOMMENDS") & (n > cap)).filter((F.col("relation") != "RECOMMENDS") | (F.col("pos") <= cap)).select("stage", "dst", "relation", "pos", "truncated")


def with_skills(operators: DataFrame, skills: DataFrame) -> DataFrame:
    """operators with their skills, sorted. operators: name; skills: name, skill."""
    per = skills.filter("skill is not null").groupBy("name").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    return operators.join(per, "name", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))


def focus_subgraph(contains: DataFrame, counter: DataFrame, stars: DataFrame, top: int = 3, skills: DataFrame | None = None) -> DataFrame:
    """stage, enemy, name, weight, pos: for each enemy of a stage its `top` counters by the largest weight, then star. stars: name, star. With skills (name, skill) also
    each counter's skills, sorted."""
    best = counter.groupBy("page", "name").agg(F.max("weight").alias("weight")).join(stars, "name")
    w = Window.partitionBy("page").orderBy(F.col("weight").desc(), F.col("star").desc(), "name")
    kept = best.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= top)
    more = []
    if skills is not None:
        kept, more = with_skills(kept, skills), ["skills"]
    return contains.select("stage", F.col("enemy").alias("page")).join(kept, "page").select("stage", F.col("page").alias("enemy"), "name", "weight", "pos", *more)
