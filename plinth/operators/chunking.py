"""Rendering entities as text and packing text into chunks with deterministic ids.

Packing is an ordered fold over a row's paragraphs, so it stays one expression in the row's own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.text import page_url, sentences, stable_id, strip

#: Least room that a continuation's context leaves for text.
LEAST_ROOM = 100
#: Fields of an enemy level, in the order in which they are shown (fixed values).
ENEMY_FIELDS = ["地位", "种类", "描述", "攻击方式", "行动方式", "最大生命值", "攻击力", "防御力", "法术抗性", "攻击半径", "重量", "移动速度", "攻击间隔", "生命自回速度", "元素抗性", "损伤抵抗", "异常抗性", "基础嘲讽等级", "目标价值"]
#: Fields of a stage, and how one is shown (fixed values).
STAGE_FIELDS = ["desc", "解锁条件", "推荐等级", "作战消耗", "部署上限", "初始COST", "COST上限", "目标点耐久", "待处理目标数量"]
SHOWN_AS = {"desc": "关卡描述"}


def _slices(s: Column, most: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substring(s, (i * most + 1).cast("int"), most))


def _tagged(paragraphs: Column, most: Column) -> Column:
    """Paragraphs in runs: (own, parts): short ones as they are, long ones as the blocks that their sentences make."""

    def long(p):
        # A sentence too long for a block is cut hard; a mark keeps its slices apart from their neighbours.
        marked = F.flatten(F.transform(sentences(p), lambda s: F.when(F.length(s) > most, F.transform(_slices(s, most), lambda x: F.struct(F.lit(True).alias("cut"), x.alias("t")))).otherwise(F.array(F.struct(F.lit(False).alias("cut"), s.alias("t"))))))
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

        def step(acc, x):
            closed = F.when(acc.open == "", acc.done).otherwise(F.array_append(acc.done, acc.open))
            fits = (acc.open == "") | (F.length(acc.open) + F.length(x.t) <= most)
            return F.when(x.cut, F.struct(F.array_append(closed, x.t).alias("done"), F.lit("").alias("open"))).when(fits, F.struct(acc.done.alias("done"), F.concat(acc.open, x.t).alias("open"))).otherwise(F.struct(closed.alias("done"), x.t.alias("open")))

        return F.aggregate(marked, start, step, lambda acc: F.when(acc.open == "", acc.done).otherwise(F.array_append(acc.done, acc.open)))

    return F.transform(paragraphs, lambda p: F.struct((F.length(p) > most).alias("long"), F.when(F.length(p) > most, long(p)).otherwise(F.array(p)).alias("parts")))


def pack(paragraphs: Column, most: Column | int) -> Column:
    """Blocks of at most `most` characters: short paragraphs are joined by line ends; a long one closes the open block and is packed by
    its sentences, without joiner. Blank paragraphs are left out."""
    most = F.lit(most) if isinstance(most, int) else most
    kept = F.filter(F.transform(paragraphs, strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, x):
        closed = F.when(acc.open == "", acc.done).otherwise(F.array_append(acc.done, acc.open))
        p = F.element_at(x.parts, 1)
        fits = (acc.open == "") | (F.length(acc.open) + 1 + F.length(p) <= most)
        grown = F.when(acc.open == "", p).otherwise(F.concat(acc.open, F.lit("\n"), p))
        return F.when(x.long, F.struct(F.concat(closed, x.parts).alias("done"), F.lit("").alias("open"))).when(fits, F.struct(acc.done.alias("done"), grown.alias("open"))).otherwise(F.struct(closed.alias("done"), p.alias("open")))

    return F.aggregate(_tagged(kept, most), start, step, lambda acc: F.when(acc.open == "", acc.done).otherwise(F.array_append(acc.done, acc.open)))


def chunks(sections: DataFrame, base_url: str, most: int = 500) -> DataFrame:
    """One row for each chunk: id, text, source, type, section, url, ord. sections: source, type, section, paragraphs and, if chunks after the first are to
    repeat it, context."""
    context = F.col("context") if "context" in sections.columns else F.lit(None).cast("string")
    room = F.when(context.isNull() | (context == ""), F.lit(most)).otherwise(F.greatest(F.lit(LEAST_ROOM), F.lit(most) - F.length(context)))
    packed = sections.select("source", "type", "section", context.alias("context"), room.cast("int").alias("room"), "paragraphs").select("*", F.posexplode(pack(F.col("paragraphs"), F.col("room"))).alias("ord", "block"))
    repeat = (F.col("ord") > 0) & (F.col("context") != "") & ~F.startswith("block", "context")
    text = strip(F.when(repeat, F.concat("context", "block")).otherwise(F.col("block")))
    return packed.select(stable_id(F.col("type"), F.col("source"), F.col("section"), F.col("ord")).alias("id"), text.alias("text"), "source", "type", "section", page_url(F.col("source"), base_url).alias("url"), F.col("ord").cast("long").alias("ord"))


def stage_title(stem: Column, code: Column, name: Column) -> Column:
    """A stem with a blank is a title; else it is made of code and name, where there is a name."""
    return F.when(F.contains(stem, F.lit(" ")) | F.coalesce(name, F.lit("")).eqNullSafe(""), stem).otherwise(F.trim(F.concat_ws(" ", F.coalesce(F.nullif(code, F.lit("")), stem), name)))


def _pairs(m: Column, colon: str = "：") -> Column:
    """Lines `key: value` of a map's filled entries."""
    return F.transform(F.filter(F.map_entries(m), lambda e: F.coalesce(e.value, F.lit("")) != ""), lambda e: F.concat(e.key, F.lit(colon), e.value))


def short_stage(label: Column) -> Column:
    """A growth label without what stands around the promotion and level."""
    hit = F.regexp_extract(label, r"精英\d+ (\d+级|满级)", 0)
    return F.when(hit != "", hit).otherwise(label)


def operator_sections(pages: DataFrame) -> DataFrame:
    """Sections meta, trait, obtain, attrs and one for each skill. pages: source, name, meta struct, trait map, obtain map, extra_attrs map, growth struct
    (stages, rows), skills array."""
    fields = [("职业", "class"), ("分支", "branch"), ("星级", "star_rating"), ("位置", "pos"), ("标签", "tag"), ("阵营", "group")]
    have = set(pages.schema["meta"].dataType.names)
    meta = F.concat(F.array(F.col("name")), F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"meta.{k}").cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}："), F.col(f"meta.{k}").cast("string"))) for label, k in fields if k in have])), _pairs(F.col("extra_attrs")))
    growth = F.transform(F.map_entries("growth.rows"), lambda e: F.concat(e.key, F.lit("："), F.array_join(F.filter(F.zip_with("growth.stages", e.value, lambda s, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(short_stage(s), F.lit(" "), v))), lambda x: x.isNotNull()), "、")))
    context = F.concat(F.col("name"), F.lit(" ")).alias("context")

    def section(name: str, paragraphs: Column) -> DataFrame:
        return pages.select("source", F.lit("operator").alias("type"), F.lit(name).alias("section"), paragraphs.alias("paragraphs"), context)

    out = section("meta", F.array(F.array_join(meta, "\n")))
    for name, lines in (("trait", _pairs(F.col("trait"))), ("obtain", _pairs(F.col("obtain"))), ("attrs", growth)):
        out = out.unionByName(section(name, F.coalesce(lines, F.array().cast("array<string>"))))
    skill = pages.select("source", "name", F.explode("skills").alias("k"))
    levels = F.transform("k.levels", lambda v: F.concat_ws(" ", F.concat(v.level, F.lit("：")), v["desc"], F.when(F.coalesce(v.cost, F.lit("")) != "", F.concat(F.lit("消耗"), v.cost)), F.when(F.coalesce(v.duration, F.lit("")) != "", F.concat(F.lit("持续"), v.duration))))
    skills = skill.select("source", F.lit("operator").alias("type"), F.concat(F.lit("skill:"), F.col("k.name")).alias("section"), F.concat(F.array(F.concat_ws(" ", "k.name", "k.type")), levels).alias("paragraphs"), F.concat("name", F.lit(" "), "k.name", F.lit(" ")).alias("context"))
    return out.unionByName(skills).filter(F.size("paragraphs") > 0)


def enemy_sections(pages: DataFrame, fields: list[str] = ENEMY_FIELDS) -> DataFrame:
    """A section for each level. pages: source, levels array<struct<level, data map, traits array>>."""
    level = pages.select("source", F.explode("levels").alias("l"))
    lines = F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at("l.data", F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"{k}："), F.try_element_at("l.data", F.lit(k)))) for k in fields]))
    head = F.array(F.concat(F.lit("敌人"), F.coalesce(F.try_element_at("l.data", F.lit("名称")), F.col("source")), F.lit("（级别"), F.col("l.level").cast("string"), F.lit("）。")))
    traits = F.when(F.size("l.traits") > 0, F.array(F.concat(F.lit("特性："), F.array_join("l.traits", "、")))).otherwise(F.array().cast("array<string>"))
    return level.select("source", F.lit("enemy").alias("type"), F.concat(F.lit("level"), F.col("l.level").cast("string")).alias("section"), F.concat(head, lines, traits).alias("paragraphs"), F.concat("source", F.lit(" ")).alias("context"))


def stage_sections(pages: DataFrame, fields: list[str] = STAGE_FIELDS) -> DataFrame:
    """Sections info and enemies. pages: source, normal map, raid map, enemies array<map>."""
    pick = lambda m: F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("")) != "", F.concat(F.lit(f"{SHOWN_AS.get(k, k)}："), F.try_element_at(m, F.lit(k)))) for k in fields]))
    head = F.array(F.concat(F.lit("关卡"), F.split_part("source", F.lit(" "), F.lit(1)), F.lit("（"), F.coalesce(F.try_element_at("normal", F.lit("name")), F.lit("")), F.lit("）。")))
    raid = F.when(F.size(F.map_keys("raid")) > 0, F.array(F.concat(F.lit("突袭："), F.array_join(_pairs(F.col("raid")), "；")))).otherwise(F.array().cast("array<string>"))
    info = pages.select("source", F.lit("stage").alias("type"), F.lit("info").alias("section"), F.concat(head, pick("normal"), raid).alias("paragraphs"), F.concat("source", F.lit(" ")).alias("context"))
    foes = F.transform("enemies", lambda m: F.array_join(_pairs(m), "，"))
    return info.unionByName(pages.select("source", F.lit("stage").alias("type"), F.lit("enemies").alias("section"), foes.alias("paragraphs"), F.concat("source", F.lit(" ")).alias("context"))).filter(F.size("paragraphs") > 0)


def guide_sections(guides: DataFrame) -> DataFrame:
    """A section body from the text's lines. guides: title, text."""
    return guides.select(F.col("title").alias("source"), F.lit("guide").alias("type"), F.lit("body").alias("section"), F.split("text", "\n").alias("paragraphs"), F.lit("").alias("context"))


def operator_guides(pages: DataFrame, skills: int = 3) -> DataFrame:
    """title, text: a short guide with the first skills' first level."""
    lines = F.transform(F.slice("skills", 1, skills), lambda k: F.concat_ws("：", k["name"], F.try_element_at(k.levels, F.lit(1))["desc"]))
    return pages.select(F.col("source").alias("title"), F.concat_ws("\n", "name", F.concat_ws(" ", "meta.class", "meta.branch"), F.array_join(_pairs(F.col("trait")), "\n"), F.array_join(lines, "\n")).alias("text"))


def enemy_guides(pages: DataFrame, fields: int = 14) -> DataFrame:
    return enemy_sections(pages, ENEMY_FIELDS[:fields]).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", F.array_join("paragraphs", "\n").alias("t")))), lambda x: x.t), "\n").alias("text")).select(F.col("source").alias("title"), "text")


def stage_guides(pages: DataFrame, fields: int = 6) -> DataFrame:
    parts = stage_sections(pages, STAGE_FIELDS[:fields])
    return parts.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("section") != "info").alias("last"), F.array_join("paragraphs", "\n").alias("t")))), lambda x: x.t), "\n").alias("text")).select(F.col("source").alias("title"), "text")


def chunk_stats(found: DataFrame, most: int = 500) -> DataFrame:
    """Per type: chunks, shortest, longest, and how many are over the limit (upper_median has the median)."""
    n = F.length("text")
    return found.withColumn("len", n).groupBy("type").agg(F.count("*").alias("n_chunks"), F.min("len").cast("long").alias("shortest"), F.max("len").cast("long").alias("longest"), F.count_if(F.col("len") > most).alias("over"))


def upper_median(found: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the element number n div 2 (from 0) of its sorted values: ranked in the shuffle's sort, never gathered."""
    w = Window.partitionBy(*by).orderBy(value)
    ranked = found.select(*by, value, (F.row_number().over(w) - 1).alias("r"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    return ranked.filter(F.col("r") == F.floor(F.col("n") / 2)).select(*by, F.col(value).alias("upper_median"))
