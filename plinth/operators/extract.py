"""Page tables: one Arrow job turns HTML into a relation of cells; all that follows are DataFrame steps on it.

cells: page_id, title, section, table_no, table_class, row_no, cell_no, tag (th or td), text, italics (texts of the cell's <i> elements).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages whose cells a task holds at once.
PAGES = 256
CELLS = "page_id long, title string, section string, table_no int, table_class string, row_no int, cell_no int, tag string, text string, italics array<string>"
#: The fields of an enemy level, in order; a header becomes the first of these that it starts with.
ENEMY_FIELDS = ["名称", "地位", "种类", "描述", "攻击方式", "行动方式", "生命自回速度", "最大生命值", "攻击力", "防御力", "法术抗性", "攻击半径", "重量", "移动速度", "攻击间隔", "元素抗性", "损伤抵抗", "基础嘲讽等级", "目标价值", "特性"]
#: Fields that hold an enemy's traits, the first that is filled counts; classes of the tables that parsers look for.
TRAIT_FIELDS = ["特性", "异常抗性", "天赋"]
GROWTH_TABLE, EXTRA_TABLE, SKILL_TABLE, LEVEL_TABLES = "char-base-attr-table", "char-extra-attr-table", "nomobile", ["enemy-info-level", "wikitable"]


def _tidy(pieces: list[str]) -> str:
    """Text pieces with one blank between them and between their words."""
    return " ".join(" ".join(pieces).split())


class _Cells(HTMLParser):
    """Collects table cells with the heading that they stand under."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.title = self.section = ""
        self.table = -1
        self.stack: list[list] = []  # open tables: number, class, row, cell, open tag, text
        self.heading: list[str] | None = None
        self.heading_id = ""
        self.in_title = False
        self.skip = 0
        self.italics: list[str] = []
        self.slanted: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "h2":
            self.heading, self.heading_id = [], a.get("id") or ""
        elif tag == "table":
            self.table += 1
            self.stack.append([self.table, a.get("class") or "", -1, -1, None, []])
        elif self.stack:
            t = self.stack[-1]
            if tag == "tr":
                self._close(t)
                t[2] += 1
                t[3] = -1
            elif tag in ("th", "td"):
                self._close(t)
                t[2] = max(t[2], 0)
                t[3] += 1
                t[4], t[5] = tag, []
                self.italics, self.slanted = [], None
            elif tag == "i" and t[4]:
                self.slanted = []

    def _close(self, t):
        if t[4]:
            self.rows.append((self.title, self.section, t[0], t[1], t[2], t[3], t[4], _tidy(t[5]), self.italics))
            t[4], self.italics, self.slanted = None, [], None

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "h2" and self.heading is not None:
            self.section, self.heading = self.heading_id or " ".join("".join(self.heading).split()), None
        elif tag == "i" and self.slanted is not None:
            self.italics, self.slanted = [*self.italics, *filter(None, [_tidy(self.slanted)])], None
        elif self.stack and tag in ("th", "td", "tr"):
            self._close(self.stack[-1])
        elif self.stack and tag == "table":
            self._close(self.stack.pop())

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title += data
        elif self.heading is not None:
            self.heading.append(data)
        elif self.stack and self.stack[-1][4]:
            self.stack[-1][5].append(data)
            if self.slanted is not None:
                self.slanted.append(data)


def cells(pages: DataFrame) -> DataFrame:
    """The cell relation of pages (page_id, html). A null or broken page gives what could be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for pdf in batches:
            # A batch's cells are many times its pages, so they go on some pages at a time.
            for a in range(0, len(pdf), PAGES):
                some, out = pdf.iloc[a : a + PAGES], []
                for page, html in zip(some.page_id, some.html):
                    p = _Cells()
                    p.feed(html or "")
                    p.close()
                    out += [(page, *r) for r in p.rows]
                yield pd.DataFrame(out, columns=names)

    return pages.select("page_id", "html").mapInPandas(run, CELLS)


def titles(pages: DataFrame) -> DataFrame:
    """page_id, title, code (the title's first word)."""
    t = F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    return pages.select("page_id", t.alias("title"), F.split_part(t, F.lit(" "), F.lit(1)).alias("code"))


def rows_of(cell: DataFrame, keep_empty: bool = False) -> DataFrame:
    """page_id, title, section, table_no, table_class, row_no, tags and texts (arrays in order); rows without text go unless keep_empty."""
    g = cell.groupBy("page_id", "title", "section", "table_no", "table_class", "row_no").agg(F.array_sort(F.collect_list(F.struct("cell_no", "tag", "text", "italics"))).alias("c"))
    r = g.select("page_id", "title", "section", "table_no", "table_class", "row_no", F.transform("c", lambda x: x.tag).alias("tags"), F.transform("c", lambda x: x.text).alias("texts"), F.transform("c", lambda x: x.italics).alias("italics"))
    return r if keep_empty else r.filter(F.exists("texts", lambda t: t != ""))


def first_tables(row: DataFrame) -> DataFrame:
    """The rows of the first table of each page's section."""
    return row.withColumn("_first", F.min("table_no").over(Window.partitionBy("page_id", "section"))).filter(F.col("table_no") == F.col("_first")).drop("_first")


def section(cell: DataFrame, name: str) -> DataFrame:
    return cell.filter(F.col("section") == name)


def th_td_pairs(row: DataFrame, wide_header: str = "名称", *also: Column) -> DataFrame:
    """page_id, section, table_no, pairs (map header -> value), and what `also` sums up of a table's rows. A row with headers and values pairs them in order; a row of headers alone waits for the
    next row of values alone; a row with the wide header and more headers than values waits with all of them. Of a repeated header the last value
    stands, at the first one's place; empty headers name nothing."""
    of = lambda tag: F.transform(F.filter(F.arrays_zip("tags", "texts"), lambda x: x.tags == tag), lambda x: x.texts)
    r = row.withColumn("th", of("th")).withColumn("td", of("td"))
    waits = (F.size("th") > 0) & ((F.size("td") == 0) | (F.array_contains("th", wide_header) & (F.size("th") > F.size("td"))))
    alone = F.size("th") == 0
    w = Window.partitionBy("page_id", "section", "table_no").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<string>")
    # What waits at a row: the last headers set aside, unless a row of values has taken them.
    waiting = F.last(F.when(waits, F.col("th")).when(alone, none), ignorenulls=True).over(w)
    heads = F.when(alone, F.coalesce(waiting, none)).when(waits, none).otherwise(F.col("th"))
    pair = F.filter(F.transform(F.arrays_zip(heads.alias("h"), F.col("td").alias("v")), lambda x: F.struct(x.h.alias("k"), x.v.alias("v"))), lambda x: (x.k != "") & x.v.isNotNull())
    flat = r.withColumn("pair", pair).groupBy("page_id", "section", "table_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "pair"))), lambda x: x["pair"])).alias("ps"), *also)
    last = F.transform(F.array_distinct(F.transform("ps", lambda p: p.k)), lambda k: F.struct(k.alias("k"), F.element_at(F.filter("ps", lambda p: p.k == k), -1).v.alias("v")))
    return flat.withColumn("pairs", F.map_from_entries(last)).drop("ps")


def js_object(text: str | None, name: str) -> str:
    """The JSON of `var name = {...}`: braces are matched outside strings, trailing commas go and escaped apostrophes lose the escape; {} if there is none or it can't be read."""
    m = re.search(rf"\bvar\s+{re.escape(name)}\s*=\s*(?=\{{)", text or "")
    if not m:
        return "{}"
    depth, quote, i = 0, "", m.end()
    for j in range(i, len(text)):
        c = text[j]
        if quote:
            quote = "" if c == quote and text[j - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                body = re.sub(r",(\s*[}\]])", r"\1", text[i : j + 1].replace("\\'", "'"))
                try:
                    return json.dumps(json.loads(body), ensure_ascii=False)
                except ValueError:
                    return "{}"
    return "{}"


def embedded_objects(pages: DataFrame, name: str, schema: str) -> DataFrame:
    """page_id, object: the page's script object as a struct."""

    @F.pandas_udf("string")
    def find(html: pd.Series) -> pd.Series:
        return html.map(lambda t: js_object(t, name))

    return pages.select("page_id", F.from_json(find("html"), schema).alias("object"))


def _table(row: DataFrame) -> DataFrame:
    """page_id, table_no, rs (its rows' texts, in order)."""
    return row.groupBy("page_id", "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "texts"))), lambda x: x.texts).alias("rs"))


def traits(row: DataFrame) -> DataFrame:
    """page_id, trait (map) from the first table of section 特性: 分支, 描述 and 分支信息, as far as they are there. Below a header 分支, 描述 the next
    row is branch and description; below 分支, 条件 it is the branch, and the rows after it are conditions, joined up to the row 分支信息; the row after
    that says more of the branch."""
    t = _table(first_tables(section(row, "特性")))
    t = t.withColumn("h", F.expr("array_position(transform(rs, r -> r[0] = '分支' and size(r) > 1 and r[1] in ('描述', '条件')), true)").cast("int"))
    t = t.withColumn("value", F.when(F.col("h") > 0, F.get("rs", F.col("h")))).withColumn("plain", F.expr("h > 0 and rs[h - 1][1] = '描述' and size(value) > 1"))
    t = t.withColumn("rest", F.expr("if(h > 0, slice(rs, h + 2, size(rs)), cast(array() as array<array<string>>))"))
    t = t.withColumn("stop", F.expr("array_position(transform(rest, r -> size(r) = 1 and r[0] = '分支信息'), true)").cast("int"))
    lines = "transform(filter(if(stop > 0, slice(rest, 1, stop - 1), rest), r -> size(r) > 1 and r[0] <> '' and r[1] <> ''), r -> concat(r[0], '：', r[1]))"
    info = "filter(transform(sequence(1, size(rs)), i -> if(size(rs[i - 1]) = 1 and rs[i - 1][0] = '分支信息' and size(get(rs, i)) > 0, get(rs, i)[0], null)), x -> x is not null)"
    t = t.withColumn("found", F.expr(f"array(named_struct('k', '分支', 'v', value[0]), named_struct('k', '描述', 'v', if(plain, value[1], nullif(array_join({lines}, '；'), ''))), named_struct('k', '分支信息', 'v', try_element_at({info}, -1)))"))
    return t.select("page_id", F.map_from_entries(F.filter("found", lambda x: x.v.isNotNull())).alias("trait"))


def obtain(row: DataFrame) -> DataFrame:
    """page_id, obtain (map): the first table of section 获得方式."""
    return th_td_pairs(first_tables(section(row, "获得方式"))).select("page_id", F.col("pairs").alias("obtain"))


def extra_attributes(row: DataFrame) -> DataFrame:
    """page_id, extra_attrs (map): the first such table of section 属性."""
    return th_td_pairs(first_tables(section(row, "属性").filter(F.contains("table_class", F.lit(EXTRA_TABLE))))).select("page_id", F.col("pairs").alias("extra_attrs"))


def growth(row: DataFrame, name: str = "属性") -> DataFrame:
    """page_id, stages (the header row's texts that aren't empty), rows (map: each row's texts by its first): the first such table of the section."""
    g = _table(first_tables(section(row, name).filter(F.contains("table_class", F.lit(GROWTH_TABLE)))))
    rest = F.expr("slice(rs, 2, size(rs))")
    keys = F.array_distinct(F.transform(rest, lambda x: x[0]))
    last = F.transform(keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(rest, lambda x: x[0] == k), -1).alias("v")))
    tail = F.transform(last, lambda x: F.struct(x.k.alias("k"), F.slice(x.v, F.lit(2), F.size(x.v)).alias("v")))
    return g.select("page_id", F.filter(F.get("rs", F.lit(0)), lambda t: t != "").alias("stages"), F.map_from_entries(tail).alias("rows"))


def skills(row: DataFrame, name: str = "技能") -> DataFrame:
    """page_id, table_no, name, type, levels: tables of class nomobile with three rows or more whose first row has two texts (name and type) and whose second
    row, of three cells or more, starts with 等级; level rows have five cells or more, and a skill has one at least."""
    g = _table(section(row, name).filter(F.contains("table_class", F.lit(SKILL_TABLE)))).withColumn("head", F.filter(F.get("rs", F.lit(0)), lambda t: t != ""))
    g = g.filter("size(rs) >= 3 and size(head) >= 2 and size(rs[1]) >= 3 and rs[1][0] = '等级'")
    levels = F.transform(F.filter(F.expr("slice(rs, 3, size(rs))"), lambda x: F.size(x) >= 5), lambda x: F.struct(*[F.get(x, F.lit(i)).alias(n) for i, n in enumerate(("level", "desc", "initial", "cost", "duration"))]))
    return g.select("page_id", "table_no", F.get("head", F.lit(0)).alias("name"), F.get("head", F.lit(1)).alias("type"), levels.alias("levels")).filter(F.size("levels") > 0)


def operator_records(pages: DataFrame, row: DataFrame) -> DataFrame:
    """page_id, name, star_rating (the source counts from 0), and the record's trait, obtain, extra and growth attributes, and skills. Each part may be as long as the pages, which
    no estimate knows behind the parser, so none is broadcast."""
    meta = embedded_objects(pages, "operator", "name string, star int, class string, branch string, pos string, tag string")
    base = meta.select("page_id", F.col("object.name").alias("name"), (F.col("object.star") + 1).alias("star_rating"), F.col("object").alias("meta"))
    listed = skills(row).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "name", "type", "levels"))), lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x.levels.alias("levels"))).alias("skills"))
    for part in (traits(row), obtain(row), extra_attributes(row), growth(row), listed):
        base = base.join(part.hint("merge"), "page_id", "left")
    return base


def field_of(header: Column, fields: list[str] = ENEMY_FIELDS) -> Column:
    """The first field, in the list's order, that the header starts with; the header itself if none."""
    return F.coalesce(*[F.when(F.startswith(header, F.lit(f)), F.lit(f)) for f in fields], header)


def enemy_levels(row: DataFrame, fields: list[str] = ENEMY_FIELDS) -> DataFrame:
    """page_id, level, data (map field -> value), traits: the first table of a level's class with any pair, in sections `级别N`. Of headers that become one
    field the last counts. traits: the first filled trait field, else the italic texts of the table's last row, of its first cell that has any."""
    r = row.filter(F.col("section").rlike(r"^级别\d+$")).filter(F.col("table_class").rlike("|".join(LEVEL_TABLES)))
    slanted = F.filter(F.transform(F.arrays_zip("tags", "italics"), lambda x: F.when((x.tags == "td") & (F.size(x.italics) > 0), x.italics)), lambda x: x.isNotNull())
    # The italics go along with the pairs: a join of both would parse the pages twice and broadcast a row for each table.
    pairs = th_td_pairs(r, "名称", F.max_by(F.get(slanted, F.lit(0)), "row_no").alias("slanted")).filter(F.size("pairs") > 0)
    pairs = pairs.withColumn("_first", F.min("table_no").over(Window.partitionBy("page_id", "section"))).filter(F.col("table_no") == F.col("_first")).drop("_first")
    table = ["page_id", "section", "table_no", "slanted"]
    e = pairs.select(*table, F.posexplode(F.map_entries("pairs")).alias("pos", "e")).select(*table, "pos", field_of(F.col("e.key"), fields).alias("f"), F.col("e.value").alias("v"))
    one = e.groupBy(*table, "f").agg(F.max_by("v", "pos").alias("v"))
    g = one.groupBy(*table).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("f", "v")))).alias("data"))
    named = F.coalesce(*[F.nullif(F.try_element_at("data", F.lit(f)), F.lit("")) for f in TRAIT_FIELDS])
    found = F.when(named.isNotNull(), F.array(named)).otherwise(F.coalesce("slanted", F.array().cast("array<string>")))
    return g.select("page_id", F.regexp_extract("section", r"(\d+)", 1).cast("int").alias("level"), "data", found.alias("traits"))


def stage_cards(row: DataFrame) -> DataFrame:
    """page_id, section, name, desc, pairs: the first row is the name, the second the description, the others pairs; navigation boxes and tables of one row are left out."""
    r = row.filter(~F.contains("table_class", F.lit("navbox")))
    n = r.groupBy("page_id", "section", "table_no").agg(F.count("*").alias("n"), F.min_by(F.get("texts", F.lit(0)), "row_no").alias("name"), F.min("row_no").alias("r0")).filter("n >= 2")
    named = r.join(n, ["page_id", "section", "table_no"])
    desc = named.filter(F.col("row_no") == F.col("r0") + 1).select("page_id", "section", "table_no", F.get("texts", F.lit(0)).alias("desc"))
    pairs = th_td_pairs(named.filter(F.col("row_no") > F.col("r0") + 1).select(*r.columns))
    return n.drop("n", "r0").join(desc, ["page_id", "section", "table_no"], "left").join(pairs, ["page_id", "section", "table_no"], "left")


def stage_enemies(row: DataFrame, header: str = "名称") -> DataFrame:
    """page_id, row_no, enemy (map header -> value): the first row that holds the header names the columns; shorter rows are left out."""
    w = Window.partitionBy("page_id", "table_no")
    at = F.min(F.when(F.array_contains("texts", header), F.col("row_no"))).over(w)
    r = row.withColumn("at", at).filter("at is not null")
    head = F.max(F.when(F.col("row_no") == F.col("at"), F.col("texts"))).over(w)
    r = r.withColumn("head", head).filter((F.col("row_no") > F.col("at")) & (F.size("texts") >= F.size("head")))
    return r.select("page_id", "table_no", "row_no", F.map_from_arrays(F.array_distinct("head"), F.slice("texts", F.lit(1), F.size(F.array_distinct("head")))).alias("enemy"))
