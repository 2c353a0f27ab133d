import pytest
from pyspark.sql import functions as F

from plinth.functions.text import sentences, token_ids, words
from plinth.operators import chunking, retrieval

CHUNKS = "ord long, type string, source string, text string"
BASE = "https://wiki.example/w/"


def corpus(spark):
    return spark.createDataFrame([(0, "operator", "能天使", "能天使 的技能 过载模式"), (1, "enemy", "碎骨", "碎骨 是精英敌人"), (2, "operator", "芬", "芬 是先锋干员")], CHUNKS)


def ask(spark, *queries):
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id long, query string")


def test_words(spark):
    row = spark.createDataFrame([("能天使 Ab3-x，",)], "t string").select(words(F.col("t")).alias("w")).first()
    assert row.w == ["能", "天", "使", "能天", "天使", "ab3", "x"]


def test_bm25(spark):
    hits = retrieval.bm25(corpus(spark), ask(spark, "能天使 技能", "敌人", "", "zzzqqqxxx"), 5).collect()
    assert [(r.ord, r["rank"]) for r in hits if r.query_id == 0][0] == (0, 0)
    only = retrieval.bm25(corpus(spark), ask(spark, "敌人"), 5, types=["enemy"]).collect()
    assert [r.ord for r in only] == [1] and not [r for r in hits if r.query_id in (2, 3)]


def test_bm25_counts_repeated_query_words(spark):
    a, b = (retrieval.bm25(corpus(spark), ask(spark, q), 1).first().score for q in ("碎", "碎 碎"))
    assert abs(b - 2 * a) < 2e-4


def test_rrf(spark):
    rows = [(1, 0, "a", 0), (1, 0, "b", 1), (1, 1, "a", 0), (1, 1, "c", 1)]
    got = {r.content: r for r in retrieval.rrf_fuse(spark.createDataFrame(rows, "query_id long, path int, content string, rank int")).collect()}
    assert got["a"].paths == [0, 1] and got["a"].score == round(2 / 61, 6) and got["b"].score == round(1 / 62, 6) and len(got) == 3


def test_named_rerank(spark):
    rows = [(1, "能天使 技能", "新约能天使", "operator", 0, 0.75), (1, "能天使 技能", "能天使", "operator", 1, 0.7), (1, "能天使 技能", "碎骨", "enemy", 2, 0.5)]
    got = retrieval.named_rerank(spark.createDataFrame(rows, "query_id long, query string, source string, type string, rank int, score double"), 2).orderBy("rank").collect()
    assert [(r.source, r.score) for r in got] == [("能天使", 0.7), ("新约能天使", 0.75)]


def test_codes_need_borders(spark):
    rows = [("1-1 开局", "stage", "11-1 怎么打"), ("1-1 开局", "stage", "1-1怎么打"), ("a", "operator", "a")]
    got = spark.createDataFrame(rows, "s string, t string, q string").select(retrieval.explicitly_named(F.col("s"), F.col("t"), F.col("q")).alias("n")).collect()
    assert [r.n for r in got] == [False, True, False]


def test_vector_metrics(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 2.0], 2), (3, [2.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(9, [0.0, 1.0])], "query_id long, q array<float>")
    assert [r.vec_id for r in retrieval.vector_top_k(v, q, 2).orderBy("rank").collect()] == [2, 3]
    assert [r.vec_id for r in retrieval.vector_top_k(v, q, 2, metric="ip").orderBy("rank").collect()] == [2, 3]
    assert [r.vec_id for r in retrieval.vector_top_k(v, q, 1, metric="l2").collect()] == [2]
    assert [r.vec_id for r in retrieval.vector_top_k(v, q, 5, where=F.col("label") == 1).orderBy("rank").collect()] == [3, 1]


def test_embedder(spark):
    rows = retrieval.embed(spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "text string")).collect()
    assert rows[0].embedding == rows[1].embedding and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-5 and set(rows[2].embedding) == {0.0}


def test_hybrid_degrades(spark):
    hit = "query_id long, content string, rank int, score double, source string, type string"
    vec = spark.createDataFrame([(0, "x", 0, 0.9, "s", "t"), (1, "y", 0, 0.8, "s", "t")], hit)
    words_ = spark.createDataFrame([(0, "x", 0, 5.0, "s", "t")], hit)
    got = {r.query_id: r for r in retrieval.hybrid(vec, words_, ask(spark, "q", "r")).collect()}
    assert got[0].score == round(2 / 61, 6) and not got[0].degraded and got[1].score == 0.8 and got[1].degraded


def pack(spark, paragraphs, most):
    return spark.createDataFrame([(paragraphs,)], "p array<string>").select(chunking.pack(F.col("p"), most).alias("c")).first().c


def test_packing(spark):
    assert pack(spark, ["a" * 10, "b" * 10], 100) == ["a" * 10 + "\n" + "b" * 10]
    assert pack(spark, ["a" * 60, " ", "b" * 60], 100) == ["a" * 60, "b" * 60]
    got = pack(spark, ["x" * 250], 100)
    assert len(got) == 3 and "".join(got) == "x" * 250
    text = "第一句话。第二句话很长！第三句？"
    got = pack(spark, [text], 12)
    assert "".join(got) == text and all(len(c) <= 12 for c in got)
    assert pack(spark, ["short", "y" * 15 + "。", "z"], 12) == ["short", "y" * 12, "yyy。", "z"]


def test_sentences(spark):
    row = spark.createDataFrame([("甲。乙！ \n 丙",)], "t string").select(sentences(F.col("t")).alias("s")).first()
    assert row.s == ["甲。", "乙！", "丙"]


def test_chunks_repeat_context(spark):
    s = spark.createDataFrame([("X", "operator", "meta", ["a" * 90, "b" * 90], "X ")], "source string, type string, section string, paragraphs array<string>, context string")
    got = chunking.chunks(s, BASE, 100).orderBy("ord").collect()
    assert [r.text[:2] for r in got] == ["aa", "X "] and got[0].url == BASE + "X" and len({r.id for r in got}) == 2


def test_entity_sections(spark):
    op = spark.sql("""select '芬' source, '芬' name, named_struct('class', '先锋', 'branch', '冲锋手', 'star_rating', 3, 'pos', '近战', 'tag', '费用回复', 'group', '') meta, map('信物', 'x') extra_attrs, map('描述', '阻挡') trait, map() obtain,
      named_struct('stages', array('精英0 1级', '精英1 满级'), 'rows', map('攻击', array('10', '20'))) growth, array(named_struct('name', '冲锋号令', 'type', '自动', 'levels', array(named_struct('level', '1', 'desc', '回费', 'initial', '0', 'cost', '5', 'duration', '')))) skills""")
    op = op.withColumn("obtain", F.create_map().cast("map<string,string>"))
    got = {r.section: r.paragraphs for r in chunking.operator_sections(op).collect()}
    assert set(got) == {"meta", "trait", "attrs", "skill:冲锋号令"} and "职业：先锋" in got["meta"][0] and got["attrs"] == ["攻击：精英0 1级 10、精英1 满级 20"]
    assert chunking.operator_guides(op).first().title == "芬"
    foe = spark.sql("select '碎骨' source, array(named_struct('level', 1, 'data', map('名称', '碎骨', '防御力', '500'), 'traits', array('a', 'b'))) levels")
    assert chunking.enemy_sections(foe).first().paragraphs == ["敌人碎骨（级别1）。", "防御力：500", "特性：a、b"]
    stage = spark.sql("select '3-8' source, map('name', '黄昏', '部署上限', '8') normal, map('x', 'y') raid, array(map('名称', '碎骨', '数量', '2')) enemies")
    assert {r.section for r in chunking.stage_sections(stage).collect()} == {"info", "enemies"} and "碎骨" in chunking.stage_guides(stage).first().text


def test_token_ids(spark):
    row = spark.createDataFrame([("能 ab1 能",)], "t string").select(token_ids(F.col("t"), 1000).alias("i")).first()
    assert len(row.i) == 3 and row.i[0] == row.i[2] and all(10 <= x < 1000 for x in row.i)


def test_saved_index_and_guide_search(spark, tmp_path):
    assert retrieval.save_index(corpus(spark), str(tmp_path / "index"))[0] == corpus(spark).count()
    index = retrieval.load_index(spark, str(tmp_path / "index"))
    q = ask(spark, "能天使 技能", "敌人", "zzzqqqxxx")
    assert sorted(map(tuple, retrieval.bm25(None, q, 5, index=index).collect())) == sorted(map(tuple, retrieval.bm25(corpus(spark), q, 5).collect()))
    asked = spark.createDataFrame([(1, "能天使 技能", 99, None), (2, "敌人", 0, "enemy"), (3, "敌人", 5, "guide"), (4, "", None, None)], "req_id long, query string, k int, doc_type string")
    got = retrieval.search_guide(corpus(spark), asked).collect()
    assert {r.req_id: r.found for r in got} == {1: True, 2: True, 3: False, 4: False} and {r.evidence for r in got} == {"retrieved"}


def test_build_corpus(spark, tmp_path):
    from plinth.operators.build import build_corpus

    guides = chunking.guide_sections(spark.createDataFrame([("a", "一。\n二。"), ("b", "三。")], "title string, text string"))
    assert build_corpus(guides, "u/", str(tmp_path / "c")) == {"chunks": 2, "added": 2, "stored": 2}
    assert build_corpus(guides, "u/", str(tmp_path / "c")) == {"chunks": 2, "added": 0, "stored": 2}
    with pytest.raises(ValueError):
        build_corpus(guides.filter("false"), "u/", str(tmp_path / "c"))
