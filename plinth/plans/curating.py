"""Curation and patterns: orders and lineitem as candidate jobs, documents and conversations as examples, events as actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.operators import curation, patterns, video
from plinth.plans.registry import Tables, query
from plinth.sources import readers, writers


@query("""
with r as (select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders)
select o_custkey, o_orderkey, rank::int as rank from r where rank <= 5
""")
def topk_per_group(t: Tables) -> DataFrame:
    return curation.top_per_group(t.orders, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 5).select("o_custkey", "o_orderkey", "rank")


@query("""
with r as (select o_custkey as stage, o_orderkey as id, o_orderstatus, row_number() over (partition by o_custkey order by o_orderstatus = 'P', o_totalprice desc, o_orderkey) as plan_rank from orders),
v as (select stage, id, plan_rank, row_number() over (partition by stage order by plan_rank, id) as rank from r where plan_rank <= 9 and o_orderstatus <> 'F')
select stage, id, plan_rank::int as plan_rank, rank::int as rank from v where rank <= 5
""")
def keep_first_valid(t: Tables) -> DataFrame:
    """Orders as items of their customer; those of status P lack ratings, those of status F turn out invalid."""
    items = t.orders.select(F.col("o_custkey").alias("stage"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("not_enough_rating"), F.col("o_totalprice").alias("rating"), F.lit(0).alias("views"), F.lit(0).alias("hot"), "o_orderstatus")
    return curation.first_valid(curation.planned(items), F.col("o_orderstatus") != "F").select("stage", "id", "plan_rank", "rank")


def jobs(t: Tables) -> DataFrame:
    """Events of each user as one job: signups deploy, clicks use skills, errors retreat, others are unsupported."""
    kind = F.when(F.col("event_type") == "signup", "deploy").when(F.col("event_type") == "click", "skill").when(F.col("event_type") == "error", "retreat").otherwise(F.col("event_type"))
    spot = F.floor(F.col("value")).cast("int")
    a = F.struct("ts", "event_id", F.struct(kind.alias("type"), F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("u"), (spot % 9).cast("string"))).alias("name"), (spot % 30).alias("kills"), F.lit(None).cast("string").alias("cost_changes"), F.array(spot % 8, spot % 5).alias("location"), F.when(F.col("event_id") % 3 > 0, "上").alias("direction")).alias("a"))
    g = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(a)).alias("s"))
    return g.select(F.col("user_id").cast("string").alias("job_id"), F.concat(F.lit("main_0"), (F.col("user_id") % 9).cast("string"), F.lit("-01")).alias("stage_name"), F.lit(None).cast("string").alias("title"), F.transform("s", lambda x: x.a).alias("actions"))


def job_actions(t: Tables) -> DataFrame:
    """The actions of jobs as rows."""
    kind = F.when(F.col("event_type") == "signup", "deploy").when(F.col("event_type") == "click", "skill").when(F.col("event_type") == "error", "retreat").otherwise(F.col("event_type"))
    spot = F.floor(F.col("value")).cast("int")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    name = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("u"), (spot % 9).cast("string")))
    return t.events.select(F.col("user_id").cast("string").alias("job_id"), idx.alias("idx"), kind.alias("type"), name.alias("name"), F.array(spot % 8, spot % 5).alias("location"), F.when(F.col("event_id") % 3 > 0, "上").alias("direction"))


@query("""
with e as (
  select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as p, floor(value)::bigint as spot, case when event_id % 7 > 0 then 'u' || floor(value)::bigint % 9 end as name from events),
named as (select *, event_type = 'signup' and name is not null as dep, event_type = 'error' and name is not null as out_n, event_type = 'error' and name is null as out_p from e),
spans as (
  select d.user_id, d.p, d.name, (select min(x.p) from named x where x.user_id = d.user_id and x.p > d.p and ((x.dep and x.name = d.name) or (x.out_n and x.name = d.name) or (x.out_p and x.spot % 8 = d.spot % 8 and x.spot % 5 = d.spot % 5))) as until
  from named d where d.dep)
select e.user_id::varchar as job_id, (e.p - 1)::int as idx, count(s.p) as n_before from e left join spans s on s.user_id = e.user_id and s.p < e.p and (s.until is null or s.until >= e.p) group by all
""")
def timeline_prefix_state(t: Tables) -> DataFrame:
    """How many units are on the field before each action."""
    return curation.count_before(job_actions(t)).select("job_id", "idx", "n_before")


@query("""
with e as (
  select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as p, floor(value)::bigint as spot, case when event_id % 7 > 0 then 'u' || floor(value)::bigint % 9 end as name from events),
named as (select *, event_type = 'signup' and name is not null as dep, event_type = 'error' and name is not null as out_n, event_type = 'error' and name is null as out_p from e),
spans as (
  select d.user_id, d.p, d.name, d.spot, (select min(x.p) from named x where x.user_id = d.user_id and x.p > d.p and ((x.dep and x.name = d.name) or (x.out_n and x.name = d.name) or (x.out_p and x.spot % 8 = d.spot % 8 and x.spot % 5 = d.spot % 5))) as until
  from named d where d.dep)
select e.user_id::varchar as job_id, (e.p - 1)::int as idx, coalesce(string_agg(s.name || '@' || s.spot % 8 || ',' || s.spot % 5, ';' order by s.name), '') as units
from e left join spans s on s.user_id = e.user_id and s.p < e.p and (s.until is null or s.until >= e.p) group by all
""")
def timeline_prefix_units(t: Tables) -> DataFrame:
    """Which units stand where before each action."""
    units = curation.units_before(job_actions(t))
    told = F.transform("units", lambda u: F.concat(u["name"], F.lit("@"), F.array_join(u.location.cast("array<string>"), ",")))
    return units.select("job_id", "idx", F.array_join(F.array_sort(told), ";").alias("units"))


@query("""
with e as (select event_type as k, case when event_id % 7 > 0 then 'u' || floor(value)::bigint % 9 end as name from events),
r as (select case when k not in ('signup', 'click', 'error') then 'unsupported:' || k when k <> 'error' and name is null then 'unnamed:' || case k when 'signup' then 'deploy' else 'skill' end end as reason from e)
select reason, count(*) as n from r where reason is not null group by reason
""")
def skip_accounting(t: Tables) -> DataFrame:
    return curation.skip_counts(jobs(t))


@query()
def rendered_examples(t: Tables) -> DataFrame:
    """Questions and answers of all usable actions, as digests."""
    return curation.examples(jobs(t)).select("job_id", "idx", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("""
with s as (select distinct 'main_0' || user_id % 9 || '-01' as stage_name from events)
select stage_name, regexp_replace(stage_name, '^main_0*(\\d+)-0*(\\d+).*', '\\1-\\2') as code from s
""")
def stage_codes(t: Tables) -> DataFrame:
    return jobs(t).select("stage_name", F.coalesce(curation.stage_code(F.col("stage_name")), "stage_name").alias("code")).distinct()


@query("select min(doc_id) as doc_id, md5(text) as digest from documents group by text")
def exact_dedup(t: Tables) -> DataFrame:
    return curation.exact_dedup(t.documents.select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@query("select count(*) as rows, count(distinct text) as distinct_rows, count(*) - count(distinct text) as removed from documents")
def exact_dedup_count(t: Tables) -> DataFrame:
    return curation.removed_count(t.documents, ["text"])


@query("with g as (select event_type, floor(value)::bigint as v, user_id, count(*) as n from events group by all having count(*) > 1) select count(*) as dup_groups, coalesce(sum(n - 1), 0)::bigint as extra_rows from g")
def near_dup_groups(t: Tables) -> DataFrame:
    return curation.duplicate_groups(t.events, ["event_type", F.floor("value").cast("bigint").alias("v"), "user_id"])


_SPLIT = """
s as (select source as grp, count(*) as n, md5('42|' || source) as h from documents group by source),
r as (select *, coalesce(sum(n) over (order by h, grp rows between unbounded preceding and 1 preceding), 0) as ahead, sum(n) over () as total from s),
sp as (select grp, n, case when ahead < greatest(1, round(total * 0.1)) then 'eval' else 'train' end as split from r)
"""


@query(f'with {_SPLIT} select grp as "group", n, split from sp')
def group_split(t: Tables) -> DataFrame:
    return curation.group_split(t.documents, "source")


@query(f"with {_SPLIT}, m as (select split, lang as action from documents join sp on source = grp) select split, action, count(*) as n from m group by rollup (split, action) having split is not null")
def split_manifest(t: Tables) -> DataFrame:
    split = curation.group_split(t.documents, "source").select(F.col("group").alias("source"), "split")
    return curation.manifest(t.documents.join(split, "source").select("split", F.col("lang").alias("action")))


@query("with r as (select doc_id, row_number() over (order by md5('42|' || doc_id)) as r, count(*) over () as n from documents) select doc_id, case when r <= greatest(1, floor(n * 0.1 + 0.5)) then 'eval' else 'train' end as split from r")
def random_split(t: Tables) -> DataFrame:
    return curation.random_split(t.documents, "doc_id").select("doc_id", "split")


@query("select doc_id, n_chars from documents order by md5('42|' || doc_id), doc_id limit 50")
def seeded_sample(t: Tables) -> DataFrame:
    return curation.seeded_sample(t.documents.select("doc_id", "n_chars"), "doc_id", 50)


@query("""
with t as (select conv_id, turn, unnest(list_filter([case when trim(text, ' ') = '' then 'question_empty' end, case when trim(text, ' ') <> '' and not starts_with(trim(text, ' '), '[关卡]') then 'question_head' end], lambda x: x is not null)) as tag from conversations)
select tag, count(*) as n from t group by tag
""")
def example_audit(t: Tables) -> DataFrame:
    """The audit's tags over conversations as examples without meta; only those of the question."""
    rows = t.conversations.select("conv_id", F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("struct<stage:string,source_job:string,index:int,action:string,kills:int,operator:string,location:array<int>,direction:string,evidence:map<string,string>>").alias("meta"))
    tagged = curation.audit_tags(rows)
    return curation.tag_counts(tagged, "conv_id").filter(F.startswith("tag", F.lit("question"))).select("tag", "n")


#: Ways to spoil a good example, by number, and the tags that the audit then gives.
_SPOILT = {
    0: [], 1: ["question_empty"], 2: ["question_head"], 3: ["question_short"], 4: ["answer_empty", "deploy_name_missing"], 5: ["answer_head", "head_differs"], 6: ["answer_no_reasons"], 7: ["answer_no_note"], 8: ["answer_no_numbering"],
    9: ["meta_missing"], 10: ["meta_action"], 11: ["head_differs", "skill_no_operator"], 12: ["meta_no_stage"], 13: ["meta_no_job", "meta_no_index"], 14: ["meta_no_kills"], 15: ["deploy_no_operator"], 16: ["deploy_location"], 17: ["deploy_direction"],
    18: ["deploy_name_missing"], 19: ["deploy_facing"], 20: ["retreat_no_target"], 21: ["retreat_name_missing"], 22: ["evidence_empty"], 23: ["evidence_label", "evidence_action"], 24: ["evidence_rationale"],
}


@query("select tag, count(*) as n from events join (values " + ", ".join(f"({v}, '{x}')" for v, tags in _SPOILT.items() for x in tags) + ") w(v, tag) on event_id % 25 = v group by tag")
def example_audit_tags(t: Tables) -> DataFrame:
    """Every tag of the audit: events as good examples, each spoilt in the way of its number."""
    v = F.col("event_id") % 25
    pick = lambda good, **ways: F.coalesce(*[F.when(v == int(k[1:]), x) for k, x in ways.items()], good)
    name, reasons = F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("\n理由：\n1) so\n" + curation.NOTE)
    deploy = F.concat(F.lit("deploy "), name, F.lit(" at (1,2) facing 上"), reasons)
    question = pick(F.concat(F.lit("[关卡] 3-8 "), F.col("event_type")), _1=F.lit(" "), _2=F.lit("stage 3-8 and more"), _3=F.lit("[关卡] 1"))
    answer = pick(
        deploy, _4=F.lit(""), _5=F.concat(F.lit("put "), name, reasons), _6=F.concat(F.lit("deploy "), name, F.lit("\n1) so" + curation.NOTE)), _7=F.concat(F.lit("deploy "), name, F.lit("\n理由：\n1) so")), _8=F.concat(F.lit("deploy "), name, F.lit("\n理由：so" + curation.NOTE)),
        _18=F.concat(F.lit("deploy it"), reasons), _20=F.concat(F.lit("retreat it"), reasons), _21=F.concat(F.lit("retreat it"), reasons),
    )
    action = pick(F.lit("deploy"), _10=F.lit("jump"), _11=F.lit("skill"), _20=F.lit("retreat"), _21=F.lit("retreat"))
    operator = F.when(~v.isin(11, 15, 20), name)
    good = F.create_map(F.lit("action"), F.lit(curation.EVIDENCE["action"]), F.lit("rationale"), F.lit(curation.EVIDENCE["rationale"]))
    other = F.create_map(F.lit("action"), F.lit("guess"), F.lit("rationale"), F.lit(curation.EVIDENCE["rationale"]))
    evidence = pick(good, _22=F.create_map().cast("map<string,string>"), _23=other, _24=F.create_map(F.lit("action"), F.lit(curation.EVIDENCE["action"])))
    meta = F.struct(
        F.when(v != 12, "3-8").alias("stage"), F.when(v != 13, "job").alias("source_job"), F.when(v != 13, 0).alias("index"), action.alias("action"), F.when(v != 14, 1).alias("kills"), operator.alias("operator"),
        F.when(~v.isin(16, 20), F.array(F.lit(1), F.lit(2))).alias("location"), F.when(v == 17, "斜").when(v != 19, "上").alias("direction"), evidence.alias("evidence"),
    )
    rows = t.events.select("event_id", question.alias("question"), answer.alias("answer"), F.when(v != 9, meta).alias("meta"))
    return curation.tag_counts(curation.audit_tags(rows), "event_id").select("tag", "n")


@query("select 'text' as what, count(*) as n, min(length(text)) as shortest, round(avg(length(text)), 1) as mean, max(length(text)) as longest from conversations union all select 'role', count(*), min(length(role)), round(avg(length(role)), 1), max(length(role)) from conversations")
def length_stats(t: Tables) -> DataFrame:
    return curation.length_stats(t.conversations, ["text", "role"])


_TOKENS = r"regexp_extract_all({0}, '[一-鿿]|[A-Za-z0-9]+|[^\s]')"


@query(f"""
with p as (select len({_TOKENS.format('q.text')}) as q, len({_TOKENS.format('a.text')}) as a from conversations q join conversations a on q.conv_id = a.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant'),
n as (select case when q + a + 1 <= 256 then q + a + 1 else least(q, greatest(64, 256 - a - 1)) + case when 256 - a - 1 < 64 then least(a, 256 - 64 - 1) else a end + 1 end as n from p)
select count(*) as n, sum(n)::bigint as tokens, round(avg(n), 1) as mean, max(n) as longest, min(n) as shortest, 0::bigint as skipped from n
""")
def tokenise_stats(t: Tables) -> DataFrame:
    """Token pairs of turns and their answers, cut to 256."""
    return curation.token_stats(curation.pair_tokens(turns(t), 256))


def turns(t: Tables) -> DataFrame:
    q, a = t.conversations.filter("role = 'user'"), t.conversations.filter("role = 'assistant'")
    a = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.select("conv_id", "turn", F.col("text").alias("question")).join(a, ["conv_id", "turn"])


_IDS = "list_transform(" + _TOKENS + ", lambda w: ('0x' || md5(w)[:8])::bigint % 49990 + 10)"
_TURNS = "select q.conv_id, q.turn, q.text as question, a.text as answer from conversations q join conversations a on q.conv_id = a.conv_id and a.turn = q.turn + 1 where q.role = 'user' and a.role = 'assistant'"


@query(f"""
with p as (select conv_id, turn, {_IDS.format('question')} as q, {_IDS.format('answer')} as a from ({_TURNS})),
c as (
  select conv_id, turn, case when len(q) + len(a) + 1 > 256 then q[: greatest(64, 256 - len(a) - 1)] else q end as q, case when len(q) + len(a) + 1 > 256 and 256 - len(a) - 1 < 64 then a[: 191] else a end as a from p)
select conv_id, turn, md5(array_to_string(list_concat(list_concat(q, a), [151643]), ',')) as ids, len(q)::bigint as n_masked from c
""")
def pair_build(t: Tables) -> DataFrame:
    return curation.pair_tokens(turns(t), 256).select("conv_id", "turn", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids"), F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("n_masked"))


@query(f"""
with p as (select conv_id, turn, {_IDS.format("'### 问题：' || chr(10) || trim(question, ' ') || chr(10) || '### 回答：' || chr(10)")} as p, list_append({_IDS.format("trim(answer, ' ')")}, 151643) as a from ({_TURNS})),
c as (select *, least(len(p) + len(a) - 256, len(p)) as d from p),
r as (select conv_id, turn, list_concat(case when d > 0 and len(p) > len(a) then p[d + 1 :] else p end, a)[: 256] as ids from c)
select conv_id, turn, len(ids)::bigint as n, md5(array_to_string(ids, ',')) as ids from r
""")
def prompt_build(t: Tables) -> DataFrame:
    return curation.prompt_tokens(turns(t), 256).select("conv_id", "turn", F.size("input_ids").cast("long").alias("n"), F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids"))


# -- patterns ----------------------------------------------------------------------------------------------------------------------------------


@query("select event_type as action, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 2) as pct from events group by 1")
def action_distribution(t: Tables) -> DataFrame:
    return patterns.distribution(t.events, "event_type", "action")


@query("select (floor(value / 5) * 5)::bigint as bucket, event_type, count(*) as n from events group by all")
def bucket_hist(t: Tables) -> DataFrame:
    return patterns.by_bucket(t.events, "value", "event_type", 5)


@query("with s as (select l_orderkey, count(distinct l_suppkey) as size from lineitem group by 1) select size, count(*) as n from s group by 1")
def setsize_hist(t: Tables) -> DataFrame:
    return patterns.set_sizes(t.lineitem, "l_orderkey", "l_suppkey")


@query("select l_suppkey, l_linestatus, count(*) as n from lineitem group by all order by n desc, l_suppkey, l_linestatus limit 50")
def topk_actions(t: Tables) -> DataFrame:
    return patterns.top_counts(t.lineitem, ["l_suppkey", "l_linestatus"], 50)


@query("select 'listed' as side, l_suppkey, count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000) group by all union all select 'other', l_suppkey, count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 5000) group by all")
def listed_split(t: Tables) -> DataFrame:
    a, b = patterns.listed(t.lineitem, t.supplier.filter("s_acctbal > 5000").select("s_suppkey"), "l_suppkey")
    return a.groupBy(F.lit("listed").alias("side"), "l_suppkey").agg(F.count("*").alias("n")).unionByName(b.groupBy(F.lit("other").alias("side"), "l_suppkey").agg(F.count("*").alias("n")))


@query("select l_linenumber as x, l_quantity::int as y, count(*) as n from lineitem group by all order by n desc, x, y limit 30")
def heat_map(t: Tables) -> DataFrame:
    return patterns.heat_map(t.lineitem.select(F.array("l_linenumber", F.col("l_quantity").cast("int")).alias("location")))


@query("select count(*) as n_rows, count(distinct l_orderkey) as n_stages, count(distinct l_suppkey) as n_operators, count(distinct l_returnflag) as n_actions from lineitem")
def pattern_summary(t: Tables) -> DataFrame:
    return patterns.summary(t.lineitem.select(F.col("l_orderkey").alias("stage"), F.col("l_suppkey").alias("operator"), F.col("l_returnflag").alias("action")))


KINDS = [("secret", ["password", "token"]), ("abuse", ["idiot", "stupid"]), ("plain", ["the"])]


@query("""
with c as (select doc_id, case when contains(lower(text), 'password') then 'secret:password' when contains(lower(text), 'token') then 'secret:token' when contains(lower(text), 'idiot') then 'abuse:idiot' when contains(lower(text), 'stupid') then 'abuse:stupid' when contains(lower(text), 'the') then 'plain:the' else 'other:' end as c from documents)
select doc_id, split_part(c, ':', 1) as category, split_part(c, ':', 2) as keyword from c
""")
def keyword_category(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", video.category(F.col("text"), KINDS).alias("c")).select("doc_id", "c.category", "c.keyword")


# -- sources and sinks -------------------------------------------------------------------------------------------------------------------------


@query("with s as (select case when length(trim(prompt, ' ')) = 0 then 'blank' when trim(prompt, ' ') = trim(chosen, ' ') then 'equal' end as reason from (select text as prompt, case when conv_id % 5 = 0 then text else role end as chosen from conversations)) select coalesce(reason, 'valid') as reason, count(*) as n from s group by 1")
def validated_pairs(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.col("text").alias("prompt"), F.when(F.col("conv_id") % 5 == 0, F.col("text")).otherwise(F.col("role")).alias("rejected"), F.col("text").alias("chosen"))
    good, bad = readers.split_valid(rows, readers.preference_checks())
    return good.select(F.lit("valid").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("with b as (select event_id % 100 as id, event_id as batch, value from events) select id, max(batch) as batch, arg_max(value, batch) as value from b group by id")
def upsert_latest(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("event_id") % 100).alias("id"), F.col("event_id").alias("batch"), "value")
    return writers.upserted(None, rows, "id").select("id", "batch", "value")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def not_done_yet(t: Tables) -> DataFrame:
    return writers.not_done(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("with r as (select o_orderstatus as status, o_orderkey as k, row_number() over (partition by o_orderstatus order by o_orderkey) as r from orders) select status, count(*) as n, string_agg(k::varchar, ',' order by k::varchar) filter (where r <= 10) as items from r group by status")
def run_report(t: Tables) -> DataFrame:
    return writers.run_report(t.orders.select(F.col("o_orderstatus").alias("status"), "o_orderkey"), "o_orderkey", 10)
