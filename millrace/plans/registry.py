"""All queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions, store, streaming
from ..operators import analytics, harness, knowledge, mutate
from ..sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {
    "stream_hourly_counts": streaming.stream_hourly_counts,
    "stream_sessions": streaming.stream_sessions,
    "stream_dedupe": streaming.stream_dedupe,
    "stream_conv_state": streaming.stream_conv_state,
}
ORACLE_SQL: dict[str, str] = {
    "stream_hourly_counts": "select date_trunc('hour', ts) as hour, event_type, count(*) n from events group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 1 hour from events)",
    "stream_sessions": """
with g as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) gap from events),
s as (select user_id, ts, sum(case when gap <= interval 30 minutes then 0 else 1 end) over (partition by user_id order by ts) sid from g)
select user_id, min(ts) as start, count(*) n from s group by user_id, sid having max(ts) + interval 30 minutes <= (select max(ts) - interval 1 hour from events)""",
    "stream_dedupe": "select event_type, count(distinct event_id) n from events group by 1",
    "stream_conv_state": "select user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) last_type, count(*) n from events group by 1",
}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


_REVENUE = "select o_orderdate as day, cast(sum(cast(o_totalprice as decimal(18,2))) as double) revenue from orders group by 1"
_CHANNEL = "(array('website_chat', 'facebook_messenger', 'zalo_oa'))[cast(get_json_object(props, '$.k') as int) % 3]"
_CHANNEL_SQL = "(['website_chat', 'facebook_messenger', 'zalo_oa'])[cast(json_extract(props, '$.k') as int) % 3 + 1]"


@query(_REVENUE)
def revenue_daily(spark, d):
    return analytics.metric_by(table(spark, d, "orders"), [F.col("o_orderdate").alias("day")], revenue=_money("o_totalprice"))


@query(f"""
with r as ({_REVENUE}), z as (
  select *, avg(cast(revenue as double)) over w m, stddev_samp(cast(revenue as double)) over w s from r
  window w as (order by day rows between 28 preceding and 1 preceding))
select day, revenue, round(m, 4) mean_n, round(s, 4) sd_n, coalesce((cast(revenue as double) - m) / nullif(s, 0) < -2, false) is_anomaly,
  'fact' kind, day period_start, day + interval 1 day period_end, 'orders' source
from z""")
def revenue_drop_alert(spark, d):
    r = revenue_daily(spark, d).withColumn("_v", F.col("revenue").cast("double"))
    z = analytics.anomaly_z(r, "day", "_v", 28, 2.0, "low").drop("_v")
    z = z.withColumns({"mean_n": F.round("mean_n", 4), "sd_n": F.round("sd_n", 4), "kind": F.lit("fact"), "period_start": F.col("day"), "source": F.lit("orders")})
    return z.withColumn("period_end", F.expr("day + interval 1 day"))


@query("""
with c as (select date_trunc('hour', ts) as hr, count(*) n from events group by 1), z as (
  select *, avg(n) over w m, stddev_samp(n) over w s from c window w as (order by hr rows between 24 preceding and 1 preceding))
select hr, n, coalesce((n - m) / nullif(s, 0) > 2, false) is_anomaly from z""")
def event_volume_spike(spark, d):
    c = analytics.metric_by(table(spark, d, "events"), [F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hr")], n=F.count("*"))
    return analytics.anomaly_z(c, "hr", "n", 24, 2.0, "high").select("hr", "n", "is_anomaly")


@query("select day, count(*) customers from (select min(o_orderdate) as day from orders group by o_custkey) group by 1")
def new_customers_daily(spark, d):
    first = analytics.first_seen(table(spark, d, "orders"), "o_custkey", "o_orderdate")
    return analytics.metric_by(first, [F.col("first_ts").alias("day")], customers=F.count("*"))


@query("select conv_id, max(turn) last_turn from conversations group by 1 having arg_max(role, turn) = 'user'")
def unanswered_conversations(spark, d):
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("role"))
    return last.filter("role = 'user'").drop("role")


@query("""select o_orderkey, date_diff('day', o_orderdate, (select max(o_orderdate) from orders)) age_days from orders
where o_orderstatus = 'O' and date_diff('day', o_orderdate, (select max(o_orderdate) from orders)) > 90""")
def overdue_open_orders(spark, d):
    orders = table(spark, d, "orders")
    now = orders.agg(F.max("o_orderdate")).scalar()
    return analytics.overdue(orders.filter("o_orderstatus = 'O'"), "o_orderdate", now, 90).select("o_orderkey", "age_days")


@query("""select cast(year(o_orderdate) as bigint) y, cast(week(o_orderdate) as bigint) w, cast(grouping(year(o_orderdate), week(o_orderdate)) as bigint) g,
  cast(sum(cast(o_totalprice as decimal(18,2))) as double) revenue, count(*) orders
from orders group by rollup(year(o_orderdate), week(o_orderdate))""")
def weekly_report_rollup(spark, d):
    o = table(spark, d, "orders").withColumns({"y": F.year("o_orderdate").cast("long"), "w": F.weekofyear("o_orderdate").cast("long")})
    return o.rollup("y", "w").agg(F.grouping_id().cast("long").alias("g"), _money("o_totalprice").alias("revenue"), F.count("*").alias("orders"))


@query(f"""
with c as (select cast(week(ts) as bigint) w, {_CHANNEL_SQL} channel, count(distinct user_id) users from events group by 1, 2)
select w, channel, users from c qualify row_number() over (partition by w order by users desc, channel) = 1""")
def channel_weekly_top(spark, d):
    e = table(spark, d, "events").select(F.weekofyear("ts").cast("long").alias("w"), F.expr(_CHANNEL).alias("channel"), "user_id")
    c = analytics.metric_by(e, ["w", "channel"], users=F.countDistinct("user_id"))
    return analytics.top_per(c, ["w"], [F.col("users").desc(), F.col("channel")], 1).drop("rank")


@query("select l_partkey, cast(sum(cast(l_quantity as decimal(18,2))) as double) quantity from lineitem group by 1 order by quantity desc, l_partkey limit 10")
def top_products(spark, d):
    return analytics.metric_by(table(spark, d, "lineitem"), ["l_partkey"], quantity=_money("l_quantity")).orderBy(F.desc("quantity"), "l_partkey").limit(10)


@query("""
with p as (select c_mktsegment segment, year(o_orderdate) y, cast(o_totalprice as decimal(18,2)) v from orders join customer on o_custkey = c_custkey),
t as (select segment, cast(sum(case when y = 1996 then v else 0 end) as double) total_a, cast(sum(case when y = 1997 then v else 0 end) as double) total_b from p group by 1)
select segment, total_a, total_b, round(total_b - total_a, 2) delta, round((total_b - total_a) / sum(total_b - total_a) over (), 6) share from t""")
def revenue_change_by_segment(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").alias("y"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    c = analytics.contribution(both, "segment", "v", F.col("y") == 1996, F.col("y") == 1997)
    return c.select("segment", *(F.col(x).cast("double").alias(x) for x in ("total_a", "total_b", "delta")), F.round(F.col("share").cast("double"), 6).alias("share"))


@query("select event_type topic, count(distinct user_id) users from events group by 1 having count(distinct user_id) >= 10")
def shared_topic(spark, d):
    return analytics.metric_by(table(spark, d, "events"), [F.col("event_type").alias("topic")], users=F.countDistinct("user_id")).filter("users >= 10")


@query("""select event_id, user_id, ts from events a where event_type = 'view' and not exists (
  select 1 from events b where b.event_type = 'purchase' and b.user_id = a.user_id and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour)""")
def viewed_not_converted(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    asks, buys = (e.filter(F.col("event_type") == k).drop("event_type") for k in ("view", "purchase"))
    return analytics.not_converted(asks, buys.drop("event_id"), "user_id", "ts", 3600)


@query("""select a.event_id view_id, b.event_id buy_id from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase'
  and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour""")
def conversion_range_join(spark, d):
    """Hour buckets make the interval join an equi-join: a view meets the purchases of its own hour and the next."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("h"))
    a = e.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("at"), F.explode(F.array("h", F.col("h") + 1)).alias("h"))
    b = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), "user_id", "ts", "h")
    return a.join(b, ["user_id", "h"]).filter("ts >= at and ts <= at + interval 1 hour").select("view_id", "buy_id")


@query("""select conv_id, turn, next_role, next_length from (select conv_id, turn, role, lead(role) over w next_role, cast(lead(length(text)) over w as bigint) next_length
  from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role is not null""")
def response_gap(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.lead(F.length("text")).over(w).cast("long").alias("next_length"))
    return c.filter("role = 'user' and next_role is not null").drop("role")


@query("""select c_nationkey, c_custkey, c_acctbal, r from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) r from customer) where r <= 3""")
def urgent_customers(spark, d):
    top = analytics.top_per(table(spark, d, "customer"), ["c_nationkey"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 3)
    return top.select("c_nationkey", "c_custkey", "c_acctbal", F.col("rank").cast("long").alias("r"))


@query("""select o_custkey agent_id, o_orderkey version, o_orderdate created_at from orders where o_orderstatus <> 'P'
qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""")
def contract_latest(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("agent_id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "P").alias("active"))
    return harness.latest_contract(o).select("agent_id", "version", "created_at")


@query("""
with f as (select o_custkey k, o_orderdate as since, max(o_totalprice) price from orders group by 1, 2),
l as (select l_orderkey, l_linenumber, l_shipdate, o_custkey k, count(*) n from lineitem join orders on l_orderkey = o_orderkey group by all)
select l_orderkey, l_linenumber, l_shipdate, n, price from l asof left join f on l.k = f.k and l.l_shipdate >= f.since""")
def price_asof_facts(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    n = store.tasks(spark, orders.count() + lines.count())
    left = store.dealt(lines, n, "l_orderkey").join(store.dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "l_linenumber", "l_shipdate", F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    facts = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"))
    return analytics.asof(left, facts, "k", "l_shipdate", "at", ["price"]).drop("k")


@query("select source, count(*) n, round(avg(quality), 6) quality_rate, round(avg(toxic), 6) toxic_rate from labels join documents using (doc_id) group by 1")
def quality_rates(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return analytics.metric_by(both, ["source"], n=F.count("*"), quality_rate=F.round(F.avg("quality"), 6), toxic_rate=F.round(F.avg("toxic"), 6))


@query("select lang, count(*) n, count(*) filter (where quality = 1 and toxic = 0) approved, round(count(*) filter (where quality = 1 and toxic = 0) / count(*), 6) rate from labels join documents using (doc_id) group by 1")
def approval_rates(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    ok = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))
    return analytics.metric_by(both, ["lang"], n=F.count("*"), approved=ok, rate=F.round(F.try_divide(ok, F.count("*")), 6))


@query("select count(*) filter (where quality = 0) flagged, count(*) filter (where quality = 0 and toxic = 1) hits, round(count(*) filter (where quality = 0 and toxic = 1) / count(*) filter (where quality = 0), 6) as prec from labels")
def escalation_precision(spark, d):
    flagged, hits = F.count_if(F.col("quality") == 0), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1))
    return table(spark, d, "labels").agg(flagged.alias("flagged"), hits.alias("hits"), F.round(F.try_divide(hits, flagged), 6).alias("prec"))


@query("select md5(lower(text)) digest, min(doc_id) doc_id, count(*) copies from documents where text is not null group by 1 having count(*) > 1")
def kb_dedupe_exact(spark, d):
    return knowledge.exact_groups(table(spark, d, "documents"))


@query("select source, cast(sum(greatest(ceil(length(text) / 800.0), 1)) as bigint) chunk_count, count(*) docs from documents where length(text) > 0 group by 1")
def kb_chunk_counts(spark, d):
    docs = table(spark, d, "documents").filter("length(text) > 0")
    return analytics.metric_by(docs, ["source"], chunk_count=F.sum(knowledge.chunk_count(F.col("text"))), docs=F.count("*"))


@query(r"""select page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) host, cast(len(regexp_extract_all(html, 'href="')) as bigint) n_links,
  cast(length(trim(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->|<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) as bigint) text_chars from pages""")
def kb_link_extract(spark, d):
    return knowledge.links(table(spark, d, "pages"))


@query("""select q.vec_id query_id, v.vec_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) / sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])), 4) score,
  row_number() over (partition by q.vec_id order by score desc, v.vec_id) as rank
from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0 qualify rank <= 5""")
def kb_topk_cosine(spark, d):
    v = table(spark, d, "embeddings")
    return knowledge.top_cosine(v.filter("vec_id % 100 = 0"), v).withColumn("rank", F.col("rank").cast("long"))


_WORD = "[A-Z][a-z]{9,}"


@query(f"select entity, count(distinct doc_id) docs from (select doc_id, unnest(regexp_extract_all(text, '{_WORD}')) entity from documents) group by 1")
def kb_entities(spark, d):
    return analytics.metric_by(knowledge.entities(table(spark, d, "documents"), _WORD), ["entity"], docs=F.count("*"))


@query(f"""with e as (select distinct doc_id, unnest(regexp_extract_all(text, '{_WORD}')) entity from documents),
p as (select doc_id, entity, lead(entity) over (partition by doc_id order by entity) other from e)
select entity src, other dst, count(*) docs from p where other is not null group by 1, 2 having count(*) >= 2""")
def kb_edges(spark, d):
    """Neighbouring entities of a document, by name: as many edges as entities, no pairs within a document. Not co-occurrence, see kb_cooccurrence."""
    e = knowledge.entities(table(spark, d, "documents"), _WORD)
    p = e.withColumn("dst", F.lead("entity").over(Window.partitionBy("doc_id").orderBy("entity"))).filter("dst is not null")
    return analytics.metric_by(p, [F.col("entity").alias("src"), "dst"], docs=F.count("*")).filter("docs >= 2")


_NAMES = rf"""w as (select row_number() over () r, doc_id, regexp_extract_all(text, '{knowledge.WORD}') w from documents),
o as (select * from (select r, doc_id, unnest(w) entity, generate_subscripts(w, 1) pos from w) where regexp_matches(entity, '{knowledge.NAME}'))"""


@query(f"with {_NAMES} select entity, count(distinct doc_id) docs from o group by 1")
def kb_names(spark, d):
    return analytics.metric_by(knowledge.names(table(spark, d, "documents")), ["entity"], docs=F.count_distinct("doc_id"))


@query(f"""with {_NAMES} select least(a.entity, b.entity) src, greatest(a.entity, b.entity) dst, count(distinct a.doc_id) docs
from o a join o b on a.r = b.r and b.pos - a.pos between 1 and 10 and a.entity <> b.entity group by 1, 2 having count(distinct a.doc_id) >= 2""")
def kb_cooccurrence(spark, d):
    """Names within ten words of each other; names further apart don't count, unlike in full co-occurrence by document."""
    return knowledge.cooccurrence(table(spark, d, "documents")).filter("docs >= 2")


@query("select doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]') email, regexp_matches(text, '(?i)(api[_-]?key|secret|token|password) *[=:]') secret, regexp_matches(text, '[0-9]{13}') card from documents")
def guardrail_pii_secret(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", t.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]").alias("email"), t.rlike(r"(?i)(api[_-]?key|secret|token|password) *[=:]").alias("secret"), t.rlike("[0-9]{13}").alias("card"))


_GUARD_SQL = f"""
with c as (select *, cast(json_extract(props, '$.k') as int) k from events), r as (
select event_id, list_filter([
  case when user_id % 50 = 0 then 'tenant' end, case when event_type not in ('view', 'click', 'signup') then 'permission' end, case when k % 10 = 0 then 'schema' end,
  case when k % 13 = 0 then 'internal_info' end, case when k % 17 = 0 then 'discount_or_refund' end, case when k / 100.0 < 0.2 then 'confidence' end, case when k >= 90 then 'source' end], x -> x is not null) reasons,
  k % 17 = 0 or k / 100.0 < 0.2 needs_approval, k % 19 = 0 escalate from c)
""".replace("list_filter([", "[x for x in [").replace("], x -> x is not null)", "] if x is not null]")


def _guarded(spark, d):
    """Tool calls made of events: the keyed number k sets what each call violates."""
    k = F.get_json_object("props", "$.k").cast("int")
    calls = table(spark, d, "events").select(F.col("event_id").alias("tool_call_id"), F.lit("t1").alias("tenant_id"), F.col("ts").alias("created_at"), F.when(F.col("user_id") % 50 == 0, "t2").otherwise("t1").alias("agent_tenant_id"), F.lit("a").alias("agent_id"), F.col("event_type").alias("tool_name"), F.when(k % 10 == 0, '{"x":1}').otherwise('{"summary":1}').alias("output"), F.when(k % 13 == 0, "token = x").otherwise("fine").alias("text"), (k / 100.0).cast("double").alias("confidence"), F.when(k % 17 == 0, F.array(F.lit("refund"))).otherwise(F.array(F.lit("reply"))).alias("tags"), F.when(k % 19 == 0, F.array(F.lit("legal"))).otherwise(F.array(F.lit("calm"))).alias("flags"), F.array(k).cast("array<string>").alias("sources"))
    contract = spark.createDataFrame([("a", "1", ["view", "click", "signup"], ["refund"], ["legal"], '{"summary":"string"}', True, 1)], "agent_id string, version string, allowed_tools array<string>, requires_approval array<string>, must_escalate_when array<string>, output_schema string, active boolean, created_at int")
    return harness.guard(calls, contract, spark.range(90).select(F.col("id").cast("string").alias("chunk_id")), 0.2)


@query(_GUARD_SQL + "select event_id tool_call_id, len(reasons) = 0 passed, array_to_string(reasons, ',') reasons from r")
def guardrail_reasons(spark, d):
    return _guarded(spark, d).select("tool_call_id", "guardrail_result.passed", F.array_join("guardrail_result.reasons", ",").alias("reasons"))


@query(_GUARD_SQL + "select event_id tool_call_id, case when escalate then 'takeover' when len(reasons) > 0 or needs_approval then 'draft' else 'auto_reply' end as mode from r")
def route_response(spark, d):
    return harness.route(_guarded(spark, d)).select("tool_call_id", "mode")


@query("select item_id, count(*) docs from documents join benchmark b on contains(documents.text, b.text) group by 1")
def eval_contains(spark, d):
    return analytics.metric_by(knowledge.containing(table(spark, d, "documents"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))), ["item_id"], docs=F.count("*"))


@query(f"select event_id, {_CHANNEL_SQL} channel, user_id from events")
def unify_inbox(spark, d):
    """One scan: the channels' rows lie in one table, with the channel as a column."""
    return table(spark, d, "events").select("event_id", F.expr(_CHANNEL).alias("channel"), "user_id")


@query("""select user_id, event_type, value from events where event_type <> 'error' qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
union all select c_custkey, 'none', 0.0 from customer where c_custkey not in (select user_id from events where event_type <> 'error' and user_id is not null)""")
def upsert_latest(spark, d):
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("none").alias("event_type"), F.lit(0.0).alias("value"))
    changes = table(spark, d, "events").filter("event_type <> 'error'").withColumn("op", F.lit("upsert"))
    return mutate.upsert(current, changes, ["user_id"], ["ts", "event_id"])


@query("select source, count(*) docs, cast(sum(n_chars) as bigint) chars from documents where source = 'src3' group by 1")
def tenant_isolation(spark, d):
    return analytics.metric_by(table(spark, d, "documents", tenant="src3"), ["source"], docs=F.count("*"), chars=F.sum("n_chars"))


@query("""
with e as (select user_id, ts, event_id, case event_type when 'view' then 'processing' when 'purchase' then 'ready' else 'failed' end t from events where event_type in ('view', 'purchase', 'error')),
f as (select user_id, list(t order by ts, event_id) l from e group by 1)
select user_id, list_reduce(list_prepend('pending', l), lambda s, t: case when s || t in ('pendingprocessing', 'processingready', 'processingfailed', 'failedprocessing') then t else s end) status from f""")
def document_status(spark, d):
    to = F.when(F.col("event_type") == "view", "processing").when(F.col("event_type") == "purchase", "ready").otherwise("failed")
    e = table(spark, d, "events").filter("event_type in ('view', 'purchase', 'error')").withColumn("to", to)
    machine = {"pending": ["processing"], "processing": ["ready", "failed"], "failed": ["processing"]}
    return mutate.fold_status(e, "user_id", ["ts", "event_id"], machine, "pending").drop("n_ignored")


@query("""with f(filename) as (values ('0002_b.py'), ('0001_a.py'), ('__init__.py'), ('x.txt'), ('0003_c.py')), a(filename) as (values ('0001_a.py'))
select filename from f where ends_with(filename, '.py') and filename <> '__init__.py' and filename not in (select filename from a)""")
def migration_pending(spark, d):
    files = spark.createDataFrame([("0002_b.py",), ("0001_a.py",), ("__init__.py",), ("x.txt",), ("0003_c.py",)], "filename string")
    return mutate.pending(files, spark.createDataFrame([("0001_a.py",)], "filename string"))


@query("""with r(filename, has_run, ok) as (values ('0001_a.py', true, true), ('0002_b.py', true, null), ('0003_c.py', false, null), ('0004_d.py', true, false), ('0005_e.py', true, true)),
b as (select *, has_run and not coalesce(ok, true) failed, coalesce(bool_or(has_run and not coalesce(ok, true)) over (order by filename rows between unbounded preceding and 1 preceding), false) earlier from r)
select filename, has_run, ok, case when earlier then 'not_run' when not has_run then 'skipped' when failed then 'failed' else 'applied' end status from b""")
def migration_prefix_stop(spark, d):
    rows = [("0001_a.py", True, True), ("0002_b.py", True, None), ("0003_c.py", False, None), ("0004_d.py", True, False), ("0005_e.py", True, True)]
    return mutate.run_prefix(spark.createDataFrame(rows, "filename string, has_run boolean, ok boolean"), "filename", "ok", "has_run")


@query(f"""with v(email, password) as (values ('', 'a'), ('a@b.co', 'secret'), ('a@b', null))
select email, password, concat_ws(', ', case when not coalesce(regexp_matches(email, '{functions.EMAIL}'), false) then '''email'': invalid email' end, case when coalesce(length(password), 0) < 6 then '''password'': too short' end) message from v""")
def validation_messages(spark, d):
    df = spark.createDataFrame([("", "a"), ("a@b.co", "secret"), ("a@b", None)], "email string, password string")
    return mutate.validate(df, [("email", F.col("email").rlike(functions.EMAIL), "invalid email"), ("password", F.length("password") >= 6, "too short")]).drop("errors")


@query("select o_orderstatus, o_orderpriority, cast(grouping(o_orderstatus, o_orderpriority) as bigint) g, count(*) n, count(distinct o_custkey) customers from orders group by cube(o_orderstatus, o_orderpriority)")
def surface_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("g"), F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("select user_id id, 'both' k from events intersect select c_custkey, 'both' from customer union all select * from (select c_custkey id, 'idle' k from customer except select user_id, 'idle' from events)")
def surface_setops(spark, d):
    users, customers = table(spark, d, "events").select(F.col("user_id").alias("id")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return users.intersect(customers).withColumn("k", F.lit("both")).union(customers.subtract(users).withColumn("k", F.lit("idle")))


@query("""select o_orderkey, ntile(4) over (partition by o_orderpriority order by o_totalprice, o_orderkey) quartile,
  count(*) over (partition by o_custkey order by o_orderdate range between interval 30 days preceding and current row) recent from orders""")
def surface_frames(spark, d):
    near = Window.partitionBy("o_custkey").orderBy(F.datediff("o_orderdate", F.lit("1970-01-01"))).rangeBetween(-30, 0)
    orders = store.ranked(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"), "o_orderpriority", ["o_totalprice", "o_orderkey"], "r", "n", "frames")
    quartile = F.expr("if(r < n % 4 * (n div 4 + 1), r div (n div 4 + 1), n % 4 + (r - n % 4 * (n div 4 + 1)) div greatest(n div 4, 1)) + 1")  # the first n % 4 have one row more
    return orders.select("o_orderkey", quartile.alias("quartile"), F.count("*").over(near).alias("recent"))


@query("select p_partkey, unnest(string_split(p_type, ' ')) word from part")
def surface_udtf(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))


@query("""select c_custkey, cast(date_diff('day', max(o_orderdate), (select max(o_orderdate) from orders)) as bigint) recency, count(*) frequency, cast(sum(cast(o_totalprice as decimal(18,2))) as double) monetary
from orders join customer on o_custkey = c_custkey group by 1""")
def customer_rfm(spark, d):
    orders = table(spark, d, "orders")
    now = orders.agg(F.max("o_orderdate")).scalar()
    return analytics.metric_by(orders.select("o_orderdate", "o_totalprice", F.col("o_custkey").alias("c_custkey")).join(table(spark, d, "customer").select("c_custkey"), "c_custkey"), ["c_custkey"], recency=F.datediff(now, F.max("o_orderdate")).cast("long"), frequency=F.count("*"), monetary=_money("o_totalprice"))


from . import live, named, past, people, product, rollups, search, spoken  # noqa: E402, F401  register their queries
