"""Queries of the product views, sinks, machines and small rows of the survey, with their SQL; registered by plans.registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .. import functions, sinks, streaming
from ..operators import analytics, knowledge, mutate, product
from ..sources import events_stream, table
from . import registry
from .registry import query

_K = "cast(json_extract(props, '$.k') as int)"
_CHANNEL, _CHANNEL_SQL = registry._CHANNEL, registry._CHANNEL_SQL


def _events(spark, d):
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _decided():
    return F.when(F.col("k") % 4 == 0, "approved").when(F.col("k") % 4 == 1, "edited").when(F.col("k") % 4 == 2, "rejected")


@query(f"""with r as (select event_type agent, {_K} k, case {_K} % 4 when 0 then 'approved' when 1 then 'edited' when 2 then 'rejected' end decision from events)
select agent, count(*) runs, round(count(*) filter (where decision = 'approved') / count(decision), 6) approval_rate, round(count(*) filter (where decision = 'edited') / count(decision), 6) edit_rate,
  round(count(*) filter (where decision = 'rejected') / count(decision), 6) reject_rate, round(avg(k / 100.0::double), 6) mean_confidence, round(count(*) filter (where k % 13 = 0) / count(*), 6) guardrail_failure_rate
from r group by 1""")
def agent_metrics(spark, d):
    runs = _events(spark, d).select(F.col("event_type").alias("agent"), _decided().alias("decision"), (F.col("k") / 100.0).cast("double").alias("confidence"), (F.col("k") % 13 != 0).alias("passed"))
    return product.decision_rates(runs, ["agent"])


@query(f"""
with e as (select *, {_K} k from events), l as (select conv_id, arg_max(role, turn) role from conversations group by 1),
m as (select 'workspaces' metric, count(distinct c_nationkey)::double v from customer
union all select 'onboarding_rate', count(*) filter (where c_custkey in (select o_custkey from orders)) / count(*) from customer
union all select 'kb_documents', count(*) from documents union all select 'handled_conversations', count(*) filter (where role = 'assistant') from l
union all select 'drafts', count(*) filter (where k % 17 = 0) from e union all select 'draft_approval_rate', count(*) filter (where k % 17 = 0 and k % 4 = 0) / count(*) filter (where k % 17 = 0) from e
union all select 'takeover_rate', count(*) filter (where k % 19 = 0) / count(*) from e
union all select 'briefing_reads', count(*) filter (where event_type = 'view') from e union all select 'briefing_clicks', count(*) filter (where event_type = 'click') from e)
select metric, round(v, 6) as value from m""")
def product_metrics(spark, d):
    e, customers = _events(spark, d), table(spark, d, "customer")
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_in", F.lit(1))
    last = table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"))
    draft = F.col("k") % 17 == 0
    return product.metric_rows([
        (customers.join(buyers, "c_custkey", "left"), {"workspaces": F.count_distinct("c_nationkey"), "onboarding_rate": F.try_divide(F.count("_in"), F.count("*"))}),
        (table(spark, d, "documents"), {"kb_documents": F.count("*")}),
        (last, {"handled_conversations": F.count_if(F.col("role") == "assistant")}),
        (e, {
            "drafts": F.count_if(draft),
            "draft_approval_rate": F.try_divide(F.count_if(draft & (F.col("k") % 4 == 0)), F.count_if(draft)),
            "takeover_rate": F.try_divide(F.count_if(F.col("k") % 19 == 0), F.count("*")),
            "briefing_reads": F.count_if(F.col("event_type") == "view"),
            "briefing_clicks": F.count_if(F.col("event_type") == "click"),
        }),
    ])


_ANSWERS = """m as (select *, min(case when event_type = 'click' then ts end) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) answered_at
from events where event_type in ('view', 'click'))"""


@query(f"with {_ANSWERS} select event_id, answered_at from m where event_type = 'view'")
def response_time(spark, d):
    m = table(spark, d, "events").filter("event_type in ('view', 'click')").select("event_id", "user_id", "ts", "event_type")
    return product.response_times(m, "user_id", ["ts", "event_id"], "event_type", "view", "click").select("event_id", "answered_at")


@query(f"""with {_ANSWERS}, w as (select cast(week(ts) as bigint) w, count(*) asked, round(count(*) filter (where answered_at is null or answered_at > ts + interval 1 day) / count(*), 6) missed_rate,
  round(avg((epoch_us(answered_at) - epoch_us(ts)) / 60000000.0::double), 4) mean_minutes from m where event_type = 'view' group by 1)
select *, round(mean_minutes - lag(mean_minutes) over (order by w), 4) change_minutes from w""")
def business_outcomes(spark, d):
    m = table(spark, d, "events").filter("event_type in ('view', 'click')").select("event_id", "user_id", "ts", "event_type")
    r = product.response_times(m, "user_id", ["ts", "event_id"], "event_type", "view", "click")
    minutes = (F.unix_micros(F.col("answered_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(6e7)
    missed = F.count_if(F.col("answered_at").isNull() | (F.col("answered_at") > F.col("ts") + F.expr("interval 1 day")))
    w = analytics.metric_by(r, [F.weekofyear("ts").cast("long").alias("w")], asked=F.count("*"), missed_rate=F.round(F.try_divide(missed, F.count("*")), 6), mean_minutes=F.round(F.avg(minutes), 4))
    return w.withColumn("change_minutes", F.round(F.col("mean_minutes") - F.lag("mean_minutes").over(Window.partitionBy().orderBy("w")), 4))  # a row a week


@query("select conv_id conversation_id, c_name customer, count(*) messages, max(turn) last_turn, arg_max(role, turn) last_role from conversations left join customer on c_custkey = conv_id group by 1, 2")
def conversation_overview(spark, d):
    turns = table(spark, d, "conversations").withColumnRenamed("conv_id", "conversation_id")
    convs = turns.select("conversation_id", F.col("conversation_id").alias("customer_id")).distinct()
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer"))
    return product.conversation_view(convs, turns, customers).drop("customer_id")


@query(f"""with a as (select user_id, {_CHANNEL_SQL} channel from events), b as (select user_id, channel, case when channel = 'zalo_oa' then 'U' else 'u' end || cast(user_id % 500 as varchar) || '@mail.example' email from a where user_id is not null)
select lower(email) email, count(distinct user_id) accounts, array_to_string(list_sort(list(distinct channel)), ',') channels from b group by 1""")
def contacts_unified(spark, d):
    a = table(spark, d, "events").filter("user_id is not null").select("user_id", F.expr(_CHANNEL).alias("channel"))
    email = F.concat(F.when(F.col("channel") == "zalo_oa", "U").otherwise("u"), (F.col("user_id") % 500).cast("string"), F.lit("@mail.example"))
    return product.contacts(a.select(F.col("user_id").alias("account_id"), "channel", email.alias("email")))


@query("select strftime(ts, '%Y-%m-%d') as day, case when event_type = 'error' then 'failed' else 'completed' end status, count(*) n from events group by 1, 2")
def runs_by_status(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status")
    return analytics.metric_by(table(spark, d, "events"), [F.date_format("ts", "yyyy-MM-dd").alias("day"), status], n=F.count("*"))


@query(f"""with e as (select {_CHANNEL_SQL} channel, ts, event_type = 'error' error from events)
select channel, count(*) syncs, count(*) filter (where error) errors, max(ts) filter (where not error) last_sync,
  coalesce(max(ts) filter (where not error) < (select max(ts) from events) - interval 10 minutes, true) stale from e group by 1""")
def integration_health(spark, d):
    e = table(spark, d, "events").select(F.expr(_CHANNEL).alias("channel"), "ts", (F.col("event_type") == "error").alias("error"))
    return product.health(e, "channel", "10 minutes")


@query(f"""with z as ({registry.ORACLE_SQL["revenue_drop_alert"]}), o as ({registry.ORACLE_SQL["overdue_open_orders"]}), a as (
select 1 priority, 'overdue' kind, cast(o_orderkey as varchar) ref, age_days::double weight from o
union all select 2, 'anomaly', strftime(day, '%Y-%m-%d'), 0.0 from z where is_anomaly
union all select 3, 'approval', cast(event_id as varchar), {_K}::double from events where {_K} % 17 = 0)
select priority, kind, ref, weight from (select *, row_number() over (partition by priority order by weight desc, ref) n from a) where n <= 4 order by priority, weight desc, ref limit 10""")
def suggested_actions(spark, d):
    overdue = registry.overdue_open_orders(spark, d).select(F.col("o_orderkey").cast("string").alias("ref"), F.col("age_days").alias("weight"))
    drops = registry.revenue_drop_alert(spark, d).filter("is_anomaly").select(F.date_format("day", "yyyy-MM-dd").alias("ref"), F.lit(0.0).alias("weight"))
    waiting = _events(spark, d).filter("k % 17 = 0").select(F.col("event_id").cast("string").alias("ref"), F.col("k").alias("weight"))
    best = [df.orderBy(F.desc("weight"), "ref").limit(4) for df in (overdue, drops, waiting)]
    return product.actions([(i + 1, kind, df) for i, (kind, df) in enumerate(zip(("overdue", "anomaly", "approval"), best, strict=True))], 10)


@query(f"""with z as ({registry.ORACLE_SQL["revenue_drop_alert"]})
select 'Revenue drop' title, 'Revenue fell on ' || strftime(day, '%Y-%m-%d') body, 'analyst' agent, day + interval 1 day created_at, '/reports/revenue' cta from z where is_anomaly""")
def briefing_feed(spark, d):
    """Items are appended under the batch's name, twice, and read back, the newest first."""
    z = registry.revenue_drop_alert(spark, d).filter("is_anomaly")
    items = z.select(F.lit("Revenue drop").alias("title"), F.concat(F.lit("Revenue fell on "), F.date_format("day", "yyyy-MM-dd")).alias("body"), F.lit("analyst").alias("agent"), F.expr("day + interval 1 day").alias("created_at"), F.lit("/reports/revenue").alias("cta"))
    sink = sinks.Log(spark, "briefing")
    for _ in range(2):
        sink.append("morning", items)
    return product.feed(sink.read(items.schema))


@query(registry._GUARD_SQL + "select strftime(ts, '%Y-%m-%d') as day, count(*) calls, count(*) filter (where len(reasons) > 0) failed from r join events using (event_id) group by 1")
def audit_log(spark, d):
    """One row for each guarded call, appended to a log by day, then summed by day."""
    calls = registry._guarded(spark, d).select("tool_call_id", "agent_id", "tool_name", "confidence", "escalate", "guardrail_result.passed", F.date_format("created_at", "yyyy-MM-dd").alias("day"))
    sink = sinks.Log(spark, "audit", by="day")
    sink.append("all", calls)
    return analytics.metric_by(sink.read(calls.schema), ["day"], calls=F.count("*"), failed=F.count_if(~F.col("passed")))


@query("select 'task-' || conv_id task_id, conv_id, max(turn) + 1 due_turn from conversations group by conv_id having arg_max(role, turn) = 'user'")
def follow_up_tasks(spark, d):
    open_ = registry.unanswered_conversations(spark, d)
    tasks = open_.select(F.concat(F.lit("task-"), F.col("conv_id").cast("string")).alias("task_id"), "conv_id", (F.col("last_turn") + 1).alias("due_turn"))
    sink = sinks.Log(spark, "tasks")
    sink.append("calls", tasks)
    return sink.read(tasks.schema)


@query("select r_regionkey, r_name from region")
def export_snapshot(spark, d):
    """A table written as JSON and read back."""
    region = table(spark, d, "region")
    return sinks.exported(region, "json")


@query(f"select event_id tool_call_id, event_type agent_id, 'refund needs approval' reason, 'value ' || cast({_K} as varchar) as content, cast({_K} as varchar) sources, {_K} / 100.0::double confidence from events where {_K} % 17 = 0")
def approval_inbox(spark, d):
    e = _events(spark, d)
    runs = e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("agent_id"), (F.col("k") / 100.0).cast("double").alias("confidence"))
    calls = e.select(F.col("event_id").alias("run_id"), F.col("event_id").alias("tool_call_id"), F.concat(F.lit("value "), F.col("k").cast("string")).alias("content"), F.col("k").cast("string").alias("sources"))
    approvals = e.select(F.col("event_id").alias("tool_call_id"), F.when(F.col("k") % 17 == 0, "pending").otherwise("approved").alias("status"), F.lit("refund needs approval").alias("reason"))
    return product.approval_cards(calls, approvals, runs)


@query("""with m as (select *, max(turn) over (partition by conv_id) last from conversations)
select case when role = 'assistant' and turn = last then 'draft' else 'sent' end kind, count(*) n from m group by 1""")
def drafts_and_sent(spark, d):
    m = table(spark, d, "conversations")
    last = m.groupBy("conv_id").agg(F.max("turn").alias("last"))
    kind = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), "draft").otherwise("sent")
    return analytics.metric_by(m.join(last, "conv_id"), [kind.alias("kind")], n=F.count("*"))


_AGENTS = [("view", True, "active"), ("click", False, "active"), ("signup", True, "paused"), ("purchase", True, "active")]


@query("select event_type agent, count(*) runs from events where event_type in ('view', 'purchase') group by 1")
def active_agent_runs(spark, d):
    agents = product.usable(spark.createDataFrame(_AGENTS, "agent string, enabled boolean, status string"))
    runs = table(spark, d, "events").select(F.col("event_type").alias("agent")).join(F.broadcast(agents), "agent", "left_semi")
    return analytics.metric_by(runs, ["agent"], runs=F.count("*"))


@query("select c_custkey, case when c_acctbal > 9000 then 'VIP' else c_mktsegment end c_mktsegment, c_acctbal, c_acctbal > 9000 is_active from customer")
def customer_patch(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.lit(False).alias("is_active"))
    return mutate.patch(c, c.filter("c_acctbal > 9000").select("c_custkey", F.lit("VIP").alias("c_mktsegment"), F.lit(True).alias("is_active")), ["c_custkey"])


@query("""select 'region-' || r_regionkey id, 0 hop from region where r_regionkey = 2
union all select 'nation-' || n_nationkey, 1 from nation where n_regionkey = 2
union all select 'customer-' || c_custkey, 2 from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2
union all select 'supplier-' || s_suppkey, 2 from supplier join nation on s_nationkey = n_nationkey where n_regionkey = 2""")
def graph_traversal(spark, d):
    def edges(name, a, ka, b, kb):
        return table(spark, d, name).select(F.concat(F.lit(f"{a}-"), F.col(ka)).alias("src"), F.concat(F.lit(f"{b}-"), F.col(kb)).alias("dst"))

    every = edges("nation", "region", "n_regionkey", "nation", "n_nationkey").union(edges("customer", "nation", "c_nationkey", "customer", "c_custkey")).union(edges("supplier", "nation", "s_nationkey", "supplier", "s_suppkey"))
    return knowledge.neighbours(every, spark.createDataFrame([("region-2",)], "id string"), 2)


_KEY = b"channel secret"


@query(f"select {_CHANNEL_SQL} channel, count(*) n from events where event_id % 7 <> 0 group by 1")
def stream_webhooks(spark, d):
    """Deliveries as a stream; those whose signature isn't their body's are dropped before anything is written."""
    signature = F.when(F.col("event_id") % 7 != 0, functions.hmac_sha256(F.col("props"), _KEY)).otherwise("forged")
    arriving = events_stream(spark, d).withColumn("signature", signature)
    out = streaming.drained(streaming.signed(arriving, "props", "signature", _KEY).select(F.expr(_CHANNEL).alias("channel")))
    return analytics.metric_by(out, ["channel"], n=F.count("*"))


def _fold_sql(states: str, kinds: str, allowed: list[str], start: str) -> str:
    return f"""with e as (select user_id, ts, event_id, {states} t from events where event_type in ({kinds})),
f as (select user_id, list(t order by ts, event_id) l from e group by 1)
select user_id, list_reduce(list_prepend('{start}', l), lambda s, t: case when s || '>' || t in ({", ".join(f"'{a}'" for a in allowed)}) then t else s end) status from f"""


def _state(names: dict[str, str]) -> str:
    return "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + " end"


def _machine_sql(names: dict[str, str], transitions: dict[str, list[str]], start: str) -> str:
    return _fold_sql(_state(names), ", ".join(f"'{k}'" for k in names), [f"{a}>{b}" for a, bs in transitions.items() for b in bs], start)


CONVERSATION = {"new": ["open"], "open": ["waiting", "takeover", "resolved"], "waiting": ["open", "takeover", "resolved"], "takeover": ["open", "resolved"], "resolved": ["open"]}
_CONVERSED = {"view": "open", "click": "waiting", "error": "takeover", "purchase": "resolved"}
RUN = {"queued": ["running", "cancelled"], "running": ["completed", "failed", "cancelled"], "failed": ["queued"]}
_RAN = {"view": "running", "purchase": "completed", "error": "failed", "signup": "cancelled", "click": "queued"}
INVITATION = {"pending": ["accepted", "declined"]}
_INVITED = {"purchase": "accepted", "error": "declined"}


@query(_machine_sql(_CONVERSED, CONVERSATION, "new"))
def stream_conv_machine(spark, d):
    """The conversation machine, with takeover and release, as a stream."""
    e = events_stream(spark, d).filter(F.col("event_type").isin(*_CONVERSED)).withColumn("to", F.expr(_state(_CONVERSED)))
    return streaming.machine(e, "user_id", ["ts", "event_id"], CONVERSATION, "new").select("user_id", "status")


@query(_machine_sql(_RAN, RUN, "queued"))
def run_status(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin(*_RAN)).withColumn("to", F.expr(_state(_RAN)))
    return mutate.fold_status(e, "user_id", ["ts", "event_id"], RUN, "queued").drop("n_ignored")


@query(_machine_sql(_INVITED, INVITATION, "pending"))
def invitation_status(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin(*_INVITED)).withColumn("to", F.expr(_state(_INVITED)))
    return mutate.fold_status(e, "user_id", ["ts", "event_id"], INVITATION, "pending").drop("n_ignored")


@query(registry.ORACLE_SQL["stream_dedupe"])
def stream_live_feed(spark, d):
    """The same rows by a trigger of one second."""
    out = streaming.drained(streaming.once(events_stream(spark, d), "event_id"), every="1 second")
    return analytics.metric_by(out, ["event_type"], n=F.count("*"))


@query(registry.ORACLE_SQL["stream_dedupe"])
def stream_incremental(spark, d):
    """Pulled twice from one checkpoint: the second pull finds nothing new."""
    folder = sinks.folder(spark, "pull")
    for _ in range(2):
        out = streaming.drained(streaming.once(events_stream(spark, d), "event_id"), checkpoint=folder)
    return analytics.metric_by(out, ["event_type"], n=F.count("*"))


@query("""select to_json({'code': '000', 'message': 'ok', 'data': {'uid': 'u' || c_custkey, 'email': lower(c_name) || '@mail.example', 'name': c_name}})::varchar created,
  to_json({'code': '000', 'message': 'ok', 'data': {'user_id': c_custkey, 'updated': true}})::varchar updated, to_json({'code': '000', 'message': 'ok', 'data': {'user_id': c_custkey, 'deleted': true}})::varchar deleted from customer""")
def user_echo(spark, d):
    say = lambda data: functions.envelope(F.lit("000"), F.lit("ok"), data)
    uid, name = F.col("c_custkey"), F.col("c_name")
    created = F.struct(F.concat(F.lit("u"), uid.cast("string")).alias("uid"), F.concat(F.lower(name), F.lit("@mail.example")).alias("email"), name.alias("name"))
    done = lambda what: F.struct(uid.alias("user_id"), F.lit(True).alias(what))
    return table(spark, d, "customer").select(say(created).alias("created"), say(done("updated")).alias("updated"), say(done("deleted")).alias("deleted"))


@query("select event_id, 'ws-' || (epoch_us(ts) // 1000) workspace_id, 'W' || user_id as name, 'Unknown' industry, left(event_type || '.py', length(event_type || '.py') - 3) stem from events where event_type = 'signup'")
def workspace_rows(spark, d):
    e = table(spark, d, "events").filter("event_type = 'signup'")
    return e.select("event_id", functions.time_id("ws", F.col("ts")).alias("workspace_id"), F.concat(F.lit("W"), F.col("user_id").cast("string")).alias("name"), F.lit("Unknown").alias("industry"), functions.stem(F.concat("event_type", F.lit(".py"))).alias("stem"))


@query(r"""select conv_id conversation_id, left(arg_min(case when role = 'user' then text end, case when role = 'user' then turn end), 80) summary,
  count(*) filter (where regexp_matches(text, '[0-9]')) todos, avg(len(regexp_extract_all(text, '[^ \t\n]+'))) < 12 low_confidence from conversations group by 1""")
def transcript_rules(spark, d):
    return product.transcripts(table(spark, d, "conversations").withColumnRenamed("conv_id", "conversation_id"), "[0-9]", 12)


_RULES = [("price", "[0-9]"), ("booking", "^a|^d"), ("complaint", "q|x"), ("return", "zz|ck")]


@query("select conv_id, turn, case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{n}'" for n, p in _RULES) + " else 'other' end intent from conversations")
def intent_labels(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", functions.intent(F.col("text"), _RULES).alias("intent"))


@query(f"with t as ({registry.ORACLE_SQL['kb_topk_cosine']}) select vec_id query_id, coalesce((select cast(t.vec_id as varchar) from t where t.query_id = q.vec_id and t.rank = 1 and t.score >= 0.5), 'no_answer') answer from embeddings q where q.vec_id % 100 = 0")
def kb_answers(spark, d):
    v = table(spark, d, "embeddings")
    q = v.filter("vec_id % 100 = 0")
    return knowledge.answer(knowledge.top_cosine(q, v, 1), q, 0.5)


@query("select o_orderkey, o_custkey from orders where o_custkey % 10 <> 3")
def erase_customers(spark, d):
    gone = table(spark, d, "customer").filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("o_custkey"))
    return mutate.erase({"orders": table(spark, d, "orders")}, "o_custkey", gone)["orders"].select("o_orderkey", "o_custkey")


@query("select event_type as action, case when user_id % 2 = 0 then 'Owner' else 'Viewer' end as role, count(*) n from events where user_id % 2 = 0 or event_type = 'view' group by 1, 2")
def role_permissions(spark, d):
    from ..operators import harness

    grants = [("Owner", a) for a in ("view", "click", "signup", "purchase", "error")] + [("Viewer", "view")]
    acts = table(spark, d, "events").filter("user_id is not null").select(F.col("event_type").alias("action"), F.when(F.col("user_id") % 2 == 0, "Owner").otherwise("Viewer").alias("role"))
    return analytics.metric_by(harness.permitted(acts, spark.createDataFrame(grants, "role string, action string")), ["action", "role"], n=F.count("*"))


@query("select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def order_page(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)


@query(rf"""with c as (select source, count(*) docs, cast(sum(ceil(length(text) / 800.0)) as bigint) chunk_count from documents where length(text) > 0 group by 1),
w as (select doc_id, source, unnest(regexp_extract_all(text, '{knowledge.WORD}')) entity from documents),
e as (select source, count(*) entity_count from (select distinct doc_id, source, entity from w where regexp_matches(entity, '{knowledge.NAME}')) group by 1)
select source, chunk_count, coalesce(entity_count, 0) entity_count from c left join e using (source)""")
def kb_source_counts(spark, d):
    docs = table(spark, d, "documents").filter("length(text) > 0")
    t = F.col("text")
    return analytics.metric_by(docs, ["source"], chunk_count=F.sum(knowledge.chunk_count(t)), entity_count=F.sum(knowledge.name_count(t)))


@query("select o_orderstatus, o_orderpriority, count(*) n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def surface_grouping_sets(spark, d):
    o = table(spark, d, "orders")
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@udtf(returnType="word string, pos int", useArrow=False)  # a call takes one row: with Arrow each would make batches of its own
class SplitWords:
    """The words of a text with their places, from 0."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split(" ")):
            yield w, i


@query("select p_partkey, unnest(w) word, generate_subscripts(w, 1) - 1 pos from (select p_partkey, string_split(p_type, ' ') w from part)")
def surface_table_function(spark, d):
    spark.udtf.register("split_words", SplitWords)
    return spark.sql("select p_partkey, word, pos from {part}, lateral split_words(p_type)", part=table(spark, d, "part"))
