"""Product views: metrics of agents and business outcomes, conversations with their customers, contacts, health, actions, cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import carried


def decision_rates(runs: DataFrame, by: list[Column | str]) -> DataFrame:
    """runs (decision, confidence, passed, ..) by keys: runs, approval, edit and reject rate of those decided, mean_confidence, guardrail_failure_rate."""
    decided = F.count("decision")
    rates = {name: F.round(F.try_divide(F.count_if(F.col("decision") == said), decided), 6) for name, said in (("approval_rate", "approved"), ("edit_rate", "edited"), ("reject_rate", "rejected"))}
    aggs = {"runs": F.count("*"), **rates, "mean_confidence": F.round(F.avg("confidence"), 6), "guardrail_failure_rate": F.round(F.try_divide(F.count_if(~F.col("passed")), F.count("*")), 6)}
    return runs.groupBy(*by).agg(*(a.alias(n) for n, a in aggs.items()))


def metric_rows(tables: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """metric, value: a row for each of a table's aggregates, which are made in one pass over it."""
    rows = []
    for df, metrics in tables:
        one = df.agg(*(a.cast("double").alias(n) for n, a in metrics.items()))
        rows.append(one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("metric"), F.round(n, 6).alias("value")) for n in metrics)))))
    return reduce(DataFrame.unionByName, rows)


def response_times(messages: DataFrame, conversation: str, order: list[str], role: str, asks: str, answers: str) -> DataFrame:
    """Each asking message with answered_at: the time (first of order) of the conversation's next answering message, null if none.

    Answers are carried back from the newest on, by ranges of a conversation; no pairs, and no conversation in one task.
    """
    said = messages.withColumn("_answer", F.when(F.col(role) == answers, F.col(order[0])))
    return carried(said, conversation, order, {"_answer": "answered_at"}, "messages", newest_first=True, own=False).filter(F.col(role) == asks).drop("_answer")


def conversation_view(conversations: DataFrame, messages: DataFrame, customers: DataFrame) -> DataFrame:
    """conversations (conversation_id, customer_id) with the customer's name, messages, last_turn and last_role; unknown customers are null."""
    last = messages.groupBy("conversation_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"))
    return conversations.join(last, "conversation_id", "left").join(customers.select("customer_id", "customer"), "customer_id", "left")


def contacts(accounts: DataFrame) -> DataFrame:
    """email (in small letters), accounts, channels (sorted, comma-joined): accounts (account_id, email, channel) of one address are one contact."""
    grouped = accounts.filter("email is not null").groupBy(F.lower(F.trim("email")).alias("email"))
    return grouped.agg(F.count_distinct("account_id").alias("accounts"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def health(syncs: DataFrame, by: str, stale_after: str) -> DataFrame:
    """by, syncs, errors, last_sync (of those without error) and stale: it lies further back than stale_after from the newest of all."""
    each = syncs.groupBy(by).agg(F.count("*").alias("syncs"), F.count_if("error").alias("errors"), F.max(F.when(~F.col("error"), F.col("ts"))).alias("last_sync"), F.max("ts").alias("_any"))
    now = F.max("_any").over(Window.partitionBy())  # a row for each integration
    return each.withColumn("stale", F.coalesce(F.col("last_sync") < now - F.expr(f"interval {stale_after}"), F.lit(True))).drop("_any")


def actions(rules: list[tuple[int, str, DataFrame]], k: int) -> DataFrame:
    """The k most urgent of what rules propose: priority, kind, ref, weight. Each rule is a priority, a kind and rows (ref, weight)."""
    rows = [df.select(F.lit(p).alias("priority"), F.lit(kind).alias("kind"), F.col("ref").cast("string").alias("ref"), F.col("weight").cast("double").alias("weight")) for p, kind, df in rules]
    return reduce(DataFrame.unionByName, rows).orderBy("priority", F.desc("weight"), "ref").limit(k)


def approval_cards(calls: DataFrame, approvals: DataFrame, runs: DataFrame) -> DataFrame:
    """A card for each open approval: agent, reason, content, sources, confidence."""
    waiting = approvals.filter("status = 'pending'").select("tool_call_id", "reason")
    return waiting.join(calls, "tool_call_id").join(runs, "run_id").select("tool_call_id", "agent_id", "reason", "content", "sources", "confidence")


def feed(items: DataFrame) -> DataFrame:
    """Cards, the newest first: title, body, agent, created_at, cta (empty if there is none)."""
    return items.select("title", "body", "agent", "created_at", F.coalesce("cta", F.lit("")).alias("cta")).orderBy(F.desc("created_at"), "title", "body")


def usable(agents: DataFrame) -> DataFrame:
    """Agents that may run: enabled and active."""
    return agents.filter("enabled and status = 'active'")


def transcripts(turns: DataFrame, todo: str, least_words: int) -> DataFrame:
    """conversation_id, summary (start of the first user turn), todos (turns that match), low_confidence (few words a turn): rules only."""
    words = F.regexp_count("text", F.lit(r"[^ \t\n]+"))
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return turns.groupBy("conversation_id").agg(F.substring(first, 1, 80).alias("summary"), F.count_if(F.col("text").rlike(todo)).alias("todos"), (F.avg(words) < least_words).alias("low_confidence"))
