"""Contracts, guardrails, routing, traces and evaluation of agent runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import includes
from ..store import few

#: Texts that mustn't leave: addresses, credentials, cards.
INTERNAL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]|(api[_-]?key|secret|token|password) *[=:]|[0-9]{13}"


#: Entries of a matrix of roles that is broadcast.
GRANTS = 10_000


def latest_contract(contracts: DataFrame) -> DataFrame:
    """The newest active contract of each agent; of the same time, the greatest version."""
    w = Window.partitionBy("agent_id").orderBy(F.col("created_at").desc(), F.col("version").desc())
    return contracts.filter("active").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def guard(calls: DataFrame, contracts: DataFrame, chunks: DataFrame, min_conf: float = 0.7, approvals: DataFrame | None = None) -> DataFrame:
    """calls with guardrail_result (passed, reasons) of seven checks, and needs_approval and escalate.

    calls: tool_call_id, tenant_id, agent_id, agent_tenant_id, tool_name, output, text, confidence, tags, flags, sources.
    A missing value fails its check. sources are matched with chunk ids by a join. approvals: tool_call_id, status; a discount
    or refund that is approved passes.
    """
    cited = calls.select("tool_call_id", F.explode_outer("sources").alias("chunk_id")).filter("chunk_id is not null")
    missing = cited.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").select("tool_call_id").distinct().withColumn("_missing", F.lit(True))
    missing = few(missing, "missing-sources")  # whole calls are shuffled only where very many fail
    c = latest_contract(contracts).select("agent_id", "allowed_tools", "requires_approval", "must_escalate_when", F.map_keys(F.from_json("output_schema", "map<string,string>")).alias("_needs"))
    df = calls.join(c, "agent_id", "left").join(missing, "tool_call_id", "left")
    told = F.lit(False)
    if approvals is not None:
        yes = approvals.filter("status = 'approved'").select("tool_call_id", F.lit(True).alias("_approved")).distinct()
        df, told = df.join(yes, "tool_call_id", "left"), F.coalesce("_approved", F.lit(False))
    keys = F.coalesce(F.json_object_keys("output"), F.array().cast("array<string>"))
    checks = {
        "tenant": F.col("tenant_id") == F.col("agent_tenant_id"),
        "permission": F.array_contains("allowed_tools", F.col("tool_name")),
        "schema": F.size(F.array_except("_needs", keys)) == 0,
        "internal_info": ~F.coalesce(F.col("text"), F.lit("")).rlike("(?i)" + INTERNAL),
        "discount_or_refund": told | ~F.arrays_overlap("tags", F.array(F.lit("discount"), F.lit("refund"))),
        "confidence": F.col("confidence") >= min_conf,
        "source": F.col("_missing").isNull(),
    }
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items())))
    df = df.withColumn("guardrail_result", F.struct((F.size(reasons) == 0).alias("passed"), reasons.alias("reasons")))
    df = df.withColumn("needs_approval", F.coalesce(F.arrays_overlap("tags", "requires_approval"), F.lit(False)) | F.coalesce(F.col("confidence") < min_conf, F.lit(True)))
    df = df.withColumn("escalate", F.coalesce(F.arrays_overlap("flags", "must_escalate_when"), F.lit(False)))
    return df.select(*(c for c in calls.columns if c not in ("guardrail_result", "needs_approval", "escalate")), "guardrail_result", "needs_approval", "escalate")


def route(df: DataFrame) -> DataFrame:
    """df with mode: takeover if escalated, draft if a check failed or approval is needed, else auto_reply."""
    held = ~F.col("guardrail_result.passed") | F.col("needs_approval")
    return df.withColumn("mode", F.when(F.col("escalate"), "takeover").when(held, "draft").otherwise("auto_reply"))


def trace(runs: DataFrame, calls: DataFrame, approvals: DataFrame) -> DataFrame:
    """runs with their calls in order, each with its last approval, and duration_ms."""
    w = Window.partitionBy("tool_call_id").orderBy(F.col("created_at").desc(), F.col("approval_id").desc())
    last = approvals.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("tool_call_id", F.col("status").alias("approval"), "reviewed_by")
    steps = calls.join(last, "tool_call_id", "left").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "tool_call_id", "tool_name", "status", "approval", "reviewed_by"))).alias("steps"))
    ms = ((F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000).cast("long")
    return runs.join(steps, "run_id", "left").withColumn("duration_ms", ms)


def evaluate(cases: DataFrame, outputs: DataFrame) -> DataFrame:
    """cases ⋈ outputs (agent_id, input, output) with passed; a case without output fails."""
    both = cases.join(outputs.select("agent_id", "input", "output"), ["agent_id", "input"], "left")
    return both.withColumn("passed", F.col("output").isNotNull() & includes(F.col("output"), F.col("must_include"), F.col("must_not_include")))


def feedback(approvals: DataFrame, runs: DataFrame) -> DataFrame:
    """New cases from rejected and edited proposals: agent_id, input, expected_behavior."""
    told = approvals.filter(F.col("status").isin("rejected", "edited"))
    return told.join(runs.select("run_id", "agent_id", F.col("input_ref").alias("input")), "run_id").select("agent_id", "input", F.col("reason").alias("expected_behavior"))


def permitted(actions: DataFrame, grants: DataFrame) -> DataFrame:
    """actions (role, action, ..) that grants (role, action) allow; a matrix of at most GRANTS entries is sent to all tasks."""
    rows = grants.select("role", "action").distinct()
    rows = F.broadcast(rows) if rows.limit(GRANTS + 1).count() <= GRANTS else rows
    return actions.join(rows, ["role", "action"], "left_semi")
