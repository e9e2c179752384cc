"""Inline cases: migrations, validation, invitations, status machines, guardrails, properties."""

import random

import pytest
from pyspark.sql import functions as F

from millrace import functions, store
from millrace.operators import analytics, harness, knowledge, mutate
from millrace.sources import records, table


def test_migrations(spark):
    files = spark.createDataFrame([("0002_b.py",), ("0001_a.py",), ("__init__.py",), ("x.txt",)], "filename string")
    none = spark.createDataFrame([], "filename string")
    assert [r[0] for r in mutate.pending(files, none).collect()] == ["0001_a.py", "0002_b.py"]
    df = spark.range(2)
    steps = {"a": lambda d: d.withColumn("x", F.lit(1)), "b": lambda d: None, "d": lambda d: False, "e": lambda d: d}
    out, said = mutate.migrate(["e", "d", "c", "b", "a"], steps, set(), df)
    assert out.columns == ["id", "x"]
    assert said == [("a", "applied"), ("b", "applied"), ("c", "skipped"), ("d", "failed"), ("e", "not_run")]


def test_messages_and_defaults(spark):
    df = spark.createDataFrame([([],), ([(["body", "email"], "bad")],), ([(["a"], "x"), ([], "y")],)], "e array<struct<loc:array<string>,msg:string>>")
    assert [r[0] for r in df.select(functions.errors_message("e")).collect()] == ["", "'email': bad", "'a': x, 'unknown': y"]
    http = spark.createDataFrame([(None, None), (0, ""), (404, "7")], "h int, c string")
    assert [tuple(r) for r in http.select(*functions.http_defaults(F.col("h"), F.col("c"))).collect()] == [(500, "500"), (500, "500"), (404, "7")]


def test_records(spark):
    df = spark.createDataFrame([('{"name":"a","email":"b"}',), ('{"name":"a"}',), ("no",), (None,)], "j string")
    assert [r.valid for r in records(df, "j", "name string, email string").collect()] == [True, False, False, False]


def test_invitation_needs_its_email(spark):
    invites = spark.createDataFrame([("i", "W", "n", "Member", "pending", "A@x.co", 9)], "id string, workspaceId string, workspaceName string, role string, status string, email string, expires_at int")
    logins = spark.createDataFrame([("u", "a@x.co", None, "i"), ("v", "b@x.co", None, "i"), ("w", "c@x.co", "W", None)], "user_id string, email string, workspaceId string, invite_id string")
    got = {r.user_id: r.route for r in mutate.accept_invitation(invites, logins, F.lit(5)).collect()}
    assert got == {"u": "join", "v": "create", "w": "dashboard"}
    assert {r.route for r in mutate.accept_invitation(invites, logins.filter("user_id = 'u'"), F.lit(9)).collect()} == {"create"}


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(1, "x", "upsert", 1), (1, "y", "upsert", 2), (2, None, "delete", 1), (3, "n", None, 1)], "k int, v string, op string, t int")
    once = mutate.upsert(now, changes, ["k"], ["t"])
    twice = mutate.upsert(once, changes, ["k"], ["t"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "y"), (3, "n")]


def test_illegal_transitions_are_counted(spark):
    e = spark.createDataFrame([("a", 1, "approved"), ("a", 2, "pending"), ("b", 1, "nowhere")], "k string, t int, to string")
    got = mutate.fold_status(e, "k", ["t"], {"pending": ["approved", "rejected"]}, "pending").collect()
    assert sorted(map(tuple, got)) == [("a", "approved", 1), ("b", "pending", 1)]


def test_owner_must_stay(spark):
    users = spark.createDataFrame([("u", "W", "Owner"), ("v", "W", "Member"), ("x", "Z", "Owner")], "id string, workspaceId string, role string")
    assert [r[0] for r in mutate.owners_missing(users, spark.createDataFrame([("u",)], "id string")).collect()] == ["W"]


def test_asof_boundary(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 6), ("n", 5)], "k string, t int")
    facts = spark.createDataFrame([("k", 5, 10), ("k", 2, 7)], "k string, at int, v int")
    assert sorted(tuple(r) for r in analytics.asof(left, facts, "k", "t", "at", ["v"]).fillna(-1).collect()) == [("k", 1, -1), ("k", 5, 10), ("k", 6, 10), ("n", 5, -1)]


def test_guard_reasons_and_no_send(spark):
    calls = spark.createDataFrame(
        [(1, "t", "t", "a", "say", '{"s":1}', "hi", 0.9, ["x"], ["y"], ["c"]), (2, "t", "u", "a", "pay", "{}", "key x@y.zz", 0.1, ["refund"], ["legal"], ["gone"]), (3, None, None, "z", None, None, None, None, None, None, None)],
        "tool_call_id long, tenant_id string, agent_tenant_id string, agent_id string, tool_name string, output string, text string, confidence double, tags array<string>, flags array<string>, sources array<string>",
    )
    contracts = spark.createDataFrame([("a", "1", ["say"], ["refund"], ["legal"], '{"s":"string"}', True, 1), ("a", "2", [], [], [], "{}", False, 2)], "agent_id string, version string, allowed_tools array<string>, requires_approval array<string>, must_escalate_when array<string>, output_schema string, active boolean, created_at int")
    out = {r.tool_call_id: r for r in harness.route(harness.guard(calls, contracts, spark.createDataFrame([("c",)], "chunk_id string"))).collect()}
    assert out[1].guardrail_result.passed and out[1].mode == "auto_reply"
    assert out[2].guardrail_result.reasons == ["tenant", "permission", "schema", "internal_info", "discount_or_refund", "confidence", "source"]
    assert out[2].mode == "takeover" and out[3].mode == "draft"
    assert all(r.guardrail_result.passed for r in out.values() if r.mode == "auto_reply")


def test_evaluate(spark):
    cases = spark.createDataFrame([("a", "1", ["đơn"], ["hủy"]), ("a", "2", [], []), ("a", "3", [], [])], "agent_id string, input string, must_include array<string>, must_not_include array<string>")
    outputs = spark.createDataFrame([("a", "1", "đơn hàng"), ("a", "2", "")], "agent_id string, input string, output string")
    assert {r.input: r.passed for r in harness.evaluate(cases, outputs).collect()} == {"1": True, "2": True, "3": False}


def test_trace_and_feedback(spark):
    runs = spark.createDataFrame([("r", "a", "in", "2024-01-01 00:00:00", "2024-01-01 00:00:02")], "run_id string, agent_id string, input_ref string, started_at string, completed_at string")
    calls = spark.createDataFrame([("r", "c2", "pay", "ok", 2), ("r", "c1", "say", "ok", 1)], "run_id string, tool_call_id string, tool_name string, status string, created_at int")
    approvals = spark.createDataFrame([("p", "r", "c1", "pending", None, "", 1), ("q", "r", "c1", "rejected", "me", "rude", 2)], "approval_id string, run_id string, tool_call_id string, status string, reviewed_by string, reason string, created_at int")
    row = harness.trace(runs, calls, approvals).first()
    assert [(s.tool_call_id, s.approval) for s in row.steps] == [("c1", "rejected"), ("c2", None)] and row.duration_ms == 2000
    assert [tuple(r) for r in harness.feedback(approvals, runs).collect()] == [("a", "in", "rude")]


def test_tenant_isolation(spark):
    sf = "/root/testdata/sf0.001"
    assert {r[0] for r in table(spark, sf, "documents", "src1").select("source").distinct().collect()} == {"src1"}
    with pytest.raises(ValueError):
        table(spark, sf, "region", "x")


def test_chunks_and_graph(spark):
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.chunk for r in knowledge.chunk(docs, 4, 1).orderBy("pos").collect()] == ["abcd", "defg", "gh"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = knowledge.neighbours(edges, spark.createDataFrame([("a",)], "id string"), 2).collect()
    assert sorted(map(tuple, got)) == [("a", 0), ("b", 1), ("c", 2)]


def test_cooccurrence_by_position(spark):
    docs = spark.createDataFrame([(1, "Anna met Bo and Cleo. " + "x " * 10 + "Dora"), (2, "Cleo, Anna; McCoy É Élan"), (3, None), (4, ""), (None, "Anna Cleo")], "doc_id long, text string")
    got = {(r.src, r.dst): r.docs for r in knowledge.cooccurrence(docs).collect()}
    assert got == {("Anna", "Bo"): 1, ("Anna", "Cleo"): 2, ("Bo", "Cleo"): 1, ("Cleo", "Élan"): 1, ("Anna", "Élan"): 1}
    assert {r.entity for r in knowledge.names(docs).collect()} == {"Anna", "Bo", "Cleo", "Dora", "Élan"}


def test_long_history_is_folded_in_parts(spark):
    rng, machine, want = random.Random(3), {"a": ["b"], "b": ["c", "a"], "c": ["a"]}, {}
    rows = [(k, t, rng.choice(["a", "b", "c", "x", None])) for k in ("hot", "cold", None) for t in range(2000 if k == "hot" else 7)]
    for k, _, to in rows:
        at, n = want.get(k, ("a", 0))
        want[k] = (to, n) if to in machine[at] else (at, n + 1)
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = mutate.fold_status(spark.createDataFrame(rows, "k string, t int, to string"), "k", ["t"], machine, "a")
        assert {r.k: (r.status, r.n_ignored) for r in out.collect()} == want
        assert "RepartitionByExpression" in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks_of_a_large_group(spark):
    df = spark.createDataFrame([("g" if i % 9 else None, i * 7 % 1000) for i in range(1000)] + [("one", 5)], "g string, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = store.ranked(df, "g", ["v"], "r", "n", "t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 1001
    for g in ("g", None, "one"):
        rows = sorted((r.r, r.v, r.n) for r in got if r.g == g)
        assert rows == [(i, v, len(rows)) for i, v in enumerate(sorted(r[1] for r in rows))]


def test_patch_changes_given_columns_only(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "c", 3)], "k int, v string, w int")
    got = mutate.patch(now, spark.createDataFrame([(1, None), (9, "z")], "k int, v string"), ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, None, 1), (2, "b", 2), (None, "c", 3)], key=str)


def test_failing_step_tells_why(spark):
    def broken(df):
        raise KeyError("x")

    why = {}
    assert mutate.migrate(["a"], {"a": broken}, set(), spark.range(1), why)[1] == [("a", "failed")] and why == {"a": "KeyError: 'x'"}


def test_hmac(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("",), ("é message",), (None,)], "m string")
    for key in (b"k", b"long" * 40):
        got = [r[0] for r in df.select(functions.hmac_sha256(F.col("m"), key)).collect()]
        assert got == [hmac.new(key, m.encode(), hashlib.sha256).hexdigest() for m in ("", "é message")] + [None]


def test_approved_refund_passes(spark):
    calls = spark.createDataFrame([(i, "t", "t", "a", "say", '{"s":1}', "hi", 0.9, ["refund"], [], []) for i in (1, 2)], "tool_call_id long, tenant_id string, agent_tenant_id string, agent_id string, tool_name string, output string, text string, confidence double, tags array<string>, flags array<string>, sources array<string>")
    contracts = spark.createDataFrame([("a", "1", ["say"], [], [], '{"s":"string"}', True, 1)], "agent_id string, version string, allowed_tools array<string>, requires_approval array<string>, must_escalate_when array<string>, output_schema string, active boolean, created_at int")
    approvals = spark.createDataFrame([(1, "approved"), (1, "approved"), (2, "rejected")], "tool_call_id long, status string")
    got = harness.guard(calls, contracts, spark.createDataFrame([], "chunk_id string"), approvals=approvals).collect()
    assert sorted((r.tool_call_id, r.guardrail_result.passed) for r in got) == [(1, True), (2, False)]


def test_cosine_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(30)] + [(99, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    whole, parts = (sorted(map(tuple, knowledge.top_cosine(v.filter("vec_id < 9"), v, 3, block=n).collect())) for n in (100, 2))
    assert whole == parts and len(whole) == 27


def test_scoped_reads_and_settings(spark):
    from millrace.sources import scoped, settings

    sf = "/root/testdata/sf0.001"
    assert scoped(spark, sf, "documents", "src1").count() == table(spark, sf, "documents", "src1").count()
    assert scoped(spark, sf, "part", "x", {"part": "p_brand"}).count() == 0
    for args in (("documents", None), ("region", "x")):
        with pytest.raises(ValueError):
            scoped(spark, sf, *args)
    spark.conf.set("app.a", "1")
    assert settings(spark, "app", {"a": "0", "b": "2"}) == {"a": "1", "b": "2"}
