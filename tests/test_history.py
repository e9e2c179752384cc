"""Values carried over ranges, mutations as history in any order of arrival, traversal hop by hop."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import store
from millrace.operators import analytics, history, knowledge
from millrace.plans.registry import QUERIES


@pytest.fixture
def ranges(spark):
    """Ranges stay as many as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("newest_first", [False, True])
@pytest.mark.parametrize("own", [False, True])
def test_carried_over_ranges(spark, ranges, newest_first, own):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([None, None, i]), rng.choice([None] * 30 + [f"s{i}"])) for i in range(900)]
    rows += [("lone", 1, None, None), ("hot", None, -1, "null order")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int, s string")
    got = store.carried(df, "g", ["o"], {"v": "lv", "s": "ls"}, "t", newest_first, own).collect()
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0), reverse=newest_first)
        v = s = None
        want = {}
        for _, o, rv, rs in mine:
            before = (v, s)
            v, s = rv if rv is not None else v, rs if rs is not None else s
            want[o] = (v, s) if own else before
        assert {r.o: (r.lv, r.ls) for r in got if r.g == g} == want


def test_asof_over_ranges(spark, ranges):
    rng = random.Random(9)
    left = [(rng.choice(["hot", "hot", "k", None]), rng.choice([None, *range(300)]), i) for i in range(700)]
    facts = [(rng.choice(["hot", "hot", "k", None]), rng.choice([None, *range(0, 300, 7)]), i) for i in range(90)]
    got = analytics.asof(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(facts, "k string, at int, v int"), "k", "t", "at", ["v"]).collect()
    for r in got:
        best = max(((at, v) for k, at, v in facts if k == r.k and None not in (k, at, r.t) and at <= r.t), default=(None, None))
        assert r.v == best[1]
    assert len(got) == 700


def test_more_rows_make_more_tasks_of_a_carry(spark, monkeypatch):
    """However few partitions the session has, no task gets many times what it may hold; facts of one time count by value."""
    monkeypatch.setattr(store, "ROWS", 100, raising=False)
    left = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot' else 'k' || id % 40 end k", "cast(id as int) t", "id i")
    facts = spark.range(900).selectExpr("case when id % 2 = 0 then 'hot' else 'k' || id % 40 end k", "cast(id div 7 * 50 as int) at", "id * 37 % 101 v")
    out = analytics.asof(left, facts, "k", "t", "at", ["v"])
    assert max(r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()) < 600
    told = {}
    for r in facts.collect():
        told.setdefault(r.k, []).append((r["at"], r.v))
    got = out.collect()
    assert len(got) == 3000 and all(r.v == max((x for x in told.get(r.k, []) if x[0] <= r.t), default=(None, None))[1] for r in got)


def test_asof_of_lines_in_more_tasks(spark, monkeypatch):
    want = sorted(map(str, QUERIES["price_asof_facts"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(store, "ROWS", 1000, raising=False)
    got = QUERIES["price_asof_facts"](spark, "/root/testdata/sf0.001")
    assert sorted(map(str, got.collect())) == want and got.rdd.getNumPartitions() >= 7


SCHEMA = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])
DDL = "id string, at int, seq int, op string, payload string"


def replayed(rows):
    """History by a loop over each id's mutations in order."""
    out = []
    for key in {r[0] for r in rows}:
        doc, mine = None, sorted({(r[1], r[2], r[3], r[4]) for r in rows if r[0] == key})
        for i, (at, _, op, payload) in enumerate(mine):
            given = json.loads(payload) if op != "delete" else {}
            none = dict.fromkeys(SCHEMA.names)
            doc = None if op == "delete" else {**none, **given} if op == "put" else {**(doc or none), **given}
            until = mine[i + 1][0] if i + 1 < len(mine) else None
            if until is None or until > at:
                d = doc or none
                out.append((key, d["name"], d["n"], str(d["tags"]), doc is not None, at, until))
    return sorted(out, key=str)


def mutations(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        fields = {"name": rng.choice([None, f"x{i}"]), "n": rng.choice([None, i]), "tags": rng.choice([None, [], [f"t{i}"]])}
        given = {k: v for k, v in fields.items() if rng.random() < 0.5}
        op = rng.choice(["put", "patch", "patch", "patch", "delete"])
        rows.append((rng.choice(["hot", "hot", "b", "c"]), rng.randrange(n // 2), i, op, None if op == "delete" else json.dumps(given)))
    return rows


def test_history_in_any_order_of_arrival(spark, ranges):
    rows = mutations(300, 1)
    want = replayed(rows)
    for seed in (1, 2):
        again = rows + random.Random(seed).sample(rows, 50)  # parts are replayed
        random.Random(seed).shuffle(again)
        good, bad = history.typed(spark.createDataFrame(again, DDL).repartition(3), SCHEMA)
        got = history.versions(good, SCHEMA)
        assert bad.count() == 0
        assert sorted(((r.id, r.name, r.n, str(r.tags), r.exists, r.valid_from, r.valid_to) for r in got.collect()), key=str) == want
    for t in (0, 40, 149, 1000):
        there = {r.id: r.n for r in history.as_of(got, F.lit(t)).collect()}
        assert there == {w[0]: w[2] for w in want if w[4] and w[5] <= t and (w[6] is None or w[6] > t)}


def test_late_correction_changes_what_came_after(spark):
    rows = [("a", 1, 1, "put", '{"name":"x","n":1}'), ("a", 5, 2, "patch", '{"n":5}')]
    late = [*rows, ("a", 3, 3, "patch", '{"name":"corrected"}')]
    told = lambda rs: sorted((r.valid_from, r.valid_to, r.name, r.n) for r in history.versions(history.typed(spark.createDataFrame(rs, DDL), SCHEMA)[0], SCHEMA).collect())
    assert told(rows) == [(1, 5, "x", 1), (5, None, "x", 5)]
    assert told(late) == [(1, 3, "x", 1), (3, 5, "corrected", 1), (5, None, "corrected", 5)]


def test_mutations_that_are_no_such(spark):
    rows = [(None, 1, 1, "put", "{}"), ("a", None, 1, "put", "{}"), ("a", 1, 1, "drop", "{}"), ("a", 1, 2, None, "{}"), ("a", 1, 3, "put", "no"), ("a", 1, 4, "patch", "[1]"), ("a", 1, 5, "put", None), ("a", 1, 6, "put", '{"size":1}'), ("a", 1, 7, "patch", '{"n":"many"}'), ("a", 1, 8, "patch", '{"n":null}'), ("a", 1, 9, "delete", None)]
    good, bad = history.typed(spark.createDataFrame(rows, DDL), SCHEMA)
    assert sorted(r.seq for r in good.collect()) == [8, 9]
    reasons = {(r.seq, r.at): r.reason for r in bad.collect()}
    assert reasons[1, 1] in ("no id or time", "unknown op") and reasons[5, 1] == reasons[3, 1] == reasons[4, 1] == "no object" and reasons[6, 1] == "unknown field" and reasons[7, 1] == "wrong type: n"
    assert history.versions(good.limit(0), SCHEMA).count() == 0


def test_traversal_of_many_hops(spark):
    edges = [(i, i + 1) for i in range(12)] + [(0, j) for j in range(100, 400)] + [(j, 0) for j in range(100, 400)] + [(5, 3), (None, 1), (3, None)]
    df = spark.createDataFrame(edges, "src int, dst int")
    got = {r.id: r.hop for r in knowledge.neighbours(df, spark.createDataFrame([(0,), (None,), (0,)], "id int"), 10).collect()}
    assert got == {**{i: i for i in range(11)}, **{j: 1 for j in range(100, 400)}}
    ended = knowledge.neighbours(df.filter("src < 3"), spark.createDataFrame([(0,)], "id int"), 1000)
    assert {r.hop for r in ended.collect()} == {0, 1, 2, 3}
