"""Streams over files and folders, null keys, long conversations, logs that are published whole."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace import sinks
from millrace.operators import harness, knowledge, mutate, product
from millrace.plans.registry import QUERIES
from millrace.sources import table_stream

SF = "/root/testdata/sf0.001"
STREAMS = [n for n in sorted(QUERIES) if n.startswith("stream_")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The small tables, each a folder of part files."""
    at = tmp_path_factory.mktemp("parts")
    for name in ("events", "orders", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"file://{at}/{name}.parquet")
    return f"file://{at}"


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_files_and_folders(spark, folders, name):
    one, many = (sorted(map(str, QUERIES[name](spark, d).collect())) for d in (SF, folders))
    assert one == many and one


def test_folder_in_several_batches(spark, folders):
    seen = []
    q = table_stream(spark, folders, "events", 1).writeStream.foreachBatch(lambda df, i: seen.append(df.count())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) == 3 and sum(seen) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_upsert_with_null_keys(spark):
    now = spark.createDataFrame([(None, 1, "a"), (1, None, "b"), (1, 1, "c")], "k int, l int, v string")
    changes = spark.createDataFrame([(None, 1, "x", "upsert", 1), (1, None, None, "delete", 1), (None, None, "n", "upsert", 1)], "k int, l int, v string, op string, t int")
    once = mutate.upsert(now, changes, ["k", "l"], ["t"])
    twice = mutate.upsert(once, changes, ["k", "l"], ["t"])
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert {r.v for r in once.collect()} == {"c", "x", "n"}


def test_response_times_of_a_long_conversation(spark):
    n, rng = 200_000, random.Random(3)
    roles = [rng.choice("uua") for _ in range(n)]
    df = spark.range(n).select(F.lit(1).alias("c"), F.col("id").alias("t"), F.element_at(F.split(F.lit("".join(roles)), ""), (F.col("id") + 1).cast("int")).alias("role")).filter("id < 300")
    want, after = {}, None
    for t in range(299, -1, -1):
        if roles[t] == "u":
            want[t] = after
        else:
            after = t
    assert {r.t: r.answered_at for r in product.response_times(df, "c", ["t"], "role", "u", "a").collect()} == want
    long = spark.range(n).select(F.lit(1).alias("c"), F.col("id").alias("t"), F.when(F.col("id") % 1000 == 999, "a").otherwise("u").alias("role"))
    began = time.time()
    out = product.response_times(long, "c", ["t"], "role", "u", "a").agg(F.count("*"), F.sum(F.col("answered_at") - F.col("t"))).first()
    assert tuple(out) == (n - 200, 200 * sum(range(1, 1000))) and time.time() - began < 30


def test_log_publishes_whole_batches(spark):
    log = sinks.Log(spark, "t", by="day")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, day string")
    log.append("x/1=?", rows)
    log.append("y", rows.filter("id = 1"))
    log.append("x/1=?", rows)  # tried again
    assert sorted(r.id for r in log.read(rows.schema).collect()) == [1, 1, 2]
    with pytest.raises(Exception):
        log.append("y", rows.withColumn("id", F.raise_error(F.lit("lost")).cast("int")))
    assert sorted(r.id for r in log.read(rows.schema).collect()) == [1, 1, 2]


def test_grants_beyond_the_broadcast(spark, monkeypatch):
    acts = spark.createDataFrame([("o", "x"), ("o", "y"), (None, "x")], "role string, action string")
    grants = spark.createDataFrame([("o", "x"), ("p", "y")], "role string, action string")
    for n in (10, 1):
        monkeypatch.setattr(harness, "GRANTS", n)
        assert [tuple(r) for r in harness.permitted(acts, grants).collect()] == [("o", "x")]


def test_repeated_ids_count_once_each(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Anna " * 200, "s"), (1, "Bo", "s"), (None, "Cleo Cleo", None), (2, None, "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert {(r.source, r.chunk_count, r.docs) for r in QUERIES["kb_chunk_counts"](spark, f"file://{tmp_path}").collect()} == {("s", 3, 2), (None, 1, 1)}
    assert {(r.source, r.chunk_count, r.entity_count) for r in QUERIES["kb_source_counts"](spark, f"file://{tmp_path}").collect()} == {("s", 3, 2), (None, 1, 1)}


@pytest.mark.parametrize("most", [1000, 3])
def test_passages_in_texts_brute_force(spark, most):
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["uno", "dos", "tres", "Élan", "quatro", "x1", "12"]) for _ in range(n))
    items = [(i, say(rng.randrange(1, 7))) for i in range(14)] + [(3, say(5)), (90, None), (91, ""), (92, "dos"), (93, "os tr"), (None, "uno dos tres")]
    texts = [(i, say(rng.randrange(0, 30))) for i in range(60)] + [(5, "uno dos tres quatro"), (None, "uno dos tres"), (70, None), (71, ""), (72, items[2][1] + "s " + "pad " * 3000)]
    docs, cases = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, passage string").repartition(2)
    got = Counter(map(tuple, knowledge.containing(docs, cases, most).collect()))
    assert got == Counter((d, i) for d, t in texts for i, p in items if t is not None and p is not None and p in t)
    assert knowledge.containing(docs, cases.limit(0)).count() == 0


def test_cosine_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)] + [(i, [1.0, 2.0, 0.0, 0.0]) for i in range(100, 140)] + [(3, [0.5, 0.5, 0.5, 0.1]), (200, None), (201, [0.0] * 4), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    good = [(i, x) for i, x in rows if i is not None and x and any(x)]
    cos = lambda a, b: round(sum(p * q for p, q in zip(a, b, strict=True)) / sum(p * p for p in a) ** 0.5 / sum(q * q for q in b) ** 0.5, 4)
    got = knowledge.top_cosine(v.filter("vec_id % 10 = 1 or vec_id = 100"), v, 4, 0.1, block=3).collect()
    for i, x in good:
        if i % 10 == 1 or i == 100:
            want = sorted((-cos(x, y), j) for j, y in good if j != i and cos(x, y) >= 0.1)[:4]
            assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == want
