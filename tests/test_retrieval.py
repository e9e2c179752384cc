"""Vectors of texts against a brute force, recall of the index against exhaustive search."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.operators import knowledge, retrieval
from millrace.plans.registry import QUERIES


def vectors(texts, dims):
    counts = []
    for t in texts:
        v = [0] * dims
        for w, n in Counter(re.findall(r"[^\W\d_]+", (t or "").lower())).items():
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % dims] += n if int(h[8], 16) % 2 == 0 else -n
        counts.append((v, bool(re.search(r"[^\W\d_]", t or ""))))
    feature = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims
    having = Counter(f for t in texts for f in {feature(w) for w in re.findall(r"[^\W\d_]+", (t or "").lower())})
    total = sum(c for _, c in counts)
    out = []
    for v, _ in counts:
        v = [n * (math.log((1 + total) / (1 + having[i])) + 1) for i, n in enumerate(v)]
        length = math.sqrt(sum(e * e for e in v))
        out.append([e / length for e in v] if length else None)
    return out


def test_text_vectors_brute_force(spark):
    texts = ["Anna met Bo", "anna MET bo!", "Élan, élan; ｗｉｄｅ words 12", None, "", "12 34", "x " * 20_000, *[f"filler {chr(97 + i)}" for i in range(20)]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, vector int").repartition(3)
    got = {r.doc_id: r.vector for r in retrieval.text_vectors(df, 16).collect()}
    for i, want in enumerate(vectors(texts, 16)):
        assert (got[i] is None) == (want is None) and (want is None or np.allclose(got[i], want, atol=1e-6))
    assert got[0] == got[1]
    assert retrieval.text_vectors(df.limit(0), 16).count() == 0


def test_near_copies_are_closer_than_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 400").select("doc_id", "text").limit(60)
    near = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), F.concat(F.lit("Some other words "), F.expr("substring(text, 30)")).alias("text"))
    v = {r.doc_id: np.array(r.vector) for r in retrieval.text_vectors(docs.union(near)).collect()}
    ids = [i for i in v if i < 10**6]
    copies, others = [v[i] @ v[i + 10**6] for i in ids], [v[i] @ v[j] for i in ids for j in ids if i < j]
    assert np.mean([c > np.quantile(others, 0.99) for c in copies]) > 0.95


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_exhaustive_search(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    q = v.filter("vec_id % 100 = 0")
    exact = {(r.query_id, r.vec_id) for r in knowledge.top_cosine(q, v).collect()}
    got = QUERIES["kb_index_topk"](spark, f"/root/testdata/{sf}").collect()
    assert len({(r.query_id, r.vec_id) for r in got} & exact) >= 0.9 * len(exact)
    index = retrieval.Index(v)
    assert index.pairs(q, index.probes_for(q)) < 0.9 * q.count() * v.count()  # vectors without groups: most cells are near
    assert sum(index.sizes.values()) == v.count()


def clustered(n, groups, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, 24))
    return [(i, (middle[i % groups] + rng.normal(0, 0.15, 24)).tolist()) for i in range(n)]


def test_grouped_vectors_need_few_cells(spark):
    v = spark.createDataFrame(clustered(3000, 40), "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 20 = 0")
    index = retrieval.Index(v)
    probes = index.probes_for(q)
    exact, got = ({(r.query_id, r.vec_id) for r in df.collect()} for df in (knowledge.top_cosine(q, v), index.search(q, 5, probes)))
    assert len(got & exact) >= 0.9 * len(exact) and index.pairs(q, probes) < 0.25 * q.count() * v.count()


def test_all_probes_are_exact_whatever_the_slices(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROWS", 7)
    monkeypatch.setattr(retrieval, "QUERIES", 3)
    rows = [*clustered(120, 5), *[(1000 + i, clustered(1, 5)[0][1]) for i in range(60)], (7, clustered(120, 5)[7][1])]  # a hot vector, a repeated id
    odd = [(500, None), (501, [0.0] * 24), (None, [1.0] * 24)]
    v = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    q = v.filter("vec_id % 10 = 0 or vec_id is null or vec_id in (500, 501)")
    index = retrieval.Index(v, cells=6)
    key = lambda df: sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in df.collect())
    assert key(index.search(q, 4, 6)) == key(knowledge.top_cosine(q.filter("vec_id is not null"), v.filter("vec_id is not null"), 4))
    assert {r.score >= 0.99 for r in index.search(q, 4, 6, floor=0.99).collect()} == {True}


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = retrieval.Index(none)
    assert index.search(none).count() == 0 and index.probes_for(none) == 1


def test_text_search(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["kb_text_search"](spark, sf).collect()
    table = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    v = dict(zip(table["doc_id"], vectors(table["text"], retrieval.DIMS), strict=True))
    ids = [i for i in v if v[i] is not None]
    x, hits, total = np.array([v[i] for i in ids]), 0, 0
    for query in sorted({r.query_id for r in got}):
        score = np.round(x @ np.array(v[query]), 3)
        best = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != query)[:5]
        mine = [r for r in got if r.query_id == query]
        assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == list(range(1, len(mine) + 1))
        hits += sum(round(r.score, 3) >= -best[-1][0] - 0.0011 for r in mine)
        total += len(best)
        first = min(mine, key=lambda r: r["rank"])
        assert {r.answer for r in mine} == {str(first.vec_id) if first.score >= 0.6 else "no_answer"}
    assert hits >= 0.9 * total
