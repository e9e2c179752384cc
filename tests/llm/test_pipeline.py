"""The pipeline's stages against plain versions of what each decides."""

import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import language

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("lang", ["null", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, lang, null)"])
def test_documents_stay_where_nothing_can_be_learned(spark, lang):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.expr(lang).cast("string"))
    odd = spark.createDataFrame([(-1, None, None, "s", 0), (-2, "", None, "s", 0), (-3, "12 !", None, "s", 0), (-4, "é", None, None, 1)], docs.schema)
    kept = corpus_pipeline.identify(spark, docs.unionByName(odd), SF)
    want = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)} | {-4}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_stages_decide_as_plain_versions_do(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    first = corpus_pipeline.identify(spark, docs, SF).collect()
    assert {r.doc_id for r in first} == {r["doc_id"] for r in table if r["text"] and any(c.isalpha() for c in r["text"])}
    assert all(r.lang == next(x["lang"] for x in table if x["doc_id"] == r.doc_id) or next(x["lang"] for x in table if x["doc_id"] == r.doc_id) is None for r in first)

    texts = {r.doc_id: r.text for r in first}
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, t in texts.items() for w in [words(t)]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    second = corpus_pipeline.deduplicate(spark, spark.createDataFrame(first, docs.schema), SF)
    assert {r.doc_id for r in second.collect()} == {i for i in sets if find(i) == i}

    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for item in items:
        w = tokens(item["text"])
        for i in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(min(13, len(w)), set()).add(tuple(w[i : i + 13]))
    clean = set()
    for r in second.collect():
        w, hit = tokens(r.text), set()
        for n, those in grams.items():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in those:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(r.doc_id)
    third = corpus_pipeline.clear_benchmarks(spark, second, SF)
    assert {r.doc_id for r in third.collect()} == clean

    fourth = corpus_pipeline.redact(spark, third, SF).collect()
    assert {r.doc_id for r in fourth} == clean
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for r in fourth:
        assert not mail.search(r.text) and (("[EMAIL]" in r.text) or not mail.search(texts[r.doc_id]))

    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(fourth, docs.schema), SF).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in mixed} <= clean and max(r["count"] for r in mixed) <= 2


def test_whole_run_is_its_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((df := stage(spark, docs, SF)).collect(), df.schema)
    rows = lambda df: sorted((r.doc_id, r.copy, r.text, r.lang) for r in df.collect())
    assert rows(docs) == rows(corpus_pipeline.run(spark, SF))
    assert language.fit(docs.limit(0)) is None
