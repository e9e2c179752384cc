"""Queries of retrieval: vectors of texts, the inverted-file index; registered by plans.registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge, pages, retrieval
from ..sources import table
from .registry import query

_DIMS = retrieval.DIMS


@query(rf"""with w as (select row_number() over () r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') w from documents),
t as (select r, word, count(*) tf, md5(word) h from (select r, unnest(w) word from w) group by 1, 2),
f as (select r, ('0x' || substr(h, 1, 8))::bigint % {_DIMS} as feature, sum(case when ('0x' || substr(h, 9, 1))::int % 2 = 0 then tf else -tf end) n from t group by 1, 2),
i as (select feature, ln((1 + (select count(distinct r) from t)) / (1 + count(*))::double) + 1 as idf from f group by 1),
v as (select r, n * idf as e from f join i using (feature)),
s as (select r, count(*) filter (where e <> 0) n_dims, max(abs(e)) m, sum(abs(e)) a, sqrt(sum(e * e)) l from v group by 1)
select doc_id, coalesce(case when l > 0 then n_dims end, 0) n_dims, round(case when l > 0 then m / l end, 4) heaviest, round(case when l > 0 then a / l end, 2) mass from w left join s using (r)""")
def kb_text_vectors(spark, d):
    v = retrieval.text_vectors(table(spark, d, "documents").select("doc_id", "text"), drop=True).select("doc_id", F.transform("vector", lambda e: F.abs(e.cast("double"))).alias("v"))
    n = F.coalesce(F.size(F.filter("v", lambda e: e > 0)), F.lit(0))
    return v.select("doc_id", F.greatest(n, F.lit(0)).cast("long").alias("n_dims"), F.round(F.array_max("v"), 4).alias("heaviest"), F.round(F.aggregate("v", F.lit(0.0), lambda a, e: a + e), 2).alias("mass"))


@query()
def kb_index_topk(spark, d):
    """The five nearest vectors of each query, from as many cells as nine of ten true neighbours and more lie in; see kb_topk_cosine."""
    v = table(spark, d, "embeddings")
    index, q = retrieval.Index(v), v.filter("vec_id % 100 = 0")
    return index.search(q, 5, index.probes_for(q)).withColumn("rank", F.col("rank").cast("long"))


@query()
def kb_text_search(spark, d):
    """The five documents most like each query document, by vectors of their words, and an answer or abstention from 0.6 on."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    v = retrieval.written(retrieval.text_vectors(docs, drop=True), "text-vectors")
    index, q = retrieval.Index(v, "vector"), v.filter("vec_id % 100 = 0")
    found = index.search(q, 5, index.probes_for(q, vector="vector"), "vector").select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))
    return found.join(knowledge.answer(found, q, 0.6), "query_id")


@query()
def kb_page_text(spark, d):
    """Pages by their text without menus: entities decoded, tags by their quotes; see kb_link_extract for the plain count."""
    t = pages.main_text(table(spark, d, "pages").select("page_id", "html"))
    return t.select("page_id", "n_blocks", "kept", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))
