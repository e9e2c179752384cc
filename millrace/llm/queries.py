"""The numbered queries: each applies one operator to its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, flac, language, licenses, mixing, near_dedup, pii, quality, sharding, tokens, warc, whitening
from .common import scratch

#: Where the vocabulary of op2 lies; a parameter of the operator.
RANKS = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_token_counts(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    """All documents are inserted; those marked toxic are deleted and inserted again, those of low quality revised to the
    count of their trimmed texts; all is compacted, and the first batch is then tried once more."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    marked, poor = (labels.filter(c).select("doc_id").distinct() for c in ("toxic = 1", "quality = 0"))
    store = tokens.Rollup(spark, scratch(spark, "token-rollup"))
    store.commit("1-load", tokens.inserts(docs, ranks, "byte_bpe_50k"))
    toxic = store.current().join(marked, "doc_id", "left_semi")
    rows = [toxic.withColumn("op", F.lit("insert")).withColumn("x", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), toxic.withColumn("op", F.lit("delete"))]
    again, gone = (x.select("op", "doc_id", *tokens.GROUP, "n_tokens") for x in rows)
    restored = f"{store.folder}/restored"
    again.write.parquet(restored)
    store.commit("2-toxic", gone)
    store.commit("3-restored", spark.read.parquet(restored))
    # Counts meet the labels, not texts: a join of documents would shuffle them whole where the labels are many.
    revised = tokens.inserts(docs.withColumn("text", F.trim("text")), ranks, "byte_bpe_50k").join(poor, "doc_id", "left_semi")
    store.commit("4-revised", revised.withColumn("op", F.lit("revise")))
    store.compact()
    store.commit("1-load", gone)
    return store.totals()


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.kept(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, percent=85)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, ~language.held_out())
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"), ~quality.held_out())
    return quality.predict(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.planned(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.scan(docs, _table(spark, sf_dir, "benchmark")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.dealt(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_token_counts": op2_token_counts,
    "op3_near_dedup": op3_near_dedup,
    "op4_language": op4_language,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_licenses": op8_licenses,
    "op9_flac": op9_flac,
    "op10_warc": op10_warc,
    "op11_divergence": op11_divergence,
    "op12_whitening": op12_whitening,
    "op13_sharding": op13_sharding,
    "pipeline": pipeline,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = rf"""
with recursive words as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i+2], ' ') for i in range(1, len(w) - 1)]) end s from words
), items as (select doc_id, len(s) n, unnest(s) v from sets),
meets as (
  select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) c
  from items a join items b on a.v = b.v and a.doc_id < b.doc_id group by all
), links as (select a, b from meets where 100 * c >= 85 * (na + nb - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select a, b from both_ways union select r.doc_id, e.b from reach r join both_ways e on r.other = e.a
), least as (select doc_id, min(other) m from reach group by doc_id)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, coalesce(least(l.m, s.doc_id), s.doc_id) component_id,
  s.doc_id = coalesce(least(l.m, s.doc_id), s.doc_id) kept
from sets s left join least l on s.doc_id = l.doc_id
"""

_OP6 = r"""
with sized as (
  select doc_id, text, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents
), totals as (select source, cast(sum(size) as bigint) source_size from sized group by source),
dealt as (
  select *, [5.0, 2.0, 1.0][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)]::double w, 2.0::double * source_size as cap from totals
), levels as (
  select *, row_number() over (order by cap / w, source nulls last) as place, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over before, 0)) / (sum(w) over () - coalesce(sum(w) over before, 0)) as level
  from dealt window before as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)
), planned as (
  select source, source_size, round(least(cap, coalesce((select arg_min(level, place) from levels where cap >= level * w) * w, cap)), 6) target from levels
), rates as (select *, case when source_size > 0 then target / source_size else 0.0 end rate from planned)
select doc_id, size, source_size, target,
  cast(size * (floor(rate) + case when ('0x' || substr(md5('1:' || coalesce(cast(doc_id as varchar), md5(text), '')), 1, 8))::bigint / 4294967296.0 < rate - floor(rate) then 1 else 0 end) as bigint) taken
from sized join rates on sized.source is not distinct from rates.source
"""

_OP7 = rf"""
with doc_words as (
  select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), item_words as (
  select item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null and text is not null
), windows as (
  select distinct item_id, least(len(w), 13) k, unnest([array_to_string(w[i:i+12], ' ') for i in range(1, greatest(len(w) - 13, 0) + 2)]) v
  from item_words where len(w) > 0
), sizes as (select distinct k from windows),
grams as (
  select doc_id, k, unnest(range(1, len(w) - k + 2)) i, w from doc_words, sizes where len(w) >= k
), hits as (
  select g.doc_id, g.i, g.k, x.item_id from grams g join windows x on x.k = g.k and x.v = array_to_string(g.w[g.i:g.i+g.k-1], ' ')
), covered as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from hits) group by doc_id),
found as (select doc_id, count(*) n, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, cast(item_id as varchar) item_id from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(c.n, 0) n_hit, coalesce(f.n, 0) n_items, sha256(coalesce(f.ids, '')) items_sha256,
  coalesce(c.n, 0) > 0 and 20 * coalesce(c.n, 0) >= len(w) contaminated
from doc_words d left join covered c on d.doc_id = c.doc_id left join found f on d.doc_id = f.doc_id
"""

_OP10 = """
with p as (select page_id, coalesce(html, '') html from pages),
d as (select page_id, strlen(html) payload_bytes, sha256(html) payload_digest from p),
r as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end least_id from d)
select page_id, payload_bytes, payload_digest,
  case when least_id is not null and least_id is distinct from page_id then 'revisit' else 'response' end record_type,
  case when least_id is distinct from page_id then least_id end refers_to
from r
"""

_OP11 = rf"""
with docs as (
  select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents
), words as (select r, lang, source, unnest(w) term from docs),
kept as (select lang, term from words group by 1, 2 having count(distinct r) >= 10),
sizes as (select lang, count(*) v from kept group by 1),
counts as (select lang, source, term, count(*) c from words join kept using (lang, term) group by 1, 2, 3),
groups as (select distinct lang, source from docs),
totals as (select g.lang, g.source, coalesce(sum(c), 0)::hugeint n from groups g left join counts t on g.lang = t.lang and g.source = t.source group by 1, 2),
langs as (select lang, sum(n)::hugeint n from totals group by 1),
dense as (
  select t.lang, t.source, k.term, coalesce(c.c, 0) c, (1 + 1000000000::hugeint * (coalesce(c.c, 0) + 2) // (t.n + 2 * s.v))::bigint p
  from totals t join kept k on t.lang = k.lang join sizes s on t.lang = s.lang left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term
), whole as (
  select k.lang, k.term, (1 + 1000000000::hugeint * (coalesce(sum(c.c), 0) + 2) // (any_value(l.n) + 2 * any_value(s.v)))::bigint q
  from kept k join langs l using (lang) join sizes s using (lang) left join counts c on c.lang = k.lang and c.term = k.term group by 1, 2
), apart as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) f from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3
), pairs as (
  select a.lang, a.source, 'pair' part, b.source as item, coalesce(f, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
), terms as (select lang, source, 'term' part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from dense join whole using (lang, term) where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op3_near_dedup": _OP3, "op6_mixing": _OP6, "op7_decontaminate": _OP7, "op10_warc": _OP10, "op11_divergence": _OP11}
