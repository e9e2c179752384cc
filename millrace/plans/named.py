"""Queries of names of several words and of edges between them; registered by plans.registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge, phrases
from ..sources import table
from .registry import query

#: The steps of operators.phrases, from words and what parts them; a run's phrases are read by recursion.
_KNOWN = rf"""t as materialized (select row_number() over () r, regexp_extract_all(text, '\p{{L}}+|[^\p{{L}}]+') l from documents where text is not null),
x as (select r, unnest(l) s, generate_subscripts(l, 1) i from t),
y as materialized (select *, regexp_matches(s, '^\p{{L}}') is_word, regexp_matches(s, '{knowledge.NAME}') is_name from x),
z as (select *, lag(s) over (partition by r order by i) gap, lag(is_name, 2) over (partition by r order by i) follows from y),
w as materialized (select r, i, s, is_name, case when is_name and follows and gap = ' ' then 0 else 1 end fresh from z where is_word),
g as (select *, sum(fresh) over (partition by r order by i) chain from w),
h as (select *, case when is_name then row_number() over (partition by r, chain order by i) - 1 else 0 end place from g),
k as (select *, sum(case when place % {phrases.RUN} = 0 then 1 else 0 end) over (partition by r order by i) - 1 tok from h),
runs as materialized (select r, tok // {phrases.PASSAGE} passage, string_agg(s, ' ' order by i) run from k where is_name group by r, tok),
distinct_runs as materialized (select run, string_split(run, ' ') w, count(*) n from runs group by 1),
sizes as (select unnest(range(1, {phrases.LONGEST + 1})) as size), starts as (select unnest(range(0, {phrases.RUN})) as spot),
placed as materialized (select run, n, spot, size, array_to_string(w[spot + 1 : spot + size], ' ') phrase from distinct_runs, sizes, starts where spot + size <= len(w)),
grams as materialized (select phrase, size, cast(sum(n) as bigint) n from placed group by 1, 2),
low as (select s as word, count(*) c from w where regexp_matches(s, '^\p{{Ll}}+$') group by 1),
p as (select *, string_split(phrase, ' ') w from grams where n >= {phrases.SUPPORT}),
known as materialized (select phrase, size as words, n from p left join low on lower(phrase) = word where size = 1 and n > coalesce(c, 0)
  union all select p.phrase, p.size, p.n from p join grams a on a.phrase = array_to_string(p.w[1 : p.size - 1], ' ') join grams b on b.phrase = array_to_string(p.w[2 : p.size], ' ')
  where p.size > 1 and 4 * p.n >= a.n + b.n and not list_contains([p.w[j] = p.w[j + 1] for j in range(1, p.size)], true))"""
_READ = f"""best as materialized (select run, spot, max(size) as size from placed join known using (phrase) group by 1, 2),
read as (select run, min(spot) as spot from best group by 1
  union all select read.run, (select min(n.spot) from best n where n.run = read.run and n.spot >= read.spot + b.size) from read join best b on b.run = read.run and b.spot = read.spot where read.spot is not null),
told as (select run, array_to_string(string_split(run, ' ')[spot + 1 : spot + size], ' ') as name from read join best using (run, spot)),
named as materialized (select r, passage, name from runs join told using (run))"""


def _learned(spark, d):
    docs = table(spark, d, "documents").select("text")
    found = phrases.runs(docs)
    return found, phrases.gazetteer(found, phrases.lower_counts(docs))


@query(f"with {_KNOWN} select phrase, cast(words as bigint) words, n from known")
def kb_gazetteer(spark, d):
    """What counts as a name in these texts, of one word and of several."""
    return _learned(spark, d)[1].withColumn("words", F.col("words").cast("long"))


@query(f"with recursive {_KNOWN}, {_READ} select name, count(*) n, count(distinct r) docs from named group by 1")
def kb_phrase_names(spark, d):
    """Names by longest match, how often they occur and in how many documents."""
    return phrases.names(*_learned(spark, d)).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("row").alias("docs"))


@query(f"""with recursive {_KNOWN}, {_READ}, u as materialized (select distinct r, passage, name from named),
m as (select name, count(*)::double n from u group by 1), total as (select count(*)::double t from (select distinct r, passage from u)),
e as (select x.name src, y.name dst, count(*) passages from u x join u y on x.r = y.r and x.passage = y.passage and x.name < y.name group by 1, 2 having count(*) >= {phrases.MET}),
q as (select src, dst, passages, passages::double k, a.n a, b.n b, t from e join m a on a.name = src join m b on b.name = dst, total),
o as (select *, 2 * (k * ln(k * t / (a * b)) + case when a > k then (a - k) * ln((a - k) * t / (a * (t - b))) else 0 end + case when b > k then (b - k) * ln((b - k) * t / ((t - a) * b)) else 0 end
  + case when t - a - b + k > 0 then (t - a - b + k) * ln((t - a - b + k) * t / ((t - a) * (t - b))) else 0 end) strength from q where k * t > a * b)
select src, dst, passages, round(strength, 4) strength from o where strength >= {phrases.STRENGTH}""")
def kb_significant_edges(spark, d):
    """Names that share passages more often than chance has it; see kb_edges for the plain list."""
    return phrases.significant(phrases.names(*_learned(spark, d))).withColumn("strength", F.round("strength", 4))
