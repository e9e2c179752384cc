"""Queries of what conversations say; registered by plans.registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions
from ..operators import classify, summary
from ..sources import table
from .registry import query


def _walk_sql(steps: int, damping: float) -> str:
    """The walk of operators.summary, a materialized table for each step."""
    parts = [r"""t as materialized (select row_number() over () r, conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+') l from conversations where conv_id is not null),
s0 as materialized (select conv_id, turn, r, i, left(trim(s, chr(32) || chr(9) || chr(13)), 400) sentence from (select conv_id, turn, r, unnest(l) s, generate_subscripts(l, 1) i from t) where regexp_matches(s, '\p{L}{3,}')),
s as materialized (select *, row_number() over (order by conv_id, turn, i, r) id, count(*) over (partition by conv_id) n from s0),
b as materialized (select distinct conv_id, id, unnest(regexp_extract_all(lower(sentence), '\p{L}{3,}')) w from s),
c as materialized (select *, 1 / sqrt(count(*) over (partition by id)) v from b),
d0 as materialized (select conv_id, w, sum(v) y from c group by 1, 2),
d as materialized (select id, case when sum(v * y) - 1 > 1e-12 then sum(v * y) - 1 end deg from c join d0 using (conv_id, w) group by 1),
x0 as materialized (select conv_id, id, n, deg, 1.0::double / n x from s join d using (id))"""]
    for k in range(steps):
        parts.append(f"y{k} as materialized (select c.conv_id, w, sum(v * coalesce(x / deg, 0)) y from c join x{k} using (id) group by 1, 2)")
        parts.append(f"x{k + 1} as materialized (select conv_id, id, n, deg, {1 - damping}::double / n + {damping}::double * (z - coalesce(x / deg, 0)) x from x{k} join (select id, sum(v * y) z from c join y{k} using (conv_id, w) group by 1) using (id))")
    parts.append(f"p as (select *, row_number() over (partition by conv_id order by round(x, 9) desc, id) place from x{steps})")
    return f"""with {", ".join(parts)}
select conv_id, any_value(p.n) n_sentences, rtrim(left(string_agg(sentence, '. ' order by id) filter (where place <= 2), 240)) summary, round(max(round(x, 9)), 6) score from p join s using (conv_id, id) group by 1"""


@query(_walk_sql(summary.STEPS, summary.DAMPING))
def conversation_summary(spark, d):
    """The two sentences of each conversation that its others point to most."""
    return summary.summaries(table(spark, d, "conversations"), "conv_id").withColumn("score", F.round("score", 6))


#: What a text is about, in labels of the given tables; documents whose id isn't divisible by five are learned from.
_TOPIC = "case when toxic = 1 then 'complaint' else 'other' end"
_BAYES = rf"""with x as (select doc_id, text, case when toxic = 1 then 'complaint' else 'other' end label from documents join labels using (doc_id)),
learn as materialized (select row_number() over () r, label, text from x where doc_id % 5 <> 0 and text is not null),
z as (select count(*) filter (where label = 'complaint')::double za, count(*) filter (where label = 'other')::double zb from learn),
w as (select distinct r, label, unnest(regexp_extract_all(lower(text), '\p{{L}}{{2,}}')) word from learn),
c0 as (select word, count(*) filter (where label = 'complaint')::double a, count(*) filter (where label = 'other')::double b from w group by 1),
c as materialized (select word, a, b from c0, z where 2 * (case when a > 0 then a * ln(a / ((a + b) * za / (za + zb))) else 0 end + case when za - a > 0 then (za - a) * ln((za - a) / ((za + zb - a - b) * za / (za + zb))) else 0 end
  + case when b > 0 then b * ln(b / ((a + b) * zb / (za + zb))) else 0 end + case when zb - b > 0 then (zb - b) * ln((zb - b) / ((za + zb - a - b) * zb / (za + zb))) else 0 end) >= {classify.SIGNIFICANT}),
k as (select ln(greatest(coalesce(sum(a), 0) + count(*), 1)) ea, ln(greatest(coalesce(sum(b), 0) + count(*), 1)) eb from c),
d as materialized (select row_number() over () r, doc_id, text from documents),
s as (select r, count(*) n, sum(ln(a + 1)) sa, sum(ln(b + 1)) sb from (select distinct r, unnest(regexp_extract_all(lower(text), '\p{{L}}{{2,}}')) word from d) join c using (word) group by 1),
e as (select doc_id, ln(za / (za + zb)) - ln(zb / (za + zb)) + coalesce(sa - sb, 0) - coalesce(n, 0) * (ea - eb) as lead from d left join s using (r), z, k),
o as (select doc_id, case when abs(lead) < {classify.MARGIN} then 'abstain' when lead >= 0 then 'complaint' else 'other' end label_pred, round(abs(lead), 4) margin from e)"""


def _learned(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    marked = docs.join(table(spark, d, "labels").select("doc_id", F.expr(_TOPIC).alias("label")), "doc_id")
    return docs, marked, classify.fit(marked.filter("doc_id % 5 <> 0"))


@query(f"{_BAYES} select * from o")
def intent_learned(spark, d):
    """A label of every document, learned from words; close calls abstain."""
    docs, _, model = _learned(spark, d)
    return classify.labelled(docs, model).withColumn("margin", F.round("margin", 4))


@query(f"""{_BAYES} select label, count(*) n, count(*) filter (where label_pred <> 'abstain') decided, count(*) filter (where label_pred = label) hits,
  count(*) filter (where label = case when regexp_matches(lower(text), '{"[0-9]"}') then 'complaint' else 'other' end) rule_hits
from o join x using (doc_id) where doc_id % 5 = 0 group by 1""")
def intent_held_out(spark, d):
    """By true label, how many held-out documents were decided and how many rightly, beside a rule by pattern."""
    docs, marked, model = _learned(spark, d)
    held = marked.filter("doc_id % 5 = 0").withColumn("rule", functions.intent(F.col("text"), [("complaint", "[0-9]")]))
    both = held.join(classify.labelled(docs.filter("doc_id % 5 = 0"), model), "doc_id")
    hits = lambda c: F.count_if(F.col("label") == F.col(c))
    return both.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("label_pred") != classify.ABSTAIN).alias("decided"), hits("label_pred").alias("hits"), hits("rule").alias("rule_hits"))
