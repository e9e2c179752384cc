"""Queries of identities: one contact over several keys, one inbox of different channel tables; registered by plans.registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity
from ..sources import table
from .registry import query

_ACCOUNTS = """a as (select 'customer-' || c_custkey account_id, 'customer' channel, case when c_acctbal < 0 then 'N/A' else c_nationkey || '.' || c_mktsegment || floor(c_acctbal / 4)::bigint || '@mail.example' end email,
  case when c_custkey % 2 = 0 then '+' || (round(c_acctbal * 100)::bigint + 1000000) || ' 7' end phone, substr(c_name, 10) ref from customer
union all select 'supplier-' || s_suppkey, 'supplier', case when s_acctbal < 0 then 'none' else 's' || s_nationkey || floor(s_acctbal)::bigint || '@mail.example' end, '00' || (round(s_acctbal * 100)::bigint + 1000000) || '-7', substr(s_name, 10) from supplier)"""
_KEYS = {"email": "email", "phone": "phone", "ref": "id"}


def _accounts(spark, d):
    """Customers and suppliers as accounts of two channels: addresses, numbers and references of their own columns."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    whole = lambda e: F.expr(e).cast("long").cast("string")
    mail, number = F.lit("@mail.example"), lambda b: whole(f"round({b} * 100) + 1000000")
    of_c = F.when(F.col("c_acctbal") < 0, "N/A").otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit("."), "c_mktsegment", whole("floor(c_acctbal / 4)"), mail))
    of_s = F.when(F.col("s_acctbal") < 0, "none").otherwise(F.concat(F.lit("s"), F.col("s_nationkey").cast("string"), whole("floor(s_acctbal)"), mail))
    phone = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+"), number("c_acctbal"), F.lit(" 7")))
    first = c.select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("account_id"), F.lit("customer").alias("channel"), of_c.alias("email"), phone.alias("phone"), F.expr("substr(c_name, 10)").alias("ref"))
    return first.unionByName(s.select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("account_id"), F.lit("supplier").alias("channel"), of_s.alias("email"), F.concat(F.lit("00"), number("s_acctbal"), F.lit("-7")).alias("phone"), F.expr("substr(s_name, 10)").alias("ref")))


_CONTACTS = f"""with recursive {_ACCOUNTS},
k as (select account_id, channel, case when email like '%@%' then email_l end email, case when phone is not null then digits end phone, ref from (
  select *, lower(email) email_l, regexp_replace(regexp_replace(phone, '^([+]|00)', ''), '[^0-9]', '', 'g') digits from a)),
e as (select account_id, 'e' || email as key from k where email is not null union select account_id, 'p' || phone from k where phone is not null union select account_id, 'r' || ref from k),
l as (select distinct x.account_id a, y.account_id b from e x join e y on x.key = y.key),
reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on r.b = l.a),
c as (select a account_id, min(b) contact from reach group by 1)"""


@query(f"{_CONTACTS} select contact, count(distinct account_id) accounts, array_to_string(list_sort(list(distinct channel)), ',') channels, count(distinct email) emails, count(distinct phone) phones, count(distinct ref) refs from c join k using (account_id) group by 1")
def contacts_resolved(spark, d):
    return identity.contacts(_accounts(spark, d), _KEYS)


@query("""select 'website_chat' channel, conv_id || '-' || turn message_id, 'customer-' || conv_id account_id, null::timestamp as at, text from conversations
union all select 'zalo_oa', cast(event_id as varchar), 'customer-' || user_id, ts, event_type from events
union all select 'mail', cast(o_orderkey as varchar), 'customer-' || o_custkey, o_orderdate, null from orders""")
def inbox_of_channels(spark, d):
    """Three channels that keep their messages in tables of their own, with columns of their own."""
    c, e, o = (table(spark, d, n) for n in ("conversations", "events", "orders"))
    who = lambda df, k: df.withColumn("who", F.concat(F.lit("customer-"), F.col(k).cast("string")))
    turn = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return identity.inbox({
        "website_chat": (who(c, "conv_id").withColumn("id", turn), {"message_id": "id", "account_id": "who", "text": "text"}),
        "zalo_oa": (who(e, "user_id"), {"message_id": "event_id", "account_id": "who", "at": "ts", "text": "event_type"}),
        "mail": (who(o, "o_custkey"), {"message_id": "o_orderkey", "account_id": "who", "at": "o_orderdate"}),
    })
