"""One contact over several keys: accounts that share an address, a number or an outside id, directly or through others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written

#: Values that stand for a missing key, after cleaning.
PLACEHOLDERS = ("", "none", "null", "n/a", "na", "unknown", "-", "0", "test", "noreply@example.com")


def cleaned(kind: str, value: Column) -> Column:
    """A key in the form in which it is compared: emails and ids in small letters and trimmed, phones by their digits (an
    international prefix 00 is as good as +); null for placeholders, emails without @ and phones of fewer than six digits."""
    v = F.lower(F.trim(value.cast("string")))
    once = lambda x, then: F.transform(F.array(x), then)[0]  # noqa: E731  # patterns run once a value, however often it is named
    if kind == "phone":  # no placeholder has six digits
        digits = F.regexp_replace(F.regexp_replace(v, "^ *(\\+|00)", ""), "[^0-9]", "")
        return once(digits, lambda x: F.when((F.length(x) >= 6) & ~x.rlike("^(.)\\1*$"), x))
    return once(v, lambda x: F.when((x.rlike("^[^@ ]+@[^@ ]+$") if kind == "email" else F.lit(True)) & ~x.isin(*PLACEHOLDERS), x))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node that is reachable) for the nodes of edges (a, b).

    Alternating large-star and small-star steps: each node points its greater neighbours, then its smaller ones and itself, to
    the least node that it knows of, so that chains shrink by half and stars by one step. A node's neighbours are never
    gathered: its least one is an aggregate with parts made before the shuffle, and what joins is an edge list that stays as
    long as it was. Each step is written; steps end when nothing changes.
    """
    nodes = written(edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node is not null").distinct(), "nodes")
    both = _stars(edges, rounds)
    return nodes.join(both.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def _stars(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """a, b: each node of edges that isn't the least of its component, with the least."""
    both = written(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    told = None
    for _ in range(rounds):
        every = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = every.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("_m", "a").alias("m"))
        large = written(every.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"), "large-star")  # as many as edges at most
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.withColumnRenamed("m", "b"))
        both = written(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "small-star")
        now = tuple(both.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first())
        if now == told:
            break
        told = now
    else:
        raise RuntimeError(f"components are open after {rounds} rounds")
    return both


def _placed(accounts: DataFrame, keys: dict[str, str], account: str) -> DataFrame:
    """accounts that have an id, with cleaned keys (_key_ and the column's name), numbers in the order of ids (_row) and the least
    number of their contact (_first). Numbers, not ids, are what is linked: they are short, and their least one is an aggregate by hashing."""
    said = {f"_key_{c}": cleaned(kind, F.col(c)) for c, kind in keys.items()}
    dealt = accounts.filter(F.col(account).isNotNull()).repartitionByRange(account, *keys).sortWithinPartitions(account)
    rows = written(dealt.withColumn("_row", F.monotonically_increasing_id()).withColumns(said), "accounts")
    named = [F.concat(F.lit(f"{kind}:"), f"_key_{c}") for c, kind in keys.items()] + [F.concat(F.lit(":"), F.col(account).cast("string"))]
    held = rows.select(F.col("_row").alias("a"), F.explode(F.array_distinct(F.array_compact(F.array(*named)))).alias("key"))
    first = held.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
    found = _stars(held.join(first, "key").select("a", "b")).select(F.col("a").alias("_row"), F.col("b").alias("_first"))
    return rows.join(found, "_row", "left").withColumn("_first", F.coalesce("_first", "_row"))


def resolved(accounts: DataFrame, keys: dict[str, str], account: str = "account_id") -> DataFrame:
    """accounts with contact: the least account id among all that share a cleaned key, transitively.

    keys: kind ('email', 'phone' or another) by column; a key meets keys of its own kind only. Null, malformed and placeholder
    keys link nothing; an account without usable keys is its own contact, one without an id has none. Of each key's accounts
    only links to the least one are made, so that a key of a third of all accounts gives as many links as accounts; rows that
    repeat an account join their keys. Columns named contact are replaced.
    """
    accounts = accounts.drop("contact")
    rows = _placed(accounts, keys, account)
    names = rows.filter("_row = _first").select("_first", F.col(account).alias("contact"))
    out = rows.join(names, "_first").select(*accounts.columns, "contact")
    return out.unionByName(accounts.filter(F.col(account).isNull()).withColumn("contact", F.col(account)))


def contacts(accounts: DataFrame, keys: dict[str, str], account: str = "account_id", channel: str = "channel") -> DataFrame:
    """contact, accounts, channels (sorted, comma-joined) and the number of different values of each key column."""
    rows = written(_placed(accounts, keys, account).select("_row", "_first", account, channel, *(f"_key_{c}" for c in keys)), "contacts")
    values = {"accounts": account} | {f"{c}s": f"_key_{c}" for c in keys}
    said = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(values.values()))))
    each = rows.select("_first", said.alias("_s")).select("_first", "_s.*").filter("v is not null").distinct()
    counts = each.groupBy("_first").agg(*(F.count(F.when(F.col("i") == i, True)).alias(n) for i, n in enumerate(values)))
    over = rows.filter(F.col(channel).isNotNull()).select("_first", channel).distinct().groupBy("_first").agg(F.array_join(F.array_sort(F.collect_list(channel)), ",").alias("channels"))
    names = rows.filter("_row = _first").select("_first", F.col(account).alias("contact"))
    told = names.join(counts, "_first").join(over, "_first", "left")
    return told.select("contact", "accounts", F.coalesce("channels", F.lit("")).alias("channels"), *(f"{c}s" for c in keys))


def inbox(channels: dict[str, tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """One inbox of several channels' own tables: channel, message_id, account_id, at, text. Each channel names its columns
    for these; those that it lacks are null."""
    kinds = {"message_id": "string", "account_id": "string", "at": "timestamp_ntz", "text": "string"}
    parts = [df.select(F.lit(name).alias("channel"), *((F.col(names[c]) if c in names else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items())) for name, (df, names) in channels.items()]
    return reduce(DataFrame.unionByName, parts)
