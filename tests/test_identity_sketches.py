"""Contacts against union-find, sketches against exact values."""

import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from millrace.operators import identity, sketches

KEYS = {"email": "email", "phone": "phone", "ref": "id"}
ACCOUNTS = "account_id string, channel string, email string, phone string, ref string, contact int"


def united(rows):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, *keys in rows:
        find(("a", a))
        for kind, k in enumerate(keys):
            if k is not None:
                root[find((kind, k))] = find(("a", a))
    groups = {}
    for a, *_ in rows:
        groups.setdefault(find(("a", a)), set()).add(a)
    return {a: min(g) for g in groups.values() for a in g}


def test_contacts_against_union_find(spark):
    rng = random.Random(4)
    some = lambda kind, n: rng.choice([None, None, f"{kind}{rng.randrange(n)}"])
    rows = [(f"a{i:04d}", some("m", 150), some("", 10**9) and f"12345{rng.randrange(200):03d}", some("r", 250)) for i in range(400)]
    rows += [(f"hot{i:03d}", "hot", None, None) for i in range(300)] + [("a0000", "hot", None, "r1")]
    rows += [(f"chain{i:03d}", f"c{i // 2}", f"77777{(i + 1) // 2:04d}", None) for i in range(120)]  # each shares one key with the next
    df = spark.createDataFrame([(a, "web", m and f" {m.upper()}@X.co ", p and f"+{p[:3]} {p[3:]}", r, 1) for a, m, p, r in rows], ACCOUNTS).repartition(4)
    got = {r.account_id: r.contact for r in identity.resolved(df, KEYS).collect()}
    assert got == united(rows)
    assert len({v for a, v in got.items() if a.startswith("chain")}) == 1


def test_keys_that_link_nothing(spark):
    rows = [("a", "w", None, None, None), ("b", "w", "N/A", "000000", "unknown"), ("c", "w", "n/a", "0000000", " Unknown "), ("d", "w", "no at", "12", ""), ("e", "w", "no at", "12", ""), (None, "w", "x@y.z", "+84 90 123 456", "7"), ("f", "z", "X@y.z ", None, None), ("g", "z", None, "008490123456", None), ("h", "fb", "x@Y.z", "84-90-123-456", None), ("7", "fb", None, None, "f")]
    df = spark.createDataFrame([(*r, 0) for r in rows], ACCOUNTS)
    assert {r.account_id: r.contact for r in identity.resolved(df, KEYS).collect()} == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "e", None: None, "f": "f", "g": "f", "h": "f", "7": "7"}
    told = {r.contact: (r.accounts, r.channels, r.emails, r.phones) for r in identity.contacts(df, KEYS).collect()}
    assert told["f"] == (3, "fb,z", 1, 1) and len(told) == 7
    assert identity.resolved(df.limit(0), KEYS).count() == 0


def test_components_of_repeated_and_looped_edges(spark):
    e = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 3), (5, 4), (6, 5), (None, 9), (8, None)], "a int, b int")
    assert {r.node: r.component for r in identity.components(e).collect()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 8: 8, 9: 9}


def test_open_components_are_told(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    with pytest.raises(RuntimeError):
        identity.components(chain, rounds=2)
    assert {r.component for r in identity.components(chain).collect()} == {0}


def test_sketches_within_their_error(spark):
    rng, rows = random.Random(6), []
    for i in range(60_000):
        rows.append((i, f"2024-01-{1 + i % 20:02d} {i % 24:02d}:30:00", None if i % 11 == 0 else rng.randrange(30_000), None if i % 7 == 0 else rng.expovariate(0.1)))
    df = spark.createDataFrame(rows, "id int, ts string, user int, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    store = sketches.Rollup(spark, "ts", [], "user", "v")
    for i in (0, 1, 2, 0):
        store.add(f"b{i}", df.filter(F.col("id") % 3 == i))
    days, once = store.by("day", p50=0.5, p99=0.99).collect(), store.by("year", p50=0.5).first()
    values, users = {}, {}
    for i, ts, u, v in rows:
        values.setdefault(ts[:10], []).extend([v] if v is not None else [])
        users.setdefault(ts[:10], set()).update([u] if u is not None else [])
    assert len(days) == 20 and sum(r.n for r in days) == 60_000 == once.n
    for r in days:
        exact = sorted(values[str(r.day)[:10]])
        assert r.measured == len(exact) and abs(r.users / len(users[str(r.day)[:10]]) - 1) < 0.03
        for rank, got in ((0.5, r.p50), (0.99, r.p99)):
            assert bisect_left(exact, got) / len(exact) - 0.01 <= rank <= bisect_right(exact, got) / len(exact) + 0.01
    everyone, everything = set().union(*users.values()), sorted(v for vs in values.values() for v in vs)
    assert abs(once.users / len(everyone) - 1) < 0.03  # merged from all hours
    assert abs(bisect_left(everything, once.p50) / len(everything) - 0.5) < 0.01
    rebuilt = sketches.told(sketches.sketched(df, [F.date_trunc("year", "ts").alias("year")], "user", "v"), {"p50": 0.5}).first()
    assert abs(rebuilt.users / once.users - 1) < 0.03 and abs(bisect_left(everything, rebuilt.p50) - bisect_left(everything, once.p50)) < 0.01 * len(everything)


def test_sketches_of_little_and_nothing(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", 1, None), ("2024-01-01 11:00:00", 1, float("nan")), (None, 2, 1.0), ("2024-01-02 00:00:00", None, 4.0), ("2024-01-02 05:00:00", 3, 2.0)], "ts string, user int, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    store = sketches.Rollup(spark, "ts", [], "user", "v")
    with pytest.raises(ValueError):
        store.by("day")
    store.add("none", df.limit(0))
    assert store.by("day", p50=0.5).count() == 0
    store.add("all", df)
    assert sorted((str(r.day)[:10], r.n, r.users, r.measured, r.p50) for r in store.by("day", p50=0.5).collect()) == [("2024-01-01", 2, 1, 0, None), ("2024-01-02", 2, 1, 2, 2.0)]


def test_exact_rollup_of_large_groups(spark):
    """Above the sizes to which sketches are exact: many users and values, null keys, a batch that is tried again."""
    rng = random.Random(7)
    rows = [(i, f"2024-01-{1 + i % 2:02d} {i % 24:02d}:30:00", None if i % 3 == 0 else f"k{i % 3}", None if i % 11 == 0 else rng.randrange(9_000), None if i % 7 == 0 else round(rng.expovariate(0.1), 2 + 4 * (i % 2))) for i in range(40_000)]
    df = spark.createDataFrame(rows, "id int, ts string, k string, user int, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    store = sketches.Rollup(spark, "ts", ["k"], "user", "v", exact=True)
    for i in (0, 1, 2, 1):
        store.add(f"b{i}", df.filter(F.pmod(F.hash("id"), F.lit(3)) == i))
    for keys, of in (([], lambda r: r[1][:10]), (["k"], lambda r: (r[1][:10], r[2]))):
        groups = {}
        for r in rows:
            groups.setdefault(of(r), []).append(r)
        want = {}
        for g, some in groups.items():
            values = sorted(r[4] for r in some if r[4] is not None)
            want[g] = (len(some), len({r[3] for r in some} - {None}), len(values), *(values[-(-len(values) * p // 100) - 1] for p in (50, 90, 99)))
        got = store.by("day", keys, p50=0.5, p90=0.9, p99=0.99).collect()
        assert {(str(r.day)[:10], r.k) if keys else str(r.day)[:10]: (r.n, r.users, r.measured, r.p50, r.p90, r.p99) for r in got} == want and len(got) == len(want)


def test_links_are_numbers_in_the_order_of_ids(spark, monkeypatch):
    """Texts aren't sorted round by round: what the steps link are short numbers, of which the least is the least id's."""
    seen, told = [], identity.written
    monkeypatch.setattr(identity, "written", lambda df, name, **o: seen.append((name, df.dtypes)) or told(df, name, **o))
    rows = [(f"a{i}", "web", f"m{i // 2}@x.co", None, f"r{(i + 1) // 2}", 0) for i in range(30)] + [("b1", "web", None, None, None, 0), ("b1", "app", "q@x.co", None, None, 0), ("b2", None, " Q@x.co", "+84 90 123 456", None, 0), (None, "web", "m1@x.co", None, None, 0)]
    df = spark.createDataFrame(rows, ACCOUNTS).repartition(3)
    got = {(r.account_id, r.contact) for r in identity.resolved(df, KEYS).collect()}
    assert got == {(f"a{i}", "a0") for i in range(30)} | {("b1", "b1"), ("b2", "b1"), (None, None)}
    assert all(t == "bigint" for name, types in seen if name in ("edges", "large-star", "small-star") for _, t in types)
    assert sorted(map(tuple, identity.contacts(df, KEYS).collect())) == [("a0", 30, "web", 15, 0, 16), ("b1", 2, "app,web", 1, 1, 0)]
