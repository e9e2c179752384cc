"""Source divergence, whitening and sharding against brute force, and the cases that every operator must bear."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import divergence, queries, sharding, whitening

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "É é Ab aB", "x" * 50_000, "1 " * 5_000, "a1b--c\x00d"]


def audited(rows, least=10, ranks=10):
    """The contract by plain loops over (text, lang, source)."""
    rows = [tuple(v or "" for v in r) for r in rows]
    words = [(lang, source, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]) for text, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df = Counter(w for la, _, ws in words if la == lang for w in set(ws))
        kept = sorted((w for w, n in df.items() if n >= least), key=lambda w: w.encode())
        sources = sorted({r[2] for r in rows if r[1] == lang})
        count = {s: Counter(w for la, so, ws in words if (la, so) == (lang, s) for w in ws if df[w] >= least) for s in sources}
        every = sum(count.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        freq, q = {s: p(count[s]) for s in sources}, p(every)
        for s in sources:
            pairs = [(-sum(f(freq[s][w], freq[o][w]) for w in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(freq[s][w], q[w]), w.encode(), w) for w in kept if count[s][w] and freq[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_divergence_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(divergence, "WIDTH", 5)  # several chunks and blocks, counters given out often
    monkeypatch.setattr(divergence, "CELLS", 8)
    monkeypatch.setattr(divergence, "HELD", 30)
    words = [f"{a}{b}" for a in ("zü", "Aa", "é", "q", "𝔘", "｡") for b in "abcdef"]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 3, 40]))), rng.choice(["en", "de", None, "", "fr"]), rng.choice(["s1", "S", "é", "𝔘", "｡", None])) for _ in range(150)]
    rows += [(t, "en", "s1") for t in ODD] + [("same words here", "en", "s1")] * 60 + [("alone", "xx", "only"), (None, "yy", "a"), ("few", "yy", "b")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "text string, lang string, source string, n int, part string").repartition(5)
    got = divergence.audit(df, least=4)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == audited(rows, least=4)
    assert ("yy", "a", "pair", "b", 0, 1) in map(tuple, got.collect())


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_frequency_is_exact():
    rng = random.Random(1)
    for top in (10, 10**6, (1 << 63) // 1000 - 1, 1 << 62):
        total = [rng.randrange(1, top + 1) for _ in range(200)]
        count = [rng.randrange(t + 1) for t in total]
        assert divergence.frequency(np.array(count), np.array(total)).tolist() == [1 + 10**9 * c // t for c, t in zip(count, total, strict=True)]


def white(vectors, k=16):
    """Distinct x, their exact centred covariance and its eigenvectors, by integers."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = [list(t) for t in {tuple(v) for v in x}]
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = [[n * a - b for a, b in zip(v, s, strict=True)] for v in fit]
    scatter = [[sum(r[i] * r[j] for r in y) for j in range(len(s))] for i in range(len(s))]
    e, u = np.linalg.eigh(np.array([[v / n**3 for v in r] for r in scatter]))
    return x, n, s, scatter, e[::-1][:k], u[:, ::-1][:, :k]


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(2)
    base = (rng.normal(0, 1, (60, 5)) @ rng.normal(0, 3, (5, 5))).astype(np.float32)
    vectors = [*base.tolist(), *[base[0].tolist()] * 40]
    odd = [None, [], [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in enumerate([*vectors, *odd])], "vec_id long, embedding array<float>, n int, component int").repartition(4)
    x, n, s, scatter, e, u = white(vectors)
    fit = whitening.quantized(df).select("x").distinct()
    assert whitening.sums_of(fit)[:2] == (n, s)
    assert whitening.scatter(fit, n, s, whitening.sums_of(fit)[2]).tolist() == scatter
    got = whitening.whitened(df).collect()
    assert len(got) == 100 * 5 and {r.vec_id for r in got} == set(range(100)) and {r.n for r in got} == {n}
    assert {r.vec_id: r.deviation for r in got} == {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}
    want = (np.array(x) - np.array(s) / n) @ u / np.sqrt(e)
    mine = np.zeros_like(want)
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(e[r.component - 1] / (sum(scatter[i][i] for i in range(5)) / n**3), rel=1e-9) and r.identity_error < 1e-9
    signs = np.sign((mine * want).sum(0))
    assert np.allclose(mine, want * signs, atol=1e-7)


def test_whitening_of_large_entries_is_exact(spark):
    vectors = [[1e15, -1e15, 3.0], [1e9, 5e14, 0.5], [-1e300, 1.0, 2.0], [0.25, 0.5, 0.75]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    far = [[min(max(64 * c, -(2.0**50)), 2.0**50) / 64 for c in v] for v in vectors]
    x, n, s, scatter, _, _ = white(far)
    fit = whitening.quantized(df).select("x").distinct()
    assert whitening.scatter(fit, *whitening.sums_of(fit)).tolist() == scatter
    square = {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in enumerate(x)}
    assert {r.vec_id: r.deviation for r in whitening.whitened(df).collect()} == {i: v if v < 1 << 63 else None for i, v in square.items()}


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_whitening_without_variance(spark, vectors):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    assert whitening.whitened(df).count() == 0


def test_whitening_query(spark):
    got = queries.op12_whitening(spark, SF).toPandas()
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x, n, s, scatter, e, u = white(table["embedding"])
    assert len(got) == 16 * len(x) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-4
    want = {i: sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for i, v in zip(table["vec_id"], x, strict=True)}
    assert dict(zip(got["vec_id"], got["deviation"], strict=True)) == want
    first = got[got["component"] == 1].set_index("vec_id")["whitened"]
    line = {i: float((np.array(v) - np.array(s) / n) @ u[:, 0] / np.sqrt(e[0])) for i, v in zip(table["vec_id"], x, strict=True)}
    sign = np.sign(sum(line[i] * v for i, v in first.items()))
    assert all(abs(line[i] * sign - v) < 1e-6 for i, v in first.items())


def laid(df, docs, shards=8):
    """Every row once, counts at most one apart, slots without gaps; the order."""
    rows = df.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(docs)
    for r in rows:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(shards)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    return [(r.doc_id, r.text) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]


def test_shards_are_even_and_agree(spark):
    docs = [(i, f"text {i} " * (i % 7)) for i in range(500)] + [(500 + i, t) for i, t in enumerate(ODD)]
    frame = lambda rows, n: spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, law string, slot int").repartition(n)
    order = laid(sharding.dealt(frame(docs, 3), bucket=1 << 10), docs)
    assert laid(sharding.dealt(frame(docs[::-1], 7), bucket=1 << 10), docs) == order  # whatever the partitions
    assert laid(sharding.dealt(frame(docs, 3), bucket=1 << 10, seed=2), docs) != order
    place = np.array([i for i, _ in order])
    assert abs(np.corrcoef(place, np.arange(len(place)))[0, 1]) < 0.2  # shuffled
    assert (np.diff(place) == 1).sum() < 10


def test_equal_rows_are_dealt_to_parts(spark):
    docs = [(7, "same " * 10)] * 400 + [(None, None)] * 300 + [(i, f"t{i}") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = sharding.scattered(sharding.sized(df), 1, 1 << 9).groupBy("_bucket", "_sub").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in rows) < 1 << 12 and len({r._sub for r in rows}) > 5
    laid(sharding.dealt(df, bucket=1 << 9), docs)


@pytest.mark.parametrize("n", [0, 1, 5, 8])
def test_few_rows(spark, n):
    docs = [(i, "t") for i in range(n)]
    laid(sharding.dealt(spark.createDataFrame(docs, "doc_id long, text string")), docs)


def test_shards_written(spark, tmp_path):
    docs = [(i, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    laid(sharding.write(df, f"file://{tmp_path}/shards", bucket=1 << 10), docs)
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={i}" for i in range(8)]
    for f in (tmp_path / "shards").glob("shard=*/*.parquet"):
        slots = pq.ParquetFile(f).read(["slot"])["slot"].to_pylist()
        assert slots == sorted(slots)


def test_sharding_query(spark):
    got, table = queries.op13_sharding(spark, SF), pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(table["doc_id"]) and got.columns[:4] == ["doc_id", "size", "text_crc32", "law"]
    crc = {i: zlib.crc32((t or "").encode()) for i, t in zip(table["doc_id"], table["text"], strict=True)}
    assert all(crc[r.doc_id] == r.text_crc32 for r in rows)
