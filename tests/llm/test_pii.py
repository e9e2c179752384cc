"""Spans of personal data in long texts, and what patterns find again of identifiers that were hidden."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.llm import pii

SPAN = "array<struct<s:int,e:int,kind:string,m:string>>"


def spans_of(rng, length, n, kinds=pii.KINDS):
    out = set()
    for _ in range(n):
        s = rng.randrange(length)
        out.add((s, min(length, s + rng.choice([1, 5, 40, 3000])), rng.choice(kinds), "m"))
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 5, 127, 128, 129, 300])
def test_free_spans_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i, spans_of(rng, 60_000 if i % 2 else 400, n), spans_of(rng, 60_000 if i % 2 else 400, 1 + n // 2)) for i in range(8)]
    df = spark.createDataFrame(rows, f"i int, taken {SPAN}, spans {SPAN}").withColumn("got", F.expr(pii._free("spans", "taken")))
    for r in df.collect():
        want = [x for x in r.spans if not any(b.s < x.e and x.s < b.e for b in r.taken)]
        assert sorted(map(tuple, r.got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_redact_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(pii, "BLOCK", block)
    rng = random.Random(block)
    texts = ["".join(rng.choice("abc é\n😀.") for _ in range(n)) for n in (1, 2, 50, 1023, 1024, 1025, 9000)]
    rows = [(i, t, spans_of(rng, len(t), rng.choice([0, 1, 4, 60]))) for i, t in enumerate(texts * 3)] + [(99, None, []), (100, "", [])]
    for r, (_, text, spans) in zip(pii.redact(spark.createDataFrame(rows, f"i int, text string, spans {SPAN}")).orderBy("i").collect(), rows, strict=True):
        out, at = [], 0
        while spans:
            s, e, kind, _ = spans[0]
            while spans and (spans[0][0] < e):
                e = max(e, spans.pop(0)[1])
            out.append(text[at:s] + f"[{kind.upper()}]")
            at = e
        assert r.text == ("".join(out) + text[at:] if text else text)


def test_a_hundred_thousand_spans_in_one_text(spark):
    n = 100_000
    df = spark.createDataFrame([(" ".join(f"u{i}@a.example, and" for i in range(n)),)], "text string")
    found = pii.find(df)
    began = time.time()
    out = pii.redact(found).select(F.regexp_count("text", F.lit(r"\[EMAIL\], and")).alias("n"), F.contains("text", F.lit("@")).alias("left")).first()
    assert (out.n, out.left) == (n, False) and time.time() - began < 60


def test_hidden_identifiers_are_found_again_by_their_contexts(spark):
    """Contexts on the left, on the right and on both sides; numbers in other contexts are told nothing."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 5, 8])))
    ip = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    texts = [f"{word()} {word()} write to {word()}{i}@{word()}.example {word()} {word()}" for i in range(120)]
    texts += [f"{word()} {word()} {ip()} was the host {word()}" for _ in range(120)]
    texts += [f"{word()} ring +1 555 {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} at noon {word()}" for _ in range(120)]
    texts += [f"{word()} {word()} in chapter {i}.{rng.randrange(9)}.{rng.randrange(9)}{i} {word()}" for i in range(100, 220)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.kind: r for r in pii.found_again(docs).collect()}
    assert set(got) == {"email", "ip", "phone"}
    for kind in got:
        assert got[kind].hidden >= 5 and got[kind].right >= 0.9 * got[kind].hidden and got[kind].right == got[kind].told, got
    assert pii.find(docs).filter("size(spans) > size(base)").count() == 0
    assert pii.found_again(docs.limit(0)).count() == 0
