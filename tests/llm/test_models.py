"""Language and quality models against slow versions, and the bounds of their memory."""

import math
import subprocess
import sys
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, quality

ODD = ["", "a", " ", "é  Ü", "x" * 3000, "1 2 3 \n\n ab", "ab\n" * 700, "ΑΣ Σ\u2003ΑΣ ab ab\x1cab", "\n", "a\n\n\nb" * 40, "word " * 900]


def slow_features(text):
    """Of every n-gram of the cleaned bytes, one by one."""
    data, b = b" " + text.lower().encode() + b" ", []
    for x in data:
        x = x if x >= 128 or chr(x).isalpha() else 32
        if x != 32 or not b or b[-1] != 32:
            b.append(x)
    counts = [0] * language.FEATURES
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            h = 0
            for x in b[i : i + n]:
                h = (h * 0x01000193 + x + 1) % 2**32
            counts[(h * 0x9E3779B1 % 2**32) >> 20] += 1
    v = np.sqrt(np.array(counts))
    return v / max(np.linalg.norm(v), 1e-9)


@pytest.mark.parametrize("block", [1 << 18, 7, 1])
def test_language_features_in_blocks(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    for t in ODD:
        assert np.allclose(language.features(t[:400]), slow_features(t[:400]), atol=1e-6), t[:20]


def test_language_decoding_by_hand(spark):
    rows = [(i, " ".join(w for w in ("der die das und", "the and of that", "le la les et")[i % 3].split()[i % 2 :]) + f" x{i}", ("de", "en", "fr")[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(docs, ~language.held_out())
    got = {r.doc_id: r for r in language.predict(docs, m).collect()}
    for i, text, _ in rows:
        x, losses = slow_features(text), []
        margins = [sum(x[j] * m.weights[j, bit] for j in np.flatnonzero(x)) + m.bias[bit] for bit in range(m.code.shape[1])]
        for k in range(len(m.languages)):
            losses.append(sum(math.log1p(math.exp(-margins[bit] * m.code[k, bit])) * m.trust[bit] for bit in range(m.code.shape[1])))
        p = [math.exp(min(losses) - v) for v in losses]
        order = sorted(p)
        assert got[i].lang_pred == m.languages[losses.index(min(losses))] and got[i].score == pytest.approx(max(p) / sum(p), abs=1e-3)
        if abs(order[-2] - language.AMBIGUOUS * order[-1]) > 1e-3:
            assert got[i].ambiguous == (order[-2] >= language.AMBIGUOUS * order[-1])


def slow_passages(text):
    """Features by loops over characters' bytes."""
    b = (text or "").encode()
    if not b:
        return [[0.0] * 201]
    parts, begun = [], 0
    for i in range(1, len(b) + 1):
        if i == len(b) or b[i - 1] == 10 or i - begun == quality.PASSAGE:
            parts.append((begun, i))
            begun = i
    shape = [97 if x >= 128 or 97 <= x <= 122 else 65 if 65 <= x <= 90 else 57 if 48 <= x <= 57 else x for x in b]
    words = text.lower().split()
    repeats = sum(words[i] == words[i - 1] for i in range(1, len(words))) / max(len(words), 1)
    out = []
    for a, z in parts:
        grams, n, dense = [0] * 192, z - a, [0] * 7
        for i in range(a, z):
            s = shape[i]
            h = s * 0x01000193 + (shape[i - 1] * 0x85EBCA6B if i >= 1 else 0) + (shape[i - 2] * 0xC2B2AE35 if i >= 2 else 0)
            grams[((h % 2**32) * 0x9E3779B1 % 2**32 >> 16) % 192] += 1
            space, letter = s in (32, 10, 9), s in (97, 65)
            edge = i > 0 and shape[i - 1] in (32, 10, 9) and not space
            for j, yes in enumerate((space, letter, s == 65, s == 57, not space and not letter and s != 57, edge, i > 0 and b[i] == b[i - 1])):
                dense[j] += yes
        out.append([*(math.sqrt(g / n) for g in grams), *(d / n * (4 if j >= 5 else 1) for j, d in enumerate(dense)), math.log1p(n) / 8, repeats])
    return out


@pytest.mark.parametrize("block", [64, 1, 2])
def test_passages_in_blocks(monkeypatch, block):
    monkeypatch.setattr(quality, "BLOCK", block * quality.PASSAGE)
    monkeypatch.setattr(quality, "PIECE", 5)
    for t in [None, *ODD]:
        assert np.allclose(quality.passages(t), slow_passages(t), atol=1e-5), (t or "")[:20]


def model(seed=1):
    rng, d, k = np.random.default_rng(seed), quality.SHAPES + quality.DENSITIES, quality.HIDDEN
    shapes = {"W": (d, k), "b": (k,), "V": (k, k), "U": (k, k), "a": (k,), "c": (k,), "d": ()}
    return quality.Model(rng.normal(0, 0.1, d), rng.uniform(0.5, 1, d), {n: rng.normal(0, 0.5, s) for n, s in shapes.items()}, 0.3)


def test_forward_pass_by_hand(monkeypatch):
    """Gated attention, one passage after the other, against the running form over blocks."""
    monkeypatch.setattr(quality, "BLOCK", quality.PASSAGE)
    m, w = model(), model().w
    for t in [None, *ODD, "A b!\n" + "zz 9\n" * 300]:
        h = [np.tanh((np.array(x) - m.mean) / m.scale @ w["W"] + w["b"]) for x in slow_passages(t)]
        e = [float((np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"])))) @ w["a"]) for v in h]
        a = [math.exp(v - max(e)) for v in e]
        z = sum(x / sum(a) * v for x, v in zip(a, h, strict=True))
        want = 1 / (1 + math.exp(-(z @ w["c"] + w["d"] + 0.3)))
        p, heaviest = m.read(quality.blocks(t))
        assert p == pytest.approx(want, abs=1e-4) and heaviest == pytest.approx(max(a) / sum(a), rel=1e-3)


def test_derivatives_agree_with_differences():
    m, rng = model(), np.random.default_rng(2)
    x, start = rng.normal(0, 1, (11, quality.SHAPES + quality.DENSITIES)), np.array([0, 3, 4, 8])
    y, weight = np.array([1.0, 0, 1, 0]), np.array([0.5, 2, 1, 1])

    def loss():
        f = m.forward(x, start)["logit"]
        return float((weight * (np.logaddexp(0, f) - y * f)).mean())

    grad = quality.gradient(m, x, start, y, weight)
    for n, g in grad.items():
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in m.w[n].shape)
            old, ends = m.w[n][at], []
            for step in (1e-5, -1e-5):
                m.w[n][at] = old + step
                ends.append(loss())
            m.w[n][at] = old
            assert np.asarray(g)[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6), n


def test_sampled_passages_are_those_of_the_whole_text(monkeypatch):
    text = "".join(f"line {i}\n" for i in range(900))
    whole = quality._some(text, 7, 64)
    monkeypatch.setattr(quality, "BLOCK", quality.PASSAGE)
    assert np.array_equal(quality._some(text, 7, 64), whole) and len(whole) == 64


@pytest.mark.parametrize("make", ['"a\\n" * 25_000_000', '"ab cd " * 8_000_000'])
def test_a_text_of_50_mb_needs_little_memory(make):
    """In a process of its own: peak memory above what is there with the text."""
    code = f"""
import resource
from millrace.llm import language, quality
from tests.llm.test_models import model
t = {make}
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
p = model().read(quality.blocks(t))
x = language.features(t)
print(p[0], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()
    assert 0 <= float(out[0]) <= 1 and int(out[1]) < 500, out


def test_repeated_ids_leave_the_sample_as_it_is(spark):
    rows = [(i, f"{'der die das' if i % 2 else 'the and of'} {i}", "de" if i % 2 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    often = docs.union(docs.filter("doc_id = 1").crossJoin(spark.range(500)).drop("id")).repartition(7)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    first, second = language.fit(docs, sample=20), language.fit(often, sample=20)
    assert first.languages == second.languages == ["de", "en"]
    assert set(language._sampled(docs, {"de": 1.0, "en": 1.0}).columns) >= {"doc_id", "draw"}
    scores = [sorted((r.doc_id, round(r.score, 6)) for r in quality.predict(docs, quality.fit(d, labels)).collect()) for d in (docs, often)]
    assert scores[0] == scores[1]


def test_language_sample_stays_out_of_the_driver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    language.fit(docs.limit(50))  # imports and the session's first uses aren't measured
    tracemalloc.start()
    m = language.fit(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = sorted((r.lang, r.doc_id, r.text) for r in docs.filter("lang is not null and text is not null").collect())
    assert most < 4 << 20 < 2 * language.FEATURES * len(rows)  # less than the features of the rows that are learned from, even as halves
    x = np.stack([language.features(t).astype(np.float16).astype(np.float32) for _, _, t in rows])
    want = language.trained(m.languages, np.array([m.languages.index(r[0]) for r in rows]), x, 150)
    assert m.languages == sorted({r[0] for r in rows}) and (m.code == want.code).all()
    for a, b in ((m.weights, want.weights), (m.bias, want.bias), (m.trust, want.trust)):
        assert a.dtype == b.dtype and a.shape == b.shape and np.allclose(a, b, atol=1e-4)
