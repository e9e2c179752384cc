"""Summaries against a graph with all its edges, learned labels against loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.operators import classify, summary
from millrace.plans.registry import QUERIES

TURNS = "conv string, turn int, text string"


def walked(words, steps=summary.STEPS, damping=summary.DAMPING):
    """The walk with a matrix of all pairs."""
    n = len(words)
    w = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) if i != j and a and b else 0 for j, b in enumerate(words)] for i, a in enumerate(words)])
    degree = w.sum(0)
    x = np.full(n, 1 / n)
    for _ in range(steps):
        x = (1 - damping) / n + damping * w @ np.where(degree > 1e-12, x / np.where(degree > 1e-12, degree, 1), 0)
    return np.round(x, summary.PLACES)


def split(text):
    return [s.strip()[: summary.LONGEST] for s in re.findall(r"[^.!?\n]+", text or "") if re.search(r"[^\W\d_]{3,}", s)]


def told(turns, most=2, length=240):
    """Best sentences of each conversation, segment by segment."""
    out = {}
    for conv in {c for c, _, _ in turns if c is not None}:
        rows = [s for _, t, text in sorted((r for r in turns if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1]) for s in split(text)]
        n, score = len(rows), []
        while rows:
            parts, again = [rows[i : i + summary.SEGMENT] for i in range(0, len(rows), summary.SEGMENT)], []
            for part in parts:
                score = walked([set(re.findall(r"[^\W\d_]{3,}", s.lower())) for s in part])
                best = sorted(sorted(range(len(part)), key=lambda i: (-score[i], i))[: most if len(parts) == 1 else summary.WINNERS])
                again += [part[i] for i in best]
            rows = again
            if len(parts) == 1:
                break
        if n:
            out[conv] = (n, ". ".join(rows)[:length].rstrip(), float(score.max()))
    return out


@pytest.mark.parametrize("segment", [256, 7])
def test_summaries_against_all_pairs(spark, monkeypatch, segment):
    monkeypatch.setattr(summary, "SEGMENT", segment)
    monkeypatch.setattr(summary, "WINNERS", 3)
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice(["order", "refund", "parcel", "late", "money", "hello", "12", "ok", "étude", "phone"]) for _ in range(rng.randrange(1, 7))) + rng.choice(". ! ?".split() + ["\n"])
    turns = [(f"c{i}", t, "".join(say() for _ in range(rng.randrange(4)))) for i in range(8) for t in range(rng.randrange(1, 6))]
    turns += [("long", t, say()) for t in range(120)] + [("odd", 0, None), ("odd", 1, ""), ("odd", 2, "12. a b!"), (None, 1, "lost words."), ("none", None, "first words here."), ("none", 1, "then words there."), ("same", 1, "twice the same. twice the same."), ("wide", 1, "x" * 5000 + ". yes indeed.")]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, TURNS).repartition(3)
    got = {r.conv: (r.n_sentences, r.summary, r.score) for r in summary.summaries(df, "conv").collect()}
    want = told(turns)
    assert set(got) == set(want) and "odd" not in got
    for k, (n, text, score) in want.items():
        assert got[k][:2] == (n, text) and got[k][2] == pytest.approx(score, abs=1e-8), k
    assert all(len(v[1]) <= 240 for v in got.values())


def test_scores_of_unlinked_sentences():
    words = [{"aaa"}, {"bbb"}, set(), {"aaa", "ccc"}]
    assert np.allclose(summary.ranks(words), walked(words), atol=1e-8)


def test_learned_labels_by_loops(spark):
    rng = random.Random(3)
    vocabulary = {"price": ["how", "much", "cost", "shop"], "booking": ["table", "book", "time", "shop"], "other": ["hello", "shop", "Élan"]}
    rows = [(i, " ".join(rng.choices(vocabulary[k], k=rng.randrange(0, 6))), k) for i in range(120) for k in [rng.choice(list(vocabulary))]]
    rows += [(500, None, "price"), (501, "x", None), (502, "new unseen", None), (503, "SHOP shop", None), (504, "", None), (7, "other text of the id", None), (7, "other text of the id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    seen = lambda t: set(re.findall(r"[^\W\d_]{2,}", (t or "").lower()))
    learn = [(t, k) for _, t, k in rows if t is not None and k is not None]
    size, n = Counter(k for _, k in learn), len(learn)
    counts = {k: Counter(w for t, kk in learn if kk == k for w in seen(t)) for k in vocabulary}

    def ratio(w):
        there, out = sum(c[w] for c in counts.values()), 0
        for k in vocabulary:
            for o, e in ((counts[k][w], there * size[k] / n), (size[k] - counts[k][w], (n - there) * size[k] / n)):
                out += 2 * o * math.log(o / e) if o else 0
        return out

    known = {w for w in set().union(*counts.values()) if ratio(w) >= classify.SIGNIFICANT}
    assert 0 < len(known) < len(set().union(*counts.values()))
    want = Counter()
    for i, t, _ in rows:
        w = seen(t) & known
        total = {k: sum(counts[k][x] for x in known) + len(known) for k in vocabulary}
        score = {k: math.log(size[k] / n) + sum(math.log((counts[k][x] + 1) / total[k]) for x in w) for k in vocabulary}
        best = sorted(sorted(score), key=lambda k: -score[k])
        lead = score[best[0]] - score[best[1]]
        want[i, best[0] if lead >= 0.05 else "abstain", round(lead, 6)] += 1
    got = classify.labelled(df, classify.fit(df), margin=0.05)
    assert Counter((r.doc_id, r.label_pred, round(r.margin, 6)) for r in got.collect()) == want
    assert classify.labelled(df.limit(0), classify.fit(df)).count() == 0
    with pytest.raises(ValueError):
        classify.fit(df.limit(0))
    assert {r.label_pred for r in classify.labelled(df, classify.fit(df.filter("label = 'price'"))).collect()} == {"price"}


def test_learned_labels_beat_the_rule(spark):
    got = {r.label: r for r in QUERIES["intent_held_out"](spark, "/root/testdata/sf0.1").collect()}
    n, decided, hits, rule = (sum(r[c] for r in got.values()) for c in ("n", "decided", "hits", "rule_hits"))
    assert decided > 0.9 * n and hits / decided > 0.95 and hits / decided > rule / n
    assert got["complaint"].hits > 0.6 * got["complaint"].n  # of the rarer label, which the rule misses
