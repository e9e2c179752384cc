"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (lines, long ones cut), each encoded by hashed character shapes and a few densities. From
document labels alone a gated attention learns which passages tell the label; the weighted passage gives the score.
The model is fitted on a bounded sample of labelled documents and applied to every passage of every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, mixed, pieces, text_of

#: Hashed shape trigrams of a passage; densities beside them; bytes up to which a line is one passage; width of the encoding.
SHAPES, DENSITIES, PASSAGE, HIDDEN = 192, 9, 400, 16
#: Bounds of the fitting sample: documents, and passages of each of them.
SAMPLE, SAMPLE_PASSAGES = 3000, 64
#: Bytes of text whose passages are encoded at once, a multiple of PASSAGE; letters whose words are compared at once.
BLOCK, PIECE = 64 * PASSAGE, 1 << 18
#: Score from which a document counts as good.
GOOD = 0.3

_GAP = re.compile(r"\s")
#: Shape of a byte: lower-case letters and bytes beyond ASCII are a, capitals A, digits 9, others stand for themselves.
_SHAPE = np.array([97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256)], np.uint32)


def repetition(text: str) -> float:
    """Share of words that repeat the word before, in pieces of a text that end with a word."""
    n, same, last, at = 0, 0, None, 0
    while at < len(text):
        end = _GAP.search(text, at + PIECE)
        to = end.start() if end else len(text)
        words = text[at:to].lower().split()
        if words:
            same += (words[0] == last) + sum(map(eq, words, words[1:]))
            n, last = n + len(words), words[-1]
        at = to
    return same / max(n, 1)


def blocks(text: str | None) -> Iterator[np.ndarray]:
    """Features of all passages of a whole text, float32, in their order, at most about BLOCK bytes of text at once; null and
    empty texts are one empty passage. A block ends with a line or, in a long line, with a passage."""
    b = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(b):
        yield np.zeros((1, SHAPES + DENSITIES), np.float32)
        return
    repeats, at = repetition(text), 0
    while at < len(b):
        to = min(at + BLOCK, len(b))
        if to < len(b) and len(lines := np.flatnonzero(b[at:to] == 10)):
            to = at + int(lines[-1]) + 1
        yield _features(b, at, to, repeats)
        at = to


def passages(text: str | None) -> np.ndarray:
    """Features of all passages of a whole text together."""
    return np.concatenate(list(blocks(text)))


def _features(text: np.ndarray, at: int, to: int, repeats: float) -> np.ndarray:
    """Of the passages between two places of a text's bytes, the first of which begins a passage."""
    before = min(at, 2)  # bytes that shapes at the beginning look back on
    b = text[at - before : to]
    new = np.concatenate([[True], b[before:-1] == 10])
    start = np.flatnonzero(new)
    within = np.arange(len(new)) - np.repeat(start, np.diff(np.append(start, len(new))))
    part = np.cumsum(new | (within % PASSAGE == 0)) - 1
    n = int(part[-1]) + 1
    size = np.bincount(part, minlength=n).astype(np.float32)
    s = _SHAPE[b]
    h = np.zeros(len(b), np.uint32)
    h[:] = s * np.uint32(0x01000193)
    h[1:] += s[:-1] * np.uint32(0x85EBCA6B)
    h[2:] += s[:-2] * np.uint32(0xC2B2AE35)
    cell = (((h * np.uint32(0x9E3779B1)) >> np.uint32(16)) % np.uint32(SHAPES))[before:]
    grams = np.bincount(part * SHAPES + cell, minlength=n * SHAPES).reshape(n, SHAPES)
    out = np.empty((n, SHAPES + DENSITIES), np.float32)
    out[:, :SHAPES] = np.sqrt(grams / size[:, None])
    share = lambda mask: np.bincount(part, mask[before:], n) / size
    space = (s == 32) | (s == 10) | (s == 9)
    letter = (s == 97) | (s == 65)
    edge = np.concatenate([[False], space[:-1]]) & ~space
    same = np.concatenate([[False], b[1:] == b[:-1]])
    dense = [share(space), share(letter), share(s == 65), share(s == 57), share(~space & ~letter & (s != 57)), share(edge) * 4, share(same) * 4, np.log1p(size) / 8, np.full(n, repeats)]
    out[:, SHAPES:] = np.stack(dense, 1)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    offset: float

    def forward(self, x: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages of several bags (standardised); start: first row of each bag."""
        w = self.w
        bag = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(x))))
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        e = (t * s) @ w["a"]
        e = np.exp(e - np.maximum.reduceat(e, start)[bag])
        a = e / np.add.reduceat(e, start)[bag]
        z = np.add.reduceat(a[:, None] * h, start)
        return {"bag": bag, "h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ w["c"] + w["d"]}

    def read(self, blocks: Iterator[np.ndarray]) -> tuple[float, float]:
        """Probability of a good document from blocks of its passages, and the weight of the heaviest: the attention of all
        passages, by a running maximum, sum of weights and weighted sum."""
        w, most, total, z = self.w, -np.inf, 0.0, 0.0
        for x in blocks:
            h = np.tanh((x - self.mean) / self.scale @ w["W"] + w["b"])
            e = (np.tanh(h @ w["V"]) / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))) @ w["a"]
            top = max(most, float(e.max()))
            held, e = np.exp(most - top), np.exp(e - top)
            most, total, z = top, total * held + float(e.sum(dtype=np.float64)), z * held + (e @ h).astype(np.float64)
        logit = z / total @ w["c"] + w["d"] + self.offset
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))), 1 / total

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Probability of a good document for each bag, and its passages' attention."""
        start = np.cumsum([0, *map(len, bags[:-1])])
        f = self.forward((np.concatenate(bags) - self.mean) / self.scale, start)
        return 1 / (1 + np.exp(-np.clip(f["logit"] + self.offset, -30, 30))), np.split(f["a"], start[1:])


def gradient(m: Model, x: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Derivatives of the mean weighted logistic loss of bags (see forward()) by the model's weights."""
    f, p = m.forward(x, start), m.w
    ds = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) * weight / len(y)
    dz = ds[:, None] * p["c"]
    da = (dz[f["bag"]] * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, start)[f["bag"]])
    gate = f["t"] * f["s"]
    dg = de[:, None] * p["a"]
    dt, du = dg * f["s"] * (1 - f["t"] ** 2), dg * gate * (1 - f["s"])
    dh = (f["a"][:, None] * dz[f["bag"]] + dt @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ du, "a": gate.T @ de, "c": f["z"].T @ ds, "d": ds.sum()}


def train(bags: list[np.ndarray], y: np.ndarray, prior: float, epochs: int = 14, seed: int = 3) -> Model:
    """Fits by Adam on small groups of bags; ``prior`` is the share of good documents that scores are adjusted to."""
    rng, every = np.random.default_rng(seed), np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    d, k = every.shape[1], HIDDEN
    w = {"W": rng.normal(0, d**-0.5, (d, k)), "b": np.zeros(k), "V": rng.normal(0, k**-0.5, (k, k)), "U": rng.normal(0, k**-0.5, (k, k)), "a": rng.normal(0, k**-0.5, k), "c": rng.normal(0, k**-0.5, k), "d": np.zeros(())}
    m = Model(mean, scale, {n: v.astype(np.float32) for n, v in w.items()}, 0.0)
    first, second, step = {n: 0 * v for n, v in m.w.items()}, {n: 0 * v for n, v in m.w.items()}, 0
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
    groups = max(1, len(bags) // 64)
    epochs = max(epochs, 500 // groups)  # few documents need more rounds
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(bags)), groups):
            start = np.cumsum([0, *(len(bags[i]) for i in rows[:-1])])
            x = (np.concatenate([bags[i] for i in rows]) - mean) / scale
            grad, p = gradient(m, x, start, y[rows], weight[rows]), m.w
            step += 1
            rate = 0.005 * (1 - 0.8 * epoch / epochs)
            for n, g in grad.items():
                g = g + 1e-4 * p[n]
                first[n], second[n] = 0.9 * first[n] + 0.1 * g, 0.999 * second[n] + 0.001 * g * g
                p[n] = (p[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    m.offset = float(np.log(prior / (1 - prior)))  # classes weighed the same in the fit
    return m


def held_out() -> Column:
    """Rows that are never learned from: crc32 of doc_id as text is divisible by 5; also rows without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _some(text: str | None, doc_id: int, most: int) -> np.ndarray:
    """At most ``most`` of a text's passages, by a hash of doc_id and place, in their order."""
    x, place, seed, n = np.zeros((0, SHAPES + DENSITIES), np.float32), np.zeros(0, np.uint64), mixed(np.array([doc_id]).astype(np.uint64)), 0
    for block in blocks(text):
        x, place = np.concatenate([x, block]), np.concatenate([place, np.arange(n, n + len(block), dtype=np.uint64)])
        n += len(block)
        if len(x) > most:
            keep = np.sort(np.argsort(mixed(seed + place), kind="stable")[:most])
            x, place = x[keep], place[keep]
    return x


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, sample: int = SAMPLE, most: int = SAMPLE_PASSAGES) -> Model | None:
    """The model from documents whose label in labels (doc_id, quality) is 0 or 1; None unless both occur.

    About sample / 2 documents of each label are chosen by a hash of doc_id. Of a document with more than ``most`` passages,
    that many are learned from, chosen by a hash of doc_id and place; no document's use depends on another's length. A
    document with several labels counts with their mean, rounded.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    marks = (marks if learn is None else marks.filter(learn)).groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000))
    share = F.when(F.col("y") == 1, min(1.0, sample / 2 / sizes[1])).otherwise(min(1.0, sample / 2 / sizes[0]))
    chosen = marks.withColumn("draw", draw).filter(F.col("draw") < share * 1_000_000)
    rows = text_of(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen: at most about ``sample`` rows
    rows = rows.groupBy("doc_id", "draw", "y").agg(F.min("text").alias("text"))  # one row of an id that repeats

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [_some(t, i, most).astype(np.float16).tobytes() for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["draw"], batch["y"], pa.array(x, pa.binary())], ["doc_id", "draw", "y", "x"])

    rows = rows.select("doc_id", "draw", "y", "text").mapInArrow(featured, "doc_id long, draw long, y int, x binary")
    got = rows.orderBy("draw", "doc_id").limit(2 * sample).toPandas()
    bags = [np.frombuffer(v, np.float16).reshape(-1, SHAPES + DENSITIES).astype(np.float32) for v in got["x"]]
    y = got["y"].to_numpy()
    if len(set(y)) < 2:
        return None
    return train(bags, y.astype(np.float32), sizes[1] / (sizes[0] + sizes[1]))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with score (0 to 1), predicted (1 from GOOD on) and attention (weight of the heaviest passage).

    Null and empty texts are scored as one empty passage; without a model all scores are 0.5. Equal texts get equal values.
    Other columns are kept, columns of these names replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted", "attention")
    schema = extended(docs, score="double", predicted="int", attention="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in pieces(batches, text, rows=64):
            score, most = np.full(len(batch), 0.5), np.ones(len(batch))
            for i, t in enumerate(batch[text].to_pylist() if m else []):
                score[i], most[i] = m.read(blocks(t))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= GOOD).astype(np.int32)), pa.array(most)], [*batch.schema.names, "score", "predicted", "attention"])

    return docs.mapInArrow(run, schema)
