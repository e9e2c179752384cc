"""Language identification by error-correcting output codes.

Every language has a codeword; for each bit a binary classifier over byte n-grams predicts it. A text's language is the one
whose codeword has the least loss, each bit weighed by how well its classifier separates the learning rows; where the
runner-up is close, the row is flagged as ambiguous. Classifiers are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, pieces, text_of

UNKNOWN = "und"
#: Hashed n-gram features; sizes of n-grams in bytes.
FEATURES, SIZES = 4096, (1, 2, 3)
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 18
#: Bound of the sample that classifiers are fitted on: rows in all, dealt evenly to the languages.
SAMPLE = 3000
#: A text is ambiguous if the runner-up is at least this likely in relation to the winner.
AMBIGUOUS = 0.8

_KEEP = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts of the whole lower-cased text, of length 1. Other than letters are spaces.

    Bytes are taken in blocks, each with the last ones of the block before, so that memory grows with the text's bytes only.
    """
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    counts, carried, last = np.zeros(FEATURES, np.int64), np.zeros(0, np.uint32), 0
    for at in range(0, len(data), BLOCK):
        new = _KEEP[data[at : at + BLOCK]]
        old, b = len(carried), np.concatenate([carried, new[(new != 32) | (np.concatenate([[last], new[:-1]]) != 32)]])  # runs of spaces count once
        h = np.zeros(len(b), np.uint32)
        for n in range(1, max(SIZES) + 1):
            if len(b) < n:
                break
            h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(1)
            if n in SIZES:
                counts += np.bincount((h[max(0, old - n + 1) :] * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=FEATURES)
        carried, last = b[max(0, len(b) - max(SIZES) + 1) :], int(new[-1])
    out = np.sqrt(counts).astype(np.float32)
    return out / max(float(np.linalg.norm(out)), 1e-9)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of bits -1 and 1: all distinct splits up to 7 languages, beyond that the best of random codes."""
    if k <= 7:
        bits = [[1 if c == 0 or not (split >> (c - 1)) & 1 else -1 for c in range(k)] for split in range(1, 2 ** max(k - 1, 0))]
        return np.array(bits or [[1] * k], np.float32).reshape(-1, k).T
    rng, length = np.random.default_rng(seed), int(np.ceil(12 * np.log2(k)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.float32), (k, length))
        distance = int((length - (code @ code.T - 2 * length * np.eye(k)).max()) // 2)
        if distance > most and (np.abs(code.sum(0)) < k).all():
            best, most = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows of features: index of the language, its probability, ambiguity."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        second = order[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return p.argmax(1), p.max(1), second >= AMBIGUOUS * order[:, -1]


def _sampled(rows: DataFrame, quota: dict[str, float]) -> DataFrame:
    share = F.element_at(F.create_map(*(F.lit(x) for kv in quota.items() for x in kv)), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1e6
    return rows.withColumn("draw", draw).filter(F.col("draw") < share)


def trained(languages: list[str], who: np.ndarray, x: np.ndarray, steps: int) -> Model:
    """The classifiers of languages from rows of features, ``who`` being each row's language by index."""
    each = (1 / (np.bincount(who) * len(languages)))[who].astype(np.float32)[:, None]  # languages weigh the same
    code = codewords(len(languages))
    y, w, b = code[who], np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):  # logistic regression of all bits at once, with momentum
        pull = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * each
        mw, mb = 0.9 * mw + x.T @ pull + 1e-5 * w, 0.9 * mb + pull.sum(0)
        w, b = w - 4.0 * mw, b - 0.4 * mb
    wrong = ((y * (x @ w + b) <= 0) * each).sum(0)
    return Model(languages, code, w, b, np.clip(1 - 2 * wrong, 0.05, 1).astype(np.float32))


def fit(docs: DataFrame, learn: Column | None = None, sample: int = SAMPLE, steps: int = 150) -> Model | None:
    """The classifiers, from rows of docs (doc_id, text, lang) where ``learn`` holds, with text and lang; None if there are none.

    Each language gives about sample / languages rows, chosen by a hash of doc_id, so that reruns agree. The task that
    these rows meet in fits the classifiers; the driver gets their weights only, whatever the sample's size.
    """
    rows = text_of(docs if learn is None else docs.filter(learn), "doc_id", "text", "lang").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(10_001).collect()}
    if len(sizes) > 10_000:
        raise ValueError("more than 10000 languages")
    if not sizes:
        return None
    quota = {k: min(1.0, 1.2 * max(sample / len(sizes), 1) / n) for k, n in sizes.items()}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).astype(np.float16).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["lang"], batch["draw"], pa.array(x, pa.binary())], ["doc_id", "lang", "draw", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [batch for batch in batches if len(batch)]
        if not got:
            return
        got = pa.Table.from_batches(got).sort_by([("lang", "ascending"), ("doc_id", "ascending")])
        x = np.empty((len(got), FEATURES), np.float32)
        for i, v in enumerate(got["x"]):
            x[i] = np.frombuffer(v.as_buffer(), np.float16)
        languages, who = np.unique(got["lang"].to_numpy().astype(object), return_inverse=True)
        m = trained(list(languages), who, x, steps)
        parts = [v.astype(np.float32).tobytes() for v in (m.weights, m.bias, m.trust)]
        yield pa.RecordBatch.from_arrays([pa.array([m.languages], pa.list_(pa.string())), *(pa.array([v], pa.binary()) for v in parts)], ["languages", "weights", "bias", "trust"])

    once = _sampled(rows, quota).groupBy("doc_id", "draw").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "draw", "r.lang", "r.text")  # one row of an id that repeats
    some = once.mapInArrow(featured, "doc_id long, lang string, draw double, x binary")
    some = some.orderBy("draw", "doc_id").limit(2 * sample + 2 * len(sizes)).select("doc_id", "lang", "x").coalesce(1)
    told = some.mapInArrow(fitted, "languages array<string>, weights binary, bias binary, trust binary").collect()
    if not told:
        return None
    languages, weights, bias, trust = told[0]
    return Model(languages, codewords(len(languages)), *(np.frombuffer(v, np.float32).reshape(shape) for v, shape in ((weights, (FEATURES, -1)), (bias, -1), (trust, -1))))


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous, from whole texts alone; columns of these names are replaced.

    ``und`` with score 0 for texts that are null, empty or have no letter, and for all if there is no model. Equal texts
    get equal values.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    schema = extended(docs, lang_pred="string", score="double", ambiguous="boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in pieces(batches, text):
            texts = batch[text].to_pylist()
            lang, score, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            rows = [i for i, t in enumerate(texts) if t and any(c.isalpha() for c in t)] if m else []
            if rows:
                for i, k, s, u in zip(rows, *m.decode(np.stack([features(texts[i]) for i in rows])), strict=True):
                    lang[i], score[i], unsure[i] = m.languages[k], float(s), bool(u)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Rows that are never learned from: crc32 of doc_id as text is 2 modulo 4; also rows without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
