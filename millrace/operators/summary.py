"""Extractive summaries: the sentences of a conversation that its other sentences point to most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import numbered, written

#: Share that follows links, steps; sentences that are weighed against each other at once, and those that go on to the next round.
DAMPING, STEPS, SEGMENT, WINNERS = 0.85, 12, 256, 16
#: Places of scores that count; letters of a sentence that are kept.
PLACES, LONGEST = 9, 400
_SENTENCE, _WORD = regex.compile(r"[^.!?\n]+"), regex.compile(r"\p{L}{3,}")


def ranks(words: list[set[str]], damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Scores of sentences given as sets of words: a damped walk over the graph whose edges weigh
    shared words / sqrt(words * words), without loops. Edges are never made: a step goes to the words and back, so that its
    cost grows with the words. Sentences that share nothing pass nothing on."""
    n = len(words)
    ids = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    row = np.repeat(np.arange(n), [len(s) for s in words])
    column = np.array([ids[w] for s in words for w in sorted(s)], np.int64)
    size = np.sqrt(np.maximum([len(s) for s in words], 1))
    weight = 1 / size[row]

    def through(x: np.ndarray) -> np.ndarray:
        y = np.bincount(column, weight * x[row], len(ids))
        own = np.where([bool(s) for s in words], x, 0)
        return np.bincount(row, weight * y[column], n) - own

    degree = through(np.ones(n))
    degree = np.where(degree > 1e-12, degree, np.inf)
    x = np.full(n, 1 / n)
    for _ in range(steps):
        x = (1 - damping) / n + damping * through(x / degree)
    return np.round(x, PLACES)


def sentences(turns: DataFrame, key: str, turn: str = "turn", text: str = "text") -> DataFrame:
    """key, at (a number that orders a key's sentences), sentence (its first LONGEST letters) of turns; those without a word
    of three letters are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, said in zip(*(batch[c].to_pylist() for c in (key, turn, text)), strict=True):
                for i, s in enumerate(_SENTENCE.findall(said or "")):
                    if _WORD.search(s):
                        out.append((k, [t, i], s.strip()[:LONGEST]))
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch[key].type), pa.array(columns[1], pa.list_(pa.int64())), pa.array(columns[2], pa.string())], [key, "at", "sentence"])

    kind = turns.schema[key].dataType.simpleString()
    return turns.select(key, F.col(turn).cast("long").alias(turn), text).filter(F.col(key).isNotNull()).mapInArrow(run, f"{key} {kind}, at array<long>, sentence string")


def summaries(turns: DataFrame, key: str, turn: str = "turn", text: str = "text", most: int = 2, length: int = 240) -> DataFrame:
    """key, n_sentences, summary, score for each conversation of turns with a sentence: its ``most`` best sentences in their order,
    at most ``length`` letters, and the best score.

    Ties go to the earlier sentence. A conversation of more than SEGMENT sentences is weighed in segments of that many; the WINNERS
    best of each meet in the next round, until one segment is left, so that no task holds more than a segment and no pairs are made.
    Null keys and texts have no sentences; a turn without a number comes first.
    """
    kind = turns.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, segment long, at array<long>, sentence string, score double, place int"

    def weighed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(_at=[[(-1 if v is None or v != v else v) for v in a] for a in group["at"]]).sort_values("_at", kind="stable").drop(columns="_at").reset_index(drop=True)
        score = ranks([set(_WORD.findall(s.lower())) for s in group["sentence"]])
        order = np.argsort(-score, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(1, len(order) + 1)
        return group.assign(score=score, place=place)

    rows = written(sentences(turns, key, turn, text), "sentences")
    counts = rows.groupBy(key).agg(F.count("*").alias("n_sentences"))
    done: list[DataFrame] = []
    while True:
        rows = numbered(rows, key, "at", "_i", "segments").withColumn("segment", F.expr(f"_i div {SEGMENT}")).drop("_i")
        scored = written(rows.select(key, "segment", "at", "sentence").groupBy(key, "segment").applyInPandas(weighed, schema), "weighed")
        wide = scored.filter("segment > 0").select(key).distinct()
        done.append(scored.join(wide, key, "left_anti"))
        if wide.isEmpty():
            break
        rows = written(scored.join(wide, key, "left_semi").filter(F.col("place") <= WINNERS).select(key, "at", "sentence"), "winners")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    best = found.filter(F.col("place") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "sentence"))).alias("s"), F.max("score").alias("score"))
    return best.join(counts, key).select(key, "n_sentences", F.rtrim(F.substring(F.array_join(F.col("s.sentence"), ". "), 1, length)).alias("summary"), "score")
