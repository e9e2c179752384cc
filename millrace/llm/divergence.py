"""How far sources of a language diverge in their words, by integer dictionaries and exact arithmetic.

One pass over the texts counts words by group; what tasks have counted meets by word, never as texts. The kept words of a
language, in UTF-8 order, are cut into chunks; within a chunk a word's id is its place in the sorted array, found by
searchsorted, a bincount of (source, id) gives the dense count vectors of all sources, and ids in order break ties as words do.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, small, written

#: Documents of a language that a kept word is in, at least; ranks of words that are told; scale of the frequencies.
LEAST, RANKS, SCALE = 10, 10, 1_000_000_000
#: Counters that a task holds before it gives them out; words of a chunk; cells of dense vectors that are made at once.
HELD, WIDTH, CELLS = 300_000, 2048, 1 << 20
#: Groups up to which their table is broadcast.
MANY_GROUPS = 50_000

_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_GROUP = "lang string, source string"


def terms(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a whole text with A-Z lower-cased, as UTF-8; a null has none."""
    return text.encode("utf-8", "replace").translate(_LETTERS).split() if text else []


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term (binary), n (occurrences), docs (documents with it): partial counts of each task, several rows a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        seen: dict[tuple, Counter] = defaultdict(Counter)

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in n.items():
                words, k = list(c), len(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(words, pa.binary()), pa.array(list(c.values()), pa.int64()), pa.array([seen[lang, source][w] for w in words], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            n.clear(), seen.clear()

        for batch in pieces(batches, "text"):
            for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text")), strict=True):
                if words := terms(text):
                    n[lang, source].update(words)
                    seen[lang, source].update(set(words))
            if sum(map(len, n.values())) > HELD:
                yield from given()
        yield from given()

    return docs.mapInArrow(run, f"{_GROUP}, term binary, n long, docs long")


def kept_terms(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, per (source and n): terms in at least ``least`` documents of their language, with their count by source."""
    by_source = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    both = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("per"))
    return both.filter(F.col("docs") >= least).drop("docs")


def _chunks(kept: DataFrame) -> DataFrame:
    """lang, terms (a sorted run of kept ones), who and term (of each count), n: cut where a language or a chunk ends."""
    rows = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, who, what, n = None, [], [], [], []

        def given() -> pa.RecordBatch:
            kinds = (pa.string(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((at, words, who, what, n), kinds, strict=True)], ["lang", "terms", "who", "term", "n"])

        for batch in batches:
            for lang, word, per in zip(*(batch[c].to_pylist() for c in ("lang", "term", "per")), strict=True):
                if words and (lang != at or len(words) >= WIDTH):
                    yield given()
                    words, who, what, n = [], [], [], []
                at = lang
                words.append(word)
                for x in per:
                    who.append(x["source"])
                    what.append(word)
                    n.append(x["n"])
        if words:
            yield given()

    return rows.mapInArrow(run, "lang string, terms array<binary>, who array<string>, term array<binary>, n array<long>")


def frequency(count: np.ndarray, total: np.ndarray | int, scale: int = SCALE) -> np.ndarray:
    """1 + floor(scale * count / total) without rounding, for 0 <= count <= total: long division, three digits at a time."""
    total = np.asarray(total)
    if total.size and int(total.max()) > (1 << 63) // 1000:
        return np.array(1 + scale * count.astype(object) // total.astype(object), np.int64)
    out, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def scored_chunk(words: list[bytes], who: list[str], what: list[bytes], n: list[int], groups: list[tuple[str, int]], v: int, ranks: int = RANKS) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Of a chunk of a language's kept terms: the differences of all pairs of its groups (source and sum, sorted), and for
    each group the ``ranks`` terms it uses most above the language, as (group, term, value)."""
    kept, sources = np.array([*words, None], object)[:-1], np.array([*(g[0] for g in groups), None], object)[:-1]
    row, column, n = np.searchsorted(sources, np.array([*who, None], object)[:-1]), np.searchsorted(kept, np.array([*what, None], object)[:-1]), np.array(n, np.int64)
    sums = np.array([g[1] for g in groups], np.int64)
    total, everything = (sums + 2 * v)[:, None], int(sums.sum()) + 2 * v
    pairs, best, width = np.zeros((len(groups), len(groups)), np.int64), [[] for _ in groups], max(1, CELLS // max(len(groups), 1))
    for at in range(0, len(kept), width):
        w = min(width, len(kept) - at)
        here = (column >= at) & (column < at + w)
        cell = row[here] * w + column[here] - at
        counts = np.bincount(cell, minlength=len(groups) * w)  # each cell has one sum at most
        counts[cell] = n[here]  # whole numbers, beyond what weights hold exactly
        counts = counts.reshape(len(groups), w)
        p, q = frequency(counts + 2, total), frequency(counts.sum(0) + 2, everything)
        for i in range(len(groups) - 1):
            apart = _difference(p[i], p[i + 1 :]).sum(1)
            pairs[i, i + 1 :] += apart
            pairs[i + 1 :, i] += apart
        for i in range(len(groups)):
            ids = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            f = _difference(p[i, ids], q[ids])
            first = np.lexsort((ids, -f))[:ranks]
            best[i] = sorted([*best[i], *((-int(f[j]), int(ids[j]) + at) for j in first)])[:ranks]
    return pairs, [(i, t, -f) for i, x in enumerate(best) for f, t in x]


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank for each source of each language of docs (text, lang, source).

    Part ``pair``: every other source of the language as item, value the summed difference of all kept terms' frequencies (0
    without kept terms). Part ``term``: the ``ranks`` terms with the greatest differences among those that the source uses
    more often than its language. Ranks go by value, then by item in UTF-8 order. Null text, lang and source are ''; repeated
    rows count each; an empty table gives no rows, a language's only source no pairs. Other columns aren't read. Vectors are
    as wide as a language has sources, which also sets the number of its pairs.
    """
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(say("lang"), say("source"), say("text"))
    kept = written(kept_terms(counted(docs), least), "kept-terms")
    sums = kept.select("lang", F.explode("per").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n")).unionByName(sums).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    told = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups")).join(sizes, "lang", "left")
    told = small(told.select("lang", F.to_json("groups").alias("groups"), F.coalesce("v", F.lit(0).cast("long")).alias("v")), MANY_GROUPS)
    kinds = {"terms": "array<binary>", "who": "array<string>", "term": "array<binary>", "n": "array<long>"}
    none = told.select("lang", *(F.array().cast(k).alias(c) for c, k in kinds.items()))  # languages without kept terms have pairs, too
    rows = _chunks(kept).unionByName(none).join(told.select("lang", F.from_json("groups", "array<struct<source:string,n:long>>").alias("groups"), "v"), "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                r = batch.slice(i, 1).to_pylist()[0]
                sums = {g["source"]: g["n"] for g in r["groups"]}
                order = sorted(sums)  # by code point, which is the order of UTF-8, too
                pairs, best = scored_chunk(r["terms"], r["who"], r["term"], r["n"], [(s, sums[s]) for s in order], r["v"], ranks)
                out = [(order[i], "pair", order[j], int(pairs[i, j])) for i in range(len(order)) for j in range(len(order)) if i != j]
                out += [(order[i], "term", r["terms"][t].decode("utf-8", "replace"), f) for i, t, f in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * len(out), pa.string()), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))], ["lang", "source", "part", "item", "value"])

    parts = rows.mapInArrow(run, f"{_GROUP}, part string, item string, value long")
    values = written(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "differences")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs, best = (values.filter(F.col("part") == part).select("*", place) for part in ("pair", "term"))
    return pairs.unionByName(best.filter(F.col("rank") <= ranks))
