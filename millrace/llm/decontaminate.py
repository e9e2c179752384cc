"""Benchmark decontamination by Wu-Manber search for many strings at once.

Strings are sequences of words: each window of 13 words of an item, or a shorter item as a whole. A shift table over
blocks of words says how far a search may jump; where a block ends some string, its bucket, split by the string's first
words, names the candidates, and comparing all words decides. Tables go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, pieces, text_of, written

WINDOW = 13
#: A broadcast set of tables holds items of at most so many bytes of text (one longer item makes a set of its own).
SET_BYTES = 2_000_000


class Tables:
    """Shift table and buckets for word strings of at least ``least`` words."""

    BLOCK = 3

    def __init__(self, strings: dict[tuple[bytes, ...], set[int]]):
        self.least = min(map(len, strings))
        self.block = min(self.BLOCK, self.least)
        self.default = self.least - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for words, items in strings.items():
            for end in range(self.block, self.least + 1):
                part = words[end - self.block : end]
                self.shift[part] = min(self.shift.get(part, self.default), self.least - end)
            self.buckets[words[self.least - self.block : self.least]][words[0]].append((words, items))
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, set[int]]]:
        """(start, end, items) of each occurrence."""
        shift, block, least, default, n = self.shift, self.block, self.least, self.default, len(words)
        end = least
        while end <= n:
            part = tuple(words[end - block : end])
            jump = shift.get(part, default)
            if jump:
                end += jump
                continue
            start = end - least
            for string, items in self.buckets[part].get(words[start], ()):
                if tuple(words[start : start + len(string)]) == string:
                    yield start, start + len(string), items
            end += 1


def _tables(items: list[tuple[int, str]], window: int) -> list[Tables]:
    whole, short = defaultdict(set), defaultdict(set)
    for item, text in items:
        words = alnum_words(text)
        for i in range(len(words) - window + 1):
            whole[tuple(words[i : i + window])].add(item)
        if 0 < len(words) < window:
            short[tuple(words)].add(item)
    return [Tables(x) for x in (whole, short) if x]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _pass(docs: DataFrame, items: list[tuple[int, str]], window: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(items)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(held.value, window)
        for batch in pieces(batches, "text"):
            counts, spans, found = [], [], []
            for text, old, known in zip(batch["text"].to_pylist(), batch["_spans"].to_pylist(), batch["_items"].to_pylist(), strict=True):
                words = alnum_words(text)
                hits, who = [tuple(x) for x in old], set(known)
                for t in tables:
                    for start, end, item in t.find(words):
                        hits.append((start, end))
                        who |= item
                counts.append(len(words))
                spans.append([list(x) for x in _merged(hits)])
                found.append(sorted(who))
            new = {"_words": pa.array(counts, pa.int64()), "_spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "_items": pa.array(found, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """docs with n_words, n_hit, hits (array of [first, end) word ranges), items (ids that occur, ascending), contaminated.

    A document is contaminated if n_hit > 0 and 20 * n_hit >= n_words. Null and empty texts have no words. Items without an
    id or words match nothing; items of one id count once. Other columns of docs are kept, columns of these names replaced.
    """
    items = text_of(benchmark, "item_id", "text").filter("item_id is not null and text is not null").withColumn("bytes", F.octet_length("text"))
    total = items.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    sets = max(1, -(-2 * total // set_bytes)) if total > set_bytes else 1
    new = ("n_words", "n_hit", "hits", "items", "contaminated", "_words", "_spans", "_items")
    found = docs.drop(*new).withColumns({"_words": F.lit(0).cast("long"), "_spans": F.array().cast("array<array<bigint>>"), "_items": F.array().cast("array<bigint>")})
    for k in range(sets):
        part = items if sets == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(sets)) == k)
        found = _pass(found if k == 0 else written(found, "scanned"), [(r["item_id"], r["text"]) for r in part.select("item_id", "text").toLocalIterator()], window)
    dirty = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.withColumnsRenamed({"_words": "n_words", "_spans": "hits", "_items": "items"}).withColumn("n_hit", F.expr("aggregate(hits, 0L, (a, x) -> a + x[1] - x[0])")).withColumn("contaminated", dirty)


def digest(found: DataFrame) -> DataFrame:
    """The columns of op7 from scan()'s rows."""
    ids = F.sha2(F.expr("array_join(array_sort(transform(items, x -> cast(x as string))), ',')"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")
