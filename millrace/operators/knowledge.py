"""Chunks, duplicates, links, entities and vectors of a knowledge base."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strip_tags, unit_vector
from ..store import written

#: Rows and bytes of a query set that are sent to all tasks at once.
QUERY_ROWS, QUERY_BYTES = 4096, 16 << 20
#: Queries and vectors of a task that are multiplied in one go.
AT_ONCE, VECTORS_AT_ONCE = 256, 2048
#: Passages, and bytes of passages, that are compared at once.
PASSAGES, PASSAGE_BYTES = 1000, 2 << 20
#: Words, and which of them are names.
WORD, NAME = r"\p{L}+", r"^\p{Lu}\p{Ll}+$"


def chunk_count(text: Column, size: int = 800, overlap: int = 0) -> Column:
    """Number of a text's chunks, see chunk(); 0 for null and empty texts."""
    if size <= overlap:
        raise ValueError("the overlap must be below the size")
    return F.when(F.length(text) > 0, F.greatest(F.ceil((F.length(text) - overlap) / (size - overlap)), F.lit(1)).cast("int")).otherwise(0)


def name_count(text: Column) -> Column:
    """Number of different names in a text, see names(); 0 for null texts."""
    return F.coalesce(F.size(F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _named))), F.lit(0))


def chunk(docs: DataFrame, size: int = 800, overlap: int = 0) -> DataFrame:
    """doc_id, pos, chunk: pieces of ``size`` characters, each starting size - overlap after the one before. Empty texts have none."""
    step, last = size - overlap, chunk_count(F.col("text"), size, overlap) - 1
    at = docs.filter(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    return at.select("doc_id", F.col("pos").cast("long").alias("pos"), F.substring("text", F.col("pos") * step + 1, F.lit(size)).alias("chunk"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Digest of the lower-cased text, its smallest doc_id and copies, for texts with more than one copy."""
    return docs.filter("text is not null").groupBy(F.md5(F.lower("text")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).filter("copies > 1")


def links(pages: DataFrame) -> DataFrame:
    """page_id, host of its address, n_links (targets in the page), text_chars without tags."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return pages.select("page_id", host.alias("host"), F.regexp_count("html", F.lit('href="')).cast("long").alias("n_links"), F.length(strip_tags(F.col("html"))).cast("long").alias("text_chars"))


def top_cosine(queries: DataFrame, vectors: DataFrame, k: int = 5, floor: float = -1.0, block: int = QUERY_ROWS) -> DataFrame:
    """query_id, vec_id, score, rank: the k best vectors of each query, from ``floor`` on.

    The query set goes to every task, in blocks of at most ``block`` rows and QUERY_BYTES bytes (a scan of the vectors for each);
    a task multiplies its vectors with a block as matrices and keeps its own best k for each query, so that what is shuffled
    is k rows a query and task. Ties go to the smaller vec_id. Queries and vectors without a length, or of another width than
    the queries' first, meet nobody.
    """
    unit = lambda df: df.select("vec_id", unit_vector("embedding").alias("u")).filter("u is not null and vec_id is not null")
    q, v, spark = written(unit(queries), "queries"), unit(vectors), queries.sparkSession
    n, width = q.agg(F.count("*"), F.max(F.size("u"))).first()
    blocks = max(1, -(-n // max(1, min(block, QUERY_BYTES // (8 * (width or 1))))))
    schema = "query_id long, vec_id long, score double"
    parts = []
    for i in range(blocks):
        some = q.filter((F.size("u") == (width or 0)) & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)).toArrow()
        held = spark.sparkContext.broadcast((some["vec_id"].to_numpy(), _matrix(some["u"].combine_chunks(), width)))
        parts.append(v.filter(F.size("u") == (width or 0)).mapInArrow(partial(_best, held=held, k=k, floor=floor), schema))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(column: pa.Array, width: int | None) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width or 1)


def _best(batches: Iterator[pa.RecordBatch], held, k: int, floor: float) -> Iterator[pa.RecordBatch]:
    """The k best of a task's vectors for each query of a block: of AT_ONCE queries at once, those scores are sorted that reach
    the k-th best so far and of their own slice."""
    ids, q = held.value
    best_id, best = np.zeros((len(ids), k), np.int64), np.full((len(ids), k), -np.inf)
    for batch in batches:
        for at in range(0, len(batch) if len(ids) else 0, VECTORS_AT_ONCE):
            some = batch.slice(at, VECTORS_AT_ONCE)
            them, m = some["vec_id"].to_numpy(), _matrix(some["u"], q.shape[1]).T
            for of in range(0, len(ids), AT_ONCE):
                mine = slice(of, of + AT_ONCE)
                score = np.round(q[mine] @ m, 4)
                score[(ids[mine, None] == them[None]) | (score < floor)] = -np.inf
                least = best[mine, -1:]
                if score.shape[1] > k:
                    least = np.maximum(least, np.partition(score, -k, 1)[:, -k, None])
                row, column = np.nonzero((score >= least) & (score > -np.inf))
                if not len(row):
                    continue
                n = len(score)
                rows = np.concatenate([np.repeat(np.arange(n), k), row])
                scores, every = np.concatenate([best[mine].ravel(), score[row, column]]), np.concatenate([best_id[mine].ravel(), them[column]])
                order = np.lexsort((every, -scores, rows))
                place = np.arange(len(order)) - np.searchsorted(rows[order], np.arange(n))[rows[order]]
                order = order[place < k]  # k of each row, as each had k before
                best[mine], best_id[mine] = scores[order].reshape(n, k), every[order].reshape(n, k)
    row, column = np.nonzero(best > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(best_id[row, column], pa.int64()), pa.array(best[row, column], pa.float64())], ["query_id", "vec_id", "score"])


def _parts(text: Column | str) -> Column:
    return F.filter(F.split(text, r"[^A-Za-zÀ-ÿ]+"), lambda w: w != "")


def containing(docs: DataFrame, passages: DataFrame, most: int = PASSAGES, size: int = PASSAGE_BYTES) -> DataFrame:
    """docs' doc_id and item_id for each row of docs (doc_id, text) whose text contains a passage of passages (item_id, passage).

    The longest inner word of a passage must be a word of the text; the words of a text that are such words lead to the passages
    it is compared with, in the row that holds the text. Passages go to all tasks in blocks of at most ``most`` rows and about
    ``size`` bytes (a scan of docs for each); texts never move. Passages of one or two words are compared with all texts. Null
    passages and texts contain nothing; repeated rows on either side count each.
    """
    inner = F.filter(_parts("passage"), lambda w, i: (i > 0) & (i < F.size(_parts("passage")) - 1))  # first and last may be parts of longer words
    anchor = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    draw = F.xxhash64(F.monotonically_increasing_id()).alias("_draw")
    cases = written(passages.filter("passage is not null").select("item_id", "passage", anchor.alias("w"), draw), "passages")
    n, total = cases.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()
    blocks = max(1, -(-n // most), -(-total // size))
    docs = docs.select("doc_id", "text").filter("text is not null")
    found = []
    for i in range(blocks):
        some = cases.filter(F.pmod("_draw", F.lit(blocks)) == i).drop("_draw")
        anchors = [r["w"] for r in some.select("w").filter("w is not null").distinct().collect()]  # at most ``most``
        if anchors:
            met = docs.withColumn("w", F.explode(F.array_intersect(_parts("text"), F.lit(anchors))))
            found.append(met.join(F.broadcast(some), "w").filter(F.contains("text", F.col("passage"))).select("doc_id", "item_id"))
        short = [(r["item_id"], r["passage"]) for r in some.filter("w is null").select("item_id", "passage").collect()]
        if short:
            told = F.array(*(F.struct(F.lit(k).alias("item_id"), F.lit(p).alias("p")) for k, p in short))
            found.append(docs.select("doc_id", F.inline(F.filter(told, lambda x: F.contains(F.col("text"), x["p"])))).select("doc_id", "item_id"))
    none = docs.select("doc_id").limit(0).withColumn("item_id", F.lit(None).cast(passages.schema["item_id"].dataType))
    return reduce(DataFrame.unionByName, found, none)


def answer(found: DataFrame, queries: DataFrame, floor: float) -> DataFrame:
    """query_id and answer: the best vec_id as text, or 'no_answer' below the floor."""
    best = found.filter((F.col("rank") == 1) & (F.col("score") >= floor)).select("query_id", F.col("vec_id").cast("string").alias("best"))
    return queries.select(F.col("vec_id").alias("query_id")).join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit("no_answer")).alias("answer"))


def entities(docs: DataFrame, pattern: str) -> DataFrame:
    """doc_id, entity for each distinct match of the pattern."""
    return docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("entity"))


def _named(w: Column) -> Column:
    return w.rlike(NAME)


def names(docs: DataFrame) -> DataFrame:
    """doc_id, entity for each distinct whole word of a document that is a capital and small letters."""
    words = F.filter(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), _named)
    return docs.select("doc_id", F.explode(F.array_distinct(words)).alias("entity"))


def cooccurrence(docs: DataFrame, reach: int = 10) -> DataFrame:
    """src, dst, docs: pairs of different names (src < dst) of which one is among the ``reach`` words after the other, and in how many documents.

    Each occurrence meets the names of the following words only, so that pairs grow with the words of a document.
    """

    def after(words: Column, a: Column, i: Column) -> Column:
        near = F.transform(F.sequence(i + 1, i + reach), lambda j: F.get(words, j))
        return F.transform(F.filter(near, lambda b: _named(b) & (b != a)), lambda b: F.struct(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")))

    def met(words: Column) -> Column:
        return F.flatten(F.array_compact(F.transform(words, lambda a, i: F.when(_named(a), after(words, a, i)))))

    pairs = F.flatten(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), met))  # the words are taken once
    return docs.select("doc_id", F.inline(pairs)).groupBy("src", "dst").agg(F.count_distinct("doc_id").alias("docs"))


def neighbours(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id, hop of all nodes within that many hops of start (id) over edges (src, dst); the least hop of each.

    Each hop's new nodes are written: a hop reads the edges of these only, and the plan stays as short however many hops there
    are. It ends early where nothing new is found. Targets are made distinct before they meet the nodes that are known, so
    that a hub costs its edges once.
    """
    found = [written(start.select("id", F.lit(0).alias("hop")).filter("id is not null").distinct(), "hop")]
    for hop in range(1, hops + 1):
        new = found[-1].join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).filter("id is not null").distinct()
        new = written(new.join(reduce(DataFrame.unionByName, found).select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), "hop")
        if new.isEmpty():
            break
        found.append(new)
    return reduce(DataFrame.unionByName, found)
